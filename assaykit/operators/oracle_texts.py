"""SQL for DuckDB that gives the rows of the queries of ``texts`` from the fields themselves."""

from __future__ import annotations

from assaykit.operators.oracle import _INTENT, _ONCE, _SECTIONS, _fields, _host, _norm, _path, _trim

_SNIPPET = "A snippet of the page as a search engine shows it, long enough for a block to count."
_MATERIALS = ("alumina", "zircon", "silicon carbide", "graphite", "magnesi", "spinel", "castable", "clay")


def _line(c: str) -> str:
    return f"coalesce(regexp_replace({c}, '\\s+', ' ', 'g'), '')"


_FIRST = f"'### 1. ' || {_line('title')} || chr(10) || '- **URL**: ' || {_line('url')} || chr(10) || '{_SNIPPET}' || chr(10)"
_QUERY1 = f"'## Query 1: who' || chr(10) || {_FIRST} || '### 2. short' || chr(10)"
_QUERY2 = f"'## Query 2: what' || chr(10) || '### 1. page of ' || {_line('publisher')} || chr(10) || 'see www.example.test/row/' || source_row || '. {_SNIPPET}' || chr(10)"
_HITS = r"""list_distinct_kept as (select source_row, list_concat(regexp_extract_all(x, '(?m)^- \*\*URL\*\*:\s*(\S+)', 1), regexp_extract_all(x, 'https?://[^\s<>"\]|]+'), regexp_extract_all(x, '(?:^|[^/\w.])(www\.[^\s<>"\]|]+)', 1)) as found from texts)"""
_HITS_OF = f"""{_HITS}, hit as (select source_row, unnest(found) as raw, generate_subscripts(found, 1) as k from list_distinct_kept),
clean as (select source_row, k, {_norm("regexp_replace(raw, '[.,;:!?''\"]+$', '')")} as url from hit)"""
_SITES = f"""sites as (select bundle_id, site from (select b.bundle_id, regexp_replace({_host('n')}, '^www\\.', '') as site from (select b.bundle_id, {_norm('i.website')} as n from evidence_bundles b join input_records i using (record_id)) b) where contains(site, '.'))"""
_OWN = f"""{_SITES}, own as (select h.*, site from (select *, {_host('n')} as full_host from (select *, {_norm('url')} as n from sources) where n <> '') h join sites using (bundle_id) where full_host = site or ends_with(full_host, '.' || site))"""
_SUBST = f"""length(t) >= 80 and not regexp_matches(t, 'captcha|cloudflare|verify you are human|access denied|enable javascript|checking your browser|unusual traffic|security check') and not regexp_matches(t, '^(error|api key|not found|unauthorized|extract_invalid_content)')"""
_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_LABEL = "coalesce(nullif(x.title, ''), x.url, '')"
_STAGE = "case when score is not null then '' when contains(e, 'evidence') or contains(e, 'timeout') then 'retrieval' when contains(e, 'JSON') then 'structured_extraction' else 'scoring' end"

ORACLE: dict[str, str] = {
    "search_result_urls": f"""with texts as (select source_row, {_QUERY1} || {_QUERY2} as x from sources), {_HITS_OF}, once as (select source_row, url, min(k) as k from clean where url <> '' group by 1, 2)
select source_row, (row_number() over (partition by source_row order by k) - 1)::int as pos, url from once""",
    "search_result_sections": f"""with blocks as (select source_row, 1 as b, {_FIRST} as x from sources union all select source_row, 2, replace({_QUERY2}, '## Query 2: what' || chr(10), '') from sources), texts as (select source_row * 2 + b - 1 as source_row, x from blocks),
{_HITS_OF}, top as (select source_row // 2 as source_row, source_row % 2 as b, min_by(url, k) as url from clean where url <> '' group by 1, 2)
select source_row, (row_number() over (partition by source_row order by b) - 1)::int as pos, url from top""",
    "batch_query_sections": f"select source_row, 'identity' as slot, length({_QUERY1})::int as chars from sources union all select source_row, 'offering', length({_QUERY2})::int from sources",
    "clean_search_urls": f"""select source_row, {_norm("regexp_replace(" + _trim("coalesce(url, '')") + ", '[.,;:!?''\"\\])}}>]+$', '')")} as url from sources""",
    "page_links": f"""select source_row, 0 as pos, 'https://page.test/row/' || source_row as url, trim({_line('title')}) as title, 'Products & more' as heading, right('Products & more ' || trim('Rows of ' || {_line('publisher')}), 300) as context from sources
union all select source_row, 1, 'https://other.test/x', 'Other', 'Others', right('Products & more ' || trim('Rows of ' || {_line('publisher')}) || case when trim({_line('title')}) = '' then '' else ' ' || trim({_line('title')}) end || ' Others', 300) from sources""",
    "site_page_links": "select source_row, 0 as pos, 'https://www.page.test/base/a/' || source_row as url, 'A' as title from sources union all select source_row, 1, 'https://sub.page.test/b', 'B' from sources",
    "repaired_answers": f"""with {_ONCE} select run_id, idx, case idx % 5 when 2 then 'commas' when 3 then 'quotes' when 4 then 'literal' else 'strict' end as strategy,
case when idx % 5 = 3 then 'the "run ' || run_id || '" of it' else 'run ' || run_id end as note, score::int as score from once""",
    "structured_facts": f"""with {_SECTIONS}, f as (select bundle_id, section, title as statement, left(body, 60) as quote, body, cast(section[2:] as int) as pos from sections), g as (select *, {{n}} as qn, {{b}} as bn from f),
held as (select bundle_id, pos, statement, section from g where length(trim(statement)) >= 8 and length(trim(quote)) >= 12 and qn <> '' and contains(bn, qn))
select bundle_id, (row_number() over (partition by bundle_id order by pos))::int as fact_no, statement, section as sources from held""".replace("{n}", "{0}").replace("{b}", "{1}"),
    "evidence_states": "select case when coalesce(regexp_matches(text, '(?m)^## S\\d+[ \\t]*$'), false) then 'usable' else 'unscorable' end as state, count(*) as packs from evidence_bundles group by 1",
    "reference_repair": """with k as (select bundle_id, coalesce(list_transform(sources, lambda s: s.id), []) as active from evidence_bundles), m as (select *, case when bundle_id % 2 = 0 then list_filter(['S2', 'S1'], lambda i: list_contains(active, i)) else [] end as kept from k)
select bundle_id, array_to_string(case when len(kept) > 0 then kept else active[1:3] end, ',') as ids from m""",
    "assembled_rows": f"""with {_ONCE}, r as (select *, array_to_string(coalesce(errors, []), ';') as e from once where record_id is not null), s as (select *, {_STAGE} as stage, row_number() over (partition by record_id order by run_id, idx) as a, row_number() over (partition by record_id order by run_id desc, idx desc) as b from r)
select i.record_id, i.contact_count as manual, f.score as baseline, f.stage as baseline_stage, l.score as candidate, l.follow_up, l.stage as candidate_stage, l.score - f.score as change from input_records i join s f on f.record_id = i.record_id and f.a = 1 join s l on l.record_id = i.record_id and l.b = 1""",
    "role_sizes": """with g as (select source, count(*) as calls, list_sort(list(length(text))) as l from documents where source is not null and text is not null group by 1)
select source, calls, (l[(calls - 1) // 2 + 1] + l[calls // 2 + 1]) / 2 as median, l[least(calls - 1, floor(calls * 0.95))::int + 1] as p95, l[-1] as longest from g""",
    "direct_materials": f"""with {_OWN}, t as (select *, lower(translate(concat_ws(' ', n, title), '-_', '  ')) as x from own), s as (select *, {" + ".join(f"(case when regexp_matches(x, '{m}') then 1 else 0 end)" for m in _MATERIALS)} as score from t)
select bundle_id, place::int as place, source_row, score::int as score from (select *, row_number() over (partition by bundle_id order by score desc, n desc, source_row) as place from s where score > 0) where place <= 8""",
    "linked_pages": f"""with {_SECTIONS}, {_OWN}, p as (select *, lower({_path('n')}) as p, regexp_replace(full_host, '^www\\.', '') || ' ' || {_path('n')} || ' ' || array_to_string({_fields('n')}, '&') as key from own), i as (select *, {_INTENT} as intent from p),
held as (select bundle_id, regexp_replace({_host('n')}, '^www\\.', '') || ' ' || {_path('n')} || ' ' || array_to_string({_fields('n')}, '&') as key from (select bundle_id, {_norm('url')} as n from sections) where n <> '')
select bundle_id, source_row, intent::int as intent from (select *, row_number() over (partition by bundle_id order by intent desc, source_row) as m from i where intent > 0 and not exists (select 1 from held where held.bundle_id = i.bundle_id and held.key = i.key)) where m <= 2""",
    "fallback_pages": f"""with {_SECTIONS}, t as (select bundle_id, lower({_trim('body')}) as t from sections), kept as (select distinct bundle_id from t where {_SUBST})
select bundle_id, source_row from (select bundle_id, source_row, row_number() over (partition by bundle_id order by source_row) as m from sources s where not exists (select 1 from kept k where k.bundle_id = s.bundle_id)) where m <= 4""",
    "kept_extracts": f"""with {_SECTIONS}, t as (select *, lower({_trim('body')}) as t, row_number() over (partition by bundle_id order by cast(section[2:] as int)) as m from sections)
select bundle_id, section, coalesce(nullif(trim(regexp_extract(body, '(?m)^#+ *([^#\\s].*)$', 1)), ''), url) as heading from t where m <= 4 and {_SUBST}""",
    "recovered_packs": """with g as (select record_id, bundle_id, list_filter([case when regexp_matches(t, '.') and not regexp_matches(t, 'alumina') then 'no_alumina' end, case when regexp_matches(t, '.') and not regexp_matches(t, 'furnace|ofen|horno') then 'no_furnace' end], lambda x: x is not null) as gaps
from (select record_id, bundle_id, lower(coalesce(text, '')) as t from evidence_bundles where record_id is not null)), k as (select record_id, min_by(gaps, bundle_id) as p, max_by(gaps, bundle_id) as r, count(*) as n from g group by 1),
u as (select *, n > 1 and len(list_filter(p, lambda x: not list_contains(r, x))) > 0 as use from k) select record_id, case when use then 'recovered' else 'primary' end as source, array_to_string(case when use then r else p end, ',') as gaps from u""",
    "shown_results": f"""with {_ONCE} select run_id, idx, left({_trim("coalesce(follow_up, '')")}, 20) as follow_up, case when isfinite(duration_seconds) then round(duration_seconds, 2) end as seconds, case when score between 0 and 100 then score end as score,
array_to_string(list_filter(list_transform(coalesce(errors, []), lambda x: left({_trim("coalesce(x, '')")}, 40)), lambda x: x <> '')[1:3], '|') as errors from once""",
    "shown_links": f"select source_row, case when regexp_matches(t, '^https?://[^\\s]+$') and length(t) <= 2000 then t else '' end as url from (select source_row, {_trim("coalesce(url, '')")} as t from sources)",
    "request_fields": f"select record_id, case when record_id % 3 = 0 and industry is not null then 'branch' else '' end as unknown, length({_trim("coalesce(name, '')")}) between 1 and 300 as named from input_records",
    "flat_texts": "select bundle_id, array_to_string(list_filter(flatten(list_transform(coalesce(sources, []), lambda x: [x.id, x.url, x.title])), lambda x: x is not null and x <> ''), '|') as texts from evidence_bundles",
    "text_shapes": """select bundle_id, coalesce(case when json_valid(retrieval) and json_type(retrieval) = 'OBJECT' then list_sort(json_keys(retrieval)) = ['mode', 'pages', 'queries', 'seconds'] and json_type(retrieval, '$.mode') = 'VARCHAR' and json_type(retrieval, '$.pages') in ('UBIGINT', 'BIGINT')
and json_type(retrieval, '$.queries') in ('UBIGINT', 'BIGINT') and json_type(retrieval, '$.seconds') in ('UBIGINT', 'BIGINT', 'DOUBLE') else false end, false) as same from evidence_bundles""",
    "record_markdown": "select record_id, array_to_string(list_filter([" + ", ".join(f"case when {_trim(f'coalesce({c}, chr(32))')} <> '' then '- **{label}**: ' || {_trim(c)} end" for c, label in (("name", "Name"), ("website", "Website"), ("country", "Country"), ("industry", "Industry"))) + "], lambda x: x is not null), chr(10)) as markdown from input_records",
    "source_links": f"""with k as (select bundle_id, list_filter(list_transform(['S2', 'S1', 'S99'], lambda i: list_filter(coalesce(sources, []), lambda s: s.id = i)[1]), lambda x: x is not null) as l from evidence_bundles)
select bundle_id, array_to_string(list_transform(l, lambda x: case when coalesce(regexp_matches(x.url, '^https?://'), false) then '[' || {_LABEL} || '](' || x.url || ')' else {_LABEL} end), '；') as markdown,
array_to_string(list_transform(l, lambda x: case when coalesce(regexp_matches(x.url, '^https?://'), false) then '<a href="' || {_ESCAPED.format('x.url')} || '">' || {_ESCAPED.format(_LABEL)} || '</a>' else {_ESCAPED.format(_LABEL)} end), '；') as html from k""",
    "streamed_overview": """with o as (select run_id, idx, any_value(status) as status, any_value(duration_seconds) as d, any_value(finished_at) as f from results where finished_at is not null group by 1, 2)
select date_trunc('hour', f) as hour, run_id, count(*) as selected, count(*) filter (status = 'valid') as valid from o group by 1, 2""",
    "json_round_trip": "select id, name, website, country, contact_count from input_records",
    "markdown_round_trip": "select record_id::int as record_id, " + ", ".join(f"replace(trim(regexp_replace(coalesce({c}, ''), '\\s*\\n\\s*', ' ', 'g')), '**', '') as {c}" for c in ("name", "industry")) + " from input_records",
    "input_ids": f"select record_id, coalesce(nullif({_trim('id')}, ''), format('input-{{:03d}}', row_number() over (order by record_id))) as id from input_records",
    "assessment_markdown": """with d as (select *, row_number() over (partition by bundle_id order by pos, direction_id) as m from directions where bundle_id is not null),
l as (select bundle_id, string_agg('| ' || regexp_replace(replace(coalesce(product, ''), '|', '\\|'), '\\s*\\n\\s*', ' ', 'g') || ' | ' || regexp_replace(replace(coalesce(priority, ''), '|', '\\|'), '\\s*\\n\\s*', ' ', 'g') || ' |', chr(10) order by pos, direction_id) as lines from d where m <= 3 group by 1)
select bundle_id, '# ' || coalesce(company, '') || chr(10) || chr(10) || '| Product | Priority |' || chr(10) || '| --- | --- |' || chr(10) || lines as markdown from l join evidence_bundles using (bundle_id)""",
}
_QUOTE = "regexp_replace(lower(regexp_replace(regexp_replace({0}, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\*\\*|__', '', 'g')), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"
ORACLE["structured_facts"] = ORACLE["structured_facts"].replace("{0}", _QUOTE.format("quote")).replace("{1}", _QUOTE.format("body"))

__all__ = ["ORACLE"]
