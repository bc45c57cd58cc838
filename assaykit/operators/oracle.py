"""SQL for DuckDB that gives the rows of the queries of the same name."""

from __future__ import annotations

_WS = r"'^[\s 　​﻿]+|[\s 　​﻿]+$'"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, {_WS}, '', 'g')"


def _norm(x: str) -> str:
    t = _trim(f"coalesce({x}, '')")
    bare = f"regexp_replace(regexp_replace(case when contains({t}, '://') then {t} else 'https://' || {t} end, '#.*$', ''), '/+$', '')"
    return f"case when regexp_matches({bare}, '^(?i:https?)://[^/?#\\s]+') then regexp_replace({bare}, '^(?i:(https?))://', '\\1://') else '' end"


def _host(norm: str) -> str:
    return f"lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract({norm}, '^(?i:https?)://([^/?#]*)', 1), '^.*@', ''), ':\\d*$', ''), '\\.+$', ''))"


def _path(norm: str) -> str:
    raw = f"regexp_replace(regexp_replace(regexp_replace(regexp_extract({norm}, '^(?i:https?)://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/+', '/', 'g'), '/$', '')"
    up = f"array_to_string(list_transform(string_split({raw}, '%'), lambda p, i: case when i > 1 and regexp_matches(p, '^[0-9A-Fa-f]{{2}}') then upper(p[1:2]) || p[3:] else p end), '%')"
    return f"case when {raw} = '' then '/' else {up} end"


def _fields(norm: str) -> str:
    return f"list_filter(string_split(case when contains({norm}, '?') then regexp_extract({norm}, '\\?(.*)$', 1) else '' end, '&'), lambda f: f <> '' and lower(split_part(f, '=', 1)) not in ('srsltid', 'gclid', 'fbclid') and not starts_with(lower(split_part(f, '=', 1)), 'utm_'))"


_SECTIONS = """parts as (
  select bundle_id, unnest(string_split(regexp_replace(text, '(^|\\n)## (S\\d+)[ \\t]*(\\n|$)', '\\1' || chr(2) || '\\2' || '\\3', 'g'), chr(2))[2:]) as raw from evidence_bundles
), sections as (
  select bundle_id, regexp_extract(raw, '^(S\\d+)', 1) as section, regexp_extract(raw, '(?m)^URL:[ \\t]*(.*)$', 1) as url, regexp_extract(raw, '(?m)^Title:[ \\t]*(.*)$', 1) as title,
    regexp_replace(raw, '^S\\d+\\n(?:URL:[^\\n]*\\n)?(?:Title:[^\\n]*\\n?)?', '') as body from parts
)"""
_ONCE = """once as (
  select * exclude (rn) from (select *, row_number() over (partition by run_id, idx order by loaded_at desc, finished_at desc) as rn from results) where rn = 1
)"""
_HOSTED = f"""normed as (select *, {_norm('url')} as n from sources), hosted as (select *, regexp_replace({_host('n')}, '^www\\.', '') as host from normed where n <> '')"""
_COUNTS = """sum(case when p and score >= t then 1 else 0 end)::bigint as tp, sum(case when not p and score >= t then 1 else 0 end)::bigint as fp, sum(case when not p and score < t then 1 else 0 end)::bigint as tn,
  sum(case when p and score < t then 1 else 0 end)::bigint as fn, sum(case when p and score is null then 1 else 0 end)::bigint as abstain_pos, sum(case when not p and score is null then 1 else 0 end)::bigint as abstain_neg"""
_SCAN = f"""with {_ONCE}, lab as (select score, coalesce(commercial_match, 0) * 10 >= 55 as p from once), c as (
  select t::int as threshold, {_COUNTS} from lab, (select unnest(range(0, 101, 5)) as t) group by t
), r as (select *, case when tp + fp = 0 then 0.0::double else tp / (tp + fp)::double end as precision, case when tp + fn + abstain_pos = 0 then 0.0::double else tp / (tp + fn + abstain_pos)::double end as recall,
  case when tn + fp + abstain_neg = 0 then 0.0::double else tn / (tn + fp + abstain_neg)::double end as specificity from c)
select *, (recall + specificity) / 2 as balanced, case when precision + recall = 0 then 0.0::double else 2 * precision * recall / (precision + recall) end as f1 from r"""
_SIGNALS = " + ".join(f"(case when regexp_matches(lower(coalesce(text, '')), '{p}') then 1 else 0 end)" for p in ("alumina", "zircon", "silicon carbide", "graphite", "magnesi", "spinel"))
_QUANTILE = "list_sort(list(duration_seconds) filter (duration_seconds is not null))"
_INTENT = "case when regexp_matches(p, '/products?$') then 3 when regexp_matches(p, '/(market-)?applications?$') then 2 when regexp_matches(p, '(^|/)[^/]*(product|application|solution|catalog|portfolio)[^/]*(/|$)') then 1 else 0 end"

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u00a0\u3000"
_NARROW = ("".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "  ").replace("'", "''")


def _fold(x: str) -> str:
    """As near as DuckDB comes to compatibility folding: wide forms, accents, case, sharp s."""
    return f"replace(strip_accents(lower(translate({x}, '{_WIDE}', '{_NARROW}'))), 'ß', 'ss')"


_CATS = {"product": (r"\bproducts?\b", 22), "process": ("production|manufactur|process|furnace|melting", 20), "channel": ("distributor|trading|import|export", 12), "technical": ("technical|specification|datasheet|grade", 14)}
_NOISE = ("career", "job", "login", "privacy", "cookie", "event", "news", "blog", "press", "terms", "sitemap", "contact", "imprint")
_LOW = " or ".join(f"host = '{h}' or ends_with(host, '.{h}')" for h in ("facebook.com", "instagram.com", "linkedin.com", "youtube.com", "x.com", "twitter.com", "wikipedia.org", "dnb.com", "kompass.com", "europages.com"))
_TERMS = f"list_filter(regexp_extract_all({_fold("coalesce(company, '')")}, '[\\p{{L}}\\p{{M}}]+'), lambda w: length(w) > 2 and w not in ('company', 'corporation', 'limited', 'ltd', 'gmbh', 'group', 'international', 'srl', 'spa'))"
_POINTS = " + ".join(f"(case when regexp_matches(locator, '{p}') or regexp_matches(folded, '{p}') then {n} else 0 end)" for p, n in _CATS.values())
_MINUS = " + ".join(f"(case when contains(locator, '{w}') then 120 else 0 end)" for w in _NOISE)
_FLAGS = ", ".join(f"case when regexp_matches(locator, '{p}') or regexp_matches(folded, '{p}') then '{n}' end" for n, (p, _) in sorted(_CATS.items()))

def _scored(own: bool) -> str:
    """Scored pages; with the site of the record as the company's host, or without any."""
    dom = f""", dom as (select bundle_id, site from (select b.bundle_id, regexp_replace({_host('n')}, '^www\\.', '') as site from (select b.bundle_id, {_norm('i.website')} as n from evidence_bundles b join input_records i using (record_id)) b) where contains(site, '.'))""" if own else ""
    domain, join = ("d.site", "left join dom d using (bundle_id)") if own else ("null::varchar", "")
    return f"""{_SECTIONS}{dom}, y as (select s.*, {_TERMS} as terms, {_norm('url')} as n, {_fold("url || ' ' || title")} as locator, {_fold('body')} as folded, {domain} as domain from sections s join evidence_bundles b using (bundle_id) {join}),
z as (select *, {_host('n')} as host, {_path('n')} as path, lower({_path('n')}) as p from y), i as (select *, {_INTENT} as intent from z), scored as (select *,
({_POINTS} + case when coalesce(host = domain or ends_with(host, '.' || domain), false) then 35 when {_LOW} then -25 else 0 end + least(15, 5 * len(list_filter(terms, lambda t: contains(locator, t)))) + case when len(list_filter(terms, lambda t: contains(host, t))) > 0 then 25 else 0 end - ({_MINUS})
  + case intent when 1 then 24 when 2 then 32 when 3 then 36 else 0 end - case when regexp_matches(p, 'history|timeline|milestone') then 24 else 0 end + case when p = '/' then 4 else 0 end)::int as relevance,
array_to_string(list_filter([{_FLAGS}], lambda x: x is not null), ',') as categories, cast(section[2:] as int) as pos from i)"""


_SCORED, _SCORED_OWN = _scored(False), _scored(True)

ORACLE: dict[str, str] = {
    "folded_names": f"select record_id, {_fold('name')} as folded from input_records where name is not null",
    "seed_names": f"""with n as (select record_id, coalesce(name, '') as v, {_trim("coalesce(name, '')")} as t from input_records),
p as (select *, list_transform(string_split_regex(t, '\\s*/\\s*'), lambda x: {_trim("regexp_replace(x, '\\s*[(（][^)）]*[)）]\\s*', ' ', 'g')")}) as parts from n)
select record_id, left({_trim("regexp_replace(regexp_replace(regexp_replace(v, '[\"“”„]', '', 'g'), '(?i)\\bsite:\\S+', '', 'g'), '\\s+', ' ', 'g')")}, 120) as seed,
coalesce(list_filter(parts[2:], lambda x: regexp_matches(x, '[A-Za-z]{{2}}') and not regexp_matches(x, '(?i)^\\S+ group$'))[-1], parts[1]) as search_name from p""",
    "record_slugs": "select record_id, case when s = '' then 'record' else s end as slug from (select record_id, left(trim(regexp_replace(coalesce(name, ''), '[^\\p{L}\\p{N}._-]+', '-', 'g'), '-._'), 48) as s from input_records)",
    "pack_addresses": """with u as (select bundle_id, unnest(regexp_extract_all(text, '(?m)^URL:[ \\t]*(\\S.*)$', 1)) as url, generate_subscripts(regexp_extract_all(text, '(?m)^URL:[ \\t]*(\\S.*)$', 1), 1) as k from evidence_bundles),
d as (select bundle_id, rtrim(url) as url, min(k) as k from u group by 1, 2) select bundle_id, (row_number() over (partition by bundle_id order by k) - 1)::int as pos, url from d""",
    "grade_rows": f"""with {_SECTIONS}, l as (select bundle_id, section, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) - 1 as pos from sections),
c as (select bundle_id, section, pos, list_transform(string_split(regexp_replace(line, '^\\||\\|\\s*$', '', 'g'), '|'), lambda x: trim(x)) as cells from l where regexp_matches(line, '^\\|.*\\|\\s*$'))
select bundle_id, section, pos::int as pos, cells[1] as grade, cells[2] as share, cells[3] as density from c where len(cells) = 3 and len(list_filter(cells, lambda x: regexp_matches(x, '^\\d+([.,]\\d+)?$'))) > 0""",
    "bundle_manifest": "select bundle_id, company, coalesce(len(sources), 0)::int as source_count, length(text)::int as chars, sha256(text) = sha256 as hash_holds from evidence_bundles",
    "cached_again": "select sha256(text) as text_hash, count(*) as packs, min(bundle_id) as first_bundle from evidence_bundles group by 1 having count(*) > 1",
    "late_results": f"with {_ONCE} select run_id, count(*) filter (loaded_at > finished_at + interval 1 day) as late, count(*) as n from once group by 1",
    "retrieval_violations": """with j as (select bundle_id, retrieval as r, json_type(retrieval, '$.mode') as tm, retrieval ->> '$.mode' as m, json_type(retrieval, '$.pages') as tp, json_type(retrieval, '$.queries') as tq, json_type(retrieval, '$.seconds') as ts,
 try_cast(retrieval ->> '$.pages' as double) as p, try_cast(retrieval ->> '$.queries' as double) as q, try_cast(retrieval ->> '$.seconds' as double) as s from evidence_bundles)
select bundle_id, case when r is null or not json_valid(r) then 'no JSON' else array_to_string(list_filter([case when not coalesce(tm = 'VARCHAR' and m in ('search', 'cache', 'fallback'), false) then '$.mode: one_of' end, case when not coalesce(tp in ('UBIGINT', 'BIGINT') and p between 1 and 3, false) then '$.pages: integer' end,
 case when not coalesce(tq in ('UBIGINT', 'BIGINT') and q >= 0, false) then '$.queries: integer' end, case when not coalesce(ts in ('UBIGINT', 'BIGINT', 'DOUBLE') and s between 0 and 100, false) then '$.seconds: number' end], lambda x: x is not null), '; ') end as violations from j""",
    "retrieval_totals": """select coalesce(retrieval ->> '$.mode', '') as mode, count(*) as packs, sum((retrieval ->> '$.pages')::int)::bigint as pages, sum((retrieval ->> '$.queries')::int)::bigint as queries, round(avg((retrieval ->> '$.seconds')::double), 4) as mean_seconds from evidence_bundles group by 1""",
    "title_fallback": f"""with {_SECTIONS}, e as (select bundle_id, id, 1 as priority, title from sources union all select bundle_id, s.id, 2, s.title from (select bundle_id, unnest(sources) as s from evidence_bundles) union all select bundle_id, section, 3, title from sections),
g as (select bundle_id, id, priority, max(title) as title from e group by all), k as (select *, row_number() over (partition by bundle_id, id order by priority) as m from g where {_trim("coalesce(title, '')")} <> '') select bundle_id, id, priority, title from k where m = 1""",
    "reserved_sources": f"""with {_HOSTED}, k as (select source_row, bundle_id, case when source_type = '官网' then 0 else 1 end as p, host || ' ' || {_path('n')} || ' ' || array_to_string({_fields('n')}, '&') as key from hosted),
o as (select * from (select *, row_number() over (partition by bundle_id, key order by p, source_row) as m from k) where m = 1)
select bundle_id, source_row, place::int as place from (select *, row_number() over (partition by bundle_id order by p, source_row) as place from o) where place <= 8""",
    "page_relevance": f"with {_SCORED} select bundle_id, section, relevance, categories from scored",
    "own_page_relevance": f"with {_SCORED_OWN} select bundle_id, section, relevance, categories from scored",
    "ranked_pages": f"""with {_SCORED}, k as (select *, row_number() over (partition by bundle_id, regexp_replace(host, '^www\\.', ''), path, array_to_string({_fields('n')}, '&') order by pos) as m from scored)
select bundle_id, section, relevance, (row_number() over (partition by bundle_id order by relevance desc, pos))::int as rank from k where m = 1""",
    "company_domains": f"""with t as (select bundle_id, {_TERMS} as terms from evidence_bundles), h as (select source_row, bundle_id, {_host('n')} as host from (select source_row, bundle_id, {_norm('url')} as n from sources)),
k as (select bundle_id, source_row, host from h join t using (bundle_id) where not ({_LOW}) and len(list_filter(terms, lambda x: contains(host, x))) > 0)
select bundle_id, host as domain from (select *, row_number() over (partition by bundle_id order by source_row) as m from k) where m = 1""",
    "candidate_sample": f"""with c as (select record_id, count(*) filter (status = 'valid') as k from results where record_id is not null group by 1),
r as (select i.record_id, name, industry, coalesce(k, 0) as contacts, updated_at, {_trim("coalesce(background, '')")} as t from input_records i left join c using (record_id)
  where industry in ('STEEL', 'FOUNDRY', 'REFRACTORY', 'CEMENT', 'GLASS', 'NONFERROUS', 'CHEMICAL') and {_trim("coalesce(name, '')")} <> '' and {_trim("coalesce(website, '')")} <> ''),
k as (select *, row_number() over (partition by industry order by (t = '') desc, contacts desc, updated_at desc nulls first, record_id) as industry_rank from r where length(t) < 300)
select record_id, name, industry, contacts, industry_rank::int as industry_rank from k where industry_rank <= 20
order by list_position(['STEEL', 'FOUNDRY', 'REFRACTORY', 'CEMENT', 'GLASS', 'NONFERROUS', 'CHEMICAL'], industry), industry_rank limit 140""",
    "contact_counts": "select record_id, count(*) filter (status = 'valid') as contact_count from results where record_id is not null group by 1",
    "weakness_reasons": f"""with r as (select record_id, {_trim("coalesce(background, '')")} as t from input_records)
select record_id, case when t = '' then 'blank' else array_to_string(list_filter([case when length(t) < 80 then 'too short (' || length(t) || ')' when length(t) < 300 then 'thin (' || length(t) || ')' end,
  case when not (contains(t, '主营') or contains(t, '产品') or contains(t, '工艺') or contains(t, '采购')) then 'no standard labels' end, case when not contains(t, 'http://') and not contains(t, 'https://') then 'no link' end], lambda x: x is not null), '; ') end as reasons from r""",
    "record_checks": f"""select record_id, 'repeated id' as violation from input_records where id in (select id from input_records where id is not null group by 1 having count(*) > 1)
union all select record_id, 'blank name' from input_records where {_trim("coalesce(name, '')")} = ''
union all select record_id, 'website without host' from (select record_id, website, {_norm('website')} as n from input_records) where {_trim("coalesce(website, '')")} <> '' and not contains({_host('n')}, '.')""",
    "url_normalised": f"select source_row, {_norm('url')} as url_norm from sources",
    "provenance_keys": f"with {_HOSTED} select source_row, host, {_path('n')} as path, array_to_string({_fields('n')}, '&') as query from hosted",
    "pages_per_host": f"with {_HOSTED} select host, count(*) as pages from hosted group by 1",
    "path_intents": f"with a as (select {_norm('url')} as n from sources), b as (select lower({_path('n')}) as p from a) select {_INTENT}::int as intent, count(*) as pages from b group by 1",
    "trusted_sources": f"""with s as (select bundle_id, regexp_replace({_host('n')}, '^www\\.', '') as site from (select b.bundle_id, {_norm('i.website')} as n from evidence_bundles b join input_records i using (record_id)))
, h as (select source_row, bundle_id, {_host('n')} as host from (select source_row, bundle_id, {_norm('url')} as n from sources))
select h.source_row, h.bundle_id from h join s using (bundle_id) where contains(site, '.') and (host = site or ends_with(host, '.' || site))""",
    "identity_aliases": f"""with n as (select record_id, {_trim("coalesce(name, '')")} as t from input_records),
a as (select record_id, list_filter(list_transform(list_concat([t], string_split_regex(t, '\\s*/\\s*'), regexp_extract_all(t, '[(（]([^)）]+)[)）]', 1), [regexp_replace(t, '\\s*[(（][^)）]*[)）]\\s*', ' ', 'g')]), lambda x: {_trim('x')}), lambda x: length(x) >= 2) as l from n),
e as (select record_id, unnest(l) as alias, generate_subscripts(l, 1) as k from a), f as (select record_id, alias, min(k) as k from e group by 1, 2)
select record_id, (row_number() over (partition by record_id order by k) - 1)::int as pos, alias from f""",
    "page_token_counts": f"with {_SECTIONS} select bundle_id, section, len(list_distinct(regexp_extract_all(lower(url || ' ' || body), '[a-z0-9]{{4,}}')))::int as tokens from sections",
    "substantive_pages": f"""with {_SECTIONS}, l as (select bundle_id, section, lower({_trim('body')}) as t from sections) select bundle_id, section,
length(t) >= 80 and not regexp_matches(t, 'captcha|cloudflare|verify you are human|access denied|enable javascript|checking your browser|unusual traffic|security check') and not regexp_matches(t, '^(error|api key|not found|unauthorized|extract_invalid_content)') as substantive from l""",
    "material_signals": f"select doc_id, ({_SIGNALS})::int as signals from documents",
    "levels_of_directions": f"select direction_id, case lower({_trim('coalesce(priority, chr(32))')}) when '高' then 'high' when 'high' then 'high' when '中' then 'medium' when 'medium' then 'medium' else 'low' end as level from directions",
    "secrets_redacted": r"select doc_id, regexp_replace(['api_key: k', 'ACCESS-TOKEN=t', 'secret : s'][doc_id % 3 + 1] || doc_id || ', ' || coalesce(text, ''), '(?i)(api[_-]?key|access[_-]?token|secret)\s*[:=]\s*[^\s,;]+', '\1=[redacted]', 'g') as text from documents",
    "evidence_sections": f"with {_SECTIONS} select bundle_id, section, url, title, length(body)::int as chars from sections",
    "source_references": f"with {_SECTIONS}, k as (select bundle_id, list_transform(sources, lambda x: x.id) as known from evidence_bundles) select distinct s.bundle_id, s.section from sections s join k using (bundle_id) where not coalesce(list_contains(known, s.section), false)",
    "uncited_sources": f"with {_SECTIONS} select source_row, bundle_id, id from sources s where not exists (select 1 from sections p where p.bundle_id = s.bundle_id and p.section = s.id)",
    "interleaved_sources": f"""with {_HOSTED}, k as (select source_row, bundle_id, coalesce(source_type, '') as slot, host || ' ' || {_path('n')} || ' ' || array_to_string({_fields('n')}, '&') as key from hosted),
r as (select *, row_number() over (partition by bundle_id, slot order by source_row) as r from k), o as (select * from (select *, row_number() over (partition by bundle_id, key order by r, slot, source_row) as m from r) where m = 1)
select bundle_id, source_row, turn::int as turn from (select *, row_number() over (partition by bundle_id order by r, slot, source_row) as turn from o) where turn <= 8""",
    "longest_title_per_host": f"with {_HOSTED} select host, title from (select host, coalesce(title, '') as title, row_number() over (partition by host order by length(coalesce(title, '')) desc, source_row) as m from hosted) where m = 1",
    "cache_lookup": """with n as (select max(created_at) as now from evidence_bundles), f as (select record_id, bundle_id, row_number() over (partition by record_id order by created_at desc, bundle_id desc) as m from evidence_bundles, n where record_id is not null and created_at >= now - interval 604800 second)
select r.record_id, f.bundle_id as entry_id, f.bundle_id is not null as hit from (select distinct record_id from evidence_bundles where record_id is not null) r left join f on f.record_id = r.record_id and f.m = 1""",
    "repeated_cache_keys": f"""select left(sha256(concat_ws(chr(31), '2', lower({_trim("coalesce(name, '')")}), {_norm('website')}, lower({_trim("coalesce(country, '')")}), {_norm('linkedin_url')}, '3')), 24) as cache_key, count(*) as records from input_records group by 1 having count(*) > 1""",
    "resume_pending": "select record_id, id from input_records i where not exists (select 1 from results r where r.record_id = i.record_id and r.status = 'valid')",
    "overlaid_runs": f"with {_ONCE} select record_id, run_id, idx, status, score from (select *, row_number() over (partition by record_id order by run_id desc, score desc nulls last, idx) as m from once where record_id is not null) where m = 1",
    "quote_verification": f"""with {_SECTIONS}, q as (select direction_id, bundle_id, application, regexp_replace(lower(regexp_replace(regexp_replace(coalesce(application, ''), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\*\\*|__', '', 'g')), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') as q from directions where bundle_id is not null),
s as (select bundle_id, regexp_replace(lower(regexp_replace(regexp_replace(body, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\*\\*|__', '', 'g')), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') as t from sections)
select direction_id, length(trim(coalesce(application, ''))) >= 8 and q <> '' and exists (select 1 from s where s.bundle_id = q.bundle_id and contains(s.t, q.q)) as verified from q""",
    "compact_evidence": r"select bundle_id, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '^(#|Company:|URL:|Title:|[-*•] )')), chr(10)) as text from evidence_bundles",
    "gap_reasons": """with t as (select bundle_id, lower(coalesce(text, '')) as t from evidence_bundles) select bundle_id, array_to_string(list_filter([case when contains(t, 'water treatment') and not contains(t, 'coagulant') then 'water_without_coagulant' end,
case when contains(t, 'furnace') and not contains(t, 'lining') then 'furnace_without_lining' end, case when contains(t, 'alumina') and not contains(t, 'grade') then 'alumina_without_grade' end,
case when regexp_matches(t, '.') and not regexp_matches(t, 'product|produkt|producto|产品') then 'no_product_word' end], lambda x: x is not null), ',') as gaps from t""",
    "known_directions": """with k as (select d.*, row_number() over (partition by bundle_id, product order by pos, direction_id) as m from directions d where bundle_id is not null and product in (select name from catalog_products))
select bundle_id, direction_id, product, n::int as n from (select *, row_number() over (partition by bundle_id order by pos, direction_id) as n from k where m = 1) where n <= 3""",
    "confusion_matrix": f"""with {_ONCE}, lab as (select run_id, score, coalesce(commercial_match, 0) * 10 >= 55 as p, 55 as t from once), c as (select run_id, {_COUNTS}, count(*) as n from lab group by run_id),
r as (select *, case when tp + fp = 0 then 0.0::double else tp / (tp + fp)::double end as precision, case when tp + fn + abstain_pos = 0 then 0.0::double else tp / (tp + fn + abstain_pos)::double end as recall,
case when tn + fp + abstain_neg = 0 then 0.0::double else tn / (tn + fp + abstain_neg)::double end as specificity, (tp + tn) / n::double as accuracy, (n - abstain_pos - abstain_neg) / n::double as coverage from c)
select *, (recall + specificity) / 2 as balanced, case when precision + recall = 0 then 0.0::double else 2 * precision * recall / (precision + recall) end as f1 from r""",
    "threshold_scan": _SCAN,
    "best_threshold": f"select threshold, balanced from ({_SCAN}) order by balanced desc, f1 desc, threshold desc limit 1",
    "average_ranks": f"with {_ONCE}, s as (select run_id, idx, score from once where score is not null) select run_id, idx, (rank() over (partition by run_id order by score) + (count(*) over (partition by run_id, score) - 1) / 2.0)::double as avg_rank from s",
    "score_quality": f"""with {_ONCE}, b as (select run_id, (coalesce(commercial_match, 0) * 10)::double as m, score::double as s from once where status = 'valid' and score is not null),
k as (select *, rank() over (partition by run_id order by m) + (count(*) over (partition by run_id, m) - 1) / 2.0::double as rm, rank() over (partition by run_id order by s) + (count(*) over (partition by run_id, s) - 1) / 2.0::double as rs from b)
select run_id, count(*) as n, round(avg(abs(m - s)), 6) as mae, case when count(*) > 1 and stddev_pop(m) > 0 and stddev_pop(s) > 0 then round(corr(m, s), 6) end as pearson, case when count(*) > 1 and stddev_pop(m) > 0 and stddev_pop(s) > 0 then round(corr(rm, rs), 6) end as spearman from k group by run_id""",
    "failure_stages": f"with {_ONCE}, e as (select score, array_to_string(coalesce(errors, []), ';') as t from once) select case when score is not null then '' when contains(t, 'evidence') or contains(t, 'timeout') then 'retrieval' when contains(t, 'JSON') then 'structured_extraction' else 'scoring' end as stage, count(*) as n from e group by 1",
    "latency_summary": f"""with {_ONCE}, g as (select run_id, count(duration_seconds) as n, max(duration_seconds) as longest, {_QUANTILE} as l from once group by run_id)
select run_id, n, longest, l[least(n - 1, floor(n * 0.5))::int + 1] as p50, l[least(n - 1, floor(n * 0.95))::int + 1] as p95 from g where n > 0""",
    "run_overview": f"with {_ONCE} select run_id, count(*) as selected, count(*) filter (lower(trim(status)) = 'valid') as valid, count(*) filter (lower(trim(coalesce(status, ''))) <> 'valid') as failed, round(avg(duration_seconds), 4) as average_seconds from once group by 1",
    "run_companies": f"with {_ONCE} select run_id, idx, o.record_id, name, industry, case when lower(trim(status)) = 'valid' then 'valid' else 'failed' end as status, case when score between 0 and 100 then score end as score from once o left join input_records i on i.record_id = o.record_id",
    "queue_filter": f"""with {_ONCE} select run_id, idx, o.record_id, name, industry, 'valid' as status, case when score between 0 and 100 then score end as score from once o left join input_records i on i.record_id = o.record_id
where lower(trim(status)) = 'valid' and contains(lower(concat_ws(' ', name, industry)), 'steel')""",
    "selected_roles": f"""with {_ONCE}, r as (select record_id, run_id, idx, status = 'valid' as v, score as s, concat_ws('|', product_match, commercial_match, follow_up) as g from once where record_id is not null),
f as (select *, row_number() over (partition by record_id order by run_id, idx) as a, row_number() over (partition by record_id order by run_id desc, idx desc) as b from r), l as (select * from f where a = 1), o as (select * from f where b = 1 and a > 1),
j as (select l.record_id, case when not l.v or l.s is null then 'lead not reviewable' when o.v is null then 'no other candidate' when not o.v then 'other invalid' when o.s is null or o.s < l.s then 'other lower' when o.s = l.s and o.g is not distinct from l.g then 'same decision'
  when o.s >= l.s + 10 then 'verdict for other' else 'verdict for lead' end as reason from l left join o using (record_id))
select record_id, case when reason = 'verdict for other' then 'other' else 'lead' end as selected_role, reason from j""",
    "report_markdown": f"with {_ONCE} select run_id, '| ' || run_id || ' | ' || count(*) || ' | ' || count(*) filter (lower(trim(status)) = 'valid') || ' | ' || count(*) filter (lower(trim(coalesce(status, ''))) <> 'valid') || ' |' as line from once group by run_id",
    "lead_round": f"with {_ONCE} select run_id || '/' || idx as key, 'lead' as role, case when status = 'valid' then 1 else 2 end as attempt, status as answer, coalesce(status = 'valid', false) as accepted from once",
    "parsed_answers": """with j as (select retrieval as r, case when json_valid(retrieval) then json_type(retrieval) end as t from evidence_bundles)
select case when t is null then 'none' else 'strict' end as strategy, case when t is null then 'no object' when t = 'OBJECT' then '' else 'not an object' end as error, count(*) as n from j group by 1, 2""",
    "diverse_pages": f"""with {_SCORED}, w as (select bundle_id, pos, relevance, case when categories = '' then [] else string_split(categories, ',') end as cats, list_distinct(regexp_extract_all(lower(url || ' ' || body), '[a-z0-9]{{4,}}')) as tokens from scored),
t1 as (select * from (select *, relevance + 8 * len(cats) as s, row_number() over (partition by bundle_id order by relevance + 8 * len(cats) desc, pos) as m from w) where m = 1 and relevance >= 20),
w2 as (select w.*, t.cats as covered, {{J}} as near from w join t1 t using (bundle_id) where w.pos <> t.pos), v2 as (select *, relevance + 8 * len(list_filter(cats, lambda c: not list_contains(covered, c))) - 20 * near as s from w2),
t2 as (select * from (select *, row_number() over (partition by bundle_id order by s desc, pos) as m from v2) where m = 1 and relevance >= 20),
w3 as (select w.bundle_id, w.pos, w.relevance, w.cats, w.tokens, list_concat(w.covered, t.cats) as covered, greatest(w.near, {{J}}) as near from w2 w join t2 t using (bundle_id) where w.pos <> t.pos), v3 as (select *, relevance + 8 * len(list_filter(cats, lambda c: not list_contains(covered, c))) - 20 * near as s from w3),
t3 as (select * from (select *, row_number() over (partition by bundle_id order by s desc, pos) as m from v3) where m = 1 and relevance >= 20)
select bundle_id, pos - 1 as pos, 1 as turn, relevance, round(s::double, 1) as selection_score from t1 union all select bundle_id, pos - 1, 2, relevance, round(s::double, 1) from t2 union all select bundle_id, pos - 1, 3, relevance, round(s::double, 1) from t3""".replace("{J}", "(len(list_intersect(w.tokens, t.tokens)) / greatest(1, len(w.tokens) + len(t.tokens) - len(list_intersect(w.tokens, t.tokens)))::double)"),
}
