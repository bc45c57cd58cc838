"""Queries over search output, pages, damaged answers, facts and reports: text in and text out, each over whole tables.

The tables hold no raw search output, no HTML and no damaged JSON, so each query writes such a text from the fields of a row and
reads it back; the SQL of the same name gives what must come out from the fields alone, or by its own functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaykit.functions import coerce as co
from assaykit.functions import text as tx
from assaykit.functions import urls as u
from assaykit.operators import evaluation as ev
from assaykit.operators import evidence as evi
from assaykit.operators import incremental as inc
from assaykit.operators import parsers as ps
from assaykit.operators import rendering as rd
from assaykit.operators import retrieval as rt
from assaykit.operators import review as rv
from assaykit.plans.runtime import at_most, shared_folder
from assaykit.sources.records import json_records, markdown_records, with_input_ids
from assaykit.sources.sinks import write_json
from assaykit.sources.tables import load_table
from assaykit.streaming.runs import results_stream, run_to_folder, windowed_overview

#: Words of materials whose mention makes a page one about materials, as patterns.
MATERIALS = ["alumina", "zircon", "silicon carbide", "graphite", "magnesi", "spinel", "castable", "clay"]
#: Slots of a batch search, in the order of its queries.
SLOTS = ["identity", "offering"]
#: Filler of a search block: a snippet that makes it long enough to count.
SNIPPET = "A snippet of the page as a search engine shows it, long enough for a block to count."


def _line(c: str) -> Column:
    """A field on one line; empty for null."""
    return F.coalesce(F.regexp_replace(F.col(c), r"\s+", " "), F.lit(""))


def _search_output(spark: SparkSession, d: str) -> DataFrame:
    """``source_row, text``: what a batch of two searches that find this page might print."""
    first = F.concat(F.lit("## Query 1: who\n### 1. "), _line("title"), F.lit("\n- **URL**: "), _line("url"), F.lit(f"\n{SNIPPET}\n### 2. short\n"))
    second = F.concat(F.lit("## Query 2: what\n### 1. page of "), _line("publisher"), F.lit("\nsee www.example.test/row/"), F.col("source_row").cast("string"), F.lit(f". {SNIPPET}\n"))
    return load_table(spark, d, "sources").select("source_row", F.concat(first, second).alias("text"))


def search_result_urls(spark: SparkSession, d: str) -> DataFrame:
    return _search_output(spark, d).select("source_row", F.posexplode(ps.search_urls(F.col("text"))).alias("pos", "url"))


def search_result_sections(spark: SparkSession, d: str) -> DataFrame:
    return ps.search_sections(_search_output(spark, d), "source_row", "text", 5).select("source_row", "pos", "url")


def batch_query_sections(spark: SparkSession, d: str) -> DataFrame:
    return ps.query_sections(_search_output(spark, d), "source_row", "text", SLOTS).select("source_row", "slot", F.length("body").alias("chars"))


def clean_search_urls(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "sources").select("source_row", u.clean_search_url(F.col("url")).alias("url"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of a page with their headings and the text before them; scripts are skipped, relative links resolved."""
    title = F.concat(F.lit("<html><head><title>"), tx.html_escape(_line("title")), F.lit("</title><script>var a = \"<a href='/no'>no</a>\";</script></head><body><h2>Products &amp; more</h2><p>Rows of "))
    body = F.concat(tx.html_escape(_line("publisher")), F.lit("</p><a href='/row/"), F.col("source_row").cast("string"), F.lit("'>"), tx.html_escape(_line("title")), F.lit("</a><h3>Others</h3><svg><text>x</text></svg><a href='https://other.test/x'>Other</a><a>none</a></body></html>"))
    pages = load_table(spark, d, "sources").select("source_row", F.concat(title, body).alias("html"), F.lit("https://page.test/base/").alias("base"))
    got = pages.select("source_row", ps.html_extract("html", "base").alias("p"))
    return got.select("source_row", F.posexplode("p.links").alias("pos", "x")).select("source_row", "pos", "x.url", "x.title", "x.heading", "x.context")


def site_page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that stay on the host of the page: one below it, one on it, none elsewhere."""
    pages = load_table(spark, d, "sources").select("source_row", F.concat(F.lit("<a href='a/"), F.col("source_row").cast("string"), F.lit("'>A</a><a href='https://sub.page.test/b'>B</a><a href='https://page.test.evil.test/'>C</a>")).alias("html"), F.lit("https://www.page.test/base/").alias("base"))
    return ps.site_links(pages, "source_row", "html", "base")


def repaired_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers damaged in one of five ways by their index, repaired: strategy and fields."""
    rows = rv.once(load_table(spark, d, "results"))
    score = F.coalesce(F.col("score").cast("string"), F.lit("null"))
    note = F.concat(F.lit("run "), F.col("run_id"))
    plain = F.concat(F.lit('{"note": "'), note, F.lit('", "score": '), score, F.lit("}"))
    damage = F.pmod("idx", F.lit(5))
    raw = (
        F.when(damage == 0, plain)
        .when(damage == 1, F.concat(F.lit("The answer:\n```json\n"), plain, F.lit("\n```\nDone.")))
        .when(damage == 2, F.concat(F.lit('{"note": "'), note, F.lit('", "score": '), score, F.lit(",}")))
        .when(damage == 3, F.concat(F.lit('{"note": "the "'), note, F.lit('" of it", "score": '), score, F.lit("}")))
        .otherwise(F.concat(F.lit("{'note': '"), note, F.lit("', 'score': "), F.coalesce(F.col("score").cast("string"), F.lit("None")), F.lit("}")))
    )
    got = rows.select("run_id", "idx", ps.json_object(raw).alias("p"))
    return got.select("run_id", "idx", "p.strategy", F.get_json_object("p.json", "$.note").alias("note"), F.get_json_object("p.json", "$.score").cast("int").alias("score"))


def structured_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a pack: title of a section as statement, two quotes, one of which stands on the page; numbers count those that hold."""
    parts = ps.pack_sections(load_table(spark, d, "evidence_bundles"))
    quotes = F.array(F.struct(F.lit("S0").alias("source_id"), F.lit("stands on no page at all").alias("quote")), F.struct(F.col("section").alias("source_id"), F.substring("body", 1, 60).alias("quote")))
    facts = parts.select("bundle_id", "pos", F.col("title").alias("statement"), quotes.alias("evidence"))
    return evi.verified_facts(facts, parts).select("bundle_id", "fact_no", "statement", F.array_join("sources", ",").alias("sources"))


def evidence_states(spark: SparkSession, d: str) -> DataFrame:
    """Packs by what can be judged on them: unscorable without sections, else usable."""
    packs = load_table(spark, d, "evidence_bundles")
    state = F.when(F.coalesce(F.col("text").rlike(r"(?m)^## S\d+[ \t]*$"), F.lit(False)), "usable").otherwise("unscorable")
    return packs.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("packs"))


def reference_repair(spark: SparkSession, d: str) -> DataFrame:
    """Ids of three sources mapped to those of the pack, distinct, active ones only, else the first three of it."""
    packs = load_table(spark, d, "evidence_bundles").select("bundle_id", F.coalesce(F.col("sources.id"), F.array().cast("array<string>")).alias("active"))
    moved = F.create_map(F.lit("X1"), F.lit("S2"), F.lit("X2"), F.lit("S1"))
    ids = F.when(F.pmod("bundle_id", F.lit(2)) == 0, F.array(F.lit("X1"), F.lit("S2"), F.lit("X2"))).otherwise(F.array(F.lit("Y9")))
    return packs.select("bundle_id", F.array_join(evi.remapped_ids(ids, moved, F.col("active")), ",").alias("ids"))


def assembled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Manual score, first and last result of each record side by side; records without one of them are left out."""
    rows = rv.once(load_table(spark, d, "results")).filter("record_id is not null")
    first = inc.overlay(rows, "record_id", [F.asc("run_id"), F.asc("idx")]).select("record_id", F.col("score").alias("baseline"), ev.failure_stage(F.col("score"), F.col("errors")).alias("baseline_stage"))
    last = inc.overlay(rows, "record_id", [F.desc("run_id"), F.desc("idx")]).select("record_id", F.col("score").alias("candidate"), F.col("follow_up"), ev.failure_stage(F.col("score"), F.col("errors")).alias("candidate_stage"))
    manual = load_table(spark, d, "input_records").select("record_id", F.col("contact_count").alias("manual"))
    return ev.assembled(manual, first, last, "record_id")


def role_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of inputs by role: here the lengths of documents by their source."""
    return ev.size_summary(load_table(spark, d, "documents").filter("source is not null and text is not null").select("source", F.length("text").cast("bigint").alias("chars")), "chars", ["source"])


def _own_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources on the site of their bundle's record, with host, path and intent."""
    site = F.regexp_replace(u.url_host(F.col("website")), r"^www\.", "")
    sites = load_table(spark, d, "evidence_bundles").select("bundle_id", "record_id").join(load_table(spark, d, "input_records").select("record_id", site.alias("site")).filter(F.col("site").contains(".")), "record_id").select("bundle_id", "site")
    rows = u.with_url_parts(load_table(spark, d, "sources").select("source_row", "bundle_id", "url", "title"), "url").filter("url_norm <> ''")
    return rows.join(sites, "bundle_id").filter((F.col("url_host") == F.col("site")) | F.endswith("url_host", F.concat(F.lit("."), F.col("site"))))


def direct_materials(spark: SparkSession, d: str) -> DataFrame:
    """Own pages of a bundle whose address or title names materials: most of them first, ties by address downwards."""
    rows = _own_sources(spark, d).withColumn("score", tx.signal_count(F.lower(F.translate(F.concat_ws(" ", "url_norm", "title"), "-_", "  ")), MATERIALS)).filter("score > 0")
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("bundle_id").orderBy(F.desc("score"), F.desc("url_norm"), F.asc("source_row"))))
    return ranked.filter("place <= 8").select("bundle_id", "place", "source_row", "score")


def linked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Own pages with an intent that the pack does not hold yet: the two of highest intent, ties by row."""
    rows = _own_sources(spark, d).withColumn("intent", u.intent_of_path(F.col("url_path"))).filter("intent > 0")
    rows = rows.select("bundle_id", "source_row", "intent", F.regexp_replace("url_host", r"^www\.", "").alias("host"), F.col("url_path").alias("path"), F.concat_ws("&", "url_fields").alias("query"))
    held = u.with_url_parts(ps.pack_sections(load_table(spark, d, "evidence_bundles")).select("bundle_id", "url"), "url").filter("url_norm <> ''")
    held = held.select("bundle_id", F.regexp_replace("url_host", r"^www\.", "").alias("host"), F.col("url_path").alias("path"), F.concat_ws("&", "url_fields").alias("query"))
    fresh = rows.join(held, ["bundle_id", "host", "path", "query"], "left_anti")
    return rt.within_budget(fresh, "bundle_id", [F.desc("intent"), F.asc("source_row")], 2).select("bundle_id", "source_row", "intent")


def fallback_pages(spark: SparkSession, d: str) -> DataFrame:
    """First four sources of bundles without any substantive section."""
    packs = load_table(spark, d, "evidence_bundles")
    kept = ps.pack_sections(packs).filter(tx.substantive(F.col("body"))).select("bundle_id")
    rows = rt.only_for_missing(load_table(spark, d, "sources").select("bundle_id", "source_row"), kept, "bundle_id")
    return rt.within_budget(rows, "bundle_id", [F.asc("source_row")], 4)


def kept_extracts(spark: SparkSession, d: str) -> DataFrame:
    """Of the first four sections of a pack those that are substantive, with their titles."""
    first = rt.within_budget(ps.pack_sections(load_table(spark, d, "evidence_bundles")), "bundle_id", [F.asc("pos")], 4)
    return first.filter(tx.substantive(F.col("body"))).select("bundle_id", "section", tx.extract_title(F.col("body"), F.col("url")).alias("heading"))


RECOVERY_RULES = {"no_alumina": (".", "alumina"), "no_furnace": (".", "furnace|ofen|horno")}


def recovered_packs(spark: SparkSession, d: str) -> DataFrame:
    """First and last pack of a record as primary and recovered one: the last is taken where it closes a gap of the first."""
    packs = load_table(spark, d, "evidence_bundles").filter("record_id is not null").withColumn("gaps", evi.rule_hits(F.col("text"), RECOVERY_RULES)).select("record_id", "bundle_id", "gaps")
    first = packs.groupBy("record_id").agg(F.min_by("gaps", "bundle_id").alias("gaps"))
    last = packs.groupBy("record_id").agg(F.max_by("gaps", "bundle_id").alias("gaps"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rt.accepted_recovery(first, last, "record_id").select("record_id", "source", F.array_join("gaps", ",").alias("gaps"))


def shown_results(spark: SparkSession, d: str) -> DataFrame:
    """Fields of results as a page shows them: bounded texts, finite numbers, scores within 0 and 100."""
    rows = rv.once(load_table(spark, d, "results"))
    return rows.select(
        "run_id", "idx", co.bounded_text(F.col("follow_up"), 20).alias("follow_up"), co.finite_number(F.col("duration_seconds")).alias("seconds"), co.bounded_score(F.col("score")).alias("score"),
        F.array_join(co.bounded_list(F.col("errors"), 3, 40), "|").alias("errors"),
    )


def shown_links(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "sources").select("source_row", co.http_url(F.col("url")).alias("url"))


def request_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a request that are not among the known ones, and whether its name has a length that is accepted."""
    rows = load_table(spark, d, "input_records")
    body = F.to_json(F.struct("name", "website", "country", F.when(F.pmod("record_id", F.lit(3)) == 0, F.col("industry")).alias("branch")))
    return rows.select("record_id", F.array_join(co.unknown_fields(body, ["name", "website", "country"]), ",").alias("unknown"), co.named(F.get_json_object(body, "$.name"), 300).alias("named"))


def flat_texts(spark: SparkSession, d: str) -> DataFrame:
    """All texts inside the sources of a pack, in order, as one list."""
    return load_table(spark, d, "evidence_bundles").select("bundle_id", F.array_join(co.text_values(F.col("sources")), "|").alias("texts"))


def text_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Whether the notes of a retrieval have the fields of a template, each of the template's type."""
    return load_table(spark, d, "evidence_bundles").select("bundle_id", co.same_shape(F.col("retrieval"), "mode string, pages bigint, queries bigint, seconds double").alias("same"))


def record_markdown(spark: SparkSession, d: str) -> DataFrame:
    columns = {"name": "Name", "website": "Website", "country": "Country", "industry": "Industry"}
    return load_table(spark, d, "input_records").select("record_id", rd.bullets(columns).alias("markdown"))


def source_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of three cited sources of a pack, as Markdown and as HTML; ids that the pack lacks are left out."""
    ids = F.array(*[F.lit(x) for x in ("S2", "S1", "S99")])
    return load_table(spark, d, "evidence_bundles").select("bundle_id", rd.evidence_links(F.col("sources"), ids).alias("markdown"), rd.evidence_links(F.col("sources"), ids, True).alias("html"))


def assessment_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Report of a bundle: heading, company, its first three directions as table lines."""
    rows = rt.within_budget(load_table(spark, d, "directions").filter("bundle_id is not null"), "bundle_id", [F.asc("pos"), F.asc("direction_id")], 3)
    lines = rows.groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "direction_id", "product", "priority"))), lambda x: rv.markdown_line(x["product"], x["priority"])).alias("lines"))
    packs = load_table(spark, d, "evidence_bundles").select("bundle_id", "company").join(lines, "bundle_id")
    return packs.select("bundle_id", rd.report(F.col("company"), F.col("lines")).alias("markdown"))


def streamed_overview(spark: SparkSession, d: str) -> DataFrame:
    """Counts by run and hour from a stream over the results, run to its end; whole rows that come again count once. The pattern holds for a file and for a folder."""
    table = load_table(spark, d, "results")
    folder = shared_folder(spark, "overview")
    rows = results_stream(spark, f"{d}/results.parque[t]", table.schema).withColumn("finished_at", F.col("finished_at").cast("timestamp"))
    run_to_folder(windowed_overview(rows), f"{folder}/rows", f"{folder}/state")
    return spark.read.parquet(f"{folder}/rows").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "run_id", "selected", "valid")


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON lines and read back."""
    folder = shared_folder(spark, "records")
    write_json(load_table(spark, d, "input_records").select("id", "name", "website", "country", "contact_count"), folder)
    return json_records(spark, folder, lines=True).select("id", "name", "website", "country", "contact_count")


def markdown_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as a Markdown table and read back; line breaks and marks of emphasis are lost in it. Ids are int as in the SQL, bigint where one does not fit."""
    folder = shared_folder(spark, "table")
    rows = load_table(spark, d, "input_records").select("record_id", "name", "industry")
    rows.select(rv.markdown_line(*[F.col(c) for c in ("record_id", "name", "industry")]).alias("value")).write.text(folder)
    fits = at_most(rows.filter(~F.col("record_id").between(-(2**31), 2**31 - 1)), 0)
    return markdown_records(spark, folder, ["record_id", "name", "industry"]).withColumn("record_id", F.col("record_id").cast("int" if fits else "bigint"))


def input_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of records, those missing numbered by their place."""
    return with_input_ids(load_table(spark, d, "input_records").select("record_id", "id"), "record_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        search_result_urls, search_result_sections, batch_query_sections, clean_search_urls, page_links, site_page_links, repaired_answers, structured_facts, evidence_states, reference_repair, assembled_rows, role_sizes, direct_materials,
        linked_pages, fallback_pages, kept_extracts, recovered_packs, shown_results, shown_links, request_fields, flat_texts, text_shapes, record_markdown, source_links, assessment_markdown, streamed_overview, json_round_trip, markdown_round_trip, input_ids,
    )
}
