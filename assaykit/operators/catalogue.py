"""All queries of the core, by name, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaykit.functions import text as tx
from assaykit.functions import urls as u
from assaykit.operators import evaluation as ev
from assaykit.operators import evidence as evi
from assaykit.operators import incremental as inc
from assaykit.operators import parsers as ps
from assaykit.operators import ranking as rk
from assaykit.operators import review as rv
from assaykit.operators import retrieval as rt
from assaykit.operators import roles, sampling
from assaykit.operators import validation as va
from assaykit.operators import texts
from assaykit.operators.oracle import ORACLE as _ORACLE
from assaykit.operators.oracle_texts import ORACLE as _TEXTS
from assaykit.plans.provider import ReplayProvider, rounds
from assaykit.plans.runtime import bounded_broadcast, ws_trim
from assaykit.sources.records import record_violations
from assaykit.sources.tables import load_table

#: Strata of the sample, in order of priority.
STRATA = ["STEEL", "FOUNDRY", "REFRACTORY", "CEMENT", "GLASS", "NONFERROUS", "CHEMICAL"]
LEVELS = {"高": "high", "high": "high", "中": "medium", "medium": "medium", "低": "low", "low": "low"}
GAP_RULES = {"water_without_coagulant": ("water treatment", "coagulant"), "furnace_without_lining": ("furnace", "lining"), "alumina_without_grade": ("alumina", "grade"), "no_product_word": (".", "product|produkt|producto|产品")}


def _results(spark: SparkSession, d: str) -> DataFrame:
    return rv.once(load_table(spark, d, "results"))


def candidate_sample(spark: SparkSession, d: str) -> DataFrame:
    counts = sampling.filtered_counts(load_table(spark, d, "results"), "record_id", F.col("status") == "valid").withColumnRenamed("contact_count", "contact_count_child")
    return sampling.candidate_sample(load_table(spark, d, "input_records"), counts, STRATA, 140)


def contact_counts(spark: SparkSession, d: str) -> DataFrame:
    return sampling.filtered_counts(load_table(spark, d, "results"), "record_id", F.col("status") == "valid")


def weakness_reasons(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "input_records").select("record_id", F.array_join(sampling.weakness_reasons(F.col("background")), "; ").alias("reasons"))


def record_checks(spark: SparkSession, d: str) -> DataFrame:
    return record_violations(load_table(spark, d, "input_records"))


def url_normalised(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "sources").select("source_row", u.normalise_url(F.col("url")).alias("url_norm"))


def _page_key() -> Column:
    """The provenance key of rows that ``with_url_parts`` has prepared."""
    return F.struct(F.regexp_replace("url_host", r"^www\.", "").alias("host"), F.col("url_path").alias("path"), F.concat_ws("&", "url_fields").alias("query"))


def provenance_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = u.with_url_parts(load_table(spark, d, "sources").select("source_row", "url"), "url")
    return rows.filter("url_norm <> ''").select("source_row", _page_key().alias("key")).select("source_row", "key.host", "key.path", "key.query")


def pages_per_host(spark: SparkSession, d: str) -> DataFrame:
    rows = u.with_url_parts(load_table(spark, d, "sources").select("url"), "url").filter("url_norm <> ''")
    return rows.groupBy(F.regexp_replace("url_host", r"^www\.", "").alias("host")).agg(F.count(F.lit(1)).alias("pages"))


def path_intents(spark: SparkSession, d: str) -> DataFrame:
    rows = u.with_url_parts(load_table(spark, d, "sources").select("url"), "url")
    return rows.groupBy(u.intent_of_path(F.col("url_path")).alias("intent")).agg(F.count(F.lit(1)).alias("pages"))


def trusted_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources on the site of their bundle's record. A bundle has one record and a record one site, so no source is met twice."""
    return _own_rows(spark, d).select("source_row", "bundle_id")


def _sites(spark: SparkSession, d: str) -> DataFrame:
    """``bundle_id, site``: host of the record's website without www., where it has a dot."""
    records = load_table(spark, d, "input_records").select("record_id", F.regexp_replace(u.url_host(F.col("website")), r"^www\.", "").alias("site")).filter(F.col("site").contains("."))
    return load_table(spark, d, "evidence_bundles").select("bundle_id", "record_id").join(records, "record_id").select("bundle_id", "site")


def _own_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = u.with_url_parts(load_table(spark, d, "sources").select("source_row", "bundle_id", "url"), "url").select("source_row", "bundle_id", "url_host")
    return rows.join(_sites(spark, d), "bundle_id").filter((F.col("url_host") == F.col("site")) | F.endswith("url_host", F.concat(F.lit("."), F.col("site"))))


def company_domains(spark: SparkSession, d: str) -> DataFrame:
    """First host of a bundle that holds a company term and is no directory."""
    terms = load_table(spark, d, "evidence_bundles").select("bundle_id", tx.company_terms(F.col("company")).alias("terms"))
    src = load_table(spark, d, "sources").select("bundle_id", "source_row", u.url_host(F.col("url")).alias("host"))
    own = src.filter(~u.host_in(F.col("host"), u.LOW_AUTHORITY_HOSTS)).join(terms, "bundle_id").filter(F.exists("terms", lambda t: F.col("host").contains(t)))
    return own.groupBy("bundle_id").agg(F.min_by("host", "source_row").alias("domain"))


def identity_aliases(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "input_records").select("record_id", F.posexplode(tx.identity_aliases(F.col("name"))).alias("pos", "alias"))


def page_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return ps.pack_sections(load_table(spark, d, "evidence_bundles")).select("bundle_id", "section", F.size(tx.page_tokens(F.col("url"), F.col("body"))).alias("tokens"))


def substantive_pages(spark: SparkSession, d: str) -> DataFrame:
    return ps.pack_sections(load_table(spark, d, "evidence_bundles")).select("bundle_id", "section", tx.substantive(F.col("body")).alias("substantive"))


def material_signals(spark: SparkSession, d: str) -> DataFrame:
    patterns = ["alumina", "zircon", "silicon carbide", "graphite", "magnesi", "spinel"]
    return load_table(spark, d, "documents").select("doc_id", tx.signal_count(F.lower(F.coalesce("text", F.lit(""))), patterns).alias("signals"))


def levels_of_directions(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "directions").select("direction_id", tx.mapped_level(F.col("priority"), LEVELS, "low").alias("level"))


def secrets_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a secret of one of three names ahead of them, as the tables hold none, redacted."""
    name = F.element_at(F.array(F.lit("api_key: k"), F.lit("ACCESS-TOKEN=t"), F.lit("secret : s")), F.pmod("doc_id", F.lit(3)).cast("int") + 1)
    return load_table(spark, d, "documents").select("doc_id", tx.redact_secrets(F.concat(name, F.col("doc_id").cast("string"), F.lit(", "), F.coalesce("text", F.lit("")))).alias("text"))


def evidence_sections(spark: SparkSession, d: str) -> DataFrame:
    return ps.pack_sections(load_table(spark, d, "evidence_bundles")).select("bundle_id", "section", "url", "title", F.length("body").alias("chars"))


def source_references(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a pack that its list of sources does not name, one row each."""
    parts = ps.pack_sections(load_table(spark, d, "evidence_bundles")).groupBy("bundle_id").agg(F.collect_set("section").alias("used"))
    rows = load_table(spark, d, "evidence_bundles").select("bundle_id", F.col("sources.id").alias("known")).join(parts, "bundle_id")
    return evi.dangling(rows, "used", "known").select("bundle_id", F.explode("missing").alias("section"))


def uncited_sources(spark: SparkSession, d: str) -> DataFrame:
    """Rows of sources whose id has no section in the pack of their bundle."""
    parts = ps.pack_sections(load_table(spark, d, "evidence_bundles")).select("bundle_id", F.col("section").alias("id"))
    return load_table(spark, d, "sources").join(parts, ["bundle_id", "id"], "left_anti").select("source_row", "bundle_id", "id")


def _scored_pages(spark: SparkSession, d: str, own: bool = False) -> DataFrame:
    packs = load_table(spark, d, "evidence_bundles")
    heads = packs.select("bundle_id", tx.company_terms(F.col("company")).alias("terms"))
    heads = heads.join(_sites(spark, d).withColumnRenamed("site", "domain"), "bundle_id", "left") if own else heads.withColumn("domain", F.lit(None).cast("string"))
    pages = u.with_url_parts(ps.pack_sections(packs), "url").join(heads, "bundle_id")
    pages = pages.withColumn("locator", tx.fold_text(F.concat_ws(" ", "url", "title"))).withColumn("folded", tx.fold_text(F.col("body")))
    return rk.with_relevance(pages)


def page_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _scored_pages(spark, d).select("bundle_id", "section", "relevance", F.array_join("categories", ",").alias("categories"))


def own_page_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Relevance with the site of the bundle's record as the company's own host."""
    return _scored_pages(spark, d, True).select("bundle_id", "section", "relevance", F.array_join("categories", ",").alias("categories"))


def ranked_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored_pages(spark, d).select("bundle_id", "section", "pos", "relevance", _page_key().alias("key"))
    return rk.ranked_distinct(rows, "bundle_id", ["key"], "relevance", "pos").select("bundle_id", "section", "relevance", "rank")


def diverse_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = _scored_pages(spark, d).withColumn("tokens", tx.page_tokens(F.col("url"), F.col("body")))
    return rk.mmr_select(pages, "bundle_id", 3)


def interleaved_sources(spark: SparkSession, d: str) -> DataFrame:
    """Round robin over the types of a bundle's sources, distinct by provenance key, the first 8."""
    rows = u.with_url_parts(load_table(spark, d, "sources").select("source_row", "bundle_id", "url", F.coalesce("source_type", F.lit("")).alias("slot")), "url").filter("url_norm <> ''")
    rows = rows.select("source_row", "bundle_id", "slot", _page_key().alias("key"))
    return rk.interleave(rows, "bundle_id", "slot", "source_row", ["key"], 8).select("bundle_id", "source_row", "turn")


def longest_title_per_host(spark: SparkSession, d: str) -> DataFrame:
    rows = u.with_url_parts(load_table(spark, d, "sources").select("source_row", "url", F.coalesce("title", F.lit("")).alias("title")), "url").filter("url_norm <> ''").withColumn("host", F.regexp_replace("url_host", r"^www\.", ""))
    return rk.best_per_key(rows, ["host"], F.col("title"), F.struct(F.length("title"), -F.col("source_row")), "title")


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Newest pack of each record as of the latest creation, if it is at most seven days old."""
    packs = load_table(spark, d, "evidence_bundles").filter("record_id is not null")
    now = load_table(spark, d, "evidence_bundles").agg(F.max("created_at")).first()[0]
    entries = packs.select("record_id", F.col("bundle_id").alias("entry_id"), "created_at")
    got = inc.cache_lookup(packs.select("record_id").distinct(), entries, "record_id", F.lit(now).cast("timestamp_ntz"))
    return got.select("record_id", "entry_id", "hit")


def repeated_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Cache keys that more than one record shares, with the number of its rows."""
    r = load_table(spark, d, "input_records")
    keyed = r.select(inc.cache_key(F.col("name"), F.col("website"), F.col("country"), F.col("linkedin_url"), 3).alias("cache_key"))
    return keyed.groupBy("cache_key").agg(F.count(F.lit(1)).alias("records")).filter("records > 1")


def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    return inc.pending(load_table(spark, d, "input_records").select("record_id", "id"), load_table(spark, d, "results"), "record_id", F.col("status") == "valid")


def overlaid_runs(spark: SparkSession, d: str) -> DataFrame:
    """The result of the latest run by record; among rows of a run the higher score, then the smaller index."""
    rows = _results(spark, d).filter("record_id is not null")
    return inc.overlay(rows, "record_id", [F.desc("run_id"), F.desc_nulls_last("score"), F.asc("idx")]).select("record_id", "run_id", "idx", "status", "score")


def quote_verification(spark: SparkSession, d: str) -> DataFrame:
    """Applications of directions against the pages of their bundle."""
    quotes = load_table(spark, d, "directions").filter("bundle_id is not null").select("direction_id", "bundle_id", F.coalesce("application", F.lit("")).alias("quote"))
    got = evi.verified_quotes(quotes.withColumn("quote_id", F.col("direction_id")), ps.pack_sections(load_table(spark, d, "evidence_bundles")), ["bundle_id"], least=8)
    return got.select("direction_id", "verified")


def compact_evidence(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "evidence_bundles").select("bundle_id", evi.compact_pack(F.col("text")).alias("text"))


def gap_reasons(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "evidence_bundles").select("bundle_id", F.array_join(evi.rule_hits(F.col("text"), GAP_RULES), ",").alias("gaps"))


def known_directions(spark: SparkSession, d: str) -> DataFrame:
    """Directions whose product is in the catalogue, first of each product in a bundle, three a bundle."""
    products = load_table(spark, d, "catalog_products").select(F.col("name").alias("product"))
    rows = load_table(spark, d, "directions").filter("bundle_id is not null").join(bounded_broadcast(products), "product", "left_semi")
    once = rk.first_by_key(rows, ["bundle_id", "product"], [F.asc("pos"), F.asc("direction_id")])
    return once.withColumn("n", F.row_number().over(Window.partitionBy("bundle_id").orderBy("pos", "direction_id"))).filter("n <= 3").select("bundle_id", "direction_id", "product", "n")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).withColumn("manual", F.coalesce("commercial_match", F.lit(0)) * 10)


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion(_labelled(spark, d), F.col("manual") >= 55, F.col("score"), F.lit(55), ["run_id"])


def threshold_scan(spark: SparkSession, d: str) -> DataFrame:
    return ev.threshold_scan(_labelled(spark, d), F.col("manual") >= 55, F.col("score"))


def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return ev.best_threshold(threshold_scan(spark, d))


def average_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = _results(spark, d).filter("score is not null").select("run_id", "idx", "score")
    return ev.average_ranks(rows, "score", ["run_id"]).select("run_id", "idx", "avg_rank")


def score_quality(spark: SparkSession, d: str) -> DataFrame:
    got = ev.score_quality(_labelled(spark, d).filter("status = 'valid'"), "manual", "score", ["run_id"])
    return got.select("run_id", "n", F.round("mae", 6).alias("mae"), F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


def failure_stages(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).groupBy(ev.failure_stage(F.col("score"), F.col("errors")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _results(spark, d)
    p50 = ev.index_quantile(rows, "duration_seconds", ["run_id"], 0.5, "p50")
    p95 = ev.index_quantile(rows, "duration_seconds", ["run_id"], 0.95, "p95")
    top = rows.groupBy("run_id").agg(F.count("duration_seconds").alias("n"), F.max("duration_seconds").alias("longest"))
    return top.join(p50, "run_id").join(p95, "run_id")


def run_overview(spark: SparkSession, d: str) -> DataFrame:
    return rv.run_overview(_results(spark, d)).select("run_id", "selected", "valid", "failed", F.round("average_seconds", 4).alias("average_seconds"))


def run_companies(spark: SparkSession, d: str) -> DataFrame:
    return rv.run_rows(_results(spark, d), load_table(spark, d, "input_records"))


def queue_filter(spark: SparkSession, d: str) -> DataFrame:
    return rv.queue_filter(run_companies(spark, d), "steel", "valid", ["name", "industry"])


def selected_roles(spark: SparkSession, d: str) -> DataFrame:
    """First and last result of a record as competing candidates; a verdict for the other where its score is higher by 10."""
    rows = _results(spark, d).filter("record_id is not null").select("record_id", "run_id", "idx", (F.col("status") == "valid").alias("valid"), "score", F.concat_ws("|", "product_match", "commercial_match", "follow_up").alias("signature"))
    lead = rk.first_by_key(rows, ["record_id"], [F.asc("run_id"), F.asc("idx")])
    last = rk.first_by_key(rows, ["record_id"], [F.desc("run_id"), F.desc("idx")]).join(lead.select("record_id", "run_id", "idx"), ["record_id", "run_id", "idx"], "left_anti")
    verdict = lead.select("record_id", F.col("score").alias("a")).join(last.select("record_id", F.col("score").alias("b")), "record_id").select("record_id", F.when(F.col("b") >= F.col("a") + 10, "other").otherwise("lead").alias("decision"), F.lit(True).alias("ok"))
    return roles.select_role(lead, last, verdict, "record_id")


def report_markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = run_overview(spark, d)
    return rows.select("run_id", rv.markdown_line(F.col("run_id"), F.col("selected"), F.col("valid"), F.col("failed")).alias("line"))


def lead_round(spark: SparkSession, d: str) -> DataFrame:
    """Requests for all results, answered from the recorded ones; failed answers are asked for again."""
    rows = _results(spark, d).select(F.concat_ws("/", "run_id", "idx").alias("key"), F.lit("lead").alias("role"), F.col("status").alias("answer"))
    recorded = rows.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    requests = rows.select("key", "role", F.lit("").alias("prompt"))
    return rounds(requests, ReplayProvider(recorded), lambda a: a == "valid", 2)


RETRIEVAL_RULES = [va.Rule("$.mode", "one_of", ("search", "cache", "fallback")), va.Rule("$.pages", "integer", low=1, high=3), va.Rule("$.queries", "integer", low=0), va.Rule("$.seconds", "number", low=0, high=100)]


def retrieval_violations(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "evidence_bundles").select("bundle_id", F.array_join(va.violations(F.col("retrieval"), RETRIEVAL_RULES), "; ").alias("violations"))


def retrieval_totals(spark: SparkSession, d: str) -> DataFrame:
    r = load_table(spark, d, "evidence_bundles").select(F.from_json("retrieval", "mode string, pages int, queries int, seconds double").alias("r")).select("r.*")
    return r.groupBy(F.coalesce("mode", F.lit("")).alias("mode")).agg(F.count(F.lit(1)).alias("packs"), F.sum("pages").alias("pages"), F.sum("queries").alias("queries"), F.round(F.avg("seconds"), 4).alias("mean_seconds"))


def title_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Title of each source of a bundle: from the sources table, else the pack's list, else the section."""
    packs = load_table(spark, d, "evidence_bundles")
    a = load_table(spark, d, "sources").select("bundle_id", "id", F.lit(1).alias("priority"), "title")
    b = packs.select("bundle_id", F.explode("sources").alias("s")).select("bundle_id", "s.id", F.lit(2).alias("priority"), "s.title")
    c = ps.pack_sections(packs).select("bundle_id", F.col("section").alias("id"), F.lit(3).alias("priority"), "title")
    every = a.unionByName(b).unionByName(c).groupBy("bundle_id", "id", "priority").agg(F.max("title").alias("title"))
    return rt.first_success(every, ["bundle_id", "id"], "priority", ws_trim(F.coalesce("title", F.lit(""))) != "").select("bundle_id", "id", "priority", "title")


def reserved_sources(spark: SparkSession, d: str) -> DataFrame:
    """Official pages of a bundle first, then the others, distinct by provenance key, the first 8."""
    rows = u.with_url_parts(load_table(spark, d, "sources").select("source_row", "bundle_id", "url", "source_type"), "url").filter("url_norm <> ''")
    rows = rows.select("source_row", "bundle_id", "source_type", _page_key().alias("key"))
    return rt.reserved_union(rows, "bundle_id", "key", F.coalesce(F.col("source_type") == "官网", F.lit(False)), "source_row", 8).select("bundle_id", "source_row", "place")


def folded_names(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "input_records").filter("name is not null").select("record_id", tx.fold_text(F.col("name")).alias("folded"))


def seed_names(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "input_records").select("record_id", tx.identity_seed_name(F.col("name")).alias("seed"), tx.search_name(F.col("name")).alias("search_name"))


def record_slugs(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "input_records").select("record_id", tx.safe_slug(F.col("name")).alias("slug"))


def pack_addresses(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "evidence_bundles").select("bundle_id", F.posexplode(ps.pack_urls(F.col("text"))).alias("pos", "url"))


def grade_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = ps.table_rows(ps.pack_sections(load_table(spark, d, "evidence_bundles")), ["bundle_id", "section"])
    return rows.select("bundle_id", "section", "pos", F.col("cells")[0].alias("grade"), F.col("cells")[1].alias("share"), F.col("cells")[2].alias("density"))


def bundle_manifest(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "evidence_bundles").select("bundle_id", "company", F.coalesce(F.size("sources"), F.lit(0)).alias("source_count"), F.length("text").alias("chars"), (F.sha2("text", 256) == F.col("sha256")).alias("hash_holds"))


def cached_again(spark: SparkSession, d: str) -> DataFrame:
    """Packs whose text stands under more than one key: hash, number of packs, first pack."""
    rows = load_table(spark, d, "evidence_bundles").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("packs"), F.min("bundle_id").alias("first_bundle"))
    return rows.filter("packs > 1")


def parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    """How the retrieval notes parse as one JSON object each: strategy, error, number."""
    rows = load_table(spark, d, "evidence_bundles").select(ps.json_object("retrieval").alias("p"))
    return rows.groupBy(F.col("p.strategy").alias("strategy"), F.coalesce("p.error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def late_results(spark: SparkSession, d: str) -> DataFrame:
    """Results by run that were loaded more than a day after they were finished."""
    late = F.col("loaded_at") > F.col("finished_at") + F.make_dt_interval(F.lit(1))
    return _results(spark, d).groupBy("run_id").agg(F.sum(F.when(late, 1).otherwise(0)).alias("late"), F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        candidate_sample, contact_counts, weakness_reasons, record_checks, url_normalised, provenance_keys, pages_per_host, path_intents, trusted_sources, company_domains, identity_aliases, page_token_counts, substantive_pages,
        material_signals, levels_of_directions, secrets_redacted, evidence_sections, source_references, uncited_sources, page_relevance, own_page_relevance, ranked_pages, diverse_pages, interleaved_sources, longest_title_per_host, cache_lookup, repeated_cache_keys,
        resume_pending, overlaid_runs, quote_verification, compact_evidence, gap_reasons, known_directions, confusion_matrix, threshold_scan, best_threshold, average_ranks, score_quality, failure_stages, latency_summary, run_overview,
        run_companies, queue_filter, selected_roles, report_markdown, lead_round, retrieval_violations, retrieval_totals, title_fallback, reserved_sources, folded_names, seed_names, record_slugs,
        pack_addresses, grade_rows, bundle_manifest, cached_again, parsed_answers, late_results,
    )
} | texts.QUERIES
ORACLE: dict[str, str] = _ORACLE | _TEXTS

__all__ = ["ORACLE", "QUERIES"]
