"""Queries of the eight problems over the tables of a data directory, and SQL for those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import address_copies as ac
from assaykit.llm import canonical_values as cv
from assaykit.llm import name_links as nl
from assaykit.llm import page_body as pb
from assaykit.llm import personal_data as pd8
from assaykit.llm.containers import container_report, containers
from assaykit.llm.source_mix import mix_shares, source_mix
from assaykit.llm.token_sizes import token_size
from assaykit.plans.runtime import cut_lineage
from assaykit.sources.tables import load_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = load_table(spark, sf_dir, "catalog_products")
    countries = load_table(spark, sf_dir, "country_list")
    a = cv.mapped_rows(load_table(spark, sf_dir, "directions"), cv.reference(spark, products, "product_id", ["name", "name_zh"], "product"), "direction_id", "product", products, "directions")
    b = cv.mapped_rows(load_table(spark, sf_dir, "input_records"), cv.reference(spark, countries, "country_id", ["name", "code"], "country"), "record_id", "country", countries, "input_records", places=True)
    return a.unionByName(b)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(pb.parsed(load_table(spark, sf_dir, "evidence_bundles")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pb.furniture_lines(_parts(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    messages = cut_lineage(pb.message_templates(pb.section_units(parts)))
    pages = pb.residue_sections(parts, messages).select(F.lit("evidence_bundles").alias("table_name"), F.col("bundle_id").cast("bigint").alias("row_id"), "section")
    titles = pb.residue_titles(load_table(spark, sf_dir, "sources"), "source_row", "title", messages).select(F.lit("sources").alias("table_name"), "row_id", F.lit("").alias("section"))
    return pages.unionByName(titles)


def _firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load_table(spark, sf_dir, "input_records").select("record_id", "name", "website", "linkedin_url", "country")
    list_ = cv.reference(spark, load_table(spark, sf_dir, "country_list"), "country_id", ["name", "code"], "country")
    typed = rows.filter(F.col("country").rlike(r"\S")).groupBy(F.col("country").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    mapped = cv.canonical_values(typed, list_, places=True).filter("entry_id > 0").select(F.col("value").alias("country"), F.col("entry_id").alias("country_id"), "n")
    return nl.firms(nl.firm_keys(rows, cut_lineage(mapped)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nl.firm_pairs(_firms(spark, sf_dir))


def p4_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _firms(spark, sf_dir)


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ac.hashed_addresses(load_table(spark, sf_dir, "sources"), "source_row", "url", "sources").unionByName(ac.hashed_addresses(load_table(spark, sf_dir, "input_records"), "record_id", "website", "input_records"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ac.address_copies(_hashed(spark, sf_dir))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ac.address_counts(_hashed(spark, sf_dir))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "source", token_size(F.col("text")).alias("tokens"))
    return cut_lineage(docs)


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _sized(spark, sf_dir)
    kinds = load_table(spark, sf_dir, "container_sizes").orderBy("container_kind").collect()
    parts = [containers(sized, k["capacity_tokens"]).select(F.lit(k["container_kind"]).alias("container_kind"), F.lit(k["capacity_tokens"]).alias("capacity_tokens"), "*") for k in kinds]
    return reduce(DataFrame.unionByName, parts)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_report(p6_packing(spark, sf_dir))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(_sized(spark, sf_dir), load_table(spark, sf_dir, "source_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = load_table(spark, sf_dir, "source_targets")
    return mix_shares(source_mix(_sized(spark, sf_dir), targets), targets)


def p7_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mix as large as all documents: sources too small for their share give all that their repeats allow."""
    targets, sized = load_table(spark, sf_dir, "source_targets"), _sized(spark, sf_dir)
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    return mix_shares(source_mix(sized, targets, total=total), targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pd8.personal_values(pd8.personal_spans(load_table(spark, sf_dir, "documents")))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    return pd8.redacted(docs, pd8.personal_spans(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_firms": p4_firms, "p5_found": p5_found, "p3_counts": p3_counts, "p6_packing": p6_packing, "p6_report": p6_report, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_capped": p7_capped, "p8_found": p8_found, "p8_redacted": p8_redacted}
_AROUND = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(12288) || chr(8203) || chr(65279) || '\"''`<>()[]{}«»‹›“”„‘’.,;:!?…'"
_STAND_INS = ", ".join(f"'{x}'" for x in ac.STAND_INS)
_CANON = f"""rows as (select 'sources' as table_name, source_row as row_id, url as a from sources union all select 'input_records', record_id, website from input_records),
bare as (select table_name, row_id, lower(trim(coalesce(a, ''), {_AROUND})) as b from rows),
rest as (select table_name, row_id, split_part(regexp_replace(b, '^https?:/+', ''), '#', 1) as r from bare where b not in ({_STAND_INS}) and (not contains(b, '://') or regexp_matches(b, '^https?://'))),
cut as (select table_name, row_id, regexp_replace(regexp_replace(split_part(split_part(r, '/', 1), '?', 1), '^(?:.*@)?(?:www\\.)?', ''), '\\.*(?::\\d*)?$', '') as host,
  regexp_replace(regexp_replace(regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), ';[^/]*$', ''), '/+$', ''), '/+', '/', 'g') as path,
  list_sort(list_filter(string_split(translate(case when contains(r, '?') then regexp_extract(r, '\\?(.*)$', 1) else '' end, '+', ' '), '&'), lambda f: f <> '' and split_part(f, '=', 1) not in ('srsltid', 'gclid', 'fbclid') and not starts_with(split_part(f, '=', 1), 'utm_'))) as fields from rest),
canon as (select table_name, row_id, host || ' ' || path || ' ' || array_to_string(fields, '&') as address from cut where regexp_matches(host, '^[^.\\s]+(\\.[^.\\s]+)+$'))"""

#: SQL for the problems that DuckDB can express over whole tables; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "p3_found": f"with {_CANON}, k as (select table_name, address, min(row_id) as kept_id from canon group by all) select c.table_name, k.kept_id, c.row_id as copy_id from canon c join k using (table_name, address) where c.row_id <> k.kept_id",
    "p3_counts": f"with {_CANON} select table_name, address, min(row_id) as kept_id, count(*) as copies from canon group by all",
}
