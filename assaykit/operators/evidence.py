"""Quotes against their sources, compaction of packs, co-occurrence rules, references between rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaykit.functions.text import normalised_quote


def verified_quotes(quotes: DataFrame, sections: DataFrame, keys: list[str], quote: str = "quote", body: str = "body", least: int = 12) -> DataFrame:
    """``quotes`` with ``verified``: the normalised quote, at least ``least`` characters when trimmed, occurs in a section of its key.

    Both sides are normalised once; the join is an equi-join on ``keys``, containment is tested within it. Quotes whose
    key has no section are not verified. Duplicated quotes stay as they are.
    """
    left = quotes.withColumn("_q", normalised_quote(F.col(quote))).withColumn("_id", F.monotonically_increasing_id() if "quote_id" not in quotes.columns else F.col("quote_id"))
    right = sections.select(*keys, normalised_quote(F.col(body)).alias("_t"))
    usable = left.filter((F.length(F.trim(quote)) >= least) & (F.col("_q") != ""))
    found = usable.select("_id", *keys, "_q").join(right, keys).filter(F.contains("_t", "_q")).select("_id").distinct().withColumn("verified", F.lit(True))
    return left.join(found, "_id", "left").withColumn("verified", F.coalesce("verified", F.lit(False))).drop("_q", "_id")


def verified_facts(facts: DataFrame, sections: DataFrame) -> DataFrame:
    """``bundle_id, fact_no, statement, sources`` of ``facts(bundle_id, pos, statement, evidence)`` that hold.

    A statement needs 8 characters and one of its first 3 quotes verified in the section it cites; numbers count the
    facts that hold.
    """
    cited = facts.select("bundle_id", "pos", "statement", F.posexplode(F.slice("evidence", 1, 3)).alias("k", "e")).select("bundle_id", "pos", "statement", "k", F.col("e.source_id").alias("section"), F.col("e.quote").alias("quote"))
    cited = cited.withColumn("quote_id", F.struct("bundle_id", "pos", "k"))
    good = verified_quotes(cited, sections, ["bundle_id", "section"]).filter("verified")
    held = good.filter(F.length(F.trim("statement")) >= 8).groupBy("bundle_id", "pos", "statement").agg(F.array_sort(F.collect_set("section")).alias("sources"))
    return held.withColumn("fact_no", F.row_number().over(Window.partitionBy("bundle_id").orderBy("pos"))).select("bundle_id", "fact_no", "statement", "sources")


def compact_pack(text: Column) -> Column:
    """The head, section marks, URL and Title lines, list items and headings of a pack; running text is dropped."""
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"^(#|Company:|URL:|Title:|[-*•] )"))
    return F.concat_ws("\n", kept)


def rule_hits(text: Column, rules: dict[str, tuple[str, str | None]]) -> Column:
    """Names of the rules whose first pattern occurs while the second (if any) does not, in order."""
    t = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(t.rlike(a) & (~t.rlike(b) if b else F.lit(True)), F.lit(n)) for n, (a, b) in rules.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def dangling(rows: DataFrame, ids: str, known: str) -> DataFrame:
    """Rows whose array ``ids`` holds ids missing from the array ``known``, with ``missing``; null arrays count as empty."""
    empty = F.array().cast("array<string>")
    missing = F.array_except(F.coalesce(F.col(ids), empty), F.coalesce(F.col(known), empty))
    return rows.withColumn("missing", missing).filter(F.size("missing") > 0)


def remapped_ids(ids: Column, old_to_new: Column, active: Column, at_most: int = 3) -> Column:
    """Ids mapped, distinct in order, active ones only; if none is left the first ``at_most`` active ids."""
    mapped = F.transform(ids, lambda i: F.coalesce(F.try_element_at(old_to_new, i), i))
    kept = F.array_distinct(F.filter(mapped, lambda i: F.array_contains(active, i)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(active, 1, at_most))
