"""Stratified sampling of records whose description is thin."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaykit.plans.runtime import ws_trim

#: Labels of a standard description.
STANDARD_LABELS = ("主营", "产品", "工艺", "采购")


def weakness_reasons(background: Column, labels: tuple[str, ...] = STANDARD_LABELS) -> Column:
    """Why a description is weak: 'blank' alone, or too short (n) / thin (n), no standard labels, no link."""
    t = ws_trim(F.coalesce(background, F.lit("")))
    n = F.length(t)
    labelled = F.lit(False)
    for x in labels:
        labelled = labelled | t.contains(x)
    reasons = F.array(
        F.when(n < 80, F.concat(F.lit("too short ("), n.cast("string"), F.lit(")"))).when(n < 300, F.concat(F.lit("thin ("), n.cast("string"), F.lit(")"))),
        F.when(~labelled, F.lit("no standard labels")),
        F.when(~t.contains("http://") & ~t.contains("https://"), F.lit("no link")),
    )
    return F.when(t == "", F.array(F.lit("blank"))).otherwise(F.filter(reasons, lambda r: r.isNotNull()))


def filtered_counts(children: DataFrame, parent: str, keep: Column) -> DataFrame:
    """``parent, contact_count``: children that pass ``keep`` by parent; parents whose children all fail count 0."""
    return children.filter(F.col(parent).isNotNull()).groupBy(parent).agg(F.count(F.when(keep, 1)).alias("contact_count"))


def candidate_sample(records: DataFrame, counts: DataFrame, strata: list[str], limit: int, key: str = "record_id") -> DataFrame:
    """Top rows by stratum, then ``limit`` rows in order of the strata.

    Kept are rows of the listed strata with name, website and a description that is blank or below 300 characters. In
    a stratum empty descriptions go first, then more contacts, later updates, the smaller key. Each stratum may give
    ``ceil(limit / strata)`` rows; the rank filter becomes a per-partition limit ahead of the shuffle.
    """
    t = ws_trim(F.coalesce(F.col("background"), F.lit("")))
    rows = records.filter(F.col("industry").isin(*strata) & (ws_trim(F.coalesce("name", F.lit(""))) != "") & (ws_trim(F.coalesce("website", F.lit(""))) != "") & (F.length(t) < 300))
    rows = rows.join(counts, key, "left").withColumn("contacts", F.coalesce("contact_count_child", F.lit(0).cast("bigint"))).withColumn("empty", (t == "").cast("int"))
    w = Window.partitionBy("industry").orderBy(F.desc("empty"), F.desc("contacts"), F.desc_nulls_first("updated_at"), F.asc(key))
    ranked = rows.withColumn("industry_rank", F.row_number().over(w)).filter(F.col("industry_rank") <= ceil(limit / len(strata)))
    order = F.array_position(F.array(*[F.lit(x) for x in strata]), F.col("industry"))
    return ranked.withColumn("stratum", order).orderBy("stratum", "industry_rank").limit(limit).select(key, "name", "industry", "contacts", "industry_rank")
