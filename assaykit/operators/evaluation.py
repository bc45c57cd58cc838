"""Confusion, threshold scan, ranks, correlation, latency: conditional aggregates over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, positive: Column, score: Column, threshold: Column, by: list[str] | None = None) -> DataFrame:
    """Counts and ratios of predictions ``score >= threshold``; a null score abstains and counts against recall or specificity.

    Zero denominators give 0. Works over the whole table or by group; one shuffle of partial sums.
    """
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    scored = score.isNotNull()
    agg = (rows.groupBy(*by) if by else rows.groupBy()).agg(
        n(positive & (score >= threshold)).alias("tp"), n(~positive & (score >= threshold)).alias("fp"), n(~positive & (score < threshold)).alias("tn"), n(positive & (score < threshold)).alias("fn"),
        n(positive & ~scored).alias("abstain_pos"), n(~positive & ~scored).alias("abstain_neg"), F.count(F.lit(1)).alias("n"),
    )
    c = F.col
    agg = agg.withColumn("precision", _ratio(c("tp"), c("tp") + c("fp"))).withColumn("recall", _ratio(c("tp"), c("tp") + c("fn") + c("abstain_pos"))).withColumn("specificity", _ratio(c("tn"), c("tn") + c("fp") + c("abstain_neg")))
    agg = agg.withColumn("accuracy", _ratio(c("tp") + c("tn"), c("n"))).withColumn("coverage", _ratio(c("n") - c("abstain_pos") - c("abstain_neg"), c("n")))
    return agg.withColumn("balanced", (c("recall") + c("specificity")) / 2).withColumn("f1", _ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def threshold_scan(rows: DataFrame, positive: Column, score: Column, thresholds: range = range(0, 101, 5)) -> DataFrame:
    """``confusion`` for each threshold. Rows are first counted by (class, score), so the expansion is of those counts only."""
    counts = rows.groupBy(positive.alias("p"), score.alias("s")).agg(F.count(F.lit(1)).alias("k"))
    each = counts.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    w = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    p, s, t = F.col("p"), F.col("s"), F.col("threshold")
    agg = each.groupBy("threshold").agg(w(p & (s >= t)).alias("tp"), w(~p & (s >= t)).alias("fp"), w(~p & (s < t)).alias("tn"), w(p & (s < t)).alias("fn"), w(p & s.isNull()).alias("abstain_pos"), w(~p & s.isNull()).alias("abstain_neg"))
    c = F.col
    agg = agg.withColumn("precision", _ratio(c("tp"), c("tp") + c("fp"))).withColumn("recall", _ratio(c("tp"), c("tp") + c("fn") + c("abstain_pos"))).withColumn("specificity", _ratio(c("tn"), c("tn") + c("fp") + c("abstain_neg")))
    return agg.withColumn("balanced", (c("recall") + c("specificity")) / 2).withColumn("f1", _ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def best_threshold(scan: DataFrame) -> DataFrame:
    """The threshold of the greatest (balanced, f1, threshold)."""
    return scan.agg(F.max_by("threshold", F.struct("balanced", "f1", "threshold")).alias("threshold"), F.max("balanced").alias("balanced"))


def average_ranks(rows: DataFrame, value: str, by: list[str], name: str = "avg_rank") -> DataFrame:
    """Average ranks of ties within a group, made on counts by distinct value and joined back: ties are never gathered."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k"))
    before = F.sum("_k").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.withColumn(name, F.coalesce(before, F.lit(0)) + (F.col("_k") + 1) / 2).drop("_k")
    return rows.join(ranks, [*by, value])


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation, null where a side does not vary or there are fewer than two rows."""
    return F.when((F.count(F.lit(1)) > 1) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def score_quality(rows: DataFrame, manual: str, score: str, by: list[str]) -> DataFrame:
    """``n, mae, pearson, spearman`` of rows that have both values, by group."""
    both = rows.select(*by, F.col(manual).cast("double").alias("m"), F.col(score).cast("double").alias("s")).dropna(subset=["m", "s"])
    ranked = average_ranks(average_ranks(both, "m", by, "rm"), "s", by, "rs")
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("m") - F.col("s"))).alias("mae"), safe_corr(F.col("m"), F.col("s")).alias("pearson"), safe_corr(F.col("rm"), F.col("rs")).alias("spearman"))


def index_quantile(rows: DataFrame, value: str, by: list[str], fraction: float, name: str) -> DataFrame:
    """Value at index ``min(n - 1, int(n * fraction))`` of the sorted values by group, from counts by distinct value.

    No group is collected or sorted whole; only its distinct values with counts are ordered.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*by)
    run = counts.withColumn("upto", F.sum("k").over(w.orderBy(value))).withColumn("n", F.sum("k").over(w))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(fraction)).cast("bigint"))
    return run.filter(F.col("upto") > at).groupBy(*by).agg(F.min(value).alias(name))


def failure_stage(score: Column, errors: Column) -> Column:
    """'' if scored, retrieval for missing evidence or timeouts, structured_extraction for unreadable answers, else scoring."""
    text = F.array_join(F.coalesce(errors, F.array().cast("array<string>")), ";")
    return F.when(score.isNotNull(), "").when(text.contains("evidence") | text.contains("timeout"), "retrieval").when(text.contains("JSON"), "structured_extraction").otherwise("scoring")


def assembled(manual: DataFrame, baseline: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """One row a key that all three tables have, with ``change`` of the score where both results have one."""
    rows = manual.join(baseline, key).join(candidate, key)
    return rows.withColumn("change", F.col("candidate") - F.col("baseline"))


def size_summary(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``calls, median, p95, longest`` by group, from counts by distinct value; the median of an even number is the mean of the middle two."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*by)
    run = counts.withColumn("upto", F.sum("k").over(w.orderBy(value))).withColumn("n", F.sum("k").over(w))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col(value)))
    n = F.col("n")
    low, high, top = F.floor((n - 1) / 2), F.floor(n / 2), F.least(n - 1, F.floor(n * F.lit(0.95)))
    out = run.groupBy(*by, "n").agg(at(low).alias("low"), at(high).alias("high"), at(top).alias("p95"), F.max(value).alias("longest"))
    return out.select(*by, F.col("n").alias("calls"), ((F.col("low") + F.col("high")) / 2).alias("median"), "p95", "longest")
