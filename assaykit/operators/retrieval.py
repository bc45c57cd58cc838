"""Attempts in order of priority, budgets, ordered unions: what decides which pages and answers are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaykit.operators.ranking import first_by_key


def first_success(attempts: DataFrame, keys: list[str], priority: str, ok: Column) -> DataFrame:
    """The successful attempt of least priority by key; keys without success give no row. One aggregate, no sort of groups."""
    rest = [c for c in attempts.columns if c not in keys and c != priority]
    best = attempts.filter(ok).groupBy(*keys).agg(F.min_by(F.struct(priority, *rest), priority).alias("_b"))
    return best.select(*keys, "_b.*")


def within_budget(rows: DataFrame, group: str, order: list[Column], budget: int) -> DataFrame:
    """The first ``budget`` rows of each group, made before a costly call so that it runs on no others."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= budget).drop("_n")


def reserved_union(rows: DataFrame, group: str, key: str, reserved: Column, pos: str, limit: int) -> DataFrame:
    """Reserved rows first, each part in its order, distinct by key, the first ``limit``: column ``place`` from 1."""
    ordered = rows.withColumn("_p", F.when(reserved, 0).otherwise(1))
    once = first_by_key(ordered, [group, key], [F.asc("_p"), F.asc(pos)])
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_p", pos)))
    return placed.filter(F.col("place") <= limit).drop("_p")


def only_for_missing(fallback: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows of a fallback for those keys only that have found nothing."""
    return fallback.join(found.select(key).distinct(), key, "left_anti")


def accepted_recovery(primary: DataFrame, recovered: DataFrame, key: str, gaps: str = "gaps") -> DataFrame:
    """``key, source, gaps``: the recovered row where there is no primary one, or where it closes a gap of it; else the primary row."""
    p = primary.select(key, F.col(gaps).alias("_p"))
    r = recovered.select(key, F.col(gaps).alias("_r"))
    both = p.join(r, key, "full_outer")
    closes = F.size(F.array_except("_p", "_r")) > 0
    use = F.col("_p").isNull() | (F.col("_r").isNotNull() & closes)
    return both.select(key, F.when(use, "recovered").otherwise("primary").alias("source"), F.when(use, F.col("_r")).otherwise(F.col("_p")).alias(gaps))
