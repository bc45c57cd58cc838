"""Read model over results: runs, their rows, queue filter, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.plans.runtime import ws_trim


def clean_status(c: Column) -> Column:
    """valid or failed; other states count as failed."""
    return F.when(F.lower(ws_trim(F.coalesce(c, F.lit("")))) == "valid", "valid").otherwise("failed")


def once(results: DataFrame) -> DataFrame:
    """One row by (run_id, idx): rows that were delivered again count once, the latest delivery stays."""
    columns = [c for c in results.columns if c not in ("run_id", "idx")]
    best = results.groupBy("run_id", "idx").agg(F.max_by(F.struct(*columns), F.struct("loaded_at", "finished_at")).alias("r"))
    return best.select("run_id", "idx", "r.*")


def run_overview(results: DataFrame) -> DataFrame:
    """``run_id, selected, valid, failed, average_seconds``; partial aggregates, one shuffle."""
    s = clean_status(F.col("status"))
    return results.groupBy("run_id").agg(F.count(F.lit(1)).alias("selected"), F.sum((s == "valid").cast("bigint")).alias("valid"), F.sum((s == "failed").cast("bigint")).alias("failed"), F.avg("duration_seconds").alias("average_seconds"))


def bounded_score(c: Column) -> Column:
    return F.when(c.between(0, 100), c)


def run_rows(results: DataFrame, records: DataFrame, run_id: str | None = None) -> DataFrame:
    """Rows of a run (or of all) with the name of the record; a filter on ``run_id`` prunes partitions."""
    rows = results if run_id is None else results.filter(F.col("run_id") == run_id)
    return rows.join(records.select("record_id", "name", "industry"), "record_id", "left").select("run_id", "idx", "record_id", "name", "industry", clean_status(F.col("status")).alias("status"), bounded_score(F.col("score")).alias("score"))


def queue_filter(rows: DataFrame, text: str, status: str, columns: list[str]) -> DataFrame:
    """Rows that hold ``text`` in one of ``columns``, whatever its case, and have the status; '' passes all."""
    out = rows.filter(F.lower(F.concat_ws(" ", *columns)).contains(text.lower())) if text else rows
    return out.filter(F.col("status") == status) if status else out


def markdown_line(*cells: Column) -> Column:
    """One row of a Markdown table; pipes are escaped and line breaks become blanks."""
    clean = [F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *clean), F.lit(" |"))
