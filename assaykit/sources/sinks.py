"""Results to files: tables, JSON, Markdown and HTML reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.text import html_escape
from assaykit.operators.review import markdown_line


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, overwritten whole or by partition; the committer makes it appear at once."""
    w = df.write.mode("overwrite")
    if by:
        w = w.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_report(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """``value``: heading, rule and one line a row, as a DataFrame of text lines that ``write.text`` can store."""
    spark = df.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))], "k int, value string")
    body = df.select(F.lit(2).alias("k"), *order, markdown_line(*[F.col(c) for c in columns]).alias("value"))
    return head.unionByName(body, allowMissingColumns=True).orderBy("k", *order).select("value")


def html_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """``value``: one escaped table row a row."""
    return df.select(F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *[html_escape(F.col(c).cast("string")) for c in columns]), F.lit("</td></tr>")).alias("value"))
