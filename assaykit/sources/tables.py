"""Table access: one Parquet file or folder per table below a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of ``<sf_dir>/<name>.parquet``; filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
