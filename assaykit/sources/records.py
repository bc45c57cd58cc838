"""Record files, JDBC tables, Markdown tables, result trees; checks of input records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaykit.functions.urls import url_host
from assaykit.operators.parsers import markdown_table
from assaykit.plans.runtime import cut_lineage, ws_trim

RECORD_SCHEMA = "id string, name string, website string, linkedin_url string, country string, industry string, background string, updated_at string, contact_count int"


def json_records(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA, lines: bool = False) -> DataFrame:
    """Records of files that hold one JSON array each, or of JSON lines; broken ones come as nulls, not as an error. Lines are read in parts, an array by one task a file."""
    return spark.read.option("multiLine", not lines).option("mode", "PERMISSIVE").schema(schema).json(path)


def jdbc_table(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1) -> DataFrame:
    """A table behind JDBC; with a numeric column the read is split into that many ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("queryTimeout", 30)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
    return reader.load()


def markdown_records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of the Markdown table in a text file; see ``markdown_table``."""
    return markdown_table(spark.read.text(path), columns)


def result_tree(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """``result.json`` files below ``<root>/<run>/records/<record>/`` with ``run_id`` and ``record_dir`` from the path."""
    rows = spark.read.option("multiLine", True).schema(schema).json(f"{root}/*/records/*/result.json").withColumn("_p", F.col("_metadata.file_path"))
    return rows.withColumn("run_id", F.regexp_extract("_p", r"([^/]+)/records/[^/]+/result\.json$", 1)).withColumn("record_dir", F.regexp_extract("_p", r"/records/([^/]+)/result\.json$", 1)).drop("_p")


def record_violations(records: DataFrame, key: str = "record_id") -> DataFrame:
    """``key, violation``: blank name, repeated id, website without a dotted host. Null ids and blank websites are no violation."""
    repeated = records.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    again = records.join(repeated, "id", "left_semi").select(key, F.lit("repeated id").alias("violation"))
    blank = records.filter(ws_trim(F.coalesce("name", F.lit(""))) == "").select(key, F.lit("blank name").alias("violation"))
    site = ws_trim(F.coalesce("website", F.lit("")))
    bad = records.filter((site != "") & ~url_host(F.col("website")).contains(".")).select(key, F.lit("website without host").alias("violation"))
    return again.unionByName(blank).unionByName(bad)


def with_input_ids(records: DataFrame, order: str) -> DataFrame:
    """Missing ids become ``input-NNN``, numbered by ``order`` among all records; ``order`` must be unique.

    Numbers are sums over parts: rows are range-parted by ``order`` and numbered within their part, parts are offset by the
    rows before them, so no task sees more than its part.
    """
    parted = records.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    parted = cut_lineage(parted)
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row a partition, so the ordered sum over all of them is short.
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    n = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(order))
    named = parted.join(F.broadcast(offsets), "_part").withColumn("id", F.coalesce(F.nullif(ws_trim(F.col("id")), F.lit("")), F.format_string("input-%03d", n)))
    return named.drop("_part", "_before")
