"""Run overview over a growing folder of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def results_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_overview(results: DataFrame, time: str = "finished_at", late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Counts and mean duration by run and window; whole rows that come again count once while the watermark holds them."""
    rows = results.withWatermark(time, late).dropDuplicatesWithinWatermark(["run_id", "idx"])
    return rows.groupBy(F.window(time, width), "run_id").agg(F.count(F.lit(1)).alias("selected"), F.sum((F.col("status") == "valid").cast("bigint")).alias("valid"), F.avg("duration_seconds").alias("average_seconds"))


def run_to_folder(rows: DataFrame, folder: str, checkpoint: str) -> None:
    """Run a stream of whole aggregates over all that is there and stop; ``folder`` holds the state after the last batch."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    query = rows.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
