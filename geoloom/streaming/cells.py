"""Cell counts over a stream of located events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import grid
from geoloom.storage import new_path


def located(events: DataFrame) -> DataFrame:
    """The driver's events with the same derived places as the batch queries."""
    k, d = F.col("event_id"), F.lit(10000.0)
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), ((F.lit(168000) + (k * 389) % 1200) / d).alias("lon"), ((F.lit(510400) + (k * 211) % 900) / d).alias("lat")
    )


def cell_counts(points: DataFrame, *, zoom: int, window: str, lateness: str) -> DataFrame:
    """Counts per cell and time window; state older than the watermark is dropped."""
    cell = grid.tile_of(F.col("lon"), F.col("lat"), zoom).alias("region_id")
    return points.withWatermark("ts", lateness).groupBy(cell, F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def daily_cell_counts(events: DataFrame) -> DataFrame:
    counts = cell_counts(located(events), zoom=12, window="1 day", lateness="7 days")
    return counts.select("region_id", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


def run_once(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a streaming plan over what is at ``path`` now, to its end, and returns the result.

    Update mode writes each micro-batch's changed rows to a shared folder; the last value of a
    window wins by batch number.
    """
    schema = spark.read.parquet(path).schema
    place = new_path(spark, "stream")
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema)
    stream = build(source.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else source.parquet(path))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{place}/out")

    done = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    keys = [c for c in stream.columns if c != "n"]
    out = spark.read.schema(stream.schema.add("_batch", "integer")).parquet(f"{place}/out")
    return out.groupBy(*keys).agg(F.max_by("n", "_batch").alias("n"))
