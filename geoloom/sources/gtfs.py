"""Public-transport feeds: GTFS text tables to features per stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.scalars import gtfs_hour

HOURS = tuple(range(24))


def read_feed(spark: SparkSession, folder: str, tables: tuple[str, ...] = ("stops", "stop_times", "trips")) -> dict[str, DataFrame]:
    """The tables of an unpacked feed; values stay text until they are used."""
    return {t: spark.read.option("header", True).csv(f"{folder}/{t}.txt") for t in tables}


def validate(report: DataFrame, fail: bool = True, shown: int = 1000) -> list[str]:
    """Messages of a validation report (type, message), errors first; errors raise ValueError if asked.

    Every row is looked at; ``shown`` bounds only how many messages come to the driver.
    """
    error = F.col("type") == "error"
    rows = report.select("type", "message").orderBy(F.when(error, 0).otherwise(1), "type", "message").limit(shown).collect()
    if fail and rows and rows[0]["type"] == "error":
        raise ValueError("the feed has errors: " + "; ".join(r["message"] for r in rows if r["type"] == "error"))
    return [f"{r['type']}: {r['message']}" for r in rows]


def trips_per_hour(series: DataFrame, hours=HOURS) -> DataFrame:
    """Mean trips per stop and hour from a time series (stop_id, hour, num_trips); 0 where absent."""
    wide = series.groupBy("stop_id").pivot("hour", list(hours)).agg(F.avg("num_trips")).na.fill(0)
    return wide.select("stop_id", *[F.col(str(h)).alias(f"trips_at_{h}") for h in hours])


def directions_per_hour(stop_times: DataFrame, trips: DataFrame, hours=HOURS) -> DataFrame:
    """Distinct headsigns per stop and hour; null where there are none."""
    hit = stop_times.filter(F.col("departure_time").isNotNull()).select("trip_id", "stop_id", gtfs_hour(F.col("departure_time")).alias("hour"))
    hit = hit.join(trips.select("trip_id", "trip_headsign"), "trip_id")
    wide = hit.groupBy("stop_id").pivot("hour", list(hours)).agg(F.array_sort(F.collect_set("trip_headsign")))
    return wide.select("stop_id", *[F.when(F.size(F.col(str(h))) > 0, F.col(str(h))).alias(f"directions_at_{h}") for h in hours])


def trip_series(stop_times: DataFrame) -> DataFrame:
    """Trips per stop and hour of one service day."""
    hit = stop_times.filter(F.col("departure_time").isNotNull()).select("stop_id", "trip_id", gtfs_hour(F.col("departure_time")).alias("hour"))
    return hit.groupBy("stop_id", "hour").agg(F.countDistinct("trip_id").alias("num_trips"))


def stop_features(feed: dict[str, DataFrame], hours=HOURS, series: DataFrame | None = None) -> DataFrame:
    """Per stop: trips_at_H, directions_at_H, lon and lat. Hours without trips anywhere drop out.

    The used hours are found in one small aggregation over the series.
    """
    series = trip_series(feed["stop_times"]) if series is None else series
    used = sorted(r["hour"] for r in series.groupBy("hour").agg(F.sum("num_trips").alias("n")).filter("n > 0").collect())
    hours = [h for h in hours if h in used]
    stops = feed["stops"].select("stop_id", F.col("stop_lon").cast("double").alias("lon"), F.col("stop_lat").cast("double").alias("lat"))
    trips, ways = trips_per_hour(series, hours), directions_per_hour(feed["stop_times"], feed["trips"], hours)
    return stops.join(trips, "stop_id").join(ways, "stop_id", "left").withColumnRenamed("stop_id", "feature_id")
