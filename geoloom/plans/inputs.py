"""Domain tables derived from the driver's keys, as DataFrames and as the same SQL.

No driver table holds coordinates, so places follow from integer keys: numerators are integers
and are divided once, which gives the same doubles in every engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) with its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place_lon(key: Column) -> Column:
    return (F.lit(168000) + (key * 7919) % 3800) / F.lit(10000.0)


def place_lat(key: Column) -> Column:
    return (F.lit(510400) + (key * 104729) % 1700) / F.lit(10000.0)


def sql_lon(key: str) -> str:
    return f"(CAST(168000 + ({key} * 7919) % 3800 AS DOUBLE) / CAST(10000 AS DOUBLE))"


def sql_lat(key: str) -> str:
    return f"(CAST(510400 + ({key} * 104729) % 1700 AS DOUBLE) / CAST(10000 AS DOUBLE))"


def sql_x(lon: str, zoom: int) -> str:
    return f"CAST(floor(({lon} + CAST(180 AS DOUBLE)) / CAST(360 AS DOUBLE) * CAST({2**zoom} AS DOUBLE)) AS BIGINT)"


def sql_y(lat: str, zoom: int) -> str:
    return f"CAST(floor((CAST(1 AS DOUBLE) - asinh(tan(radians({lat}))) / pi()) / CAST(2 AS DOUBLE) * CAST({2**zoom} AS DOUBLE)) AS BIGINT)"


def sql_id(x: str, y: str, zoom: int) -> str:
    return f"concat(CAST({x} AS VARCHAR), '_', CAST({y} AS VARCHAR), '_{zoom}')"


# Point features: customers with a category and a value.
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("feature_id"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("value"), place_lon(k).alias("lon"), place_lat(k).alias("lat")
    )


PTS = f"pts AS (SELECT c_custkey AS feature_id, c_mktsegment AS seg, c_acctbal AS value, {sql_lon('c_custkey')} AS lon, {sql_lat('c_custkey')} AS lat FROM customer)"


def tiled(spark: SparkSession, sf_dir: str, zoom: int) -> DataFrame:
    from geoloom.functions import grid

    return points(spark, sf_dir).withColumns({"x": grid.tile_x(F.col("lon"), zoom), "y": grid.tile_y(F.col("lat"), zoom)}).withColumn("region_id", grid.tile_id(F.col("x"), F.col("y"), zoom))


def sql_tiled(zoom: int) -> str:
    return f"{PTS}, xy AS (SELECT *, {sql_x('lon', zoom)} AS x, {sql_y('lat', zoom)} AS y FROM pts), tiled AS (SELECT *, {sql_id('x', 'y', zoom)} AS region_id FROM xy)"


# Features with nullable tags: line items of an order as one feature each.
def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("feature_id"),
        F.when(k % 3 != 0, F.col("p_brand")).alias("brand"),
        F.when(k % 5 < 3, F.concat(F.lit("size"), (F.col("p_size") % 4).cast("string"))).alias("size"),
        (F.col("p_retailprice") > 1000).alias("dear"),
        place_lon(k).alias("lon"),
        place_lat(k).alias("lat"),
    )


TAGS = f"""tags AS (SELECT p_partkey AS feature_id, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS brand,
  CASE WHEN p_partkey % 5 < 3 THEN concat('size', CAST(p_size % 4 AS VARCHAR)) END AS size, p_retailprice > 1000 AS dear,
  {sql_lon('p_partkey')} AS lon, {sql_lat('p_partkey')} AS lat FROM part)"""


# Box regions: 25 nations on a 5 by 5 grid of touching boxes.
def box_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    i, j = n % 5, F.floor(n / 5).cast("int")
    at = lambda base, step, v: (F.lit(base) + v * step) / F.lit(10000.0)
    return table(spark, sf_dir, "nation").select(
        n.alias("region_id"), at(168000, 760, i).alias("minx"), at(510400, 340, j).alias("miny"), at(168000, 760, i + 1).alias("maxx"), at(510400, 340, j + 1).alias("maxy")
    )


def _edge(base: int, step: int, v: str) -> str:
    return f"CAST({base} + {step} * ({v}) AS DOUBLE) / CAST(10000 AS DOUBLE)"


REGS = f"""regs AS (SELECT n_nationkey AS region_id, {_edge(168000, 760, 'n_nationkey % 5')} AS minx, {_edge(510400, 340, 'n_nationkey // 5')} AS miny,
  {_edge(168000, 760, 'n_nationkey % 5 + 1')} AS maxx, {_edge(510400, 340, 'n_nationkey // 5 + 1')} AS maxy FROM nation)"""


# Box features: suppliers with a size of their own.
def box_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y, r = F.lit(168000) + (k * 7919) % 3800, F.lit(510400) + (k * 104729) % 1700, (k % 7 + 1) * 20
    d = F.lit(10000.0)
    return table(spark, sf_dir, "supplier").select(
        k.alias("feature_id"), ((x - r) / d).alias("minx"), ((y - r) / d).alias("miny"), ((x + r) / d).alias("maxx"), ((y + r) / d).alias("maxy")
    )


def _ext(base: int, mul: int, mod: int, sign: str) -> str:
    return f"CAST({base} + (s_suppkey * {mul}) % {mod} {sign} (s_suppkey % 7 + 1) * 20 AS DOUBLE) / CAST(10000 AS DOUBLE)"


BOXES = f"""boxes AS (SELECT s_suppkey AS feature_id, {_ext(168000, 7919, 3800, '-')} AS minx, {_ext(510400, 104729, 1700, '-')} AS miny,
  {_ext(168000, 7919, 3800, '+')} AS maxx, {_ext(510400, 104729, 1700, '+')} AS maxy FROM supplier)"""


# Trajectory points: a user's events in time order.
def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trip_id"), "ts", k, "value", ((F.lit(168000) + (k * 389) % 1200)/ F.lit(10000.0)).alias("lon"), ((F.lit(510400) + (k * 211) % 900) / F.lit(10000.0)).alias("lat")
    )


TRACKS = """tracks AS (SELECT user_id AS trip_id, ts, event_id, value, CAST(168000 + (event_id * 389) % 1200 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lon,
  CAST(510400 + (event_id * 211) % 900 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lat FROM events)"""
