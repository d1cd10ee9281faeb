"""Column roles of the tables that pass between the stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGION, FEATURE, GEOMETRY = "region_id", "feature_id", "geometry"
BOX = ("minx", "miny", "maxx", "maxy")


def need(df: DataFrame, *columns: str, role: str = "table") -> DataFrame:
    """Raises ValueError unless the columns are there; costs no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the {role} lacks {', '.join(missing)}")
    return df


def check_tables(regions: DataFrame, features: DataFrame, joint: DataFrame, region_id: str = REGION, feature_id: str = FEATURE) -> None:
    """What an embedder needs: named ids that agree between the three tables."""
    need(regions, region_id, role="regions table")
    need(features, feature_id, role="features table")
    need(joint, region_id, feature_id, role="joint table")


def drop_geometry(df: DataFrame) -> DataFrame:
    return df.drop(GEOMETRY, *BOX)


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """Opt-in check that runs a job: raises ValueError for an empty table."""
    if df.limit(1).count() == 0:
        raise ValueError(f"{what} is empty")
    return df


def with_bounds(df: DataFrame) -> DataFrame:
    """Adds minx..maxy from point columns or from WKB in ``geometry`` where they are missing."""
    if all(c in df.columns for c in BOX):
        return df
    if {"lon", "lat"} <= set(df.columns):
        return df.withColumns({"minx": F.col("lon"), "miny": F.col("lat"), "maxx": F.col("lon"), "maxy": F.col("lat")})
    need(df, GEOMETRY, role="table with geometry")
    from geoloom.functions.geometry import st_bounds

    return df.withColumn("_b", st_bounds(F.col(GEOMETRY))).select("*", "_b.*").drop("_b")


def to_regions(df: DataFrame, index_column: str | None = None) -> DataFrame:
    """A table with its index column renamed to region_id; a running number if there is none."""
    return _indexed(df, index_column, REGION)


def to_wgs84(df: DataFrame, epsg: int) -> DataFrame:
    """Points (lon, lat) or boxes of a coordinate system in degrees; unknown systems are a ValueError."""
    from geoloom.functions.crs import to_degrees

    if {"lon", "lat"} <= set(df.columns):
        df = to_degrees(df, epsg)
    if all(c in df.columns for c in BOX):
        df = to_degrees(to_degrees(df, epsg, lon="minx", lat="miny"), epsg, lon="maxx", lat="maxy")
    return df


def to_features(df: DataFrame, index_column: str | None = None) -> DataFrame:
    return _indexed(df, index_column, FEATURE)


def _indexed(df: DataFrame, index_column: str | None, name: str) -> DataFrame:
    if index_column is not None:
        need(df, index_column)
        if index_column != name:
            df = df.drop(name).withColumnRenamed(index_column, name)
        return df
    return df if name in df.columns else df.withColumn(name, F.monotonically_increasing_id())
