"""Labels of regions and scalers fitted on one table and applied to another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import grid, h3


def hex_labels(points: DataFrame, *, zoom: int | None = None, resolution: int | None = None, target: str | None = None) -> DataFrame:
    """Points per cell, or the mean of a target: region_id, label. Cells without points don't appear.

    Cells are H3 cells of a resolution or map tiles of a zoom.
    """
    if (zoom is None) == (resolution is None):
        raise ValueError("either a zoom or a resolution is needed")
    lon, lat = F.col("lon"), F.col("lat")
    cell = grid.tile_of(lon, lat, zoom) if zoom is not None else h3.h3_text(h3.h3_cell(lon, lat, resolution))
    value = F.count(F.lit(1)) if target in (None, "count") else F.avg(target)
    return points.withColumn("region_id", cell).groupBy("region_id").agg(value.cast("double").alias("label"))


def scale_fitted(df: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """Min-max scaling by the training table's range, clipped to [0, 1]."""
    limits = train.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    scaled = F.try_divide(F.col(column).cast("double") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return df.crossJoin(F.broadcast(limits)).withColumn(column, F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_lo", "_hi")
