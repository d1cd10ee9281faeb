"""Prepared datasets of points and trajectories: what each keeps, and how it is split and labelled."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.filters import in_bounds, within_quantiles
from geoloom.operators.labels import hex_labels, scale_fitted
from geoloom.operators.splits import quantile_bins, spatial_split, stratified_split, width_bins
from geoloom.operators import trajectories


@dataclass(frozen=True)
class PointSpec:
    """Columns and rules of a point dataset; ``versions`` map to grid zooms."""

    name: str
    target: str
    quantiles: tuple[float, float] | None = None
    versions: dict[str, int] = field(default_factory=lambda: {"8": 12, "9": 13, "10": 14})


AIRBNB = PointSpec("airbnb", "price", (0.05, 0.95))
KING_COUNTY = PointSpec("king_county", "price", (0.1, 0.9))
CHICAGO = PointSpec("chicago_crime", "count")
PHILADELPHIA = PointSpec("philadelphia_crime", "count")
POLICE = PointSpec("police_incidents", "count")

#: Bounds of the trips that are kept.
TRIP_LAT, TRIP_LON = (20.14, 53.55), (73.33, 135.05)


def read_splits(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """The splits of a dataset as one table with a ``split`` column."""
    out = None
    for s in splits:
        part = spark.read.parquet(f"{folder}/{s}").withColumn("split", F.lit(s))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def prepare_points(df: DataFrame, spec: PointSpec, *, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Rows with a place, as lon and lat, without the target's outliers."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    placed = df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(*rest, F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"))
    return within_quantiles(placed, F.col(spec.target), *spec.quantiles) if spec.quantiles else placed


class PointDataset:
    """A point table with a target, split by parent cells and labelled per cell."""

    def __init__(self, points: DataFrame, spec: PointSpec, version: str | None = None):
        if version is not None and version not in spec.versions:
            raise ValueError(f"{spec.name} has no version {version}")
        self.points, self.spec = points, spec
        self.zoom = spec.versions.get(version) if version else None

    def train_test_split(self, *, zoom: int | None = None, test: float = 0.2, validation: float = 0.0, bins: int = 7, seed: int | str = 0, force: bool = False) -> DataFrame:
        if "split" in self.points.columns and not force:
            raise ValueError("the dataset is split already")
        if self.zoom is not None and zoom is not None and zoom != self.zoom:
            raise ValueError("the zoom differs from the version's")
        target = None if self.spec.target == "count" else self.spec.target
        zoom = zoom if zoom is not None else self.zoom
        if zoom is None:
            raise ValueError("a zoom is needed")
        self.points = spatial_split(self.points.drop("split"), zoom=zoom, target=target, bins=bins, test=test, validation=validation, seed=seed)
        self.zoom = zoom
        return self.points

    def labels(self) -> DataFrame:
        """region_id, label and split; counts are scaled by the training cells' range."""
        if "split" not in self.points.columns:
            raise ValueError("the dataset is not split")
        counted = self.spec.target == "count"
        out = None
        for s in ("train", "validation", "test"):
            part = hex_labels(self.points.filter(F.col("split") == s), zoom=self.zoom, target=None if counted else self.spec.target).withColumn("split", F.lit(s))
            out = part if out is None else out.unionByName(part)
        return scale_fitted(out, out.filter("split = 'train'"), "label") if counted else out


class TrajectoryDataset:
    """Located, timed points of trips: cell sequences for travel time (TTE) or mobility (HMP)."""

    def __init__(self, points: DataFrame, version: str = "TTE", zoom: int = 15):
        if version not in ("TTE", "HMP"):
            raise ValueError("the version must be TTE or HMP")
        self.points, self.version, self.zoom = points, version, zoom

    def sequences(self, *, trip: str = "trip_id", order: str = "ts", tie: str | None = None, outliers: tuple[float, float] | None = (0.05, 0.95)) -> DataFrame:
        """trip, cells and duration (or x_cells and y_cells), trips of unusual length left out."""
        points = self.points
        if outliers:
            lengths = trajectories.line_lengths(points, trip=trip, order=order, tie=tie)
            points = points.join(within_quantiles(lengths, F.col("length"), *outliers).select(trip), trip, "left_semi")
        cells = trajectories.fill_gaps(trajectories.to_cells(points, trip=trip, order=order, zoom=self.zoom, tie=tie), trip=trip, order=order, tie=tie)
        seqs = trajectories.sequences(cells, trip=trip, zoom=self.zoom)
        if self.version == "HMP":
            return trajectories.mobility_task(seqs)
        span = points.groupBy(trip).agg(F.min(order).alias("_a"), F.max(order).alias("_b"))
        us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        timed = seqs.join(span, trip).withColumn("duration", (us("_b") - us("_a")) / 1e6).drop("_a", "_b")
        return trajectories.travel_time_task(timed)

    def train_test_split(self, sequences: DataFrame, *, trip: str = "trip_id", test: float = 0.2, bins: int = 4, seed: int | str = 0) -> DataFrame:
        """Stratified by duration (TTE) or by sequence length (HMP), in equal-width bins."""
        value = F.col("duration") if self.version == "TTE" else (F.size("x_cells") + F.size("y_cells")).cast("double")
        binned = width_bins(sequences.withColumn("_v", value), "_v", bins, "_bin")
        return stratified_split(binned, trip, "_bin", test=test, seed=seed).drop("_v", "_bin")


def in_trip_bounds(points: DataFrame) -> DataFrame:
    return in_bounds(points, TRIP_LON, TRIP_LAT)


__all__ = ["AIRBNB", "CHICAGO", "KING_COUNTY", "PHILADELPHIA", "POLICE", "PointDataset", "PointSpec", "TrajectoryDataset", "in_trip_bounds", "prepare_points", "quantile_bins", "read_splits"]
