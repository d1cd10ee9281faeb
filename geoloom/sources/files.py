"""Files: GeoParquet, trajectory logs, CSV to Parquet, downloads."""

from __future__ import annotations

import logging
import urllib.request
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.geometry import Geometry
from geoloom.operators.filters import within_quantiles
from geoloom.operators.spatial_join import clip, clip_to
from geoloom.schema import BOX, FEATURE, GEOMETRY, need, to_features
from geoloom.storage import committed, opened, spread

log = logging.getLogger(__name__)


def read_geoparquet(spark: SparkSession, path: str, *, index_column: str | None = None, columns: Sequence[str] | None = None, area: tuple[float, float, float, float] | Geometry | None = None) -> DataFrame:
    """A features table from Parquet with WKB in ``geometry``.

    Only the asked columns are read. With an area (minx, miny, maxx, maxy), stored box columns are
    compared first, so row groups outside are skipped, and geometries are cut to it; an area can also be a polygon.
    """
    df = spark.read.parquet(path)
    if index_column is not None:
        need(df, index_column, role="file")
    if columns is not None:
        boxes = [c for c in BOX if c in df.columns]
        df = df.select(*dict.fromkeys([*([index_column] if index_column else []), *columns, GEOMETRY, *boxes]))
    df = to_features(df, index_column)
    if area is None:
        return df
    return clip_to(df, area) if isinstance(area[0], str) else clip(df, *area)


def write_geoparquet(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "errorifexists", in_order: bool = True, row_group_bytes: int = 16 << 20) -> str:
    """Features as zstd Parquet; box columns give row groups the statistics that area filters use.

    Rows are dealt by ranges of a Hilbert curve through their boxes' middles and sorted along it, so a row group holds neighbours and an
    area meets few of them. ``in_order`` off leaves rows where they are.
    """
    from geoloom.functions.grid import hilbert
    from geoloom.schema import with_bounds

    rows = with_bounds(df)
    if in_order:
        near = hilbert((F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2, 24)
        rows = rows.withColumn("_h", near).repartitionByRange(*partition_by, "_h").sortWithinPartitions(*partition_by, "_h").drop("_h")
    rows.write.mode(mode).option("compression", "zstd").option("parquet.block.size", row_group_bytes).partitionBy(*partition_by).parquet(path)
    return path


def csv_to_parquet(spark: SparkSession, source: str, target: str, *, schema: str | None = None, where: str | None = None) -> DataFrame:
    """CSV once turned into zstd Parquet; later calls read the Parquet."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(source)
        (df.filter(where) if where else df).write.option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)


def read_plt(spark: SparkSession, root: str) -> DataFrame:
    """Trajectory logs ``<root>/<user>/Trajectory/<trip>.plt``: user_id, trip_id, ts, lon, lat, altitude.

    Six header lines are dropped by their shape: a data line has seven comma-separated fields. Logs are many and small, so the driver doesn't list
    them: one task names the users' folders, and those are dealt to tasks that list and read them.
    """
    lines = _log_lines(spark, root)
    f = F.split("value", ",")
    rows = lines.filter(F.size(f) == 7).filter(f[0].try_cast("double").isNotNull() & f[5].rlike(r"^\d{4}-\d\d-\d\d$"))
    return rows.select(
        F.regexp_extract("path", r"([^/]+)/Trajectory/[^/]+\.plt$", 1).alias("user_id"),
        F.concat_ws("_", F.regexp_extract("path", r"([^/]+)/Trajectory/", 1), F.regexp_extract("path", r"([^/]+)\.plt$", 1)).alias("trip_id"),
        F.concat_ws(" ", f[5], F.trim(f[6])).try_cast("timestamp_ntz").alias("ts"),
        f[1].cast("double").alias("lon"),
        f[0].cast("double").alias("lat"),
        f[3].cast("double").alias("altitude"),
    )


def _log_lines(spark: SparkSession, root: str) -> DataFrame:
    """The lines of all logs (value) with their files' paths; through Spark's own reader where Arrow knows no file system for ``root``."""
    try:
        opened(root)
    except (ValueError, OSError):
        return spark.read.text(f"{root}/*/Trajectory/*.plt").select("value", F.col("_metadata.file_path").alias("path"))

    def users(batches):
        import pandas as pd
        from pyarrow import fs

        for b in batches:
            system, place = opened(root)
            found = [f.path for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.Directory] if len(b) else []
            for k in range(0, len(found), 10_000):
                yield pd.DataFrame({"folder": found[k : k + 10_000]})

    def read(batches):
        import pandas as pd
        from pyarrow import fs

        system, _ = opened(root)
        values, paths = [], []
        for b in batches:
            for folder in b["folder"]:
                for f in system.get_file_info(fs.FileSelector(f"{folder}/Trajectory", allow_not_found=True)):
                    if f.type != fs.FileType.File or not f.base_name.endswith(".plt") or f.base_name.startswith(("_", ".")):
                        continue
                    with system.open_input_file(f.path) as log_file:
                        got = log_file.read().splitlines()
                    for k in range(0, len(got), 50_000):
                        values += [v.decode("utf-8", "replace") for v in got[k : k + 50_000]]
                        paths += [f.path] * (len(values) - len(paths))
                        if len(values) >= 20_000:
                            yield pd.DataFrame({"value": values, "path": paths})
                            values, paths = [], []
        if values:
            yield pd.DataFrame({"value": values, "path": paths})

    folders = spark.range(0, 1, 1, 1).mapInPandas(users, "folder string")
    return spread(folders).mapInPandas(read, "value string, path string")


def quantile_filtered(spark: SparkSession, paths: Sequence[str], column: str, target: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Several Parquet files as one, its outliers removed, written with zstd and read again."""
    within_quantiles(spark.read.parquet(*paths), F.col(column), low, high).write.option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)


def download_file(url: str, path: str, *, chunk_bytes: int = 1 << 16, force: bool = True, opener=urllib.request.urlopen) -> str:
    """Fetches a URL to a file in chunks; an existing file stays, with a warning, unless forced."""
    system, place = opened(path)
    if system.get_file_info(place).is_file and not force:
        log.warning("%s exists and is kept", path)
        return path
    with opener(url) as response, committed(path) as out:
        while chunk := response.read(chunk_bytes):
            out.write(chunk)
    return path


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raises EmptyDataError for a table without rows; runs one small job."""
    from geoloom.errors import EmptyDataError

    if not df.limit(1).count():
        raise EmptyDataError(f"{what} holds no {FEATURE}")
    return df
