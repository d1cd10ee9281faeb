"""The folder that the driver and all executors share, lineage cuts through Parquet in it, and rows dealt over all cores."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of its own only where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="geoloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/geoloom-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: cuts the lineage and gives the planner exact sizes."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores, for rows that cost much each: files of narrow rows hold millions in what the planner reads as one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def opened(uri: str):
    """The file system (Arrow's, for any scheme that it knows) and the path in it of a file that isn't a table; a bare path is a local one."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", uri))


@contextlib.contextmanager
def committed(uri: str) -> Iterator:
    """A stream to a file that appears under its name only once it is whole, so a task that fails or runs twice leaves no part of one."""
    system, path = opened(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder or ".", recursive=True)
    part = f"{folder or '.'}/_{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, path)
