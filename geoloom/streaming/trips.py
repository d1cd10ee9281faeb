"""Consecutive cells of trips over a stream: keyed state with the last cell of each trip."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType

from geoloom.functions import grid
from geoloom.storage import new_path

_DAY_US = 86_400_000_000
#: Stands for null in whole numbers, which pandas would turn into floats.
_NONE = -(2**63)
#: Points of a bucket in a replay, about, and buckets of a partition of its state.
BUCKET_ROWS, PARTITION_BUCKETS = 65_536, 4


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def _settled(rows: pd.DataFrame, mark: int, expiry: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The points before ``mark`` whose cell is another than that of the point before, and the rows to keep: last points (``done``) and waiting ones."""
    trip = pd.factorize(rows["trip"], use_na_sentinel=False)[0]
    order = np.lexsort((rows["tie"], rows["us"], trip))
    trip, rows = trip[order], rows.iloc[order]
    us, x, y = (rows[c].to_numpy() for c in ("us", "x", "y"))
    ready = us < mark
    same = trip[1:] == trip[:-1]
    moved = lambda v: (v[1:] != v[:-1]) & (v[1:] != _NONE) & (v[:-1] != _NONE)
    first = np.concatenate([[True], ~same | (x[:-1] == _NONE) | (y[:-1] == _NONE) | moved(x) | moved(y) | (us[1:] - us[:-1] > expiry)])
    last = ready & np.concatenate([~(same & ready[1:]), [True]])
    kept = ~ready | (last & (us >= mark - expiry))
    return rows[ready & ~rows["done"].to_numpy() & first], rows[kept].assign(done=ready[kept])


def consecutive_cells(points: DataFrame, *, trip: str, order: str, tie: str, zoom: int, lateness: str, expiry_ms: int, buckets: int = 256) -> DataFrame:
    """Points with their tile, consecutive repeats of a trip removed, as a stream: trip, order, tie, x, y.

    A trip's state is its last cell and the points that wait: a point is held until the watermark passes its time, so
    points may come in any order within ``lateness`` (later ones are dropped and never move the state), and is then
    compared with the last cell in order of time. Timers in event time wake trips whose points wait while nothing new comes, and
    forget one that has been still for ``expiry_ms``; a point after such a time counts as a first one, forgotten or not.

    Trips are dealt to ``buckets`` by a hash; the trips of a bucket share one state and are worked on together as arrays, so a micro-batch
    costs a call per bucket and not one per trip. The number must stay the same for as long as a checkpoint is used.
    """
    kind = points.schema[trip].dataType
    whole = isinstance(kind, IntegralType)
    number = lambda c: F.coalesce(c.cast("long"), F.lit(_NONE))
    at = F.col(order).cast("timestamp")
    placed = points.filter(at.isNotNull()).select(
        F.pmod(F.xxhash64(trip), F.lit(buckets)).alias("bucket"), (number(F.col(trip)) if whole else F.col(trip)).alias("trip"), at.alias("at"), F.unix_micros(at).alias("us"),
        number(F.col(tie)).alias("tie"), number(grid.tile_x(F.col("lon"), zoom)).alias("x"), number(grid.tile_y(F.col("lat"), zoom)).alias("y"),
    )
    columns = ["trip", "us", "tie", "x", "y"]

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        parts = [_unpacked(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            parts += [b.loc[b["us"] >= mark, columns].assign(done=False) for b in batches]
        rows = pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)
        out = rows[:0]
        if (rows["us"] < mark).any():
            out, rows = _settled(rows, mark, expiry_ms * 1000)
        if len(rows):
            waiting = rows.loc[~rows["done"], "us"]
            wake = int(waiting.min()) // 1000 + 1 if len(waiting) else int(rows["us"].min()) // 1000 + expiry_ms + 1
            state.update((_packed(rows),))
            state.setTimeoutTimestamp(max(wake, mark // 1000 + 1))
        elif state.exists:
            state.remove()
        if len(out):
            yield out[columns]

    trip_type = "long" if whole else kind.simpleString()
    marked = placed.withWatermark("at", lateness)
    found = marked.groupBy("bucket").applyInPandasWithState(step, f"trip {trip_type}, us long, tie long, x long, y long", "rows binary", "append", GroupStateTimeout.EventTimeTimeout)
    known = lambda c: F.nullif(F.col(c), F.lit(_NONE))
    return found.select((known("trip").cast(kind) if whole else F.col("trip")).alias(trip), F.timestamp_micros("us").alias(order), known("tie").alias(tie), known("x").alias("x"), known("y").alias("y"))


def replayed_cells(spark: SparkSession, points: DataFrame, *, trip: str, order: str, tie: str, zoom: int, batches: int = 4, days_late: int = 400) -> DataFrame:
    """A bounded table of points as a stream of ``batches`` micro-batches, run to its end, and what came of it.

    Points are dealt to files in turn, so every file spans all times, and a micro-batch takes as many files as there are cores (one where points are few). Points may be
    late by ``days_late`` or, if that is more, by all the time that the table spans. A last file with one point that far after all others moves the
    watermark past them, and the batch without data that follows lets waiting trips wake. Watermarks start in 1970, so a table with older
    points runs that much later. pandas' times end in 2262, so a table of more than some 140 years is an error. Points without a time have no
    place in a stream and are left out.

    Every partition of a state costs a Python run and files in each micro-batch, with rows or not, so there are as many as the points need
    (one a core at least), and not more than ``spark.sql.shuffle.partitions``.
    """
    place = new_path(spark, "replay")
    us = F.unix_micros(F.col(order).cast("timestamp"))
    n, first, last = points.agg(F.count(F.lit(1)), F.coalesce(F.min(us), F.lit(0)), F.coalesce(F.max(us), F.lit(0))).first()
    ahead = max(0, _DAY_US - first)
    rows = points.select(trip, F.timestamp_micros(us + ahead).alias(order), F.col(tie).cast("long").alias(tie), "lon", "lat")
    days = max(days_late, (last - first) // _DAY_US + 1)
    files = min(spark.sparkContext.defaultParallelism, n // (batches * BUCKET_ROWS) + 1)
    rows.repartition(batches * files).write.parquet(f"{place}/in")
    null = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    end = spark.range(1).select(null(trip), F.timestamp_micros(F.lit(last + ahead + (days + 1) * _DAY_US)).alias(order), null(tie), null("lon"), null("lat"))
    end.coalesce(1).write.mode("append").parquet(f"{place}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{place}/in")
    stream = consecutive_cells(source, trip=trip, order=order, tie=tie, zoom=zoom, lateness=f"{days} days", expiry_ms=days * 86_400_000, buckets=n // BUCKET_ROWS + 8)
    writer = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    setting = "spark.sql.shuffle.partitions"
    asked = spark.conf.get(setting)
    try:
        spark.conf.set(setting, str(min(int(asked), max(spark.sparkContext.defaultParallelism, n // (BUCKET_ROWS * PARTITION_BUCKETS)))))
        done = writer.start()  # takes the settings along
    finally:
        spark.conf.set(setting, asked)
    done.awaitTermination()
    found = spark.read.schema(stream.schema).parquet(f"{place}/out").withColumn(order, F.timestamp_micros(F.unix_micros(order) - ahead))
    return found.filter(F.unix_micros(order) <= last)
