"""Shared helpers: a scratch folder all executors see, and lineage cuts through Parquet."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.storage import shared_folder, written

#: A word is a run of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


scratch_dir = shared_folder
materialise = written


_OWNER = ""
_CACHES: dict[str, Callable[[], None]] = {}


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Registers what empties an operator's cache in a Python worker."""
    _CACHES[owner] = clear


def settle(owner: str) -> None:
    """Called by a task's function: when a worker turns to another operator, the others' caches go back to the machine.

    Workers outlive stages; without this an executor holds what every operator of a pipeline once cached.
    """
    global _OWNER
    if _OWNER == owner:
        return
    _OWNER = owner
    for name, clear in _CACHES.items():
        if name != owner:
            clear()
    gc.collect()
    trim()


def trim() -> None:
    """Gives what is free in a Python worker's heaps back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bytes of an Arrow batch in a pipeline. Spark's own bounds (10,000 rows, 64 MB) put a whole partition of texts into one
#: batch, which executors hold outside the heap several times over, besides the worker.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the session's Arrow batches from now on, as plans run after what made them has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Bounds the rows of an Arrow batch while a plan with large rows runs."""
    with _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows):
        yield


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, size: int):
    """Bounds the bytes of an Arrow batch while a plan with both large and small rows runs."""
    with _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size):
        yield


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: int):
    before = spark.conf.get(key)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def pieces(batch: pa.RecordBatch, column: int = 1, size: int = 1_000_000, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text in ``column``, so that a few texts at a time become Python objects."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(batch: pa.RecordBatch, size: int = 1_000_000) -> Iterator[tuple[list, list]]:
    """Ids and texts (the first two columns) of a batch, some at a time."""
    for part in pieces(batch, 1, size):
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_unit(*cols, seed: str):
    """Uniform number in [0, 1) from md5 of the values and a seed: the same in any engine."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols], F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def word_count(text):
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
