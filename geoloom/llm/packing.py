"""Packing token sequences to a fixed length, balanced by attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import settle, trim
from geoloom.llm.tokens import CACHED_CHUNKS, encoder, texts_of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Places documents of the given token counts in sequences; pieces (doc, start, length, sequence, offset).

    Whole multiples of the capacity fill sequences of their own. What remains of each document
    goes, largest cost first (linear * n + quadratic * n**2), to the sequence of the lowest cost
    that has room; as many sequences as the tokens need are open, and a document that fits
    nowhere whole is cut over those of lowest cost. So at most one sequence's worth is padding.
    """
    pieces, rest, sequence = [], [], 0
    for doc, n in enumerate(lengths.tolist()):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((doc, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, doc, n - n % capacity))
    rest.sort(key=lambda x: (-(linear * x[0] + quadratic * x[0] ** 2), x[1]))
    bins = -(-sum(x[0] for x in rest) // capacity)
    used, cost = np.zeros(bins, np.int64), np.zeros(bins)
    for n, doc, start in rest:
        while n:
            room = capacity - used
            fits = room >= n
            at = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, np.inf)))
            take = min(n, int(room[at]))
            pieces.append((doc, start, take, sequence + at, int(used[at])))
            used[at] += take
            cost[at] += linear * take + quadratic * take * take
            start, n = start + take, n - take
    return pieces


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    mode: str = "spaced",
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    capacity: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    group_tokens: int = 3_000_000,
    with_ids: bool = False,
    cached_chunks: int = CACHED_CHUNKS,
) -> DataFrame:
    """Tokenises every whole document and packs the ids into sequences of at most ``capacity``.

    Each task packs its documents in groups of about ``group_tokens`` tokens, in the order it
    reads them, so memory is bounded, nothing is shuffled, and a rerun of a task gives the same
    pieces; padding is below one sequence a group. ``with_ids`` adds the ids of each piece; ``cached_chunks``
    trades the tokenizer's time for a worker's memory.

    Edge cases: null or empty text is the end id alone; a null id is kept; equal rows are packed
    separately; texts of any length are cut over sequences; an empty table gives no rows; other
    columns are ignored.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    id_type = dict(docs.dtypes)[id_col]
    schema = schema.replace("doc_id long", f"doc_id {id_type}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("tokens")
        coder = encoder(tokenizer_path, mode, cached_chunks)
        end = np.array([end_id], coder.dtype)
        base, out = TaskContext.get().partitionId() << 33, None
        ids, rows, held = [], [], 0

        def flush():
            nonlocal base
            pieces = balance(np.array([len(x) for x in rows]), capacity, linear, quadratic)
            cols = [[] for _ in range(8)]
            for doc, start, n, sequence, offset in pieces:
                piece = rows[doc][start : start + n]
                crc = zlib.crc32(piece.astype("<u4").tobytes())
                for c, v in zip(cols, (ids[doc], start, n, crc, len(rows[doc]), base + sequence, offset), strict=False):
                    c.append(v)
                if with_ids:
                    cols[7].append(piece.astype(np.int32))
            base += max((x[3] for x in pieces), default=-1) + 1
            names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"]
            types = [out] + [pa.int64()] * 6 + [pa.list_(pa.int32())]
            k = 8 if with_ids else 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], types, strict=False)], names[:k])

        for batch in batches:
            out = batch.column(0).type
            for some, texts in texts_of(batch):
                for i, x in zip(some, coder.encode(texts), strict=True):
                    ids.append(i)
                    rows.append(np.concatenate([x, end]))
                    held += len(rows[-1])
                    if held >= group_tokens:
                        yield flush()
                        ids, rows, held = [], [], 0
                        trim()  # what encoding freed lies between cached chunks
        if rows:
            yield flush()

    picked = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    return picked.mapInArrow(run, schema)
