"""Exact duplicates by distributed MSD radix partitioning: texts are split byte by byte, never digested."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from geoloom.llm.common import materialise, pieces, settle

#: Bytes of the first digit, and how much wider each next one is.
FIRST, WIDER = 32, 8
#: Bytes of the texts of one group that a task splits by itself.
HELD = 16 << 20
#: Bytes of the prefixes that a round tells all tasks (the table of crowded prefixes, which is broadcast).
TOLD = 8 << 20
#: Rows below which no prefix counts as crowded.
FEW = 64


def radix_groups(texts: list[bytes], depth: int = 0) -> list[int]:
    """For each text the position of the first one equal to it; the first ``depth`` bytes are known to be equal.

    A group is split by its next digit (some bytes); a part that is alone, or whose digit is cut
    short by the end of the texts, is settled, the others are split by a wider digit.
    """
    first = list(range(len(texts)))
    groups, width = [first[:]], FIRST
    while groups:
        left = []
        for group in groups:
            parts: dict[bytes, list[int]] = {}
            for k in group:
                parts.setdefault(texts[k][depth : depth + width], []).append(k)
            for digit, part in parts.items():
                if len(part) > 1 and len(digit) < width:
                    for k in part:
                        first[k] = part[0]
                elif len(part) > 1:
                    left.append(part)
        groups, depth, width = left, depth + width, width * WIDER
    return first


def _best(ids: list, rows: list) -> int:
    """Position of the row that stays: the largest id, null below all; of equal ids the first row."""
    return max(range(len(ids)), key=lambda k: (ids[k] is not None, 0 if ids[k] is None else ids[k], -rows[k]))


def _merged(rows: list[tuple], depth: int) -> Iterator[tuple[list[tuple], tuple]]:
    """Groups of equal texts among rows (leader, best_id, best_row, size, text): members, and the row they become."""
    members: dict[int, list[tuple]] = {}
    for k, first in enumerate(radix_groups([r[4] for r in rows], depth)):
        members.setdefault(first, []).append(rows[k])
    for own in members.values():
        best = own[_best([r[1] for r in own], [r[2] for r in own])]
        yield own, (own[0][0], best[1], best[2], sum(r[3] for r in own), own[0][4])


def _local(docs: DataFrame) -> DataFrame:
    """One row per document: its leader among the equal texts of its batch; the leader's row has the text, its digest and the group's sums.

    Copies thus leave their text behind before anything is shuffled, a third of the corpus as well as a pair.
    """
    id_type = docs.schema["id"].dataType
    fields = f"id {id_type.simpleString()}, row long, leader long, sha string, best_id {id_type.simpleString()}, best_row long, size long, text binary"
    arrow_id = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("exactdedup")
        for batch in batches:
            for part in pieces(batch, 2, 16 << 20, 10_000):
                ids, rows, texts = (part.column(k).to_pylist() for k in range(3))
                first = radix_groups(texts)
                members: dict[int, list[int]] = {}
                for k, f in enumerate(first):
                    members.setdefault(f, []).append(k)
                sha, best, size, kept = ([None] * len(ids) for _ in range(4))
                for f, own in members.items():
                    digest = hashlib.sha256(texts[f]).hexdigest()
                    for k in own:
                        sha[k] = digest
                    best[f] = own[_best([ids[k] for k in own], [rows[k] for k in own])]
                    size[f], kept[f] = len(own), texts[f]
                yield pa.record_batch(
                    [
                        part.column(0), part.column(1), pa.array([rows[f] for f in first], pa.int64()), pa.array(sha, pa.string()),
                        pa.array([None if b is None else ids[b] for b in best], arrow_id), pa.array([None if b is None else rows[b] for b in best], pa.int64()),
                        pa.array(size, pa.int64()), pa.array(kept, pa.binary()),
                    ],
                    names=["id", "row", "leader", "sha", "best_id", "best_row", "size", "text"],
                )

    return docs.select("id", F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).mapInArrow(run, fields)


def _fields(id_type: T.DataType) -> str:
    """A round's rows: ``row`` goes on as ``leader``; a leader has its group's sums, and its text if its group isn't settled."""
    return f"row long, leader long, best_id {id_type.simpleString()}, best_row long, size long, text binary"


def _split(depth: int, id_type: T.DataType, most: int):
    """Splits the groups of rows that share their first ``depth`` bytes; the rows come sorted by those.

    A group is held up to ``most`` bytes. A larger one is merged piece by piece (equal texts of a
    piece become one row) and, if more than one text is left of it, goes on to the next round.
    """
    names = ["row", "leader", "best_id", "best_row", "size", "text"]
    kinds = [pa.int64(), pa.int64(), to_arrow_type(id_type), pa.int64(), pa.int64(), pa.binary()]

    def rows_of(batches):
        for batch in batches:
            for part in pieces(batch, 4, 1 << 20):
                yield from zip(*(part.column(k).to_pylist() for k in range(5)), strict=True)

    def split(group):
        held, size, crowded = [], 0, False
        for row in group:
            held.append(row)
            size += len(row[4])
            if size > most:
                merged = list(_merged(held, depth))
                yield from ((r[0], own[0][0], None, None, None, None) for own, _ in merged for r in own[1:])
                held = [row for _, row in merged]
                size = sum(len(r[4]) for r in held)
                if len(held) > 1 and size > most // 2:
                    yield from ((r[0], *r) for r in held)
                    held, size, crowded = [], 0, True
        for own, row in _merged(held, depth):
            yield from ((r[0], row[0], None, None, None, None) for r in own[1:])
            yield (row[0], *row[:4], row[4] if crowded else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("exactdedup")
        out, size = [], 0
        for _, group in itertools.groupby(rows_of(batches), key=lambda r: r[4][:depth]):
            for row in split(group):
                out.append(row)
                size += 64 + len(row[5] or b"")
                if size > 4 << 20:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _round(active: DataFrame, depth: int, id_type: T.DataType) -> DataFrame:
    """Splits all groups by their first ``depth`` bytes: rows of ``_fields``.

    Prefixes are counted first. Those with too many rows for a task (at most ``TOLD`` bytes of
    prefixes, so the broadcast is bounded) are not moved: where the texts end within the prefix they
    are all equal and an aggregate settles them, otherwise they wait for more bytes. The others are
    dealt by prefix, and each task splits its groups to the end.
    """
    prefix = F.substring("text", 1, depth)
    crowd = max(FEW, active.count() // max(1, TOLD // (depth + 32)))
    crowded = materialise(active.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > crowd).select("prefix", F.lit(True).alias("crowded")), "prefixes")
    marked = active.withColumn("prefix", prefix).join(F.broadcast(crowded), "prefix", "left")
    columns = ["row", "leader", "best_id", "best_row", "size", "text"]
    waiting = marked.filter(F.col("crowded") & (F.octet_length("text") >= depth)).select("row", F.col("row").alias("leader"), *columns[2:])
    ended = marked.filter(F.col("crowded") & (F.octet_length("text") < depth))
    order = F.struct(F.col("best_id").isNotNull().alias("has"), "best_id", (-F.col("best_row")).alias("early"))
    sums = materialise(ended.groupBy("prefix").agg(F.min("row").alias("leader"), F.max(order).alias("best"), F.sum("size").alias("sum")), "ended")
    settled = ended.select("row", "prefix").join(F.broadcast(sums), "prefix")
    at_leader = F.col("row") == F.col("leader")
    settled = settled.select(
        "row", "leader", F.when(at_leader, F.col("best.best_id")).alias("best_id"), F.when(at_leader, -F.col("best.early")).alias("best_row"),
        F.when(at_leader, F.col("sum")).alias("size"), F.lit(None).cast("binary").alias("text"),
    )
    cold = marked.filter(F.col("crowded").isNull()).select("row", *columns[2:])
    split = cold.repartition(prefix).sortWithinPartitions(prefix).mapInArrow(_split(depth, id_type, HELD), _fields(id_type))
    return split.union(waiting.select(*columns)).union(settled.select(*columns))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts: (id, keep_id, group_size, kept, text_sha256), one row per document.

    Each batch of documents merges its own copies; what is left is split by 32 bytes, then by the
    next 256, 2,048 and so on, until every group is alone or its texts have ended. Only the bytes
    decide; the digest is an output. Texts move once unless their prefix is crowded. Results
    come back along the leaders: document, leader in its batch, leader in each round.

    Edge cases: a null text equals an empty one; null ids rank below all others (``keep_id`` is null
    only where the whole group has none); of rows that repeat both text and id exactly one is kept;
    texts of any length are read whole; an empty table gives no rows. Other columns aren't looked at.
    """
    id_type = docs.schema[id_col].dataType
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    local = materialise(_local(base), "local")
    active = local.filter("text is not null").select("row", "leader", "best_id", "best_row", "size", "text")
    rounds, depth, width = [], FIRST, FIRST
    while not rounds or active.limit(1).count():
        table = materialise(_round(active, depth, id_type), "round")
        rounds.append(table)
        active = table.filter("text is not null")
        width *= WIDER
        depth += width
    value = ["best_id", "best_row", "size"]
    found = None
    for table in reversed(rounds):
        done = table.filter("size is not null and text is null")
        groups = done.select("leader", *value) if found is None else done.select("leader", *value).union(found.select(F.col("row").alias("leader"), *value))
        rest = table.filter("size is null or text is not null").select("row", "leader").join(groups, "leader")
        found = done.select("row", *value).union(rest.select("row", *value))
    groups = materialise(found.select(F.col("row").alias("leader"), *value), "groups")
    return (
        local.select("id", "row", "leader", "sha")
        .join(groups, "leader")
        .select(F.col("id").alias(id_col), F.col("best_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("best_row")).alias("kept"), F.col("sha").alias("text_sha256"))
    )
