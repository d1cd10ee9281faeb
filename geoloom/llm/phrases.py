"""Phrases whose words stand together more often than chance has it, mined by sorted runs of packed word numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import batch_bytes, materialise, pieces, settle
from geoloom.llm.words import byte_classes, counted, split_words

#: Words end at spaces and tabs, pieces at marks and line ends.
CLASSES = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Bytes of text that are coded together.
BLOCK = 4 << 20
#: Keys that a task holds before it merges them.
HELD = 1_000_000


def coded_blocks(docs: DataFrame, size: int) -> DataFrame:
    """Blocks of texts as words of a dictionary of their own: rows of (block, lang, word, local, n) and, once a block, (block, stream).

    A stream is the words' local numbers, doubled, plus one where a piece begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("phrases")
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in pieces(batch, 1, size, 1 << 20):
                words = split_words(part.column(1), CLASSES)
                langs = part.column(0).dictionary_encode()
                known = max(1, len(words.names))
                pair, place, n = counted(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.text] * known + words.code)
                stream = (place * 2 + words.fresh).astype(np.uint32)
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(pair), block)), langs.dictionary.take(pa.array(pair // known)), words.names.take(pa.array(pair % known)).cast(pa.binary()),
                        pa.array(np.arange(len(pair))), pa.array(n.astype(np.int64)), pa.nulls(len(pair), pa.binary()),
                    ],
                    names=["block", "lang", "word", "local", "n", "stream"],
                )
                yield pa.record_batch(
                    [pa.array([block]), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([stream.tobytes()], pa.binary())],
                    names=["block", "lang", "word", "local", "n", "stream"],
                )
                block += 1

    return docs.mapInArrow(run, "block long, lang string, word binary, local long, n long, stream binary")


def dictionary(counts: DataFrame, least: int) -> DataFrame:
    """Words that occur ``least`` times, numbered from 1 without gaps: (lang, word, f, word_id, before), ``before`` the occurrences of lower numbers.

    Numbers and sums start anew in each file and are put together by one row per file.
    """
    kept = materialise(counts.filter(F.col("f") >= least).select("lang", "word", "f", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "dictionary")
    per_part = kept.groupBy("part").agg(F.count(F.lit(1)).alias("words"), F.sum("f").alias("sum"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    per_part = per_part.select("part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("id_from"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("sum_from"))
    within = Window.partitionBy("part").orderBy("row")
    own = kept.withColumn("k", F.row_number().over(within)).withColumn("s", F.coalesce(F.sum("f").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(per_part, "part").select("lang", "word", "f", (F.col("id_from") + F.col("k")).alias("word_id"), (F.col("sum_from") + F.col("s")).alias("before"))


def _pack(ids: np.ndarray, width: int) -> np.ndarray:
    """Rows of word numbers as big-endian keys of ``width`` bytes a word: (n, words * width) bytes."""
    wide = ids.astype(">u8").view(np.uint8).reshape(len(ids), ids.shape[1], 8)
    return np.ascontiguousarray(wide[:, :, 8 - width :]).reshape(len(ids), -1)


def _unpack(keys: np.ndarray, width: int) -> np.ndarray:
    wide = np.zeros((len(keys), keys.shape[1] // width, 8), np.uint8)
    wide[:, :, 8 - width :] = keys.reshape(len(keys), -1, width)
    return wide.view(">u8")[:, :, 0].astype(np.int64)


def radix_sorted(keys: np.ndarray, counts: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct keys in byte order with their counts added up: a radix sort by digits of two bytes, then run lengths.

    ``part`` belongs to the key and goes with it.
    """
    n, width = keys.shape
    if not n:
        return (keys, counts) if part is None else (keys, counts, part)
    digits = np.zeros((n, width + width % 2), np.uint8)
    digits[:, width % 2 :] = keys
    digits = digits.view(">u2").astype(np.uint16)
    order = np.argsort(digits[:, -1], kind="stable")
    for k in range(digits.shape[1] - 2, -1, -1):
        order = order[np.argsort(digits[order, k], kind="stable")]
    digits = digits[order]
    runs = np.flatnonzero(np.concatenate([[True], (digits[1:] != digits[:-1]).any(1)]))
    first, sums = order[runs], np.add.reduceat(counts[order], runs, dtype=np.int64)
    return (keys[first], sums) if part is None else (keys[first], sums, part[first])


def _grams(width: int, ranges: int, total: int, most: int):
    """Keys of three words (the third 0 where the piece breaks) with counts, cut at range bounds.

    Range bounds follow from the dictionary alone: a key goes to the part of [0, total) that its
    first word's occurrences cover, and within it by its second word. So the ranges ascend with
    the keys, a frequent first word spans many of them, and no pair of words is in two.
    """

    def cut(held: list[tuple]) -> pa.RecordBatch:
        keys, counts, part = radix_sorted(*(np.concatenate(c) for c in zip(*held, strict=True)))
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(cuts[1:], len(part))
        return pa.record_batch(
            [
                pa.array(part[cuts]),
                pa.array([np.ascontiguousarray(keys[a:b].T).tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                pa.array([counts[a:b].astype(np.int64).tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
            ],
            names=["part", "keys", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("phrases")
        held: list[tuple] = []
        for batch in batches:
            for local, known, before, f, stream in zip(*(batch.column(k) for k in range(5)), strict=True):
                codes = np.frombuffer(stream.as_buffer(), np.uint32)
                fresh, place = (codes & 1).astype(bool), (codes >> 1).astype(np.int32)
                ids, low, span, share = np.zeros((4, int(place.max()) + 1))
                own, start, length = local.values.to_numpy(), before.values.to_numpy() / total, f.values.to_numpy() / total
                ids[own], share[own], low[own] = known.values.to_numpy(), start, np.floor(start * ranges)
                span[own] = np.floor((start + length) * ranges) - low[own] + 1
                x = ids[place].astype(np.int64)
                y = np.append(np.where(fresh[1:], 0, x[1:]), 0)
                z = np.where(y > 0, np.append(y[1:], 0), 0)
                at = np.flatnonzero((x > 0) & (y > 0))
                first, second = place[at], place[np.minimum(at + 1, len(place) - 1)]
                part = np.minimum(low[first] + np.floor(share[second] * span[first]), ranges - 1).astype(np.int32)
                if len(at):
                    keys = _pack(np.stack([x[at], y[at], z[at]], 1), width)
                    del x, y, z, codes, fresh, place, first, second
                    held.append(radix_sorted(keys, np.ones(len(at), np.int32), part))
                if sum(len(h[0]) for h in held) >= most:
                    yield cut(held)
                    held = []
        if held:
            yield cut(held)

    return run


def _runs(width: int, least: int, most: int):
    """Merges the runs of each range: phrases of two (third word 0) and three words that occur ``least`` times."""

    def settled(keys: np.ndarray, counts: np.ndarray) -> list[pa.RecordBatch]:
        if not len(keys):
            return []
        ids = _unpack(keys, width)
        pair = np.flatnonzero(np.concatenate([[True], (ids[1:, :2] != ids[:-1, :2]).any(1)]))
        sums = np.add.reduceat(counts, pair)
        two, three = pair[sums >= least], (counts >= least) & (ids[:, 2] > 0)
        out = np.concatenate([np.column_stack([ids[two, :2], np.zeros(len(two), np.int64), sums[sums >= least]]), np.column_stack([ids[three], counts[three]])])
        return [pa.record_batch([pa.array(out[:, k]) for k in range(4)], names=["x", "y", "z", "a"])] if len(out) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("phrases")
        now, keys, counts, size = None, [], [], 0
        for batch in batches:
            for part, raw, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if part != now or size > most:
                    merged = radix_sorted(np.concatenate(keys), np.concatenate(counts)) if keys else None
                    if part != now:
                        yield from settled(*merged) if merged else []
                        merged, now = None, part
                    keys, counts, size = ([merged[0]], [merged[1]], 0) if merged else ([], [], 0)
                n = np.frombuffer(n.as_buffer(), np.int64)
                keys.append(np.frombuffer(raw.as_buffer(), np.uint8).reshape(3 * width, len(n)).T)
                counts.append(n)
                size += len(n)
        if keys:
            yield from settled(*radix_sorted(np.concatenate(keys), np.concatenate(counts)))

    return run


def _best_cut(a, cuts: list[tuple]):
    """The struct (score, k, l, r) of the cut with the lowest score, the first of equals.

    Squares and products are decimals of 38 digits, so 64 bits may be passed; the quotient is floored exactly.
    """
    wide = lambda c: c.cast("decimal(18,0)")
    scored = []
    for k, (left, right) in enumerate(cuts, 1):
        top = (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
        under = wide(left) * wide(right)
        scored.append(F.struct(F.call_function("div", top.cast("decimal(38,0)"), under.cast("decimal(38,0)")).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.least(*scored) if len(scored) > 1 else scored[0]


def collocations(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 10, absorb: int = 50, top: int = 2000, salts: int = 64
) -> DataFrame:
    """The ``top`` phrases of two or three words of each language: (lang, rank, phrase, a, l, r, n, score).

    A phrase with a >= ``least`` occurrences within pieces scores floor(1000000 a^2 / (l r)) at its
    lowest cut into a first part (l occurrences) and a rest (r). A phrase inside a longer
    candidate with at least ``absorb`` percent of its occurrences is dropped. Ranks go by score, then a, both
    descending, then by the phrase's bytes.

    Blocks of texts are coded once with dictionaries of their own and written. The words of all blocks are
    counted, frequent ones numbered, and each block gets its own words' numbers back, so no task
    holds the whole dictionary. Rarer words break pieces, as no frequent phrase holds one. Keys of three
    numbers are sorted and counted within a task, dealt by ranges that the words' counts bound, and merged.

    Edge cases: null texts are empty, a null language is ``und``; texts without words count nothing;
    repeated rows count each; ties are broken to the end by the phrase; texts of any length are read whole;
    an empty table gives no rows. Other columns aren't looked at.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    blocks = materialise(coded_blocks(base, BLOCK), "blocks")
    own_words = blocks.filter("stream is null").select("block", "lang", "word", "local", "n")
    counts = materialise(own_words.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = materialise(dictionary(counts, least), "numbers")
    size, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("f"), F.lit(0))).first()
    width, ranges = max(1, (int(size).bit_length() + 7) // 8), int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = own_words.join(words, ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("local", "word_id", "before", "f")).alias("m"))
    lists = known.select("block", *[F.col(f"m.{c}").alias(c) for c in ("local", "word_id", "before", "f")])
    coded = lists.join(blocks.filter("stream is not null").select("block", "stream"), "block")
    with batch_bytes(spark, 4 << 20):
        grams = coded.select("local", "word_id", "before", "f", "stream").mapInArrow(_grams(width, ranges, max(1, int(total)), HELD), "part int, keys binary, counts binary")
        found = materialise(grams.repartitionById(ranges, "part").sortWithinPartitions("part").mapInArrow(_runs(width, least, HELD), "x long, y long, z long, a long"), "grams")
    two, three = found.filter("z = 0").select("x", "y", "a"), found.filter("z > 0")
    named = lambda c: words.select(F.col("word_id").alias(c), F.col("lang").alias(f"lang_{c}"), F.col("word").cast("string").alias(f"word_{c}"), F.col("f").alias(f"f_{c}"))
    head = two.select("x", "y", F.col("a").alias("l"))
    tail = two.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("r"))
    longer = three.select("x", "y", "a").union(three.select(F.col("y").alias("x"), F.col("z").alias("y"), "a")).groupBy("x", "y").agg(F.max("a").alias("longer"))
    short = (
        two.join(longer, ["x", "y"], "left").filter(F.coalesce(100 * F.col("longer") < absorb * F.col("a"), F.lit(True)))
        .join(named("x"), "x").join(named("y"), "y")
        .select(F.col("lang_x").alias("lang"), F.concat_ws(" ", "word_x", "word_y").alias("phrase"), "a", _best_cut(F.col("a"), [(F.col("f_x"), F.col("f_y"))]).alias("cut"))
    )
    long = (
        three.join(head, ["x", "y"]).join(tail, ["y", "z"]).join(named("x"), "x").join(named("y"), "y").join(named("z"), "z")
        .select(F.col("lang_x").alias("lang"), F.concat_ws(" ", "word_x", "word_y", "word_z").alias("phrase"), "a",
                _best_cut(F.col("a"), [(F.col("f_x"), F.col("r")), (F.col("l"), F.col("f_z"))]).alias("cut"))
    )
    ranked = short.union(long).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(salts)).alias("salt"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
