"""How sources of a language differ in their terms: a tournament in which groups stay and peers come by."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import materialise, pieces, settle
from geoloom.llm.words import byte_classes, counted, split_words

#: Terms are made of letters and of everything beyond ASCII.
CLASSES = byte_classes(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
SCALE = 1_000_000_000
#: Bytes of text that are counted together; terms of a block of a vector, as a power of two; groups of a slot at most.
BLOCK, BITS, CROWD = 8 << 20, 14, 64


def term_counts(docs: DataFrame, size: int) -> DataFrame:
    """(lang, source, term, n, docs) by block of text: occurrences and documents. ``docs`` has lang, source and text without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("divergence")
        for batch in batches:
            for part in pieces(batch, 2, size, 1 << 20):
                words = split_words(part.column(2), CLASSES)
                langs, sources = part.column(0).dictionary_encode(), part.column(1).dictionary_encode()
                group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
                known = max(1, len(words.names))
                pair, place, n = counted(group[words.text] * known + words.code)
                # the first time a document has a term counts for its documents; words come text by text
                once = np.unique(words.text * known + words.code)
                in_docs = np.bincount(np.searchsorted(pair, group[once // known] * known + once % known), minlength=len(pair))
                owner = pair // known
                yield pa.record_batch(
                    [
                        langs.dictionary.take(pa.array(owner // max(1, len(sources.dictionary)))), sources.dictionary.take(pa.array(owner % max(1, len(sources.dictionary)))),
                        words.names.take(pa.array(pair % known)).cast(pa.binary()), pa.array(n.astype(np.int64)), pa.array(in_docs.astype(np.int64)),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + terms)), exact in 64 bits: three decimal digits of the quotient at a time."""
    under = np.int64(max(1, total + terms))
    left, out = counts.astype(np.int64) + 1, np.zeros(len(counts), np.int64)
    out, left = left // under, left % under
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // under, left % under
    return out + 1


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _squeeze(*columns: np.ndarray) -> bytes:
    """Integer columns as one compressed string: gaps of the first (ascending), the others by byte planes."""
    import zstandard

    gaps = np.diff(columns[0], prepend=0)
    planes = [np.ascontiguousarray(c.astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes() for c in (gaps, *columns[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _expand(raw: bytes, n: int, columns: int) -> list[np.ndarray]:
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(1, 8 * n * columns)), np.uint8).reshape(columns, 8, n)
    out = [np.ascontiguousarray(c.T).view("<i8").ravel() for c in data]
    return [np.cumsum(out[0]), *out[1:]]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of (term, n, total) as compressed vectors: ``own`` with the language's totals, ``peer`` without."""
    settle("divergence")
    for batch in batches:
        own, peer = [], []
        size = []
        for x in batch.column(5):
            term, n, total = (x.values.field(k).to_numpy() if x.is_valid else np.zeros(0, np.int64) for k in range(3))
            size.append(len(term))
            own.append(_squeeze(term, n, total))
            peer.append(_squeeze(term, n))
        yield pa.record_batch([*batch.columns[:5], pa.array(size, pa.int64()), pa.array(own, pa.binary()), pa.array(peer, pa.binary())], names=["lang", "block", "slot", "slots", "g", "size", "own", "peer"])


def _shares_of(t: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """A group's number, its slot and its shares of all terms that the block has of its language."""
    for g, slot, size, raw, words, terms, first, width in zip(*(t.column(c).to_pylist() for c in ("g", "from_slot", "size", "peer", "words", "terms", "first", "width")), strict=True):
        term, n = _expand(raw, size, 2)
        full = np.zeros(width, np.int64)
        full[term - first] = n
        yield g, slot, shares(full, words, terms)


def _meet(own: pa.Table, peers: pa.Table) -> pa.Table:
    """Meetings of a slot's groups with the peers that come by: both directions of each pair, summed over the block's terms."""
    settle("divergence")
    here, a, b, value = list(_shares_of(own)), [], [], []
    for g, slot, q in _shares_of(peers):
        for h, own_slot, p in here:
            if slot != own_slot or g < h:  # within a slot each pair once
                a += [h, g]
                b += [g, h]
                value += [int(_f(p, q).sum()), int(_f(q, p).sum())]
    lang = own.column("lang")[0].as_py() if len(own) else ""
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "g": pa.array(a, pa.int64()), "peer": pa.array(b, pa.int64()), "value": pa.array(value, pa.int64())})


def numbered(kept: DataFrame) -> DataFrame:
    """Terms in order with ``id`` from 0 without gaps, its ``block`` and the place ``at`` in it.

    Each range of the order is numbered alone and starts where those before it end, so how many blocks there are follows from the terms, not from the ranges.
    """
    apart = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("_n", F.monotonically_increasing_id())
    apart = materialise(apart.withColumn("_range", F.shiftright("_n", 33)), "ranges")
    ends = apart.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = apart.join(F.broadcast(ends.select("_range", before.alias("_start"))), "_range")
    placed = placed.withColumn("id", F.col("_start") + F.col("_n").bitwiseAND((1 << 33) - 1)).drop("_n", "_range", "_start")
    return placed.withColumn("block", F.shiftright("id", BITS)).withColumn("at", F.col("id").bitwiseAND((1 << BITS) - 1).cast("long"))


def _heaps(top: int):
    """The ``top`` terms of a group within a block by value, then by number, of those that it has more of than its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("divergence")
        for batch in batches:
            out = []
            for lang, g, block, size, raw, words, lang_words, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                term, n, total = _expand(raw, size, 3)
                p, q = shares(n, words, terms), shares(total, lang_words, terms)
                over = np.flatnonzero(p > q)
                best = heapq.nsmallest(top, zip((-_f(p[over], q[over])).tolist(), term[over].tolist(), strict=True))
                out += [(lang, g, (block << BITS) + t, -v) for v, t in best]
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["lang", "g", "term_id", "value"])

    return run


def source_divergence(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200, slots: int = 16, rounds_at_once: int = 8
) -> DataFrame:
    """How far the sources of each language are from one another, and by which terms from their language: (lang, source, part, item, value, rank).

    Terms are counted by block of text, then by group. Kept terms (in ``least_docs`` documents of their
    language) are numbered in order without gaps and cut into blocks of 16,384; a group's counts in a block
    are one compressed vector. The groups of a language sit in slots: ``slots`` of them, more where a slot would hold over 64
    groups. In each round of a round-robin tournament every slot meets one other, of which one stays and
    the other's vectors come to it, and both directions of all their pairs are summed. ``rounds_at_once`` rounds
    make one job, which bounds what travels at a time. Nothing is kept by one task but two slots' vectors of a block.
    Terms are ranked by heaps within a block, then over the blocks' winners.

    Edge cases: null texts, languages and sources are empty strings; groups without kept terms take part, as do
    languages without any (value 0); repeated rows count each; ties go to the smaller item by bytes; texts of
    any length are read whole; an empty table gives no rows. Other columns aren't looked at.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    base = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = materialise(term_counts(base, BLOCK).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = materialise(numbered(kept.select("lang", "term", "total")), "kept")
    held = materialise(counts.join(kept, ["lang", "term"]).select("lang", "source", "block", "at", "n", "total"), "held")

    blocks = kept.groupBy("lang", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("width"))  # of a language's terms in a block, which are consecutive
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_words"))
    groups = base.select("lang", "source").distinct().join(langs, "lang", "left").join(held.groupBy("lang", "source").agg(F.sum("n").alias("words")), ["lang", "source"], "left")
    by_lang = Window.partitionBy("lang")
    groups = groups.fillna(0, ["terms", "lang_words", "words"]).withColumn("g", F.row_number().over(by_lang.orderBy("source")).cast("long") - 1).withColumn("many", F.count(F.lit(1)).over(by_lang))
    wanted = F.greatest(F.least("many", F.lit(slots)), F.ceil(F.col("many") / CROWD))
    groups = groups.withColumn("slots", (wanted + wanted % 2).cast("long")).withColumn("slot", F.col("g") % F.col("slots"))
    groups = materialise(groups, "groups")

    listed = held.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("term"), "n", "total"))).alias("entries"))
    grid = groups.select("lang", "source", "slot", "slots", "g").join(blocks.select("lang", "block"), "lang").join(listed, ["lang", "source", "block"], "left")
    vectors = grid.select("lang", "block", "slot", "slots", "g", "entries").mapInArrow(_vectors, "lang string, block long, slot long, slots long, g long, size long, own binary, peer binary")
    vectors = materialise(vectors, "vectors")
    facts = groups.select("lang", "g", "words", "terms", "lang_words")
    full = vectors.join(facts, ["lang", "g"]).join(blocks, ["lang", "block"])

    columns = ["lang", "block", "g", "size", "peer", "words", "terms", "first", "width"]
    staying = full.select(*columns, F.col("slot").alias("at_slot"), F.col("slot").alias("from_slot"))
    met, most = [], groups.agg(F.max("slots")).first()[0] or 0
    odd = F.col("slots") - 1
    for start in range(-1, most - 1, rounds_at_once):
        rounds = F.sequence(F.lit(start).cast("long"), F.least(F.lit(start + rounds_at_once - 1).cast("long"), F.col("slots") - 2))
        going = full.filter(F.col("slots") - 2 >= start).withColumn("round", F.explode(rounds))
        other = F.pmod(F.col("round") - F.col("slot"), odd)
        partner = (
            F.when(F.col("round") < 0, F.col("slot"))  # a slot meets itself
            .when(F.col("slot") == odd, F.pmod(F.col("round") * F.shiftright("slots", 1), odd))
            .when(other == F.col("slot"), odd)
            .otherwise(other)
        )
        going = going.withColumn("at_slot", partner)
        travels = (F.col("round") < 0) | (((F.col("slot") + F.col("at_slot")) % 2 == 0) != (F.col("slot") < F.col("at_slot")))
        going = going.filter(travels).select(*columns, "at_slot", F.col("slot").alias("from_slot")).toDF(*columns, "at_slot", "from_slot")
        place = ["lang", "block", "at_slot"]
        sums = staying.groupBy(*place).cogroup(going.groupBy(*place)).applyInArrow(_meet, "lang string, g long, peer long, value long")
        met.append(materialise(sums.groupBy("lang", "g", "peer").agg(F.sum("value").alias("value")), "met"))  # each pair meets once
    return _ranked(groups, kept, full, met, top)


def _ranked(groups: DataFrame, kept: DataFrame, full: DataFrame, met: list[DataFrame], top: int) -> DataFrame:
    """Both parts of the report, ranked within each group."""
    names = groups.select("lang", "g", "source")
    pairs = groups.select("lang", "g", "source").join(names.select("lang", F.col("g").alias("peer"), F.col("source").alias("item")), "lang").filter("g <> peer")
    pairs = pairs.join(functools.reduce(DataFrame.union, met), ["lang", "g", "peer"], "left") if met else pairs.withColumn("value", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))

    heaps = full.filter("size > 0").select("lang", "g", "block", "size", "own", "words", "lang_words", "terms").mapInArrow(_heaps(top), "lang string, g long, term_id long, value long")
    by_term = Window.partitionBy("lang", "g").orderBy(F.col("value").desc(), "term_id")  # numbers follow the terms' bytes
    best = heaps.withColumn("rank", F.row_number().over(by_term)).filter(F.col("rank") <= top)
    terms = best.join(kept.select("lang", F.col("id").alias("term_id"), F.col("term").cast("string").alias("item")), ["lang", "term_id"]).join(names, ["lang", "g"])
    return pairs.union(terms.select("lang", "source", F.lit("term"), "item", "value", "rank"))
