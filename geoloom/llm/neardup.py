"""MinHash near-duplicates by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import WORD_PATTERN, batch_rows, materialise, settle, texts_of
from geoloom.llm.graph import components

_WORD = re.compile(WORD_PATTERN)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_M = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (xor-shift-multiply)."""
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


class Shingler:
    """Sets of 64-bit shingle hashes of whole texts; word hashes are cached per worker."""

    def __init__(self, words: int):
        self.words, self.cache = words, {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        if len(self.cache) > 150_000:
            self.cache.clear()
        cache = self.cache
        for w in set(words).difference(cache):
            cache[w] = xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; one for the whole sequence where it is shorter than a shingle."""
        words = _WORD.findall((text or "").translate(_LOWER)) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        h = self._hashes(words)
        n = max(1, len(h) - self.words + 1)
        out = np.full(n, min(self.words, len(h)), np.uint64)
        for k in range(min(self.words, len(h))):
            out = _mix(out * _M(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(out)


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """A fast similarity sketch of ``t`` coordinates.

    In round r < t each item is thrown into a random bin with value (r, hash) and a bin keeps the
    least; rounds stop once every bin is filled. Rounds t <= r < 2t send every item to bin
    r - t, so every coordinate fills for certain. Coordinates of two sets agree with probability
    equal to their Jaccard similarity, with Chernoff-type concentration.
    """
    best = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    for r in range(2 * t):
        h = _mix(items + _M((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = (h >> _M(12)) | _M(r << 52 & 0xFFFFFFFFFFFFFFFF)
        if r < t:
            np.minimum.at(best, ((h & _M(0xFFF)) * _M(t) >> _M(12)).astype(np.int64), value)
        else:
            best[r - t] = min(best[r - t], value.min())
        if best.max() != np.iinfo(np.uint64).max:
            break
    return best


def sketch_many(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The same sketches for many non-empty sets at once; a set takes part until its bins are full."""
    full = np.iinfo(np.uint64).max
    out = np.full((len(sets), t), full, np.uint64)
    if not len(sets):
        return out
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    left = np.arange(len(sets))
    for r in range(2 * t):
        h = _mix(flat + _M((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = (h >> _M(12)) | _M(r << 52)
        at = row * t + (((h & _M(0xFFF)) * _M(t) >> _M(12)).astype(np.int64) if r < t else r - t)
        np.minimum.at(out.ravel(), at, value)
        still = (out[left] == full).any(1)
        if not still.all():
            done = np.zeros(len(sets), bool)
            done[left[~still]] = True
            keep, left = ~done[row], left[still]
            flat, row = flat[keep], row[keep]
        if not len(left):
            break
    return out


def _band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates; the band's number is part of it."""
    n, t = sketches.shape
    part = sketches.reshape(n, t // rows, rows)
    key = np.broadcast_to(np.arange(1, t // rows + 1, dtype=np.uint64), (n, t // rows)).copy()
    for k in range(rows):
        key = _mix(key * _M(0x9E3779B97F4A7C15) + part[:, :, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int, coordinates: int, rows: int) -> DataFrame:
    """(id, n, set_a, set_b, bands) per text: set size, a 128-bit hash of the set, band keys."""
    id_type = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        settle("neardup")
        maker = Shingler(words)
        for batch in batches:
            for some, texts in texts_of(batch):
                sets = [maker.shingles(x) for x in texts]
                whole = [xxh3_128_intdigest(s.tobytes()) for s in sets]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = iter(_band_keys(sketch_many([sets[i] for i in full], coordinates), rows))
                signed = lambda v: v - (1 << 64) if v >> 63 else v
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, batch.column(0).type), pa.array([len(s) for s in sets], pa.int64()), pa.array([signed(x >> 64) for x in whole], pa.int64()), pa.array([signed(x & (1 << 64) - 1) for x in whole], pa.int64()), pa.array([next(keys) if len(s) else np.zeros(0, np.int64) for s in sets], pa.list_(pa.int64()))],
                    ["id", "n", "set_a", "set_b", "bands"],
                )

    return docs.mapInArrow(run, f"id {id_type}, n long, set_a long, set_b long, bands array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, items): each text's shingle set, little-endian and sorted, as one binary."""
    id_type = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("neardup")
        maker = Shingler(words)
        for batch in batches:
            for some, texts in texts_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(some, batch.column(0).type), pa.array([maker.shingles(x).tobytes() for x in texts], pa.binary())], ["id", "items"])

    return docs.mapInArrow(run, f"id {id_type}, items binary")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with ``linked``, whether their full sets have 100 * intersection >= percent
    * union. ``a`` may be a hub, and the join on it is one adaptive execution can split."""
    id_type = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("neardup")
        for batch in batches:
            linked, last, left = [], None, None
            for i in range(batch.num_rows):
                a = batch.column(2)[i].as_buffer()
                if last is None or not a.equals(last):
                    last, left = a, np.frombuffer(a, np.uint64)
                right = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                union = len(np.unique(np.concatenate([left, right])))
                linked.append(100 * (len(left) + len(right) - union) >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a"
    )
    return joined.select("a", "b", "ia", "ib").mapInArrow(run, f"a {id_type}, b {id_type}, linked boolean")


def star_links(star: DataFrame, sets: DataFrame, percent: int, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Compares members with the firsts of their buckets as far as their components may still differ.

    ``star`` holds (a, b, votes, small): the buckets that the first a and the member b share, and whether
    one of them holds those two alone. Each round takes one first per member, the one of most
    votes that is untried and in another component, so a group of like texts costs a comparison a
    member and round, however large. Pairs of small buckets, a bounded number a member, are
    compared at the end; what larger buckets leave open is for ``block_links``. Returns the
    comparisons and the components so far.
    """
    best = F.min(F.struct((-F.col("votes")).alias("rank"), "a")).alias("best")
    pick = lambda pairs: pairs.groupBy("b").agg(best).select("best.a", "b")
    tried = materialise(compared(pick(star), sets, percent), "compared")
    for turn in range(rounds):
        found = components(tried.filter("linked"))
        label = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}c"))  # noqa: E731, B023
        apart = star.join(tried.select("a", "b"), ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left")
        apart = apart.filter(F.coalesce("ac", "a") != F.coalesce("bc", "b")).select("a", "b", "votes", "small")
        open_pairs = materialise(apart, "open-pairs")
        if not open_pairs.limit(1).count():
            break
        last = turn == rounds - 1
        chosen = open_pairs.filter("small").select("a", "b") if last else pick(open_pairs)
        more = materialise(compared(chosen, sets, percent), "compared")
        tried = tried.union(more)
        if last and more.filter("linked").limit(1).count():
            found = components(tried.filter("linked"))
    return tried, found


#: Items (shingles) of one block's sets, which bounds its memory, and those from which a component has blocks of its own.
BLOCK, LARGE = 65_536, 32_768
#: Sets of one block, about: a smaller set counts as if it had its share of the items. It bounds the counts of a pair of blocks to some 10 MB.
SETS = 1_024
#: Columns of one 0/1 matrix, which bounds it to some 30 MB.
COLUMNS = 4_000


def _linked_within(left: list, right: list | None, percent: int) -> tuple[list, list]:
    """Ids and, for each, the least id it is tied to through links between two blocks (or within one).

    Blocks are lists of (id, component, items); pairs of one component need no comparing. Counting
    shared items is one product of 0/1 matrices over the items that both blocks hold.
    """
    both = left if right is None else left + right
    ids, comps = [r["id"] for r in both], np.unique([r["component"] for r in both], return_inverse=True)[1]
    sets = [np.frombuffer(r["items"], np.uint64) for r in both]
    n = np.array([len(x) for x in sets], np.int64)
    k = 0 if right is None else len(left)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    cut = int(n[:k].sum())
    if right is None:
        items, times = np.unique(flat, return_counts=True)
        items = items[times > 1]
    else:
        items = np.intersect1d(flat[:cut], flat[cut:])
    hits = []
    for at in range(0, len(items), COLUMNS):
        part = items[at : at + COLUMNS]
        pos = np.minimum(np.searchsorted(part, flat), len(part) - 1)
        ok = part[pos] == flat
        grid = np.zeros((len(sets), len(part)), np.float32)
        grid[row[ok], pos[ok]] = 1
        hits.append(grid[: k or None] @ grid[k:].T)
    shared = np.rint(sum(hits)).astype(np.int64) if hits else np.zeros((k or len(sets), len(sets) - k), np.int64)
    a, b = (n[: k or None, None], n[None, k:])
    tie = (100 * shared >= percent * (a + b - shared)) & (comps[: k or None, None] != comps[None, k:])
    x, y = np.nonzero(tie)
    y = y + k
    order = np.array(sorted(range(len(ids)), key=ids.__getitem__))
    rank = np.argsort(order)
    label = rank.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, new[x])
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != rank).tolist()
    return [ids[i] for i in moved], [ids[order[label[i]]] for i in moved]


def block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Ties (a, b) between members (key, id, component, n items) of one bucket and different components.

    A bucket's members are dealt into blocks of like total size, of ``BLOCK`` items and ``SETS`` sets at most on average, by a hash of the id, large components into
    blocks of their own; every two blocks of a bucket meet in one row, unless both belong to the
    same large component. So a bucket of any size is compared in full without a row per pair and
    without gathering it. Buckets of the same members are compared once.
    """
    id_type = dict(members.dtypes)["id"]
    print_ = F.bit_xor(F.xxhash64("id")), F.sum(F.xxhash64(F.xxhash64("id")) % F.lit(2**40)), F.count(F.lit(1))
    same_members = members.groupBy("key").agg(*[c.alias(f"p{i}") for i, c in enumerate(print_)])
    once = same_members.groupBy("p0", "p1", "p2").agg(F.min("key").alias("key")).select("key")
    members = materialise(members.join(once, "key", "left_semi"), "members")
    sizes = members.groupBy("key", "component").agg(F.sum(F.greatest("n", F.lit(max(1, BLOCK // SETS)))).alias("own"))
    part = F.when(F.col("own") >= LARGE, F.col("component"))
    sizes = materialise(sizes.select("key", "component", "own", part.alias("part")), "sizes")
    dealt = sizes.groupBy("key", "part").agg(F.ceil(F.sum("own") / F.lit(float(BLOCK))).alias("blocks"))
    same = lambda l, r: (F.col(f"{l}.key") == F.col(f"{r}.key")) & F.col(f"{l}.part").eqNullSafe(F.col(f"{r}.part"))
    plan = materialise(sizes.alias("s").join(dealt.alias("d"), same("s", "d")).select("s.key", "s.component", "s.part", "d.blocks"), "plan")
    placed = members.select("id", "component", "key").join(plan, ["key", "component"]).join(sets, "id")
    block = F.concat_ws("|", F.coalesce(F.col("part").cast("string"), F.lit("-")), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("string"))
    docs = F.collect_list(F.struct("id", "component", "items")).alias("docs")
    blocks = materialise(placed.withColumn("block", block).groupBy("key", "part", "block").agg(docs), "blocks")
    names = blocks.select("key", "part", "block")
    meets = (F.col("l.key") == F.col("r.key")) & (F.col("l.block") <= F.col("r.block"))
    pairs = names.alias("l").join(names.alias("r"), meets).filter("l.part is null or r.part is null or l.part <> r.part").select("l.key", F.col("l.block").alias("i"), F.col("r.block").alias("j"))
    side = lambda k: blocks.select("key", F.col("block").alias(k), F.col("docs").alias(f"d{k}"))
    met = pairs.join(side("i"), ["key", "i"]).join(side("j"), ["key", "j"]).select("i", "j", "di", "dj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("neardup")
        for batch in batches:
            for k in range(batch.num_rows):
                left = batch.column(2)[k].as_py()
                right = None if batch.column(0)[k].as_py() == batch.column(1)[k].as_py() else batch.column(3)[k].as_py()
                a, b = _linked_within(left, right, percent)
                kind = batch.column(2).type.value_type[0].type
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    with batch_rows(members.sparkSession, 2):
        return materialise(met.mapInArrow(run, f"a {id_type}, b {id_type}"), "block-links")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    coordinates: int = 240,
    rows: int = 6,
) -> DataFrame:
    """Groups documents linked by shingle sets with Jaccard similarity of ``percent`` or more.

    Returns the id, n_shingles, component_id (smallest id reachable) and kept (id = component_id).
    Texts with the same set are one class, represented by its smallest id. Representatives are
    sketched and banded. Members of a bucket are compared on full sets with the bucket's first, one first a
    round, as long as they may be in different components; members of a bucket that are still
    apart then meet block by block, so no two of a bucket that might join two components go
    uncompared, while a group of like texts costs a few stars and not all its pairs. With
    40 bands of 6 coordinates a pair at 0.8 shares no bucket with probability 5e-6, at 0.85
    with 1e-9; a pair at 0.1 shares one with 4e-5.

    Edge cases: null text, or text without words, has an empty set and links with nothing; null
    ids link with nothing and are dropped from groups (component_id null, not kept); rows with the
    same id are one document and must be distinct; texts of fewer words than a shingle are one
    shingle; an empty table gives no rows; other columns are ignored.
    """
    if coordinates % rows:
        raise ValueError("coordinates must be a multiple of rows")
    with batch_rows(docs.sparkSession, 200):
        return _groups(docs, id_col, text_col, words, percent, coordinates, rows)


def _groups(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, coordinates: int, rows: int) -> DataFrame:
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    marks = materialise(signatures(base, words, coordinates, rows), "signatures")
    usable = marks.filter("n > 0 and id is not null")
    classes = materialise(usable.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    heads = usable.join(classes.select("set_a", "set_b", F.col("rep").alias("id")), ["set_a", "set_b", "id"], "left_semi")
    buckets = heads.select("id", "n", F.explode("bands").alias("key"))
    first = buckets.groupBy("key").agg(F.min(F.struct("id", "n")).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = materialise(buckets.join(materialise(first, "firsts"), "key"), "buckets")
    sized = F.least("n", "first.n") * 100 >= F.greatest("n", "first.n") * percent
    star = shared.filter("id <> first.id").filter(sized).groupBy(F.col("first.id").alias("a"), F.col("id").alias("b"))
    star = materialise(star.agg(F.count(F.lit(1)).alias("votes"), (F.min("size") == 2).alias("small")), "pairs")
    involved = materialise(shared.select("id").distinct(), "involved")
    sets = materialise(shingle_sets(base.join(involved, "id", "left_semi"), words), "sets")
    tried, found = star_links(star, sets, percent)

    # Buckets whose members are still apart: their members of different components are compared.
    label = found.select(F.col("node").alias("id"), "component")
    placed = shared.filter("size > 2").join(label, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    members = placed.join(materialise(open_keys, "open-keys"), "key", "left_semi")
    extra = block_links(members, sets, percent)
    if extra.limit(1).count():
        found = components(tried.filter("linked").select("a", "b").union(extra.select("a", "b")))

    # A class takes its representative's component; one text alone in both keeps its own id.
    reach = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("reach", F.coalesce("component", "rep"))
    reach = materialise(reach.filter("copies > 1 or reach <> rep").select("set_a", "set_b", "reach"), "reach")
    own = usable.select("id", "n", "set_a", "set_b").join(reach, ["set_a", "set_b"], "left")
    alone = marks.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("own"))
    out = own.select("id", "n", F.coalesce("reach", "id").alias("own")).union(alone)
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("own").alias("component_id"), F.coalesce(F.col("own") == F.col("id"), F.lit(False)).alias("kept")
    )
