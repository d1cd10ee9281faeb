"""Embeddings: near-duplicates by an epsilon grid order join, exact top-k by M-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import batch_bytes, batch_rows, hash_unit, materialise
from geoloom.llm.graph import components

_FINITE = "v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"


#: What takes part in links.
_LINKS = f"id is not null and {_FINITE} and exists(v, x -> x <> 0)"


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows whose vector is whole and finite; v keeps its element type."""
    return rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).filter(_FINITE)


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Lists of one length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


# --- Epsilon grid order ----------------------------------------------------------------------


def principal_axes(vectors: DataFrame, axes: int, sample: int) -> dict[int, np.ndarray]:
    """Leading principal axes per dimension, from at most ``sample`` vectors drawn by hash.

    They only order and separate intervals; any orthonormal axes give the same links.
    """
    n = vectors.count()
    picked = vectors.filter(hash_unit(F.col("id"), seed="axes") < min(1.0, sample / max(n, 1))).limit(2 * sample)
    by_dim: dict[int, list] = {}
    for r in picked.select("v").toLocalIterator():
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for d, rows in by_dim.items():
        x = _unit(np.array(rows, np.float64))
        _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
        out[d] = vt[:axes].T
    return out


def interval_pairs(boxes: DataFrame, eps: float, fan: int = 64) -> DataFrame:
    """Pairs (i <= j) of intervals whose boxes are within eps, from (block, d, lo, hi) in sequence order.

    Up to ``fan`` neighbours in the sequence share a box on the level above, up to one box. From
    there pairs of boxes that are near enough are replaced by pairs of what they hold, level by
    level, with equality joins on the parents; a pair of distant boxes takes all below it away.
    """
    axes = boxes.select(F.size("lo").alias("n")).first()
    if axes is None:
        return boxes.select(F.col("block").alias("i"), F.col("block").alias("j"))
    least = lambda c, f: F.array(*[f(F.get(c, F.lit(k))) for k in range(axes["n"])]).alias(c)
    level = boxes.select("d", F.shiftright("block", 32).alias("p"), F.col("block").bitwiseAND((1 << 32) - 1).alias("q"), "lo", "hi")
    most = level.agg(F.max("p").alias("p"), F.max("q").alias("q")).first()
    p, q, levels = most["p"], most["q"], []
    while p or q:
        up = {"pp": F.col("p"), "pq": F.floor(F.col("q") / fan)} if q else {"pp": F.floor(F.col("p") / fan), "pq": F.lit(0)}
        p, q = (p, q // fan) if q else (p // fan, 0)
        level = level.withColumns({c: v.cast("long") for c, v in up.items()})
        levels.append(level)
        level = materialise(level.groupBy("d", F.col("pp").alias("p"), F.col("pq").alias("q")).agg(least("lo", F.min), least("hi", F.max)), "boxes")
    pairs = level.select("d", F.col("p").alias("ap"), F.col("q").alias("aq"), F.col("p").alias("bp"), F.col("q").alias("bq"))
    apart = lambda x, y: F.zip_with(F.col(x), F.col(y), lambda u, v: u.cast("double") - v)
    wide = F.zip_with(apart("alo", "bhi"), apart("blo", "ahi"), lambda u, v: F.pow(F.greatest(u, v, F.lit(0.0)), F.lit(2.0)))
    near = F.aggregate(wide, F.lit(0.0), lambda t, x: t + x) <= (eps + 1e-6) ** 2  # coordinates are of single precision
    for level in reversed(levels):
        side = lambda s: level.select("d", F.col("pp").alias(f"{s}p"), F.col("pq").alias(f"{s}q"), F.struct("p", "q").alias(s), F.col("lo").alias(f"{s}lo"), F.col("hi").alias(f"{s}hi"))  # noqa: E731, B023
        met = pairs.join(side("a"), ["d", "ap", "aq"]).join(side("b"), ["d", "bp", "bq"]).filter("a <= b").filter(near)
        pairs = materialise(met.select("d", F.col("a.p").alias("ap"), F.col("a.q").alias("aq"), F.col("b.p").alias("bp"), F.col("b.q").alias("bq")), "near-boxes")
    block = lambda s: (F.shiftleft(f"{s}p", 32) + F.col(f"{s}q"))
    return pairs.select(block("a").alias("i"), block("b").alias("j"))


def link_block(xa: np.ndarray, xb: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= least; within xa, unordered and without itself, if xb is None.

    Single precision finds candidates; whatever is near the threshold is judged in double.
    """
    ua, slack = _unit(xa), 1e-4
    ub = ua if xb is None else _unit(xb)
    s = ua.astype(np.float32) @ ub.astype(np.float32).T
    if xb is None:
        s[np.tril_indices(len(s))] = -2
    r, c = np.nonzero(s >= least - slack)
    near = s[r, c] < least + slack
    ok = ~near
    if near.any():
        ok[near] = (ua[r[near]] * ub[c[near]]).sum(1) >= least
    return r[ok], c[ok]


def _least_reachable(labels: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Smallest label in each local component."""
    while True:
        new = labels.copy()
        np.minimum.at(new, r, labels[c])
        np.minimum.at(new, c, new[r])
        if (new == labels).all():
            return labels
        labels = new


def epsilon_grid_join(
    rows: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = 0.9,
    axes: int = 12,
    grid_axes: int = 4,
    interval: int = 2048,
    sample: int = 4096,
) -> DataFrame:
    """Near-duplicate vectors: the id, n_links, component_id and kept (id = component_id).

    Cosine >= least means a distance of at most eps = sqrt(2 - 2 * least) between unit vectors,
    and projections on orthonormal axes only shrink distances. Vectors are put in epsilon grid
    order on the leading principal axes by a range exchange and cut into intervals; intervals
    whose boxes are farther apart than eps are skipped, recursively, and the rest meet in pairs.
    Equal vectors are one class with a multiplicity; a pair of intervals returns counts and local
    components, never the links themselves. Boxes stay a table, with boxes of boxes above them.

    Edge cases: vectors that are null, zero or hold null or non-finite components have no links
    and are their own component; vectors of different lengths don't link; rows with equal ids
    are vectors of their own, whether equal or not, each with its own links and component; null ids have no links and are not kept;
    an empty table gives no rows; other columns are ignored.
    """
    spark, eps = rows.sparkSession, float(np.sqrt(2 - 2 * least)) + 1e-9
    id_type = dict(rows.dtypes)[id_col]
    good = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).filter(_LINKS)
    keyed = good.select("id", "v", F.xxhash64(F.lit(1), "v").alias("k1"), F.xxhash64(F.lit(2), "v").alias("k2"))
    named = keyed.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
    classes = materialise(named.withColumn("rep", F.monotonically_increasing_id()), "classes")
    base = principal_axes(classes.select(F.col("rep").alias("id"), "v"), axes, sample)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                part = batch.take(pa.array(np.nonzero(dims == d)[0]))
                x = _matrix(part.column(2))
                y = _unit(x) @ base[d] if d in base else _unit(x)[:, :axes]
                out = np.zeros((len(x), axes))
                out[:, : y.shape[1]] = y
                cells = np.floor(out[:, :grid_axes] / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([d] * len(x), pa.int32()), *[pa.array(c) for c in cells.T], pa.array(list(out.astype(np.float32)), pa.list_(pa.float32())), pa.array([r.tobytes() for r in x], pa.binary())],
                    ["rep", "m", "d", *[f"c{k}" for k in range(grid_axes)], "y", "x"],
                )

    cells = [f"c{k}" for k in range(grid_axes)]
    placed = classes.select("rep", "m", "v").mapInArrow(place, f"rep long, m long, d int, {', '.join(f'{c} int' for c in cells)}, y array<float>, x binary")
    ordered = placed.repartitionByRange("d", *cells, "rep").sortWithinPartitions("d", *cells, "rep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId() << 32, 0, None

        def flush(t: pa.Table):
            y = np.array(t["y"].to_pylist(), np.float32)
            ids = t["rep"].combine_chunks()
            return pa.RecordBatch.from_arrays(
                [pa.array([part + seq], pa.int64()), pa.array([t["d"][0].as_py()], pa.int32()), pa.array([y.min(0).tolist()], pa.list_(pa.float32())), pa.array([y.max(0).tolist()], pa.list_(pa.float32())), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([t["m"].to_pylist()], pa.list_(pa.int64())), pa.array([b"".join(t["x"].to_pylist())], pa.binary())],
                ["block", "d", "lo", "hi", "reps", "ms", "x"],
            )

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows:
                d = held["d"].to_numpy()
                n = min(interval, int((d == d[0]).sum()))
                if n == held.num_rows and n < interval:
                    break
                yield flush(held.slice(0, n))
                seq, held = seq + 1, held.slice(n)
        if held is not None and held.num_rows:
            yield flush(held)

    blocks = ordered.mapInArrow(cut, f"block long, d int, lo array<float>, hi array<float>, reps array<long>, ms array<long>, x binary")
    blocks = materialise(blocks, "intervals")
    pairs = interval_pairs(blocks.select("block", "d", "lo", "hi"), eps)
    left, right = (blocks.select(F.col("block").alias(k), F.col("d").alias(f"d{k}"), F.col("reps").alias(f"r{k}"), F.col("ms").alias(f"m{k}"), F.col("x").alias(f"x{k}")) for k in "ij")
    met = pairs.join(left, "i").join(right, "j").select("i", "j", "di", "ri", "mi", "xi", "rj", "mj", "xj")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, d = (batch.column(c)[k].as_py() for c in range(3))
                get = lambda c: batch.column(c)[k].values.to_numpy(zero_copy_only=False)
                ra, ma, rb, mb = get(3), get(4), get(6), get(7)
                xa = np.frombuffer(batch.column(5)[k].as_buffer(), np.float64).reshape(-1, d)
                xb = None if i == j else np.frombuffer(batch.column(8)[k].as_buffer(), np.float64).reshape(-1, d)
                r, c = link_block(xa, xb, least)
                reps, ms = (ra, ma) if xb is None else (np.concatenate([ra, rb]), np.concatenate([ma, mb]))
                if xb is not None:
                    c = c + len(ra)
                n = np.bincount(r, ms[c], len(reps)) + np.bincount(c, ms[r], len(reps))
                hit = np.nonzero(n > 0)[0]
                low = _least_reachable(reps, r, c)
                yield pa.RecordBatch.from_arrays([pa.array(reps[hit], batch.column(3).type.value_type), pa.array(n[hit].astype(np.int64)), pa.array(low[hit], batch.column(3).type.value_type)], ["rep", "n", "low"])

    with batch_rows(spark, 8):
        part = materialise(met.mapInArrow(link, "rep long, n long, low long"), "links")
    counted = part.groupBy("rep").agg(F.sum("n").alias("n"))
    found = components(part.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    per_class = (
        classes.select("k1", "k2", "rep", "least", "m")
        .join(counted, "rep", "left")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", "least", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "rep").alias("part"))
    )
    lowest = per_class.groupBy("part").agg(F.min("least").alias("component"))
    linked = keyed.select("id", "k1", "k2").join(per_class.join(lowest, "part").select("k1", "k2", "n", "component"), ["k1", "k2"]).select("id", "n", "component")
    alone = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).filter(f"not coalesce({_LINKS}, false)")
    everyone = linked.unionByName(alone.select("id", F.lit(None).cast("long").alias("n"), F.lit(None).cast(id_type).alias("component")))
    own = F.coalesce("component", "id")
    return everyone.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(False)).alias("kept")
    )


# --- M-tree ----------------------------------------------------------------------------------


class MTree:
    """A paged metric tree over integer vectors, for the largest inner products.

    An extra coordinate sqrt(M - |x|^2), M the largest squared norm, gives all vectors one norm,
    so that the largest inner products with a query are the smallest distances to (q, 0). Every
    page stores, per entry, the distance to the page's routing object and, on inner pages, the
    entry's covering radius; entries are skipped by |d(q, parent) - d(parent, entry)| - radius
    without computing a distance.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, page: int = 512, fanout: int = 8, seed: int = 5):
        self.ids, self.x = ids, x.astype(np.float64)
        norm = (self.x * self.x).sum(1)
        self.top = float(norm.max()) if len(x) else 0.0
        self.full = np.concatenate([self.x, np.sqrt(np.maximum(self.top - norm, 0))[:, None]], 1)
        self.page, self.fanout, self.rng = page, fanout, np.random.default_rng(seed)
        #: Pages: (rows, distances to parent, radii, child pages); leaves have no radii and children.
        self.pages: list[tuple] = []
        self.root = self._build(np.arange(len(ids)), None) if len(ids) else -1

    def _far(self, rows: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(((self.full[rows] - self.full[to]) ** 2).sum(1))

    def _build(self, rows: np.ndarray, parent: int | None) -> int:
        up = self._far(rows, parent) if parent is not None else np.zeros(len(rows))
        if len(rows) <= self.page:
            self.pages.append((rows, up, None, None))
            return len(self.pages) - 1
        pivots = np.sort(self.rng.choice(rows, self.fanout, replace=False))
        square = (self.full[rows] ** 2).sum(1)[:, None] + (self.full[pivots] ** 2).sum(1) - 2 * self.full[rows] @ self.full[pivots].T
        owner = np.argmin(square, 1)
        if np.bincount(owner, minlength=self.fanout).max() == len(rows):  # equal vectors: deal them out
            owner = np.arange(len(rows)) % self.fanout
        kept, radii, children = [], [], []
        for k, p in enumerate(pivots.tolist()):
            own = rows[owner == k]
            if len(own):
                kept.append(p)
                radii.append(float(self._far(own, p).max()))
                children.append(self._build(own, p))
        kept = np.array(kept)
        self.pages.append((kept, self._far(kept, parent) if parent is not None else np.zeros(len(kept)), np.array(radii), children))
        return len(self.pages) - 1

    def search(self, q: np.ndarray, own_ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Best first for many queries in step: per query the k largest scores and their ids, without
        its own id, ties to smaller ids; -inf where there are fewer. With ``floors`` (whole numbers or
        -inf) only scores from there on are wanted, and the place of one that is missing holds floor - 0.5.

        In each round every query takes the page of its least bound; queries that take the same
        page are worked on together. A query is done when its next bound lies beyond its k-th distance.
        """
        q, n = q.astype(np.float64), len(q)
        best_s = np.full((n, k), -np.inf)
        best_i = np.zeros((n, k), self.ids.dtype)
        if self.root < 0:
            return best_s, best_i
        fixed = (q * q).sum(1) + self.top
        slack = 1e-6 * np.sqrt(1 + fixed)
        limit = np.full(n, np.inf)
        if floors is not None:
            best_s[:] = floors[:, None] - 0.5
            known = np.isfinite(floors)
            limit[known] = np.sqrt(np.maximum(fixed[known] - 2 * best_s[known, 0], 0))
        bound = np.full((n, len(self.pages)), np.inf)
        bound[:, self.root] = 0
        to_parent = np.full((n, len(self.pages)), np.nan)
        active = np.arange(n)
        while len(active):
            page = bound[active].argmin(1)
            least = bound[active, page]
            go = np.isfinite(least) & (least <= limit[active] + slack[active])
            active, page = active[go], page[go]
            bound[active, page] = np.inf
            order = np.argsort(page, kind="stable")
            cuts = np.flatnonzero(np.diff(page[order])) + 1
            for part in np.split(order, cuts):
                if len(part):
                    self._visit(int(page[part[0]]), active[part], q, own_ids, fixed, slack, limit, bound, to_parent, best_s, best_i)
        return best_s, best_i

    def _visit(self, page, who, q, own_ids, fixed, slack, limit, bound, to_parent, best_s, best_i):
        rows, up, radii, children = self.pages[page]
        d = to_parent[who, page]
        reach = np.abs(d[:, None] - up) - (0 if radii is None else radii)
        some = ~(reach > (limit[who] + slack[who])[:, None]).all(0)  # NaN at the root skips nothing
        if not some.any():
            return
        pick = np.flatnonzero(some)
        s = q[who] @ self.x[rows[pick]].T
        if children is not None:
            far = np.sqrt(np.maximum(fixed[who, None] - 2 * s, 0))
            kids = np.array(children)[pick]
            bound[who[:, None], kids] = np.maximum(far - radii[pick], 0)
            to_parent[who[:, None], kids] = far
            return
        ids = self.ids[rows[pick]]
        s[own_ids[who][:, None] == ids] = -np.inf
        hit = np.flatnonzero(((s >= best_s[who, -1:]) & np.isfinite(s)).any(1))
        if not len(hit):
            return
        w, k, s = who[hit], best_s.shape[1], s[hit]
        least = best_s[w, -1:]
        if len(ids) > k:  # nothing below the page's own k-th score can be among the best
            least = np.maximum(least, np.partition(s, -k, axis=1)[:, [-k]])
        row, col = np.nonzero((s >= least) & np.isfinite(s))
        held = np.bincount(row, minlength=len(hit))
        at = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
        new_s = np.full((len(hit), held.max()), -np.inf)
        new_i = np.zeros(new_s.shape, self.ids.dtype)
        new_s[row, at], new_i[row, at] = s[row, col], ids[col]
        all_s, all_i = np.concatenate([best_s[w], new_s], 1), np.concatenate([best_i[w], new_i], 1)
        order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
        best_s[w], best_i[w] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)
        last = best_s[w, -1]
        limit[w] = np.where(np.isfinite(last), np.sqrt(np.maximum(fixed[w] - 2 * np.where(np.isfinite(last), last, 0), 0)), np.inf)


#: Regions of the space at most, which bounds what tasks share; regions beyond their size are cut by a hash.
MAX_PIVOTS = 512
#: Partitions of the search at most.
MAX_SPREAD = 20_000


class Regions:
    """Pivots with covering radii, over vectors lifted to one norm as in the trees."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.x, self.top = pivots.astype(np.float64), top
        self.lift = np.sqrt(np.maximum(top - (self.x * self.x).sum(1), 0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row and its distance."""
        x = x.astype(np.float64)
        lift = np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))
        near = x @ self.x.T + lift[:, None] * self.lift
        at = near.argmax(1)
        return at, np.sqrt(np.maximum(2 * self.top - 2 * near[np.arange(len(x)), at], 0))

    def reach(self, q: np.ndarray, radii: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """(query, region): whether the region's ball may hold a score of the query's floor or more."""
        q = q.astype(np.float64)
        fixed = (q * q).sum(1) + self.top
        far = np.sqrt(np.maximum(fixed[:, None] - 2 * q @ self.x.T, 0))
        limit = np.sqrt(np.maximum(fixed - 2 * np.where(np.isfinite(floors), floors, 0), 0))
        slack = 1e-6 * np.sqrt(1 + fixed)
        return (far - radii <= (limit + slack)[:, None]) | ~np.isfinite(floors)[:, None]


def top_inner_products(
    rows: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 20,
    k: int = 20,
    scale: float = 64.0,
    tree_rows: int = 4096,
    query_rows: int = 1024,
) -> DataFrame:
    """Each query's k largest integer inner products: query_id, rank, vec_id (candidate) and score.

    Components become floor(scale * x); queries are the rows whose id is divisible by ``every``,
    candidates every row but the query's own. Rows are numbered in the order of their ids, so that ties between
    numbers are ties between ids, and go to the nearest of up to
    ``MAX_PIVOTS`` pivots; a region is one M-tree or, by a hash, several of about ``tree_rows``.
    Queries first search the region they lie in. Their k-th score there bounds the second
    round: only regions whose ball may hold a better one are visited, and only scores from
    the bound on are returned. A window per query keeps the best k.

    Edge cases: vectors that are null or hold null or non-finite components take no part; rows
    with equal ids are candidates and queries each, so a repeated query id has its ranks once a row; shorter vectors count as padded with zeros; null ids take no part; fewer than k candidates are all returned; an
    empty table gives no rows; other columns are ignored. Scores are exact up to 2**53.
    """
    spark = rows.sparkSession
    good = usable(rows, id_col, vector_col).filter("id is not null")
    own = good.select("id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v")).repartitionByRange("id", F.xxhash64("v")).sortWithinPartitions("id")
    numbered = materialise(own.select(F.col("id").alias("name"), F.monotonically_increasing_id().alias("id"), (F.col("id") % every == 0).alias("asks"), "v"), "ints")
    ints = numbered.select("id", "asks", "v")
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x)
    size = ints.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d"),
        F.coalesce(F.max(square), F.lit(0.0)).alias("top"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda t, x: F.greatest(t, F.abs(x)))).alias("big"),
    ).first()
    width, kind = size["d"], np.dtype("<i4" if (size["big"] or 0) < 1 << 31 else "<i8")
    padded = lambda lists: np.array([(x + [0] * width)[:width] for x in lists], np.int64).reshape(len(lists), width).astype(kind)
    drawn = ints.orderBy(hash_unit(F.col("id"), seed="pivots"), "id").limit(min(MAX_PIVOTS, max(1, -(-size["n"] // tree_rows)))).select("v").collect()
    regions = Regions(padded([r["v"] for r in drawn]), size["top"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = padded(part.column(2).to_pylist())
                region, far = regions.nearest(x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(region, pa.int32()), pa.array(far), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "asks", "tree", "far", "x"])

    placed = materialise(ints.mapInArrow(place, "id long, asks boolean, tree int, far double, x binary"), "placed")
    asked = placed.filter("asks")
    found = placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.count_if("asks").alias("q")).collect()  # a row a pivot
    radii, chunks, parts = np.full(len(drawn), -np.inf), np.ones(len(drawn), np.int64), np.ones(len(drawn), np.int64)
    for r in found:
        radii[r["tree"]], chunks[r["tree"]], parts[r["tree"]] = r["radius"], -(-r["n"] // tree_rows), max(1, -(-r["q"] // query_rows))
    per_tree = lambda counts: F.get(F.array(*[F.lit(int(c)) for c in counts]), F.col("tree")) if len(drawn) else F.lit(1)
    chunks_of, spread = per_tree(chunks), int(min(max(1, chunks.sum()), MAX_SPREAD))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (tree, chunk, id, x) rows as one row per tree, chunk and ``query_rows`` or a whole tree."""
        own, ids, x = None, [], []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([own[0]], pa.int32()), pa.array([own[1]], pa.int64()), pa.array([ids], pa.list_(id_kind)), pa.array([b"".join(x)], pa.binary())], ["tree", "chunk", "ids", "x"])

        for batch in batches:
            id_kind = batch.column(2).type
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != row[:2] or len(ids) >= row[4]:
                    if ids:
                        yield flush()
                    own, ids, x = row[:2], [], []
                ids.append(row[2])
                x.append(row[3])
        if ids:
            yield flush()

    gathered = "tree int, chunk long, ids array<long>, x binary"
    chunk = F.pmod(F.xxhash64("id"), chunks_of).cast("long").alias("chunk")
    dealt = placed.select("tree", chunk, "id", "x", F.lit(8 * tree_rows).alias("most")).repartition("tree", "chunk").sortWithinPartitions("tree", "chunk")
    trees = materialise(dealt.mapInArrow(gather, gathered), "trees")
    part = F.pmod(F.xxhash64("id"), per_tree(parts)).cast("long").alias("chunk")
    first = asked.select("tree", part, "id", "x", F.lit(2 * query_rows).alias("most")).repartition("tree", "chunk").sortWithinPartitions("tree", "chunk").mapInArrow(gather, gathered)
    first = first.select("tree", F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.expr("cast(null as array<double>)").alias("floors"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                raw = batch.column(4)[r].as_buffer()
                if last is None or not raw.equals(last):
                    ids = batch.column(3)[r].values.to_numpy(zero_copy_only=False)
                    last, tree = raw, MTree(ids, np.frombuffer(raw, kind).reshape(len(ids), width))
                own = batch.column(0)[r].values.to_numpy(zero_copy_only=False)
                q = np.frombuffer(batch.column(1)[r].as_buffer(), kind).reshape(len(own), width)
                floors = batch.column(2)[r].values
                scores, near = tree.search(q, own, k, None if floors is None else floors.to_numpy(zero_copy_only=False))
                at, s = np.repeat(own, k), scores.ravel()
                real = np.isfinite(s) & (s == np.floor(s))
                out = batch.column(0).type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(at[real], out), pa.array(near.ravel()[real], out), pa.array(s[real].astype(np.int64))], ["query_id", "vec_id", "score"])

    def searched(blocks: DataFrame, label: str) -> DataFrame:
        every_chunk = F.explode(F.sequence(F.lit(0).cast("long"), chunks_of.cast("long") - 1)).alias("chunk")
        # A stated number of partitions: few bytes mean much work here, so they must not be put together by size.
        met = blocks.select("tree", "q_ids", "q_x", "floors", every_chunk).repartition(spread, "tree", "chunk").join(trees.repartition(spread, "tree", "chunk"), ["tree", "chunk"]).select("q_ids", "q_x", "floors", "ids", "x")
        # By bytes, not rows: the same plan deals queries out, and few of them at a time would be searched for few at a time.
        with batch_bytes(spark, 8 << 20):
            return materialise(met.mapInArrow(search, "query_id long, vec_id long, score long"), label)

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    ranked = lambda best: best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    near = materialise(ranked(searched(first, "near")), "near")
    bounds = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, query_rows):
                part = batch.slice(at, query_rows)
                raw, own = part.column(2).to_pylist(), part.column(1).to_numpy()
                q = np.frombuffer(b"".join(raw), kind).reshape(len(raw), width)
                floors = part.column(3).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                go = regions.reach(q, radii, floors)
                go[np.arange(len(q)), own] = False
                for t in np.flatnonzero(go.any(0)).tolist():
                    some = np.flatnonzero(go[:, t])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t], pa.int32()), pa.array([part.column(0).take(pa.array(some)).to_pylist()], pa.list_(part.column(0).type)), pa.array([q[some].tobytes()], pa.binary()), pa.array([floors[some].tolist()], pa.list_(pa.float64()))],
                        ["tree", "q_ids", "q_x", "floors"],
                    )

    groups = max(1, -(-sum(r["q"] for r in found) // query_rows))
    rest = asked.select("id", "tree", "x").join(bounds, "id", "left").repartition(groups, "id").mapInArrow(visits, "tree int, q_ids array<long>, q_x binary, floors array<double>")
    far = searched(rest, "far")
    best = ranked(near.drop("rank").unionByName(far))
    for column in ("query_id", "vec_id"):
        best = best.join(numbered.select(F.col("id").alias(column), F.col("name").alias(f"{column}_name")), column)
    return best.select(F.col("query_id_name").alias("query_id"), "rank", F.col("vec_id_name").alias("vec_id"), "score")
