"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

import operator
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import hash_unit, materialise, pieces, settle, texts_of

FEATURES = (
    "log_chars", "word_length", "upper_share", "digit_share", "mark_share", "symbol_share", "space_share",
    "other_share", "distinct_words", "distinct_lines", "log_line", "adjacent_repeats",
)
_NAMES = [f"f{k}" for k in range(len(FEATURES))]
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of each code point: 0 lower or caseless letter, 1 upper, 2 digit, 3 usual mark, 4 symbol, 5 space, 6 other."""
    if not _CLASSES:
        out = np.full(0x10000, 6, np.uint8)
        for c in range(0x10000):
            kind = unicodedata.category(chr(c))
            if kind[0] == "L" or kind[0] == "M":
                out[c] = 1 if kind in ("Lu", "Lt") else 0
            elif kind[0] == "N":
                out[c] = 2
            elif kind[0] in "PS":
                out[c] = 3 if chr(c) in ".,;:'\"?!-()" else 4
            elif chr(c).isspace():
                out[c] = 5
        _CLASSES.append(out)
    return _CLASSES[0]


def features(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES per text; zeros for null or empty."""
    out = np.zeros((len(texts), len(FEATURES)))
    if not texts:
        return out
    texts = [x or "" for x in texts]
    n = np.array([len(x) for x in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _classes()[np.minimum(points, 0xFFFF)]
    full = n > 0
    starts = (np.cumsum(n) - n)[full]
    share = np.zeros((7, len(texts)))
    for k in range(7):
        if len(starts):
            share[k, full] = np.add.reduceat(kinds == k, starts, dtype=np.int64)
    chars, letters = np.maximum(n, 1), np.maximum(share[0] + share[1], 1)
    out[:, 0], out[:, 2] = np.log1p(n), share[1] / letters
    for at, k in ((3, 2), (4, 3), (5, 4), (6, 5), (7, 6)):
        out[:, at] = share[k] / chars
    for i, x in enumerate(texts):
        words, lines = x.split(), x.split("\n")
        w = len(words) or 1
        out[i, 1] = (n[i] - share[5, i]) / w
        out[i, 8] = len(set(words)) / w
        out[i, 9] = len(set(lines)) / len(lines)
        out[i, 10] = np.log1p(n[i] / len(lines))
        out[i, 11] = sum(map(operator.eq, words, words[1:])) / w
    return out


class Gam:
    """Additive lookup tables per feature and per chosen pair, learned by cyclic boosting."""

    def __init__(self, edges: list[np.ndarray], bias: float):
        self.edges, self.bias = edges, bias
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.coarse: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Table look-ups, added up for all rows at once."""
        b = self.bins(x)
        s = np.full(len(x), self.bias)
        for f, t in enumerate(self.tables):
            s += t[b[:, f]]
        for (f, g), t in zip(self.pairs, self.pair_tables, strict=True):
            s += t[self.coarse[f][b[:, f]], self.coarse[g][b[:, g]]]
        return s

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    at = int(np.argmax(gain)) if len(gain) else -1
    return (float(gain[at]), at + 1) if at >= 0 else (0.0, 0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 4) -> np.ndarray:
    """Step values per bin from a tree of at most ``leaves`` leaves over a histogram of gradients."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b], ridge), a, b) for a, b in parts]
        gain, cut, a, b = max(cuts)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best pair of cuts, one on each axis: gain and the step per cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    ll = (cg[:-1, :-1], ch[:-1, :-1])
    lr = (cg[:-1, -1:] - ll[0], ch[:-1, -1:] - ll[1])
    rl = (cg[-1:, :-1] - ll[0], ch[-1:, :-1] - ll[1])
    rr = (cg[-1, -1] - ll[0] - lr[0] - rl[0], ch[-1, -1] - ll[1] - lr[1] - rl[1])
    if not ll[0].size:
        return 0.0, np.zeros_like(g)
    gain = sum(a * a / (b + ridge) for a, b in (ll, lr, rl, rr)) - g.sum() ** 2 / (h.sum() + ridge)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = np.zeros_like(g)
    for (a, b), rows, cols in ((ll, slice(None, i + 1), slice(None, j + 1)), (lr, slice(None, i + 1), slice(j + 1, None)), (rl, slice(i + 1, None), slice(None, j + 1)), (rr, slice(i + 1, None), slice(j + 1, None))):
        step[rows, cols] = a[i, j] / (b[i, j] + ridge)
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, coarse: int = 12, rounds: int = 80, rate: float = 0.15, pairs: int = 6, pair_rounds: int = 40, ridge: float = 2.0) -> Gam:
    """Cyclic boosting of shallow trees, first over features, then over the pairs of most gain."""
    prior = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.zeros(0) for c in x.T]
    model = Gam(edges, float(np.log(prior / (1 - prior))))
    if not len(y) or y.min() == y.max():
        return model
    b, s = model.bins(x), np.full(len(y), model.bias)

    def gradients():
        p = 1 / (1 + np.exp(-s))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(x.shape[1]):
            g, h = gradients()
            k = len(edges[f]) + 1
            step = rate * _shallow_tree(np.bincount(b[:, f], g, k), np.bincount(b[:, f], h, k), ridge)
            model.tables[f] += step
            s += step[b[:, f]]
    model.coarse = [np.arange(len(e) + 1) * coarse // (len(e) + 1) for e in edges]
    c = np.stack([model.coarse[f][b[:, f]] for f in range(x.shape[1])], 1)
    grid = lambda f, g_, v: np.bincount(c[:, f] * coarse + c[:, g_], v, coarse * coarse).reshape(coarse, coarse)
    g, h = gradients()
    ranked = sorted(((_quadrants(grid(i, j, g), grid(i, j, h), ridge)[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in ranked[:pairs] if gain > 1e-9]
    model.pair_tables = [np.zeros((coarse, coarse)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = gradients()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h), ridge)[1]
            t += step
            s += step[c[:, i], c[:, j]]
    return model


def _arrays(batch: pa.RecordBatch, start: int) -> np.ndarray:
    cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[start:]]
    return np.stack(cols, 1) if batch.num_rows else np.zeros((0, len(cols)))


def _feature_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, f0, f1, ...), written: texts become numbers before anything is joined."""
    id_type = dict(docs.dtypes)[id_col]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("quality")
        for batch in batches:
            for some, texts in texts_of(batch):
                x = features(texts)
                yield pa.RecordBatch.from_arrays([pa.array(some, batch.column(0).type)] + [pa.array(c) for c in x.T], ["id", *_NAMES])

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string"))
    return materialise(picked.mapInArrow(extract, f"id {id_type}, " + ", ".join(f"{c} double" for c in _NAMES)), "features")


def _fold(fold: int):
    return F.crc32(F.col("id").cast("string").cast("binary")) % fold


def train(rows: DataFrame, labels: DataFrame, *, id_col: str, label_col: str, fold: int, held_out: int, sample_rows: int) -> Gam:
    """Fits the model on the driver from at most ``sample_rows`` labelled rows, drawn by hash."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).filter("y is not null")
    known = materialise(rows.filter(_fold(fold) != held_out).join(known, "id"), "labelled")
    n, chance = known.count(), hash_unit(F.col("id"), seed="quality-sample")
    if n > sample_rows:
        known = known.filter(chance < sample_rows * 1.1 / n)
    learn = known.orderBy(chance, "id").limit(sample_rows).toPandas()
    return fit(learn[_NAMES].to_numpy(float).reshape(-1, len(_NAMES)), (learn["y"].to_numpy(float) > 0.5).astype(float))


def score(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fold: int = 4,
    held_out: int = 2,
    threshold: float = 0.7,
    sample_rows: int = 20_000,
) -> DataFrame:
    """Scores every whole text: the id, held_out, score (0 to 1) and predicted (score >= threshold).

    Features come from the text alone. The model is fitted on the driver from at most
    ``sample_rows`` labelled rows, drawn by a hash of the id over all labelled rows whose
    crc32(id as text) mod ``fold`` is not ``held_out``. Texts become feature rows before any
    join, so only numbers are shuffled.

    Edge cases: null or empty text scores from zero features; a null id is never learned from
    nor held out; without labels the score is 0.5, with one class its smoothed share; a label
    table with repeated ids counts each row; empty documents give no rows; other columns are
    ignored.
    """
    rows = _feature_rows(docs, id_col, text_col)
    model = train(rows, labels, id_col=id_col, label_col=label_col, fold=fold, held_out=held_out, sample_rows=sample_rows)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_arrays(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    return rows.mapInArrow(apply, f"id {dict(rows.dtypes)['id']}, score double, predicted int").select(
        F.col("id").alias(id_col), F.coalesce(_fold(fold) == held_out, F.lit(False)).alias("held_out"), "score", "predicted"
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fold: int = 4,
    held_out: int = 2,
    threshold: float = 0.7,
    sample_rows: int = 20_000,
) -> DataFrame:
    """The documents that score ``threshold`` or more, with all their columns, each judged by
    itself as it is read: nothing is joined or shuffled. Edge cases are those of ``score``; where nothing is labelled, all stay."""
    rows = _feature_rows(docs, id_col, text_col)
    model = train(rows, labels, id_col=id_col, label_col=label_col, fold=fold, held_out=held_out, sample_rows=sample_rows)
    if not any(t.any() for t in model.tables) and model.bias == 0:
        return docs
    at = docs.columns.index(text_col)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("quality")
        for batch in batches:
            good = [model.score(features(part.column(at).to_pylist())) >= threshold for part in pieces(batch, at)]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(sift, docs.schema)
