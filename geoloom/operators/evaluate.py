"""Evaluators: predictions against labels."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from geoloom.functions.scalars import EARTH_RADIUS_M, haversine_m, mape_term, smape_term


def align(labels: DataFrame, predictions: DataFrame, on: str) -> DataFrame:
    """Labels with predictions by id; ids on one side alone fall out (see ``unmatched``)."""
    return labels.join(predictions, on)


def unmatched(labels: DataFrame, predictions: DataFrame, on: str) -> DataFrame:
    return labels.select(on).join(predictions.select(on), on, "left_anti")


def regression_metrics(pairs: DataFrame, true: str = "label", predicted: str = "prediction", r2: bool = True) -> DataFrame:
    """MSE, RMSE, MAE, MAPE, sMAPE and R2 in one aggregation."""
    t, p = F.col(true).cast("double"), F.col(predicted).cast("double")
    error = p - t
    mse = F.avg(error * error)
    out = [mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.avg(mape_term(t, p)).alias("mape"), F.avg(smape_term(t, p)).alias("smape")]
    if r2:
        out.append((F.lit(1.0) - F.try_divide(F.sum(error * error), F.var_pop(t) * F.count(t))).alias("r2"))
    return pairs.agg(*out)


def hex_regression(labels: DataFrame, predictions: DataFrame, on: str = "region_id") -> DataFrame:
    return regression_metrics(align(labels, predictions, on))


def trajectory_regression(labels: DataFrame, predictions: DataFrame, on: str = "trip_id", version: str = "TTE") -> DataFrame:
    if version != "TTE":
        raise ValueError("only the travel-time task has numeric labels")
    return regression_metrics(align(labels, predictions, on), r2=False)


def sequence_accuracy(true: Column, predicted: Column) -> Column:
    """Share of equal items over the common length; null for an empty one."""
    n = F.least(F.size(true), F.size(predicted))
    hits = F.aggregate(
        F.zip_with(F.slice(true, 1, n), F.slice(predicted, 1, n), lambda a, b: (a == b).cast("int")), F.lit(0), lambda acc, x: acc + x
    )
    return F.try_divide(hits.cast("double"), n.cast("double"))


def sequence_haversine(true: Column, predicted: Column) -> Column:
    """Mean distance in metres between items (structs of lon, lat) over the common length."""
    n = F.least(F.size(true), F.size(predicted))
    total = F.aggregate(
        F.zip_with(F.slice(true, 1, n), F.slice(predicted, 1, n), lambda a, b: haversine_m(a["lon"], a["lat"], b["lon"], b["lat"])),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return F.try_divide(total, n.cast("double"))


def _metres(p, q):
    """Great-circle distances between places (lon, lat in radians), broadcast."""
    import numpy as np

    h = np.sin((q[..., 1] - p[..., 1]) / 2) ** 2 + np.cos(p[..., 1]) * np.cos(q[..., 1]) * np.sin((q[..., 0] - p[..., 0]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1, h)))


def _warp(p, q, lo, hi, keep: bool):
    """Least cost of a warping path within the columns lo[i] <= j < hi[i] of each row, and the costs row by row if kept.

    A row follows from the one before at once: with running sums c of its distances, its costs are
    c[j] + min over k <= j of (what leads into k) - c[k - 1].
    """
    import numpy as np

    rows, before, start = [], None, 0
    for i in range(len(p)):
        a, b = int(lo[i]), int(hi[i])
        step = _metres(p[i], q[a:b])
        sums = np.cumsum(step)
        into = np.full(b - a, np.inf)
        if before is None:
            into[0] = 0.0
        else:
            for shift in (0, 1):  # from straight above, and from above and one to the left
                x, y = max(a, start + shift), min(b, start + shift + len(before))
                if x < y:
                    into[x - a : y - a] = np.minimum(into[x - a : y - a], before[x - shift - start : y - shift - start])
        before, start = sums + np.minimum.accumulate(into - (sums - step)), a
        if keep:
            rows.append(before)
    return float(before[-1]), rows


def _path_spans(rows, lo):
    """First and last column of the best path in each row, from the costs."""
    import numpy as np

    n = len(rows)
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = lambda i, j: rows[i][j - lo[i]] if i >= 0 and 0 <= j - lo[i] < len(rows[i]) else np.inf
    j = int(lo[-1]) + len(rows[-1]) - 1
    for i in range(n - 1, -1, -1):
        last[i] = j
        while True:
            left, above, both = at(i, j - 1), at(i - 1, j), at(i - 1, j - 1)
            if i == 0 and j == 0 or left > min(above, both):
                break
            j -= 1
        first[i] = j
        if i and both <= above:
            j -= 1
    return first, last


def warped(p, q, radius: int | None):
    """Dynamic time warping of places (lon, lat in radians): exact, or near the best path of the halved sequences within a radius.

    With a radius the sequences are halved by means until one is short, solved there, and solved again level by level
    in a band around the path of the level before, so time and memory grow with their length.
    """
    import numpy as np

    whole = lambda n, m: (np.zeros(n, np.int64), np.full(n, m, np.int64))
    if radius is None:
        return _warp(p, q, *whole(len(p), len(q)), False)[0]
    levels = [(p, q)]
    while min(len(levels[-1][0]), len(levels[-1][1])) >= radius + 2 and max(len(levels[-1][0]), len(levels[-1][1])) > 3:
        levels.append(tuple((x[: len(x) // 2 * 2 : 2] + x[1::2][: len(x) // 2]) / 2 for x in levels[-1]))
    lo, hi = whole(len(levels[-1][0]), len(levels[-1][1]))
    for level in range(len(levels) - 1, -1, -1):
        x, y = levels[level]
        cost, rows = _warp(x, y, lo, hi, level > 0)
        if not level:
            return cost
        first, last = _path_spans(rows, lo)
        first, last = (np.concatenate([v[:1].repeat(radius), v, v[-1:].repeat(radius)]) for v in (first, last))
        n, m = len(levels[level - 1][0]), len(levels[level - 1][1])
        low = np.lib.stride_tricks.sliding_window_view(first, 2 * radius + 1).min(1) - radius
        high = np.lib.stride_tricks.sliding_window_view(last, 2 * radius + 1).max(1) + radius
        row = np.minimum(np.arange(n) // 2, len(low) - 1)
        lo, hi = np.clip(2 * low[row], 0, m - 1), np.clip(2 * high[row] + 2, 1, m)
        lo[0], hi[-1] = 0, m
    return None


def dtw_metres(true: Column, predicted: Column, radius: int | None = None) -> Column:
    """Dynamic time warping over great-circle distances between items (lon, lat).

    Exact without a radius; with one, linear in the length of the sequences and never below the exact cost.
    """

    @arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for (p, starts), (q, others) in zip(_radians(a), _radians(b), strict=True):
            out += [warped(p[i:j], q[k:m], radius) if i < j and k < m else None for i, j, k, m in zip(starts[:-1], starts[1:], others[:-1], others[1:], strict=True)]
        return pa.array(out, pa.float64())

    places = lambda c: F.transform(c, lambda e: F.struct(e["lon"].cast("double").alias("lon"), e["lat"].cast("double").alias("lat")))
    return run(places(true), places(predicted))


def _radians(lists: pa.Array, rows: int = 64):
    """Lists of (lon, lat) some at a time: their places in radians as one array and where each list starts; null lists are empty. No place becomes a Python object."""
    import numpy as np

    for k in range(0, len(lists), rows):
        part = lists.slice(k, rows)
        flat = part.flatten()
        n = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
        spots = [np.asarray(flat.field(c).to_numpy(zero_copy_only=False), float) for c in (0, 1)]
        yield np.radians(np.stack(spots, 1)), [0, *np.cumsum(n).tolist()]


def mobility_metrics(pairs: DataFrame, *, true: str = "true_cells", predicted: str = "predicted_cells", k: int | None = None) -> DataFrame:
    """Mean accuracy of cell-id sequences, cut to k items where the true one has at least as many."""
    t, p = F.col(true), F.col(predicted)
    if k is not None:
        p = F.when(F.size(t) >= k, F.slice(p, 1, k)).otherwise(p)
        t = F.when(F.size(t) >= k, F.slice(t, 1, k)).otherwise(t)
    return pairs.agg(F.avg(sequence_accuracy(t, p)).alias("accuracy"))
