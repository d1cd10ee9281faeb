"""Exact quantiles of a large column in two passes, without sorting it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.storage import written

#: Distinct values that come to the driver at most; more are ranked where they are.
GATHERED = 200_000
_ACCURACY = 10_000


def _sketched(rows: DataFrame, shares: list[float], slack: float) -> tuple[int, list[tuple[float, float]]]:
    """How many values there are, and for each share two of them that its rank lies between: one sketch for all shares.

    The sketch errs by 1 / ``_ACCURACY`` of the ranks at most, half of what the brackets leave on either side at first.
    """
    ends = [min(1.0, max(0.0, s + k * slack / _ACCURACY)) for s in shares for k in (-1, 1)]
    found = rows.agg(F.count("v").alias("n"), F.percentile_approx("v", ends, _ACCURACY).alias("ends")).first()
    ends = list(map(float, found["ends"] or [0.0] * len(ends)))
    return found["n"], list(zip(ends[::2], ends[1::2], strict=True))


def _merged(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The brackets in order, those that overlap as one."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def values_at(rows: DataFrame, brackets: list[tuple[float, float]], ranks: list[int]) -> dict[int, float | None]:
    """The values at ranks (from 0) of the column ``v``, each of which lies in a bracket or next to one.

    One pass counts the values between the brackets by region and those within them one by one. Where a bracket
    ends just before a rank, the rank's value is the next region's least. A rank further off is left open (None).
    """
    spans = _merged(brackets)
    v = F.col("v")
    # Regions in order: 2k lies before span k, 2k + 1 is span k itself.
    region = F.lit(2 * len(spans))
    for k, (lo, hi) in reversed(list(enumerate(spans))):
        region = F.when(v < lo, 2 * k).when(v <= hi, 2 * k + 1).otherwise(region)
    keyed = rows.select(region.alias("region"), v)
    counts = keyed.groupBy("region", F.when(F.col("region") % 2 == 1, v).alias("inside")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    found = counts.limit(GATHERED + 1).collect()
    if len(found) > GATHERED:
        return _ranked(counts, ranks)
    out, below = {}, 0
    todo = sorted(set(ranks))
    for r in sorted(found, key=lambda r: (r["region"], r["least"])):
        while todo and todo[0] < below + r["n"]:
            rank = todo.pop(0)
            value = r["inside"] if r["inside"] is not None else {0: r["least"], r["n"] - 1: r["most"]}.get(rank - below)
            out[rank] = None if value is None else float(value)
        below += r["n"]
    return out


def _ranked(counts: DataFrame, ranks: list[int]) -> dict[int, float | None]:
    """The same where the brackets hold too many distinct values to gather: running sums within each region, of which the ranks' rows are taken."""
    counts = written(counts, "counts")
    sums = dict(counts.groupBy("region").agg(F.sum("n")).collect())  # a row per region
    before, below = {}, 0
    for region in sorted(sums):
        before[region] = below
        below += sums[region]
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    upto = F.sum("n").over(Window.partitionBy("region").orderBy("least")) + F.element_at(start, F.col("region"))
    wanted = F.explode(F.filter(F.array(*[F.lit(r).cast("long") for r in sorted(set(ranks))]), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))))
    placed = counts.withColumn("upto", upto).withColumn("rank", wanted)
    first, last = F.col("rank") == F.col("upto") - F.col("n"), F.col("rank") == F.col("upto") - 1
    value = F.when(F.col("inside").isNotNull() | first, F.col("least")).when(last, F.col("most"))
    return {r["rank"]: None if r["value"] is None else float(r["value"]) for r in placed.select("rank", value.alias("value")).collect()}


def quantiles(df: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """Quantiles by linear interpolation between ranks; null values don't count, none at all gives None.

    Two passes over the column: a sketch brackets all ranks, and one count settles them exactly.
    """
    rows = df.select(value.alias("v")).filter("v is not null")
    for slack in (2.0, 100.0, 2.0 * _ACCURACY):  # the first bracket holds what the sketch promises
        n, brackets = _sketched(rows, list(shares), slack)
        if not n:
            return [None] * len(shares)
        places = [s * (n - 1) for s in shares]
        found = values_at(rows, brackets, [r for p in places for r in (math.floor(p), math.ceil(p))])
        if None not in found.values():
            break
    out = []
    for p in places:
        lo, hi = math.floor(p), math.ceil(p)
        out.append(found[lo] if lo == hi or found[lo] == found[hi] else (hi - p) * found[lo] + (p - lo) * found[hi])
    return out
