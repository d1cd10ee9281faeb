"""Binning and train / validation / test splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import grid
from geoloom.operators.quantiles import quantiles
from geoloom.storage import written

SPLITS = ("train", "validation", "test")
#: Cells that are placed one by one, on the driver, after all others were placed in rounds.
LAST_CELLS = 4_096


def quantile_bins(df: DataFrame, value: str, bins: int, out: str = "bucket") -> DataFrame:
    """Equal-frequency bins: distinct linear quantiles as edges, right-closed, the least value in the first."""
    edges = sorted({e for e in quantiles(df, F.col(value), [k / bins for k in range(bins + 1)]) if e is not None})
    below = F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e < F.col(value))) - 1
    return df.withColumn(out, F.greatest(below, F.lit(0)).cast("int"))


def width_bins(df: DataFrame, value: str, bins: int, out: str = "bucket") -> DataFrame:
    """Equal-width bins, right-closed; the least value falls into the first."""
    limits = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    edges = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * k / float(bins))
    below = F.size(F.filter(edges, lambda e: e < F.col(value))) if bins > 1 else F.lit(0)
    return df.crossJoin(F.broadcast(limits)).withColumn(out, below.cast("int")).drop("_lo", "_hi")


def sequence_split(seq: Column, share: float = 0.85) -> tuple[Column, Column]:
    """A sequence's head and tail: int(size * share) items, but never all."""
    n = F.size(seq)
    k = F.floor(n * share).cast("int")
    k = F.when(k == n, n - 1).otherwise(k)
    return F.slice(seq, 1, F.greatest(k, F.lit(0))), F.slice(seq, F.greatest(k, F.lit(0)) + 1, F.greatest(n - k, F.lit(0)))


def shuffle_order(*parts: Column, seed: int | str) -> Column:
    """A fixed pseudo-random order, the same in any engine."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))


def cell_statistics(points: DataFrame, *, zoom: int, target: str | None = None, categorical: bool = False, bins: int = 7) -> DataFrame:
    """Points per parent cell and stratification bucket: cell, bucket, points."""
    placed = points.withColumn("cell", grid.tile_of(F.col("lon"), F.col("lat"), zoom))
    if target is None or target == "count":
        counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("points"))
        return quantile_bins(counts, "points", bins).select("cell", F.col("bucket").cast("string").alias("bucket"), "points")
    binned = placed.withColumn("bucket", F.col(target).cast("string")) if categorical else quantile_bins(placed, target, bins)
    return binned.groupBy("cell", F.col("bucket").cast("string").alias("bucket")).agg(F.count(F.lit(1)).alias("points"))


def _fractions(total: int, test: float, validation: float) -> dict[str, float]:
    parts = {"validation": validation / total if validation >= 1 else validation, "test": test / total if test >= 1 else test}
    if sum(parts.values()) >= 1:
        raise ValueError("the split sizes leave nothing to train on")
    return {"train": 1 - sum(parts.values()), **parts}


def assign_cells(rows: list[tuple[str, str, int]], fractions: dict[str, float], seed: int | str, placed: dict[str, dict[str, int]] | None = None) -> dict[str, str]:
    """Greedy: cells in a fixed pseudo-random order, each to the split that brings its buckets'
    ratios closest to the wanted ones; ties to train, then validation, then test. ``placed`` has the points per bucket and split to begin with."""
    import hashlib

    cells: dict[str, list[tuple[str, int]]] = {}
    for cell, bucket, n in rows:
        cells.setdefault(cell, []).append((bucket, n))
    splits = [s for s in SPLITS if fractions.get(s, 0) > 0]
    sums: dict[str, dict[str, int]] = {b: {s: have.get(s, 0) for s in splits} for b, have in (placed or {}).items()}
    out = {}
    for cell in sorted(cells, key=lambda c: hashlib.md5(f"{c}|{seed}".encode()).hexdigest()):
        costs = []
        for choice in splits:
            cost = 0.0
            for bucket, n in sorted(cells[cell]):
                have = sums.setdefault(bucket, dict.fromkeys(splits, 0))
                total = sum(have.values()) + n
                cost += sum(abs(fractions[s] - (have[s] + n * (s == choice)) / total) for s in splits)
            costs.append(cost)
        out[cell] = splits[costs.index(min(costs))]
        for bucket, n in cells[cell]:
            sums[bucket][out[cell]] += n
    return out


def _in_rounds(stats: DataFrame, cells: int, fractions: dict[str, float], seed: int | str) -> tuple[DataFrame, DataFrame]:
    """Places all but about the last ``LAST_CELLS`` cells of the order: their labels, and the points per bucket and split.

    A round takes half of what is left, by hash. What a split still needs of a bucket, so that it ends the round with its share,
    is known from the rounds before; a cell draws its split by another hash, in proportion to what its points' buckets need.
    Later rounds, each half as large, make up for the draws of earlier ones. Sums are per bucket; no cell reaches the driver.
    """
    splits = [s for s in SPLITS if fractions.get(s, 0) > 0]
    unit = lambda salt: F.conv(F.substring(shuffle_order(F.col("cell"), seed=f"{salt}{seed}"), 1, 12), 16, 10).cast("long") / float(16**12)
    stats = stats.withColumn("_u", unit(""))
    rounds = max(1, math.ceil(math.log2(cells / LAST_CELLS)))
    labels, sums = None, stats.limit(0).select("bucket", *[F.lit(0).cast("long").alias(s) for s in splits])
    for k in range(rounds):
        low = 1 - 0.5**k
        high = 1 - LAST_CELLS / cells if k == rounds - 1 else 1 - 0.5 ** (k + 1)
        own = stats.filter((F.col("_u") >= low) & (F.col("_u") < high))
        totals = own.groupBy("bucket").agg(F.sum("points").alias("_new")).join(sums, "bucket", "left").na.fill(0)
        whole = F.col("_new") + sum((F.col(s) for s in splits), F.lit(0))
        needs = totals.select("bucket", *[F.greatest(F.lit(0.0), F.lit(fractions[s]) * whole - F.col(s)).alias(f"_{s}") for s in splits])
        weigh = own.join(written(needs, "needs"), "bucket")
        all_needs = sum((F.col(f"_{s}") for s in splits), F.lit(0.0))
        per_cell = weigh.groupBy("cell").agg(*[F.sum(F.try_divide(F.col("points") * F.col(f"_{s}"), all_needs)).alias(s) for s in splits])
        mark, upto, choice = unit("draw") * sum((F.col(s) for s in splits), F.lit(0.0)), F.lit(0.0), F.lit(splits[-1])
        bounds = []
        for s in splits:
            upto = upto + F.col(s)
            bounds.append((s, upto))
        for s, bound in reversed(bounds[:-1]):
            choice = F.when(mark < bound, s).otherwise(choice)
        found = written(per_cell.select("cell", choice.alias("split")), "placed")
        gained = own.join(found, "cell").groupBy("bucket").agg(*[F.sum(F.when(F.col("split") == s, F.col("points")).otherwise(0)).alias(s) for s in splits])
        sums = written(sums.unionByName(gained).groupBy("bucket").agg(*[F.sum(s).alias(s) for s in splits]), "sums")
        labels = found if labels is None else labels.unionByName(found)
    return labels, sums


def spatial_split(
    points: DataFrame,
    *,
    zoom: int,
    target: str | None = None,
    categorical: bool = False,
    bins: int = 7,
    test: float = 0.2,
    validation: float = 0.0,
    seed: int | str = 0,
) -> DataFrame:
    """Points (lon, lat) with a ``split``: whole parent cells go to one split, stratified by bucket.

    Cells are placed in a fixed pseudo-random order: all but the last ``LAST_CELLS`` in rounds that
    never leave the executors, and those one by one, which settles what the rounds left uneven. A table of no more cells is
    placed one by one from the start. The labels come back by a join on the cell.
    """
    if categorical and target is None:
        raise ValueError("a categorical split needs a target")
    stats = written(cell_statistics(points, zoom=zoom, target=target, categorical=categorical, bins=bins), "statistics")
    facts = stats.agg(F.countDistinct("cell").alias("cells"), F.sum("points").alias("total")).first()
    if not facts["total"]:
        return points.withColumn("split", F.lit("train"))
    fractions = _fractions(facts["total"], test, validation)
    labels, placed, left = None, {}, stats
    if facts["cells"] > 2 * LAST_CELLS:
        labels, sums = _in_rounds(stats, facts["cells"], fractions, seed)
        left = stats.join(labels, "cell", "left_anti")
        placed = {r["bucket"]: r.asDict() for r in sums.join(left.select("bucket").distinct(), "bucket", "left_semi").collect()}  # the last cells' buckets
    last = assign_cells([(r["cell"], r["bucket"], r["points"]) for r in left.collect()], fractions, seed, placed)
    own = points.sparkSession.createDataFrame(sorted(last.items()), "cell string, split string")
    labels = own if labels is None else own.unionByName(labels)
    keyed = points.withColumn("_cell", grid.tile_of(F.col("lon"), F.col("lat"), zoom))
    return keyed.join(labels.withColumnRenamed("cell", "_cell"), "_cell").drop("_cell")


def train_test_spatial_split(points: DataFrame, *, test: float = 0.2, **options) -> tuple[DataFrame, DataFrame]:
    if test <= 0:
        raise ValueError("test must be above 0")
    done = spatial_split(points, test=test, **options)
    return done.filter("split = 'train'").drop("split"), done.filter("split = 'test'").drop("split")


def split_report(labelled: DataFrame, bucket: str, expected: dict[str, float]) -> DataFrame:
    """Per bucket and split: points, ratio within the bucket (5 digits) and its distance from the wanted one."""
    per = labelled.groupBy(bucket, "split").agg(F.count(F.lit(1)).alias("points"))
    whole = F.sum("points").over(Window.partitionBy(bucket))
    want = F.create_map(*[F.lit(v) for kv in expected.items() for v in (kv[0], float(kv[1]))])
    ratio = F.round(F.col("points") / whole, 5)
    return per.withColumn("ratio", ratio).withColumn("difference", F.round(F.col("ratio") - F.try_element_at(want, F.col("split")), 5))


def stratified_split(df: DataFrame, key: str, bucket: str, *, test: float = 0.2, seed: int | str = 0) -> DataFrame:
    """Rows split at random within each bucket: the first share of a fixed pseudo-random order is the test.

    Two passes: counts per bucket, then ranks among rows whose hash can lie near the cut, so
    that no bucket is sorted whole in one task.
    """
    order = shuffle_order(F.col(key), seed=seed)
    unit = F.conv(F.substring(order, 1, 12), 16, 10).cast("long") / float(16**12)
    rows = df.withColumn("_o", order).withColumn("_u", unit)
    sizes = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    wide = rows.join(sizes, bucket)
    want = F.floor(F.col("_n") * test)
    slack = F.sqrt(F.col("_n")) * 6 + 6
    low, high = (want - slack) / F.col("_n"), (want + slack) / F.col("_n")
    base = wide.filter(F.col("_u") < low).groupBy(bucket).agg(F.count(F.lit(1)).alias("_b"))
    near = wide.filter((F.col("_u") >= low) & (F.col("_u") < high))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy("_o", key))
    picked = near.withColumn("_r", rank).join(base, bucket, "left").withColumn("_t", F.col("_r") + F.coalesce("_b", F.lit(0)) <= want)
    far = wide.filter((F.col("_u") < low) | (F.col("_u") >= high)).withColumn("_t", F.col("_u") < low)
    label = F.when(F.col("_t"), "test").otherwise("train").alias("split")
    return picked.select(*df.columns, label).unionByName(far.select(*df.columns, label))
