"""Embedders that are plain aggregations: counts, contextual counts, timetable features."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.filters import fixed_columns
from geoloom.schema import FEATURE, REGION, check_tables, drop_geometry
from geoloom.storage import written

AGGREGATES = ("average", "median", "sum", "min", "max")


def expected_features(tags: Mapping | Sequence[str] | None, subcategories: bool) -> list[str] | None:
    """Column names of a filter, sorted: key_value or group_key=value with subcategories, else keys or groups."""
    if tags is None:
        return None
    if not isinstance(tags, Mapping):
        return list(tags)
    grouped = bool(tags) and all(isinstance(v, Mapping) for v in tags.values())
    names = []
    for group, flat in tags.items() if grouped else [(None, tags)]:
        if grouped and not subcategories:
            names.append(group)
            continue
        for key, values in flat.items():
            if not subcategories:
                names.append(key)
            elif values is True:
                raise ValueError(f"{key}: True has no fixed list of values to count apart")
            elif values is not False:
                for v in [values] if isinstance(values, str) else values:
                    names.append(f"{group}_{key}={v}" if grouped else f"{key}_{v}")
    return sorted(dict.fromkeys(names))


#: Columns that a table of counts may get from its data.
MAX_COLUMNS = 10_000


def _few(names: DataFrame, what: str) -> list[str]:
    """The values of a one-column table that become columns, sorted; too many are an error."""
    found = [r[0] for r in names.limit(MAX_COLUMNS + 1).collect()]
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} {what}")
    return sorted(found)


def count_embedding(
    regions: DataFrame,
    features: DataFrame,
    joint: DataFrame,
    *,
    expected: Mapping | Sequence[str] | None = None,
    subcategories: bool = True,
    region_id: str = REGION,
    feature_id: str = FEATURE,
) -> DataFrame:
    """Counts per region and category; regions without features count 0.

    With subcategories, each value of each column is a category "column_value"; names that end
    in "_null" are left out. Without, a column's non-null values are counted. Boolean columns are
    counted where true. ``expected`` fixes the columns; otherwise one job finds the distinct
    categories, so the plan itself has fixed columns. Counting is a long form (one row per
    feature and value) summed per region with partial sums before the shuffle.
    """
    check_tables(regions, features, joint, region_id, feature_id)
    features = drop_geometry(features)
    values = [c for c in features.columns if c != feature_id]
    kinds = dict(features.dtypes)
    flags = bool(values) and all(kinds[c] == "boolean" for c in values)
    if subcategories and flags:
        raise ValueError("boolean columns have no subcategories")
    wanted = expected_features(expected, subcategories)
    if not values:
        if wanted is None:
            raise ValueError("no features and no expected columns")
        return fixed_columns(regions.select(region_id), wanted, [region_id])
    left = joint.select(region_id, feature_id)
    if subcategories:
        pairs = F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}_"), F.col(f"`{c}`").cast("string"))) for c in values])
        long = features.select(feature_id, F.explode(F.array_compact(pairs)).alias("name")).filter(~F.col("name").endswith("_null"))
        names = wanted if wanted is not None else _few(long.select("name").distinct(), "names of features; list the expected ones")
        counted = left.join(long.filter(F.col("name").isin(names)), feature_id).groupBy(region_id)
        counts = counted.pivot("name", names).count() if names else counted.count().drop("count")
    else:
        names = values
        one = lambda c: F.col(f"`{c}`").cast("int") if flags else F.col(f"`{c}`").isNotNull().cast("int")
        per = features.select(feature_id, *[one(c).alias(c) for c in values])
        counts = left.join(per, feature_id).groupBy(region_id).agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in values])
    done = regions.select(region_id).join(counts, region_id, "left")
    done = done.select(region_id, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("int").alias(c) for c in names])
    return fixed_columns(done, wanted, [region_id]) if wanted is not None else done


def _aggregate(name: str, c: Column) -> Column:
    rules = {"average": F.avg, "median": F.median, "sum": F.sum, "min": F.min, "max": F.max}
    if name not in rules:
        raise ValueError(f"unknown aggregation: {name}")
    return rules[name](c)


def contextual_embedding(
    counts: DataFrame,
    edges: DataFrame,
    distance: int,
    *,
    aggregation: str = "average",
    concatenate: bool = False,
    region_id: str = REGION,
) -> DataFrame:
    """Counts with those of the neighbours at distances 1 to ``distance``.

    Squashed: v + sum of agg_d / (d + 1)^2. Concatenated: columns "name_d", distance by
    distance. One join of the edge table with the counts and one grouped aggregation serve all
    distances; no neighbours, and missing values, count 0.
    """
    if distance < 0:
        raise ValueError("distance must not be negative")
    _aggregate(aggregation, F.lit(0))
    names = [c for c in counts.columns if c != region_id]
    near = edges.filter((F.col("distance") >= 1) & (F.col("distance") <= distance))
    joined = near.join(counts.withColumnRenamed(region_id, "neighbour_id"), "neighbour_id")
    aggs = [
        F.coalesce(_aggregate(aggregation, F.when(F.col("distance") == d, F.col(f"`{c}`"))).cast("double"), F.lit(0.0)).alias(f"{c}_{d}")
        for d in range(1, distance + 1)
        for c in names
    ]
    own = counts.select(region_id, *[F.col(f"`{c}`").cast("double").alias(f"{c}_0") for c in names])
    wide = own
    if aggs:
        around = joined.groupBy(F.col("region_id").alias(region_id)).agg(*aggs)
        wide = own.join(around, region_id, "left").na.fill(0.0)
    if concatenate:
        return wide
    total = lambda c: sum((F.col(f"`{c}_{d}`") / float((d + 1) ** 2) for d in range(1, distance + 1)), F.col(f"`{c}_0`"))
    return wide.select(region_id, *[total(c).alias(c) for c in names])


def gtfs_features(regions: DataFrame, features: DataFrame, joint: DataFrame, *, region_id: str = REGION, feature_id: str = FEATURE) -> DataFrame:
    """Timetable features per region: trips summed, directions counted over the union of sets,
    both scaled to [0, 1] by the least and greatest of all columns of their kind.

    A kind whose values are all equal gives null. A region's sets are never gathered: its directions become rows, of which
    equal ones are dropped before they are shuffled, and rows are counted.
    """
    check_tables(regions, features, joint, region_id, feature_id)
    trips = [c for c in features.columns if c.startswith("trips_at")]
    ways = [c for c in features.columns if c.startswith("directions_at")]
    member = joint.select(region_id, feature_id).join(features.select(feature_id, *trips, *ways), feature_id)
    full = regions.select(region_id).join(member.groupBy(region_id).agg(*[F.sum(c).alias(c) for c in trips]), region_id, "left") if trips else regions.select(region_id)
    if ways:
        served = lambda k: lambda d: F.struct(F.lit(k).alias("way"), d.alias("to"))
        to = [F.transform(F.coalesce(F.col(f"`{c}`").cast("array<string>"), F.array()), served(k)) for k, c in enumerate(ways)]
        each = member.select(region_id, F.explode(F.concat(*to)).alias("_r")).select(region_id, "_r.way", "_r.to").distinct()
        full = full.join(each.groupBy(region_id).agg(*[F.count_if(F.col("way") == k).alias(c) for k, c in enumerate(ways)]), region_id, "left")
    full = full.na.fill(0, [*trips, *ways])
    for group in (trips, ways):
        if group:
            full = min_max(full, group)
    return full


def min_max(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Scales columns by their common least and greatest value; a single row of scalars is joined back."""
    columns = list(columns)
    lo = F.least(*[F.min(c) for c in columns]) if len(columns) > 1 else F.min(columns[0])
    hi = F.greatest(*[F.max(c) for c in columns]) if len(columns) > 1 else F.max(columns[0])
    limits = df.agg(lo.cast("double").alias("_lo"), hi.cast("double").alias("_hi"))
    scaled = {c: F.try_divide(F.col(c).cast("double") - F.col("_lo"), F.col("_hi") - F.col("_lo")) for c in columns}
    return df.crossJoin(F.broadcast(limits)).withColumns(scaled).drop("_lo", "_hi")


def z_score(df: DataFrame, columns: Iterable[str], fitted: DataFrame | None = None, tiny: float = 1e-8) -> DataFrame:
    """Population z-scores; a column that hardly varies becomes 0. ``fitted`` (one row from
    ``z_fit``) applies the scale of other data."""
    columns = list(columns)
    stats = fitted if fitted is not None else z_fit(df, columns)
    wide = df.crossJoin(F.broadcast(stats))
    out = {c: F.when(F.col(f"{c}_std") < tiny, F.lit(0.0)).otherwise((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")) for c in columns}
    return wide.withColumns(out).drop(*[x for c in columns for x in (f"{c}_mean", f"{c}_std")])


def z_fit(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.agg(*[a for c in columns for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def mean_vectors(joint: DataFrame, vectors: DataFrame, columns: Iterable[str], *, region_id: str = REGION, feature_id: str = FEATURE) -> DataFrame:
    """Mean of the features' vectors per region."""
    return joint.join(vectors, feature_id, "left").groupBy(region_id).agg(*[F.avg(c).alias(c) for c in columns])


def neighbour_pairs(edges: DataFrame) -> DataFrame:
    """(anchor, positive) pairs of direct neighbours."""
    return edges.filter("distance = 1").select(F.col("region_id").alias("anchor"), F.col("neighbour_id").alias("positive"))


def negative_samples(regions: DataFrame, near: DataFrame, pairs: DataFrame, *, seed: int = 0, tries: int = 8) -> DataFrame:
    """For each pair a region that is no neighbour up to the distance in ``near``; pairs of an anchor
    that has no such region drop out.

    Regions lie on a ring by a hash of their id, cut into slots of a few each; a pair's hash picks a slot, and
    of it and the next slots the first allowed region counts. Pairs whose slots are all excluded try again farther on,
    up to the whole ring, so none is lost. Reruns agree, and no step numbers all rows in one task.
    """
    regions = written(regions.select(F.col("region_id").alias("negative")).distinct(), "regions")
    n = regions.count()
    slots = max(1, n // 2)
    mark = lambda *c: F.md5(F.concat_ws("|", *[F.col(x).cast("string") for x in c], F.lit(str(seed))))
    place = lambda *c: F.conv(F.substring(mark(*c), 1, 12), 16, 10).cast("long") % slots
    ring = regions.select("negative", place("negative").alias("slot"), mark("negative").alias("order"))
    barred = near.select(F.col("region_id").alias("anchor"), F.col("neighbour_id").alias("negative")).distinct()
    barred = barred.unionByName(regions.select(F.col("negative").alias("anchor"), "negative")).join(regions, "negative", "left_semi")
    barred = written(barred.distinct(), "barred")
    full = barred.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= n).select("anchor")
    left = written(pairs.select("anchor", "positive").distinct().join(full, "anchor", "left_anti"), "pairs")
    done, start, width = None, 0, min(tries, slots)
    while True:
        steps = F.explode(F.sequence(F.lit(start), F.lit(start + width - 1))).alias("k")
        tried = left.select("anchor", "positive", steps).withColumn("slot", F.pmod(place("anchor", "positive") + F.col("k"), F.lit(slots)))
        allowed = tried.join(ring, "slot").join(barred, ["anchor", "negative"], "left_anti")
        found = written(allowed.groupBy("anchor", "positive").agg(F.min(F.struct("k", "order", "negative")).alias("first")), "negatives")
        part = found.select("anchor", "positive", F.col("first.negative").alias("negative"))
        done = part if done is None else done.unionByName(part)
        left = written(left.join(found.select("anchor", "positive"), ["anchor", "positive"], "left_anti"), "pairs")
        start += width
        if start >= slots or not left.limit(1).count():
            return done
        width = min(2 * width, slots - start)


def valid_patches(edges: DataFrame, k: int, ring_size: int) -> DataFrame:
    """Regions all of whose cells within distance k are present (``ring_size`` with the centre)."""
    return edges.filter((F.col("distance") >= 0) & (F.col("distance") <= k)).groupBy("region_id").agg(F.count(F.lit(1)).alias("cells")).filter(F.col("cells") == ring_size).select("region_id")
