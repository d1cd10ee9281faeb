"""Tag filters, grouping, outlier filters and projections."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.quantiles import quantiles

TagFilter = Mapping[str, object]


def merge_filters(tags: TagFilter | Iterable) -> dict[str, object]:
    """One flat filter key -> True or list of values from a flat one, groups of them, or several.

    True takes in lists, False adds nothing, values keep their order without repeats.
    """
    out: dict[str, object] = {}

    def add(flat: TagFilter) -> None:
        for key, values in flat.items():
            if values is True:
                out[key] = True
            elif values is not False and out.get(key) is not True:
                have = out.setdefault(key, [])
                have += [v for v in dict.fromkeys([values] if isinstance(values, str) else values) if v not in have]

    def walk(item) -> None:
        if isinstance(item, Mapping):
            if item and all(isinstance(v, Mapping) for v in item.values()):
                for v in item.values():
                    add(v)
            else:
                add(item)
        else:
            for v in item:
                walk(v)

    walk(tags)
    return {k: v for k, v in out.items() if v is True or v}


#: Values of a filter that a table may hold.
MAX_VALUES = 100_000


def filter_from_table(rows: DataFrame, *, group: str | None = None, key: str = "key", value: str = "value") -> dict[str, object]:
    """A filter from a table of its values, such as a file of predefined tags: key -> values, or group -> key -> values with ``group``.

    A null value stands for any value of its key. Names and values are sorted. A filter is part of a plan, so
    more than ``MAX_VALUES`` values are an error.
    """
    keys = [c for c in (group, key) if c]
    found = rows.select(*[F.col(f"`{c}`").cast("string") for c in keys], F.col(f"`{value}`").cast("string").alias("_value")).distinct().limit(MAX_VALUES + 1).collect()
    if len(found) > MAX_VALUES:
        raise ValueError(f"more than {MAX_VALUES} values in a filter")
    out: dict = {}
    for *path, v in sorted(map(tuple, found), key=lambda r: [x or "" for x in r]):
        flat = out.setdefault(path[0], {}) if group else out
        if v is None:
            flat[path[-1]] = True
        elif flat.get(path[-1]) is not True:
            flat.setdefault(path[-1], []).append(v)
    return out


def _matches(key: str, values: object) -> Column:
    if values is True:
        return F.col(f"`{key}`").isNotNull()
    return F.col(f"`{key}`").isin([values] if isinstance(values, str) else list(values))


def tag_mask(df: DataFrame, tags: TagFilter) -> Column:
    """Whether any key of the filter matches; keys the table lacks are ignored."""
    parts = [F.coalesce(_matches(k, v), F.lit(False)) for k, v in tags.items() if v is not False and k in df.columns]
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def first_tag(df: DataFrame, tags: TagFilter) -> Column:
    """"key=value" of the first key of the filter, in its order, that matches; null if none does."""
    parts = [F.when(_matches(k, v), F.concat(F.lit(f"{k}="), F.col(f"`{k}`"))) for k, v in tags.items() if v is not False and k in df.columns]
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def group_features(df: DataFrame, groups: Mapping[str, TagFilter], keep: Iterable[str] = ("feature_id",)) -> DataFrame:
    """One column per group with its first tag; features without any, and empty groups, vanish.

    Whether a group is empty takes one aggregation.
    """
    keep = list(keep)
    grouped = df.select(*keep, *[first_tag(df, t).alias(g) for g, t in groups.items()])
    grouped = grouped.filter(F.coalesce(*[F.col(f"`{g}`") for g in groups]).isNotNull())
    return drop_empty_columns(grouped, keep)


def drop_empty_columns(df: DataFrame, keep: Iterable[str] = ("feature_id", "geometry")) -> DataFrame:
    """Drops columns without values; the others follow in order of name. One aggregation."""
    first = [c for c in keep if c in df.columns]
    rest = [c for c in df.columns if c not in first]
    if not rest:
        return df
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in rest]).first()
    return df.select(*first, *[F.col(f"`{c}`") for c in sorted(rest) if counts[c]])


def fixed_columns(df: DataFrame, wanted: Iterable[str], keep: Iterable[str]) -> DataFrame:
    """The wanted columns in order, 0 where missing."""
    return df.select(*keep, *[F.col(f"`{c}`") if c in df.columns else F.lit(0).alias(c) for c in wanted])


def within_quantiles(df: DataFrame, value: Column, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows between two quantiles (linear interpolation, bounds included).

    The quantiles are found first, so the filter is two constants that reach the scan.
    """
    lo, hi = quantiles(df, value, [low, high])
    return df.filter(value.between(lo, hi)) if lo is not None else df.limit(0)


def in_bounds(df: DataFrame, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    """Strictly inside a box: four comparisons that reach the scan."""
    return df.filter((F.col("lon") > lon[0]) & (F.col("lon") < lon[1]) & (F.col("lat") > lat[0]) & (F.col("lat") < lat[1]))


def members(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose id is in a table of ids, without repeats."""
    return df.join(ids.select(on), on, "left_semi").dropDuplicates()


def merge_scans(parts: Iterable[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Several scans as one table; per key the first non-null value of each column in scan order."""
    tables = [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    rest = [c for c in together.columns if c not in (*keys, "_part", order)]
    place = F.struct("_part", order)
    return together.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in rest])


def popular_tags(tags: DataFrame, *, in_wiki_only: bool = False, min_count: int = 0, min_fraction: float = 0.0) -> DataFrame:
    """Values per key of popular tags, from a table key, value, count_all, count_all_fraction, in_wiki."""
    keep = (F.col("count_all") >= min_count) & (F.col("count_all_fraction") >= min_fraction)
    if in_wiki_only:
        keep &= F.col("in_wiki")
    return tags.filter(keep).groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("values"))
