"""OpenStreetMap and Overture extracts, road networks, tiles: tables in, features out.

Fetching over a network is left to a callable that the caller passes, so that every path can be
run and tested without one; a partition fetches its own share.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Mapping, Sequence
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions import road
from geoloom.functions.scalars import haversine_m
from geoloom.operators.embedders import _few
from geoloom.operators.filters import drop_empty_columns, fixed_columns, group_features, merge_filters, merge_scans, tag_mask
from geoloom.operators.regionalizers import slippy_regions
from geoloom.operators.spatial_join import clip, semi_join
from geoloom.schema import BOX, GEOMETRY, with_bounds
from geoloom.storage import committed, opened, written


class NetworkType(str, Enum):
    """Kinds of road network."""

    # Fixed values.
    ALL_PRIVATE = "all_private"
    ALL = "all"
    BIKE = "bike"
    DRIVE = "drive"
    DRIVE_SERVICE = "drive_service"
    WALK = "walk"


# Roads and accesses that a network leaves out, as whole values ("motor" stands for every value with it).
_NOT_ROADS = "abandoned construction no planned platform proposed raceway razed"
_NO_ROAD = {
    NetworkType.ALL_PRIVATE: _NOT_ROADS,
    NetworkType.ALL: _NOT_ROADS,
    NetworkType.BIKE: _NOT_ROADS + " bus_guideway corridor elevator escalator footway motor steps",
    NetworkType.WALK: _NOT_ROADS + " bus_guideway corridor cycleway elevator escalator motor",
    NetworkType.DRIVE_SERVICE: _NOT_ROADS + " bridleway bus_guideway corridor cycleway elevator escalator footway path pedestrian steps track",
    NetworkType.DRIVE: _NOT_ROADS + " bridleway bus_guideway corridor cycleway elevator escalator footway path pedestrian service steps track",
}
_NO_SERVICE = {
    NetworkType.ALL_PRIVATE: "",
    NetworkType.ALL: "private",
    NetworkType.BIKE: "private",
    NetworkType.WALK: "private",
    NetworkType.DRIVE_SERVICE: "emergency_access parking parking_aisle private",
    NetworkType.DRIVE: "alley driveway emergency_access parking parking_aisle private",
}
_BARRED = {NetworkType.BIKE: ("bicycle",), NetworkType.WALK: ("foot",), NetworkType.DRIVE: ("motor_vehicle", "motorcar"), NetworkType.DRIVE_SERVICE: ("motor_vehicle", "motorcar")}


def network_mask(tags: Column, kind: NetworkType | str) -> Column:
    """Whether a way with these tags (map) belongs to a road network."""
    kind = NetworkType(kind)
    value = lambda key: F.try_element_at(tags, F.lit(key))
    out = lambda key, values: F.coalesce(value(key).isin(values.split()), F.lit(False))
    mask = value("highway").isNotNull() & ~out("highway", _NO_ROAD[kind]) & ~out("area", "yes") & ~out("service", _NO_SERVICE[kind] or "-")
    if " motor" in _NO_ROAD[kind]:
        mask &= ~F.coalesce(value("highway").contains("motor"), F.lit(False))
    if kind != NetworkType.ALL_PRIVATE:
        mask &= ~out("access", "private")
    for key in _BARRED.get(kind, ()):
        mask &= ~out(key, "no")
    return mask


def road_network(
    nodes: DataFrame,
    ways: DataFrame,
    network: NetworkType | str,
    *,
    columns: Sequence[str] = ("highway",),
    zones: Mapping | None = None,
    metadata: bool = False,
    area: DataFrame | None = None,
    contain_within_area: bool = False,
    cell: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The road graph of an extract: (nodes, edges).

    ``nodes``: id, lon, lat; ``ways``: id, refs (ids of nodes in order), tags (map). Ways of the
    network are cut at their ends and at nodes that occur more than once. Edges: feature_id
    (u_v_key), u, v, key (numbers the edges from u to v), way, path (lon, lat structs), length_m, the box, the asked
    tags normalised, and all tags with ``metadata``. Nodes: id, lon, lat and street_count, for the ends of edges.
    With an area, edges that meet it (or lie within it) stay. A way is one row's array throughout, which
    the format bounds to 2,000 nodes; steps to unknown nodes break an edge's path and are left out.
    """
    steps = ways.filter(network_mask(F.col("tags"), network)).select(F.col("id").alias("way"), "tags", F.posexplode("refs").alias("pos", "node"))
    steps = written(steps, "road-steps")
    met = steps.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node")
    spot = F.struct("pos", "node", "n", "lon", "lat")
    lines = steps.drop("tags").join(met, "node").groupBy("way").agg(F.array_sort(F.collect_list(spot)).alias("line"))
    last = F.size("line") - 1
    cuts = F.filter(F.transform("line", lambda s, i: F.when((s["n"] > 1) | (i == 0) | (i == last), i)), lambda i: i.isNotNull())
    cut = lines.withColumn("cuts", cuts).filter(F.size("cuts") > 1)
    spans = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda k: F.struct(F.get("cuts", k - 1).alias("a"), F.get("cuts", k).alias("b")))
    edges = cut.select("way", "line", F.explode(spans).alias("s")).select("way", F.slice("line", F.col("s.a") + 1, F.col("s.b") - F.col("s.a") + 1).alias("line"))
    pairs = F.zip_with(F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line") - 1), lambda p, q: haversine_m(p["lon"], p["lat"], q["lon"], q["lat"]))
    ends = {"u": F.get("line", F.lit(0))["node"], "v": F.get("line", F.size("line") - 1)["node"], "first": F.get("line", F.lit(0))["pos"]}
    side = lambda c: F.transform("line", lambda p: p[c])
    box = {"minx": F.array_min(side("lon")), "miny": F.array_min(side("lat")), "maxx": F.array_max(side("lon")), "maxy": F.array_max(side("lat"))}
    edges = edges.withColumns({**ends, "length_m": F.aggregate(pairs, F.lit(0.0), lambda t, d: t + d), **box})
    edges = edges.withColumn("path", F.transform("line", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))).drop("line")
    tags = steps.filter("pos = 0").select("way", "tags")
    key = F.row_number().over(Window.partitionBy("u", "v").orderBy("way", "first")) - 1
    edges = edges.withColumn("key", key).join(tags, "way")
    edges = edges.withColumn("feature_id", F.concat_ws("_", "u", "v", "key")).withColumns({c: road.normalise(c, F.try_element_at("tags", F.lit(c)), zones) for c in columns})
    keep = ["feature_id", "u", "v", "key", "way", "path", "length_m", *BOX, *columns]
    edges = written(edges.select(*keep, *(["tags"] if metadata else [])), "road-edges")
    if area is not None:
        edges = semi_join(edges, area, cell=cell, id_col="feature_id", contained=contain_within_area)
    used = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("street_count"))
    return nodes.select("id", "lon", "lat").join(used, "id"), edges


def read_extract(
    spark: SparkSession, path: str, tags: Mapping, *, area: tuple[float, float, float, float] | None = None, explode_tags: bool = True, keep_all_tags: bool = False, grouped: bool = False
) -> DataFrame:
    """Features of an extract in Parquet: element, id, tags (map) and geometry (WKB) or boxes.

    The tag filter is one predicate on the map and the area one on the boxes, both before any
    decoding. Exploded tags become columns in order of name, those without values dropped; groups
    give a column each with the first matching tag.
    """
    flat = merge_filters(tags)
    df = spark.read.parquet(path)
    hit = F.lit(False)
    for key, values in flat.items():
        value = F.try_element_at("tags", F.lit(key))
        hit = hit | (value.isNotNull() if values is True else F.coalesce(value.isin(list(values)), F.lit(False)))
    df = df.filter(hit).withColumn("feature_id", F.concat_ws("/", "element", F.col("id").cast("string")))
    if area is not None:
        df = clip(with_bounds(df), *area) if GEOMETRY in df.columns else with_bounds(df).filter(f"minx <= {area[2]!r} and maxx >= {area[0]!r} and miny <= {area[3]!r} and maxy >= {area[1]!r}")
    place = [c for c in (GEOMETRY, "lon", "lat", *BOX) if c in df.columns]
    if not explode_tags:
        return df.select("feature_id", *place, "tags" if keep_all_tags else F.map_filter("tags", lambda k, _: k.isin(list(flat))).alias("tags"))
    keys = sorted(flat)
    if keep_all_tags:
        keys = _few(df.select(F.explode(F.map_keys("tags")).alias("k")).distinct(), "tags; keep them as a map")
    wide = df.select("feature_id", *place, *[F.try_element_at("tags", F.lit(k)).alias(k) for k in keys])
    return group_features(wide, tags, keep=["feature_id", *place]) if grouped else drop_empty_columns(wide, ["feature_id", *place])


def read_overture(spark: SparkSession, paths: Sequence[str], *, area: tuple[float, float, float, float] | None = None, keep_empty: bool = True) -> DataFrame:
    """Wide features of several theme / type tables (feature_id, boxes, boolean columns)."""
    out = None
    for p in paths:
        df = spark.read.parquet(p)
        if area is not None:
            df = df.filter(f"minx <= {area[2]!r} and maxx >= {area[0]!r} and miny <= {area[3]!r} and maxy >= {area[1]!r}")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    keep = [c for c in ("feature_id", GEOMETRY, *BOX) if c in out.columns]
    return out if keep_empty else drop_empty_columns(out, keep)


def fetch_features(spark: SparkSession, areas: Sequence[str], tags: Mapping, fetch: Callable[[str, str, object], list[dict]], schema: str) -> DataFrame:
    """One query per (area, key, value), each in a task of its own; per element the first values win.

    ``fetch`` returns rows with element, id and the columns of ``schema``.
    """
    flat = merge_filters(tags)
    asks = [(k, a, key, json.dumps(v)) for k, (a, key, v) in enumerate((a, key, v) for a in areas for key, vs in flat.items() for v in ([True] if vs is True else vs))]
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(no, *(r.get(c) for c in names)) for no, a, k, v in b.itertuples(index=False) for r in fetch(a, k, json.loads(v))]
            yield pd.DataFrame(rows, columns=["ask", *names])

    todo = spark.createDataFrame(asks, "ask long, area string, key string, value string").repartition(max(1, len(asks)))
    found = todo.mapInPandas(run, f"ask long, {schema}")
    merged = merge_scans([found], ["element", "id"], "ask")
    merged = merged.withColumn("feature_id", F.concat_ws("/", "element", F.col("id").cast("string"))).drop("element", "id")
    return merged.filter(tag_mask(merged, flat))


def cached_query(query: str, folder: str, run: Callable[[str], object], *, retries: int = 5, wait: float = 60.0, busy: tuple = (TimeoutError, ConnectionError)) -> object:
    """A query's JSON answer, kept in a file named by the query's hash; waits and retries while the server is busy."""
    place = f"{folder.rstrip('/')}/{hashlib.sha256(query.encode()).hexdigest()}.json"
    system, path = opened(place)
    if system.get_file_info(path).is_file:
        with system.open_input_stream(path) as kept:
            return json.loads(kept.read())
    for turn in range(retries + 1):
        try:
            answer = run(query)
            break
        except busy:
            if turn == retries:
                raise
            time.sleep(wait)
    with committed(place) as out:
        out.write(json.dumps(answer).encode())
    return answer


def road_features(edges: DataFrame, columns: Sequence[str], *, wide: Mapping[str, Sequence[str]] | None = None, zones: Mapping | None = None, area: DataFrame | None = None, cell: float | None = None) -> DataFrame:
    """Road edges with lists exploded and values normalised, or as 0 / 1 flags per edge.

    ``columns`` hold strings or arrays; ``wide`` lists the values of each column that become flags
    "column-value". One aggregation per edge, maxima of flags, with partial maxima first.
    """
    kinds = dict(edges.dtypes)
    df = semi_join(edges, area, cell=cell, id_col="feature_id") if area is not None else edges
    for c in columns:
        if kinds[c].startswith("array"):
            df = df.withColumn(c, F.explode_outer(c))
    df = df.withColumns({c: road.normalise(c, F.col(c), zones) for c in columns})
    if wide is None:
        return df
    flags = {f"{c}-{v}": F.max(F.when(F.col(c) == v, 1).otherwise(0)).cast("short") for c, vs in wide.items() for v in vs}
    return fixed_columns(df.groupBy("feature_id").agg(*[f.alias(n) for n, f in flags.items()]), list(flags), ["feature_id"])


def load_tiles(
    areas: DataFrame, zoom: int, fetch: Callable[[int, int, int], bytes], *, save_to: str | None = None, extension: str = "png", collector: Callable[[str, bytes], object] | None = None, kind: str | None = None
) -> DataFrame:
    """Tiles of the areas with what is kept of their images in ``tile``.

    That is the bytes; with ``save_to`` the path of the file they went to; or whatever a collector
    of the caller's makes of a tile's id and bytes, of Spark type ``kind``. Each task fetches its own
    tiles. ``save_to`` is any folder that Arrow's file systems open and all executors share; a tile's file appears once it is whole.
    """
    if collector is not None and (save_to is not None or kind is None):
        raise ValueError("a collector needs the type it returns, and no folder to save to")
    tiles = slippy_regions(areas, zoom)

    def save(name: str, data: bytes) -> str:
        path = f"{save_to.rstrip('/')}/{name}.{extension}"
        with committed(path) as out:
            out.write(data)
        return path

    store = collector or (save if save_to is not None else lambda name, data: data)

    def run(batches):
        for b in batches:
            b["tile"] = [store(name, fetch(int(x), int(y), zoom)) for x, y, name in zip(b["x"], b["y"], b["region_id"], strict=True)]
            yield b

    kind = kind or ("binary" if save_to is None else "string")
    return tiles.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in tiles.dtypes) + f", tile {kind}")


def geocode(spark: SparkSession, queries: Sequence[str], search: Callable[[str], list[dict]]) -> DataFrame:
    """Regions by name: ``search`` returns display_name and a box per hit; the first one counts."""
    rows = []
    for q in queries:
        hits = search(q)
        if not hits:
            raise ValueError(f"nothing is called {q}")
        rows.append((hits[0]["display_name"], *(float(hits[0][c]) for c in BOX)))
    return spark.createDataFrame(rows, "region_id string, " + ", ".join(f"{c} double" for c in BOX))
