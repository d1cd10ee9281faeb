"""Neighbourhoods as edge tables (region_id, neighbour_id, distance)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import grid, h3
from geoloom.operators.spatial_join import touches_join
from geoloom.storage import written


def tile_edges(tiles: DataFrame, k: int, zoom: int) -> DataFrame:
    """Pairs of given tiles within Chebyshev distance k, by the closed-form ring: missing tiles
    don't lengthen a distance. One equi-join; the centre is at distance 0."""
    near = tiles.select("region_id", F.explode(grid.disk(F.col("x"), F.col("y"), k)).alias("c"))
    near = near.select("region_id", F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.col("c.distance").alias("distance"))
    return near.join(tiles.select(F.col("region_id").alias("neighbour_id"), "x", "y"), ["x", "y"]).select("region_id", "neighbour_id", "distance")


def h3_edges(cells: DataFrame, k: int) -> DataFrame:
    """Pairs of given H3 cells (cell) within k steps of each other, the cell itself at distance 0.

    Without the join, that is for neighbours that need not be given, explode ``h3_disk``.
    """
    near = cells.select(F.col("cell").alias("a"), F.explode(h3.h3_disk(F.col("cell"), k)).alias("c")).select("a", F.col("c.cell").alias("b"), "c.distance")
    found = near.join(cells.select(F.col("cell").alias("b")).distinct(), "b", "left_semi")
    return found.select(h3.h3_text(F.col("a")).alias("region_id"), h3.h3_text(F.col("b")).alias("neighbour_id"), "distance")


def adjacency_edges(regions: DataFrame, *, cell: float | None = None) -> DataFrame:
    """Regions that touch, at distance 1."""
    return touches_join(regions, cell=cell).withColumn("distance", F.lit(1))


def edges_from_lookup(spark, lookup: dict) -> DataFrame:
    """Edges of a dictionary region -> neighbours."""
    return spark.createDataFrame([(a, b, 1) for a, bs in lookup.items() for b in sorted(bs)], ["region_id", "neighbour_id", "distance"])


def edges_from_function(regions: DataFrame, neighbours: Callable, id_type: str = "string") -> DataFrame:
    """Edges of a user's function region -> iterable of neighbours, a batch at a time."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([(r, n, 1) for r in batch["region_id"] for n in neighbours(r)], columns=["region_id", "neighbour_id", "distance"])

    return regions.select("region_id").mapInPandas(run, f"region_id {id_type}, neighbour_id {id_type}, distance int")


def up_to_distance(edges: DataFrame, distance: int, *, include_center: bool = False, roots: DataFrame | None = None) -> DataFrame:
    """Shortest hops up to a distance, by a breadth-first search from 64 starts at once.

    Starts are numbered in the order of their ids, so that neighbours mostly share a block of 64. A row of the state is a node and a
    block: which of its starts have reached the node (a bit each), which did so in the last round, and in which round each came. A
    round sends the last round's bits along the edges and merges them with the state by one aggregation, with
    partial sums before its shuffle; no pair of regions is a row before the end. Each round but the last is
    written to the shared folder, so the plan does not grow, and a longer search ends with the last new
    bit. A distance below 0 gives nothing. ``roots`` bounds the starts (region_id).
    """
    if distance < 0:
        return edges.limit(0).select("region_id", F.col("region_id").alias("neighbour_id"), F.lit(0).alias("distance"))
    links = edges.select("region_id", F.col("neighbour_id").alias("next"), F.expr("distance = 1 and region_id <> neighbour_id").alias("step")).distinct()
    links = written(links, "links")
    steps = links.filter("step").select(F.col("region_id").alias("node"), "next")
    ordered = (roots if roots is not None else links).select("region_id").distinct().repartitionByRange("region_id").sortWithinPartitions("region_id")
    starts = written(ordered.select("region_id", F.monotonically_increasing_id().alias("root")), "starts")
    bit = F.expr("shiftleft(1L, cast(root & 63 AS int))")
    state = starts.select(
        F.col("region_id").alias("node"), F.shiftright("root", 6).alias("block"), bit.alias("seen"), F.array(F.struct(F.lit(0).alias("distance"), bit.alias("bits"))).alias("came")
    )
    state = state.withColumn("front", F.col("seen"))
    nothing = F.lit(0).cast("long")
    for d in range(1, distance + 1):
        sent = state.filter("front <> 0").join(steps, "node").select(F.col("next").alias("node"), "block", nothing.alias("seen"), F.col("front").alias("got"), F.lit(None).cast(state.schema["came"].dataType).alias("came"))
        both = state.select("node", "block", "seen", nothing.alias("got"), "came").unionByName(sent)
        merged = both.groupBy("node", "block").agg(F.bit_or("seen").alias("seen"), F.bit_or("got").alias("got"), F.first("came", ignorenulls=True).alias("came"))
        new = F.col("got").bitwiseAND(F.bitwise_not("seen"))
        came = F.coalesce("came", F.array().cast(state.schema["came"].dataType))
        came = F.when(new != 0, F.array_append(came, F.struct(F.lit(d).alias("distance"), new.alias("bits")))).otherwise(came)
        state = merged.select("node", "block", F.col("seen").bitwiseOR(new).alias("seen"), came.alias("came"), new.alias("front"))
        if d == distance:
            break  # the last round is part of what is returned
        state = written(state, "hops")
        if d > 3 and not state.filter("front <> 0").limit(1).count():
            break
    pairs = state.select(F.col("node").alias("neighbour_id"), "block", F.explode("came").alias("came")).filter(F.col("came.distance") >= (0 if include_center else 1))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("came.bits", b) == 1)
    pairs = pairs.select("neighbour_id", F.col("came.distance").alias("distance"), "block", F.explode(bits).alias("bit"))
    return pairs.withColumn("root", F.col("block") * 64 + F.col("bit")).join(starts, "root").select("region_id", "neighbour_id", "distance")


def at_distance(edges: DataFrame, distance: int, *, include_center: bool = False, roots: DataFrame | None = None) -> DataFrame:
    """Shortest hops of a distance exactly; at 0 the region itself if the centre is included."""
    if distance <= 0:
        found = up_to_distance(edges, min(distance, 0), include_center=True, roots=roots)
        return found if include_center else found.limit(0)
    return up_to_distance(edges, distance, roots=roots).filter(F.col("distance") == distance)


class Neighbourhood:
    """Per-region questions over an edge table; a user's own edges work alike."""

    def __init__(self, edges: DataFrame, include_center: bool = False):
        self.edges, self.include_center = edges, include_center

    def _ids(self, found: DataFrame) -> set:
        return {r["neighbour_id"] for r in found.select("neighbour_id").distinct().collect()}

    def _root(self, region) -> DataFrame:
        return self.edges.sparkSession.createDataFrame([(region,)], "region_id " + dict(self.edges.dtypes)["region_id"])

    def _center(self, override: bool | None) -> bool:
        return self.include_center if override is None else override

    def neighbours(self, region, include_center: bool | None = None) -> set:
        return self.up_to(region, 1, include_center)

    def up_to(self, region, distance: int, include_center: bool | None = None) -> set:
        own = self._center(include_center)
        return self._ids(up_to_distance(self.edges, distance, include_center=own, roots=self._root(region)))

    def at(self, region, distance: int, include_center: bool | None = None) -> set:
        own = self._center(include_center)
        return self._ids(at_distance(self.edges, distance, include_center=own, roots=self._root(region)))


def plot_table(regions: DataFrame, edges: DataFrame, region, max_distance: int = 100) -> DataFrame:
    """Regions tagged selected / neighbour / other, with their hop distance, for drawing."""
    root = regions.filter(F.col("region_id") == region).select("region_id")
    near = up_to_distance(edges, max_distance, include_center=True, roots=root).select(F.col("neighbour_id").alias("region_id"), "distance")
    tag = F.when(F.col("distance") == 0, "selected").when(F.col("distance").isNotNull(), "neighbour").otherwise("other")
    return regions.join(near, "region_id", "left").withColumn("tag", tag)
