"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import materialise


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """The smallest id each node can reach: (node, component), for the nodes of ``edges`` (a, b).

    Labels start as the smaller of a node and its least neighbour; each round takes the least
    label among neighbours and then follows labels of labels, so the rounds grow with the log
    of the longest chain. Minima are pre-aggregated before each shuffle and a hub's edges are a
    plain join side that adaptive execution can split. Each round is written to the shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialise(both, "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    labels = materialise(labels, "labels")
    for _ in range(max_rounds):
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy("a")
            .agg(F.min("component").alias("m"))
            .select(F.col("a").alias("node"), "m")
        )
        stepped = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = stepped.join(jump, "component", "left").select("node", "was", F.coalesce(F.least("component", "next"), F.col("component")).alias("component"))
        moved = materialise(moved, "labels")
        labels = moved.select("node", "component")
        if not moved.filter("was <> component").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels
