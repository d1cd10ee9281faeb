"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import hash_unit, materialise, word_count


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_repeat: float) -> DataFrame:
    """Word targets per source by water filling.

    ``sizes`` has (source, size) rows. The sources, ordered by code point with null last,
    weigh ``weights`` in turn. They share ``share`` times all words; no target passes
    ``max_repeat`` times its source's words, the excess going to the others by weight.
    In ascending order of cap / weight the capped sources are a prefix, so the water level
    is the greatest of (what is left before a row) / (weights from that row on).
    The unpartitioned windows see one row per source, after aggregation.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    wheel = F.array(*[F.lit(int(w)) for w in weights])
    ranked = totals.withColumn("rn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn(
        "w", F.element_at(wheel, ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    )
    cap = F.lit(float(max_repeat)) * F.col("source_size")
    by_cap = Window.orderBy((cap / F.col("w")).asc(), F.col("rn").asc())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    levels = ranked.select(
        "source",
        "source_size",
        "w",
        F.sum("source_size").over(everything).alias("all_size"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.sum("w").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("w_from"),
    )
    level = (F.lit(float(share)) * F.col("all_size") - F.lit(float(max_repeat)) * F.col("size_before")) / F.col("w_from")
    return levels.select(
        "source",
        "source_size",
        F.least(
            F.lit(float(max_repeat)) * F.col("source_size"), F.col("w") * F.max(level).over(everything)
        ).alias("target"),
    )


def mix_plan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = ("doc_id",),
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    max_repeat: float = 2.0,
    seed: str = "mix-1",
) -> DataFrame:
    """How often each document goes into the mix.

    Returns one row per document: ``row`` (struct of the ``carry`` columns), ``size`` (words),
    ``source_size``, ``target`` and ``copies`` = floor(rate) plus one Bernoulli copy, drawn from
    a hash of the id and the seed with the fraction as probability, where rate = target /
    source_size. Pass one aggregates words per source (partial sums before the shuffle, so a
    source holding most rows is harmless); the table of targets is written, so its measured
    size decides whether Spark broadcasts it or joins by sort and merge, and in the latter
    case adaptive execution splits a hot source. The documents are never shuffled otherwise.

    Edge cases: null text has size 0; null source is a source of its own; a source without
    words has rate 0; equal rows are separate documents that share one draw; an empty table
    gives an empty plan. Other columns are only looked at through ``carry`` and may have any name.
    """
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.col(f"`{id_col}`").alias("mix_id"),
        F.col(f"`{source_col}`").alias("mix_source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
    )
    targets = materialise(
        source_targets(base.select(F.col("mix_source").alias("source"), "size"), weights, share, max_repeat), "targets"
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return (
        base.join(targets, F.col("mix_source").eqNullSafe(F.col("source")))
        .withColumn("copies", (whole + (hash_unit(F.col("mix_id"), seed=seed) < rate - whole).cast("long")).cast("long"))
        .select("row", "size", "source_size", "target", "copies")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents' own columns, each row as often as the plan says."""
    plan = mix_plan(docs, carry=docs.columns, **options).filter(F.col("copies") > 0)
    return plan.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
