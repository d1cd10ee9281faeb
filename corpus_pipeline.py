"""Corpus pipeline: five operators in a row over `documents`, each stage written and read again."""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import mixing, neardup, packing, pii, quality
from geoloom.llm.common import bound_batches, materialise, scratch_dir, table
from geoloom.llm.queries import tokenizer_path


def _bounded(stage: Callable) -> Callable:
    """The stage with Arrow batches of bounded size; the session keeps the bound, since the caller runs the plan."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_bounded
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents the classifier scores below 0.7.

    Null and empty texts are scored from zero features, repeated rows alike; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_bounded
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five words, 0.8): that of the smallest id.

    Rows are told apart by a key of their own, so copies that repeat an id or have none go too;
    a row without id stays only where no row of its group has one. Null and empty texts link with
    nothing and stay; an empty table stays empty.
    """
    taken = {c.lower() for c in docs.columns}
    key = next(name for k in itertools.count() if (name := f"row_{k}") not in taken)
    rows = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = materialise(neardup.near_duplicates(rows, id_col=key, words=5, percent=80).select(F.col(key).alias("row"), "component_id"), "groups")
    placed = found.join(rows.select(F.col(key).alias("row"), "doc_id"), "row")
    kept = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("kept"), F.count(F.lit(1)).alias("size"))
    kept = materialise(kept.filter("size > 1"), "kept")  # written, so that the join below is of two tables and a large group can be split
    dropped = found.join(kept, "component_id").filter("row <> kept.row").select(F.col("row").alias(key))
    return rows.join(materialise(dropped, "dropped"), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@_bounded
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by the name of its kind.

    Null texts stay null, empty ones empty; repeated rows change alike; an empty table stays empty.
    """
    found = pii.detect(docs, carry=tuple(c for c in docs.columns if c != "text"), redact=True)
    own = {"text": F.col("redacted"), "n_chars": F.coalesce(F.length("redacted").cast("long"), F.col("row.n_chars"))}
    return found.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@_bounded
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their target weights.

    A null source is one of its own; texts without words count nothing; repeated rows share their
    draw; an empty table stays empty.
    """
    return mixing.mix(docs)


@_bounded
def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises and packs what is left into sequences of 2048 tokens, ids included.

    A null or empty text is its end id alone; repeated rows are packed one by one; an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=True, group_tokens=1_000_000, cached_chunks=100_000)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
