"""Exact duplicates against brute force and SQL."""

import collections
import hashlib

import duckdb
import pytest

from geoloom.llm import exactdedup
from geoloom.llm.queries import QUERIES, SQL


def brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = collections.Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            stays = i == keep and not kept
            kept |= stays
            out[i, keep, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def found(df):
    return collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exactdedup.exact_duplicates(df).collect())


def texts(rng):
    stem = "same beginning of many texts, longer than the first digit; " * 8
    out = [None, "", "", "a", "a", "A", "a ", "ä", "x" * 32, "x" * 31, "x" * 33, "x" * 288, "x" * 287, "x" * 288]
    out += [stem + str(rng.randint(0, 25)) for _ in range(150)] + [stem * 5 + rng.choice("pq") for _ in range(40)]
    out += ["one text that is most of the table"] * 200 + ["z" * 300_000 + e for e in ("", "1", "1")]
    return out


@pytest.mark.parametrize("few, held", [(64, 16 << 20), (3, 2_000), (1, 100), (10_000, 500)])
def test_equals_brute_force(spark, rng, monkeypatch, few, held):
    monkeypatch.setattr(exactdedup, "FEW", few)
    monkeypatch.setattr(exactdedup, "HELD", held)
    rows = list(enumerate(texts(rng)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, leader string, size int").repartition(7)
    assert found(df) == brute(rows)


def test_edges(spark):
    rows = [(None, "a"), (None, "a"), (3, "a"), (3, "a"), (None, "b"), (None, "b"), (7, None), (7, ""), (9, "")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)
    named = spark.createDataFrame([("b", "t"), ("a", "t"), (None, "t")], "doc_id string, text string")
    assert {r["keep_id"] for r in exactdedup.exact_duplicates(named).collect()} == {"b"}
    assert exactdedup.exact_duplicates(named.limit(0)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = db.execute(SQL["op11_exact_texts"]).df()
    got = QUERIES["op11_exact_texts"](spark, sf_dir).toPandas()[want.columns]
    order = ["doc_id", "kept"]
    assert got.sort_values(order).reset_index(drop=True).equals(want.sort_values(order).reset_index(drop=True))
