"""Phrases against brute force and SQL."""

import collections
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from geoloom.llm import phrases, words
from geoloom.llm.queries import QUERIES, SQL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, absorb=50, top=2000):
    f = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, n in f.items():
        total = sum(c for g, c in n.items() if len(g) == 1)
        longest = collections.Counter()
        for g, a in n.items():
            if len(g) == 3 and a >= least:
                for inner in (g[:2], g[1:]):
                    longest[inner] = max(longest[inner], a)
        ranked = []
        for g, a in n.items():
            if len(g) > 1 and a >= least and not (longest[g] and 100 * longest[g] >= absorb * a):
                score, k = min(((1_000_000 * a * a) // (n[g[:k]] * n[g[k:]]), k) for k in range(1, len(g)))
                ranked.append((-score, -a, " ".join(g).encode(), n[g[:k]], n[g[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, total, -s) for r, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def found(df, **options):
    return sorted(tuple(r[c] for c in COLUMNS) for r in phrases.collocations(df, **options).collect())


def corpus(rng):
    word = lambda: rng.choice(["the", "of", "THE", "Ärger", "ärger", "a\x00b", *[f"w{k}" for k in range(25)]])
    join = lambda: rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! ?"])
    rows = []
    for k in range(400):
        text = "".join(word() + join() for _ in range(rng.randint(0, 60)))
        rows.append((text + ("new york city " * rng.randint(0, 2)) + f"once{k}", rng.choice(["en", "en", "de", None])))
    return [*rows, (None, "en"), ("", None), (" \t.", "xx"), *[("repeated row of words", "de")] * 12]


@pytest.mark.parametrize("held, block", [(2_000_000, 8 << 20), (500, 3_000)])
def test_equals_brute_force(spark, rng, monkeypatch, held, block):
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "BLOCK", block)
    rows = corpus(rng)
    df = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, a int, word string").repartition(5)
    assert found(df) == brute(rows)
    assert found(df, least=3, top=20) == brute(rows, least=3, top=20)


def test_edges(spark):
    assert found(spark.createDataFrame([], "text string, lang string")) == []
    assert found(spark.createDataFrame([("a b", "en")], "text string, lang string")) == []
    rows = [("x y " * 200_000, "en")]
    assert found(spark.createDataFrame(rows, "text string, lang string")) == brute(rows)


def test_words_and_keys():
    texts = pa.array(["One two,three", "", "four  FIVE.", ".", "six"])
    w = words.split_words(texts.slice(1), phrases.CLASSES)
    assert w.names.take(pa.array(w.code)).to_pylist() == [b"four", b"five", b"six"] and w.fresh.tolist() == [True, False, True] and w.text.tolist() == [1, 1, 3]
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 300, (5_000, 3))
    keys, counts = phrases.radix_sorted(phrases._pack(ids, 2), np.ones(5_000, np.int64))
    want, n = np.unique(ids, axis=0, return_counts=True)
    assert (phrases._unpack(keys, 2) == want).all() and (counts == n).all()


def test_query_equals_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(db.execute(SQL["op12_phrases"]).fetchall())
    assert sorted(tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_phrases"](spark, sf_dir).collect()) == want
