"""The audit of sources against brute force and SQL."""

import collections
import re

import duckdb
import numpy as np
import pytest

from geoloom.llm import divergence
from geoloom.llm.queries import QUERIES, SQL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, top=200):
    df, n, langs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        df[lang].update(set(terms))
        n[lang, source].update(terms)
    out = []
    f = lambda p, q: (p - q) * (p - q) // q
    for lang, sources in langs.items():
        kept = [t for t, c in df[lang].items() if c >= 3]
        counts = {s: {t: n[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(c[t] for c in counts.values()) for t in kept}
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r[c] for c in COLUMNS) for r in divergence.source_divergence(df, **options).collect())


def corpus(rng):
    rows = []
    for k in range(300):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", *[f"s{k}" for k in range(12)], "é", None])
        weight = len(source) + ord(source[-1]) % 5 if source else 1
        rows.append((" ".join(rng.choice(["The", "the", "Ärger", "x1y", "don't", *[f"w{chr(97 + (j * weight) % 26)}{'z' * (j % 4)}" for j in range(30)]]) for _ in range(rng.randint(0, 50))), lang, source))
    return [*rows, ("few words only here", "rare", "a"), (None, "rare", "b"), ("", "none", None), ("1 2 3", "none", "q")]


@pytest.mark.parametrize("bits, options", [(14, {}), (3, {"slots": 3, "rounds_at_once": 2, "top": 7})])
def test_equals_brute_force(spark, rng, monkeypatch, bits, options):
    monkeypatch.setattr(divergence, "BITS", bits)
    rows = corpus(rng)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, g int, term string").repartition(4)
    assert found(df, **options) == brute(rows, options.get("top", 200))


def test_edges(spark):
    schema = "text string, lang string, source string"
    assert found(spark.createDataFrame([], schema)) == []
    rows = [("same text " * 3, "en", "a")] * 4 + [("other " * 100_000, "en", "b")]
    assert found(spark.createDataFrame(rows, schema)) == brute(rows)


def test_blocks_follow_from_the_terms_not_from_the_ranges(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BITS", 3)
    terms = spark.createDataFrame([("de" if k % 3 else "en", f"w{k:03}".encode(), k) for k in range(100)], "lang string, term binary, total long")
    for key, value in (("spark.sql.shuffle.partitions", "29"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(key, value)
    try:
        rows = sorted(divergence.numbered(terms).collect(), key=lambda r: (r["lang"], r["term"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r["id"], r["block"], r["at"]) for r in rows] == [(k, k >> 3, k & 7) for k in range(100)]


def test_shares_are_exact():
    rng = np.random.default_rng(0)
    for total, terms in ((0, 1), (10**15, 10**9), (7, 3)):
        counts = rng.integers(0, total + 1, 200)
        assert divergence.shares(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 1) // (total + terms) for c in counts]


def test_query_equals_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(db.execute(SQL["op13_divergence"]).fetchall())
    assert sorted(tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_divergence"](spark, sf_dir).collect()) == want
