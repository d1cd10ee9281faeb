"""Near-duplicates, vector search, repeated strings and components, each against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import graph, neardup, suffixdedup, vectors
from geoloom.llm.queries import QUERIES, SQL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_groups(docs, words, percent=80):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = set(zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else ({tuple(w)} if w else set())
    inverse, parent = collections.defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in inverse[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            inverse[x].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def families(rng):
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randint(0, 30))
    out = []
    for _ in range(8):
        base = [word() for _ in range(rng.randint(3, 80))]
        family = [base]
        for _ in range(30):
            w = list(rng.choice(family))
            for _ in range(rng.randint(0, max(1, len(base) // 14))):
                w[rng.randrange(len(w))] = word()
            family.append(w)
        out += [" ".join(w) for w in family]
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, rng, words):
    texts = [*families(rng), None, "", "one", "ONE", "one two", "  one\ttwo "]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("key"), F.lit("x").alias("id"), F.lit(2).alias("component")).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, words=words).collect()}
    assert got == brute_groups(rows, words)


def test_near_duplicates_in_tiny_blocks(spark, rng, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 400)
    monkeypatch.setattr(neardup, "LARGE", 150)
    rows = list(enumerate(families(rng)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert got == brute_groups(rows, 2)


def test_blocks_of_small_sets_are_bounded(spark, monkeypatch):
    sizes: list = []
    monkeypatch.setattr(neardup, "SETS", 20)
    members = spark.createDataFrame([("k", i, i, 3) for i in range(400)], "key string, id long, component long, n long")
    sets = spark.createDataFrame([(i, bytearray(np.sort(np.array([i // 2, 10_000 + i // 2, 20_000 + i // 2], np.uint64)).tobytes())) for i in range(400)], "id long, items binary")
    keep = neardup.materialise
    monkeypatch.setattr(neardup, "materialise", lambda df, label: (out := keep(df, label), label == "blocks" and sizes.extend(r[0] for r in out.select(F.size("docs")).collect()))[0])
    found = {(r["a"], r["b"]) for r in neardup.block_links(members, sets, 80).collect()}
    assert found == {(2 * k + 1, 2 * k) for k in range(200)}
    assert len(sizes) > 10 and max(sizes) < 60


def test_near_duplicates_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES["op8_near_texts"](spark, sf_dir).collect()
    want = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()], 2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicate_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, "z " * 50_000), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"], r["n_shingles"]) for r in neardup.near_duplicates(df).collect()}
    assert got == {None: (None, False, 2), 1: (1, True, 2), 2: (1, False, 2), 3: (3, True, 1), 4: (4, True, 0)}
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_sketches():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in (1, 2, 5, 30, 300, 3000)]
    many = neardup.sketch_many(sets, 120)
    assert (many == np.stack([neardup.sketch(s, 120) for s in sets])).all() and (many != np.iinfo(np.uint64).max).all()
    base = rng.integers(0, 1 << 60, 2000).astype(np.uint64)
    for share in (0.3, 0.8):
        k = int(2000 * 2 * share / (1 + share))
        a, b = base, np.concatenate([base[:k], rng.integers(0, 1 << 60, 2000 - k).astype(np.uint64)])
        s = neardup.sketch_many([np.unique(a), np.unique(b)], 960)
        assert abs((s[0] == s[1]).mean() - share) < 0.08


def test_components(spark):
    rng = np.random.default_rng(1)
    chain = [(k, k + 1) for k in range(100, 140)]
    random = [(int(a), int(b)) for a, b in rng.integers(200, 260, (40, 2))]
    edges = chain + random + [(5, 5), (9, 300), (9, 301)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: label[k] for a, b in edges if a != b for k in (a, b)}


VEC = "vec_id long, embedding array<float>, label int"


def vector_rows(dims=8, n=150):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, dims))
    x = centers[rng.integers(0, 12, n)] + rng.normal(0, 0.12, (n, dims))
    rows = [(k, [float(v) for v in r], k % 3) for k, r in enumerate(x.astype(np.float32))]
    rows += [(n, rows[3][1], 0), (n + 1, [2 * v for v in rows[3][1]], 0), (n + 2, None, 1), (n + 3, [0.0] * dims, 1), (n + 4, [1.0, None] + [0.0] * (dims - 2), 1)]
    rows += [(n + 5, [float("nan")] * dims, 1), (n + 6, [float("inf")] + [0.0] * (dims - 1), 1), (n + 7, [1.0, 2.0], 1), (n + 8, [2.0, 4.0], 1), (n + 9, [], 1), (n + 10, [1e-30] * dims, 0)]
    return rows


def brute_links(rows, least=0.9):
    good = {i: np.array(v, float) for i, v, _ in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    links = {i: {j for j, w in good.items() if j != i and len(w) == len(v) and v @ w / np.sqrt((v @ v) * (w @ w)) >= least} for i, v in good.items()}
    out = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), set()) - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links.get(i, ())), min(seen))
    return out


@pytest.mark.parametrize("interval", [7, 4096])
def test_epsilon_grid_join(spark, interval):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VEC).select("*", F.lit(1).alias("id"), F.lit(2).alias("rep"), F.lit(3).alias("n")).repartition(3)
    got = vectors.epsilon_grid_join(df, interval=interval, axes=6).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_links(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert vectors.epsilon_grid_join(df.limit(0)).count() == 0


def test_pairs_of_near_intervals_by_level(spark):
    rng = np.random.default_rng(3)
    lo = np.round(rng.uniform(0, 20, (300, 2)), 2)
    hi = lo + np.round(rng.uniform(0, 1, (300, 2)), 2)
    block = [(k % 7 << 32) + k // 7 for k in range(300)]
    d = [1 + k % 2 for k in range(300)]
    df = spark.createDataFrame([(b, n, x, y) for b, n, x, y in zip(block, d, lo.tolist(), hi.tolist(), strict=True)], "block long, d int, lo array<float>, hi array<float>")
    got = sorted((r["i"], r["j"]) for r in vectors.interval_pairs(df, 0.8, fan=4).collect())
    gap = lambda i, j: np.hypot(*np.maximum(0, np.maximum(lo[i] - hi[j], lo[j] - hi[i])))
    want = sorted((block[i], block[j]) for i in range(300) for j in range(300) if block[i] <= block[j] and d[i] == d[j] and gap(i, j) <= 0.8)
    assert got == want
    assert vectors.interval_pairs(df.limit(0), 0.8).count() == 0


def brute_top(rows, every=20, k=20):
    good = {i: np.floor(64 * np.array(v, float)) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    width = max(map(len, good.values()))
    good = {i: np.pad(v, (0, width - len(v))) for i, v in good.items()}
    out = []
    for q in sorted(good):
        if q % every == 0:
            best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("tree_rows", [30, 4096])
def test_top_inner_products(spark, tree_rows):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VEC).select("*", F.lit(1).alias("tree"), F.lit(2).alias("rank")).repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vectors.top_inner_products(df, tree_rows=tree_rows, query_rows=3).collect())
    assert got == brute_top(rows)
    assert vectors.top_inner_products(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:4], VEC)
    assert vectors.top_inner_products(few).count() == 3


def test_queries_of_a_region_are_searched_for_together(spark, tmp_path, monkeypatch):
    rng, folder = np.random.default_rng(4), str(tmp_path)
    x = rng.integers(-4, 5, (1200, 6))

    class Spy(vectors.MTree):
        def search(self, q, *rest):
            with open(f"{folder}/{len(self.ids)}-{int(self.ids[0])}", "a") as f:
                f.write(f"{len(q)}\n")
            return super().search(q, *rest)

    monkeypatch.setattr(vectors, "MTree", Spy)
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x.tolist())], VEC)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vectors.top_inner_products(df, every=4, scale=1.0, tree_rows=300).collect()}
    scores = x @ x.T
    for i in range(0, 1200, 4):
        order = sorted((-int(s), j) for j, s in enumerate(scores[i]) if j != i)[:20]
        assert [got[i, k + 1] for k in range(20)] == [(j, -s) for s, j in order]
    asked = [int(n) for f in tmp_path.iterdir() for n in f.read_text().split()]
    assert sum(asked) > 300 and max(asked) > 20 and len(asked) < 40


def test_rows_with_equal_ids_are_vectors_of_their_own(spark, tmp_path):
    import duckdb

    near, far = [1.0, 0.02], [-3.0, 9.0]
    rows = [(1, [1.0, 0.0], 0), (1, [9.0, 0.0], 0), (1, far, 1), (20, [1.0, 0.0], 0), (20, near, 0), (20, near, 0), (7, [-1.0, 3.01], 2), (8, [0.0, -5.0], 0), (9, None, 1), (9, [0.0, 0.0], 1), (None, near, 0)]
    df = spark.createDataFrame(rows, VEC).repartition(3)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name, columns in (("op4_top_k", ["query_id", "rank", "vec_id", "score"]), ("op5_near_vectors", ["vec_id", "n_links", "component_id", "kept"])):
        plain = lambda rows: sorted(rows, key=str)
        got = plain(tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(tmp_path)).collect())
        assert got == plain(db.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall())
    assert vectors.epsilon_grid_join(df).count() == len(rows)


def test_m_tree_skips_pages():
    rng = np.random.default_rng(3)
    x = (rng.integers(-3, 4, (3000, 3)) + np.repeat(rng.integers(-400, 400, (30, 3)), 100, 0)).astype(np.int64)
    tree = vectors.MTree(np.arange(3000), x, page=20)
    visits = []
    plain = tree._visit
    tree._visit = lambda page, who, *rest: (visits.append(len(who)), plain(page, who, *rest))
    q = x[::97]
    scores, ids = tree.search(q, np.arange(3000)[::97], 5)
    for k, row in enumerate(q):
        order = sorted((-int(row @ v), i) for i, v in enumerate(x) if i != k * 97)[:5]
        assert [(-int(s), int(i)) for s, i in zip(scores[k], ids[k], strict=True)] == order
    assert sum(visits) < 0.5 * len(q) * len(tree.pages)
    assert (vectors.MTree(np.zeros(0, int), np.zeros((0, 3))).search(q, np.zeros(len(q), int), 2)[0] == -np.inf).all()


@pytest.mark.parametrize("name", ["op4_top_k", "op5_near_vectors", "op1_mixing"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = c.execute(SQL[name]).df()[got.columns]
    key = list(got.columns)
    assert got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()


def brute_removal(docs, least=50):
    first, out = {}, {}
    raw = {i: (t or "").encode() for i, t in docs}
    for i in sorted(raw):
        for k in range(len(raw[i]) - least + 1):
            first.setdefault(raw[i][k : k + least], i)
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - least + 1):
            if first[b[k : k + least]] < i:
                gone[k : k + least] = b"\x01" * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def removal(df, **options):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdedup.repeated_strings(df, **options).collect()}


@pytest.mark.parametrize("alphabet", ["ab", "abcde ", "é1"])
def test_repeated_strings_equal_brute_force(spark, rng, alphabet):
    piece = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(20, 120)))
    shared = [piece() for _ in range(10)]
    rows = []
    for i in range(150):
        t = "".join(rng.choice([*shared, piece()])[rng.randint(0, 30) :] for _ in range(rng.randint(0, 6)))
        t = "xy" * rng.randint(0, 120) if i % 37 == 0 else "z" * rng.randint(30, 300) if i % 41 == 0 else t
        rows.append((i * 3, t if i % 29 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("id"), F.lit(2).alias("bucket"), F.lit(3).alias("dest")).repartition(4)
    assert removal(df, group_bytes=3000, run_samples=800) == brute_removal(rows)


@pytest.mark.parametrize("ranges", [4096, 3])
def test_hot_strings_are_dealt_over_tasks(spark, rng, monkeypatch, ranges):
    dealt = []

    class Watched(suffixdedup.Deal):
        def __init__(self, *args):
            super().__init__(*args)
            dealt.append(self)

    monkeypatch.setattr(suffixdedup, "Deal", Watched)
    monkeypatch.setattr(suffixdedup, "MAX_RANGES", ranges)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, near = word(90), [word(25) for _ in range(6)]
    rows = []
    for i in range(160):
        t = word(rng.randint(0, 60))
        if i % 3:
            t = t + rng.choice(["", *near]) + line + rng.choice(["", *near]) + word(rng.randint(0, 60))
        rows.append((rng.randint(0, 10**6) * 200 + i, t + (line[20:] if i % 5 == 0 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert removal(df, group_bytes=4000, run_samples=700, bucket_bytes=1200) == brute_removal(rows)
    assert len(dealt[0].hot) and dealt[0].parts.min() > 1


def test_repeated_strings_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert removal(docs) == brute_removal([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_repeated_string_edges(spark):
    t = "the quick brown fox jumps over the lazy dog and then rests a while"
    rows = [(None, t), (7, t), (7, t), (9, t), (10, t[:49]), (11, ""), (12, None), (13, "q" * 30_000), (14, "q" * 49)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixdedup.repeated_strings(df).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["n_removed"]) for r in got if r["doc_id"] is not None) == [(7, 0), (7, 0), (9, len(t)), (10, 0), (11, 0), (12, 0), (13, 0), (14, 0)]
    assert suffixdedup.repeated_strings(df.limit(0)).count() == 0


def test_repeated_strings_of_rows_that_share_an_id(spark, rng):
    word = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n))
    a, b, c = word(80), word(80), word(70)
    rows = [(1, a), (1, a + b), (2, b), (-1, c), (-1, word(30) + c), (None, c), (3, c + a), (3, a), (3, word(9) + b + c), (3, c + a), (4, b)]
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49 if i is not None else 0):
            first[t[k : k + 50]] = min(i, first.get(t[k : k + 50], i))
    want = []
    for i, t in rows:
        gone = {k + j for k in range(len(t) - 49) for j in range(50) if i is not None and first[t[k : k + 50]] < i}
        want.append((i, hashlib.sha256("".join(x for k, x in enumerate(t) if k not in gone).encode()).hexdigest(), len(gone)))
    for parts in (1, 4):
        got = suffixdedup.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted(((r["doc_id"], r["kept_sha256"], r["n_removed"]) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("width", "runs"), [(20, 1), (20, 6), (82, 9)])
def test_merge_of_front_coded_runs(width, runs):
    rng = np.random.default_rng(width + runs)
    parts, keys = [], []
    for _ in range(runs):
        k = rng.integers(97, 99, (int(rng.integers(0, 2000)), width)).astype(np.uint8)
        k[: len(k) // 2, : width - 6] = 97
        part = suffixdedup.sort_run(k, np.arange(len(k)), np.arange(len(k)))
        part = suffixdedup.unpack_run(suffixdedup.pack_run(part)) if len(k) else part
        parts.append(part)
        keys += [bytes(x) for x in part.keys]
    at, lcp = suffixdedup.merge_runs(parts)
    merged = [keys[i] for i in at]
    assert merged == sorted(keys)
    for a, b, n in zip(merged, merged[1:], lcp[1:], strict=False):
        assert a[:n] == b[:n] and (n == width or a[n] != b[n])
