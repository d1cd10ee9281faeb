"""Tokens, mixing, packing, token files, quality, language and personal data."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import langid, mixing, packing, pii, quality, tokens, wavelet
from geoloom.llm.queries import QUERIES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = "word_bpe_49k.json"
BYTE = "byte_bpe_50k.json"
ODD = ["", " ", "\n", "a  b", " a\n b ", "don't I'll\n\n x", "<|endoftext|> hi", "é x́ y", "ΑΣ ΑΣ b", "Hello, world. foo., x", "x" * 5000, "İstanbul ŚŻ. ǅ.", "a\tb\x1cc", "😀!! ok"]


def clashing(spark, rows):
    """Documents with nulls, empties, repeats and columns named like the operators' own."""
    df = spark.createDataFrame(rows, DOCS)
    extra = ["row", "size", "copies", "target", "id", "text_", "ids", "score", "predicted", "bands", "key", "component", "n"]
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(extra)])


EDGE = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (4, "word " * 3000, "de", "b", 15000), (None, "no id here", "en", "b", 10), (5, "Call +1 (644) 555-7859", None, "b", 22)]


@pytest.mark.parametrize(("name", "mode"), [(WORD, "dropped"), (BYTE, "spaced"), (BYTE, "whole")])
def test_chunked_ids_are_the_tokenizers_ids(rng, name, mode):
    from tokenizers import Tokenizer

    coder = tokens.ChunkEncoder(tokenizer_path(name), mode)
    texts = ODD + ["".join(rng.choice(" \n\t ab.,1'éA<ΣsŚ\x1c\x85 　*") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    fresh = Tokenizer.from_file(tokenizer_path(name))
    want = [x.ids for x in fresh.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # cold and warm
        assert [x.tolist() for x in coder.encode(texts)] == want
    assert coder.encode([None])[0].tolist() == []


@pytest.mark.parametrize(("name", "mode"), [(WORD, "dropped"), (BYTE, "spaced"), (BYTE, "whole")])
def test_ids_are_those_of_the_tokenizer_as_loaded(rng, name, mode):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer_path(name))
    ends = {x.content for x in fresh.get_added_tokens_decoder().values()}
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "<|", " ", "\n", "  ", "word", " see", "Ünit", "x.", "'s", "12", "\x85"]
    texts = ["see <|endoftext|> here", "<|endoftext|>", "<|endoftext|><|startoftext|>", "a<|endoftext|>b <|endoftext|>\n"]
    texts += ["".join(rng.choices(marks, k=rng.randint(1, 9))) for _ in range(3000)]
    want = [x.ids for x in fresh.encode_batch(texts, add_special_tokens=False)]
    assert any(fresh.token_to_id(t) in x for t in ends for x in want)
    coder = tokens.ChunkEncoder(tokenizer_path(name), mode)
    for _ in range(2):  # cold and warm
        assert [x.tolist() for x in coder.encode(texts)] == want


@pytest.mark.parametrize(("name", "mode"), [(WORD, "dropped"), (BYTE, "spaced")])
def test_every_letter_before_a_mark(name, mode):
    from tokenizers import Tokenizer

    fresh, coder = Tokenizer.from_file(tokenizer_path(name)), tokens.ChunkEncoder(tokenizer_path(name), mode)
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha() and not 0x3400 <= c < 0xD7A4 and not 0x17000 <= c < 0x18D00 and c < 0x20000]
    odd = [c for c in letters if not coder._ends_word(c)]
    assert "\u0130" in odd or mode == "spaced"
    texts = [f"w{c}, {c}." for c in letters] + [f"{c}{m} a{c}{m}{m}" for c in [*odd, "e", "\u00e9", "\u03a3"] for m in "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"]
    texts += ["KED\u0130.", "BELED\u0130YES\u0130, \u0130STANBUL", "\u092a\u095d, \u0939\u0948\u0964", "e\u0301. e\u0301"]
    want = [x.ids for x in fresh.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode(texts)] == want


@pytest.mark.parametrize("odd", ["normalized", "lstrip", "rstrip", "single_word"])
def test_added_tokens_that_match_by_context(tmp_path, odd):
    from tokenizers import AddedToken, Tokenizer

    fresh = Tokenizer.from_file(tokenizer_path(BYTE))
    fresh.add_tokens([AddedToken("stop", **({"normalized": False} | {odd: True}))])
    fresh.save(str(tmp_path / "t.json"))
    texts = ["a stop b", "stopper stop", "non stop  x", "<|endoftext|>stop"]
    got = tokens.ChunkEncoder(str(tmp_path / "t.json"), "spaced").encode(texts)
    assert [x.tolist() for x in got] == [x.ids for x in fresh.encode_batch(texts, add_special_tokens=False)]


def test_cache_turns_over(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_CHUNKS", 3)
    coder = tokens.ChunkEncoder(tokenizer_path(WORD), "dropped")
    for k in range(6):
        text = f"alpha beta w{k} gamma x{k}"
        assert coder.encode([text])[0].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "mode"), [(WORD, "dropped"), (BYTE, "spaced")])
def test_words_are_no_python_objects(name, mode):
    """Cutting, counting and joining words takes few bytes a word: no string or list entry for each."""
    import tracemalloc

    coder = tokens.ChunkEncoder(tokenizer_path(name), mode)
    texts = ["to be or no " * 50_000, "it is so\n" * 50_000]
    first = coder.encode(texts)
    tracemalloc.start()
    again = coder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * 350_000  # a string of two letters alone takes 51
    want = [coder.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in first] == want == [x.tolist() for x in again]


@pytest.mark.parametrize("most", [2, 300, 350_000])
@pytest.mark.parametrize(("name", "mode"), [(WORD, "dropped"), (BYTE, "spaced")])
def test_cuts_beside_any_white_space(rng, name, mode, most):
    coder = tokens.ChunkEncoder(tokenizer_path(name), mode, most)
    white = ["\t", "\r", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u180e", "\u2000", "\u200a", "\u200b", "\u2028", "\u202f", "\u205f", "\u3000", "\ufeff"]
    parts = [" "] * 12 + ["\n"] * 6 + white + ["\u00ab", "\u2019", "\u4e2d", "\u0436", "\u00c9", "\u03a3", "a", "Qx", "the", "'s", "'LL", ".", "!!", "-", "12", "\u0301", "\U0001f600", "<|", "\0"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    want = [x.ids for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [y.tolist() for i in range(0, len(texts), 500) for y in coder.encode(texts[i : i + 500])]
    assert got == want and len(coder.cache.chunks) <= 2 * most


def test_frequent_words_outlive_rare_ones():
    coder = tokens.ChunkEncoder(tokenizer_path(WORD), "dropped", 50)
    for k in range(60):
        coder.encode([f"often always x often always {''.join(chr(97 + int(c)) for c in str(k))} {'q' * (k + 1)}"])
    kept = coder.cache.chunks.to_pylist()
    assert b" often" in kept and b" always" in kept and b" q" not in kept and len(kept) <= 100


def test_mixing(spark):
    rows = [(k, "w " * (k % 13 + 1), "en", f"s{k % 4}" if k % 9 else None, 1) for k in range(2000)]
    df = spark.createDataFrame(rows, DOCS)
    plan = mixing.mix_plan(df, carry=["doc_id", "source"]).toPandas()
    plan["source"] = [r["source"] for r in plan["row"]]
    total = plan["size"].sum()
    per = plan.groupby(plan["source"].fillna("~")).agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"))
    assert (per["size"] == per["own"]).all() and per["target"].sum() == pytest.approx(1.5 * total)
    assert (per["target"] <= 2 * per["own"] + 1e-6).all()
    free = per[per["target"] < 2 * per["own"] - 1e-6]
    weights = dict(zip(["s0", "s1", "s2", "s3", "~"], [5, 2, 1, 5, 2], strict=True))
    level = [t / weights[s] for s, t in free["target"].items()]
    assert max(level) - min(level) < 1e-6 * max(level)
    plan["taken"] = plan["size"] * plan["copies"]
    assert (plan["copies"] <= 2).all()
    got = plan.groupby(plan["source"].fillna("~"))["taken"].sum()
    assert (abs(got / per["target"] - 1) < 0.15).all()
    assert mixing.mix(df).count() == plan["copies"].sum() and mixing.mix(df).columns == df.columns
    assert sorted(mixing.mix(df).select("doc_id").collect()) == sorted(mixing.mix(df.repartition(7)).select("doc_id").collect())


def test_mixing_edges(spark):
    df = clashing(spark, EDGE)
    plan = {(r["row"]["doc_id"], r["size"]) for r in mixing.mix_plan(df).collect()}
    assert (1, 0) in plan and (4, 3000) in plan and (None, 3) in plan
    assert mixing.mix_plan(df).count() == len(EDGE) and mixing.mix(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, rng):
    texts = [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(rng.choice([3, 40, 200, 3000]))) for _ in range(120)]
    rows = [(k, t, "en", "a", len(t)) for k, t in enumerate(texts)] + EDGE[:2]
    df = clashing(spark, [(k, r[1], *r[2:]) for k, r in enumerate(rows)]).repartition(3)
    coder = tokens.ChunkEncoder(tokenizer_path(BYTE), "whole")
    ids = {k: [*coder.encode([r[1]])[0].tolist(), 1] for k, r in enumerate(rows)}
    got = packing.pack(df, tokenizer_path(BYTE), group_tokens=20_000).toPandas()
    for doc, part in got.groupby("doc_id"):
        part = part.sort_values("start")
        assert part["start"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() == len(ids[doc]) == part["doc_tokens"].iloc[0]
        assert all(crc(ids[doc][s : s + n]) == c for s, n, c in zip(part["start"], part["length"], part["ids_crc32"], strict=True))
    assert set(got["doc_id"]) == set(ids)
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() <= 2048
    used = got.groupby("sequence_id")["length"].sum()
    assert used.sum() / (2048 * len(used)) > 0.9
    assert packing.pack(df.limit(0), tokenizer_path(BYTE)).count() == 0
    assert packing.pack(clashing(spark, EDGE), tokenizer_path(BYTE), with_ids=True).filter("doc_id is null").first()["ids"]


def test_packing_encodes_large_parts(monkeypatch):
    """A word that recurs within some megabytes reaches the tokenizer once, however little the cache keeps."""
    import pyarrow as pa

    coder, seen = tokens.ChunkEncoder(tokenizer_path(BYTE), "spaced", 1), []
    encode = type(coder)._encode
    monkeypatch.setattr(type(coder), "_encode", lambda self, chunks: seen.extend(chunks.to_pylist()) or encode(self, chunks))
    batch = pa.record_batch({"doc_id": range(40), "text": [f"number {k}" + " some words, again some words" * 4_000 for k in range(40)]})
    ids = [x for _, texts in packing.texts_of(batch) for x in coder.encode(texts)]
    assert sorted(seen) == sorted(set(seen)) and " words" in seen
    assert len(ids) == 40 and ids[7].tolist() == coder.tokenizer.encode(batch.column(1)[7].as_py(), add_special_tokens=False).ids


def test_packing_balances_cost():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 900, 400)
    pieces = packing.balance(n, 2048, 1.0, 1 / 2048)
    cost, fill = {}, {}
    for _, _, k, s, _ in pieces:
        cost[s], fill[s] = cost.get(s, 0) + k + k * k / 2048, fill.get(s, 0) + k
    assert len(fill) == -(-int(n.sum()) // 2048) and np.std(list(cost.values())) / np.mean(list(cost.values())) < 0.15


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 5000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 40, n).astype("<u2") * 1000
    shard = wavelet.WaveletShard.from_bytes(wavelet.WaveletShard.build(x, [n]).to_bytes())
    assert (shard.decode() == x).all()
    for i in rng.integers(0, n, 20).tolist() if n else []:
        assert shard.access(i) == x[i]
    for token in (0, 5000, 39000, 123, 70000):
        at = np.flatnonzero(x == token)
        assert shard.count(token) == len(at) and shard.count(token, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
        assert [shard.select(token, k) for k in range(min(len(at), 15))] == at[:15].tolist()
    if n:
        assert shard.locate(int(x[0])) == np.flatnonzero(x == x[0]).tolist() if n < 600 else True
    for bad in (lambda: shard.access(n), lambda: shard.select(0, n + 1)):
        with pytest.raises(IndexError):
            bad()
    with pytest.raises(ValueError):
        wavelet.WaveletShard.from_bytes(b"nothing of the kind")


def test_token_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coder = tokens.ChunkEncoder(tokenizer_path(WORD), "whole")
    want, at = {}, 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*coder.encode([r["text"]])[0].tolist(), 1]
        want[r["doc_id"]] = (at, len(ids), crc(ids))
        at += len(ids)
    shards = wavelet.write_shards(docs, tokenizer_path(WORD), shard_tokens=20_000)
    assert shards.count() > 4
    got = wavelet.encode_corpus(docs, tokenizer_path(WORD), shard_tokens=20_000).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want
    edge = wavelet.encode_corpus(clashing(spark, EDGE), tokenizer_path(WORD)).orderBy("start").collect()
    assert len(edge) == len(EDGE) and edge[0]["doc_id"] is None and edge[1]["n_tokens"] == 1
    assert wavelet.encode_corpus(docs.limit(0), tokenizer_path(WORD)).count() == 0


def auc(good, bad):
    return (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()


def test_quality_on_held_out_rows(spark, sf_dir):
    docs, marks = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, marks).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    m = got.merge(marks.toPandas())
    m = m[m["held_out"]]
    assert auc(m[m["quality"] == 1]["score"].to_numpy(), m[m["quality"] == 0]["score"].to_numpy()) > 0.97
    assert (m[m["quality"] == 1]["predicted"] == 1).mean() > 0.97
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == set(got[got["predicted"] == 1]["doc_id"])


def test_quality_ignores_held_out_labels(spark, sf_dir):
    docs, marks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = marks.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score(docs, m).orderBy("doc_id").select("doc_id", "score").collect() for m in (marks, flipped))
    assert a == b


def test_quality_edges(spark):
    df = clashing(spark, EDGE)
    marks = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (4, None, 0), (1, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(df, marks).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    none = quality.score(df, marks.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and quality.keep_good(df, marks.limit(0)).count() == len(EDGE)
    assert quality.score(df.limit(0), marks).count() == 0 and quality.keep_good(df.limit(0), marks).columns == df.columns


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs or (1, 0) in model.pairs
    z = rng.uniform(-1, 1, (2000, 3))
    s = model.score(z)
    assert auc(s[z[:, 0] * z[:, 1] > 0], s[z[:, 0] * z[:, 1] <= 0]) > 0.95


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    got = langid.identify(docs).toPandas().merge(docs.toPandas())
    held = got[got["held_out"]]
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_ignores_held_out_rows_and_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = docs.withColumns({"lang": F.when(held, "xx").otherwise(F.col("lang")), "source": F.lit("s")})
    a, b = (langid.identify(d).orderBy("doc_id").select("doc_id", "lang_pred", "score").collect() for d in (docs, other))
    assert a == b


def test_cross_parsing_equals_a_plain_parse(rng):
    samples = {"a": "abracadabra abba", "b": "banana bandana nab", "c": "xyz"}
    p = langid.CrossParser(samples)

    def phrases(text, sample):
        n, i = 0, 0
        while i < len(text):
            k = 1
            while i + k <= len(text) and text[i : i + k] in sample:
                k += 1
            i, n = i + max(k - 1, 1), n + 1
        return n

    for _ in range(200):
        t = "".join(rng.choice("abcdnrxyz ") for _ in range(rng.randint(1, 40)))
        clean = re.sub(" +", " ", t)
        cost = {s: phrases(clean, v) * np.log2(max(len(re.sub(" +", " ", v)), 2)) for s, v in samples.items()}
        names, score = p.predict([t])
        want = min(sorted(cost), key=cost.get) if clean.strip() else "und"
        assert names[0] == want and 0 <= score[0] <= 1


@pytest.mark.parametrize("letters", [4, 64])
def test_segments_and_rare_letters_change_no_parse(rng, monkeypatch, letters):
    monkeypatch.setattr(langid, "SEGMENT", 8)
    monkeypatch.setattr(langid, "DENSE_LETTERS", letters)
    monkeypatch.setattr(langid, "FEW_LANES", letters)
    samples = {"a": "abracadabra abba dcnrb", "b": "banana bandana nab", "c": "xyz", "d": "ab" * 40 + "q"}
    p = langid.CrossParser(samples)
    assert p.sparse == (letters == 4)
    texts = ["".join(rng.choice("abcdnrxyzq ") for _ in range(rng.randint(0, 90))) for _ in range(300)] + ["ab" * 60 + "q" + "ab" * 300]
    codes, n = p.symbols(texts)
    got = p._phrases(codes, np.cumsum(n) - n, n)
    for i, t in enumerate(texts):
        t, j = re.sub(" +", " ", t), 0
        for j, lang in enumerate(p.languages):
            at = want = 0
            while at < len(t):
                k = 1
                while at + k <= len(t) and t[at : at + k] in samples[lang]:
                    k += 1
                at, want = at + max(k - 1, 1), want + 1
            assert got[j, i] == want


def test_a_script_of_thousands_of_letters_stays_small(rng):
    samples = {f"z{k}": "".join(chr(0x4E00 + 3000 * k + rng.randrange(3000)) for _ in range(24_000)) for k in range(4)}
    samples["en"] = "".join(rng.choice("etaoinshrdlu ") for _ in range(24_000))
    p = langid.CrossParser(samples, literals=True)
    held = p.moves.nbytes + sum(w.edge_from.nbytes + w.edge_to.nbytes + w.column.nbytes for w in p.walks)
    assert held < 200e6
    assert p.predict([samples["z1"][5000:6000] * 1000, samples["en"]])[0] == ["z1", "en"]


def test_language_edges(spark):
    got = langid.identify(clashing(spark, [*EDGE, (7, "123 456!", "en", "a", 8)])).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(EDGE) + 1 and by[1]["lang_pred"] == by[2]["lang_pred"] == by[7]["lang_pred"] == "und" and by[7]["score"] == 0
    assert {r["lang_pred"] for r in langid.identify(clashing(spark, [(1, "text", None, "a", 4)])).collect()} == {"und"}
    assert langid.identify(clashing(spark, EDGE).limit(0)).count() == 0


def drawn_first(n):
    """Ids that are learned from, in the order in which language samples are drawn."""
    ids = [k for k in range(n) if zlib.crc32(str(k).encode()) % 5]
    return sorted(ids, key=lambda k: hashlib.md5(f"{k}:language-sample".encode()).hexdigest()[:13])


@pytest.mark.parametrize("first", [["w" * 30_000], ["", "w" * 30_000], ["12 34", "w" * 30_000, "v" * 23_000]])
def test_language_sample_goes_on_after_texts_that_do_not_fit(spark, first):
    ids = drawn_first(600)
    texts = dict(zip(ids, [*first, *[f"word {k} " + "abc " * 25 for k in range(600)]], strict=False))
    df = spark.createDataFrame([(k, x, "en") for k, x in texts.items()], "id long, text string, lang string").repartition(3)
    got = langid.language_samples(df, fold=5, held_out=0, sample_docs=96, sample_chars=24_000)["en"]
    assert 23_900 < len(got) <= 24_000 and "word 3 " in got


def test_language_sample_takes_the_start_of_long_texts_and_enough_short_ones(spark):
    a, b, *_ = drawn_first(600)
    rows = [(a, "- " * 20_000 + "x" * 20_000, "xx"), (b, "y" * 20_000, "xx"), *[(k, "ab", "yy") for k in range(20_000)], (a, "7", "zz")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    got = langid.language_samples(df, fold=5, held_out=0, sample_docs=96, sample_chars=24_000)
    assert set(got) == {"xx", "yy"} and got["xx"] == "x" * 20_000 + " " + "y" * 3998 and len(got["yy"]) == 23_999


def test_language_of_one_word_does_not_take_other_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    k = next(k for k in range(10**9, 10**9 + 99) if zlib.crc32(str(k).encode()) % 5)
    more = spark.createDataFrame([(k, "zqx", "xx")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs.unionByName(more)).collect()}
    alone = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert got.pop(k) == "xx" and got == alone


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            s = m[0]
            d = re.sub("[^0-9]", "", s)
            ok = kind == "email"
            ok |= kind == "ip" and all(int(p) <= 255 for p in s.split("."))
            ok |= kind == "phone" and 9 <= len(d) <= 15
            ok |= kind == "card" and 13 <= len(d) <= 19 and pii.luhn(d)
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_the_plain_patterns(rng):
    for _ in range(20_000):
        t = "".join(rng.choice("a.@-+1 2().0%é_") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t), t
    known = "Mail a.b@c.example.org, card 4111 1111 1111 1111 or 4111111111111112, ip 10.0.0.256 and 10.0.0.25, +1 (644) 555-7859"
    assert [k for k, _, _ in pii.base_spans(known)] == [0, 1, 2, 3] and pii.base_spans(known) == plain_spans(known)
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_tagger_gradients():
    model = pii.Tagger(hidden=3, seed=1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    codes, tags = rng.integers(0, 130, (5, 2)).astype(np.uint8), rng.integers(0, pii.TAGS, (5, 2))

    def loss():
        e = model.emissions(codes)[0].astype(np.float64)
        total = 0.0
        for b in range(2):
            a = model.p["first"] + e[0, b]
            gold = a[tags[0, b]]
            for t in range(1, 5):
                a = np.log(np.exp(a[:, None] + model.p["trans"]).sum(0)) + e[t, b]
                gold += model.p["trans"][tags[t - 1, b], tags[t, b]] + e[t, b, tags[t, b]]
            total += np.log(np.exp(a).sum()) - gold
        return total / 2

    g = model.gradients(codes, tags)
    for name, at in (("trans", (1, 2)), ("first", (3,)), ("out", (2, 4)), ("bias", (0,)), ("rf", (1, 5)), ("rb", (2, 10)), ("xf", (int(codes[2, 0]), 4)), ("xb", (int(codes[1, 1]), 7))):
        keep = model.p[name][at]
        step = 1e-2
        model.p[name][at] = keep + step
        up = loss()
        model.p[name][at] = keep - step
        down = loss()
        model.p[name][at] = keep
        assert g[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3), name


@pytest.fixture(scope="module")
def tagger():
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))

    def card():
        d = [rng.randint(0, 9) for _ in range(15)]
        return next("".join(map(str, [4, *d[:-1], c])) for c in range(10) if pii.luhn("".join(map(str, [4, *d[:-1], c]))))

    def item():
        return rng.choice([
            lambda: f"{word()}@{word()}.com", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), card,
            lambda: f"+{rng.randint(1, 9)} ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", lambda: f"year {rng.randint(1900, 2030)}", lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}",
        ])()

    make = lambda: " ".join([*[word() for _ in range(rng.randint(1, 5))], item(), *[word() for _ in range(rng.randint(1, 5))]])[: pii.WINDOW]
    texts = [make() for _ in range(500)]
    return pii.Tagger().fit(*pii.training_set([(t, pii.base_spans(t)) for t in texts])), [make() for _ in range(200)]


def test_tagger_finds_spans_it_has_not_seen(tagger):
    model, texts = tagger
    right = wrong = total = 0
    for t in texts:
        codes = np.zeros((pii.WINDOW, 1), np.uint8)
        codes[: len(t), 0] = pii.encode(t)
        path = model.decode(codes)[:, 0]
        want = pii.tags_of(pii.base_spans(t), 0)
        total += (want > 0).sum()
        right += ((want > 0) & (path == want)).sum()
        wrong += ((want == 0) & (path > 0)).sum()
    assert right / total > 0.85 and wrong / total < 0.15


def test_model_adds_variants_and_keeps_base(tagger):
    model, _ = tagger
    texts = ["bed cab (644) 555-7859 fed hag", "dab abc@def.com bag", "plain words without any", ""]
    found = pii.find_spans(texts, model)
    assert all(set(b) <= set(s) for b, s in found) and found[2] == ([], []) == found[3]
    assert any(len(s) > len(b) for b, s in found)
    for (_, s), t in zip(found, texts, strict=True):
        assert all(0 <= a < b <= len(t) for _, a, b in s)


def test_windows_cover_every_trigger(rng):
    for _ in range(300):
        t = "".join(rng.choice("aaaaaaaaaaaaaaaa1@") for _ in range(rng.randint(0, 900)))
        starts = pii.windows(t)
        for m in pii.TRIGGER.finditer(t):
            assert any(s <= m.start() < s + pii.WINDOW for s in starts)


def test_reconcile_takes_the_heaviest_set():
    got = pii.reconcile([(0, 0, 10, 1.0), (1, 8, 20, 1.0), (2, 10, 20, 1.0), (3, 30, 40, 1.0)], [(3, 35, 45)])
    assert sorted(got) == [(0, 0, 10), (2, 10, 20)]


def test_detection(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = pii.detect(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        base = sorted(plain_spans(texts[r["doc_id"]]))
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for k, _, _ in base) for j in range(4)]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


def test_detection_edges(spark):
    df = clashing(spark, EDGE)
    got = pii.detect(df, carry=tuple(df.columns), redact=True).collect()
    assert len(got) == len(EDGE)
    by = {r["row"]["doc_id"]: r for r in got}
    assert by[1]["redacted"] is None and by[5]["redacted"] == "Call <PHONE>" and by[5]["n_phone"] == 1 and by[2]["spans"] == ""
    assert pii.detect(df.limit(0)).count() == 0
    assert pii.cover("ab 12 cd", [(1, 3, 5), (2, 4, 5)]) == "ab <IP> cd"


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = []
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs.persist()
        tables.append(docs)
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for t in tables[:-1]:
        assert t.columns == start.columns
    n = [t.count() for t in tables]
    assert n[0] < start.count() and n[1] < n[0] and n[2] == n[1] and n[3] > n[2]
    assert tables[2].filter(F.col("text").rlike(PLAIN["email"])).count() == 0
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = start.join(marks.filter("quality = 1"), "doc_id", "left_semi")
    assert tables[0].join(good, "doc_id", "left_semi").count() >= 0.97 * good.count()
    assert P.run(spark, sf_dir).count() == n[-1]


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as P

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(5, a), (5, a), (3, a + " end"), (None, a), (7, b), (7, c), (9, c), (None, d), (None, d), (8, ""), (8, None)]
    df = spark.createDataFrame([(k, x, "en", "s", 1) for k, x in rows], DOCS).repartition(3)
    got = P.near_duplicate_stage(spark, df, "")
    assert got.columns == df.columns
    want = [(3, a + " end"), (7, b), (7, c), (None, d), (8, ""), (8, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_pipeline_packs_the_ids(spark):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    texts = {1: "some text <|endoftext|> here", 2: "word " * 3000, 3: None}
    df = spark.createDataFrame([(k, x, "en", "a", 1) for k, x in texts.items()], DOCS)
    pieces = P.pack_stage(spark, df, "").collect()
    coder = Tokenizer.from_file(tokenizer_path(BYTE))
    for k, x in texts.items():
        own = sorted((r["start"], r["ids"], r["ids_crc32"]) for r in pieces if r["doc_id"] == k)
        assert [i for _, ids, _ in own for i in ids] == [*coder.encode(x or "", add_special_tokens=False).ids, 1]
        assert all(crc(ids) == c for _, ids, c in own)


def test_pipeline_bounds_the_bytes_of_a_batch(spark, tmp_path, monkeypatch):
    import corpus_pipeline as P

    key, folder, plain = "spark.sql.execution.arrow.maxBytesPerBatch", str(tmp_path), packing.texts_of
    before = spark.conf.get(key)

    def seen(batch):
        with open(f"{folder}/{batch.column(0)[0]}", "w") as f:
            f.write(str(batch.nbytes))
        return plain(batch)

    monkeypatch.setattr(packing, "texts_of", seen)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    try:
        pieces = P.pack_stage(spark, docs, "")
        assert pieces.select("doc_id").distinct().count() == 3000
    finally:
        spark.conf.set(key, before)
    sizes = [int(x.read_text()) for x in tmp_path.iterdir()]
    assert sum(sizes) >= 15_000_000 and max(sizes) < 5_000_000


def test_query_names():
    import corpus_pipeline

    assert sorted({int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES}) == list(range(1, 14)) and len(corpus_pipeline.STAGES) == 5
