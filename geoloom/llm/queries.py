"""Queries over the driver's tables, with the SQL that gives the same rows where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import divergence, exactdedup, langid, mixing, neardup, packing, phrases, pii, quality, suffixdedup, vectors, wavelet
from geoloom.llm.common import table

TOKENIZER_FOLDER = "public_tokenizers"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
             row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM s),
l AS (SELECT source, source_size, w,
        (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT)
         - CAST(2.0 AS DOUBLE) * CAST(coalesce(sum(source_size) OVER (ORDER BY (CAST(2.0 AS DOUBLE) * source_size) / w, rn
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
        / CAST(sum(w) OVER (ORDER BY (CAST(2.0 AS DOUBLE) * source_size) / w, rn
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM r),
t AS (SELECT source, source_size, least(CAST(2.0 AS DOUBLE) * source_size, w * max(level) OVER ()) AS target FROM l),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
        CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':mix-1'), 1, 13) AS BIGINT)
          / CAST(4503599627370496 AS DOUBLE) AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS n FROM m)
SELECT doc_id, size, source_size, target, CAST(size * n AS BIGINT) AS taken, CAST(n AS BIGINT) AS copies FROM c
"""


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_corpus(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {"op1_mixing": op1_mixing, "op2_token_files": op2_token_files, "op6_packing": op6_packing}
SQL = {"op1_mixing": OP1_SQL}


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES |= {"op3_quality": op3_quality, "op7_pii": op7_pii, "op9_language": op9_language}


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_inner_products(table(spark, sf_dir, "embeddings"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.epsilon_grid_join(table(spark, sf_dir, "embeddings"))


def op8_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


OP4_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP5_SQL = """
WITH RECURSIVE every_row AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings),
v AS (
  SELECT row, CAST(embedding AS DOUBLE[]) AS x FROM every_row
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (SELECT a.row AS a, b.row AS b FROM v a JOIN v b ON a.row <> b.row AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach(node, low) AS (
  SELECT row, vec_id FROM every_row UNION SELECT e.b, reach.low FROM reach JOIN e ON e.a = reach.node),
c AS (SELECT node, min(low) AS low FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT m.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.low AS component_id, coalesce(c.low = m.vec_id, false) AS kept
FROM every_row m JOIN c ON c.node = m.row LEFT JOIN n ON n.a = m.row
"""

QUERIES |= {"op4_top_k": op4_top_k, "op5_near_vectors": op5_near_vectors, "op8_near_texts": op8_near_texts}
SQL |= {"op4_top_k": OP4_SQL, "op5_near_vectors": OP5_SQL}


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeated_strings(table(spark, sf_dir, "documents"))


QUERIES["op10_repeated_strings"] = op10_repeated_strings


def op11_exact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""

QUERIES["op11_exact_texts"] = op11_exact_texts
SQL["op11_exact_texts"] = OP11_SQL


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, unnest(list_transform(ps, lambda q: regexp_extract_all(q, '[^\x20\x09]+'))) AS w FROM d),
g AS (
  SELECT lang, 1 AS k, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i:i])) AS g FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) FROM p
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) FROM p),
f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY lang, k, g),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.k, c.g, c.a, j.cut, l.a AS l, r.a AS r,
    CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM c JOIN (SELECT unnest([1, 2]) AS cut) j ON j.cut < c.k
  JOIN f l ON l.lang = c.lang AND l.k = j.cut AND l.g = c.g[1:j.cut]
  JOIN f r ON r.lang = c.lang AND r.k = c.k - j.cut AND r.g = c.g[j.cut + 1:c.k]),
s AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inner2 AS (
  SELECT lang, g[1:2] AS g, a FROM c WHERE k = 3 UNION ALL SELECT lang, g[2:3], a FROM c WHERE k = 3),
m AS (SELECT lang, g, max(a) AS longer FROM inner2 GROUP BY lang, g),
kept AS (SELECT s.*, array_to_string(s.g, ' ') AS phrase FROM s LEFT JOIN m USING (lang, g) WHERE m.longer IS NULL OR 100 * m.longer < 50 * s.a),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""

QUERIES["op12_phrases"] = op12_phrases
SQL["op12_phrases"] = OP12_SQL


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
u AS (SELECT doc, lang, source, unnest(ts) AS term FROM d),
t AS (SELECT lang, term FROM u GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM u SEMI JOIN t USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
size AS (SELECT lang, count(*) AS v FROM t GROUP BY lang),
words AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
whole AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS all_n FROM c GROUP BY lang, term),
p AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (CAST(coalesce(words.n, 0) AS HUGEINT) + size.v) AS p
  FROM g JOIN t USING (lang) JOIN size USING (lang) LEFT JOIN words USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (CAST(n AS HUGEINT) + 1)) // (CAST(all_n AS HUGEINT) + v) AS q FROM whole JOIN size USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""

QUERIES["op13_divergence"] = op13_divergence
SQL["op13_divergence"] = OP13_SQL
