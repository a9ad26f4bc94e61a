"""Registered queries of the operators, with DuckDB SQL where SQL can say it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (byte_bpe, conversation_repair, decontaminate, html_extract, importance_sample, jaccard_join, packing,
               secret_scan, sharding, substring_dedup, topk_search, toxicity, url_filter)

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL for the same rows."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (host, path, verdict) of the registered query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"),
             ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
             ("net", "/fr/", "block")]


@query("""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://')
                  THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rhost, rpath, verdict) AS (VALUES """ + ", ".join(map(str, URL_RULES)) + """),
fits AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path
           ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC) AS n
  FROM (SELECT DISTINCT * FROM parts) p JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f
  ON f.n = 1 AND p.page_id IS NOT DISTINCT FROM f.page_id AND p.host = f.host AND p.path = f.path
""")
def op1_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.match_urls(table(spark, sf_dir, "pages"), rules)


@query()
def op10_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def op3_topk_search(spark, sf_dir):
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


@query()
def op4_secret_scan(spark, sf_dir):
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


@query()
def op8_html_extraction(spark, sf_dir):
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


@query()
def op6_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query()
def op5_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingles FROM d),
e AS (SELECT doc_id, unnest(shingles) AS x FROM s),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * k >= 80 * (na.n + nb.n - k)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.c)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
""")
def op2_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query()
def op9_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query()
def op11_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


#: CRC-32 of a word's bytes, from the table of the reflected polynomial.
_CRC32 = """
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc)"""
_CRC32_OF = """xor(list_reduce(list_transform(range(strlen({0})), lambda i:
    ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT), lambda c, b:
    xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""


@query(f"""
WITH {_CRC32},
texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 'b', 0, NULL, text FROM benchmark),
lists AS (
  SELECT kind, r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'),
    lambda x: x <> '') AS words FROM texts),
features AS (SELECT kind, r, unnest(words) AS word FROM lists),
hashed AS (SELECT word, {_CRC32_OF.format("word")} % 10000 AS bucket
           FROM (SELECT DISTINCT word FROM features), crc_table),
counts AS (
  SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t
  FROM features JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE
    / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (
  SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM features JOIN hashed USING (word) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)
      / 4294967296)))::BIGINT AS score
  FROM lists LEFT JOIN weights USING (r) WHERE kind = 'd'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked
""")
def op12_importance_sample(spark, sf_dir):
    return importance_sample.importance_sample(table(spark, sf_dir, "documents"),
                                               table(spark, sf_dir, "benchmark"))


@query()
def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_report(conversation_repair.damage(table(spark, sf_dir, "conversations")))
