"""The registered queries of the operators, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctw, decontaminate, exact, near, quality, quotes, repeats, toxicity, url_filter
from .common import crc_mod, read

URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.Rule.prefix(v, t) for v, t in URL_RULES]
    out = url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rule, rhost, rpath, verdict) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'),
  ('org/es/', 'org', '/es/', 'block')),
m AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT p.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m USING (page_id)
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.exact_groups(read(spark, sf_dir, "documents"), hash_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""

def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(read(spark, sf_dir, "documents"), k=4)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh
  FROM w),
f AS MATERIALIZED (SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), chr(10))) AS fp, sh FROM s),
c AS MATERIALIZED (SELECT fp, any_value(n) AS n, any_value(sh) AS sh, min(doc_id) AS least FROM f WHERE n > 0 GROUP BY fp),
e AS MATERIALIZED (SELECT fp, n, unnest(sh) AS x FROM c),
pairs AS (SELECT a.fp AS u, b.fp AS v, a.n AS p, b.n AS q, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.fp <> b.fp GROUP BY ALL),
links AS MATERIALIZED (SELECT u, v FROM pairs WHERE 100 * k >= 80 * (p + q - k)),
reach(u, v) AS (SELECT fp, fp FROM c UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
comp AS (SELECT reach.u AS fp, min(c.least) AS component_id FROM reach JOIN c ON c.fp = reach.v GROUP BY 1)
SELECT f.doc_id, f.n AS n_shingles, coalesce(comp.component_id, f.doc_id) AS component_id, f.doc_id = coalesce(comp.component_id, f.doc_id) AS kept
FROM f LEFT JOIN comp ON f.fp = comp.fp AND f.n > 0
"""

def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM benchmark),
ig AS (
  SELECT item_id, least(len(ws), 5) AS k, unnest(list_distinct(list_transform(range(1, len(ws) - least(len(ws), 5) + 2), lambda p: array_to_string(ws[p:p+least(len(ws), 5)-1], ' ')))) AS g
  FROM i WHERE len(ws) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM ig GROUP BY 1),
ks AS (SELECT DISTINCT k FROM ig),
dg AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda p: array_to_string(ws[p:p+k-1], ' '))) AS g
  FROM d, ks WHERE len(ws) >= k),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN ig USING (k, g) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""

def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod(F.col("doc_id"), 5) == 0
    out = quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod(F.col("doc_id"), 3) == 1
    docs = read(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels"), ~held))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_offending"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod(F.col("doc_id"), 10) == 0
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    out = ctw.score(docs, ~F.col("held_out"), keep=("held_out",))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(read(spark, sf_dir, "conversations"))


QUERIES = {
    "op2_quotes": op2_quotes,
    "op7_repeats": op7_repeats,
    "op6_lm_score": op6_lm_score,
    "op1_quality": op1_quality,
    "op3_toxicity": op3_toxicity,
    "op10_decontaminate": op10_decontaminate,
    "op9_near_dedup": op9_near_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_bpe": op5_bpe,
    "op8_exact_dedup": op8_exact_dedup,
}
ORACLE_SQL = {"op10_decontaminate": OP10_SQL, "op9_near_dedup": OP9_SQL, "op4_url_filter": OP4_SQL, "op8_exact_dedup": OP8_SQL}
