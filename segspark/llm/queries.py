"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm import bpe, contamination, html, pii, quality, repeats, shards, simhash, topk, url_filter


def _read(s: SparkSession, d: str, table: str) -> DataFrame:
    return s.read.parquet(f"{d}/{table}.parquet")


def op1_topk(s: SparkSession, d: str) -> DataFrame:
    return topk.search(topk.quantized(_read(s, d, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


def op2_simhash(s: SparkSession, d: str) -> DataFrame:
    found = simhash.groups(_read(s, d, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op3_html(s: SparkSession, d: str) -> DataFrame:
    return html.extract(_read(s, d, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_pii(s: SparkSession, d: str) -> DataFrame:
    return pii.replace(_read(s, d, "documents").select("doc_id", "text"))


def op5_contamination(s: SparkSession, d: str) -> DataFrame:
    return contamination.matches(_read(s, d, "documents"), _read(s, d, "benchmark"))


def op6_quality(s: SparkSession, d: str) -> DataFrame:
    scored = quality.score(_read(s, d, "documents").select("doc_id", "text"), _read(s, d, "labels"))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_shards(s: SparkSession, d: str) -> DataFrame:
    docs = _read(s, d, "documents")
    return shards.materialise(docs, shards.new_folder(docs))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_urls(s: SparkSession, d: str) -> DataFrame:
    return url_filter.judge(_read(s, d, "pages"), s.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op9_bpe(s: SparkSession, d: str) -> DataFrame:
    return bpe.digests(_read(s, d, "documents"), bpe.Vocabulary(s, public_tokenizers.path(bpe.RANKS)))


def op10_repeats(s: SparkSession, d: str) -> DataFrame:
    return repeats.remove(_read(s, d, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_simhash": op2_simhash,
    "op3_html": op3_html,
    "op4_pii": op4_pii,
    "op5_contamination": op5_contamination,
    "op6_quality": op6_quality,
    "op7_shards": op7_shards,
    "op8_urls": op8_urls,
    "op9_bpe": op9_bpe,
    "op10_repeats": op10_repeats,
}

_OP1 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.v, v.v)::BIGINT AS score FROM v q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

_OP5 = r"""WITH w AS (
  SELECT doc_id AS id, 0 AS item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT item_id, 1, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT DISTINCT id, item, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n FROM s WHERE item = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(n.n) AS n_shingles FROM s d JOIN s b ON d.s = b.s AND d.item = 0 AND b.item = 1 JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n.n)"""

_OP8 = f"""WITH p AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
t AS (SELECT * FROM (VALUES {", ".join(map(str, URL_RULES))}) t(h, q, v))
SELECT page_id, host, path, h || q AS rule, coalesce(v, 'allow') AS verdict FROM u
LEFT JOIN t ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(h || q) DESC) = 1"""

SQL: dict[str, str] = {
    "op1_topk": _OP1,
    "op5_contamination": _OP5,
    "op8_urls": _OP8,
}
