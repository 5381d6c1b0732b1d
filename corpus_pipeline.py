"""The pipeline over documents: STAGES in order, each of one operator.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. Null and empty texts, repeated
rows and empty tables are treated as each operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm import bpe, contamination, pii, quality, simhash
from segspark.llm.shared import delete, free_name, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than not."""
    scored = quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col(free_name("score", docs.columns)) >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data; n_chars is that of the new text."""
    out = pii.replace(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): ids as little-endian unsigned 32-bit integers, decoded again."""
    return bpe.digests(docs, bpe.Vocabulary(spark, public_tokenizers.path(bpe.RANKS)), keep_ids=True, block_chars=3_000_000)


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", surrogates),
    ("bpe", token_ids),
]

#: SQL can't express the classifier's training; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        delete(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
