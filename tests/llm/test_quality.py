"""The classifier's accuracy on held-out labels, its determinism and odd inputs."""

import zlib

import numpy as np

from segspark.llm import quality
from segspark.llm.queries import op6_quality

SF = "/root/testdata/sf0.01"


def auc(s, y):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_accuracy(spark):
    rows = op6_quality(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    test = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    s, y = np.array([t[0] for t in test]), np.array([t[1] for t in test])
    assert ((s >= 0.5) == y).mean() > 0.9 and auc(s, y) > 0.9
    again = {r.doc_id: r.score for r in quality.score(spark.read.parquet(f"{SF}/documents.parquet").repartition(5), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_words():
    ids, doc = quality.word_ids([b"", b"Ab!! 12", b"", "é".encode()])
    assert doc.tolist() == [1, 1, 1, 1, 1, 1, 1, 1, 3, 3] and len(ids) == 10
    assert quality.word_ids([b"", b""])[0].size == 0
    v = np.ones((quality.BUCKETS, quality.DIMS), np.float32)
    assert quality.pooled([b"", b"a b"], v)[:, 0].tolist() == [0, 1]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", 1.0), (2, "", "en", 2.0), (None, "x " * 50000, None, None), (4, "good words", "de", 0.0), (4, "good words", "de", 0.0)], "doc_id long, text string, lang string, quality double")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (None, 1), (7, None)], "doc_id long, quality int")
    got = quality.score(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs, labels.limit(0)).first().score == 0.5
    assert quality.score(docs.limit(0), labels).count() == 0
