"""Each stage of the pipeline against a plain version, on its own input; odd tables."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_contamination import shingles
from test_deduplicate import kept_by_all_pairs
from test_pii import PYTHON

from segspark.llm import bpe, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], SF).write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
        assert name == "bpe" or tables[-1].columns == columns
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.score(docs, labels).collect() if r.score >= 0.5}
    assert rows[1] == {d: r for d, r in rows[0].items() if d in good} and 0 < len(rows[1]) < len(rows[0])
    assert set(rows[2]) == kept_by_all_pairs([(d, r.text) for d, r in rows[1].items()]) and len(rows[2]) < len(rows[1])
    items = [s for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (s := shingles(r.text))]
    clean = {d for d, r in rows[2].items() if not any(len(s & shingles(r.text)) >= 0.8 * len(s) for s in items)}
    assert set(rows[3]) == clean and len(clean) < len(rows[2])
    assert set(rows[4]) == clean
    for d, r in rows[4].items():
        before = rows[3][d].text
        assert PYTHON.split(before) == PYTHON.split(r.text) and not set(PYTHON.findall(before)) & set(PYTHON.findall(r.text)) and r.n_chars == len(r.text)
    encoder = bpe.Vocabulary(spark, public_tokenizers.path(bpe.RANKS)).encoder()
    for d, r in rows[5].items():
        t = rows[4][d].text
        ids = np.array(encoder.encode_ordinary(t), "<u4").tobytes()
        assert (bytes(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) == (ids, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert set(rows[5]) == clean
    again = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert again == {d: r.ids_sha256 for d, r in rows[5].items()}


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    odd = [(1, None, None, None, None, None), (2, "", "en", "s", 0, 1.0), (None, "a b", "en", "s", 3, 1.0), (4, "words " * 30000, "en", None, 9, None), (5, "mail a.b@c.org now", "en", "s", 1, 0.0), (5, "mail a.b@c.org now", "en", "s", 1, 0.0)]
    for rows in (odd, []):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, spark.createDataFrame(rows, schema), SF)
            if name != "bpe":  # other columns keep their values
                assert {(r.doc_id, r.score) for r in out.collect()} <= {(r[0], r[5]) for r in rows}
            assert out.count() <= len(rows) and (name == "bpe" or out.columns == [c.split()[0] for c in schema.split(", ")])
