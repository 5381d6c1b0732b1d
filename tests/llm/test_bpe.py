"""Encoding against the tokenizer library, and the exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers

from segspark.llm import bpe
from segspark.llm.queries import op9_bpe

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "\n\n\n a", "It's 1,234.5 ½ ٣ don't   \t x  ", "é日本語 ไทย \U0001f600\U0001f468‍\U0001f469", "\x1c\x85  a b​", "''s 'll'LL", "a" * 5000, "the " * 30000, "\r\n \r\n", "<|endoftext|>"]


def expected(rows, vocabulary):
    enc = vocabulary.encoder()
    out = []
    for i, t in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        out.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_pack():
    rng = np.random.default_rng(1)
    rows = np.sort(rng.integers(0, 50, 3000))
    values = np.concatenate([np.sort(rng.choice(2**30, (rows == r).sum(), replace=False)) for r in range(50)])
    data, offsets = bpe._bytes(bpe.pack(values, rows, 51))
    got, counts = bpe.unpack(data, offsets)
    assert got.tolist() == values.tolist() and counts.tolist() == np.bincount(rows, minlength=51).tolist()


def test_query_equals_library(spark):
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path(bpe.RANKS))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, op9_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr) == expected(rows, vocabulary)


def test_edges(spark):
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path(bpe.RANKS))
    rng = random.Random(4)
    alphabet = "ab é'sS1٣ \n\t  .,日\U0001f600"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = [(None if i % 50 == 7 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], "doc_id long, text string, ids binary, block int").repartition(3)
    for size in (200, bpe.BLOCK_CHARS):
        coded = bpe.encode(df, vocabulary, size)
        got = bpe.decode(coded, vocabulary).collect()
        assert sorted((r.doc_id, bytes(r.decoded)) for r in got if r.doc_id is not None) == sorted((i, (t or "").encode()) for i, t in rows if i is not None)
    assert sorted(map(tuple, bpe.digests(df, vocabulary).collect()), key=repr) == expected(rows, vocabulary)
    assert bpe.encode(df.limit(0), vocabulary).count() == 0
