"""SimHash groups against brute force."""

import random
import re

import numpy as np
import xxhash

from segspark.llm import simhash, text
from segspark.llm.queries import op2_simhash

SF = "/root/testdata/sf0.001"


def fingerprint(t: str | None, k: int = 3) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    spans = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in spans]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def brute(rows, most=3):
    """{row number: (fingerprint, component)} by comparing all pairs."""
    f = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= most or rows[i][0] == rows[j][0]:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, f"{f[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def edits(rng, n):
    base = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(300)] = f"X{rng.randrange(50)}"
        out.append(" ".join(w))
    return out


def rows_of(df):
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def test_hashes():
    rng = random.Random(3)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(80), 255, 256, 257, 1000]]
    buf = b"".join(texts)
    end = np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    assert text.xxh64(buf, start, end).tolist() == [xxhash.xxh64_intdigest(t, 42) for t in texts]


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(op2_simhash(spark, SF)) == brute(rows)


def test_edges(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", "  \t", "a", "A", "a b", "é à b c", "x " * 20000, "\x1c a b c", *edits(rng, 60), *["same text here now"] * 5]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)]
    rows += [rows[3], (rows[9][0], "another text for one id")]
    df = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in rows], "doc_id long, text string, key string, node int, f0 int")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(op2_simhash(spark, str(tmp_path))) == brute(rows)


def test_large_keys_in_blocks(spark):
    """Groups over the block size are compared in pairs of blocks, with the same result."""
    rng = random.Random(6)
    rows = [(i, t) for i, t in enumerate(edits(rng, 150))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small = simhash.groups(df, block=4)
    got = sorted((r.doc_id, f"{r.f0 % 2**64:016x}", r.component_id) for r in small.collect())
    assert got == brute(rows)


def test_repeated_ids_connect(spark):
    """Fingerprints of one doc_id are linked, whichever of them has the smaller ids."""
    rows = [(3, "t t t t"), (5, "t t t t"), (5, "u u u u"), (8, "u u u u"), (9, "v v v v"), (9, "w w w w")]
    got = sorted((r.doc_id, r.component_id) for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (8, 3), (9, 9), (9, 9)]


def test_null_id_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "q r s t"), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.groups(df).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}
    assert simhash.groups(df.limit(0)).count() == 0
