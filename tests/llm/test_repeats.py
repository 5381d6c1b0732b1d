"""Repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from segspark.llm import repeats
from segspark.llm.queries import op10_repeats

SF = "/root/testdata/sf0.001"


def brute(rows, n=100):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                gone[p : p + n] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df, **more):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in repeats.remove(df, **more).collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op10_repeats(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr) == brute(rows)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 8)))
    passages = ["".join(word() for _ in range(60)) for _ in range(4)]
    out = [None, "", "a" * 99, "a" * 100, "a" * 101, "a" * 700, "ab" * 300, "abc" * 90]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += ["".join(word() for _ in range(rng.randint(0, 30))), p[a : a + rng.randint(80, 300)]]
        out.append("".join(parts))
    return out + out[-3:]


@pytest.mark.parametrize("runs, piece", [(20_000, 1 << 20), (0, 1 << 20), (3, 300)])
def test_edges(spark, monkeypatch, runs, piece):
    """Also with buckets over the limit, and texts that are cut into pieces."""
    monkeypatch.setattr(repeats, "PIECE", piece)
    rows = list(enumerate(texts(runs)))
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, id int, key string").repartition(4)
    if piece < 1000:  # the workers don't see the patch: the functions run here
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["id", "text"])
        found = [r for b in repeats._runs(iter([batch])) for r in b.to_pylist()]
        starts = sorted((r["id"], r["place"] >> 9, ((r["place"] >> 1) & 255)) for r in found)
        covered = [(i, p) for i, s, n in starts for p in range(s, s + n + 1)]
        assert covered == [(i, p) for i, t in rows for p in range(len((t or "").encode()) - 99)]
    assert result(df, runs=runs) == brute(rows)


def test_hot_anchor(spark):
    """A passage that very many texts share, each with its own surroundings and some with a cut passage."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(160)
    rows = [(i, word(rng.randrange(90)) + passage[rng.choice([0, 0, 30]) :] + word(rng.randrange(90))) for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows)
    assert sum(r[2] for r in want) > 2400 * 130
    for runs in (repeats.RUNS, 100_000):
        assert result(df, runs=runs) == want


def test_repeated_and_null_ids(spark):
    t = texts(9)[8:30]
    rows = [(i // 3 if i % 5 else None, x) for i, x in enumerate(t)]
    rows += rows[:4]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove(df).count() == 0
    assert result(spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string")) == brute([(1, None), (2, "x")])
