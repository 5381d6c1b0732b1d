"""Shards: the permutation, the exact round trip, reading on from any slot."""

import numpy as np
import public_tokenizers
import pytest

from segspark.llm import bpe, shards
from segspark.llm.queries import op7_shards

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 63, 64, 65, 1000, 4096, 70000])
def test_feistel_is_a_permutation(n):
    slots = shards.feistel(np.arange(n), n, 3)
    assert sorted(slots.tolist()) == list(range(n))
    assert n < 60 or (slots != shards.feistel(np.arange(n), n, 4)).any() and np.abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.5


def check(rows, index, folder, **sizes):
    want = sorted((str(d), k // 8, (t or "").encode()[k : k + 8]) for d, t in rows for k in range(0, len((t or "").encode()), 8))
    assert sorted(r.slot for r in index) == list(range(len(want)))
    by_slot = {r.slot: r for r in index}
    records = list(shards.read(folder, 0, len(want), **sizes))
    assert sorted((str(by_slot[i].doc_id), by_slot[i].part, x[: by_slot[i].n_tokens]) for i, x in enumerate(records)) == want
    assert all(set(x[by_slot[i].n_tokens :]) <= {0} for i, x in enumerate(records))
    assert list(shards.read(folder, 5, 9, **sizes)) == records[5:9]


def test_round_trip(spark, tmp_path):
    rows = [(i, "é" * i) for i in range(40)] + [(None, "null id"), (3, "again"), (3, "again"), (50, None), (51, ""), (52, "x" * 5000)]
    spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, slot int").repartition(3).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    folder = f"file://{tmp_path}/out"
    sizes = {"stride": 8, "shard_bytes": 80}
    index = shards.materialise(df, folder, **sizes)
    check(rows, index.collect(), folder, **sizes)
    before = list(shards.read(folder, 0, 700, **sizes))
    files = lambda: {f.name: f.stat().st_mtime_ns for f in (tmp_path / "out").iterdir()}
    written = files()
    check(rows, index.collect(), folder, **sizes)  # reading the table again writes nothing
    assert files() == written and not any(name.startswith("_") for name in written)
    assert index.count() and files() == written
    shards.materialise(df, folder, **sizes)  # written again: the same bytes
    assert before == list(shards.read(folder, 0, 700, **sizes))
    assert shards.materialise(df.where("doc_id = 51"), f"{folder}2").count() == 0


def test_query(spark):
    rows = op7_shards(spark, SF).collect()
    sizes = {r.doc_id: len(r.text.encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got: dict = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == {d: n for d, n in sizes.items() if n} and sorted(r.slot for r in rows) == list(range(len(rows)))


def test_ids_of_a_vocabulary(spark, tmp_path):
    """Ids of op9, four bytes each, come back from the shards as they were."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bpe.digests(docs, bpe.Vocabulary(spark, public_tokenizers.path(bpe.RANKS)), keep_ids=True).write.parquet(f"{tmp_path}/ids")
    coded = spark.read.parquet(f"{tmp_path}/ids")
    folder, sizes = f"file://{tmp_path}/out", {"width": 4, "stride": 100, "shard_bytes": 1 << 16}
    index = sorted(shards.materialise(coded, folder, "ids", **sizes).collect())
    parts: dict = {}
    for r, record in zip(index, shards.read(folder, 0, len(index), **sizes), strict=True):
        assert len(record) == 400 and set(record[4 * r.n_tokens :]) <= {0} and r.offset == r.slot % 163 * 400 and r.shard == r.slot // 163
        parts.setdefault(r.doc_id, {})[r.part] = record[: 4 * r.n_tokens]
    assert {d: b"".join(p[k] for k in sorted(p)) for d, p in parts.items()} == {r.doc_id: bytes(r.ids) for r in coded.collect() if r.ids}


def test_broken_ids_raise(spark, tmp_path):
    spark.createDataFrame([(1, b"12345678"), (2, b"123")], "doc_id long, ids binary").write.parquet(f"{tmp_path}/ids")
    with pytest.raises(Exception, match="3 bytes aren't ids of 4 bytes"):
        shards.materialise(spark.read.parquet(f"{tmp_path}/ids"), f"file://{tmp_path}/out", "ids", width=4)
