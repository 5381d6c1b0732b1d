"""Token ids in training order, as shards of fixed-stride binary records.

Every row's ids, little-endian and of a stated width in bytes, are cut into sequences of STRIDE ids, the last
one padded. A text column is taken as its bytes of UTF-8, which are ids of width 1; a binary column holds ids of any
encoder, such as those of bpe.encode (width 4). The n sequences, numbered in the order of the table, get global slots 0 to n - 1 by a keyed Feistel
permutation: a balanced network over the next even number of bits, walked until the slot is below n.
Sequences are dealt to shards by ranges of slots and written in slot order, each record STRIDE ids
wide, so that record k of a shard is at byte k * STRIDE * width, and a reader can stop and resume
at any slot. A shard appears under its name when it is whole; one that a repeated task writes again has the same bytes.
The shards are written once, when materialise is called; the table that it returns is a stored one.

A null or empty row has no sequences; one whose bytes aren't whole ids raises. 0 pads; n_tokens of the table tells it
from an id 0 at the end. Repeated or null doc_ids are sequences of their own. The table must be one that reads the same again, as a stored one does. Extra columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.shared import shared_dir, written

STRIDE, KEY, SHARD_BYTES, ROUNDS = 512, 20240229, 32 << 20, 4


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of the sequences x under a keyed permutation of 0 to n - 1."""
    half = max(1, -(-(n - 1).bit_length() // 2))
    low, mask = np.uint64(half), np.uint64((1 << half) - 1)
    rng = np.random.default_rng(key)
    keys = rng.integers(0, 2**64, ROUNDS, dtype=np.uint64)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> low, out[todo] & mask
            for k in keys:
                f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(32)) & mask)
            out[todo] = (left << low) | right
            todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _sequences(offsets: dict[int, int], n: int, per_shard: int, stride: int, width: int, key: int):
    """(shard, slot, doc_id, part, n_tokens, ids) of the sequences; ids are compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = offsets.get(TaskContext.get().partitionId(), 0)
        pack = zstandard.ZstdCompressor(level=1).compress
        step = stride * width
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                doc, part, size, data = [], [], [], []
                for d, t in zip(some.column("doc_id").to_pylist(), some.column("ids").to_pylist()):
                    if len(t or b"") % width:
                        raise ValueError(f"doc_id {d}: {len(t)} bytes aren't ids of {width} bytes each")
                    for k in range(0, len(t or b""), step):
                        s = t[k : k + step]
                        doc.append(d)
                        part.append(k // step)
                        size.append(len(s) // width)
                        data.append(pack(s))
                slot = feistel(np.arange(number, number + len(doc)), n, key)
                number += len(doc)
                arrays = [pa.array((slot // per_shard).astype(np.int32)), pa.array(slot), pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array(size, pa.int32()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, _NAMES)

    return run


_NAMES = ["shard", "slot", "doc_id", "part", "n_tokens", "ids"]


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _write(folder: str, per_shard: int, record_bytes: int):
    """Writes the shards of a task, whose rows are sorted by slot, and tells where each sequence is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        out, shard, temporary = None, None, None

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(temporary, f"{path}/{shard_name(shard)}")

        for batch in batches:
            crc = []
            for s, data in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist()):
                if s != shard:
                    close()
                    shard, temporary = s, f"{path}/_{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary, buffer_size=1 << 20)
                record = unpack.decompress(data, max_output_size=record_bytes).ljust(record_bytes, b"\0")
                out.write(record)
                crc.append(zlib.crc32(record))
            slot = batch.column("slot").to_numpy()
            arrays = [batch.column("slot"), batch.column("shard"), pa.array(slot % per_shard * record_bytes), batch.column("doc_id"), batch.column("part"), batch.column("n_tokens"), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["slot", "shard", "offset", "doc_id", "part", "n_tokens", "crc32"])
        close()

    return run


def materialise(docs: DataFrame, folder: str, column: str = "text", width: int = 1, stride: int = STRIDE, key: int = KEY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards into the folder; returns (slot, shard, offset, doc_id, part, n_tokens, crc32) of every sequence, a stored table."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("binary").alias("ids"))
    record_bytes = stride * width
    # sequences of each task, one row for a task: where its numbers start
    counts = texts.select(F.spark_partition_id().alias("p"), F.ceil(F.coalesce(F.octet_length("ids"), F.lit(0)) / record_bytes).alias("n")).groupBy("p").agg(F.sum("n").alias("n")).collect()
    offsets, n = {}, 0
    for r in sorted(counts, key=lambda r: r.p):
        offsets[r.p] = n
        n += int(r.n)
    per_shard = max(1, shard_bytes // record_bytes)
    shards = max(1, -(-n // per_shard))
    spark = docs.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    rows = texts.mapInArrow(_sequences(offsets, max(n, 1), per_shard, stride, width, key), "shard int, slot long, doc_id long, part int, n_tokens int, ids binary")
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    return written(dealt.mapInArrow(_write(folder, per_shard, record_bytes), "slot long, shard int, offset long, doc_id long, part int, n_tokens int, crc32 long"), keep=True)


def read(folder: str, start: int, stop: int, width: int = 1, stride: int = STRIDE, shard_bytes: int = SHARD_BYTES) -> Iterator[bytes]:
    """The records of slots start to stop - 1, in order, from wherever the last reader stopped."""
    fs, path = pa.fs.FileSystem.from_uri(folder)
    record_bytes = stride * width
    per_shard = max(1, shard_bytes // record_bytes)
    while start < stop:
        shard, first = divmod(start, per_shard)
        count = min(stop - start, per_shard - first)
        with fs.open_input_file(f"{path}/{shard_name(shard)}") as f:
            f.seek(first * record_bytes)
            for _ in range(count):
                yield f.read(record_bytes)
        start += count


def new_folder(docs: DataFrame) -> str:
    return f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
