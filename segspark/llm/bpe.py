"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens. Texts of a task are put together into blocks; a block sends each of
its distinct pre-tokens once, with the list of its positions. Words are shuffled by their hash: a
block's words of one bucket, and their positions, are one compressed message. In its bucket each
distinct word is encoded once, and the ids go back to the blocks, where they are put in order by
position. Decoding joins the table of token bytes.

A null text is an empty one: no ids. Rows with null or repeated doc_id give a row each. A frequent
word is sent once by each block, not for each occurrence. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.shared import tidy, trim
from segspark.llm.text import xxh64

#: Characters of the texts of a block, about: bounds a task's memory (a longer text is a block of its own).
BLOCK_CHARS = 6_000_000
#: Buckets of words for each partition of a shuffle.
BUCKETS = 4
RANKS = "byte_bpe_multi_50k.tiktoken"


def java_pattern(pattern: str) -> str:
    r"""The pattern for Java, whose \s knows ASCII only."""
    return pattern.replace(r"[^\s", r"[^\p{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


class Vocabulary:
    """Ranks that the driver reads once and sends out: a vocabulary's size is fixed."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self._sent = spark.sparkContext.broadcast(f.read())
        self.pattern, self.key = pattern, uuid.uuid4().hex

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in self._sent.value.splitlines() if line)}

    def encoder(self) -> tiktoken.Encoding:
        """For single pre-tokens, built once in each Python worker."""
        if self.key not in _encoders:
            _encoders[self.key] = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks(), special_tokens={})
        return _encoders[self.key]

    def table(self) -> list[bytes]:
        if self.key not in _tables:
            ranks = self.ranks()
            out = [b""] * (max(ranks.values()) + 1)
            for token, i in ranks.items():
                out[i] = token
            _tables[self.key] = out
        return _tables[self.key]


_encoders: dict = {}
_tables: dict = {}


def pack(values: np.ndarray, rows: np.ndarray, n_rows: int) -> pa.Array:
    """Ascending numbers of each row as a binary: differences, seven bits a byte. ``rows`` is sorted."""
    d = values.astype(np.uint32)
    same = rows[1:] == rows[:-1]
    d[1:][same] -= d[:-1][same].copy()
    size = np.ones(len(d), np.uint8)
    for i in range(1, 5):
        size += d >= 1 << 7 * i
    end = np.cumsum(size, dtype=np.int64)
    out = np.zeros(end[-1] if len(end) else 0, np.uint8)
    start = end - size
    for i in range(5):
        has = np.flatnonzero(size > i)
        if not len(has):
            break
        more = size[has] > i + 1
        out[start[has] + i] = ((d[has] >> np.uint32(7 * i)) & np.uint32(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
    offsets = np.zeros(n_rows + 1, np.int64)
    offsets[1:] = np.bincount(rows, size, n_rows)
    return pa.Array.from_buffers(pa.large_binary(), n_rows, [None, pa.py_buffer(np.cumsum(offsets)), pa.py_buffer(out)])


def unpack(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and how many each row has."""
    last = data < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    within = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    d = np.add.reduceat((data & 127).astype(np.int64) << 7 * within, starts) if len(ends) else ends
    counts = np.diff(np.concatenate([[0], np.cumsum(last)])[offsets])
    total = np.cumsum(d)
    before = np.concatenate([[0], total])[np.cumsum(counts) - counts]
    return total - np.repeat(before, counts), counts


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A large binary array's data and offsets."""
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _from_parts(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def _message(sizes: np.ndarray, parts: list[bytes]) -> bytes:
    """Lengths of some binaries, and the binaries, compressed for the shuffle."""
    return zstandard.compress(np.concatenate([[len(sizes)], sizes]).astype("<u4").tobytes() + b"".join(parts), 3)


def _parts(message: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of the binaries."""
    data = np.frombuffer(zstandard.decompress(message), np.uint8)
    at = 4 + 4 * int(data[:4].view("<u4")[0])
    return data[4:at].view("<u4").astype(np.int64), data[at:]


_NAMES = ["block", "bucket", "words", "places"]
_SCHEMA = "block long, bucket int, words binary, places binary"


def _blocks(limit: int, buckets: int):
    """The messages of the texts' blocks: the words of each bucket, and their places. One row of a block, of bucket -1, tells of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []  # doc_id array, pre-token counts, pre-tokens
        size = 0
        for batch in batches:
            sizes = np.cumsum(batch.column("n").to_numpy())
            start = 0
            while start < batch.num_rows:
                room = limit - size + (sizes[start - 1] if start else 0)
                stop = max(int(np.searchsorted(sizes, room, "right")), start + (not held))
                if stop > start:
                    part = batch.slice(start, stop - start)
                    lists = part.column("words")
                    held.append((part.column("doc_id"), np.diff(np.asarray(lists.offsets)), lists.flatten()))
                    size += int(sizes[stop - 1] - (sizes[start - 1] if start else 0))
                if stop < batch.num_rows:
                    yield block(base + number, held)
                    held, size, number = [], 0, number + 1
                start = stop
            batch = part = lists = None  # or else they stay until the next batch is read
        if held:
            yield block(base + number, held)

    def block(number: int, held: list[tuple]) -> pa.RecordBatch:
        ids = pa.concat_arrays([x[0] for x in held])
        counts = np.concatenate([x[1] for x in held]).astype(np.int64)
        coded = pa.concat_arrays([x[2] for x in held]).dictionary_encode()
        held.clear()  # they keep whole batches alive
        words, ends = _bytes(coded.dictionary.cast(pa.large_binary()))
        n = len(ends) - 1
        bucket = (xxh64(words.tobytes(), ends[:-1], ends[1:]) % np.uint64(buckets)).astype(np.int64)
        rank = np.empty(n, np.int32)
        by_bucket = np.argsort(bucket, kind="stable")
        rank[by_bucket] = np.arange(n, dtype=np.int32)
        index = rank[coded.indices.to_numpy()]
        del coded
        order = np.argsort(index, kind="stable").astype(np.uint32)
        places, place_ends = _bytes(pack(order, index[order], n))
        del index, order
        texts = words.tobytes()
        known = np.asarray(ids.is_valid()).astype(np.uint8)
        about = np.asarray(ids.fill_null(0)).astype("<i8").tobytes() + counts.astype("<i8").tobytes() + known.tobytes()
        cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1)).tolist()
        to, sent, kept = [-1], [None], [about]
        starts, lengths = ends[:-1].tolist(), np.diff(ends)
        for i in range(buckets):
            a, b = cuts[i], cuts[i + 1]
            if b > a:
                own = by_bucket[a:b]
                parts = [texts[starts[j] : starts[j] + k] for j, k in zip(own.tolist(), lengths[own].tolist())]
                sent.append(_message(lengths[own], parts))
                kept.append(_message(np.diff(place_ends[a : b + 1]), [places[place_ends[a] : place_ends[b]].tobytes()]))
                to.append(i)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(to), number)), pa.array(to, pa.int32()), _from_parts(sent), _from_parts(kept)], _NAMES)

    return run


def _words_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(batch.column("words").is_valid()).select(_NAMES[:3])


def _encode_words(vocabulary: Vocabulary):
    """The messages with ids in the place of words. Rows are sorted by bucket, so each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.encoder().encode_ordinary
        known: dict[bytes, bytes] = {}
        last = None
        for batch in batches:
            out = []
            for bucket, message in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if bucket != last:
                    last, known = bucket, {}
                lengths, words = _parts(message)
                text, at, ids = words.tobytes(), 0, []
                for n in lengths.tolist():
                    word = text[at : at + n]
                    at += n
                    if (got := known.get(word)) is None:
                        got = known[word] = np.array(encode(word.decode()), "<u4").tobytes()
                    ids.append(got)
                out.append(_message(np.fromiter(map(len, ids), np.int64, len(ids)), ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _from_parts(out)], ["block", "bucket", "ids"])

    return run


def _reassemble(kept: pa.Table, coded: pa.Table) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) of each document of a block."""
    about = kept.filter(pa.compute.equal(kept.column("bucket"), -1)).column("places")[0].as_py()
    places = dict(zip(kept.column("bucket").to_pylist(), kept.column("places").to_pylist()))
    messages = [(ids, places[i]) for i, ids in zip(coded.column("bucket").to_pylist(), coded.column("ids").to_pylist())]
    return _documents(about, messages)


def _documents(about: bytes, messages: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    n = len(about) // 17
    doc_ids, counts = np.frombuffer(about, "<i8", n), np.frombuffer(about, "<i8", n, 8 * n)
    known = np.frombuffer(about, np.uint8, n, 16 * n).astype(bool)
    total = int(counts.sum())
    if total:
        lengths, data = (np.concatenate(x) for x in zip(*(_parts(ids) for ids, _ in messages)))
        place_lengths, places = (np.concatenate(x) for x in zip(*(_parts(p) for _, p in messages)))
        place, uses = unpack(places, np.concatenate([[0], np.cumsum(place_lengths)]))
        if len(place) != total:
            raise RuntimeError(f"A block of {total} pre-tokens came back with {len(place)}.")
        word_at = np.empty(total, np.int32)
        word_at[place] = np.repeat(np.arange(len(uses), dtype=np.int32), uses)
        lengths //= 4
        starts = np.cumsum(lengths) - lengths
        n_ids = lengths[word_at]
        to = np.cumsum(n_ids)
        ids = data.view("<u4")[np.repeat(starts[word_at] - (to - n_ids), n_ids) + np.arange(to[-1])]
        bounds = np.concatenate([[0], to])[np.concatenate([[0], np.cumsum(counts)])]
    else:
        ids, bounds = np.zeros(0, "<u4"), np.zeros(n + 1, np.int64)
    for at in range(0, n, 1000):
        parts = [ids[a:b].tobytes() for a, b in zip(bounds[at : at + 1000].tolist(), bounds[at + 1 : at + 1001].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids[at : at + 1000], mask=~known[at : at + 1000]), _from_parts(parts)], ["doc_id", "ids"])


def _blocks_and_ids(docs: DataFrame, vocabulary: Vocabulary, block_chars: int):
    """The messages of all blocks, and the ids that come back to them, grouped by block."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(java_pattern(vocabulary.pattern)), F.lit(0))
    # a bucket's distinct words must fit into a task's memory: their number follows that of the shuffle's partitions
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n"), words.alias("words")).mapInArrow(tidy(_blocks(block_chars, buckets)), _SCHEMA)
    # one shuffle by block, which is read twice: its words go on to their buckets and come back as ids, its places stay
    blocks = sent.repartition("block")
    coded = blocks.mapInArrow(tidy(_words_only), "block long, bucket int, words binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_encode_words(vocabulary)), "block long, bucket int, ids binary")
    return blocks.groupBy("block").cogroup(coded.groupBy("block"))


def encode(docs: DataFrame, vocabulary: Vocabulary, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids): the ids of every text as little-endian unsigned 32-bit integers."""
    return _blocks_and_ids(docs, vocabulary, block_chars).applyInArrow(lambda kept, coded: pa.Table.from_batches(_reassemble(kept, coded)), "doc_id long, ids binary")


def _decoded(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in memoryview(ids).cast("I")])


def decode(coded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """All columns but ``ids``, and the bytes that the ids stand for."""
    rest = [f for f in coded.schema.fields if f.name != "ids"]
    names = [*(f.name for f in rest), "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary.table()
        for batch in batches:
            decoded = [_decoded(x, table) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-1]), _from_parts(decoded)], names)

    return coded.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "decoded binary"]))


def digests(docs: DataFrame, vocabulary: Vocabulary, keep_ids: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) after encoding and decoding every text, and the ids if asked for.

    A block's ids are decoded where they are put together, so neither they nor the decoded bytes travel.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]

    def run(kept: pa.Table, coded: pa.Table) -> pa.Table:
        table, out = vocabulary.table(), []
        for batch in _reassemble(kept, coded):
            ids = batch.column("ids").to_pylist()
            digest = lambda parts: pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
            columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), digest(ids), digest(_decoded(x, table) for x in ids)]
            out.append(pa.RecordBatch.from_arrays([*columns, *[batch.column("ids")] * keep_ids], names))
        trim()
        return pa.Table.from_batches(out)

    return _blocks_and_ids(docs, vocabulary, block_chars).applyInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
