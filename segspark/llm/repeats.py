"""Repeated byte strings of a fixed length, by bucket-pointer refinement over sampled suffixes.

A suffix's bucket is named by a 64-bit hash of its first h bytes, so that every executor gives the
same name. Buckets are refined by the bucket of a later offset: the name for 2h bytes is made of the
names for h bytes here and h bytes on, and each name once made is used again for the next lengths
(2, 4, ..., 64, then GRAM and LENGTH bytes).

Any LENGTH bytes hold one place with the smallest GRAM bucket (leftmost of equals): its anchor. Runs
of strings with one anchor are sent to the bucket of that anchor, one row a run. There:
runs that agree as a whole with an earlier run are repeats; runs that share only the anchor's bucket
are refined by the buckets of their single strings, made from the bytes around the anchor.
Buckets with one run go; those of very many runs are never brought together, but
their strings are sent under names of their own, after each task has set aside those that it has seen before. A run that a task has seen before is a repeat at once and not sent on,
so a passage that is everywhere gives a row for each chunk of text, not for each of its copies.

A null text is an empty one. Rows with null or repeated doc_id are allowed: their order is by
doc_id (nulls first), then text; equal rows count as copies in that order. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.shared import written

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1  # anchors' places in a string
#: Bytes that are hashed at once; longer texts are cut into overlapping pieces of that size.
PIECE = 1 << 20
#: Runs of one bucket that are refined in one task; the strings of larger (hot) buckets are dealt out by their own names.
RUNS = 1000

_K1, _K2, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32)
_BYTE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of longer strings from those of their two parts."""
    with np.errstate(over="ignore"):
        x = a * _K1
        x ^= x >> _R
        x += b
        x *= _K2
        x ^= x >> _R
        return x


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of GRAM and of LENGTH bytes at each place of at least LENGTH bytes."""
    by = {1: _BYTE[data]}
    for h in (2, 4, 8, 16, 32, 64):
        x = by[h // 2]
        by[h] = _pair(x[: len(x) - h // 2], x[h // 2 :])
    n = len(data)
    at = lambda h, off, count: by[h][off : off + count]
    gram = _pair(at(16, 0, n - 23), at(8, 16, n - 23))
    m = n - LENGTH + 1
    return gram, _pair(at(64, 0, m), _pair(at(32, 64, m), at(4, 96, m)))


def _anchors(gram: np.ndarray, m: int) -> np.ndarray:
    """The anchor of the string at each of m places: a sliding minimum of the name, then the place."""
    low = np.uint64((1 << 24) - 1)
    x = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    rest = SPAN - width
    return (np.minimum(x[:m], x[rest : rest + m]) & low).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ids, text offsets, sizes): texts and pieces of long texts, about PIECE bytes together."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        return data, np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64), np.array([len(x[2]) for x in held], np.int64)

    for batch in batches:
        for i, t in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            for at in range(0, max(0, len(t or b"") - LENGTH + 1), PIECE):
                piece = t[at : at + PIECE + LENGTH - 1]
                held.append((i, at, piece))
                size += len(piece)
                if size >= PIECE:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


_RUN = ["key", "u", "id", "place"]
_RUN_SCHEMA = "key long, u long, id long, place long"
# place: start of a run in its text, its last start less the first (8 bits), 1 for a candidate and 0 for a repeat


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of all texts. Those that agree with an earlier run of the same chunk are repeats already."""
    for data, ids, offsets, sizes in _pieces(batches):
        gram, string = names(data)
        m = len(string)
        ends = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(sizes)), sizes)[:m]
        inside = np.arange(m) + LENGTH <= ends[piece]
        anchor = _anchors(gram, m)
        new = np.ones(m, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(new & inside)
        last_of = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
        n = last_of - first
        a = anchor[first]
        key = gram[a]
        u = _pair(_pair(string[first], string[last_of]), (n * 256 + (a - first)).astype(np.uint64))
        doc, start = ids[piece[first]], offsets[piece[first]] + first - (ends - sizes)[piece[first]]
        order = np.lexsort((start, doc, u))
        again = np.zeros(len(first), bool)
        again[order[1:]] = u[order[1:]] == u[order[:-1]]
        key[again] = _pair(doc[again].view(np.uint64), start[again].astype(np.uint64))
        place = (start << 9) | (n << 1) | ~again
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), u.view(np.int64), doc, place)], _RUN)


_FOUND = ["kind", "key", "id", "start", "stop"]
_FOUND_SCHEMA = "kind int, key long, id long, start long, stop long"


def _found(kind: int, key: np.ndarray, doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), *(pa.array(x) for x in (key, doc, start, stop))], _FOUND)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, u, id, place): repeats (kind 0), and the first runs of their kind where a bucket has several (kind 1)."""
    last = None  # the last candidate: key, u, and the last first-of-its-kind (row, whether its bucket had another before)
    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns], 1)
        sure = (rows[:, 3] & 1) == 0
        for doc, place in [rows[sure][:, 2:].T]:
            if len(doc):
                yield _found(0, doc, doc, place >> 9, (place >> 9) + ((place >> 1) & 255))
        rows = rows[~sure]
        if not len(rows):
            continue
        before = np.concatenate([[last[0] if last else rows[0] - 1], rows[:-1]])
        new_key = rows[:, 0] != before[:, 0]
        new_kind = new_key | (rows[:, 1] != before[:, 1])
        if not last:
            new_kind[0] = new_key[0] = True
        again = rows[~new_kind]
        if len(again):
            yield _found(0, again[:, 0], again[:, 2], again[:, 3] >> 9, (again[:, 3] >> 9) + ((again[:, 3] >> 1) & 255))
        kinds = rows[new_kind]
        joined = ~new_key[new_kind]
        if last:
            kinds, joined = np.concatenate([[last[1]], kinds]), np.concatenate([[last[2]], joined])
        several = joined.copy()
        several[:-1] |= joined[1:]
        out = kinds[:-1][several[:-1]]
        if len(out):
            yield _found(1, out[:, 0], out[:, 2], out[:, 3] >> 9, (out[:, 3] >> 9) + ((out[:, 3] >> 1) & 255))
        last = (rows[-1], kinds[-1], joined[-1])
    if last and last[2]:
        out = last[1][None]
        yield _found(1, out[:, 0], out[:, 2], out[:, 3] >> 9, (out[:, 3] >> 9) + ((out[:, 3] >> 1) & 255))


def _strings(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, start and name of every string of some runs (key, id, start, bytes), in order."""
    sizes = np.array([len(r[3]) for r in rows])
    _, name = names(np.frombuffer(b"".join(r[3] for r in rows), np.uint8))
    count = sizes - LENGTH + 1
    run = np.repeat(np.arange(len(rows)), count)
    lead = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    doc, start = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    return doc[run], start[run] + lead, name[(np.cumsum(sizes) - sizes)[run] + lead]


def _spans(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, first and last start of the stretches that strings, in order of id and start, make up."""
    cut = np.flatnonzero((np.diff(start) != 1) | (np.diff(doc) != 0)) + 1
    a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(doc)]]) - 1
    return doc[a], start[a], start[b]


_CONTEXT = ["key", "id", "start", "stop", "bytes"]
_CONTEXT_SCHEMA = "key long, id long, start long, stop long, bytes binary"
#: Runs of hot buckets whose strings are held against each other before they are sent.
_TOGETHER = 4000


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The listed runs of texts with their bytes. Runs of a hot bucket give their strings instead, each under its own name.

    Without bytes a row is such a string (stop -1), or a stretch of strings that another one sent from here precedes.
    """

    def rows(key: np.ndarray, doc: np.ndarray, start: np.ndarray, stop: np.ndarray, parts: list[bytes] | None = None) -> pa.RecordBatch:
        held = pa.nulls(len(doc), pa.binary()) if parts is None else pa.array(parts, pa.binary())
        return pa.RecordBatch.from_arrays([*map(pa.array, (key, doc, start, stop)), held], _CONTEXT)

    def single(some: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, start, name = _strings(some)
        order = np.lexsort((start, doc, name))
        again = np.zeros(len(name), bool)
        again[order[1:]] = name[order[1:]] == name[order[:-1]]
        yield rows(name[~again].view(np.int64), doc[~again], start[~again], np.full((~again).sum(), -1))
        if again.any():
            order = np.lexsort((start, doc))
            doc, first, last = _spans(*(x[order][again[order]] for x in (doc, start)))
            yield rows(_pair(doc.view(np.uint64), first.astype(np.uint64)).view(np.int64), doc, first, last)

    apart: list[tuple] = []
    for batch in batches:
        for doc, text, runs in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs")):
            if len(runs):
                key, start, stop, hot = (runs.values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                parts = np.array([text[a : b + LENGTH] for a, b in zip(start.tolist(), stop.tolist())], object)
                if (~hot).any():
                    yield rows(key[~hot], np.full((~hot).sum(), doc), start[~hot], stop[~hot], parts[~hot].tolist())
                apart += [(None, doc, a, x) for a, x in zip(start[hot].tolist(), parts[hot].tolist())]
                while len(apart) >= _TOGETHER:
                    yield from single(apart[:_TOGETHER])
                    apart = apart[_TOGETHER:]
    if apart:
        yield from single(apart)


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, id, start): strings that start earlier too (kind 0)."""

    def repeats(rows: list[tuple]):
        doc, start, name = _strings(rows)
        first = np.zeros(len(name), bool)
        first[np.unique(name, return_index=True)[1]] = True
        if not first.all():
            doc, start, stop = _spans(doc[~first], start[~first])
            yield _found(0, doc, doc, start, stop)

    ready: list[tuple] = []  # rows of whole buckets
    held: list[tuple] = []  # rows of the bucket that has not ended
    last = None  # the last name of a single string
    for batch in batches:
        whole = batch.column("bytes").is_valid().to_numpy(zero_copy_only=False)
        key, doc, start, stop = (batch.column(i).to_numpy() for i in range(4))
        sure, alone = ~whole & (stop >= 0), ~whole & (stop < 0)
        if sure.any():
            yield _found(0, doc[sure], doc[sure], start[sure], stop[sure])
        if alone.any():
            name = key[alone]
            again = np.concatenate([[last is not None and name[0] == last], name[1:] == name[:-1]])
            last = name[-1]
            if again.any():
                yield _found(0, doc[alone][again], doc[alone][again], start[alone][again], start[alone][again])
        for row in zip(*(x[whole].tolist() for x in (key, doc, start)), batch.column("bytes").drop_null().to_pylist()):
            if held and row[0] != held[0][0]:
                ready += held
                held = []
                if len(ready) > 4000:
                    yield from repeats(ready)
                    ready = []
            held.append(row)
    if ready + held:
        yield from repeats(ready + held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the bytes of its repeats."""
    for batch in batches:
        kept, removed, spans, sizes = [], [], [], []
        for text, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs")):
            text = text or b""
            parts, at, gone, n = [], 0, 0, 0
            if runs.is_valid and len(runs):
                start, stop = runs.values.field(0).to_numpy(), runs.values.field(1).to_numpy() + LENGTH
                order = np.argsort(start, kind="stable")
                start, reach = start[order], np.maximum.accumulate(stop[order])
                new = np.concatenate([[True], start[1:] > reach[:-1]])
                begin, end = start[new], reach[np.concatenate([new[1:], [True]])]
                for a, b in zip(begin.tolist(), end.tolist()):
                    parts.append(text[at:a])
                    at, gone, n = b, gone + b - a, n + 1
            parts.append(text[at:])
            kept.append(b"".join(parts))
            removed.append(gone)
            spans.append(n)
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, id, text): ids are different and follow the order of the documents."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.select("doc_id", F.col("doc_id").alias("id"), "text")
    return written(docs.orderBy("doc_id", "text").select("doc_id", F.monotonically_increasing_id().alias("id"), "text"))


def remove(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): every text's bytes without those that a string of LENGTH bytes with an earlier start covers."""
    texts = _numbered(docs)
    sent = texts.where(F.octet_length("text") >= LENGTH).select("id", "text").mapInArrow(_runs, _RUN_SCHEMA)
    compared = written(sent.repartition("key").sortWithinPartitions("key", "u", "id", "place").mapInArrow(_compare, _FOUND_SCHEMA))
    several = compared.where("kind = 1")
    # buckets of very many runs are not brought together: their strings are dealt out by their own names
    hot = written(several.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > runs).select("key", F.lit(True).alias("hot")))
    listed = several.join(hot, "key", "left").groupBy("id").agg(F.collect_list(F.struct("key", "start", "stop", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs"))
    # both joins read one shuffle of the texts
    whole = texts.select("id", "text", "doc_id")
    around = whole.join(listed.hint("shuffle_hash"), "id").select("id", "text", "runs").mapInArrow(_contexts, _CONTEXT_SCHEMA)
    refined = written(around.repartition("key").sortWithinPartitions("key", "id", "start").mapInArrow(_refine, _FOUND_SCHEMA))
    found = compared.where("kind = 0").union(refined)
    gone = found.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    return whole.join(gone.hint("shuffle_hash"), "id", "left").select("doc_id", "text", "runs").mapInArrow(_cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
