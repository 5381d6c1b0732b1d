"""Quality scores: random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities.

Words are runs of lower-case letters, of capitals, of digits or of other signs; each also gives its
shape (kind and length). A word's vector is the sum of the fixed sparse random vectors of the words
around it, over all documents; words are hashed into BUCKETS, so the table's size is fixed. Sums are
of integers, so they do not depend on order. A document's features are the mean and the deviation of
its word vectors. The network learns from at most MAX_LABELLED labelled documents, those with the
smallest hash of their doc_id; its temperature is fitted on the part of them that training leaves out.

A null or empty text has the features of no words and a score too. Labels without quality or doc_id
are not used; of several labels of a document the largest counts. Without both classes among the
labels every score is the smoothed share of ones. Of rows that share a labelled doc_id one teaches. Each input row gives one row. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.llm.shared import free_name, tidy
from segspark.llm.text import chunks, xxh64

BUCKETS, SHAPES, DIMS = 4096, 64, 32
#: Words on each side that count as context, and non-zero components of a word's random vector.
CONTEXT, NONZERO = 2, 2
#: Bound of the labelled sample that the network learns from.
MAX_LABELLED = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 60, 128, 3e-3, 1e-3, 7

_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 lower case and non-ASCII, 2 capitals, 3 signs, 4 digits
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123] = _KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 4

_rng = np.random.default_rng(SEED)
_PLACE = _rng.integers(0, DIMS, (BUCKETS, NONZERO))
_SIGN = _rng.choice([-1, 1], (BUCKETS, NONZERO))


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of each word and shape, in order: the shape stands before its word."""
    joined = b"\n".join(texts)
    kind = _KIND[np.frombuffer(joined, np.uint8)]
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], kind[1:] != kind[:-1]])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(kind))
    word = kind[start] > 0
    start, end = start[word], end[word]
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    doc = np.searchsorted(at, start, "right") - 1
    shape = (kind[start].astype(np.int64) - 1) * 16 + np.minimum(end - start, 15)
    bucket = SHAPES + (xxh64(joined, start, end) % np.uint64(BUCKETS - SHAPES)).astype(np.int64)
    return np.stack([shape, bucket], 1).ravel(), np.repeat(doc, 2)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of context vectors: a row for each bucket that it has seen."""
    sums = np.zeros(BUCKETS * DIMS)
    for _, texts in chunks(batches, "text"):
        ids, doc = word_ids(texts)
        for off in range(1, CONTEXT + 1):
            same = doc[off:] == doc[:-off]
            a, b = ids[:-off][same], ids[off:][same]
            for j in range(NONZERO):
                sums += np.bincount(a * DIMS + _PLACE[b, j], _SIGN[b, j], BUCKETS * DIMS)
                sums += np.bincount(b * DIMS + _PLACE[a, j], _SIGN[a, j], BUCKETS * DIMS)
    yield from _rows(sums.astype("<i8").reshape(BUCKETS, DIMS))


def _rows(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    seen = np.flatnonzero(sums.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array([sums[i].tobytes() for i in seen], pa.binary())], ["bucket", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BUCKETS, DIMS), "<i8")
    for batch in batches:
        for i, s in zip(batch.column("bucket").to_pylist(), batch.column("sums").to_pylist()):
            total[i] += np.frombuffer(s, "<i8")
    yield from _rows(total)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all buckets from all documents, of unit length; buckets that never occur have zero."""
    schema = "bucket int, sums binary"
    found = docs.select("text").mapInArrow(tidy(_contexts), schema).repartition("bucket").mapInArrow(_add, schema).toArrow()
    out = np.zeros((BUCKETS, DIMS))
    for i, s in zip(found.column("bucket").to_pylist(), found.column("sums").to_pylist()):
        out[i] = np.frombuffer(s, "<i8")
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the word vectors of each text."""
    ids, doc = word_ids(texts)
    out = np.zeros((len(texts), 2 * DIMS), np.float32)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i in np.flatnonzero(np.diff(at)):
        counts = np.bincount(ids[at[i] : at[i + 1]], minlength=BUCKETS)
        used = np.flatnonzero(counts)
        w = (counts[used] / counts[used].sum()).astype(np.float32)
        v = vectors[used]
        mean = w @ v
        out[i, :DIMS] = mean
        out[i, DIMS:] = np.sqrt(np.maximum(w @ (v * v) - mean * mean, 0))
    return out


class Network:
    """Standardized features, one hidden layer, one output and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = (y.sum() + 1) / (len(y) + 2)
        self.constant = len(y) < 4 or y.min() == y.max()
        if self.constant:
            return
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(y))
        held = order[: max(1, len(y) // 5)] if len(y) >= 20 else order
        learn = order[max(1, len(y) // 5) :] if len(y) >= 20 else order
        self.mean, self.scale = x[learn].mean(0), x[learn].std(0) + 1e-3
        x = (x - self.mean) / self.scale
        # classes weigh alike in training; the offset puts their true shares back
        share = np.clip(y[learn].mean(), 1e-3, 1 - 1e-3)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(learn), -(-len(learn) // BATCH)):
                h = np.tanh(x[part] @ p[0] + p[1])
                g = (_sigmoid(h @ p[2] + p[3]) - y[part]) * weight[part] / len(part)
                gh = np.outer(g, p[2]) * (1 - h * h)
                grads = [x[part].T @ gh + DECAY * p[0], gh.sum(0), h.T @ g + DECAY * p[2], g.sum(keepdims=True)]
                t += 1
                for a, d, b, c in zip(p, grads, m, v):
                    b += 0.1 * (d - b)
                    c += 0.001 * (d * d - c)
                    a -= RATE * (b / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.999**t)) + 1e-8)
        self.weights = p
        self.offset = np.log(share / (1 - share))
        logits = self._logits(x[held])
        loss = lambda s: -np.mean(np.log(np.where(y[held] == 1, _sigmoid(s), _sigmoid(-s)) + 1e-12))
        self.temperature = min(np.geomspace(0.25, 8, 61), key=lambda z: loss(logits / z + self.offset))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        p = self.weights
        return np.tanh(x @ p[0] + p[1]) @ p[2] + p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(x), self.prior)
        return _sigmoid(self._logits((x - self.mean) / self.scale) / self.temperature + self.offset)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def held_out() -> Column:
    """Whether a document's label is not for learning: crc32 of its doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[Broadcast, Broadcast]:
    """Word vectors of all documents, and the network of the labelled sample; both of fixed size."""
    sc = docs.sparkSession.sparkContext
    vectors = sc.broadcast(word_vectors(docs))
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.col("quality").cast("int").alias("quality"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            x = pooled(texts, vectors.value).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    # the sample's size is bounded, so it may be sent everywhere
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")
    made = rows.mapInArrow(features, "doc_id long, quality int, x binary").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("x").alias("x"))
    got = made.toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    x = np.stack([np.frombuffer(r, "<f4") for r in got.column("x").to_pylist()]).astype(float) if got.num_rows else np.zeros((0, 2 * DIMS))
    return vectors, sc.broadcast(Network(x, np.array(got.column("quality").to_pylist(), float)))


def score(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """All columns of the documents and ``score``, the probability of quality 1; ``score_`` if they have a column of that name."""
    vectors, network = fit(docs, labels, most)
    fields = docs.schema.fields
    name = free_name("score", docs.columns)
    names = [*(f.name for f in fields), name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            s = network.value.scores(pooled(texts, vectors.value))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-1]), pa.array(s)], names)

    return docs.select(*(f"`{f.name}`" for f in fields)).mapInArrow(tidy(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"{name} double"]))
