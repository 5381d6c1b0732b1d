"""Short test items in long documents, by size-partitioned MinHash containment.

Items are partitioned by their number of shingles, at powers of two. For each partition a document
is read in overlapping windows of twice that many shingles, so that a window and an item are of like
size and a high containment is a high similarity. A window whose minimum of one hash function equals
an item's is a possible hit; it is verified by the exact share of the item's shingles in the document.

Items are the small side: a block of them of at most ITEM_BLOCK_BYTES goes to all tasks, and a longer
list takes a scan of the documents for each block. Nothing is shuffled.

A null or empty text, and an item without words, has no shingles and matches nothing; a text of fewer
words than a shingle counts as one. Repeated documents and items give a row each. Extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm import text as T
from segspark.llm.shared import tidy

SHINGLE, SHARE = 5, 0.8
#: Hash functions. A stretch with SHARE of an item has a similarity of 0.19 at least with its window: 1.4e-6 of them are missed.
HASHES = 64
ITEM_BLOCK_BYTES = 16 << 20
#: Most bits that a partition's filter of minima is addressed by, for each hash function: 2**18 bytes each.
_FILTER_BITS = 18

_rng = np.random.default_rng(5)
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def _hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    clean, start, end, doc = T.shingles(texts, size)
    return T.xxh64(clean, start, end), doc


class Items:
    """The shingles of some items, and by partition and hash function their minima."""

    def __init__(self, rows: list[tuple], size: int):
        h, owner = _hashes([r[1] for r in rows], size)
        at = np.searchsorted(owner, np.arange(len(rows) + 1))
        self.ids = [r[0] for r in rows]
        self.sets = [np.unique(h[a:b]) for a, b in zip(at, at[1:])]
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]] = {}
        level = np.array([int(len(s) - 1).bit_length() for s in self.sets])
        with np.errstate(over="ignore"):
            for c in sorted(set(level[[len(s) > 0 for s in self.sets]].tolist())) if len(rows) else []:
                own = [i for i in np.flatnonzero(level == c) if len(self.sets[i])]
                low = np.array([[(self.sets[i] * a + b).min() for a, b in zip(_A, _B)] for i in own])
                bits = min(_FILTER_BITS, len(own).bit_length() + 5)
                might, shift = np.zeros((HASHES, 1 << bits), bool), np.uint64(64 - bits)
                for j in range(HASHES):
                    might[j, low[:, j] >> shift] = True
                order = np.argsort(low, axis=0)
                self.parts[c] = (np.array(own)[order].T, np.take_along_axis(low, order, 0).T, might, shift)

    def near(self, h: np.ndarray, doc: np.ndarray) -> set[tuple[int, int]]:
        """Possible (text, item) pairs for the shingle hashes of some texts, in text order."""
        out: set[tuple[int, int]] = set()
        if not self.parts or not len(h):
            return out
        first = min(self.parts)
        # blocks of 2**first shingles, none over the end of a text
        lead = np.arange(len(h)) - np.searchsorted(doc, doc)
        cuts = np.flatnonzero(lead % (1 << first) == 0)
        owner, number = doc[cuts], lead[cuts] >> first
        for j in range(HASHES):
            with np.errstate(over="ignore"):
                low = np.minimum.reduceat(h * _A[j] + _B[j], cuts)
            text, at = owner, number
            for c in range(first, max(self.parts) + 1):
                if c > first:
                    pairs = np.flatnonzero(at % 2 == 0)
                    low, text, at = np.minimum.reduceat(low, pairs), text[pairs], at[pairs] >> 1
                if c in self.parts:
                    items, lows, might, shift = self.parts[c]
                    window = low.copy()
                    joined = text[1:] == text[:-1]
                    window[:-1][joined] = np.minimum(low[:-1], low[1:])[joined]
                    hits = np.flatnonzero(might[j][window >> shift])
                    left, right = (np.searchsorted(lows[j], window[hits], side) for side in ("left", "right"))
                    for w, a, b in zip(hits[right > left], left[right > left], right[right > left]):
                        out.update((int(text[w]), int(i)) for i in items[j, a:b])
        return out


class _Search:
    """Finds verified matches in batches of texts, with items that are sent out once."""

    def __init__(self, rows: list[tuple], size: int, share: float, docs: DataFrame):
        self.sent, self.size, self.share, self.key = docs.sparkSession.sparkContext.broadcast(rows), size, share, uuid.uuid4().hex

    def items(self) -> Items:
        if self.key not in _built:
            _built.clear()
            _built[self.key] = Items(self.sent.value, self.size)
        return _built[self.key]

    def of(self, texts: list[bytes]) -> list[tuple]:
        """(text number, item_id, shared, shingles) of each match."""
        items = self.items()
        h, doc = _hashes(texts, self.size)
        at = np.searchsorted(doc, np.arange(len(texts) + 1))
        found, whole = [], {}
        for d, i in sorted(items.near(h, doc)):
            if d not in whole:
                whole[d] = np.unique(h[at[d] : at[d + 1]])
            n = int(np.isin(items.sets[i], whole[d], assume_unique=True).sum())
            if n >= self.share * len(items.sets[i]):
                found.append((d, items.ids[i], n, len(items.sets[i])))
        return found


_built: dict[str, Items] = {}


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size."""
    listed = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = listed.agg(F.sum(F.octet_length("text") + 16).alias("n")).first().n or 0
    n = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield [(r.item_id, r.text.encode()) for r in (listed.where(part == i) if n > 1 else listed).collect()]


def matches(docs: DataFrame, items: DataFrame, size: int = SHINGLE, share: float = SHARE, block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles): documents that hold at least ``share`` of an item's different shingles."""

    def one(block: list[tuple]) -> DataFrame:
        search = _Search(block, size, share, docs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in T.chunks(batches, "text"):
                if found := search.of(texts):
                    d, *rest = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "item_id", "n_shared", "n_shingles"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, item_id long, n_shared long, n_shingles long")

    return reduce(DataFrame.union, map(one, _blocks(items, block_bytes)))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SHINGLE, share: float = SHARE, block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """The documents without those that match an item; all columns are kept."""

    def one(rest: DataFrame, block: list[tuple]) -> DataFrame:
        search = _Search(block, size, share, docs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in T.chunks(batches, "text"):
                keep = np.ones(len(texts), bool)
                keep[[d for d, *_ in search.of(texts)]] = False
                yield batch.filter(pa.array(keep))

        return rest.mapInArrow(tidy(run), rest.schema)

    return reduce(one, _blocks(items, block_bytes), docs)
