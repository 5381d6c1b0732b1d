"""Words, shingles and their hashes for many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes that are worked on at once: bounds a Python worker's memory (a single longer text is one chunk).
CHUNK_BYTES = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer spans are hashed one by one.
_VECTOR_LIMIT = 256


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` bytes of text, and their texts as bytes; null texts are empty."""
    for batch in batches:
        texts = batch.column(column)
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(texts):
            room = limit + (ends[start - 1] if start else 0)
            stop = max(start + 1, int(np.searchsorted(ends, room, "right")))
            yield batch.slice(start, stop - start), [t or b"" for t in texts.slice(start, stop - start).cast(pa.binary()).to_pylist()]
            start = stop


def words(texts: list[bytes], lower: bool = True) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with one space for each run of ASCII white space; start, end and text number of every word."""
    joined = b"\n".join(texts)
    a = np.frombuffer(joined.translate(_LOWER) if lower else joined, np.uint8)
    space = (a == 32) | ((a >= 9) & (a <= 13))
    before, after = np.ones(len(a), bool), np.ones(len(a), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    first, last = np.flatnonzero(~space & before), np.flatnonzero(~space & after)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    doc = np.searchsorted(at, first, "right") - 1
    keep = ~space | ~before
    to = np.cumsum(keep) - 1
    clean = np.where(space, np.uint8(32), a)[keep]
    return clean.tobytes(), to[first], to[last] + 1, doc


def shingles(texts: list[bytes], size: int, lower: bool = True) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All shingles of ``size`` words, repeats included, as spans of a buffer with their text number, in text order.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    clean, start, end, doc = words(texts, lower)
    n = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    where = np.cumsum(n) - n
    lead = np.arange(len(doc)) - where[doc]
    begins = np.flatnonzero((lead == 0) | (lead + size <= n[doc]))
    tail = np.minimum(begins + size, (where + n)[doc[begins]]) - 1
    return clean, start[begins], end[tail], doc[begins]


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _mix(lane: np.ndarray) -> np.ndarray:
    return _rotl(lane * _P2, 31) * _P1


def _hash_length(words8: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """XXH64 of spans that all have n bytes."""
    i, s = 0, np.uint64(seed)
    with np.errstate(over="ignore"):
        if n >= 32:
            acc = [np.full(len(at), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            while i + 32 <= n:
                for j in range(4):
                    acc[j] = _rotl(acc[j] + words8[at + (i + 8 * j)] * _P2, 31) * _P1
                i += 32
            h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for x in acc:
                h = (h ^ _mix(x)) * _P1 + _P4
        else:
            h = np.full(len(at), s + _P5, np.uint64)
        h += np.uint64(n)
        while i + 8 <= n:
            h = _rotl(h ^ _mix(words8[at + i]), 27) * _P1 + _P4
            i += 8
        if i + 4 <= n:
            h = _rotl(h ^ ((words8[at + i] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            i += 4
        while i < n:
            h = _rotl(h ^ ((words8[at + i] & np.uint64(0xFF)) * _P5), 11) * _P1
            i += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def xxh64(buffer: bytes, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many spans of a buffer, by groups of equal length."""
    out = np.empty(len(start), np.uint64)
    padded = buffer + bytes(8)
    words8 = np.ndarray((len(buffer) + 1,), "<u8", padded, strides=(1,))
    length = end - start
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for group in np.split(order, cuts) if len(order) else []:
        n = int(length[group[0]])
        if n <= _VECTOR_LIMIT:
            out[group] = _hash_length(words8, start[group], n, seed)
        else:
            out[group] = [xxhash.xxh64_intdigest(buffer[a : a + n], seed) for a in start[group].tolist()]
    return out


def mix64(h: np.ndarray, key: int) -> np.ndarray:
    """Another 64-bit hash from one (the finalizer of splitmix64); a bijection for each key."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))
