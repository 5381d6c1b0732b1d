"""Pairs of texts by the Jaccard similarity of their sets of shingles: exact, with prefix filters.

A node is a set of shingles, named by a 64-bit hash of it. Two sets of the wanted similarity share one of
their rarest shingles, as many as the similarity takes, whatever order ranks the shingles; ranks come from
counters of a fixed size, which decide on work only. What can be similar enough by sizes and places is
verified on whole sets, and only between nodes that no known link connects yet (their roots differ).

Keys with many rows are dealt out in blocks; the rows of the root that most of them have meet only blocks of
other rows, so that a large group of copies is not held against itself. A key whose block has more open pairs than a few for each
row sends its rows with their sets to one place, where all its pairs are verified and a spanning forest of
the links comes out: so what is shuffled grows with rows, not with pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm import text as T
from segspark.llm.shared import tidy, written

#: Rows, and shingles of their sets, of one key that make a block: bounds what a task holds of a key.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: So many rows of a block are held against its others first.
CENTRES = 8
#: Open pairs for each row of a block beyond which its rows are verified at one place.
PAIRS = 8
#: Bits of the counters by which shingles are ranked: 4 MB, whatever the input.
COUNTERS = 20
#: Different shingles that are compared at once.
_COLUMNS = 2048


def sets_of(texts: list[bytes], shingle: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted hashes of each text's different shingles, and a 64-bit hash of each such set."""
    clean, start, end, doc = T.shingles(texts, shingle)
    h = T.xxh64(clean, start, end)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    sets = [np.unique(h[a:b]) for a, b in zip(at, at[1:])]
    return sets, names_of(sets)


def names_of(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTERS)).astype(np.int64)


def _concat(arrays: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, dtype)


def count_into(counts: np.ndarray, sets: list[np.ndarray]) -> None:
    """Adds how many sets have a shingle, by the first bits of its hash."""
    np.add.at(counts, _bucket(_concat(sets, np.uint64)), 1)


def counter_rows(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Counters in blocks, so that those of all tasks are summed on the executors."""
    return pa.array(range(64), pa.int64()), pa.array([x.tobytes() for x in np.split(counts, 64)], pa.binary())


def summed(counted: DataFrame) -> np.ndarray:
    """The counts (block, counts) of all tasks: 64 rows of a fixed size go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts")):
                part = np.frombuffer(counts.as_buffer(), np.uint32)
                sums[block] = sums[block] + part if block in sums else part.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    rows = counted.repartition("block").mapInArrow(tidy(run), "block long, counts binary").collect()
    return np.concatenate([np.frombuffer(r.counts, np.uint32) for r in sorted(rows)]) if rows else np.zeros(1 << COUNTERS, np.uint32)


def prefixes(docs: DataFrame, shingle: int, similarity: float, counts) -> DataFrame:
    """(key, salt, node, place): of each text's n different shingles the rarest n - similarity * n + 1; place is n and the rank.

    Keys whose counter is far above the mean have salts, so that the rows of a very common one are dealt out; others have -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most_rows = max(BLOCK, 4 * int(counts.value.mean()))
        for batch, texts in T.chunks(batches, "text"):
            sets, ids = sets_of(texts, shingle)
            keys, salts, places, nodes = [], [], [], []
            for i in np.unique(ids, return_index=True)[1].tolist():
                s, n = sets[i], len(sets[i])
                most = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
                count = counts.value[_bucket(s)]
                order = np.lexsort((s, count))[:most]
                keys.append(s[order])
                parts = count[order].astype(np.int64) // most_rows
                salts.append(np.where(parts, (int(ids[i]) >> 8) % (parts + 1), -1).astype(np.int32))
                places.append((n << 32) + np.arange(most))
                nodes.append(np.full(most, ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(_concat(keys, np.uint64).view(np.int64)), pa.array(_concat(salts, np.int32)), pa.array(_concat(nodes, np.int64)), pa.array(_concat(places, np.int64))], ["key", "salt", "node", "place"])

    return docs.mapInArrow(tidy(run), "key long, salt int, node long, place long")


def met(rows: DataFrame) -> DataFrame:
    """(key, node, place), each once, of the keys with several nodes, and of all keys with salts."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        last = None
        for batch in batches:
            if batch.num_rows:
                pair = np.stack([batch.column("key").to_numpy(), batch.column("node").to_numpy()], 1)
                new = np.concatenate([[last is None or bool((pair[0] != last).any())], (pair[1:] != pair[:-1]).any(1)])
                last = pair[-1]
                yield pa.Table.from_batches([batch.filter(pa.array(new))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = [], False  # the last row so far, and whether one before has its key
        for t in once(batches):
            t = pa.concat_tables([*held, t]).combine_chunks()
            if not t.num_rows:
                continue
            key = t.column("key").to_numpy()
            same = key[1:] == key[:-1]
            keep = np.concatenate([[known], same]) | np.concatenate([same, [False]]) | (t.column("salt").to_numpy() >= 0)
            last = len(key) - 1
            yield from t.slice(0, last).filter(pa.array(keep[:-1])).select(names).to_batches()
            held, known = [t.slice(last)], bool(keep[-1])
        if known:
            yield from held[0].select(names).to_batches()

    names = ["key", "node", "place"]
    return rows.repartition("key", "salt").sortWithinPartitions("key", "node").mapInArrow(tidy(run), "key long, node long, place long")


def rooted(rows: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(key, node, place, root, k, hub, strays) of the keys that have several roots; k is the number of their blocks.

    Without roots each node is its own. With them, a key of several blocks has a hub, the root of most of its rows: the other
    rows make the first blocks, ``strays`` in number, and those of the hub the rest. Otherwise hub is null.
    """
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum(F.shiftright("place", 32)) / F.lit(BLOCK_SHINGLES))).cast("int")
    if roots is None:
        keys = written(rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), blocks.alias("k")).where("lo < hi").select("key", "k"))
        return rows.select("*", F.col("node").alias("root")).join(keys, "key").withColumns({"hub": F.lit(None).cast("long"), "strays": F.col("k")})
    known = written(rows.join(roots, "node", "left").select("key", "node", "place", F.coalesce("root", "node").alias("root")))
    several = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), blocks.alias("k")).where("lo < hi").select("key", "k")
    keys = written(several)
    hubs = known.join(keys.where("k > 1"), "key").groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("hub"))
    parted = known.join(keys.where("k > 1"), "key").join(hubs, "key").groupBy("key", "hub", (F.col("root") == F.col("hub")).alias("mass")).agg(blocks.alias("k"))
    parts = parted.groupBy("key", "hub").agg(F.sum("k").cast("int").alias("k"), F.sum(F.when(F.col("mass"), 0).otherwise(F.col("k"))).cast("int").alias("strays"))
    one = keys.where("k = 1").select("key", F.lit(None).cast("long").alias("hub"), "k", F.col("k").alias("strays"))
    return known.join(written(one.union(parts.select("key", "hub", "k", "strays"))), "key")


def candidates(rows: DataFrame, similarity: float, centres: bool) -> DataFrame:
    """(kind, key, i, j, a, b) of the pairs a, b (kind 0) of rows with a common key and different roots that can be similar enough.

    With ``centres`` each row is held against CENTRES rows of its own block only. Without, against all rows of the
    key in pairs of blocks (i, j), but for pairs of the hub's blocks; of a pair of blocks with too many pairs come the nodes a instead (kind 1, b null).
    """
    by = ["key", "i", "j"]
    names = ["kind", *by, "a", "b"]
    n_centres, most_pairs = CENTRES, PAIRS

    def pairs(number: np.ndarray, node: np.ndarray, place: np.ndarray, root: np.ndarray) -> Iterator[np.ndarray]:
        """Numbers of two rows of each pair."""
        starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        sizes = np.diff([*starts, len(number)])
        n, rank = place >> 32, place & 0xFFFFFFFF

        def fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            # at their first common shingle, sets share that one and what follows it in both at most
            most = np.minimum(n[a] - rank[a], n[b] - rank[b])
            ok = (root[a] != root[b]) & (most >= similarity / (1 + similarity) * (n[a] + n[b]) - 1e-6)
            return np.stack([a[ok], b[ok]], 1)

        end, rest = np.repeat(starts + sizes, sizes), np.arange(len(number))
        if centres:
            for i in range(n_centres):
                centre = np.repeat(starts + i, sizes)
                later = rest[rest > centre]
                yield fit(centre[later], later)
            return
        mixed = np.repeat(np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts), sizes)
        rest = rest[mixed]
        for step in range(1, int(sizes.max())):
            rest = rest[rest + step < end[rest]]
            if not len(rest):
                return
            yield fit(rest, rest + step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(t: pa.Table, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            number = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).any(1)]))
            node, place, root = (t.column(c).to_numpy() for c in ("node", "place", "root"))
            sizes = np.bincount(number)
            made, dense, kept = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool), []
            touched = np.zeros(len(number), bool)
            for p in pairs(number, node, place, root):
                of = number[p[:, 0]]
                made += np.bincount(of, minlength=len(sizes))
                dense |= made > most_pairs * sizes
                if not centres:
                    touched[p.ravel()] = True
                    p, of = p[~dense[of]], of[~dense[of]]
                kept.append(np.stack([of, node[p[:, 0]], node[p[:, 1]]], 1))
            p = np.concatenate(kept) if kept else np.zeros((0, 3), np.int64)
            if not centres:
                p = p[~dense[p[:, 0]]]
                whole = np.flatnonzero(touched & dense[number])
                if len(whole):
                    yield batch_of(1, keys[whole], node[whole], None)
            p = np.unique(np.sort(p[:, 1:], axis=1), axis=0)
            for at in range(0, len(p), 1 << 16):
                part = p[at : at + (1 << 16)]
                yield batch_of(0, np.zeros((len(part), 3), np.int64), part[:, 0], part[:, 1])

        def batch_of(kind: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            last = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(keys[:, c]) for c in range(3)), pa.array(a), last], names)

        yield from by_runs(batches, by, emit)

    name, mass = F.xxhash64("node", "key"), F.coalesce(F.col("root") == F.col("hub"), F.lit(False))
    own = F.when(mass, F.col("strays") + F.pmod(name, F.greatest(F.col("k") - F.col("strays"), F.lit(1)))).otherwise(F.pmod(name, F.col("strays"))).cast("long")
    placed = rows.withColumn("own", own)
    if centres:
        dealt = placed.select("key", F.col("own").alias("i"), F.col("own").alias("j"), "node", "place", "root")
    else:
        # rows of one root aren't held against each other: those of the hub meet the blocks of the others only
        met_by = F.when(mass, F.col("strays")).otherwise(F.col("k"))
        dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), met_by - 1))).select("key", F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j"), "node", "place", "root")
    return dealt.repartition(*by).sortWithinPartitions(*by, F.xxhash64("node", "key"), "node").mapInArrow(tidy(run), "kind int, key long, i long, j long, a long, b long")


def by_runs(batches: Iterator[pa.RecordBatch], by: list[str], emit) -> Iterator[pa.RecordBatch]:
    """What emit gives for rows sorted by ``by``, called with whole runs of equal values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        t = pa.Table.from_batches([*held, batch]).combine_chunks()
        if not t.num_rows:
            continue
        keys = np.stack([t.column(c).to_numpy() for c in by], 1)
        other = np.flatnonzero((keys != keys[-1]).any(1))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield from emit(t.slice(0, cut), keys[:cut])
        held = t.slice(cut).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield from emit(t, np.stack([t.column(c).to_numpy() for c in by], 1))


def sets_at(docs: DataFrame, where: DataFrame, shingle: int) -> DataFrame:
    """(node, s): the set of each node of ``where`` (node, doc_id), read from the text of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in T.chunks(batches, "text"):
            sets, ids = sets_of(texts, shingle)
            first = np.unique(ids, return_index=True)[1]
            ends = np.cumsum([0, *(len(sets[i]) for i in first)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.ListArray.from_arrays(pa.array(ends), pa.array(_concat([sets[i] for i in first], np.uint64).view(np.int64)))], ["node", "s"])

    found = docs.join(where.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(tidy(run), "node long, s array<long>")
    # a document's id may be that of other texts too, or of many copies
    return found.join(where.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("s").alias("s"))


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as that."""
    left, right = (sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    shared, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    like = F.least(F.size("sa"), F.size("sb")) >= similarity * F.greatest(F.size("sa"), F.size("sb"))
    return pairs.join(left, "a").join(right, "b").where(like & (shared >= similarity * (total - shared))).select("a", "b")


def linked_blocks(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect what all pairs of that similarity connect within each block (key, i, j) of the nodes a."""
    by = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(t: pa.Table, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
            for a, n in zip(cuts.tolist(), np.diff([*cuts, len(keys)]).tolist()):
                part = t.slice(a, n).combine_chunks()
                s = part.column("s").chunk(0)
                ends = s.offsets.to_numpy()
                links = forest(part.column("node").to_numpy(), s.flatten().to_numpy(), np.diff(ends), similarity)
                if len(links):
                    yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

        yield from by_runs(batches, by, emit)

    whole = rows.select(*by, F.col("a").alias("node")).join(sets, "node")
    return whole.repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(tidy(run), "a long, b long")


def forest(node: np.ndarray, values: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
    """Links of a spanning forest of all pairs of sets (their values one after the other) with that similarity."""
    n = len(node)
    owner = np.repeat(np.arange(n), size)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    several = count > 1
    number = np.cumsum(several) - 1
    use = several[column]
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((n, n), np.float32)
    for first in range(0, int(several.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [first, first + _COLUMNS])
        holds = np.zeros((n, _COLUMNS), np.float32)
        holds[owner[a:b], column[a:b] - first] = 1
        shared += holds @ holds.T
    near = shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-4
    out, rest = [], np.ones(n, bool)
    for start in range(n):
        if not rest[start]:
            continue
        rest[start], queue = False, [start]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(near[i] & rest)
            rest[new] = False
            queue += new.tolist()
            out += [(int(node[i]), int(node[j])) for j in new]
    return np.array(out, np.int64).reshape(-1, 2)
