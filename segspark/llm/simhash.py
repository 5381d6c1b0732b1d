"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 n bits is cut into so few segments that, of two fingerprints within the
distance, one segment differs in at most one bit. Each segment is indexed with each of its bits
masked out, so such segments meet under an equal key. Rows of one key are verified on the whole
fingerprint and yield a spanning forest of their links, never all pairs.

Nulls: a null text is an empty one. A document without words has fingerprint zero and is linked
like any other. Rows with a null doc_id have a fingerprint and no component of their own: they get
the smallest doc_id of their group (null if it has none). Rows that share a doc_id keep a
fingerprint each; their component is that of both. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from segspark.llm import similarity as S
from segspark.llm import text as T
from segspark.llm.shared import components, scratch, tidy, written

#: Rows of one key that one task compares; larger groups are compared in pairs of blocks of that size.
BLOCK = 2048
#: Keys of up to so many rows are compared row by row at equal offsets, for all keys of a batch at once.
SMALL = 64


def _bits(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document the bits that are set in over half of its hashes; doc is sorted."""
    out = np.zeros(n_docs, np.uint64)
    at = np.searchsorted(doc, np.arange(n_docs + 1))
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    for i in np.flatnonzero(np.diff(at)):
        part = bits[at[i] : at[i + 1]]
        out[i] = np.packbits(part.sum(0, dtype=np.int64) * 2 > len(part), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, n: int = 1) -> DataFrame:
    """(doc_id, f0, f1, ...): n fingerprints of 64 bits as longs. f0 is of the XXH64 of the shingles (seed 42)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in T.chunks(batches, "text"):
            clean, start, end, doc = T.shingles(texts, shingle)
            h = T.xxh64(clean, start, end)
            f = [_bits(T.mix64(h, j) if j else h, doc, len(texts)) for j in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x.view(np.int64)) for x in f)], names)

    names = ["doc_id", *(f"f{j}" for j in range(n))]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), ", ".join(f"{x} long" for x in names))


def _segments(bits: int, count: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; all lie within one word of 64 bits."""
    words, out = bits // 64, []
    for w in range(words):
        k = count // words
        cuts = [round(64 * i / k) for i in range(k + 1)]
        out += [(64 * w + a, b - a) for a, b in zip(cuts, cuts[1:])]
    return out


def variants(prints: DataFrame, n: int, segments: int) -> DataFrame:
    """(key, node, f0, ...): each segment with each of its bits masked out. A key holds segment, bit and the rest."""

    def keys(first: int, width: int, number: int):
        word, shift = first // 64, first % 64
        mask = (1 << width) - 1
        part = F.shiftrightunsigned(F.col(f"f{word}"), shift).bitwiseAND(F.lit(mask))
        for i in range(width):
            # width 32 at most: the masked segment, the bit's number (6 bits) and the segment's number fit into a long
            yield part.bitwiseAND(F.lit(mask & ~(1 << i))) + F.lit(((number << 6) + i) << 33)

    all_keys = [k for number, (first, width) in enumerate(_segments(64 * n, segments)) for k in keys(first, width, number)]
    return prints.select(F.explode(F.array(*all_keys)).alias("key"), "node", *(f"f{j}" for j in range(n)))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1)


def _forest(node: np.ndarray, f: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect what is within ``most`` bits, by a search that compares each row with the rows not yet reached."""
    out, rest = [], np.arange(len(node))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = _distance(f[rest], f[i]) <= most
            for j in rest[near]:
                out.append((int(node[i]), int(node[j])))
                queue.append(j)
            rest = rest[~near]
    return out


def _runs(key: np.ndarray, node: np.ndarray, f: np.ndarray, most: int) -> np.ndarray:
    """Links of all keys; rows are sorted by key. First each row is held against its key's first row, all at once.

    What is not near the first row is held against the others: in keys of up to SMALL rows all at once too.
    """
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff([*starts, len(key)])
    first = np.repeat(starts, sizes)
    near = _distance(f, f[first]) <= most
    linked = near & (first != np.arange(len(key)))
    pairs = [np.stack([node[first[linked]], node[linked]], 1)]
    missed = (np.add.reduceat(~near, starts) > 0) & (sizes > 2)
    end = np.repeat(starts + sizes, sizes)
    rest = np.flatnonzero(np.repeat(missed & (sizes <= SMALL), sizes) & (first != np.arange(len(key))))
    for step in range(1, SMALL):
        rest = rest[rest + step < end[rest]]
        if not len(rest):
            break
        a = rest[~(near[rest] & near[rest + step])]
        a = a[_distance(f[a], f[a + step]) <= most]
        pairs.append(np.stack([node[a], node[a + step]], 1))
    for s, n in zip(starts[missed & (sizes > SMALL)].tolist(), sizes[missed & (sizes > SMALL)].tolist()):
        if more := _forest(node[s : s + n], f[s : s + n], most):
            pairs.append(np.array(more, np.int64))
    return np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)


def _link_sorted(n: int, most: int, block: int, by: list[str], spill: bool):
    """A function for mapInArrow over rows sorted by ``by``: links (a, b) with kind 0.

    With ``spill`` the rows of a key with over ``block`` rows come out themselves, with kind 1.
    """
    fs = [f"f{j}" for j in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(pairs: np.ndarray) -> pa.RecordBatch:
            zero = pa.array(np.zeros(len(pairs), np.int64))
            return pa.RecordBatch.from_arrays([zero, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *[zero] * n], names)

        held: list[pa.RecordBatch] = []  # rows of the last key so far
        for batch in batches:
            tail = pa.Table.from_batches([*held, batch]).combine_chunks()
            keys = np.stack([tail.column(c).to_numpy() for c in by], 1)
            cut = _last_start(keys)
            done, held = tail.slice(0, cut), tail.slice(cut).to_batches()
            yield from emit(done, keys[:cut], links)
            if spill and tail.num_rows - cut > block:
                yield spilled(tail.slice(cut))
                held = []
                over.add(int(keys[-1, 0]))
        if held:
            tail = pa.Table.from_batches(held).combine_chunks()
            yield from emit(tail, np.stack([tail.column(c).to_numpy() for c in by], 1), links)

    over: set[int] = set()  # keys whose rows go out as they come

    def spilled(t: pa.Table) -> pa.RecordBatch:
        one = pa.array(np.ones(t.num_rows, np.int64))
        return pa.RecordBatch.from_arrays([one, *(t.column(c).combine_chunks() for c in ("key", "node", *fs))], names)

    def emit(t: pa.Table, keys: np.ndarray, links):
        if not t.num_rows:
            return
        changes = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        sizes = np.diff([*changes, len(keys)])
        number = np.repeat(np.arange(len(sizes)), sizes)
        large = np.repeat((sizes > block) | (np.isin(keys[changes, 0], list(over)) if over else False), sizes) if spill else np.zeros(len(keys), bool)
        if large.any():
            yield spilled(t.filter(pa.array(large)))
        small = ~large & (np.repeat(sizes, sizes) > 1)
        if small.any():
            f = np.stack([t.column(c).to_numpy() for c in fs], 1)[small].view(np.uint64)
            pairs = _runs(number[small], t.column("node").to_numpy()[small], f, most)
            if len(pairs):
                yield links(pairs)

    names = ["kind", "a", "b", *fs]
    return run, ", ".join(f"{x} long" for x in names)


def _last_start(keys: np.ndarray) -> int:
    """Where the run of the last key starts."""
    other = np.flatnonzero((keys != keys[-1]).any(1))
    return int(other[-1]) + 1 if len(other) else 0


def links(prints: DataFrame, n: int = 1, distance: int = 3, segments: int = 2, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect the nodes of (node, f0, ...) as all links within ``distance`` bits do.

    Complete if distance <= 2 * segments - 1. Nodes and fingerprints should be distinct.
    """
    rows = variants(prints, n, segments)
    run, schema = _link_sorted(n, distance, block, ["key"], True)
    first = written(rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(tidy(run), schema))
    found = first.where("kind = 0").select("a", "b")
    large = first.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"), *(f"f{j}" for j in range(n)))
    if not large.isEmpty():
        # a key with very many fingerprints: all pairs of blocks, each a task's group of its own
        blocks = large.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("k"))
        placed = large.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
        pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("key", "node", *(f"f{j}" for j in range(n)), F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j"))
        run, schema = _link_sorted(n, distance, block, ["key", "i", "j"], False)
        more = pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(tidy(run), schema)
        found = found.union(written(more.select("a", "b").distinct()))
    return found.distinct()


def groups(docs: DataFrame, shingle: int = 3, n: int = 1, distance: int = 3, segments: int = 2, block: int = BLOCK) -> DataFrame:
    """(doc_id, f0, ..., component_id): component_id is the smallest doc_id that links can reach."""
    fs = [f"f{j}" for j in range(n)]
    with scratch():
        prints = written(fingerprints(docs, shingle, n))
        # one node for each different fingerprint: its smallest doc_id. Rows without an id get a node of their own above all ids.
        distinct = prints.groupBy(*fs).agg(F.min("doc_id").alias("least"))
        nodes = written(distinct.select(*fs, F.coalesce("least", F.lit(_NO_ID) + F.pmod(F.xxhash64(*fs), F.lit(1 << 60))).alias("node")))
        found = links(nodes.select("node", *fs), n, distance, segments, block)
        # both sides are stored tables, so that a fingerprint with very many copies is split over tasks
        rows = written(prints.join(nodes, fs))
        # the fingerprints of one doc_id are linked
        own = written(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last"))
        shared_id = rows.join(own, "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct()
        roots = components(found.union(shared_id))
        known = rows.join(roots, "node", "left").select("doc_id", *fs, F.coalesce("root", "node").alias("root"))
        return written(known.select("doc_id", *fs, F.when(F.col("root") < _NO_ID, F.col("root")).alias("component_id")), keep=True)


#: Nodes of rows without a doc_id start here; doc_ids are smaller.
_NO_ID = 1 << 62


def _seen(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, node, f0) of each text, node being the name of its set of shingles; then (block, counts) of a task's counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << S.COUNTERS, np.uint32)
        for batch, texts in T.chunks(batches, "text"):
            clean, start, end, doc = T.shingles(texts, shingle)
            h = T.xxh64(clean, start, end)
            at = np.searchsorted(doc, np.arange(len(texts) + 1))
            sets = [np.unique(h[a:b]) for a, b in zip(at, at[1:])]
            S.count_into(counts, sets)
            none = pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(S.names_of(sets)), pa.array(_bits(h, doc, len(texts)).view(np.int64)), none, pa.nulls(len(texts), pa.binary())], names)
        if counts.any():
            block, parts = S.counter_rows(counts)
            none = pa.nulls(len(block), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, block, parts], names)

    names = ["doc_id", "node", "f0", "block", "counts"]
    return docs.mapInArrow(tidy(run), "doc_id long, node long, f0 long, block long, counts binary")


def deduplicate(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 3, segments: int = 2, block: int = BLOCK) -> DataFrame:
    """The documents of which one of each group stays, that with the smallest doc_id; all columns are kept.

    Links are all pairs of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 at
    least; documents of an equal set are one node. Fingerprints within ``distance`` bits, found by deletion variants,
    come first: their links are reduced to stars before they are verified. They hold the closest copies only (at a similarity of 0.8 nine to ten of
    64 bits differ), so an exact search for the other pairs follows.

    Rows are documents: rows that share a doc_id but not a set are judged apart. Of equal rows one stays, of rows with
    one doc_id and set that which is smallest as JSON. Rows without a doc_id stay and link nothing.
    """
    with scratch():
        known = docs.where("doc_id is not null")
        texts = known.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        seen = written(_seen(texts, shingle))
        rows = seen.where("block is null").select("doc_id", "node", "f0")
        nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("f0").alias("f0")))
        counts = docs.sparkSession.sparkContext.broadcast(S.summed(seen.where("block is not null").select("block", "counts")))

        def sets(ends: DataFrame) -> DataFrame:
            return written(S.sets_at(texts, nodes.join(ends.distinct(), "node", "left_semi"), shingle))

        # equal and near fingerprints: each node with the smallest of those that links reach
        prints = written(nodes.groupBy("f0").agg(F.min("node").alias("node")))
        equal = nodes.select("node", "f0").join(prints.select("f0", F.col("node").alias("a")), "f0").where("node <> a").select("a", F.col("node").alias("b"))
        stars = components(links(prints, 1, distance, segments, block)).where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        # all other pairs: first some rows of each key against the others, then all that no verified link connects
        first_texts = texts.join(nodes.select("doc_id").distinct(), "doc_id", "left_semi")
        met = written(S.met(S.prefixes(first_texts, shingle, similarity, counts)))
        centres = S.candidates(S.rooted(met), similarity, True).select("a", "b")
        tried = written(equal.union(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(centres).distinct())
        found = written(S.confirmed(tried, sets(tried.select(F.explode(F.array("a", "b")).alias("node"))), similarity))
        rest = written(S.candidates(S.rooted(met, components(found)), similarity, False))
        pairs = written(rest.where("kind = 0").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
        dense = rest.where("kind = 1")
        held = sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).union(dense.select(F.col("a").alias("node"))))
        found = found.union(S.confirmed(pairs, held, similarity)).union(S.linked_blocks(dense, held, similarity))
        roots = components(found)
        first = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min(F.struct("doc_id", "node")).alias("first"))
        keep = written(first.select("first.*"), keep=True)
        several = written(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), keep=True)
        counts.unpersist()
    return _kept(docs, known, several, keep, shingle)


def _kept(docs: DataFrame, known: DataFrame, several: DataFrame, keep: DataFrame, shingle: int) -> DataFrame:
    """The rows of the documents that ``keep`` (doc_id, node) names, and those without a doc_id; ``several`` has the repeated ids."""
    none = docs.where("doc_id is null")
    if several.isEmpty():
        return known.join(keep.select("doc_id"), "doc_id", "left_semi").select(*docs.columns).union(none)
    single = known.join(keep.join(several, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in T.chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(S.sets_of(texts, shingle)[1])], names)

    whole = known.join(several, "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("id"), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    names = ["id", "text", "whole", "node"]
    fields = StructType([*whole.schema.fields, StructField("node", LongType())])
    named = whole.mapInArrow(tidy(run), fields).join(keep.withColumnRenamed("doc_id", "id"), ["id", "node"], "left_semi")
    one = named.groupBy("id", "node").agg(F.min_by("whole", F.to_json("whole")).alias("whole"))
    return single.select(*docs.columns).union(one.select("whole.*")).union(none)
