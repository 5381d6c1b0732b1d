"""Exact top-k inner products by sorted lists that are only read in sequence.

Each block of items has one list per dimension, sorted by value. A query reads the list of a
dimension from its larger contributions on: from the top if its component is positive, from the
bottom if it is negative. After each round of reading every item has a lower bound (what was read
of it, and the least contribution of each list still unread) and an upper bound (the frontier of
each such list). Lower bounds are running sums: a round adds what it reads, each element once. A query stops when the items that could still reach its k-th lower bound are few;
their final scores are then resolved. Queries of a block read in common rounds, so that a round is
four matrix products: two over what it reads, two over what is left unread.

Vectors that are null, or hold null or non-finite components, take no part. Shorter vectors count
as padded with zeros. A query's own id is no candidate of it. Each row of a repeated id is a query
and a candidate of its own. A score that a long can't hold raises. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of items, and of a block of queries: one task's unit holds one of each.
ITEM_BLOCK, QUERY_BLOCK = 8192, 512
#: How deep the lists have been read at the end of each round, as parts of them: denser where bounds become tight.
DEPTHS = (1 / 16, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16, 1)
#: Few items, after which scores are resolved: this many times k, or this part of the block.
FEW, PART = 8, 32


def quantized(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, as longs."""
    ok = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.where(F.col(vec_col).isNotNull() & ok).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def nra(items: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, int]]:
    """For each query the numbers of the items that may be among its k best: all of those with a score of its k-th best too.

    With them comes how deep the query's lists were read.
    """
    n = len(items)
    out: list[tuple[np.ndarray, int]] = [(np.arange(n), n)] * len(queries)
    if n <= FEW * k:
        return out
    order = np.argsort(items, axis=0, kind="stable")
    lists = np.take_along_axis(items, order, 0)
    rank = np.empty(items.shape, np.int32)
    np.put_along_axis(rank, order, np.arange(n, dtype=np.int32)[:, None], 0)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    alive, depth = np.arange(len(queries)), 0
    # before anything is read each list gives its least; what is read then adds its difference from that, once
    lower = np.broadcast_to((up * lists[0] + down * lists[-1]).sum(1), (n, len(queries)))
    over = items - lists[0], items - lists[-1]
    for part in DEPTHS:
        before, depth = depth, max(1, math.ceil(n * part))
        # read: from the top of a list, or from its bottom
        top, low = rank >= n - depth, rank < depth
        lower = lower + np.where(top & (rank < n - before), over[0], 0) @ up.T + np.where(low & (rank >= before), over[1], 0) @ down.T
        if depth < n:
            # lists in which an item is unread give it their frontier at most
            gap = up * (lists[n - depth] - lists[0]), down * (lists[depth - 1] - lists[-1])
            upper = lower + (gap[0] + gap[1]).sum(1) - top.astype(items.dtype) @ gap[0].T - low.astype(items.dtype) @ gap[1].T
        else:
            upper = lower
        may = upper >= np.partition(lower, n - k, axis=0)[n - k]
        done = (may.sum(0) <= max(FEW * k, n // PART)) | (depth == n)
        for i in np.flatnonzero(done):
            out[alive[i]] = np.flatnonzero(may[:, i]), depth
        alive, lower, up, down = alive[~done], lower[:, ~done], up[~done], down[~done]
        if not len(alive):
            break
    return out


def _unit(k: int):
    def run(queries: pa.Table, items: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        if queries.num_rows and items.num_rows:
            x, q = _matrix(items), _matrix(queries)
            width = max(x.shape[1], q.shape[1])
            x, q = _pad(x, width), _pad(q, width)
            ids = items.column("vec_id").to_numpy(zero_copy_only=False)
            own = queries.column("vec_id").to_numpy(zero_copy_only=False)
            row = queries.column("row").to_pylist()
            # bounds are at most four times this sum: the smallest type that holds them exactly
            most = _largest(x) * _largest(q) * width * 4
            exact = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
            # k + 1 and those that tie: the query's own rows may be among them
            extra = int(np.unique(ids, return_counts=True)[1].max())
            x, q = x.astype(exact), q.astype(exact)
            for i, (near, _) in enumerate(nra(x, q, k + extra)):
                near = near[ids[near] != own[i]]
                score = (x[near] @ q[i]).astype(np.int64)
                best = np.lexsort((ids[near], -score))[:k]
                for column, values in zip(found, ([own[i]] * len(best), [row[i]] * len(best), ids[near][best], score[best])):
                    column.extend(values)
        return pa.table([pa.array(c, pa.int64()) for c in found], ["query_id", "row", "vec_id", "score"])

    return run


def _matrix(t: pa.Table) -> np.ndarray:
    """The vectors as rows, shorter ones padded with zeros."""
    v = pa.concat_arrays(t.column("v").chunks)
    sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False)
    out = np.zeros((len(v), sizes.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
    return out


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _pad(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def search(vectors: DataFrame, is_query: Column, k: int = 5, item_block: int = ITEM_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of (vec_id, v) for each row that is a query, ties to smaller ids."""
    known = vectors.where(F.col("vec_id").isNotNull())
    sizes = known.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    items, blocks = max(1, -(-sizes.n // item_block)), max(1, -(-sizes.q // query_block))
    spread = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(n)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = known.where(is_query).withColumn("row", F.monotonically_increasing_id()).select("vec_id", "row", "v", spread(blocks).alias("qb"), every(items).alias("ib"))
    right = known.select("vec_id", "v", spread(items).alias("ib"), every(blocks).alias("qb"))
    found = left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInArrow(_unit(k), "query_id long, row long, vec_id long, score long")
    w = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
