"""Tables in the shared folder, and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def free_name(name: str, columns: list[str]) -> str:
    """The name, with as many underscores as it takes to differ from all columns in any letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only where it is unset and all runs on one machine, as in tests, a local one is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise RuntimeError(f"spark.checkpoint.dir is unset: on {master} intermediate tables need a folder that all executors share.")
        where = f"file://{tempfile.mkdtemp(prefix='checkpoint')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_scratch: ContextVar[list | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch():
    """Tables that are written within are deleted at the end, but for those to keep."""
    before = _scratch.set([])
    try:
        yield
    finally:
        delete(*_scratch.get())
        _scratch.reset(before)


#: Spark's setting that removes the shuffle files of a query at its end, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, and is whole after the loss of executors. Its shuffle files go."""
    path, conf = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    if not keep and _scratch.get() is not None:
        _scratch.get().append(out)
    return out


def delete(*tables: DataFrame) -> None:
    for t in tables:
        jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t._path)
        path.getFileSystem(conf).delete(path, True)


def trim() -> None:
    """Gives the memory that a Python worker has freed back to the machine: idle workers stay for other stages."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """The same function for mapInArrow, with trim() at its end."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


#: Edges that a task contracts at once: bounds its memory.
EDGES = 1 << 19


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that connect the same nodes: stars around the smallest of those that EDGES edges of a task connect."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        nodes, ends = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
        a, b = ends[: t.num_rows], ends[t.num_rows :]
        root = np.arange(len(nodes))
        while True:
            # each end's root takes the smaller of both roots, then all point to their root's root
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            while (new != new[new]).any():
                new = new[new]
            new = new[root]
            if (new == root).all():
                break
            root = new
        leaf = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[root[leaf]])], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= EDGES:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that can be reached.

    Tasks first contract what they hold. Then large-star and small-star rounds: each keeps the number of edges within bounds
    and ends after a number of rounds that grows with the logarithm of the longest path. All joins have AQE's skew handling.
    """

    def fewer(rows: DataFrame) -> DataFrame:
        """Tasks hold EDGES rows each, about: few edges are contracted as a whole."""
        stored = written(rows)
        out = written(stored.coalesce(max(1, -(-stored.count() // EDGES))).mapInArrow(tidy(contracted), "a long, b long"))
        delete(stored)
        return out

    now = fewer(edges.where("a <> b").select("a", "b"))
    while not _stars(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = fewer(small)
        delete(now)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node with a smaller neighbour has only that one, which has none itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()
