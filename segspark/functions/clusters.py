"""Character clusters as one JVM regular expression; their offsets by an Arrow function."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from segspark import charsets as C


def _single(c: Column) -> Column:
    """Whether each character of a text is a cluster of its own, since none starts a longer one. Not for empty texts."""
    return (F.length(c) > 0) & F.is_valid_utf8(c) & ~F.rlike(c, F.lit(C.CLUSTER_START))


def clusters(col: Column | str) -> Column:
    """The clusters of a text in order; they join back to the text. NULL gives an empty array."""
    c = F.col(col) if isinstance(col, str) else col
    found = F.when(_single(c), F.split(c, "")).otherwise(F.regexp_extract_all(c, F.lit(C.CLUSTER), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>"))


@F.arrow_udf(ArrayType(IntegerType()))
def running(lengths: pa.Array) -> pa.Array:
    """The running sums of each array: of all arrays of a batch at once."""
    offsets = lengths.offsets.to_numpy()
    total = np.concatenate([[0], np.cumsum(lengths.flatten().to_numpy(), dtype=np.int64)])
    starts = offsets - offsets[0]
    sums = total[1:] - np.repeat(total[starts[:-1]], np.diff(starts))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(sums, pa.int32()))


def ends_of(tokens: Column) -> Column:
    """End offsets of the parts of a text, in code points; the array is not null."""
    return running(F.transform(tokens, F.length))


def cluster_ends(col: Column | str) -> Column:
    """End offsets of the clusters, in code points: a sequence where each character is a cluster, which needs no Python."""
    c = F.col(col) if isinstance(col, str) else col
    longer = ends_of(F.when(_single(c), F.array().cast("array<string>")).otherwise(clusters(c)))
    return F.when(_single(c), F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))).otherwise(longer)


def cluster_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, pos, cluster, end): offsets are made within a text, so nothing is shuffled."""
    found = df.select(F.col(id_col), clusters(text_col).alias("clusters"), cluster_ends(text_col).alias("ends"))
    return found.select(id_col, F.posexplode(F.arrays_zip("clusters", "ends")).alias("pos", "c")).select(id_col, "pos", F.col("c.clusters").alias("cluster"), F.col("c.ends").alias("end"))
