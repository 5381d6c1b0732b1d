"""URL rules by a blocked Bloom filter and an exact hash join.

Every page gives the canonical prefixes of its url: each suffix of its host with each beginning of
its path that has the length of some rule's path. A blocked Bloom filter of the listed (host, path)
lets possible hits through; an equality join with the rules removes its false positives.

A null url, or one without ``://``, has an empty host and path, fits no rule and gets the default
verdict. Of equal rules with both verdicts block wins. Each input row gives one row. Extra columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the filter for each rule, and its largest size: 2**17 blocks of 64 bytes are 8 MB. A longer
#: list fills the filter more, which costs more candidates in the join and no correctness.
BITS_PER_KEY, MAX_BLOCKS = 16, 1 << 17
WORDS = 8  # 64-bit words of a block: one bit in each is set for a key

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def bloom(keys: DataFrame) -> np.ndarray:
    """The filter of (host, path): blocks of eight words. Bits are set and joined on the executors; the driver gets one row a block."""
    n = max(1, min(MAX_BLOCKS, -(-keys.count() * BITS_PER_KEY // 512)))
    bits = F.xxhash64("path", "host")
    block = F.pmod(F.xxhash64("host", "path"), F.lit(n)).alias("block")
    one = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int"))).alias(f"w{i}") for i in range(WORDS)]
    filled = keys.groupBy(block).agg(*one).toPandas()
    out = np.zeros((n, WORDS), np.int64)
    out[filled["block"]] = filled[[f"w{i}" for i in range(WORDS)]].to_numpy()
    return out.view(np.uint64)


def may_hold(spark: SparkSession, keys: DataFrame):
    """A column function of an array of (host, path): the numbers of those that may be listed; all that are listed are among them."""
    sent = spark.sparkContext.broadcast(bloom(keys))

    @F.pandas_udf("array<int>")
    def probe(places: pd.Series, bits: pd.Series) -> pd.Series:
        """The numbers of the keys of each row that may be listed."""
        table, sizes = sent.value, places.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series([[]] * len(places))
        place, b = (np.concatenate(x.to_list()).astype(np.int64) for x in (places, bits))
        b = b.view(np.uint64)
        rows = table[np.mod(place, len(table))]
        at = np.stack([(b >> np.uint64(6 * i)) & np.uint64(63) for i in range(WORDS)], 1)
        may = ((rows >> at) & np.uint64(1)).all(1)
        ends = np.cumsum(sizes)
        number = np.arange(len(may)) - np.repeat(ends - sizes, sizes)
        return pd.Series([number[a:e][may[a:e]].astype(np.int32) for a, e in zip(ends - sizes, ends)])

    probe = probe.asNondeterministic()  # so that it is evaluated once, where it stands
    hashes = lambda keys, one, two: F.transform(keys, lambda k: F.xxhash64(k[one], k[two]))
    return lambda keys: probe(hashes(keys, "host", "path"), hashes(keys, "path", "host"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages; rules are (host, path, verdict)."""
    spark = pages.sparkSession
    listed = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    lengths = sorted(r[0] for r in listed.select(F.length("path")).distinct().collect())  # as many as paths have lengths
    labels = listed.agg(F.max(F.size(F.split("host", "\\.")))).first()[0] or 0
    held = may_hold(spark, listed)
    url = F.col("url")
    # a host's suffixes of as many labels as listed hosts have at most: a long host makes no more of them
    suffix = lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i)
    hosts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(labels)), suffix)) if labels else F.array().cast("array<string>")
    starts = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda p: F.struct(h.alias("host"), p.alias("path")))))
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.monotonically_increasing_id().alias("row")).withColumn("keys", keys)
    tried = rows.select("row", "page_id", "host", "path", "keys", held(F.col("keys")).alias("hits"))
    # only possible hits are shuffled; the other rows are judged where they are read
    fits = listed.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict")
    hits = tried.where(F.size("hits") > 0).select("row", "page_id", "host", "path", F.explode(F.transform("hits", lambda i: F.element_at("keys", i + 1))).alias("k"))
    joined = hits.select("row", "page_id", "host", "path", F.col("k.host").alias("h"), F.col("k.path").alias("p")).join(fits, ["h", "p"], "left")
    best = F.max(F.when(F.col("verdict").isNotNull(), F.struct((F.length("h") + F.length("p")).alias("n"), F.length("h").alias("m"), F.concat("h", "p").alias("rule"), "verdict")))
    found = joined.groupBy("row", "page_id", "host", "path").agg(best.alias("best")).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    rest = tried.where(F.size("hits") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return found.union(rest)
