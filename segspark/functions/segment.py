"""Segmentation as a Column: a JVM expression without a dictionary, an Arrow-batched UDF with one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark import charsets as C
from segspark.functions.clusters import cluster_ends, clusters, ends_of
from segspark.functions.normalize import normalize
from segspark.operators.dictionary import registry, words_of
from segspark.operators.lattice import segment_text

EMPTY = "array<string>"
#: So many characters of text, besides one text, are Python strings or tokens in Arrow's memory at a time. Decides on memory only.
HELD_CHARS = 250_000


def segment_plain(col: Column | str) -> Column:
    """Tokens without any dictionary: one JVM regular expression. NULL and empty text give an empty array."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.regexp_extract_all(c, F.lit(C.NO_DICTIONARY), F.lit(0)), F.array().cast(EMPTY))


def _udf(sent, safe: bool, compat: str = "corrected"):
    """The core over whole Arrow batches."""

    @F.arrow_udf(EMPTY)
    def tokens(texts: pa.Array) -> pa.Array:
        return _batch(texts, words_of(sent), safe, compat)

    return tokens


def _udf_in_parts(sent, safe: bool, compat: str = "corrected"):
    """The core over Arrow batches. Tokens leave in parts of a batch, so those of a whole batch are never held."""

    @F.arrow_udf(EMPTY)
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from _parts(texts, words_of(sent), safe, compat)

    return tokens


def _parts(texts: pa.Array, words, safe: bool, compat: str = "corrected", held: int = HELD_CHARS):
    """The tokens of all texts of a batch, in arrays for some texts each."""
    flat, ends, chars = [], [0], 0
    for t in texts:
        text = t.as_py()
        flat += segment_text(text, words, safe, compat)
        ends.append(len(flat))
        chars += len(text or "")
        if chars >= held:
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))
            flat, ends, chars = [], [0], 0
    if len(ends) > 1:
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))


def _batch(texts: pa.Array, words, safe: bool, compat: str = "corrected", held: int = HELD_CHARS) -> pa.ListArray:
    """The tokens of all texts of a batch in one array."""
    parts = list(_parts(texts, words, safe, compat, held))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


def segment(col: Column | str, dict_name: str, safe: bool = False, parallel: bool = False, compat: str = "corrected", spark: SparkSession | None = None) -> Column:
    """Tokens of a text as an array; NULL and empty text give an empty array.

    An unknown dictionary raises here, on the driver. ``parallel`` is accepted and changes nothing:
    rows already run in parallel.
    """
    spark = spark or SparkSession.getActiveSession()
    sent = registry(spark).broadcast(dict_name)

    tokens = _udf_in_parts(sent, safe, compat)
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(tokens(c), F.array().cast(EMPTY))


def token_rows(df, id_col: str, tokens: Column):
    """Rows (id, pos, token). Filters on tokens come after the explode, so the UDF runs once."""
    return df.select(F.col(id_col), F.posexplode(tokens).alias("pos", "token"))


def token_offsets(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """Rows (id, pos, token, start, end) in code points: offsets are made within a text, so nothing is shuffled."""
    found = df.select(F.col(id_col), tokens.alias("tokens")).select(id_col, "tokens", ends_of(F.col("tokens")).alias("ends"))
    rows = found.select(id_col, F.posexplode(F.arrays_zip("tokens", "ends")).alias("pos", "t"))
    return rows.select(id_col, "pos", F.col("t.tokens").alias("token"), (F.col("t.ends") - F.length("t.tokens")).alias("start"), F.col("t.ends").alias("end"))


def register_functions(spark: SparkSession, dict_name: str) -> None:
    """SQL functions thai_segment(text), thai_segment_safe(text) and the table function thai_tokens(text)."""
    sent = registry(spark).broadcast(dict_name)

    spark.udf.register("thai_segment", _udf_in_parts(sent, False))
    spark.udf.register("thai_segment_safe", _udf_in_parts(sent, True))

    @F.udtf(returnType="pos int, token string, start int, end int", useArrow=True)
    class ThaiTokens:
        def eval(self, text: str):
            at = 0
            for i, t in enumerate(segment_text(text, words_of(sent))):
                yield i, t, at, at + len(t)
                at += len(t)

    spark.udtf.register("thai_tokens", ThaiTokens)


__all__ = ["cluster_ends", "clusters", "normalize", "register_functions", "segment", "segment_plain", "token_offsets", "token_rows"]
