"""Sources of dictionary words: a file with a word on each line, or a list."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark import charsets as C

SCHEMA = "word string"


def trim_word(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{C.TRIMMED}]+|[{C.TRIMMED}]+$", "")


def resolve(path: str) -> str:
    """Local paths become absolute; URIs stay as they are."""
    return path if ":/" in str(path) else str(Path(path).resolve())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines split at newlines only, one trailing carriage return off, lines that aren't UTF-8 dropped.

    The text reader splits a file over tasks and hands the bytes of a line on unchanged, so is_valid_utf8 tells bad lines.
    """
    where = resolve(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(where)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(where)
    if fs.getFileStatus(at).isDirectory():
        raise IsADirectoryError(where)
    lines = spark.read.option("lineSep", "\n").text(where if ":/" in where else f"file://{where}")
    return lines.where(F.is_valid_utf8("value")).select(F.regexp_replace("value", "\r\\z", "").alias("raw"))


def stored(raw: DataFrame, compat: str = "corrected") -> DataFrame:
    """The words that a dictionary holds: trimmed, not empty, distinct.

    ``reference``: a word with leading white space is looked up by as many of its untrimmed characters.
    """
    trimmed = trim_word(F.col("raw"))
    word = trimmed if compat == "corrected" else F.substring(F.col("raw"), F.lit(1), F.length(trimmed))
    return raw.where(F.length(trimmed) > 0).select(word.alias("word")).distinct()


def from_words(spark: SparkSession, words: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "raw string")
