"""Usual questions on tokens, as plain DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, group: str, tokens: Column) -> DataFrame:
    """Tokens and characters by group: the arrays are counted in place, so nothing is exploded before the shuffle."""
    t = df.select(group, tokens.alias("t"))
    return t.select(group, F.size("t").cast("long").alias("n")).groupBy(group).agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_texts"))


def _words(df: DataFrame, keep: list[str], tokens: Column) -> DataFrame:
    rows = df.select(*keep, F.explode(tokens).alias("token"))
    return rows.where(F.col("token").rlike("^[-a-zA-Z]+$"))


def top_tokens(df: DataFrame, tokens: Column, k: int) -> DataFrame:
    """The k most frequent words; ties to the smaller word."""
    return _words(df, [], tokens).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(k)


def vocabulary(df: DataFrame, group: str, tokens: Column) -> DataFrame:
    """Different words by group: distinct pairs first, so a hot group is spread over all tasks."""
    return _words(df, [group], tokens).distinct().groupBy(group).agg(F.count("*").alias("n_words"))


def unknown_rate(df: DataFrame, group: str, tokens: Column, words: DataFrame) -> DataFrame:
    """Words by group, and how many of them the dictionary lacks. Counted before the join."""
    counts = _words(df, [group], tokens).groupBy(group, "token").agg(F.count("*").alias("n"))
    known = words.select(F.col("word").alias("token"), F.lit(1).alias("known"))
    return counts.join(known, "token", "left").groupBy(group).agg(F.sum("n").alias("n_words"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("n_unknown"))
