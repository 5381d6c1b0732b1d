"""Named dictionaries as DataFrames of words, and the operations on them."""

from __future__ import annotations

import re
from collections.abc import Iterable
from weakref import WeakKeyDictionary

from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.operators.lattice import Words
from segspark.sources.wordlist import from_words, read_lines, resolve, stored, trim_word

#: A dictionary is sent to every executor; beyond this many characters it is refused. A parameter of broadcast_words.
MAX_BROADCAST_CHARS = 64_000_000


def add(words: DataFrame, more: DataFrame) -> DataFrame:
    """Words and trimmed new words; empty ones are ignored."""
    return words.select("word").union(more.select(trim_word(F.col("word")).alias("word")).where("length(word) > 0")).distinct()


def remove(words: DataFrame, gone: DataFrame) -> DataFrame:
    return words.join(gone.select(trim_word(F.col("word")).alias("word")), "word", "left_anti")


def contains(words: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked words with a flag; exact, without trimming."""
    held = words.select("word").distinct().withColumn("held", F.lit(True))
    return asked.join(held, "word", "left").select(*asked.columns, F.coalesce("held", F.lit(False)).alias("found"))


def size(words: DataFrame) -> DataFrame:
    return words.agg(F.count_distinct("word").alias("size"))


def prefixes(texts: DataFrame, words: DataFrame, id_col: str = "text_id", text_col: str = "text", max_length: int | None = None) -> DataFrame:
    """All words that a text starts with, as (id, word, end): substrings and an equality join, no pair is compared."""
    longest = max_length or words.agg(F.max(F.length("word"))).first()[0] or 0
    ends = F.sequence(F.lit(1), F.least(F.lit(longest), F.length(text_col)))
    starts = texts.where((F.length(text_col) > 0) & F.lit(longest > 0)).select(id_col, F.explode(F.transform(ends, lambda n: F.substring(F.col(text_col), F.lit(1), n))).alias("word"))
    return starts.join(words.select("word").distinct(), "word").select(id_col, "word", F.length("word").alias("end"))


class Registry:
    """Dictionaries of a session by name. A name is never overwritten."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.frames: dict[str, DataFrame] = {}
        self._sent: dict[str, Broadcast] = {}

    def create(self, name: str, words: DataFrame) -> bool:
        if name in self.frames:
            return False
        self.frames[name] = words
        words.select(F.lit(name).alias("dict_name"), "word").createOrReplaceTempView(f"dictionary_{name}" if re.fullmatch(r"[A-Za-z0-9_]+", name) else f"`dictionary_{name.replace('`', '')}`")
        return True

    def words(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise RuntimeError(f"Dictionary name {name} does not exist.")
        return self.frames[name]

    def broadcast(self, name: str) -> Broadcast:
        if name not in self._sent:
            self._sent[name] = broadcast_words(self.words(name))
        return self._sent[name]


def broadcast_words(words: DataFrame, limit: int = MAX_BROADCAST_CHARS) -> Broadcast:
    """Sends a checked number of characters to the executors."""
    chars = words.agg(F.sum(F.length("word"))).first()[0] or 0
    if chars > limit:
        raise ValueError(f"The dictionary has {chars} characters; at most {limit} are sent to executors.")
    return words.sparkSession.sparkContext.broadcast(sorted(r.word for r in words.select("word").toLocalIterator()))


_registries: WeakKeyDictionary = WeakKeyDictionary()


def registry(spark: SparkSession) -> Registry:
    return _registries.setdefault(spark, Registry(spark))


def load_dict(spark: SparkSession, file_path: str, dict_name: str, compat: str = "corrected") -> tuple[str, bool]:
    """Loads a file of words under a name that isn't taken. A missing file or a folder raises and changes nothing."""
    if dict_name in registry(spark).frames:
        return f"Failed: dictionary name {dict_name} already exists, please use another name.", False
    path = resolve(file_path)
    registry(spark).create(dict_name, stored(read_lines(spark, path), compat))
    return f"Successful: file {path} has been successfully loaded to dictionary name {dict_name}.", True


def load_words(spark: SparkSession, words: Iterable[str], dict_name: str, compat: str = "corrected") -> bool:
    return registry(spark).create(dict_name, stored(from_words(spark, words), compat))


def words_of(sent: Broadcast) -> Words:
    """The look-up structure of a broadcast, built once for each Python worker."""
    if sent.value is not _built.get("of"):
        _built.update(of=sent.value, words=Words(sent.value))
    return _built["words"]


_built: dict = {}
