"""Tokens without a dictionary and their offsets, for texts without Thai: NumPy over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from segspark import charsets as C
from segspark.functions.clusters import ends_of

PIECES = "array<struct<token:string,end:int>>"
#: So many bytes of text, besides those of one text, are looked at in one go. Decides on memory only.
HELD_BYTES = 4_000_000

_OTHER, _LETTER, _DIGIT, _BLANK, _LINE = range(5)
_CLASS = np.zeros(256, np.uint8)
for _kind, _chars in ((_LETTER, b"-abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_DIGIT, b"0123456789"), (_BLANK, b" \t"), (_LINE, b"\n")):
    _CLASS[list(_chars)] = _kind


def _cut(data: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """Pieces of the texts that lie in ``data`` between ``offsets``, the first of which is 0: tokens are runs of a class."""
    size = len(data)
    kind = _CLASS[data]
    first = np.zeros(size + 1, bool)  # a text starts here
    first[offsets] = True
    later = ~first[:-1]  # has a byte before it in its text
    before, line = np.zeros(size, bool), data == 10
    # a point between digits belongs to them, a carriage return to the line feed after it
    points = np.flatnonzero((data == 44) | (data == 46))
    points = points[(points > 0) & (points < size - 1)]
    kind[points[(kind[points - 1] == _DIGIT) & (kind[points + 1] == _DIGIT) & later[points] & later[points + 1]]] = _DIGIT
    returns = np.flatnonzero(data[:-1] == 13)
    returns = returns[line[returns + 1] & later[returns + 1]]
    kind[returns] = _LINE
    before[returns + 1] = True
    start = ~later | (kind == _LINE) & ~before
    start[1:] |= kind[1:] != kind[:-1]
    at = np.append(np.flatnonzero(start), size).astype(np.int32)
    lists = np.searchsorted(at, offsets).astype(np.int32)
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int32))
    ends = chars[at[1:]] - np.repeat(chars[offsets[:-1]], np.diff(lists))
    tokens = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))
    return pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([tokens, pa.array(ends, pa.int32())], ["token", "end"]))


def pieces_of(texts: pa.Array, held: int = HELD_BYTES) -> pa.Array:
    """Tokens and their ends in code points, of texts without Thai."""
    texts = texts.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    parts, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + held, "right")) - 1)
        parts.append(_cut(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        i = j
    return pa.concat_arrays(parts) if parts else _cut(data[:0], offsets[:1])


@F.arrow_udf(ArrayType(StructType([StructField("token", StringType()), StructField("end", IntegerType())])))
def _pieces(texts: pa.Array) -> pa.Array:
    return pieces_of(texts)


def plain_offsets(df: DataFrame, id_col: str, text_col: str, tokens: Column) -> DataFrame:
    """Rows (id, pos, token, start, end) of texts without a dictionary; ``tokens`` are taken of texts with Thai."""
    c = F.col(text_col)
    plain = (F.length(c) > 0) & F.is_valid_utf8(c) & ~F.rlike(c, F.lit(f"[{C.THAI}]"))
    found = df.select(F.col(id_col).alias("id"), F.when(plain, c).alias("plain"), F.when(plain, F.array().cast("array<string>")).otherwise(tokens).alias("tokens"))
    zipped = F.arrays_zip("tokens", ends_of(F.col("tokens")).alias("ends")).cast(PIECES)
    rows = found.select("id", F.posexplode(F.when(F.col("plain").isNotNull(), _pieces("plain")).otherwise(zipped)).alias("pos", "t"))
    return rows.select(F.col("id").alias(id_col), "pos", "t.token", (F.col("t.end") - F.length("t.token")).alias("start"), "t.end")
