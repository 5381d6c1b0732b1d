"""Segmentation of streams: a stateless map, so the column functions run on a stream unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.functions.normalize import normalize
from segspark.functions.segment import segment, segment_plain


def token_stream(stream: DataFrame, id_col: str, text_col: str, dict_name: str | None = None, safe: bool = False) -> DataFrame:
    """Rows (id, pos, token) of normalized texts. The dictionary is fixed when the query starts."""
    text = normalize(text_col)
    tokens = segment(text, dict_name, safe=safe, spark=stream.sparkSession) if dict_name else segment_plain(text)
    return stream.select(F.col(id_col), F.posexplode(tokens).alias("pos", "token"))


def token_counts(stream: DataFrame, ts_col: str, text_col: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Tokens in event-time windows; rows later than ``late`` are dropped and their state is freed."""
    return stream.withWatermark(ts_col, late).select(ts_col, F.explode(segment_plain(text_col)).alias("token")).groupBy(F.window(ts_col, window), "token").count()
