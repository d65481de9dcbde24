"""The row-wise operators over a stream: they keep no state, so they run on it as on a table.

Counts over event time close with a watermark; everything that needs the whole collection (ids of a
vocabulary, merges, frequencies without a window) stays with tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qatlam.functions import text as T


def clean_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    """A stream with ``cleaned`` and ``script`` of its text."""
    return stream.withColumn("cleaned", T.clean_text(text)).withColumn("script", T.detect_script(text))


def token_stream(stream: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The raw tokens of a stream's texts with the columns to ``keep``."""
    cut = stream.where(F.col(text).isNotNull()).select(*keep, F.posexplode(T.raw_tokens(T.normalize_apostrophes(text))).alias("pos", "token"))
    return cut.withColumn("token_type", T.token_type("token"))


def windowed_token_counts(stream: DataFrame, time: str, width: str = "1 hour", late: str = "1 hour", text: str = "text") -> DataFrame:
    """Tokens by type in windows of event time; rows later than ``late`` are dropped by the watermark."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))  # a watermark takes no timestamp without zone
    tokens = token_stream(timed.withWatermark(time, late), time, text=text)
    return tokens.groupBy(F.window(time, width), "token_type").agg(F.count(F.lit(1)).alias("n"))
