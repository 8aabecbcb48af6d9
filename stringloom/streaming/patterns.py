"""Pattern counts over a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.operators import search


def stream_counts(texts: DataFrame, patterns: list[str], id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """(id, pattern, cnt) for each arriving text; stateless, so any output mode and restart work."""
    return search.count_scan(texts, patterns, id_col, text_col)


def windowed_counts(texts: DataFrame, patterns: list[str], time_col: str, width: str, late: str, text_col: str = "text") -> DataFrame:
    """(window, pattern, cnt): occurrences by tumbling window of the event time, closed once the watermark has passed it."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), search.overlap_count(text_col, F.lit(p)).alias("cnt")) for p in patterns])).alias("hit")
    hits = texts.withWatermark(time_col, late).select(time_col, each)
    return hits.groupBy(F.window(time_col, width).alias("window"), F.col("hit.pattern").alias("pattern")).agg(F.sum("hit.cnt").alias("cnt"))
