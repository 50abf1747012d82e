"""Moments of a stream in event-time windows: an addition of this engine, built on mergeable aggregates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(df: DataFrame, time: str, value: str, *keys: str, window: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """count, mean, population variance, least and greatest value of each window and key.  On a stream, rows later than
    `delay` are dropped and state for closed windows goes; on a table the watermark has no effect."""
    marked = df.withWatermark(time, delay) if df.isStreaming else df
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return marked.groupBy(w.alias("w"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"), F.min(value).alias("least"), F.max(value).alias("most")).select(F.col("w.start").alias("start"), *keys, "n", "mean", "var", "least", "most")
