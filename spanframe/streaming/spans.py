"""The same expressions over streams: span extraction a row, and latency percentiles by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.functions.spans import each_span, pattern_spans


def stream_spans(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, start, end, label) of a stream of texts: stateless, so any output mode and any restart will do."""
    found = each_span(texts.select(F.col(id_col).alias("id"), pattern_spans(F.col(text_col)).alias("spans")), "spans")
    return found.select("id", "s.start", "s.end", "s.label")


def windowed_latency(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """p50, p95 and count of a value by tumbling window; state ends with the watermark."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    stats = timed.groupBy(F.window(time, width).alias("w"), by).agg(F.percentile_approx(value, [0.5, 0.95], 10_000).alias("p"), F.count("*").alias("n"))
    return stats.select(F.col("w.start").alias("window_start"), by, F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), "n")
