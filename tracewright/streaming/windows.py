"""Streaming forms of the usage counts. The reference work has no streams; these are extensions with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def minute_counts(events: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """(minute, cnt) by event time; rows later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("cnt")).select(F.col("w.start").alias("minute"), "cnt")


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, cnt) of bursts of activity that pauses of ``gap`` separate."""
    per = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("cnt"))
    return per.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "cnt")


def without_repeats(events: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def serve(requests: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch of requests to ``handle``; a batch counts as done when it returns, so it may come again and must be idempotent."""
    return requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
