"""The same sessions over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(rows: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n) of sessions; rows later than `late` behind the newest are dropped, which bounds the state."""
    w = F.session_window(ts, gap)
    return rows.withWatermark(ts, late).groupBy(key, w).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")).drop("session_window")
