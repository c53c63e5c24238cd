"""Windowed counters over a stream of events: ticks, sliding rates and activity sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ticks(events: DataFrame, ts: str, key: str, width: str = "1 second", late: str = "1 minute") -> DataFrame:
    """Events by key and tumbling tick; a tick is final once the watermark has passed it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("events"))


def sliding(events: DataFrame, ts: str, key: str, span: str, slide: str, late: str = "1 minute") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, span, slide), key).agg(F.count(F.lit(1)).alias("events"))


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str = "15 minutes", late: str = "1 minute") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("events"))
