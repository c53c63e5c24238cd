"""Sinks of the stats stream: one JSON frame for each tick, and files of them in order of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def stats_frames(rated: DataFrame) -> DataFrame:
    """(ts_ms, frame): all queues that have a sample at a tick, by name; a frame holds one small row a queue."""
    row = F.struct("queue", *[c for c in rated.columns if c.endswith("_rate")])
    frames = rated.groupBy("ts_ms").agg(F.array_sort(F.collect_list(row)).alias("queues"))
    return frames.select("ts_ms", F.to_json(F.struct("ts_ms", "queues")).alias("frame"))


def events_for(role: str, events: DataFrame) -> DataFrame:
    """What a subscriber of a role sees: audit events are for administrators only."""
    return events if role == "admin" else events.where("event <> 'audit'")


def write_frames(frames: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's frames; a repeated batch overwrites its own folder, so none is there twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.orderBy("ts_ms").write.mode("overwrite").json(f"{path}/batch={number}")

    return frames.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
