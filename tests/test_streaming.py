"""Windowed counters on a stream equal the same windows in batch."""

import pytest
from pyspark.sql import functions as F

from flowloom.streaming import windows as wn


@pytest.mark.parametrize("kind", ["ticks", "sliding", "sessions"])
def test_stream_equals_batch(spark, sf_dir, tmp_path, kind):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("at"), "event_type", "user_id")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    plan = {
        "ticks": lambda df: wn.ticks(df, "at", "event_type", "1 hour"),
        "sliding": lambda df: wn.sliding(df, "at", "event_type", "6 hours", "1 hour"),
        "sessions": lambda df: wn.sessions(df, "at", ["user_id", "event_type"]),
    }[kind]
    stream = plan(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName(f"out_{kind}").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = sorted(map(str, spark.table(f"out_{kind}").collect()))
    finally:
        q.stop()
    assert got == sorted(map(str, plan(events).collect()))
