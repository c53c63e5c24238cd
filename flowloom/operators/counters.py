"""Counters, rates, bounded histories and sweeps: grouped and windowed aggregates over outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

IDLE_MS = 900_000


def cycle_counters(outcomes: DataFrame) -> DataFrame:
    """Counters of each queue over (queue, event) rows; one aggregation for all."""
    names = ("enqueued", "reserved", "acked", "nacked", "deduplicated", "promotions", "lease_redeliveries", "dedup_expirations")
    return outcomes.groupBy("queue").agg(*[F.count_if(F.col("event") == n).alias(n) for n in names])


def dead_lettered(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("event = 'dead_lettered'").groupBy("queue", "cause").agg(F.count(F.lit(1)).alias("dead_lettered"))


def admin_totals(outcomes: DataFrame, last_purge: DataFrame | None = None) -> DataFrame:
    """Running totals by queue; those up to the purge that emptied a queue are forgotten."""
    if last_purge is not None:
        cut = last_purge.select(F.col("queue").alias("__q"), "purged_at")
        outcomes = outcomes.join(cut, F.col("queue") == F.col("__q"), "left").where(F.col("purged_at").isNull() | (F.col("at") > F.col("purged_at"))).drop("__q")
    names = ("enqueued", "reserved", "acked", "nacked", "dead_lettered")
    return outcomes.groupBy("queue").agg(*[F.count_if(F.col("event") == n).alias(n) for n in names])


def idle_eviction(outcomes: DataFrame, depths: DataFrame, now: int, idle_ms: int = IDLE_MS) -> DataFrame:
    """Queues whose totals stay: active within the bound, or with any job left."""
    last = outcomes.groupBy("queue").agg(F.max("at").alias("last_at"))
    total = depths.select(F.col("queue").alias("__q"), (F.col("live") + F.col("dead_letter")).alias("jobs"))
    known = last.join(total, F.col("queue") == F.col("__q"), "left").withColumn("jobs", F.coalesce("jobs", F.lit(0))).drop("__q")
    return known.where((now - F.col("last_at") < idle_ms) | (F.col("jobs") > 0))


def samples(outcomes: DataFrame, tick_ms: int) -> DataFrame:
    """Cumulative counters of each queue at every tick in which it had events."""
    names = ("enqueued", "acked", "nacked", "dead_lettered")
    tick = (F.floor(F.col("at") / tick_ms) * tick_ms).cast("bigint")
    steps = outcomes.groupBy("queue", tick.alias("ts_ms")).agg(*[F.count_if(F.col("event") == n).alias(n) for n in names])
    upto = Window.partitionBy("queue").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("queue", "ts_ms", *[F.sum(n).over(upto).alias(n) for n in names])


def rates(sampled: DataFrame) -> DataFrame:
    """Increase a second since the sample before: 0 at first, never negative, to two places."""
    names = ("enqueued", "acked", "nacked", "dead_lettered")
    w = Window.partitionBy("queue").orderBy("ts_ms")
    dt = F.greatest((F.col("ts_ms") - F.lag("ts_ms").over(w)) / 1000.0, F.lit(0.001))
    rate = lambda n: F.coalesce(F.round(F.greatest(F.col(n) - F.lag(n).over(w), F.lit(0)) / dt, 2), F.lit(0.0))
    return sampled.select("queue", "ts_ms", *[rate(n).alias(f"{n}_rate") for n in names])


def history_ring(rated: DataFrame, keep: int) -> DataFrame:
    """The newest samples of each queue."""
    place = F.row_number().over(Window.partitionBy("queue").orderBy(F.col("ts_ms").desc()))
    return rated.withColumn("__n", place).where(F.col("__n") <= max(keep, 1)).drop("__n")


def trailing(rated: DataFrame, span_ms: int) -> DataFrame:
    """Samples of the span that ends at the newest one of all."""
    end = rated.agg(F.max("ts_ms").alias("__end"))
    return rated.join(F.broadcast(end), F.col("ts_ms") >= F.col("__end") - span_ms).drop("__end")


def monotonic_frames(frames: DataFrame) -> DataFrame:
    """Frames in arrival order that are newer than all before them."""
    before = Window.partitionBy("queue").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("__top", F.max("ts_ms").over(before)).where(F.col("__top").isNull() | (F.col("ts_ms") > F.col("__top"))).drop("__top")


def sessions(events: DataFrame, gap: str = "15 minutes") -> DataFrame:
    """Spans of activity by user and kind, ended by a gap."""
    win = F.session_window("at", gap)
    return events.groupBy("user_id", "event_type", win).agg(F.count(F.lit(1)).alias("events"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms")).drop("session_window")


def due(index: DataFrame, deadline: str, now: int, budget: int, *ties: str) -> DataFrame:
    """What one phase of a sweep takes: due rows by deadline and ties, up to the budget."""
    return index.where(F.col(deadline) <= now).orderBy(deadline, *ties).limit(budget)


def next_deadline(*indexes: tuple[DataFrame, str]) -> DataFrame:
    """The earliest deadline of all timers; each index gives one row to the last minimum."""
    parts = [df.agg(F.min(c).alias("deadline_ms")) for df, c in indexes]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.agg(F.min("deadline_ms").alias("deadline_ms"))


def purge_chunk(snapshot: DataFrame, dedup: DataFrame, queue: str, most: int) -> DataFrame:
    """What one chunk of a purge removes, by table; nothing while any job of the queue is in flight.

    Dedup records (queue, idempotency_key, deadline_ms) go by their timers, oldest deadline first.
    """
    own = snapshot.where(F.col("queue") == queue)
    key = F.when(F.col("state") == "ready", F.struct((9 - F.least("priority", F.lit(9))).cast("bigint").alias("a"), F.col("enq").alias("b"), "job_id"))
    key = key.when(F.col("state") == "scheduled", F.struct(F.coalesce("sched", "enq").alias("a"), F.lit(0).cast("bigint").alias("b"), "job_id"))
    key = key.otherwise(F.struct(F.col("failed_at").alias("a"), F.lit(0).cast("bigint").alias("b"), "job_id"))
    phase = F.array_position(F.array(F.lit("ready"), F.lit("scheduled"), F.lit("dead_letter")), F.col("state"))
    rows = own.where("state <> 'inflight'").select(phase.cast("int").alias("phase"), key.alias("key"))
    keyed = dedup.where(F.col("queue") == queue).select(F.lit(4).alias("phase"), F.struct(F.col("deadline_ms").alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("idempotency_key").alias("job_id")).alias("key"))
    taken = rows.unionByName(keyed).orderBy("phase", "key").limit(most)
    busy = own.agg((F.count_if(F.col("state") == "inflight") > 0).alias("busy"))
    return taken.join(F.broadcast(busy), ~F.col("busy")).groupBy("phase").agg(F.count(F.lit(1)).alias("purged"))


def attempts(events: DataFrame) -> DataFrame:
    """events (event_id, at, event) with the attempt that each belongs to."""
    before = Window.partitionBy("event_id").orderBy("at", "event").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum((F.col("event") != "reserved").cast("int")).over(before), F.lit(0))
    return events.withColumn("attempt", (1 + ended).cast("bigint"))


#: Upper bounds of the buckets of request times, in milliseconds.
BUCKETS_MS = (5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)


def request_histogram(requests: DataFrame) -> DataFrame:
    """Requests (method, ok, ms) by method, outcome and the number of bounds that their time exceeds."""
    bucket = F.size(F.filter(F.array(*map(F.lit, BUCKETS_MS)), lambda b: b < F.col("ms"))).cast("bigint")
    outcome = F.when(F.col("ok"), "ok").otherwise("error")
    return requests.groupBy("method", outcome.alias("outcome"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("requests"))


def purge_status(snapshot: DataFrame, most: int) -> DataFrame:
    """Of each queue: whether it may be purged, what one chunk takes of its jobs, and whether any remain."""
    n, busy = F.count(F.lit(1)), F.count_if(F.col("state") == "inflight") > 0
    return snapshot.groupBy("queue").agg(
        F.when(busy, "failed_precondition").otherwise("purged").alias("status"),
        F.when(busy, F.lit(0)).otherwise(F.least(n, F.lit(most))).cast("bigint").alias("purged"),
        (~busy & (n > most)).alias("remaining"),
    )
