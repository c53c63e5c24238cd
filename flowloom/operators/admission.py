"""Deduplication, admission and routing of single operations, where no general state machine is needed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def _windows(window_ms: int):
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, deadline = None, 0, 0
        for pdf in frames:
            firsts, deadlines, repeats = [], [], []
            for queue, idem, event, at in zip(pdf["queue"], pdf["idem"], pdf["event_id"].tolist(), pdf["enq"].tolist()):
                repeat = (queue, idem) == key and at < deadline
                if not repeat:
                    key, first, deadline = (queue, idem), event, at + window_ms
                firsts.append(first)
                deadlines.append(deadline)
                repeats.append(repeat)
            yield pdf.drop(columns="enq").assign(first_id=firsts, deadline=deadlines, deduplicated=repeats)

    return fold


def dedup_fold(jobs: DataFrame, window_ms: int) -> DataFrame:
    """Each keyed enqueue with the id it gets and whether it is a repeat.

    The window is fixed from the first accepted enqueue and does not slide; at
    its deadline a key is new again. Rows are sorted by key and event order and
    read as a stream that remembers one window, so a key of any number of rows
    takes no memory, and work in proportion.
    """
    keyed = jobs.where("idem is not null").select("queue", "idem", "event_id", "enq")
    ordered = keyed.repartition("queue", "idem").sortWithinPartitions("queue", "idem", "enq", "event_id")
    return ordered.mapInPandas(_windows(window_ms), "queue string, idem string, event_id bigint, first_id bigint, deadline bigint, deduplicated boolean")


def admit(jobs: DataFrame, caps: DataFrame, window_ms: int) -> DataFrame:
    """Best-effort admission without dequeues: an accepted job's repeats pass with its id, others up to the queue's cap.

    Without dequeues a queue that is full stays full: the last job it takes is the
    cap-th of its firsts, and a repeat of a first behind that one, which was refused
    and left no record, is refused as well. ``caps`` has a row for each declared queue.
    """
    fold = dedup_fold(jobs, window_ms).select("event_id", "first_id", (F.col("deadline") - window_ms).alias("first_enq"), "deduplicated")
    every = jobs.join(fold, "event_id", "left").withColumns(
        {"deduplicated": F.coalesce("deduplicated", F.lit(False)), "first": F.struct(F.coalesce("first_enq", "enq").alias("enq"), F.coalesce("first_id", "event_id").alias("event_id"))}
    )
    limits = caps.select(F.col("queue").alias("__q"), "max_queue_depth")
    most = limits.agg(F.max("max_queue_depth")).first()[0] or 0
    # Only the first rows up to the greatest cap are ever ranked together.
    place = F.row_number().over(Window.partitionBy("queue").orderBy("enq", "event_id"))
    ranked = every.where(~F.col("deduplicated")).select("queue", "enq", "event_id").withColumn("place", place).where(F.col("place") <= most)
    last = ranked.join(limits, F.col("queue") == F.col("__q")).where(F.col("place") == F.col("max_queue_depth")).select("__q", F.struct("enq", "event_id").alias("last"))
    placed = every.join(limits.join(last, "__q", "left"), F.col("queue") == F.col("__q"), "left").drop("__q", "first_enq", "first_id")
    cap = F.col("max_queue_depth")
    taken = cap.isNull() | ((cap > 0) & F.coalesce(F.col("first") <= F.col("last"), F.lit(True)))
    return placed.withColumn("status", F.when(~taken, "queue_full").when(F.col("deduplicated"), "deduplicated").otherwise("accepted"))


def atomic_admission(jobs: DataFrame, batch: str, live: DataFrame, caps: DataFrame) -> DataFrame:
    """All-or-nothing batches: demand per queue, repeats counted as new, against live depth and cap."""
    demand = jobs.groupBy(batch, "queue").agg(F.count(F.lit(1)).alias("demand"))
    known = demand.join(live.select("queue", "live"), "queue", "left").join(caps.select("queue", "max_queue_depth"), "queue", "left")
    full = F.col("max_queue_depth").isNotNull() & (F.coalesce("live", F.lit(0)) + F.col("demand") > F.col("max_queue_depth"))
    marked = known.withColumn("full", F.coalesce(full, F.lit(False)))
    by_batch = marked.groupBy(batch).agg(
        F.sum("demand").alias("jobs"), F.sum(F.when(F.col("full"), F.col("demand")).otherwise(F.lit(0))).alias("rejected"), F.bool_or("full").alias("any_full")
    )
    return by_batch.select(batch, "jobs", "rejected", (~F.col("any_full")).alias("committed"))


def fenced(attempt: Column, held: Column) -> Column:
    """Outcome of an operation that names a lease: a lapsed lease still counts until a sweep has run."""
    return F.when(held.isNull(), "not_found").when(attempt != held, "failed_precondition").otherwise("ok")


def lease_outcomes(asked: DataFrame, inflight: DataFrame) -> DataFrame:
    """asked (job_id, asked_attempt) with the outcome of an ack."""
    held = inflight.select("job_id", F.col("attempt").alias("held"), "queue")
    return asked.join(held, "job_id", "left").withColumn("outcome", fenced(F.col("asked_attempt"), F.col("held")))


def retry_cap(base: Column, backoff: Column, attempt: Column, delay_max: Column, horizon: Column) -> Column:
    """The delay before jitter: none for 0, doubled for each attempt if exponential, held to both bounds."""
    shift = F.least(attempt - 1, F.lit(62)).cast("int")
    bound = F.least(delay_max, horizon)
    doubled = F.when(base > F.expr("9223372036854775807") / F.pow(F.lit(2.0), shift), F.lit(2**63 - 1)).otherwise(base * F.pow(F.lit(2.0), shift).cast("bigint"))
    return F.when(base == 0, F.lit(0)).otherwise(F.least(F.when(backoff == "exponential", doubled).otherwise(base), bound)).cast("bigint")


def explicit_delay(asked: Column, queue: Column, horizon: Column) -> Column:
    """An asked delay within the schedule horizon; 0 for a job that is not in flight, whose nack will be refused."""
    return F.when(queue.isNull(), F.lit(0)).otherwise(F.least(F.greatest(asked, F.lit(0)), horizon)).cast("bigint")


def strategy_label(delay: Column, dead_letter: Column) -> Column:
    """What a nack asks for: a delay of its own, the dead letters, or the queue's policy."""
    return F.when(delay.isNotNull(), "delay").when(dead_letter, "dead_letter").otherwise("default")


def nack_route(df: DataFrame, strategy: Column, delay: Column) -> DataFrame:
    """Where a nack sends its job: an explicit dead letter outranks exhausted attempts."""
    spent = F.col("attempt") >= F.col("max_attempts")
    route = F.when((strategy == "dead_letter") | spent, "dead_letter").when(delay > 0, "scheduled").otherwise("ready")
    cause = F.when(strategy == "dead_letter", "rejected").when(spent, "attempts_exhausted")
    return df.withColumns({"route": route, "cause": cause, "next_attempt": F.when(route == "dead_letter", F.col("attempt")).otherwise(F.col("attempt") + 1)})


def keyed_dead_letters(keys: DataFrame, dead: DataFrame, done: str) -> DataFrame:
    """keys (failed_at, queue, job_id, asked) with status: ``done`` if the record is there and its queue's own, else missing."""
    known = dead.select(F.col("failed_at").alias("__at"), F.col("queue").alias("__queue"), F.col("job_id").alias("__id"))
    same = (F.col("failed_at") == F.col("__at")) & (F.col("queue") == F.col("__queue")) & (F.col("job_id") == F.col("__id"))
    ok = F.col("__id").isNotNull() & (F.col("asked") == F.col("queue"))
    return keys.join(known, same, "left").withColumn("status", F.when(ok, done).otherwise("missing")).drop("__at", "__queue", "__id")
