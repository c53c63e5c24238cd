"""Depths, priority order, pages and top-k over a snapshot of jobs.

Within a queue ready jobs go by falling priority (9 at most), then enqueue time,
then id in byte order; timers by deadline and id; dead letters by time of failure,
length and bytes of the queue's name, and id. Every bound on examined rows is a
rank over the whole order, since rows that a filter drops count as examined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

STATES = ("ready", "scheduled", "inflight", "dead_letter")
PAGE_MOST = 100
EXAMINE_CAP = 10_000


def inv_priority(priority: Column) -> Column:
    return F.lit(9) - F.least(priority, F.lit(9))


def ready_order() -> list[Column]:
    return [inv_priority(F.col("priority")), F.col("enq"), F.col("job_id")]


def queue_depths(snapshot: DataFrame) -> DataFrame:
    """Jobs by queue and state, and live ones: dead letters do not count towards a cap."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    return snapshot.groupBy("queue").agg(*counts, F.count_if(F.col("state") != "dead_letter").alias("live"))


def ready_rank(snapshot: DataFrame) -> DataFrame:
    """Ready jobs with their place in their queue."""
    place = F.row_number().over(Window.partitionBy("queue").orderBy(*ready_order())).cast("bigint")
    return snapshot.where("state = 'ready'").withColumn("place", place)


def reserve_top_k(snapshot: DataFrame, k: int) -> DataFrame:
    """The k jobs of each queue that a worker gets first."""
    return ready_rank(snapshot).where(F.col("place") <= k)


def reserve_from(snapshot: DataFrame, queues: list[str], max_jobs: int, lease_ms: int, now: int) -> DataFrame:
    """What one reservation over several queues takes: queues in the order asked, up to max_jobs in all.

    Each queue's rank is bounded before queues meet, so the last order is over
    at most len(queues) * max_jobs rows.
    """
    asked = F.array_position(F.array(*map(F.lit, queues)), F.col("queue"))
    first = reserve_top_k(snapshot.where(F.col("queue").isin(queues)), max_jobs).withColumn("asked", asked)
    taken = first.orderBy("asked", "place").limit(max_jobs)
    return taken.withColumn("lease_expires_at_ms", F.lit(min(now + lease_ms, 2**63 - 1)).cast("bigint"))


def ready_page(snapshot: DataFrame, queue: str, after: tuple[int, int, str] | None, limit: int) -> DataFrame:
    """A page after a key, each row with the cursor to go on from; the cursor is null where nothing follows."""
    limit = min(max(limit, 1), PAGE_MOST)
    rows = snapshot.where((F.col("state") == "ready") & (F.col("queue") == queue)).withColumn("inv", inv_priority(F.col("priority")))
    if after is not None:
        inv, enq, job = after
        rows = rows.where((F.col("inv") > inv) | ((F.col("inv") == inv) & ((F.col("enq") > enq) | ((F.col("enq") == enq) & (F.col("job_id") > job)))))
    page = rows.orderBy("inv", "enq", "job_id").limit(limit + 1)
    n = F.row_number().over(Window.orderBy("inv", "enq", "job_id")).cast("bigint")
    more = F.count(F.lit(1)).over(Window.partitionBy()) > limit
    last = F.concat_ws("/", F.col("inv").cast("string"), F.col("enq").cast("string"), "job_id")
    page = page.withColumn("n", n).withColumn("more", more).where(F.col("n") <= limit)
    return page.withColumn("next_cursor", F.when(F.col("more"), F.max_by(last, "n").over(Window.partitionBy()))).drop("more")


TIMER_KEYS = {
    "scheduled": ["sched", "job_id"],
    "inflight": ["lease_end", "job_id"],
    "dead_letter": ["failed_at", "name_bytes", "queue", "job_id"],
}


def timer_index(snapshot: DataFrame, state: str) -> DataFrame:
    """Rows of a timer table with the key columns of its order."""
    return snapshot.where(F.col("state") == state).withColumn("name_bytes", F.octet_length("queue"))


def timer_page(snapshot: DataFrame, state: str, queue: str, limit: int, examine: int = EXAMINE_CAP) -> DataFrame:
    """A page of one queue out of an index over all queues, reading at most ``examine`` rows of it.

    Only the first ``examine`` rows in order are ever kept, so the rank over them
    is over a bounded table. ``truncated`` tells that the bound ended the page.
    """
    limit = min(max(limit, 1), PAGE_MOST)
    keys = TIMER_KEYS[state]
    index = timer_index(snapshot, state)
    seen = index.orderBy(*keys).limit(examine + 1).withColumn("examined", F.row_number().over(Window.orderBy(*keys)).cast("bigint"))
    seen = seen.withColumn("cut", F.max("examined").over(Window.partitionBy()) > examine).where(F.col("examined") <= examine)
    found = seen.where(F.col("queue") == queue).withColumn("n", F.row_number().over(Window.orderBy("examined")).cast("bigint"))
    page = found.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy())).where(F.col("n") <= limit)
    return page.withColumn("truncated", F.col("cut") & (F.col("found") < limit)).drop("cut", "found")


def drain(snapshot: DataFrame, queue: str | None, most: int, scan_cap: int) -> DataFrame:
    """The oldest dead letters a drain returns: up to ``most`` matches among the first ``scan_cap`` rows."""
    keys = TIMER_KEYS["dead_letter"]
    seen = timer_index(snapshot, "dead_letter").orderBy(*keys).limit(scan_cap)
    hits = seen.where(F.col("queue") == queue) if queue else seen
    return hits.orderBy(*keys).limit(most)


def audit_page(audit: DataFrame, before: int | None, limit: int, actor: str = "", action_prefix: str = "", scan_cap: int = 1000) -> DataFrame:
    """Newest first; next_before is the last sequence examined if older ones remain."""
    limit = min(max(limit, 1), PAGE_MOST)
    rows = audit if before is None else audit.where(F.col("seq") < before)
    seen = rows.orderBy(F.col("seq").desc()).limit(scan_cap + 1).withColumn("examined", F.row_number().over(Window.orderBy(F.col("seq").desc())).cast("bigint"))
    more = F.max("examined").over(Window.partitionBy())
    seen = seen.withColumn("rows", more)
    within = seen.where(F.col("examined") <= scan_cap)
    hit = F.lit(True)
    if actor:
        hit = hit & (F.col("actor") == actor)
    if action_prefix:
        hit = hit & F.startswith(F.col("action"), F.lit(action_prefix))
    hits = within.where(hit).withColumn("n", F.row_number().over(Window.orderBy("examined")).cast("bigint"))
    # The page is full at its limit-th match; otherwise the scan ends at the cap or at the oldest record.
    stop = F.coalesce(F.max(F.when(F.col("n") == limit, F.col("examined"))).over(Window.partitionBy()), F.least(F.col("rows"), F.lit(scan_cap)))
    hits = hits.withColumn("stop", stop).where(F.col("n") <= limit)
    last = within.select(F.col("examined").alias("e"), F.col("seq").alias("stop_seq"))
    out = hits.join(last, F.col("stop") == F.col("e"), "left")
    return out.withColumn("next_before", F.when(F.col("rows") > F.col("stop"), F.col("stop_seq"))).drop("rows", "stop", "e", "stop_seq")


def audit_numbers(events: DataFrame, order: str, *ties: str) -> DataFrame:
    """Sequence numbers from 1 in insertion order, whatever the clock says; ties decide between equal rows.

    A global order without one task over all rows: rows are counted per range of
    the order column, and ranks within a range are shifted by the ranges before.
    """
    spark = events.sparkSession
    lo, hi, n = events.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    if not n:
        return events.withColumn("seq", F.lit(0).cast("bigint"))
    parts = max(1, min(4096, n // 2000))
    width = (hi - lo) // parts + 1
    ranged = events.withColumn("__range", F.floor((F.col(order) - lo) / width).cast("bigint"))
    sizes = sorted((r["__range"], r["count"]) for r in ranged.groupBy("__range").count().collect())
    before, rows = 0, []
    for part, size in sizes:
        rows.append((part, before))
        before += size
    shift = spark.createDataFrame(rows, "__range bigint, __before bigint")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(order, *ties))
    return ranged.join(F.broadcast(shift), "__range").withColumn("seq", F.col("__before") + place).drop("__range", "__before")


def get_job(snapshot: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """Asked ids with the job's state; dead letters and unknown ids are not found."""
    live = snapshot.where("state <> 'dead_letter'").drop("state").withColumn("__in", (F.col("reserved") <= now) & (F.col("attempt") == 1))
    joined = asked.join(live, "job_id", "left")
    state = F.when(F.col("queue").isNull(), "not_found").when(F.col("__in"), "inflight").when(F.coalesce("sched", "enq") > now, "scheduled").otherwise("ready")
    return joined.withColumn("found_state", state).drop("__in")
