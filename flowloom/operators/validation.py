"""Validation of enqueue requests as one chained expression: the first failing rule names the rejection.

Lengths are of UTF-8 bytes. Limits come from a registry joined by queue; a limit
that a queue does not set is the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Default limits.
DEFAULTS = {
    "max_lease_ms": 300_000, "default_max_attempts": 3, "max_attempts_ceiling": 100, "default_priority": 0, "retry_delay_ms": 0,
    "retry_backoff": "none", "retry_delay_max_ms": 3_600_000, "max_reserve_batch": 256, "max_reserve_queues": 32, "max_wait_ms": 300_000,
    "max_enqueue_batch": 256, "max_payload_bytes": 1_048_576, "max_custom_entries": 64, "max_custom_bytes": 16_384, "max_custom_key_bytes": 256,
    "max_queue_name_bytes": 512, "max_job_type_bytes": 256, "max_idempotency_key_bytes": 256, "schedule_horizon_ms": 2_592_000_000, "dedup_window_ms": 86_400_000,
}
#: Labels of the reasons, in the order in which they are tested.
REASONS = (
    "invalid_request", "unknown_queue", "queue_name_too_long", "job_type_name_too_long", "job_type_not_allowed", "idempotency_key_too_long", "payload_too_large",
    "encoding_not_allowed", "custom_entries_too_many", "custom_key_too_long", "custom_map_too_large", "scheduled_too_far", "queue_closing", "queue_full",
)


def byte_length(c: Column) -> Column:
    return F.octet_length(c).cast("bigint")


def bad_queue_name(q: Column) -> Column:
    return q.isNull() | (q == "") | q.isin(".", "..") | F.contains(q, F.lit("/")) | q.rlike("\\p{Cc}")


def structural_message(c: dict[str, Column]) -> Column:
    """The text for a request of the wrong shape, else null."""
    return (
        F.when(bad_queue_name(c["queue"]), "queue name is empty, a dot name, or holds a slash or control character")
        .when(F.coalesce(c["job_type"], F.lit("")) == "", "job_type must not be empty")
        .when(c["payload"].isNotNull() & (byte_length(c["payload"]) == 0), "payload must not be empty")
        .when(c["payload"].isNotNull() & (F.coalesce(c["encoding"], F.lit("")) == ""), "payload needs an encoding")
        .when(c["idempotency_key"] == "", "idempotency_key must not be empty")
        .when((c["priority"] < 0) | (c["priority"] > 9), "priority must be 0 to 9")
        .when(c["max_attempts"] < 1, "max_attempts must be at least 1")
    )


def custom_bytes(custom: Column) -> Column:
    """Bytes of keys and values of a map of typed primitives: strings by length, numbers 8, booleans 1."""
    size = lambda v: F.coalesce(F.octet_length(v["s"]).cast("bigint"), F.when(v["d"].isNotNull() | v["i"].isNotNull(), 8), F.when(v["b"].isNotNull(), 1), F.lit(0)).cast("bigint")
    return F.aggregate(F.map_entries(custom), F.lit(0).cast("bigint"), lambda a, e: a + byte_length(e["key"]) + size(e["value"]))


def first_long_key(custom: Column, most: Column) -> Column:
    """The first key in byte order that is longer than allowed."""
    return F.get(F.filter(F.array_sort(F.map_keys(custom)), lambda k: F.octet_length(k) > most), F.lit(0))


def with_limits(requests: DataFrame, registry: DataFrame, queue: str = "queue") -> DataFrame:
    """requests with ``declared`` and one ``lim_`` column for each limit; the registry's size is its number of declared queues."""
    own = [c for c in registry.columns if c != "queue"]
    r = registry.select(F.col("queue").alias("__queue"), *[F.col(c).alias(f"__{c}") for c in own])
    joined = requests.join(r, F.col(queue) == F.col("__queue"), "left")
    limits = {f"lim_{k}": F.coalesce(F.col(f"__{k}"), F.lit(v)) if k in own else F.lit(v) for k, v in DEFAULTS.items()}
    # These two have no default: null stands for no bound, and job types never fall back.
    limits |= {f"lim_{k}": F.col(f"__{k}") for k in ("max_queue_depth", "allowed_encodings", "allowed_job_types") if k in own}
    return joined.withColumn("declared", F.col("__queue").isNotNull()).withColumns(limits).drop("__queue", *[f"__{c}" for c in own])


def resolved_limits(jobs: DataFrame, boot: DataFrame, live: DataFrame, asked_attempts: Column) -> DataFrame:
    """jobs with the limits that ride on their ops: dedup windows of the boot registry, all else of the live one."""
    first = with_limits(jobs, boot).withColumn("boot_dedup_window_ms", F.col("lim_dedup_window_ms").cast("bigint"))
    first = first.drop("declared", *[c for c in first.columns if c.startswith("lim_")])
    both = with_limits(first, live)
    attempts = F.least(F.coalesce(asked_attempts, F.col("lim_default_max_attempts")), F.col("lim_max_attempts_ceiling")).cast("bigint")
    return both.withColumns({"resolved_max_attempts": attempts, "live_max_queue_depth": F.col("lim_max_queue_depth").cast("bigint")})


def classify_enqueue(requests: DataFrame, registry: DataFrame, strict: bool, now: Column) -> DataFrame:
    """requests with reason (null if accepted), limit, actual and message.

    Expects queue, job_type, payload, encoding, idempotency_key, priority,
    max_attempts, custom and scheduled_at_ms.
    """
    df = with_limits(requests, registry)
    c = {n: F.col(n) for n in ("queue", "job_type", "payload", "encoding", "idempotency_key", "priority", "max_attempts", "custom", "scheduled_at_ms")}
    lim = lambda n: F.col(f"lim_{n}")
    message = structural_message(c)
    entries = F.coalesce(F.cardinality(c["custom"]).cast("bigint"), F.lit(0).cast("bigint"))
    entries = F.when(c["custom"].isNull(), F.lit(0)).otherwise(entries).cast("bigint")
    long_key = first_long_key(c["custom"], lim("max_custom_key_bytes"))
    total = custom_bytes(c["custom"])
    rules = [
        ("invalid_request", message.isNotNull(), None, None),
        ("unknown_queue", F.lit(strict) & ~F.col("declared"), None, None),
        ("queue_name_too_long", byte_length(c["queue"]) > lim("max_queue_name_bytes"), lim("max_queue_name_bytes"), byte_length(c["queue"])),
        ("job_type_name_too_long", byte_length(c["job_type"]) > lim("max_job_type_bytes"), lim("max_job_type_bytes"), byte_length(c["job_type"])),
        ("job_type_not_allowed", lim("allowed_job_types").isNotNull() & ~F.array_contains(lim("allowed_job_types"), c["job_type"]), None, None),
        ("idempotency_key_too_long", byte_length(c["idempotency_key"]) > lim("max_idempotency_key_bytes"), lim("max_idempotency_key_bytes"), byte_length(c["idempotency_key"])),
        ("payload_too_large", byte_length(c["payload"]) > lim("max_payload_bytes"), lim("max_payload_bytes"), byte_length(c["payload"])),
        ("encoding_not_allowed", c["payload"].isNotNull() & lim("allowed_encodings").isNotNull() & ~F.array_contains(lim("allowed_encodings"), F.coalesce(c["encoding"], F.lit(""))), None, None),
        ("custom_entries_too_many", entries > lim("max_custom_entries"), lim("max_custom_entries"), entries),
        ("custom_key_too_long", long_key.isNotNull(), lim("max_custom_key_bytes"), byte_length(long_key)),
        ("custom_map_too_large", total > lim("max_custom_bytes"), lim("max_custom_bytes"), total),
        ("scheduled_too_far", c["scheduled_at_ms"] > now + lim("schedule_horizon_ms"), lim("schedule_horizon_ms"), c["scheduled_at_ms"]),
    ]
    # Which rule fails first is decided once; its label and numbers are then looked up.
    first = F.lit(None).cast("int")
    for k, (_, failed, _, _) in reversed(list(enumerate(rules, 1))):
        first = F.when(F.coalesce(failed, F.lit(False)), k).otherwise(first)
    number = lambda c: (F.lit(None) if c is None else c).cast("bigint")
    named = df.withColumn("__rule", first)
    pick = lambda values: F.when(F.col("__rule").isNotNull(), F.element_at(F.array(*values), F.col("__rule")))
    found = {
        "reason": pick([F.lit(label) for label, *_ in rules]),
        "limit": pick([number(limit) for _, _, limit, _ in rules]),
        "actual": pick([number(actual) for *_, actual in rules]),
        "message": message,
    }
    return named.withColumns(found).drop("__rule")


def _listed(names: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(names, _quoted), ", "), F.lit("]"))


def _quoted(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def rejection_detail() -> Column:
    """The sentence for a classified request's reason, of its columns reason, limit, actual and message; null if accepted."""
    limit, actual = F.col("limit").cast("string"), F.col("actual").cast("string")
    measured = lambda what, unit="bytes": F.concat(F.lit(f"{what} "), actual, F.lit(f" {unit}; the limit is "), limit)
    long_key = first_long_key(F.col("custom"), F.col("limit"))
    texts = {
        "invalid_request": F.col("message"),
        "unknown_queue": F.concat(F.lit("queue "), _quoted(F.col("queue")), F.lit(" is not declared (strict mode)")),
        "queue_name_too_long": measured("queue name is"),
        "job_type_name_too_long": measured("job_type is"),
        "job_type_not_allowed": F.concat(F.lit("job_type "), _quoted(F.col("job_type")), F.lit(" is not allowed; allowed: "), _listed(F.col("lim_allowed_job_types"))),
        "idempotency_key_too_long": measured("idempotency_key is"),
        "payload_too_large": measured("payload is"),
        "encoding_not_allowed": F.concat(F.lit("encoding "), _quoted(F.col("encoding")), F.lit(" is not allowed; allowed: "), _listed(F.col("lim_allowed_encodings"))),
        "custom_entries_too_many": measured("custom map has", "entries"),
        "custom_key_too_long": F.concat(F.lit("custom key "), _quoted(long_key), F.lit(" is "), actual, F.lit(" bytes; the limit is "), limit),
        "custom_map_too_large": measured("custom map is"),
        "scheduled_too_far": F.lit("scheduled_at exceeds the schedule horizon"),
        "queue_closing": F.concat(F.lit("queue "), _quoted(F.col("queue")), F.lit(" is being deleted and is not accepting new jobs")),
        "queue_full": F.concat(F.lit("queue "), _quoted(F.col("queue")), F.lit(" is at capacity (max_queue_depth="), limit, F.lit(")")),
    }
    out = F.lit(None).cast("string")
    for reason, text in texts.items():
        out = F.when(F.col("reason") == reason, text).otherwise(out)
    return out


def batch_message(jobs: Column, most: int = DEFAULTS["max_enqueue_batch"]) -> Column:
    """The text for a batch of the wrong number of jobs, else null."""
    return F.when(jobs < 1, "batch must contain at least one job").when(jobs > most, f"batch exceeds max_enqueue_batch ({most})")


def reserve_queues_message(queues: Column, declared: Column, strict: bool, most: int = DEFAULTS["max_reserve_queues"], name_bytes: int = DEFAULTS["max_queue_name_bytes"]) -> Column:
    """The text for a reservation over too many, too long named or, in strict mode, undeclared queues, else null."""
    long_name = F.get(F.filter(queues, lambda q: F.octet_length(q) > name_bytes), F.lit(0))
    unknown = F.filter(queues, lambda q: ~F.array_contains(declared, q))
    return (
        F.when(F.size(queues) > most, f"reserve exceeds max_reserve_queues ({most})")
        .when(long_name.isNotNull(), F.concat(F.lit("queue name "), _quoted(long_name), F.lit(f" exceeds max_queue_name_bytes ({name_bytes})")))
        .when(F.lit(strict) & (F.size(unknown) > 0), F.concat(F.lit("queue(s) not declared (strict mode): "), _listed(unknown)))
    )


def rejections(classified: DataFrame) -> DataFrame:
    """Rejections by queue and reason; queues that cannot be trusted as a label are counted together."""
    label = F.when(F.col("reason").isin("invalid_request", "unknown_queue", "queue_name_too_long"), "_rejected").when(F.col("reason") == "queue_closing", "").otherwise(F.col("queue"))
    return classified.where("reason is not null").groupBy(label.alias("queue"), "reason").agg(F.count(F.lit(1)).alias("rejected"))


UUID = "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"


def request_message(kind: Column, c: dict[str, Column]) -> Column:
    """Shape of the other requests: reserve, ack, nack, extend and drain; null if right."""
    lease_id = kind.isin("ack", "nack", "extend")
    return (
        F.when((kind == "reserve") & (F.coalesce(F.size(c["queues"]), F.lit(0)) < 1), "queues must not be empty")
        .when((kind == "reserve") & F.exists(c["queues"], bad_queue_name), "a queue name is not valid")
        .when(kind.isin("reserve", "extend") & (F.coalesce(c["lease_ms"], F.lit(0)) <= 0), "lease must be positive")
        .when((kind == "reserve") & (c["max_jobs"] < 1), "max_jobs must be at least 1")
        .when(lease_id & ~F.coalesce(c["job_id"].rlike(UUID), F.lit(False)), "job_id is not a UUID")
        .when(lease_id & (F.coalesce(c["attempt"], F.lit(0)) < 1), "attempt must be at least 1")
        .when((kind == "nack") & c["strategy"].isNotNull() & ~c["strategy"].isin("default", "delay", "dead_letter"), "strategy is not known")
        .when((kind == "drain_dead_letters") & (c["queues"].isNotNull()) & F.exists(c["queues"], bad_queue_name), "a queue name is not valid")
    )


def reserve_clamps(lease_ms: Column, max_jobs: Column, wait_ms: Column, max_leases: Column) -> dict[str, Column]:
    """Lease, batch and wait of a reservation within the limits of all its queues."""
    return {
        "lease_ms": F.greatest(F.lit(1), F.least(lease_ms, F.array_min(max_leases))).cast("bigint"),
        "max_jobs": F.least(F.greatest(F.coalesce(max_jobs, F.lit(1)), F.lit(1)), F.lit(DEFAULTS["max_reserve_batch"])).cast("bigint"),
        "wait_ms": F.least(F.greatest(F.coalesce(wait_ms, F.lit(0)), F.lit(0)), F.lit(DEFAULTS["max_wait_ms"])).cast("bigint"),
    }
