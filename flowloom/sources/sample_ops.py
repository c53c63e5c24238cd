"""The sample jobs as an op log: enqueues, reservations, lease ends, hourly sweeps and audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ranking import audit_numbers
from .tables import LEASE_MS, OP_KINDS, OPS, jobs_view

HOUR = 3_600_000


def _ops(df: DataFrame, kind: str, at: Column, code: int, body: Column) -> DataFrame:
    own = [(body if k == kind else F.lit(None)).cast(t).alias(k) for k, t in OP_KINDS.items()]
    return df.select(at.alias("now_ms"), "event_id", F.lit(code).alias("code"), F.lit(kind).alias("kind"), *own)


def sample_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs_view(spark, sf_dir)
    none = lambda t: F.lit(None).cast(t)
    request = F.struct(
        F.col("queue").alias("queue"), F.col("job_type").alias("job_type"), none("struct<data:binary,encoding:string>").alias("payload"), F.col("idem").alias("idempotency_key"),
        F.col("priority").alias("priority"), F.col("max_attempts").alias("max_attempts"), none("struct<traceparent:string,tracestate:string>").alias("trace_context"),
        none("map<string,struct<s:string,d:double,i:bigint,b:boolean>>").alias("custom"), F.col("sched").alias("scheduled_at_ms"),
    )
    cap = F.when(F.col("queue") == "click", 300)
    limits = F.struct(F.col("priority").cast("int").alias("priority"), F.col("max_attempts").alias("max_attempts"), F.lit(86_400_000).cast("bigint").alias("dedup_window_ms"), cap.cast("bigint").alias("max_queue_depth"))
    enqueue = F.struct(F.array(F.struct("job_id", request.alias("request"), limits.alias("limits"))).alias("jobs"))
    reserve = F.struct(F.array("queue").alias("queues"), F.lit(LEASE_MS).cast("bigint").alias("lease_ms"), F.lit(1).cast("bigint").alias("max_jobs"))
    ack = F.struct("job_id", F.lit(1).cast("bigint").alias("attempt"))
    nack = F.struct(
        "job_id", F.lit(1).cast("bigint").alias("attempt"), F.lit("failed").alias("reason"), F.when(F.col("oc") == 8, "dead_letter").otherwise("default").alias("strategy"),
        (F.col("k") * 100).alias("retry_delay_ms"), F.lit(True).alias("dead_letter_enabled"),
    )
    hours = j.select((F.floor(F.col("enq") / HOUR) * HOUR + HOUR).cast("bigint").alias("at")).distinct().withColumn("event_id", F.lit(0).cast("bigint"))
    sweep = F.struct(F.lit(1 << 53).cast("bigint").alias("budget"), (F.col("at") - 7 * 24 * HOUR).alias("retention_cutoff_ms"), F.lit(True).alias("dead_letter_enabled"))
    audit = F.struct(F.concat(F.lit("a"), (F.col("user_id") % 5).cast("string")).alias("actor"), F.lit("admin").alias("role"), F.lit("job.enqueue").alias("action"), F.lit("{}").alias("details_json"))
    parts = [
        _ops(j, "enqueue", F.col("enq"), 0, enqueue),
        _ops(j, "reserve", F.col("reserved"), 1, reserve),
        _ops(j.where("oc <= 5"), "ack", F.col("done"), 2, ack),
        _ops(j.where("oc > 5"), "nack", F.col("done"), 2, nack),
        _ops(hours, "sweep", F.col("at"), 3, sweep),
        _ops(j.where("event_id % 50 = 1"), "audit_append", F.col("enq"), 3, audit),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # Time first, then the job and what happens to it: a rank, so that any id gets a number of its own.
    every = audit_numbers(every, "now_ms", "event_id", "code").withColumn("cycle_id", F.col("seq"))
    return every.select(*[c.split()[0] for c in OPS.split(", ")[:4]], *OP_KINDS)
