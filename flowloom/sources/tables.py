"""State tables and logs of queue data: schemas, readers, writers, and views over the sample tables.

Snapshots are immutable tables, so a query over several of them sees one state;
a key that has gone meanwhile cannot occur. Reads prune columns: payload bytes
are scanned only by queries that ask for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: The instant at which sample snapshots are taken, and the sample script's lease and steps of waiting, acting and
#: scheduling: long enough for some jobs of every queue to be in every state at T0.
T0 = 1_705_320_000_000
LEASE_MS, WAIT_MS, ACT_MS, SCHEDULE_MS = 21_600_000, 60_000, 300_000, 600_000

_CUSTOM = "map<string,struct<s:string,d:double,i:bigint,b:boolean>>"
_TRACE = "struct<traceparent:string,tracestate:string>"
_PAYLOAD = "struct<data:binary,encoding:string>"
_JOB = f"struct<job_id:string,queue:string,job_type:string,priority:int,max_attempts:bigint,enqueued_at_ms:bigint,scheduled_at_ms:bigint,payload:{_PAYLOAD},custom:{_CUSTOM},trace_context:{_TRACE}>"
#: Names, columns and types of the state tables.
STATE_TABLES = {
    "jobs": f"job_id string, queue string, job_type string, priority int, max_attempts bigint, attempt bigint, enqueued_at_ms bigint, scheduled_at_ms bigint, custom {_CUSTOM}, trace_context {_TRACE}",
    "payloads": "job_id string, data binary, encoding string",
    "ready": "queue string, inv_priority int, enqueued_at_ms bigint, job_id string, attempt bigint",
    "scheduled": "deadline_ms bigint, job_id string, queue string, attempt bigint",
    "inflight": f"job_id string, attempt bigint, lease_expires_at_ms bigint, enqueued_at_ms bigint, priority int, max_attempts bigint, queue string, trace_context {_TRACE}",
    "leases": "deadline_ms bigint, job_id string, queue string",
    "dedup": "queue string, idempotency_key string, enqueued_at_ms bigint, deadline_ms bigint, job_id string",
    "dedup_timers": "deadline_ms bigint, queue string, idempotency_key string",
    "dead_letter": f"failed_at_ms bigint, queue string, job_id string, cause string, final_attempt bigint, last_reason string, job {_JOB}",
    "closing": "queue string, deadline_ms bigint",
    "audit": "seq bigint, ts_ms bigint, actor string, role string, action string, details_json string",
}
_REQUEST = f"struct<queue:string,job_type:string,payload:{_PAYLOAD},idempotency_key:string,priority:bigint,max_attempts:bigint,trace_context:{_TRACE},custom:{_CUSTOM},scheduled_at_ms:bigint>"
_LIMITS = "struct<priority:int,max_attempts:bigint,dedup_window_ms:bigint,max_queue_depth:bigint>"
_PREPARED = f"struct<jobs:array<struct<job_id:string,request:{_REQUEST},limits:{_LIMITS}>>>"
_KEYS = "array<struct<failed_at_ms:bigint,queue:string,job_id:string>>"
#: One nullable struct for each kind of operation.
OP_KINDS = {
    "enqueue": _PREPARED,
    "enqueue_atomic": _PREPARED,
    "reserve": "struct<queues:array<string>,lease_ms:bigint,max_jobs:bigint>",
    "ack": "struct<job_id:string,attempt:bigint>",
    "nack": "struct<job_id:string,attempt:bigint,reason:string,strategy:string,retry_delay_ms:bigint,dead_letter_enabled:boolean>",
    "extend": "struct<job_id:string,attempt:bigint,lease_ms:bigint>",
    "drain_dead_letters": "struct<queue:string,max:bigint,scan_cap:bigint>",
    "close_queue": "struct<queue:string,grace_ms:bigint>",
    "open_queue": "struct<queue:string>",
    "requeue_dead_letters": f"struct<queue:string,keys:{_KEYS}>",
    "dead_letter_jobs": "struct<queue:string,state:string,keys:array<struct<priority:int,enqueued_at_ms:bigint,deadline_ms:bigint,job_id:string>>,reason:string,dead_letter_enabled:boolean>",
    "delete_dead_letters": f"struct<queue:string,keys:{_KEYS}>",
    "purge_queue_chunk": "struct<queue:string,max:bigint>",
    "sweep": "struct<budget:bigint,retention_cutoff_ms:bigint,dead_letter_enabled:boolean>",
    "audit_append": "struct<actor:string,role:string,action:string,details_json:string>",
}
OPS = "seq bigint, cycle_id bigint, now_ms bigint, kind string, " + ", ".join(f"{k} {v}" for k, v in OP_KINDS.items())


def read_ops(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """An op log; a row that does not parse, or whose kind lacks its struct, fails the read."""
    ops = spark.read.schema(OPS).option("mode", "FAILFAST").format(fmt).load(path)
    return checked_ops(ops)


def checked_ops(ops: DataFrame) -> DataFrame:
    """ops, failing on the first record whose kind is unknown or whose own struct is missing."""
    own = F.coalesce(*[F.when(F.col("kind") == k, F.col(k).isNotNull()) for k in OP_KINDS], F.lit(False))
    return ops.where(F.when(own, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("corrupt op at seq "), F.col("seq").cast("string"))).cast("boolean")))


def write_ops(ops: DataFrame, path: str, fmt: str = "parquet") -> None:
    ops.select(*[f.name for f in T._parse_datatype_string(OPS)]).write.mode("errorifexists").format(fmt).save(path)


def stream_ops(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The op log as a stream; the file bound is the back-pressure."""
    return spark.readStream.schema(OPS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as enqueued jobs with a scripted lease each: reserved, done or lapsed."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = _read(spark, sf_dir, "events").select(
        "event_id", "user_id", "value", F.col("event_id").cast("string").alias("job_id"), F.col("event_type").alias("queue"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), ms.alias("enq"),
    )
    j = e.withColumns(
        {
            "priority": F.col("k") % 10,
            "max_attempts": 1 + F.col("user_id") % 3,
            "job_type": F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")),
            "sched": F.when(F.col("event_id") % 5 == 0, F.col("enq") + F.col("k") * SCHEDULE_MS),
            "idem": F.when(F.col("event_id") % 4 == 0, F.concat_ws("-", F.col("user_id").cast("string"), F.col("k").cast("string"))),
        }
    )
    j = j.withColumn("reserved", F.greatest("enq", F.coalesce("sched", "enq")) + WAIT_MS * (F.col("event_id") % 97))
    return j.withColumns(
        {"lease_end": F.col("reserved") + LEASE_MS, "oc": F.col("event_id") % 10, "done": F.col("reserved") + ACT_MS * (F.col("event_id") % 80)}
    )


#: The same view for the checking engine, as the head of a WITH.
JOBS_SQL = f"""
j0 as (select event_id, user_id, value, cast(event_id as varchar) job_id, event_type queue,
         cast(json_extract_string(props, '$.k') as bigint) k, (epoch_us(ts) // 1000) enq from events),
j1 as (select *, k % 10 priority, 1 + user_id % 3 max_attempts, 'u' || cast(user_id % 7 as varchar) job_type,
         case when event_id % 5 = 0 then enq + k * {SCHEDULE_MS} end sched,
         case when event_id % 4 = 0 then cast(user_id as varchar) || '-' || cast(k as varchar) end idem from j0),
j2 as (select *, greatest(enq, coalesce(sched, enq)) + {WAIT_MS} * (event_id % 97) reserved from j1),
j as (select *, reserved + {LEASE_MS} lease_end, event_id % 10 oc, reserved + {ACT_MS} * (event_id % 80) done from j2)"""


def snapshot_view(spark: SparkSession, sf_dir: str, now: int = T0) -> DataFrame:
    """Every job's state at ``now``; an acked job is gone and one not yet enqueued is not there."""
    acted = (F.col("done") < F.col("lease_end")) & (F.col("done") <= now)
    lapsed = F.col("lease_end") <= now
    spent = F.col("max_attempts") <= 1
    state = (
        F.when(F.coalesce("sched", "enq") > now, "scheduled")
        .when(F.col("reserved") > now, "ready")
        .when((F.col("oc") <= 5) & acted, "acked")
        .when((F.col("oc") == 8) & acted, "dead_letter")
        .when(~lapsed, "inflight")
        .when(spent, "dead_letter")
        .otherwise("ready")
    )
    s = jobs_view(spark, sf_dir).where(F.col("enq") <= now).withColumn("state", state).where("state <> 'acked'")
    rejected = (F.col("oc") == 8) & acted
    return s.withColumns(
        {
            "attempt": F.when((F.col("state") == "ready") & (F.col("reserved") <= now), 2).otherwise(1).cast("bigint"),
            "cause": F.when(F.col("state") == "dead_letter", F.when(rejected, "rejected").otherwise("lease_expired")),
            "failed_at": F.when(F.col("state") == "dead_letter", F.when(rejected, F.col("done")).otherwise(F.col("lease_end"))),
        }
    )


SNAPSHOT_SQL = f"""{JOBS_SQL},
s0 as (select *, (done < lease_end and done <= {T0}) acted from j where enq <= {T0}),
s1 as (select *, case when coalesce(sched, enq) > {T0} then 'scheduled' when reserved > {T0} then 'ready'
         when oc <= 5 and acted then 'acked' when oc = 8 and acted then 'dead_letter' when lease_end > {T0} then 'inflight'
         when max_attempts <= 1 then 'dead_letter' else 'ready' end state from s0),
s as (select *, case when state = 'ready' and reserved <= {T0} then 2 else 1 end::bigint attempt,
        case when state = 'dead_letter' then case when oc = 8 and acted then 'rejected' else 'lease_expired' end end cause,
        case when state = 'dead_letter' then case when oc = 8 and acted then done else lease_end end end failed_at
      from s1 where state <> 'acked')"""


def payload_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as payloads."""
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("job_id"), F.encode("text", "UTF-8").alias("data"), F.col("lang").alias("encoding"))


def audit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit records; the sequence is the event's own number plus one."""
    e = _read(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.concat(F.lit("a"), (F.col("user_id") % 5).cast("string")).alias("actor"),
        F.element_at(F.array(F.lit("viewer"), F.lit("operator"), F.lit("admin")), (F.col("user_id") % 3 + 1).cast("int")).alias("role"),
        F.concat(F.col("event_type"), F.lit("."), F.when(F.col("event_id") % 2 == 0, "put").otherwise("delete")).alias("action"),
        F.col("props").alias("details_json"),
    )


AUDIT_SQL = """a as (select event_id + 1 seq, (epoch_us(ts) // 1000) ts_ms, 'a' || cast(user_id % 5 as varchar) actor,
  ['viewer', 'operator', 'admin'][user_id % 3 + 1] role, event_type || case when event_id % 2 = 0 then '.put' else '.delete' end "action", props details_json from events)"""


def registry_view(spark: SparkSession) -> DataFrame:
    """Per-queue overrides; null falls back to the default, and ``refund`` is declared without jobs."""
    return spark.createDataFrame(REGISTRY, REGISTRY_SCHEMA)


REGISTRY_SCHEMA = "queue string, max_lease_ms bigint, default_priority bigint, default_max_attempts bigint, max_queue_depth bigint, dedup_window_ms bigint, allowed_encodings array<string>, allowed_job_types array<string>, max_payload_bytes bigint, retry_delay_ms bigint, retry_backoff string"
REGISTRY = [
    ("purchase", 60000, 7, None, 50, 5000, ["en", "de"], None, 4000, 5000, "exponential"),
    ("signup", None, None, 2, None, 20000, None, ["u1", "u2", "u3"], None, None, None),
    ("view", 10000, None, None, 0, None, [], None, 200, 1000, "none"),
    ("click", None, 3, 5, 400, 600000, None, None, None, None, "exponential"),
    ("refund", 5000, 1, 1, 1, 1000, None, None, None, 0, None),
]


def registry_sql() -> str:
    def lit(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, list):
            return "[" + ", ".join(map(lit, v)) + "]::varchar[]"
        return f"'{v}'" if isinstance(v, str) else str(v)

    names = [c.split()[0] for c in REGISTRY_SCHEMA.split(", ")]
    rows = " union all ".join("select " + ", ".join(f"{lit(v)} {n}" for n, v in zip(names, row)) for row in REGISTRY)
    return f"r as ({rows})"
