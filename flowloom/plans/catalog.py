"""All queries over queue data, by name, and the SQL that checks each.

A query is a plan over the sample views of ``sources.tables``; its SQL states the
same result for another engine. Both are registered side by side, so that a name
cannot have one without the reader seeing whether it has the other.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import admission as ad, counters as ct, ranking as rk, validation as va
from ..sources.sample_ops import sample_ops
from ..sources.shared import shared_path, written
from ..sources.tables import (
    AUDIT_SQL, JOBS_SQL, SNAPSHOT_SQL, T0, audit_view, jobs_view, payload_view, registry_sql, registry_view, snapshot_view,
)
from ..streaming.replay_stream import replay_slices
from ..streaming.sinks import stats_frames
from .register import Query, register_into
from .replay import replay_outcomes, replay_state

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
query = register_into(_QUERIES, _SQL)
SQL_PAYLOAD_LIMIT = 4000
HOUR = 3_600_000


def _snap(select: str, *more: str) -> str:
    return f"with {', '.join([SNAPSHOT_SQL, *more])} {select}"


def _jobs(select: str, *more: str) -> str:
    return f"with {', '.join([JOBS_SQL, *more])} {select}"


# --- depths, order, top-k -------------------------------------------------------------------------


@query(_snap("""select queue, count(*) filter (state = 'ready') ready, count(*) filter (state = 'scheduled') scheduled, count(*) filter (state = 'inflight') inflight,
count(*) filter (state = 'dead_letter') dead_letter, count(*) filter (state <> 'dead_letter') live from s group by queue"""))
def queue_depths(spark, sf_dir):
    return rk.queue_depths(snapshot_view(spark, sf_dir))


@query(_snap("select queue, state, count(*) jobs from s group by queue, state"))
def depths_by_state(spark, sf_dir):
    return snapshot_view(spark, sf_dir).groupBy("queue", "state").agg(F.count(F.lit(1)).alias("jobs"))


@query(_snap("select sum(n)::bigint jobs, count(*) indexes from (select queue, state, count(*) n from s group by 1, 2)"))
def index_totals(spark, sf_dir):
    return depths_by_state(spark, sf_dir).agg(F.sum("jobs").alias("jobs"), F.count(F.lit(1)).alias("indexes"))


_RANK_SQL = "f as (select *, row_number() over (partition by queue order by 9 - least(priority, 9), enq, job_id) place from s where state = 'ready')"


@query(_snap("select queue, job_id, priority, enq, attempt, place from f where place <= 5", _RANK_SQL))
def reserve_topk(spark, sf_dir):
    return rk.reserve_top_k(snapshot_view(spark, sf_dir), 5).select("queue", "job_id", "priority", "enq", "attempt", "place")


@query(_snap("""select queue, job_id, attempt, 1705320060000::bigint lease_expires_at_ms from (select f.*, o.pos from f join (select unnest(['view', 'error', 'click']) q, unnest([1, 2, 3]) pos) o on q = queue
order by pos, place limit 12)""", _RANK_SQL))
def reserve_multi_queue(spark, sf_dir):
    got = rk.reserve_from(snapshot_view(spark, sf_dir), ["view", "error", "click"], 12, 60000, T0)
    return got.select("queue", "job_id", "attempt", "lease_expires_at_ms")


_PAGE_SQL = """p as (select *, 9 - least(priority, 9) inv from s where state = 'ready' and queue = 'click'),
c as (select inv, enq, job_id from p order by inv, enq, job_id limit 1 offset 9),
q as (select p.* from p, c where (p.inv, p.enq, p.job_id) > (c.inv, c.enq, c.job_id) order by p.inv, p.enq, p.job_id limit 21),
n as (select *, row_number() over (order by inv, enq, job_id) n, count(*) over () total from q)"""


@query(_snap("""select job_id, priority, enq, attempt, n, case when total > 20 then (select inv::varchar || '/' || enq::varchar || '/' || job_id from n where n = 20) end next_cursor
from n where n <= 20""", _PAGE_SQL))
def peek_ready_page(spark, sf_dir):
    s = snapshot_view(spark, sf_dir)
    tenth = rk.ready_page(s, "click", None, 10).where("n = 10").select("inv", "enq", "job_id").first()
    page = rk.ready_page(s, "click", tuple(tenth) if tenth else (0, 0, ""), 20)
    return page.select("job_id", "priority", "enq", "attempt", "n", "next_cursor")


def _timer_sql(state: str, order: str, queue: str, limit: int, examine: int) -> str:
    return _snap(
        f"select job_id, queue, n, examined, cut and total < {limit} truncated from n where n <= {limit}",
        f"x as (select *, row_number() over (order by {order}) examined, count(*) over () > {examine} cut from s where state = '{state}')",
        f"n as (select *, row_number() over (order by examined) n, count(*) over () total from x where examined <= {examine} and queue = '{queue}')",
    )


def _timer(spark, sf_dir, state, queue, limit, examine=rk.EXAMINE_CAP):
    return rk.timer_page(snapshot_view(spark, sf_dir), state, queue, limit, examine).select("job_id", "queue", "n", "examined", "truncated")


@query(_timer_sql("scheduled", "sched, job_id", "click", 15, 10000))
def peek_scheduled_page(spark, sf_dir):
    return _timer(spark, sf_dir, "scheduled", "click", 15)


@query(_timer_sql("inflight", "lease_end, job_id", "view", 15, 10000))
def peek_inflight_page(spark, sf_dir):
    return _timer(spark, sf_dir, "inflight", "view", 15)


@query(_timer_sql("dead_letter", "failed_at, strlen(queue), queue, job_id", "error", 15, 10000))
def peek_dead_letter_page(spark, sf_dir):
    return _timer(spark, sf_dir, "dead_letter", "error", 15)


@query(_timer_sql("dead_letter", "failed_at, strlen(queue), queue, job_id", "signup", 50, 40))
def peek_truncated(spark, sf_dir):
    return _timer(spark, sf_dir, "dead_letter", "signup", 50, 40)


@query(_snap("select failed_at, queue, job_id, cause, attempt final_attempt from (select * from (select * from s where state = 'dead_letter' order by failed_at, strlen(queue), queue, job_id limit 200) where queue = 'purchase' order by failed_at, job_id limit 10)"))
def drain_dead_letters(spark, sf_dir):
    got = rk.drain(snapshot_view(spark, sf_dir), "purchase", 10, 200)
    return got.select("failed_at", "queue", "job_id", "cause", F.col("attempt").alias("final_attempt"))


@query(_snap("select failed_at, queue, job_id, cause from s where state = 'dead_letter' order by failed_at, strlen(queue), queue, job_id limit 25"))
def drain_all_queues(spark, sf_dir):
    return rk.drain(snapshot_view(spark, sf_dir), None, 25, 10000).select("failed_at", "queue", "job_id", "cause")


@query(_snap("""select id job_id, queue, attempt, case when queue is null then 'not_found' when reserved <= 1705320000000 and attempt = 1 then 'inflight'
when coalesce(sched, enq) > 1705320000000 then 'scheduled' else 'ready' end found_state
from (select cast(event_id * 3 as varchar) id from events) left join (select * from s where state <> 'dead_letter') on id = job_id"""))
def get_job(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") * 3).cast("string").alias("job_id"))
    return rk.get_job(snapshot_view(spark, sf_dir), asked, T0).select("job_id", "queue", "attempt", "found_state")


@query(_snap("select f.job_id, f.queue, f.place, strlen(text)::bigint size, lang encoding, strlen(text) <= 4096 inline from f left join documents d on cast(d.doc_id as varchar) = f.job_id where place <= 20", _RANK_SQL))
def peek_with_payload(spark, sf_dir):
    first = rk.reserve_top_k(snapshot_view(spark, sf_dir), 20).select("job_id", "queue", "place")
    joined = first.join(payload_view(spark, sf_dir), "job_id", "left")
    size = F.octet_length("data").cast("bigint")
    return joined.select("job_id", "queue", "place", size.alias("size"), "encoding", (size <= fn.INLINE_BYTES).alias("inline"))


@query(_snap("select job_id, lease_end from s where state = 'inflight' and attempt = 1 and lease_end <= 1705330800000"))
def leases_checked(spark, sf_dir):
    """Lease timers that still match their job's lease."""
    s = snapshot_view(spark, sf_dir).where("state = 'inflight'")
    timers = s.select("job_id", F.col("lease_end").alias("deadline_ms")).where(F.col("deadline_ms") <= T0 + 3 * HOUR)
    held = s.select(F.col("job_id").alias("id"), "lease_end", "attempt")
    return timers.join(held, (F.col("job_id") == F.col("id")) & (F.col("deadline_ms") == F.col("lease_end"))).where("attempt = 1").select("job_id", "lease_end")


@query("select queue from (select event_type queue from events union select unnest(['purchase', 'signup', 'view', 'click', 'refund'])) order by queue")
def queue_names(spark, sf_dir):
    own = jobs_view(spark, sf_dir).select("queue")
    return own.unionByName(registry_view(spark).select("queue")).distinct().orderBy("queue")


# --- audit ----------------------------------------------------------------------------------------

_AUDIT_PAGE_SQL = """x as (select *, row_number() over (order by seq desc) examined, count(*) over () total from a where seq < {before}),
h as (select *, row_number() over (order by examined) n from x where examined <= {cap} and {hit}),
e as (select coalesce((select examined from h where n = {limit}), (select least(max(total), {cap}) from x)) stop)
select seq, actor, "action", n, case when total > stop then (select seq from x where examined = stop) end next_before from h, e where n <= {limit}"""


@query(f"with {AUDIT_SQL}, " + _AUDIT_PAGE_SQL.format(before=5000, cap=1000, hit="true", limit=50))
def audit_page(spark, sf_dir):
    return rk.audit_page(audit_view(spark, sf_dir), 5000, 50).select("seq", "actor", "action", "n", "next_before")


@query(f"with {AUDIT_SQL}, " + _AUDIT_PAGE_SQL.format(before=9000, cap=1000, hit="actor = 'a3' and starts_with(action, 'view.')", limit=100))
def audit_filtered_page(spark, sf_dir):
    return rk.audit_page(audit_view(spark, sf_dir), 9000, 100, "a3", "view.").select("seq", "actor", "action", "n", "next_before")


@query("select event_id, row_number() over (order by event_id) seq from events")
def audit_seq(spark, sf_dir):
    return rk.audit_numbers(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"), "event_id")


@query(f"with {AUDIT_SQL} select role, \"action\", count(*) records, min(seq) first_seq from a group by role, \"action\"")
def audit_by_action(spark, sf_dir):
    return audit_view(spark, sf_dir).groupBy("role", "action").agg(F.count(F.lit(1)).alias("records"), F.min("seq").alias("first_seq"))


# --- validation and registry ----------------------------------------------------------------------

_CUSTOM = "map<string,struct<s:string,d:double,i:bigint,b:boolean>>"


def _requests(spark, sf_dir):
    """Sample jobs as enqueue requests, some of them wrong in each way that a rule looks for."""
    j = jobs_view(spark, sf_dir)
    e = F.col("event_id")
    value = lambda **v: F.struct(*[F.lit(v.get(k)).cast(t).alias(k) for k, t in (("s", "string"), ("d", "double"), ("i", "bigint"), ("b", "boolean"))])
    key = F.when(e % 53 == 0, F.repeat(F.lit("k"), 300)).otherwise(F.lit("key"))
    text = F.struct(F.repeat(F.lit("v"), (F.col("k") * 400).cast("int")).alias("s"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("boolean").alias("b"))
    many = F.map_from_arrays(F.array(*[F.lit(f"k{i}") for i in range(1, 66)]), F.array_repeat(value(i=1), 65)).cast(_CUSTOM)
    custom = F.when(e % 151 == 0, many).when(e % 3 == 0, F.map_from_arrays(F.array(key, F.lit("n"), F.lit("f")), F.array(text, value(i=1), value(b=True))).cast(_CUSTOM))
    return j.select(
        "event_id",
        F.when(e % 101 == 0, "..").when(e % 103 == 0, F.concat(F.col("queue"), F.lit("/x"))).when(e % 107 == 0, F.repeat(F.lit("q"), 600)).otherwise(F.col("queue")).alias("queue"),
        F.when(e % 109 == 0, "").when(e % 113 == 0, F.repeat(F.lit("é"), 200)).otherwise(F.col("job_type")).alias("job_type"),
        F.when(e % 2 == 0, F.repeat(F.lit("p"), (F.col("k") * 90).cast("int"))).alias("payload"),
        F.when(e % 127 != 0, F.element_at(F.array(*map(F.lit, ("en", "de", "fr"))), (e % 3 + 1).cast("int"))).alias("encoding"),
        F.when(e % 131 == 0, "").when(e % 149 == 0, F.repeat(F.lit("i"), 300)).otherwise(F.col("idem")).alias("idempotency_key"),
        F.when(e % 137 == 0, 12).otherwise(F.col("priority")).cast("bigint").alias("priority"),
        F.when(e % 139 == 0, 0).otherwise(F.col("max_attempts")).cast("bigint").alias("max_attempts"),
        custom.alias("custom"),
        F.when(e % 19 == 0, F.col("enq") + F.col("k") * 100_000_000).alias("scheduled_at_ms"),
        "enq",
    )


_REQUESTS_SQL = """q0 as (select event_id, enq, k,
  case when event_id % 101 = 0 then '..' when event_id % 103 = 0 then queue || '/x' when event_id % 107 = 0 then repeat('q', 600) else queue end queue,
  case when event_id % 109 = 0 then '' when event_id % 113 = 0 then repeat('é', 200) else job_type end job_type,
  case when event_id % 2 = 0 then repeat('p', k * 90) end payload,
  case when event_id % 127 <> 0 then ['en', 'de', 'fr'][event_id % 3 + 1] end encoding,
  case when event_id % 131 = 0 then '' when event_id % 149 = 0 then repeat('i', 300) else idem end idempotency_key,
  case when event_id % 137 = 0 then 12 else priority end priority,
  case when event_id % 139 = 0 then 0 else max_attempts end max_attempts,
  case when event_id % 151 = 0 then 65 when event_id % 3 = 0 then 3 end entries, case when event_id % 151 = 0 then 3 when event_id % 3 = 0 and event_id % 53 = 0 then 300 when event_id % 3 = 0 then 3 end key_bytes,
  case when event_id % 151 = 0 then 706 when event_id % 3 = 0 then case when event_id % 53 = 0 then 300 else 3 end + 1 + 1 + k * 400 + 8 + 1 end custom_bytes,
  case when event_id % 19 = 0 then enq + k * 100000000 end scheduled_at_ms from j),
q1 as (select q0.*, r.queue is not null declared, r.allowed_job_types, r.allowed_encodings, coalesce(r.max_payload_bytes, 1048576) max_payload from q0 left join r on r.queue = q0.queue),
q2 as (select *, case
  when queue in ('', '.', '..') or contains(queue, '/') or job_type = '' or (payload is not null and (strlen(payload) = 0 or coalesce(encoding, '') = '')) or idempotency_key = ''
    or priority > 9 or max_attempts < 1 then 'invalid_request'
  when {strict} and not declared then 'unknown_queue'
  when strlen(queue) > 512 then 'queue_name_too_long' when strlen(job_type) > 256 then 'job_type_name_too_long'
  when allowed_job_types is not null and not list_contains(allowed_job_types, job_type) then 'job_type_not_allowed'
  when strlen(idempotency_key) > 256 then 'idempotency_key_too_long' when strlen(payload) > max_payload then 'payload_too_large'
  when payload is not null and allowed_encodings is not null and not list_contains(allowed_encodings, coalesce(encoding, '')) then 'encoding_not_allowed'
  when entries > 64 then 'custom_entries_too_many' when key_bytes > 256 then 'custom_key_too_long' when custom_bytes > 16384 then 'custom_map_too_large'
  when scheduled_at_ms > enq + 2592000000 then 'scheduled_too_far' end reason from q1),
q as (select *, case reason when 'queue_name_too_long' then 512 when 'job_type_name_too_long' then 256 when 'payload_too_large' then max_payload when 'idempotency_key_too_long' then 256 when 'custom_entries_too_many' then 64 when 'custom_key_too_long' then 256
  when 'custom_map_too_large' then 16384 when 'scheduled_too_far' then 2592000000 end::bigint "limit",
  case reason when 'queue_name_too_long' then strlen(queue) when 'job_type_name_too_long' then strlen(job_type) when 'payload_too_large' then strlen(payload) when 'idempotency_key_too_long' then strlen(idempotency_key) when 'custom_entries_too_many' then entries
  when 'custom_key_too_long' then key_bytes when 'custom_map_too_large' then custom_bytes when 'scheduled_too_far' then scheduled_at_ms end::bigint actual from q2)"""


def _classified(spark, sf_dir, strict):
    return va.classify_enqueue(_requests(spark, sf_dir), registry_view(spark), strict, F.col("enq"))


@query(_jobs('select event_id, reason, "limit", actual from q', registry_sql(), _REQUESTS_SQL.format(strict="false")))
def enqueue_classify(spark, sf_dir):
    return _classified(spark, sf_dir, False).select("event_id", "reason", "limit", "actual")


@query(_jobs("""select case when reason in ('invalid_request', 'unknown_queue', 'queue_name_too_long') then '_rejected' else queue end queue, reason, count(*) rejected
from q where reason is not null group by 1, 2""", registry_sql(), _REQUESTS_SQL.format(strict="true")))
def rejections_by_reason(spark, sf_dir):
    return va.rejections(_classified(spark, sf_dir, True))


@query("select doc_id::varchar job_id, strlen(text)::bigint size, strlen(text) > 4000 too_large, lang not in ('en', 'de') wrong_encoding, case when strlen(text) <= 4096 then sha256(base64(encode(text))) end inline_sha from documents")
def payload_limits(spark, sf_dir):
    p = payload_view(spark, sf_dir)
    shown = fn.payload_json(F.col("data"), F.col("encoding"))
    return p.select(
        "job_id", shown["size"].alias("size"), (shown["size"] > SQL_PAYLOAD_LIMIT).alias("too_large"), (~F.col("encoding").isin("en", "de")).alias("wrong_encoding"), F.sha2(shown["data"], 256).alias("inline_sha")
    )


@query(_jobs("select event_id, entries::bigint entries, custom_bytes::bigint custom_bytes, case when key_bytes > 256 then key_bytes end::bigint long_key from q where entries is not null", registry_sql(), _REQUESTS_SQL.format(strict="false")))
def custom_map_limits(spark, sf_dir):
    r = _requests(spark, sf_dir).where("custom is not null")
    return r.select(
        "event_id", F.cardinality("custom").cast("bigint").alias("entries"), va.custom_bytes(F.col("custom")).alias("custom_bytes"), va.byte_length(va.first_long_key(F.col("custom"), F.lit(256))).alias("long_key")
    )


@query(f"""with {registry_sql()}, n as (select distinct event_type queue from events union select queue from r)
select n.queue, r.queue is not null declared, coalesce(max_lease_ms, 300000)::bigint max_lease_ms, coalesce(default_priority, 0)::bigint default_priority, coalesce(default_max_attempts, 3)::bigint default_max_attempts,
max_queue_depth::bigint max_queue_depth, coalesce(dedup_window_ms, 86400000)::bigint dedup_window_ms, coalesce(max_payload_bytes, 1048576)::bigint max_payload_bytes, coalesce(retry_delay_ms, 0)::bigint retry_delay_ms, coalesce(retry_backoff, 'none') retry_backoff
from n left join r on r.queue = n.queue""")
def effective_limits(spark, sf_dir):
    names = ("max_lease_ms", "default_priority", "default_max_attempts", "max_queue_depth", "dedup_window_ms", "max_payload_bytes", "retry_delay_ms")
    limits = va.with_limits(queue_names(spark, sf_dir), registry_view(spark))
    return limits.select("queue", "declared", *[F.col(f"lim_{n}").cast("bigint").alias(n) for n in names], F.col("lim_retry_backoff").alias("retry_backoff"))


@query(f"with {registry_sql()} select least(300000, min(max_lease_ms))::bigint min_max_lease_ms, coalesce(bool_or(retry_delay_ms > 0), false) any_retry_policy from r")
def registry_summary(spark, sf_dir):
    r = registry_view(spark)
    return r.agg(F.least(F.lit(va.DEFAULTS["max_lease_ms"]), F.min("max_lease_ms")).cast("bigint").alias("min_max_lease_ms"), F.coalesce(F.bool_or(F.col("retry_delay_ms") > 0), F.lit(False)).alias("any_retry_policy"))


@query(f"with {registry_sql()} select event_type queue, count(*) jobs from events where event_type not in (select queue from r) group by 1")
def undeclared_queues(spark, sf_dir):
    return jobs_view(spark, sf_dir).join(F.broadcast(registry_view(spark).select("queue")), "queue", "left_anti").groupBy("queue").agg(F.count(F.lit(1)).alias("jobs"))


@query(_jobs("select event_id from j where queue not in (select queue from r)", registry_sql()))
def strict_unknown_queues(spark, sf_dir):
    return jobs_view(spark, sf_dir).join(F.broadcast(registry_view(spark).select("queue")), "queue", "left_anti").select("event_id")


@query(_jobs("""select event_id, coalesce(case when event_id % 2 = 0 then priority end, default_priority, 0)::bigint priority,
least(coalesce(case when event_id % 3 = 0 then max_attempts * 60 end, default_max_attempts, 3), 100)::bigint max_attempts, 9 - least(coalesce(case when event_id % 2 = 0 then priority end, default_priority, 0), 9)::bigint inv_priority
from j left join r on r.queue = j.queue""", registry_sql()))
def job_limits_resolved(spark, sf_dir):
    j = va.with_limits(jobs_view(spark, sf_dir), registry_view(spark))
    asked = F.when(F.col("event_id") % 2 == 0, F.col("priority"))
    priority = F.coalesce(asked, F.col("lim_default_priority")).cast("bigint")
    attempts = F.coalesce(F.when(F.col("event_id") % 3 == 0, F.col("max_attempts") * 60), F.col("lim_default_max_attempts"))
    return j.select("event_id", priority.alias("priority"), F.least(attempts, F.col("lim_max_attempts_ceiling")).cast("bigint").alias("max_attempts"), rk.inv_priority(priority).cast("bigint").alias("inv_priority"))


@query(_jobs("""select event_id, greatest(1, least(k * 1000, list_min([coalesce(max_lease_ms, 300000), 45000])))::bigint lease_ms, least(greatest(coalesce(case when event_id % 2 = 0 then k * 5 end, 1), 1), 256)::bigint max_jobs,
least(greatest(k * 9000 - 100000, 0), 300000)::bigint wait_ms from j left join r on r.queue = j.queue""", registry_sql()))
def reserve_clamps(spark, sf_dir):
    j = va.with_limits(jobs_view(spark, sf_dir), registry_view(spark))
    clamps = va.reserve_clamps(F.col("k") * 1000, F.when(F.col("event_id") % 2 == 0, F.col("k") * 5), F.col("k") * 9000 - 100000, F.array(F.col("lim_max_lease_ms"), F.lit(45000)))
    return j.select("event_id", *[c.alias(n) for n, c in clamps.items()])


@query(_jobs("""select event_id, case when kind in ('ack', 'nack', 'extend') and event_id % 5 = 0 then 'job_id is not a UUID' when kind in ('ack', 'nack', 'extend') and k = 0 then 'attempt must be at least 1'
when kind = 'extend' and k < 0 then 'x' end message from (select *, ['ack', 'nack', 'extend'][event_id % 3 + 1] kind from j)"""))
def lease_request_checks(spark, sf_dir):
    j = jobs_view(spark, sf_dir)
    kind = F.element_at(F.array(F.lit("ack"), F.lit("nack"), F.lit("extend")), (F.col("event_id") % 3 + 1).cast("int"))
    uuid = F.when(F.col("event_id") % 5 == 0, "short").otherwise(F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("event_id").cast("string"), 12, "0")))
    none = F.lit(None)
    c = {"queues": none.cast("array<string>"), "lease_ms": F.lit(5), "max_jobs": none.cast("bigint"), "job_id": uuid, "attempt": F.col("k"), "strategy": none.cast("string")}
    return j.select("event_id", va.request_message(kind, c).alias("message"))


# --- dedup, admission, routing --------------------------------------------------------------------

_DEDUP_SQL = """recursive d0 as (select queue, idem, event_id, enq, row_number() over (partition by queue, idem order by enq, event_id) n from j where idem is not null),
d as (select queue, idem, event_id, n, event_id first_id, enq + {w} deadline, false deduplicated from d0 where n = 1
  union all select d0.queue, d0.idem, d0.event_id, d0.n, case when d0.enq < d.deadline then d.first_id else d0.event_id end, case when d0.enq < d.deadline then d.deadline else d0.enq + {w} end, d0.enq < d.deadline
  from d join d0 on d0.queue = d.queue and d0.idem = d.idem and d0.n = d.n + 1)"""


def _dedup(select: str, w: int, *more: str) -> str:
    return f"with recursive {JOBS_SQL}, {', '.join([_DEDUP_SQL.format(w=w).removeprefix('recursive '), *more])} {select}"


DAY = 86_400_000


@query(_dedup("select queue, idem, event_id, first_id, deadline, deduplicated from d", 5 * DAY))
def dedup_enqueue(spark, sf_dir):
    return ad.dedup_fold(jobs_view(spark, sf_dir), 5 * DAY)


@query(_dedup("select queue, count(*) keyed, count(*) filter (deduplicated) deduplicated, count(distinct first_id) firsts from d group by queue", 5 * DAY))
def dedup_counts(spark, sf_dir):
    d = ad.dedup_fold(jobs_view(spark, sf_dir), 5 * DAY)
    return d.groupBy("queue").agg(F.count(F.lit(1)).alias("keyed"), F.count_if("deduplicated").alias("deduplicated"), F.countDistinct("first_id").alias("firsts"))


@query(_dedup("""select m.event_id, case when max_queue_depth is not null and f.place > max_queue_depth then 'queue_full' when m.deduplicated then 'deduplicated' else 'accepted' end status
from m join f on f.event_id = m.first_id""", 5 * DAY, registry_sql(),
"m as (select j.event_id, j.queue, j.enq, coalesce(d.first_id, j.event_id) first_id, coalesce(d.deduplicated, false) deduplicated, r.max_queue_depth from j left join d on d.event_id = j.event_id left join r on r.queue = j.queue)",
"f as (select event_id, row_number() over (partition by queue order by enq, event_id) place from m where not deduplicated)"))
def admission_no_dequeue(spark, sf_dir):
    return ad.admit(jobs_view(spark, sf_dir), registry_view(spark), 5 * DAY).select("event_id", "status")


@query(_snap("""select batch, sum(demand)::bigint jobs, sum(case when isfull then demand else 0 end)::bigint rejected, not bool_or(isfull) committed
from (select t.*, coalesce(max_queue_depth is not null and coalesce(live, 0) + demand > max_queue_depth, false) isfull from t left join lv on lv.queue = t.queue left join r on r.queue = t.queue) group by batch""",
registry_sql(), "lv as (select queue, count(*) live from s where state <> 'dead_letter' group by queue)", "t as (select event_id // 4 batch, queue, count(*) demand from j group by 1, 2)"))
def atomic_admission(spark, sf_dir):
    batches = jobs_view(spark, sf_dir).withColumn("batch", F.floor(F.col("event_id") / 4).cast("bigint"))
    return ad.atomic_admission(batches, "batch", rk.queue_depths(snapshot_view(spark, sf_dir)), registry_view(spark))


_FENCE_SQL = """select id job_id, asked_attempt, case when held is null then 'not_found' when asked_attempt <> held then 'failed_precondition' else 'ok' end outcome
from (select job_id id, 1 + (event_id % 3 = 0)::bigint asked_attempt from j) left join (select job_id, attempt held from s where state = 'inflight') on id = job_id"""


def _fenced(spark, sf_dir):
    asked = jobs_view(spark, sf_dir).select("job_id", (1 + (F.col("event_id") % 3 == 0).cast("bigint")).alias("asked_attempt"))
    return ad.lease_outcomes(asked, snapshot_view(spark, sf_dir).where("state = 'inflight'"))


@query(_snap(_FENCE_SQL))
def ack_outcomes(spark, sf_dir):
    return _fenced(spark, sf_dir).select("job_id", "asked_attempt", "outcome")


@query(_snap(f"select outcome, count(*) requests from ({_FENCE_SQL}) group by outcome"))
def stale_attempt_fencing(spark, sf_dir):
    return _fenced(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("requests"))


_CAP_SQL = """cap as (select j.*, 1 + event_id % 6 att, case when coalesce(retry_delay_ms, 0) = 0 then 0 else least(case when retry_backoff = 'exponential' then retry_delay_ms * (1 << (event_id % 6)) else retry_delay_ms end, 60000) end::bigint capped
  from j left join r on r.queue = j.queue)"""


def _capped(spark, sf_dir):
    j = va.with_limits(jobs_view(spark, sf_dir), registry_view(spark)).withColumn("attempt", 1 + F.col("event_id") % 6)
    cap = ad.retry_cap(F.col("lim_retry_delay_ms"), F.col("lim_retry_backoff"), F.col("attempt"), F.lit(3_600_000), F.lit(60_000))
    return j.withColumn("capped", cap)


@query(_jobs("select event_id, att attempt, capped, capped - capped // 4 least_delay from cap", registry_sql(), _CAP_SQL))
def retry_delay_bounds(spark, sf_dir):
    return _capped(spark, sf_dir).select("event_id", "attempt", "capped", (F.col("capped") - F.floor(F.col("capped") / 4)).cast("bigint").alias("least_delay"))


@query()
def retry_delay_jittered(spark, sf_dir):
    c = _capped(spark, sf_dir)
    return c.select("event_id", "attempt", "capped", fn.jittered(F.col("capped"), fn.jitter_hash("job_id", "attempt")).alias("delay_ms"))


@query(_jobs("""select event_id, case when event_id % 7 = 0 or att >= max_attempts then 'dead_letter' when capped > 0 then 'scheduled' else 'ready' end route,
case when event_id % 7 = 0 then 'rejected' when att >= max_attempts then 'attempts_exhausted' end cause, case when event_id % 7 = 0 or att >= max_attempts then att else att + 1 end next_attempt from cap""", registry_sql(), _CAP_SQL))
def nack_routing(spark, sf_dir):
    routed = ad.nack_route(_capped(spark, sf_dir), F.when(F.col("event_id") % 7 == 0, "dead_letter").otherwise("default"), F.col("capped"))
    return routed.select("event_id", "route", "cause", "next_attempt")


# --- sweep phases ---------------------------------------------------------------------------------


@query(_snap("select job_id, queue, case when attempt >= max_attempts then 'dead_letter' else 'ready' end route, lease_end from s where state = 'inflight' and lease_end <= 1705330800000 order by lease_end, job_id limit 100"))
def lease_expiry_sweep(spark, sf_dir):
    got = ct.due(snapshot_view(spark, sf_dir).where("state = 'inflight'"), "lease_end", T0 + 3 * HOUR, 100, "job_id")
    return got.select("job_id", "queue", F.when(F.col("attempt") >= F.col("max_attempts"), "dead_letter").otherwise("ready").alias("route"), "lease_end")


@query(_snap("select job_id, queue, enq, attempt, sched from s where state = 'scheduled' and sched <= 1705334400000 order by sched, job_id limit 100"))
def promote_due(spark, sf_dir):
    return ct.due(snapshot_view(spark, sf_dir).where("state = 'scheduled'"), "sched", T0 + 4 * HOUR, 100, "job_id").select("job_id", "queue", "enq", "attempt", "sched")


@query(_dedup("select queue, idem, max(deadline)::bigint deadline from d group by queue, idem having max(deadline) <= 1705320000000 order by deadline, queue, idem limit 200", 5 * DAY))
def dedup_expire(spark, sf_dir):
    records = ad.dedup_fold(jobs_view(spark, sf_dir), 5 * DAY).groupBy("queue", "idem").agg(F.max("deadline").alias("deadline"))
    return ct.due(records, "deadline", T0, 200, "queue", "idem")


@query(_snap("select job_id, queue, failed_at from s where state = 'dead_letter' and failed_at <= 1705000000000 order by failed_at, strlen(queue), queue, job_id limit 100"))
def retention_expire(spark, sf_dir):
    dead = rk.timer_index(snapshot_view(spark, sf_dir), "dead_letter")
    return ct.due(dead, "failed_at", 1_705_000_000_000, 100, "name_bytes", "queue", "job_id").select("job_id", "queue", "failed_at")


@query(_snap("select least((select min(sched) from s where state = 'scheduled'), (select min(lease_end) from s where state = 'inflight'), (select min(failed_at) + 86400000 from s where state = 'dead_letter')) deadline_ms"))
def next_deadline(spark, sf_dir):
    s = snapshot_view(spark, sf_dir)
    kept = s.where("state = 'dead_letter'").withColumn("retained", F.col("failed_at") + DAY)
    return ct.next_deadline((s.where("state = 'scheduled'"), "sched"), (s.where("state = 'inflight'"), "lease_end"), (kept, "retained"))


@query(_snap("""select phase, count(*) purged from (select phase from (
  select case state when 'ready' then 1 when 'scheduled' then 2 else 3 end::int phase, case state when 'ready' then 9 - least(priority, 9) when 'scheduled' then sched else failed_at end a, case state when 'ready' then enq else 0 end b, job_id c from s where queue = 'signup' and state <> 'inflight'
  union all select 4, max(deadline), 0, idem from d where queue = 'signup' group by idem) order by phase, a, b, c limit 900)
group by phase""", _DEDUP_SQL.format(w=5 * DAY).removeprefix("recursive ")).replace("with ", "with recursive ", 1))
def purge_chunk(spark, sf_dir):
    """A chunk of a queue whose leases have all ended."""
    records = ad.dedup_fold(jobs_view(spark, sf_dir), 5 * DAY).groupBy("queue", F.col("idem").alias("idempotency_key")).agg(F.max("deadline").alias("deadline_ms"))
    return ct.purge_chunk(snapshot_view(spark, sf_dir).where("state <> 'inflight'"), records, "signup", 900)


# --- metrics --------------------------------------------------------------------------------------


def _outcomes(spark, sf_dir):
    """What happened to each sample job up to T0, a row an event."""
    j = jobs_view(spark, sf_dir)
    row = lambda at, event, cause=None: F.struct(at.alias("at"), F.lit(event).alias("event"), F.lit(cause).cast("string").alias("cause"))
    acted, oc = F.col("done") < F.col("lease_end"), F.col("oc")
    rows = F.array(
        row(F.col("enq"), "enqueued"),
        F.when(F.col("sched") > F.col("enq"), row(F.col("sched"), "promotions")),
        row(F.col("reserved"), "reserved"),
        F.when((oc <= 5) & acted, row(F.col("done"), "acked")),
        F.when((oc >= 6) & acted, row(F.col("done"), "nacked")),
        F.when((oc == 8) & acted, row(F.col("done"), "dead_lettered", "rejected")),
        F.when(~acted & (F.col("max_attempts") > 1), row(F.col("lease_end"), "lease_redeliveries")),
        F.when(~acted & (F.col("max_attempts") <= 1), row(F.col("lease_end"), "dead_lettered", "lease_expired")),
    )
    return j.select("queue", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("queue", "r.*").where(F.col("at") <= T0)


_OUTCOMES_SQL = """o as (select * from (select queue, enq "at", 'enqueued' event, null cause from j union all select queue, sched, 'promotions', null from j where sched > enq union all select queue, reserved, 'reserved', null from j
union all select queue, done, 'acked', null from j where oc <= 5 and done < lease_end union all select queue, done, 'nacked', null from j where oc >= 6 and done < lease_end
union all select queue, done, 'dead_lettered', 'rejected' from j where oc = 8 and done < lease_end union all select queue, lease_end, 'lease_redeliveries', null from j where done >= lease_end and max_attempts > 1
union all select queue, lease_end, 'dead_lettered', 'lease_expired' from j where done >= lease_end and max_attempts <= 1) where "at" <= 1705320000000)"""
_COUNT = lambda names: ", ".join(f"count(*) filter (event = '{n}') {n}" for n in names)


@query(_dedup(f"select queue, {_COUNT(('enqueued', 'reserved', 'acked', 'nacked', 'deduplicated', 'promotions', 'lease_redeliveries', 'dedup_expirations'))} from e group by queue", 5 * DAY, _OUTCOMES_SQL,
"""e as (select queue, event from o union all select queue, 'deduplicated' from d join j using (event_id, queue) where deduplicated and enq <= 1705320000000
union all select queue, 'dedup_expirations' from (select distinct queue, first_id, deadline from d) where deadline <= 1705320000000)"""))
def counters_by_queue(spark, sf_dir):
    """Counters of lease outcomes, of repeats that met a record, and of records that ran out."""
    d = ad.dedup_fold(jobs_view(spark, sf_dir), 5 * DAY)
    none = F.lit(None).cast("string").alias("cause")
    at = jobs_view(spark, sf_dir).select("event_id", "enq")
    repeats = d.where("deduplicated").join(at, "event_id").where(F.col("enq") <= T0).select("queue", F.col("enq").alias("at"), F.lit("deduplicated").alias("event"), none)
    # A record begins with each first, which is the one row of its window that is no repeat.
    ended = d.where(~F.col("deduplicated") & (F.col("deadline") <= T0)).select("queue", F.col("deadline").alias("at"), F.lit("dedup_expirations").alias("event"), none)
    return ct.cycle_counters(_outcomes(spark, sf_dir).unionByName(repeats).unionByName(ended))


@query(_jobs("select queue, cause, count(*) dead_lettered from o where event = 'dead_lettered' group by queue, cause", _OUTCOMES_SQL))
def dead_lettered_by_cause(spark, sf_dir):
    return ct.dead_lettered(_outcomes(spark, sf_dir))


@query(_jobs(f"select queue, {_COUNT(('enqueued', 'reserved', 'acked', 'nacked', 'dead_lettered'))} from o where not (queue = 'view' and \"at\" <= 1704800000000) group by queue", _OUTCOMES_SQL))
def admin_totals(spark, sf_dir):
    purge = spark.createDataFrame([("view", 1_704_800_000_000)], "queue string, purged_at bigint")
    return ct.admin_totals(_outcomes(spark, sf_dir), F.broadcast(purge))


@query(_snap("select queue, last_at, coalesce(jobs, 0) jobs from (select queue, max(\"at\") last_at from o group by queue) left join (select queue q, count(*) jobs from s where queue <> 'error' group by queue) on q = queue where 1705320000000 - last_at < 60000 or coalesce(jobs, 0) > 0", _OUTCOMES_SQL))
def idle_eviction(spark, sf_dir):
    depths = rk.queue_depths(snapshot_view(spark, sf_dir).where("queue <> 'error'"))
    depths = depths.withColumn("live", F.col("ready") + F.col("scheduled") + F.col("inflight"))
    return ct.idle_eviction(_outcomes(spark, sf_dir), depths, T0, 60_000)


def _rates_sql(tick: int) -> str:
    names = ("enqueued", "acked", "nacked", "dead_lettered")
    return f"""{_OUTCOMES_SQL}, st as (select queue, ("at" // {tick}) * {tick} ts_ms, {_COUNT(names)} from o group by 1, 2),
cu as (select queue, ts_ms, {", ".join(f"sum({n}) over w {n}" for n in names)} from st window w as (partition by queue order by ts_ms rows unbounded preceding)),
rt as (select queue, ts_ms, {", ".join(f"coalesce(round(greatest({n} - lag({n}) over w, 0)::double / greatest((ts_ms - lag(ts_ms) over w) / 1000.0::double, 0.001::double), 2), 0.0)::double {n}_rate" for n in names)} from cu window w as (partition by queue order by ts_ms))"""


@query(_jobs("select * from rt", _rates_sql(HOUR)))
def rates_hourly(spark, sf_dir):
    return ct.rates(ct.samples(_outcomes(spark, sf_dir), HOUR))


@query(_jobs("select * from rt", _rates_sql(1000)))
def rates_1s(spark, sf_dir):
    return ct.rates(ct.samples(_outcomes(spark, sf_dir), 1000))


@query(_jobs("select * exclude n from (select *, row_number() over (partition by queue order by ts_ms desc) n from rt) where n <= 60", _rates_sql(HOUR)))
def rate_history_ring(spark, sf_dir):
    return ct.history_ring(rates_hourly(spark, sf_dir), 60)


@query(_jobs("select * from rt where ts_ms >= (select max(ts_ms) from rt) - 21600000", _rates_sql(HOUR)))
def spark_range(spark, sf_dir):
    return ct.trailing(rates_hourly(spark, sf_dir), 6 * HOUR)


@query(_snap("select count(distinct queue) queues, count(*) filter (state = 'ready') ready, count(*) filter (state = 'inflight') inflight, count(*) filter (state = 'dead_letter') dead_letter from s"))
def dashboard_aggregate(spark, sf_dir):
    d = rk.queue_depths(snapshot_view(spark, sf_dir))
    return d.agg(F.count(F.lit(1)).alias("queues"), *[F.sum(s).alias(s) for s in ("ready", "inflight", "dead_letter")])


@query(_snap(f"""select n.queue, coalesce(d.ready, 0) ready, coalesce(d.live, 0) live, coalesce(t.enqueued, 0) enqueued, coalesce(t.acked, 0) acked
from (select event_type queue from events union select queue from r) n left join (select queue, count(*) filter (state = 'ready') ready, count(*) filter (state <> 'dead_letter') live from s group by queue) d on d.queue = n.queue
left join (select queue, {_COUNT(("enqueued", "acked"))} from o group by queue) t on t.queue = n.queue""", _OUTCOMES_SQL, registry_sql()))
def overview(spark, sf_dir):
    names = queue_names(spark, sf_dir)
    d = rk.queue_depths(snapshot_view(spark, sf_dir)).select("queue", "ready", "live")
    t = ct.admin_totals(_outcomes(spark, sf_dir)).select("queue", "enqueued", "acked")
    joined = names.join(d, "queue", "left").join(t, "queue", "left")
    return joined.select("queue", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("ready", "live", "enqueued", "acked")])


@query(_jobs("""select ts_ms, '{"ts_ms":' || ts_ms::varchar || ',"queues":[' || string_agg('{"queue":"' || queue || '","enqueued_rate":' || enqueued_rate::varchar || ',"acked_rate":' || acked_rate::varchar
|| ',"nacked_rate":' || nacked_rate::varchar || ',"dead_lettered_rate":' || dead_lettered_rate::varchar || '}', ',' order by queue) || ']}' frame from rt group by ts_ms""", _rates_sql(HOUR)))
def stats_frames_hourly(spark, sf_dir):
    """The frames of the stats stream, a JSON text for each hour."""
    return stats_frames(rates_hourly(spark, sf_dir))


@query("select event_id, role_rank >= needed allowed from (select event_id, user_id % 3 role_rank, event_id % 3 needed from events)")
def role_checks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    role = lambda c: F.element_at(F.array(*map(F.lit, fn.ROLES)), (c % 3 + 1).cast("int"))
    return e.select("event_id", fn.role_allows(role(F.col("user_id")), role(F.col("event_id"))).alias("allowed"))


@query("""select user_id, event_type, count(*) events, min(ms) first_ms, max(ms) last_ms from (select *, sum(fresh) over (partition by user_id, event_type order by ms, event_id rows unbounded preceding) g
from (select *, case when ms - lag(ms) over (partition by user_id, event_type order by ms, event_id) < 900000 then 0 else 1 end fresh from (select *, (epoch_us(ts) // 1000) ms from events))) group by user_id, event_type, g""")
def activity_sessions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("at"))
    return ct.sessions(e.withColumn("ms", F.unix_millis("at")))


@query("""select queue, arrival, ts_ms from (select *, max(ts_ms) over (partition by queue order by arrival rows between unbounded preceding and 1 preceding) top from (select event_type queue, event_id arrival, (epoch_us(ts) // 1000) // 1000 * 1000 ts_ms from events)) where top is null or ts_ms > top""")
def frame_monotonic(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    frames = e.select(F.col("event_type").alias("queue"), F.col("event_id").alias("arrival"), (F.floor(fn.millis(F.col("ts")) / 1000) * 1000).cast("bigint").alias("ts_ms"))
    return ct.monotonic_frames(frames)


@query("select queue, count(*) empty_reserves from (select unnest([event_type, 'refund']) queue from events) group by queue")
def reserve_empty(spark, sf_dir):
    timeouts = jobs_view(spark, sf_dir).select(F.explode(F.array(F.col("queue"), F.lit("refund"))).alias("queue"))
    return timeouts.groupBy("queue").agg(F.count(F.lit(1)).alias("empty_reserves"))


@query(_jobs("select event_id // 16 batch, count(*) jobs, count(sched) scheduled, string_agg(distinct queue, ',' order by queue) queues, string_agg(distinct job_type, ',' order by job_type) job_types from j group by 1"))
def batch_distinct_dims(spark, sf_dir):
    b = jobs_view(spark, sf_dir).withColumn("batch", F.floor(F.col("event_id") / 16).cast("bigint"))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("jobs"), F.count("sched").alias("scheduled"), names("queue").alias("queues"), names("job_type").alias("job_types"))


@query("select event_type, count(*) requests, count(*) filter (value < 0) failed, quantile_disc(value, 0.5) median, quantile_disc(value, 0.99) p99 from events group by event_type")
def request_latency(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    q = lambda p: F.expr(f"percentile_disc({p}) within group (order by value)")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("value") < 0).alias("failed"), q(0.5).alias("median"), q(0.99).alias("p99"))


@query("select cast(event_id as varchar) id, sha256(props) etag from events")
def etag_sha256(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("id"), fn.etag(F.col("props")).alias("etag"))


@query(_snap("""select job_id, '{"job_id":"' || job_id || '","queue":"' || queue || '","job_type":"' || job_type || '","priority":' || priority::varchar || ',"attempt":' || attempt::varchar || ',"max_attempts":' || max_attempts::varchar
|| ',"enqueued_at_ms":' || enq::varchar || coalesce(',"scheduled_at_ms":' || sched::varchar, '') || case when state = 'inflight' then ',"lease_expires_at_ms":' || lease_end::varchar else '' end || ',"state":"' || state || '"}' json from s"""))
def job_json(spark, sf_dir):
    s = snapshot_view(spark, sf_dir)
    return s.select("job_id", fn.job_json(F.col("state")).alias("json"))


@query("select o_orderstatus queue, cast(o_orderkey as varchar) job_id, place from (select *, row_number() over (partition by o_orderstatus order by o_orderpriority, o_orderdate, cast(o_orderkey as varchar)) place from orders) where place <= 10")
def orders_topk(spark, sf_dir):
    """The priority order over another table: urgent orders first, then the oldest."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    jobs = o.select(
        F.col("o_orderstatus").alias("queue"), F.col("o_orderkey").cast("string").alias("job_id"), (10 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        fn.millis(F.col("o_orderdate")).alias("enq"), F.lit("ready").alias("state"),
    )
    return rk.reserve_top_k(jobs, 10).select("queue", "job_id", "place")


# --- commands on known state, and smaller views -----------------------------------------------------


@query(_jobs("""select event_id, least(coalesce(case when event_id % 3 = 0 then max_attempts * 60 end, l.default_max_attempts, 3), 100)::bigint max_attempts,
coalesce(b.dedup_window_ms, 86400000)::bigint dedup_window_ms, l.max_queue_depth::bigint max_queue_depth
from j left join r b on b.queue = j.queue left join (select * replace (case when queue = 'view' then 9 else max_queue_depth end as max_queue_depth) from r) l on l.queue = j.queue""", registry_sql()))
def limits_of_two_registries(spark, sf_dir):
    """Dedup windows are those at start-up; every other limit is the live one."""
    boot = registry_view(spark)
    live = boot.withColumn("max_queue_depth", F.when(F.col("queue") == "view", 9).otherwise(F.col("max_queue_depth")))
    j = va.resolved_limits(jobs_view(spark, sf_dir), boot, live, F.when(F.col("event_id") % 3 == 0, F.col("max_attempts") * 60))
    return j.select("event_id", F.col("resolved_max_attempts").alias("max_attempts"), F.col("boot_dedup_window_ms").alias("dedup_window_ms"), F.col("live_max_queue_depth").alias("max_queue_depth"))


_KEYS_SQL = "k as (select failed_at + (event_id % 5 = 0)::bigint failed_at, queue, job_id, case when event_id % 7 = 0 then 'other' else queue end asked from s where state = 'dead_letter')"


def _dead_keys(spark, sf_dir):
    """Keys of all sample dead letters: some with a wrong time, some asked of another queue."""
    dead = snapshot_view(spark, sf_dir).where("state = 'dead_letter'")
    asked = F.when(F.col("event_id") % 7 == 0, "other").otherwise(F.col("queue"))
    keys = dead.select((F.col("failed_at") + (F.col("event_id") % 5 == 0).cast("bigint")).alias("failed_at"), "queue", "job_id", asked.alias("asked"))
    return dead, keys


@query(_snap("""select k.job_id, k.asked, case when d.job_id is not null and k.asked = k.queue then 'requeued' else 'missing' end status, case when d.job_id is not null and k.asked = k.queue then 1705320000000 end::bigint enqueued_at_ms,
case when d.job_id is not null and k.asked = k.queue then 1 end::bigint attempt from k left join (select * from s where state = 'dead_letter') d on d.failed_at = k.failed_at and d.queue = k.queue and d.job_id = k.job_id""", _KEYS_SQL))
def requeue_dead_letters(spark, sf_dir):
    """A requeued job begins anew, ready now with attempt 1, whatever caps or tombstones say."""
    dead, keys = _dead_keys(spark, sf_dir)
    hit = ad.keyed_dead_letters(keys, dead, "requeued")
    ok = F.col("status") == "requeued"
    return hit.select("job_id", "asked", "status", F.when(ok, F.lit(T0)).cast("bigint").alias("enqueued_at_ms"), F.when(ok, F.lit(1)).cast("bigint").alias("attempt"))


@query(_snap("select k.asked, case when d.job_id is not null and k.asked = k.queue then 'deleted' else 'missing' end status, count(*) entries from k left join (select * from s where state = 'dead_letter') d on d.failed_at = k.failed_at and d.queue = k.queue and d.job_id = k.job_id group by 1, 2", _KEYS_SQL))
def delete_dead_letters(spark, sf_dir):
    dead, keys = _dead_keys(spark, sf_dir)
    return ad.keyed_dead_letters(keys, dead, "deleted").groupBy("asked", "status").agg(F.count(F.lit(1)).alias("entries"))


@query(_snap("select job_id, queue, attempt final_attempt, 'admin' cause from s where state in ('ready', 'scheduled')"))
def dead_letter_jobs(spark, sf_dir):
    """Jobs an operator buries: only ready and scheduled ones can be, with the attempt they stand at."""
    s = snapshot_view(spark, sf_dir).where("state in ('ready', 'scheduled')")
    return s.select("job_id", "queue", F.col("attempt").alias("final_attempt"), F.lit("admin").alias("cause"))


@query(_jobs("select event_id, reserved + 1000 + greatest(1, least(k * 1000 - 5000, coalesce(max_lease_ms, 300000)))::bigint lease_expires_at_ms from j left join r on r.queue = j.queue where done < lease_end", registry_sql()))
def extend_leases(spark, sf_dir):
    """A lease is extended from now, not from its end, so it may also become shorter."""
    j = va.with_limits(jobs_view(spark, sf_dir).where("done < lease_end"), registry_view(spark))
    lease = F.greatest(F.lit(1), F.least(F.col("k") * 1000 - 5000, F.col("lim_max_lease_ms")))
    return j.select("event_id", (F.col("reserved") + 1000 + lease).cast("bigint").alias("lease_expires_at_ms"))


@query(_jobs("select queue, count(*) filter (enq >= 1704600000000 and enq < 1704600000000 + 30000000) closing, count(*) jobs from j group by queue"))
def closing_admission(spark, sf_dir):
    """Enqueues that meet a tombstone; at its deadline the queue is open again."""
    at, grace = 1_704_600_000_000, 30_000_000
    shut = (F.col("enq") >= at) & (F.lit(at + grace) > F.col("enq"))
    return jobs_view(spark, sf_dir).groupBy("queue").agg(F.count_if(shut).alias("closing"), F.count(F.lit(1)).alias("jobs"))


_ATTEMPT_SQL = """o as (select event_id, reserved "at", 'reserved' event from j union all select event_id, done, 'nacked' from j where oc >= 6 and done < lease_end union all select event_id, lease_end, 'lapsed' from j where done >= lease_end)"""


@query(_jobs("select event_id, \"at\", event, 1 + coalesce(sum((event <> 'reserved')::int) over (partition by event_id order by \"at\", event rows between unbounded preceding and 1 preceding), 0)::bigint attempt from o", _ATTEMPT_SQL))
def attempt_numbers(spark, sf_dir):
    """The attempt each event of a job belongs to: one more after every retry and lapsed lease."""
    j = jobs_view(spark, sf_dir)
    row = lambda at, event: F.struct(F.col(at).alias("at"), F.lit(event).alias("event"))
    acted = F.col("done") < F.col("lease_end")
    rows = F.filter(F.array(row("reserved", "reserved"), F.when((F.col("oc") >= 6) & acted, row("done", "nacked")), F.when(~acted, row("lease_end", "lapsed"))), lambda r: r.isNotNull())
    return ct.attempts(j.select("event_id", F.explode(rows).alias("r")).select("event_id", "r.*"))


@query(f"with {AUDIT_SQL} select seq, actor, \"action\" from (select * from a where seq between 100 and 299 union select * from a where seq between 250 and 400) order by seq desc limit 200")
def audit_live_tail(spark, sf_dir):
    """Pages and the live tail as one list: each record once, newest first, the newest 200."""
    a = audit_view(spark, sf_dir).select("seq", "actor", "action")
    both = a.where("seq between 100 and 299").unionByName(a.where("seq between 250 and 400"))
    return both.dropDuplicates(["seq"]).orderBy(F.col("seq").desc()).limit(200)


@query(_jobs(f"""select 'jobs_' || event || '_total{{queue="' || queue || '"}} ' || n::varchar line from (select queue, event, count(*) n from o group by 1, 2)""", _OUTCOMES_SQL))
def metrics_exposition(spark, sf_dir):
    """Counters as lines of the text format that scrapers read."""
    n = _outcomes(spark, sf_dir).groupBy("queue", "event").agg(F.count(F.lit(1)).alias("n"))
    return n.select(fn.exposition(F.concat(F.lit("jobs_"), F.col("event"), F.lit("_total")), F.col("queue"), F.col("n")).alias("line"))


# --- replay ---------------------------------------------------------------------------------------


@query()
def op_replay(spark, sf_dir):
    """Outcomes of the sample op log."""
    return replay_outcomes(written(sample_ops(spark, sf_dir), "ops"))


@query()
def op_replay_state(spark, sf_dir):
    """Rows of each state table and queue that the sample op log leaves."""
    state = replay_state(written(sample_ops(spark, sf_dir), "ops"))
    return state.groupBy("tbl", "queue").agg(F.count(F.lit(1)).alias("entries"), F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"))


@query()
def op_replay_stream(spark, sf_dir):
    """The same outcomes by a stream over the log in ordered slices, four at least."""
    return replay_slices(written(sample_ops(spark, sf_dir), "ops"), shared_path(spark, "replay-stream"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
