"""Queries of the admin surface: request checks, details, JSON records, counters and totals beside the catalog's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import admission as ad, counters as ct, ranking as rk, validation as va
from ..sources.tables import T0, jobs_view, registry_sql, registry_view, snapshot_view
from .catalog import (
    _DEDUP_SQL, _FENCE_SQL, _RANK_SQL, _REQUESTS_SQL, DAY, HOUR, _classified, _fenced, _jobs, _rates_sql, _requests, _snap, admission_no_dequeue, oracle_sql as _catalog_sql, rates_hourly,
)
from .register import Query, register_into

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
query = register_into(_QUERIES, _SQL)


@query("""select batch, jobs, case when jobs > 256 then 'batch exceeds max_enqueue_batch (256)' end message from (select user_id % 40 batch, count(*) jobs from events group by 1)
union all select -1, 0, 'batch must contain at least one job'""")
def batch_checks(spark, sf_dir):
    """Batches of many sizes, and one of none, against the bound of a batch."""
    sizes = jobs_view(spark, sf_dir).groupBy((F.col("user_id") % 40).cast("bigint").alias("batch")).agg(F.count(F.lit(1)).alias("jobs"))
    none = spark.range(1).select(F.lit(-1).cast("bigint").alias("batch"), F.lit(0).cast("bigint").alias("jobs"))
    return sizes.unionByName(none).select("batch", "jobs", va.batch_message(F.col("jobs")).alias("message"))


@query(_jobs("""select event_id, case when event_id % 7 = 0 then 'reserve exceeds max_reserve_queues (32)' when event_id % 11 = 0 then 'queue name "' || repeat('q', 600) || '" exceeds max_queue_name_bytes (512)'
when len(u) > 0 then 'queue(s) not declared (strict mode): [' || array_to_string(list_transform(u, lambda x: '"' || x || '"'), ', ') || ']' end message
from (select event_id, list_filter([queue, 'refund', 'other' || (k % 3)::varchar], lambda x: not list_contains(ql, x) and x <> 'other0') u from j, (select list(queue) ql from r))""", registry_sql()))
def reserve_queue_checks(spark, sf_dir):
    """Reservations over too many, too long named or undeclared queues, in strict mode."""
    declared = F.array(*[F.lit(r["queue"]) for r in registry_view(spark).select("queue").collect()])  # configuration, not data
    other = F.concat(F.lit("other"), (F.col("k") % 3).cast("string"))
    queues = F.filter(F.array(F.col("queue"), F.lit("refund"), other), lambda q: q != "other0")
    queues = F.when(F.col("event_id") % 7 == 0, F.array_repeat(F.col("queue"), 33)).when(F.col("event_id") % 11 == 0, F.array(F.col("queue"), F.repeat(F.lit("q"), 600))).otherwise(queues)
    return jobs_view(spark, sf_dir).select("event_id", va.reserve_queues_message(queues, declared, True).alias("message"))


@query(_jobs("""select event_id, case reason
when 'invalid_request' then case when queue in ('', '.', '..') or contains(queue, '/') then 'queue name is empty, a dot name, or holds a slash or control character' when job_type = '' then 'job_type must not be empty'
  when payload is not null and strlen(payload) = 0 then 'payload must not be empty' when payload is not null and coalesce(encoding, '') = '' then 'payload needs an encoding'
  when idempotency_key = '' then 'idempotency_key must not be empty' when priority > 9 then 'priority must be 0 to 9' else 'max_attempts must be at least 1' end
when 'unknown_queue' then 'queue "' || queue || '" is not declared (strict mode)' when 'queue_name_too_long' then 'queue name is ' || actual::varchar || ' bytes; the limit is 512'
when 'job_type_name_too_long' then 'job_type is ' || actual::varchar || ' bytes; the limit is 256' when 'job_type_not_allowed' then 'job_type "' || job_type || '" is not allowed; allowed: ["u1", "u2", "u3"]'
when 'idempotency_key_too_long' then 'idempotency_key is ' || actual::varchar || ' bytes; the limit is 256' when 'payload_too_large' then 'payload is ' || actual::varchar || ' bytes; the limit is ' || "limit"::varchar
when 'encoding_not_allowed' then 'encoding "' || coalesce(encoding, '') || '" is not allowed; allowed: ' || case queue when 'purchase' then '["en", "de"]' else '[]' end
when 'custom_entries_too_many' then 'custom map has ' || actual::varchar || ' entries; the limit is 64' when 'custom_key_too_long' then 'custom key "' || repeat('k', 300) || '" is 300 bytes; the limit is 256'
when 'custom_map_too_large' then 'custom map is ' || actual::varchar || ' bytes; the limit is 16384' when 'scheduled_too_far' then 'scheduled_at exceeds the schedule horizon' end detail from q where reason is not null""", registry_sql(), _REQUESTS_SQL.format(strict="true")))
def rejection_details(spark, sf_dir):
    """The sentence a client is told for each refused request."""
    return _classified(spark, sf_dir, True).where("reason is not null").select("event_id", va.rejection_detail().alias("detail"))


_DEAD_JSON = """'{"id":"' || job_id || '","key_b64":"' || key || '","job_type":"' || job_type || '","priority":' || priority::varchar || ',"attempt":' || attempt::varchar || ',"max_attempts":' || max_attempts::varchar
|| ',"enqueued_at_ms":' || enq::varchar || ',"failed_at_ms":' || failed_at::varchar || ',"cause":"' || cause || '"' || coalesce(',"scheduled_at_ms":' || sched::varchar, '') || '}'"""
_DEAD_KEY = "dk as (select *, base64(unhex(lpad(hex(failed_at), 16, '0') || lpad(hex(strlen(queue)), 4, '0')) || encode(queue) || encode(job_id)) key from s where state = 'dead_letter')"


def _dead_json(spark, sf_dir):
    dead = snapshot_view(spark, sf_dir).where("state = 'dead_letter'")
    key = fn.base64_text(fn.dead_letter_key(F.col("failed_at"), F.col("queue"), F.col("job_id")))
    return dead.select("job_id", "queue", key.alias("key_b64"), fn.dead_letter_json(key).alias("json"))


@query(_snap(f"select job_id, {_DEAD_JSON} json from dk", _DEAD_KEY))
def dead_letter_records(spark, sf_dir):
    """Dead letters as JSON, each with the key that commands name it by."""
    return _dead_json(spark, sf_dir).select("job_id", "json")


@query(_snap(f"select dk.key asked_key, case when event_id % 5 = 0 then null else {_DEAD_JSON} end json from dk", _DEAD_KEY))
def dead_letter_by_key(spark, sf_dir):
    """Records asked for by key and queue; a key of another queue is not found."""
    have = _dead_json(spark, sf_dir)
    dead = snapshot_view(spark, sf_dir).where("state = 'dead_letter'")
    asked = dead.select(
        fn.base64_text(fn.dead_letter_key(F.col("failed_at"), F.col("queue"), F.col("job_id"))).alias("asked_key"), F.when(F.col("event_id") % 5 == 0, "other").otherwise(F.col("queue")).alias("asked_queue")
    )
    found = asked.join(have, (F.col("asked_key") == F.col("key_b64")) & (F.col("asked_queue") == F.col("queue")), "left")
    return found.select("asked_key", "json")


@query(_snap("""select job_id, '{"job_id":"' || job_id || '","queue":"' || queue || '","job_type":"' || job_type || '","priority":' || priority::varchar || ',"attempt":' || attempt::varchar || ',"max_attempts":' || max_attempts::varchar
|| ',"enqueued_at_ms":' || enq::varchar || coalesce(',"scheduled_at_ms":' || sched::varchar, '') || ',"state":"ready"}' json,
case when total > 25 then (select base64(encode((9 - least(priority, 9))::varchar || '/' || enq::varchar || '/' || job_id)) from f where queue = 'click' and place = 25) end next_cursor
from (select *, count(*) over () total from f where queue = 'click') where place <= 25""", _RANK_SQL))
def ready_jobs_json(spark, sf_dir):
    """The first page of a queue's ready jobs as JSON, with the encoded cursor to go on from."""
    page = rk.ready_page(snapshot_view(spark, sf_dir), "click", None, 25)
    return page.select("job_id", fn.job_json(F.lit("ready")).alias("json"), fn.cursor_encode(F.col("next_cursor")).alias("next_cursor"))


@query(_snap("""select least((select min(sched) from s where state = 'scheduled'), (select min(lease_end) from s where state = 'inflight'), (select min(failed_at) + 8640000000 from s where state = 'dead_letter'),
(select min(deadline) from d where deadline > 1705320000000), (select max(enq) + 30000 from s where queue = 'view')) deadline_ms""", _DEDUP_SQL.format(w=5 * DAY).removeprefix("recursive ")).replace("with ", "with recursive ", 1))
def next_deadline_of_all(spark, sf_dir):
    """The earliest of all timers: schedules, leases, dedup records, a tombstone, and dead letters with their retention."""
    s = snapshot_view(spark, sf_dir)
    kept = s.where("state = 'dead_letter'").withColumn("kept", F.col("failed_at") + 100 * DAY)
    records = ad.dedup_fold(jobs_view(spark, sf_dir), 5 * DAY).where(F.col("deadline") > T0)
    closing = s.where("queue = 'view'").agg((F.max("enq") + 30_000).alias("until"))
    return ct.next_deadline((s.where("state = 'scheduled'"), "sched"), (s.where("state = 'inflight'"), "lease_end"), (kept, "kept"), (records, "deadline"), (closing, "until"))


@query(_snap("select count(*) filter (failed_at <= 1704800000000) dead_letters_expired, count(*) filter (failed_at > 1704800000000 and queue = 'purchase') dead_letters_drained from s where state = 'dead_letter'"))
def global_counters(spark, sf_dir):
    """Dead letters that ran out, and those that a drain of one queue took of the rest."""
    dead = snapshot_view(spark, sf_dir).where("state = 'dead_letter'")
    old = F.col("failed_at") <= 1_704_800_000_000
    return dead.agg(F.count_if(old).alias("dead_letters_expired"), F.count_if(~old & (F.col("queue") == "purchase")).alias("dead_letters_drained"))


@query("with a as (" + _catalog_sql()["admission_no_dequeue"] + """) select event_id // 16 batch, count(*) filter (status = 'accepted') accepted, count(*) filter (status = 'queue_full') rejected, count(*) filter (status = 'deduplicated') deduplicated from a group by 1""")
def batch_outcomes(spark, sf_dir):
    """What became of the jobs of each batch."""
    a = admission_no_dequeue(spark, sf_dir)
    count = lambda status, name: F.count_if(F.col("status") == status).alias(name)
    return a.groupBy(F.floor(F.col("event_id") / 16).cast("bigint").alias("batch")).agg(count("accepted", "accepted"), count("queue_full", "rejected"), count("deduplicated", "deduplicated"))


@query(_snap(f"""select case when asked_attempt = 1 then 'Ack' else 'Nack' end "method", case when outcome = 'ok' then 'ok' else 'error' end outcome, len(list_filter([5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000], lambda x: x < ms))::bigint bucket, count(*) requests
from (select *, cast(job_id as bigint) * 37 % 12000 ms from ({_FENCE_SQL})) group by 1, 2, 3"""))
def request_histogram(spark, sf_dir):
    """Requests by method and outcome, and by the bucket of the milliseconds they took."""
    ms = F.col("job_id").cast("bigint") * 37 % 12000
    return ct.request_histogram(_fenced(spark, sf_dir).select(F.when(F.col("asked_attempt") == 1, "Ack").otherwise("Nack").alias("method"), (F.col("outcome") == "ok").alias("ok"), ms.alias("ms")))


@query(_snap("select j.event_id, case when s.queue is null then 0 else least(greatest(j.k * 600000 - 6000000, 0), 30000000) end::bigint delay_ms from j left join s on s.job_id = j.job_id and s.state = 'inflight'"))
def explicit_retry_delays(spark, sf_dir):
    """Delays that nacks ask for, within the schedule horizon; none for a job that is not in flight."""
    held = snapshot_view(spark, sf_dir).where("state = 'inflight'").select("job_id", F.col("queue").alias("held"))
    j = jobs_view(spark, sf_dir).join(held, "job_id", "left")
    return j.select("event_id", ad.explicit_delay(F.col("k") * 600_000 - 6_000_000, F.col("held"), F.lit(30_000_000)).alias("delay_ms"))


@query("select unnest(['max_custom_bytes', 'max_custom_entries', 'max_custom_key_bytes', 'max_enqueue_batch', 'max_idempotency_key_bytes', 'max_job_type_bytes', 'max_lease_ms', 'max_payload_bytes', 'max_queue_name_bytes', 'max_reserve_batch', 'max_reserve_queues', 'max_wait_ms', 'schedule_horizon_ms']) setting, unnest([16384, 64, 256, 256, 256, 256, 300000, 1048576, 512, 256, 32, 300000, 2592000000])::bigint advertised")
def server_info(spark, sf_dir):
    """The limits told to clients: those of a queue that nothing is declared for."""
    names = sorted(n for n in va.DEFAULTS if n.startswith("max_") and n != "max_attempts_ceiling" or n == "schedule_horizon_ms")
    unscoped = va.with_limits(spark.range(1).select(F.lit("").alias("queue")), registry_view(spark))
    pairs = F.array(*[F.struct(F.lit(n).alias("setting"), F.col(f"lim_{n}").cast("bigint").alias("advertised")) for n in names])
    return unscoped.select(F.explode(pairs).alias("p")).select("p.*")


@query(_jobs("""select event_id, case when event_id % 151 = 0 then '{' || array_to_string(list_transform(list_sort(list_transform(range(1, 66), lambda i: '"k' || i::varchar || '"')), lambda x: x || ':1'), ',') || '}'
else '{"f":true,"' || case when event_id % 53 = 0 then repeat('k', 300) else 'key' end || '":"' || repeat('v', k * 400) || '","n":1}' end json_text from q where entries is not null and k <= 3""", registry_sql(), _REQUESTS_SQL.format(strict="false")))
def custom_maps_json(spark, sf_dir):
    """Custom maps of typed values as JSON, keys in byte order."""
    r = _requests(spark, sf_dir).join(jobs_view(spark, sf_dir).select("event_id", "k"), "event_id").where("custom is not null and k <= 3")
    return r.select("event_id", fn.custom_json(F.col("custom")).alias("json_text"))


@query(_snap("""select count(*)::bigint queues, sum(ready)::bigint ready, sum(scheduled)::bigint scheduled, sum(inflight)::bigint inflight, sum(dead_letter)::bigint dead_letter, sum(en)::bigint enqueued_centi, sum(ac)::bigint acked_centi
from (select queue, count(*) filter (state = 'ready') ready, count(*) filter (state = 'scheduled') scheduled, count(*) filter (state = 'inflight') inflight, count(*) filter (state = 'dead_letter') dead_letter from s group by queue) d
left join (select queue q, round(arg_max(enqueued_rate, ts_ms) * 100)::bigint en, round(arg_max(acked_rate, ts_ms) * 100)::bigint ac from rt group by queue) on q = queue having count(*) > 0""", _rates_sql(HOUR)))
def dashboard_rates(spark, sf_dir):
    """Depths and latest rates, in hundredths a second, over all queues; no row without queues."""
    d = rk.queue_depths(snapshot_view(spark, sf_dir))
    newest = rates_hourly(spark, sf_dir).groupBy(F.col("queue").alias("q")).agg(*[F.round(F.max_by(f"{n}_rate", "ts_ms") * 100).cast("bigint").alias(n) for n in ("enqueued", "acked")])
    both = d.join(newest, F.col("queue") == F.col("q"), "left")
    total = both.agg(F.count(F.lit(1)).alias("queues"), *[F.sum(s).alias(s) for s in rk.STATES], F.sum("enqueued").alias("enqueued_centi"), F.sum("acked").alias("acked_centi"))
    return total.where("queues > 0")


@query(_snap("""select queue, case when count(*) filter (state = 'inflight') > 0 then 'failed_precondition' else 'purged' end status, case when count(*) filter (state = 'inflight') > 0 then 0 else least(count(*), 50) end::bigint purged,
count(*) filter (state = 'inflight') = 0 and count(*) > 50 remaining from (select * replace (case when event_id % 2 = 0 then queue else queue || '-odd' end as queue) from s where state <> 'inflight' or event_id % 2 = 0) group by queue"""))
def purge_status(spark, sf_dir):
    """Which queues a purge may begin on, how much its first chunk takes, and whether more remains."""
    s = snapshot_view(spark, sf_dir).where("state <> 'inflight' or event_id % 2 = 0")
    own = s.withColumn("queue", F.when(F.col("event_id") % 2 == 0, F.col("queue")).otherwise(F.concat("queue", F.lit("-odd"))))
    return ct.purge_status(own, 50)


@query(_jobs("select strategy, count(*) nacks from (select case when event_id % 3 = 0 then 'delay' when event_id % 7 = 0 then 'dead_letter' else 'default' end strategy from j) group by strategy"))
def nack_strategies(spark, sf_dir):
    """Nacks by the label of what they ask for."""
    e = F.col("event_id")
    label = ad.strategy_label(F.when(e % 3 == 0, e), (e % 3 != 0) & (e % 7 == 0))
    return jobs_view(spark, sf_dir).groupBy(label.alias("strategy")).agg(F.count(F.lit(1)).alias("nacks"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
