"""Replay of an op log: outcomes of every op and the state that is left.

Queues that no op couples are folded apart. An atomic batch and a reservation
over several queues couple theirs; ops that name a job go where the job was
enqueued; open and close go by queue; every component meets each sweep, whose
count is added up afterwards. Sweeps are a few numbers each: up to ``MOST_SWEEPS``
are broadcast once as sorted arrays, of which a component applies only those at
which something of it is due; beyond, each component gets a row a sweep. A drain over all queues, or a sweep whose budget
could run out, needs the order over all queues and so one component. Audit
records only need numbers, which are ranks.

A component is one group: its ops meet in one task, as an order-dependent fold
demands. What spreads a log over a cluster is its number of components.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.fold import Fold
from ..operators.ranking import audit_numbers
from ..sources.shared import written
from ..sources.tables import OP_KINDS

OUTCOME = "seq bigint, idx int, kind string, status string, queue string, job_id string, attempt bigint, value bigint, reason string"
STATE = "tbl string, queue string, job_id string, key string, at_ms bigint, attempt bigint, priority int, max_attempts bigint, reason string, body string"
ROUTED = "component string, seq bigint, pos int, now_ms bigint, kind string, body string"
#: Distinct couplings of queues up to which components are worked out on the driver; beyond, by joins.
MOST_COUPLINGS = 100_000
#: 40 bytes each.
MOST_SWEEPS = 1_000_000
NEVER = -(2**63)
MOST_SEQ = 2**63 - 1
ALL = ""
#: Rows that Python gives back at a time.
BATCH_ROWS = 10_000
#: So that a few components seldom share a task.
LEAST_TASKS = 64

_STATE = [c.split()[0] for c in STATE.split(", ")]


def packed(ops: DataFrame, *more: Column) -> DataFrame:
    """seq, pos, now_ms, kind and the op's own struct as JSON text."""
    body = F.coalesce(*[F.when(F.col("kind") == k, F.to_json(k)) for k in OP_KINDS])
    return ops.select("seq", F.lit(0).alias("pos"), F.coalesce("now_ms", F.lit(0)).alias("now_ms"), "kind", body.alias("body"), *more)


def op_from(seq, now_ms, kind, body) -> dict:
    return {"seq": seq, "now_ms": now_ms, "kind": kind, "body": json.loads(body) if body else {}}


def outcome_rows(op: dict, found: list[dict]) -> Iterator[tuple]:
    """Rows of OUTCOME."""
    seq, kind, places = op["seq"], op["kind"], op["body"].get("places")  # of a part of a batch within the whole
    for i, o in enumerate(found):
        if kind == "sweep":  # what a sweep moves has no order over components: 0 is the sweep, 1 all that it moved
            idx = min(i, 1)
        else:
            idx = o.get("idx", places[i] if places else i)
        yield seq, idx, kind, o["status"], o.get("queue"), o.get("job_id"), o.get("attempt"), o.get("value"), o.get("reason")


def record_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as they come, so many at a time."""
    while some := list(itertools.islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))])


def _folder(shared, state: bool):
    """A component's ops, in order, to its outcomes, or to the state they leave; only that state is held."""
    names = ["table", *_STATE[1:]]

    def outcomes(fold: Fold, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, last = 0, -1
        seqs, nows, cutoffs, bodies = shared.value if shared is not None else [np.zeros(0, np.int64)] * 4
        marks = [*seqs.tolist(), MOST_SEQ]

        def swept(end: int) -> Iterator[tuple]:
            """Apply the sweeps before one of them, or all: those at which nothing is due do nothing."""
            nonlocal at
            while at < end:
                due, dead, stop = fold.earliest(), fold.oldest_dead(), min(end, at + 1024)
                hit = np.zeros(stop - at, bool)
                if due is not None:
                    hit |= nows[at:stop] >= due
                if dead is not None:
                    hit |= cutoffs[at:stop] >= dead
                k = int(np.argmax(hit))
                if not hit[k]:
                    at = end if due is None and dead is None else stop
                    continue
                budget, enabled = bodies[at + k].tolist()
                cutoff = int(cutoffs[at + k])
                body = {"budget": budget, "retention_cutoff_ms": None if cutoff == NEVER else cutoff, "dead_letter_enabled": bool(enabled)}
                op = {"seq": int(seqs[at + k]), "now_ms": int(nows[at + k]), "kind": "sweep", "body": body}
                yield from outcome_rows(op, fold.apply(op))
                at += k + 1

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("seq", "now_ms", "kind", "body"))):
                op = op_from(*row)
                if op["seq"] < last:
                    raise RuntimeError("ops of a component are out of order")
                last = op["seq"]
                if marks[at] < last:
                    yield from swept(int(np.searchsorted(seqs, last)))
                yield from outcome_rows(op, fold.apply(op))
        yield from swept(len(seqs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold()
        rows = outcomes(fold, batches)
        if not state:
            yield from record_batches(rows, _arrow(OUTCOME))
            return
        for _ in rows:
            pass
        yield from record_batches((tuple(r.get(n) for n in names) for r in fold.rows()), _arrow(STATE))

    return run


def _folded(routed: DataFrame, sweeps: tuple | None, state: bool = False) -> DataFrame:
    """Each component's rows reach Python in order and a batch at a time, so a task holds no component's log."""
    spark = routed.sparkSession
    shared = spark.sparkContext.broadcast(sweeps) if sweeps is not None else None
    # A number given by hand: small components are not put into one task again.
    tasks = max(LEAST_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = routed.repartition(tasks, "component").sortWithinPartitions("component", "seq", "pos")
    return ordered.groupBy("component").applyInArrow(_folder(shared, state), STATE if state else OUTCOME)


def _sweeps(ops: DataFrame) -> tuple | None:
    """(numbers, times, cutoffs, budget and dead-letter switch) of all sweeps in order; None if they are too many to broadcast."""
    own = ops.where("kind = 'sweep'")
    if own.count() > MOST_SWEEPS:
        return None
    found = own.select(
        "seq", F.coalesce("now_ms", F.lit(0)).alias("now"), F.coalesce("sweep.retention_cutoff_ms", F.lit(NEVER)).alias("cutoff"), F.coalesce("sweep.budget", F.lit(0)).alias("budget"),
        F.coalesce("sweep.dead_letter_enabled", F.lit(False)).cast("bigint").alias("enabled"),
    ).toArrow().sort_by("seq")
    column = lambda c: np.asarray(found.column(c).combine_chunks()).astype(np.int64)
    return column("seq"), column("now"), column("cutoff"), np.stack([column("budget"), column("enabled")], axis=1)


def _couplings(ops: DataFrame) -> DataFrame:
    """(a, b) of queues that one op names together, each with the op's first."""
    batch = ops.where("kind = 'enqueue_atomic'").select(F.transform("enqueue_atomic.jobs", lambda j: j["request"]["queue"]).alias("q"))
    reserve = ops.where("kind = 'reserve'").select(F.col("reserve.queues").alias("q"))
    # An ordinary batch is folded job by job, so it couples nothing; its outcomes keep their places.
    several = batch.unionByName(reserve).where(F.size(F.array_distinct("q")) > 1)
    return several.select(F.get("q", F.lit(0)).alias("a"), F.explode("q").alias("b")).where("a <> b").distinct()


def _labelled(couplings: DataFrame) -> DataFrame:
    """(q, c): the least queue that each coupled queue reaches, by rounds that also jump to the label's own label."""
    edges = written(couplings.unionByName(couplings.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "couplings")
    labels = written(edges.select(F.col("a").alias("q"), F.col("a").alias("c")).distinct(), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("q")).groupBy(F.col("a").alias("n")).agg(F.min("c").alias("m"))
        less = labels.join(near, F.col("q") == F.col("n")).select("q", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = less.select(F.col("q").alias("j"), F.col("c").alias("jc"))
        after = written(less.join(jump, F.col("c") == F.col("j"), "left").select("q", "old", F.least("c", F.coalesce("jc", "c")).alias("c")), "labels")
        labels = after.drop("old")
        if after.where("old <> c").isEmpty():
            return labels


def components(ops: DataFrame) -> dict[str, str] | DataFrame | None:
    """Queue -> component for coupled queues, as a table (q, c) if they are many; None if all queues are one component."""
    drains = F.count_if((F.col("kind") == "drain_dead_letters") & F.col("drain_dead_letters.queue").isNull())
    jobs = F.when(F.col("kind") == "enqueue", F.size("enqueue.jobs")).when(F.col("kind") == "enqueue_atomic", F.size("enqueue_atomic.jobs")).otherwise(0)
    reserved = F.when(F.col("kind") == "reserve", F.col("reserve.max_jobs")).otherwise(0)
    most, least, wide = ops.agg(F.greatest(F.sum(jobs), F.sum(reserved)), F.min(F.when(F.col("kind") == "sweep", F.col("sweep.budget"))), drains).first()
    # Any phase can have at most as many timers as jobs were enqueued or reserved.
    if wide or (least is not None and least < (most or 0)):
        return None
    couplings = _couplings(ops)
    if couplings.limit(MOST_COUPLINGS + 1).count() > MOST_COUPLINGS:
        return _labelled(couplings)
    pairs = couplings.collect()
    root: dict[str, str] = {}

    def find(x: str) -> str:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {q: find(q) for q in root}


def _routed(ops: DataFrame, apart: bool = True) -> tuple[DataFrame, tuple | None]:
    """(packed ops, one row for each component that needs to see them, with the component; sweeps that are not among them, if they may be apart)."""
    one = components(ops)
    if one is None:
        return packed(ops.where("kind <> 'audit_append'")).withColumn("component", F.lit(ALL)), None
    spark = ops.sparkSession
    table = F.broadcast(spark.createDataFrame(list(one.items()) or [("", "")], "q string, c string")) if isinstance(one, dict) else one
    homed = lambda df: df.join(table, df["queue"] == table["q"], "left").withColumn("component", F.concat(F.lit("q:"), F.coalesce("c", "queue"))).drop("q", "c")
    # Jobs of an ordinary batch may go to several components, and are folded one by one: each is a row with its place.
    parts = ops.where("kind = 'enqueue'").select("seq", F.coalesce("now_ms", F.lit(0)).alias("now_ms"), F.posexplode("enqueue.jobs").alias("pos", "job"))
    body = F.concat(F.lit('{"jobs":['), F.to_json("job"), F.lit('],"places":['), F.col("pos").cast("string"), F.lit("]}"))
    enqueues = homed(parts.select("seq", "pos", "now_ms", F.lit("enqueue").alias("kind"), body.alias("body"), F.col("job.request.queue").alias("queue"))).drop("queue")
    named = F.coalesce(
        F.when(F.col("kind") == "enqueue_atomic", F.get(F.col("enqueue_atomic.jobs"), F.lit(0))["request"]["queue"]),
        F.when(F.col("kind") == "reserve", F.get(F.col("reserve.queues"), F.lit(0))),
        *[F.when(F.col("kind") == k, F.col(f"{k}.queue")) for k in ("drain_dead_letters", "close_queue", "open_queue", "requeue_dead_letters", "dead_letter_jobs", "delete_dead_letters", "purge_queue_chunk")],
    )
    alone = ops.where("kind not in ('enqueue', 'sweep', 'audit_append', 'ack', 'nack', 'extend')")
    by_queue = homed(packed(alone, named.alias("queue"))).drop("queue")
    born = ops.where("kind in ('enqueue', 'enqueue_atomic')").select(F.explode(F.coalesce("enqueue.jobs", "enqueue_atomic.jobs")).alias("j"))
    born = born.select(F.col("j.job_id").alias("born_id"), F.col("j.request.queue").alias("queue")).dropDuplicates(["born_id"])
    leases = packed(ops.where("kind in ('ack', 'nack', 'extend')"), F.coalesce("ack.job_id", "nack.job_id", "extend.job_id").alias("asked_id"))
    by_job = leases.join(born, F.col("asked_id") == F.col("born_id"), "left").withColumn("queue", F.coalesce("queue", F.lit("")))
    by_job = homed(by_job).drop("asked_id", "born_id", "queue")
    single = by_queue.unionByName(by_job).unionByName(enqueues)
    sweeps = _sweeps(ops) if apart else None
    if sweeps is not None:
        return single, sweeps
    # Dealt by component over a join that names no key but one: rows of sweeps are the large side.
    every = single.select("component").distinct().withColumn("one", F.lit(1))
    each = packed(ops.where("kind = 'sweep'")).withColumn("one", F.lit(1)).join(every, "one").drop("one")
    return single.unionByName(each), None


def _restored(outcomes: DataFrame, ops: DataFrame) -> DataFrame:
    """Sweeps of several components as one: counts added, the jobs they moved listed after it in order."""
    swept = outcomes.where("kind = 'sweep'")
    every = ops.where("kind = 'sweep'").select("seq", F.lit(0).cast("bigint").alias("value"))
    total = swept.where("status = 'swept'").select("seq", "value").unionByName(every).groupBy("seq").agg(F.sum("value").alias("value"))
    head = total.select("seq", F.lit(0).alias("idx"), F.lit("sweep").alias("kind"), F.lit("swept").alias("status"), *[F.lit(None).cast(t).alias(n) for n, t in (("queue", "string"), ("job_id", "string"), ("attempt", "bigint"))], "value", F.lit(None).cast("string").alias("reason"))
    moved = swept.where("status <> 'swept'")
    return outcomes.where("kind <> 'sweep'").unionByName(head).unionByName(moved)


def replay(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, state) of an op log; state rows are tagged with their table."""
    routed = _routed(ops)
    return _outcomes(ops, *routed), _state(ops, *routed)


def replay_outcomes(ops: DataFrame) -> DataFrame:
    return _outcomes(ops, *_routed(ops))


def replay_state(ops: DataFrame) -> DataFrame:
    return _state(ops, *_routed(ops))


def routed_log(ops: DataFrame) -> DataFrame:
    """The log as a stream by component takes it: ops and sweeps as rows of each component that meets them."""
    return _routed(ops, apart=False)[0].select(*[c.split()[0] for c in ROUTED.split(", ")])


def restored(outcomes: DataFrame, ops: DataFrame) -> DataFrame:
    """Outcomes of all components of a log, its sweeps whole and its audit records among them."""
    return with_audits(_restored(outcomes, ops), ops)


def _numbered(ops: DataFrame) -> DataFrame:
    return audit_numbers(ops.where("kind = 'audit_append'").select(F.col("seq").alias("op_seq"), "now_ms", "audit_append"), "op_seq")


def _outcomes(ops: DataFrame, routed: DataFrame, sweeps: tuple | None) -> DataFrame:
    # Written, as they are read for each of the parts below.
    return restored(written(_folded(routed, sweeps), "outcomes"), ops)


def with_audits(outcomes: DataFrame, ops: DataFrame) -> DataFrame:
    """Outcomes with those of the audit records, which only need numbers."""
    audits = _numbered(ops).select(
        F.col("op_seq").alias("seq"), F.lit(0).alias("idx"), F.lit("audit_append").alias("kind"), F.lit("appended").alias("status"),
        *[F.lit(None).cast(t).alias(n) for n, t in (("queue", "string"), ("job_id", "string"), ("attempt", "bigint"))],
        F.col("seq").alias("value"), F.lit(None).cast("string").alias("reason"),
    )
    return outcomes.unionByName(audits)


def _state(ops: DataFrame, routed: DataFrame, sweeps: tuple | None) -> DataFrame:
    records = _numbered(ops).select(
        F.lit("audit").alias("tbl"), F.lit(None).cast("string").alias("queue"), F.lit(None).cast("string").alias("job_id"), F.col("audit_append.actor").alias("key"),
        F.col("now_ms").alias("at_ms"), F.col("seq").alias("attempt"), F.lit(None).cast("int").alias("priority"), F.lit(None).cast("bigint").alias("max_attempts"),
        F.col("audit_append.action").alias("reason"), F.to_json("audit_append").alias("body"),
    )
    return _folded(routed, sweeps, state=True).unionByName(records)


def state_table(state: DataFrame, name: str) -> DataFrame:
    return state.where(F.col("tbl") == name).drop("tbl")
