"""Every query with SQL gives the same rows as the SQL."""

import pytest
from helpers import same_rows

from flowloom.plans import admin, catalog

QUERIES, SQL = catalog.queries() | admin.queries(), catalog.oracle_sql() | admin.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    same_rows(QUERIES[name](spark, sf_dir), duck.sql(SQL[name]))


def test_names_agree():
    assert set(SQL) <= set(QUERIES) and not set(catalog.queries()) & set(admin.queries())


def test_the_snapshot_fills_every_state(spark, sf_dir):
    rows = QUERIES["depths_by_state"](spark, sf_dir).collect()
    assert {r["state"] for r in rows} == {"ready", "scheduled", "inflight", "dead_letter"}
    outcomes = {r["outcome"] for r in QUERIES["stale_attempt_fencing"](spark, sf_dir).collect()}
    assert outcomes == {"ok", "failed_precondition", "not_found"}


def test_admission_equals_the_fold(spark, sf_dir):
    """The plan without a state machine against the state machine, with caps that many repeats meet."""
    from pyspark.sql import functions as F

    from flowloom.operators import admission as ad
    from flowloom.operators.fold import Fold
    from flowloom.sources.tables import jobs_view

    jobs = jobs_view(spark, sf_dir).withColumn("idem", F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 23).cast("string")))
    caps = spark.createDataFrame([("click", 20), ("view", 0), ("error", 55), ("signup", None)], "queue string, max_queue_depth bigint")
    window, cap = 86_400_000, {r["queue"]: r["max_queue_depth"] for r in caps.collect()}
    fold, want = Fold(), {}
    for r in jobs.orderBy("enq", "event_id").select("event_id", "queue", "idem", "enq").collect():
        job = {"job_id": str(r["event_id"]), "request": {"queue": r["queue"], "idempotency_key": r["idem"]}, "limits": {"dedup_window_ms": window, "max_queue_depth": cap.get(r["queue"])}}
        want[r["event_id"]] = fold.apply({"kind": "enqueue", "now_ms": r["enq"], "body": {"jobs": [job]}})[0]["status"].replace("enqueued", "accepted")
    got = {r["event_id"]: r["status"] for r in ad.admit(jobs, caps, window).select("event_id", "status").collect()}
    assert got == want and set(want.values()) == {"accepted", "deduplicated", "queue_full"}


def test_queries_leave_the_session_as_it_was(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        a = QUERIES["rates_hourly"](spark, sf_dir)
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
        there = sorted(map(str, a.collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert there == sorted(map(str, QUERIES["rates_hourly"](spark, sf_dir).collect()))


def test_filters_and_columns_reach_the_scan(spark, sf_dir, capsys):
    from flowloom.sources.tables import payload_view

    payload_view(spark, sf_dir).select("job_id").where("job_id = '5'").explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<doc_id:bigint>" in plan and "PushedFilters: [IsNotNull(doc_id)" in plan


def test_entry_imports_and_names(spark):
    import __spark_entry__ as e

    assert {"queue_depths", "op_replay"} <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
