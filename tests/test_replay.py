"""Replay on Spark equals the fold, whole or by component, in batch and as a stream."""

import json

import pytest
from test_fold import random_ops

from flowloom.operators.fold import Fold
from flowloom.plans.replay import components, replay
from flowloom.sources.sample_ops import sample_ops
from flowloom.sources.tables import OP_KINDS, OPS, read_ops, write_ops
from flowloom.streaming.replay_stream import run_replay


def frame_of(spark, ops):
    rows = [json.dumps({"seq": o["seq"], "cycle_id": o["seq"], "now_ms": o["now_ms"], "kind": o["kind"], o["kind"]: o["body"]}) for o in ops]
    df = spark.read.schema(OPS).json(spark.sparkContext.parallelize(rows, 2))
    return df


def expected(ops):
    fold, out = Fold(), []
    for op in ops:
        found = fold.apply(op)
        for i, o in enumerate(found):
            idx = min(i, 1) if op["kind"] == "sweep" else o.get("idx", i)
            out.append((op["seq"], idx, o["status"], o.get("queue"), o.get("job_id"), o.get("attempt"), o.get("value")))
    return sorted(map(repr, out)), fold


def got(outcomes):
    return sorted(repr(tuple(r)) for r in outcomes.select("seq", "idx", "status", "queue", "job_id", "attempt", "value").collect())


@pytest.mark.parametrize("seed,few", [(1, False), (2, True)])
def test_batch_equals_fold(spark, seed, few):
    ops = random_ops(seed, 200)
    for op in ops:
        if op["kind"] == "reserve" and few:  # no coupling but by batches
            op["body"]["queues"] = op["body"]["queues"][:1]
        if op["kind"] == "enqueue_atomic" and few:
            for p in op["body"]["jobs"]:
                p["request"]["queue"] = "alpha"
    df = frame_of(spark, ops).cache()
    assert (components(df) == {}) == few
    want, fold = expected(ops)
    outcomes, state = replay(df)
    assert got(outcomes) == want
    rows = sorted((r["tbl"], r["queue"] or "", r["job_id"] or "", r["at_ms"] or 0) for r in state.select("tbl", "queue", "job_id", "at_ms").collect())
    assert rows == sorted((r["table"], r.get("queue") or "", r.get("job_id") or "", r.get("at_ms") or 0) for r in fold.rows())


def test_many_couplings_and_sweeps_take_the_other_way(spark, monkeypatch):
    import flowloom.plans.replay as rp

    ops = random_ops(5, 150)
    for op in ops:
        if op["kind"] == "reserve" and "gamma" in op["body"]["queues"]:
            op["body"]["queues"] = ["gamma"]
        if op["kind"] == "enqueue_atomic":
            for p in op["body"]["jobs"]:
                p["request"]["queue"] = "alpha"
    df = frame_of(spark, ops).cache()
    few = components(df)
    assert few == {"alpha": "alpha", "beta": "alpha"}
    want = expected(ops)[0]
    assert got(replay(df)[0]) == want
    monkeypatch.setattr(rp, "MOST_COUPLINGS", 0)
    monkeypatch.setattr(rp, "MOST_SWEEPS", 0)
    assert {r["q"]: r["c"] for r in components(df).collect()} == few
    assert got(replay(df)[0]) == want


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    ops = random_ops(3, 120)
    log, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))
    for a in (0, 60):  # a run to the end of what is there, then a second one
        frame_of(spark, ops[a : a + 60]).coalesce(1).write.mode("append").parquet(log)
        run_replay(spark, log, out, check)
    assert got(spark.read.parquet(out)) == expected(ops)[0]


def test_ops_round_trip_and_corrupt_records(spark, tmp_path):
    ops = frame_of(spark, random_ops(4, 40))
    write_ops(ops, str(tmp_path / "ops"))
    back = read_ops(spark, str(tmp_path / "ops"))
    assert back.count() == 40 and set(OP_KINDS) <= set(back.columns)
    ops.selectExpr("* except (kind)", "'reserve' as kind").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="corrupt op"):
        read_ops(spark, str(tmp_path / "bad")).count()


def test_sample_ops_hold_every_event_under_its_own_number(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 100")
    far = events.selectExpr("event_id + 250000 as event_id", "* except (event_id)").select(*events.columns)
    events.unionByName(far).unionByName(events.selectExpr("event_id + 5000000000 as event_id", "* except (event_id)").select(*events.columns)).write.parquet(str(tmp_path / "events.parquet"))
    ops = sample_ops(spark, str(tmp_path)).cache()
    n = events.count()
    assert ops.where("kind = 'enqueue'").count() == 3 * n and ops.where("kind in ('ack', 'nack')").count() == 3 * n
    assert ops.select("seq").distinct().count() == ops.count() > 9 * n
    times = [r["now_ms"] for r in ops.orderBy("seq").select("now_ms").collect()]
    assert times == sorted(times)


def test_outcomes_come_before_a_component_is_read_whole(monkeypatch):
    import pyarrow as pa

    import flowloom.plans.replay as rp

    monkeypatch.setattr(rp, "BATCH_ROWS", 50)
    ops, read = random_ops(6, 400), []

    def batches():
        for op in ops:
            read.append(op["seq"])
            yield pa.RecordBatch.from_pylist([{"seq": op["seq"], "pos": 0, "now_ms": op["now_ms"], "kind": op["kind"], "body": json.dumps(op["body"])}])

    found = rp._folder(None, state=False)(batches())
    first = next(found)
    assert first.num_rows == 50 and len(read) < 60
    rows = [r for b in (first, *found) for r in b.to_pylist()]
    names = ("seq", "idx", "status", "queue", "job_id", "attempt", "value")
    assert sorted(repr(tuple(r[n] for n in names)) for r in rows) == expected(ops)[0]


def test_state_comes_in_batches_without_outcomes(monkeypatch):
    import pyarrow as pa

    import flowloom.plans.replay as rp

    monkeypatch.setattr(rp, "BATCH_ROWS", 10)
    ops = random_ops(7, 300)
    rows = [{"seq": op["seq"], "pos": 0, "now_ms": op["now_ms"], "kind": op["kind"], "body": json.dumps(op["body"])} for op in ops]
    found = list(rp._folder(None, state=True)(iter([pa.RecordBatch.from_pylist(rows)])))
    assert len(found) > 1 and max(b.num_rows for b in found) == 10
    want = [r["table"] for r in expected(ops)[1].rows()]
    assert [r["tbl"] for b in found for r in b.to_pylist()] == want


def test_stream_by_component_equals_fold(spark, tmp_path):
    from flowloom.streaming.replay_stream import replay_slices

    ops = random_ops(9, 160)
    for op in ops:
        if op["kind"] == "reserve":
            op["body"]["queues"] = op["body"]["queues"][:1]
        if op["kind"] == "enqueue_atomic":
            for p in op["body"]["jobs"]:
                p["request"]["queue"] = "alpha"
    df = frame_of(spark, ops).cache()
    assert components(df) == {}
    assert got(replay_slices(df, str(tmp_path))) == expected(ops)[0]
    # Slices are in order; keys are components, so no task folds all queues.
    assert spark.read.parquet(str(tmp_path / "log")).select("component").distinct().count() > 1
