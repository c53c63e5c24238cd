"""The state machine against a fixed scenario, edge rules, and random logs."""

import json
import random

import pytest

from flowloom.operators.fold import Fold

T = 1_000_000


def job(job_id, queue, cap=None, window=20_000, priority=0, attempts=3, key=None, at=None, payload=None):
    return {
        "job_id": job_id,
        "request": {"queue": queue, "job_type": "t", "idempotency_key": key, "scheduled_at_ms": at, "payload": payload},
        "limits": {"priority": priority, "max_attempts": attempts, "dedup_window_ms": window, "max_queue_depth": cap},
    }


def alpha(job_id, **kw):
    return job(job_id, "alpha", cap=6, window=5000, **kw)


class Log:
    def __init__(self):
        self.fold, self.seq = Fold(), 0

    def __call__(self, kind, now=T, **body):
        self.seq += 1
        return self.fold.apply({"seq": self.seq, "now_ms": now, "kind": kind, "body": body})

    def status(self, *a, **b):
        return [o["status"] for o in self(*a, **b)]

    def table(self, name):
        return [r for r in self.fold.rows() if r["table"] == name]


def test_golden_scenario():
    log = Log()
    assert log.status("enqueue", T, jobs=[alpha("j01"), alpha("j02", key="k1"), alpha("j03", at=T + 5000), job("j04", "beta", priority=9, attempts=2, payload={"data": "eA==", "encoding": "json"})]) == ["enqueued"] * 4
    hit = log("enqueue", T + 100, jobs=[alpha("j05", key="k1")])[0]
    assert (hit["status"], hit["job_id"]) == ("deduplicated", "j02")
    assert log.status("enqueue_atomic", T + 200, jobs=[alpha("j06"), job("j07", "gamma", attempts=1)]) == ["enqueued"] * 2
    got = log("reserve", T + 1000, queues=["alpha", "beta"], lease_ms=10_000, max_jobs=3)
    assert [(o["job_id"], o["attempt"], o["value"]) for o in got] == [(j, 1, T + 11_000) for j in ("j01", "j02", "j06")]
    assert log.status("ack", T + 1000, job_id="j04", attempt=1) == ["not_found"]
    assert log.status("nack", T + 2000, job_id="j01", attempt=1, strategy="delay", retry_delay_ms=2000, dead_letter_enabled=True) == ["retry"]
    assert log.status("ack", T + 2000, job_id="j02", attempt=7) == ["failed_precondition"]
    assert log("extend", T + 3000, job_id="j02", attempt=1, lease_ms=30_000)[0]["value"] == T + 33_000
    assert log.status("reserve", T + 3500, queues=["gamma"], lease_ms=10_000, max_jobs=1) == ["reserved"]
    buried = log("nack", T + 4000, job_id="j07", attempt=1, strategy="dead_letter", retry_delay_ms=0, dead_letter_enabled=True)[0]
    assert (buried["status"], buried["reason"]) == ("dead_lettered", "rejected")
    assert log("sweep", T + 6000, budget=100, retention_cutoff_ms=T - 54_000, dead_letter_enabled=True)[0]["value"] == 3
    log("close_queue", T + 6500, queue="alpha", grace_ms=30_000)
    assert log.status("enqueue", T + 6600, jobs=[alpha("j08")]) == ["queue_closing"]
    assert log.status("purge_queue_chunk", T + 6600, queue="alpha", max=100) == ["failed_precondition"]
    log("open_queue", T + 6700, queue="alpha")
    assert log.status("enqueue", T + 6800, jobs=[job("j09", "beta", priority=4), job("j10", "beta", at=T + 30_000)]) == ["enqueued"] * 2
    assert log.status("dead_letter_jobs", T + 7000, queue="beta", state="ready", keys=[{"job_id": "j09"}], reason="manual", dead_letter_enabled=True) == ["dead_lettered"]
    assert log.status("dead_letter_jobs", T + 7100, queue="beta", state="scheduled", keys=[{"job_id": "j10"}], dead_letter_enabled=True) == ["dead_lettered"]
    key = lambda at, q, j: {"failed_at_ms": at, "queue": q, "job_id": j}
    assert log.status("delete_dead_letters", T, queue="beta", keys=[key(T + 7000, "beta", "j09")]) == ["deleted"]
    assert log.status("requeue_dead_letters", T + 8000, queue="gamma", keys=[key(T + 4000, "gamma", "j07")]) == ["requeued"]
    drained = log("drain_dead_letters", T, queue=None, max=10, scan_cap=100)
    assert [(o["job_id"], o["reason"], o["attempt"]) for o in drained] == [("j10", "admin", 1)]
    assert log.status("delete_dead_letters", T, queue="gamma", keys=[key(T + 4000, "gamma", "j07")]) == ["missing"]
    assert log("sweep", T + 5900, budget=100, retention_cutoff_ms=None, dead_letter_enabled=True)[0]["value"] == 0
    assert [log("audit_append", T + 9000 + i, actor="a", role="admin", action="x", details_json="{}")[0]["value"] for i in range(2)] == [1, 2]
    ready = {(r["queue"], r["job_id"], r["attempt"], r["priority"], r["at_ms"]) for r in log.table("ready")}
    assert ready == {("alpha", "j01", 2, 0, T), ("alpha", "j03", 1, 0, T), ("beta", "j04", 1, 9, T), ("gamma", "j07", 1, 0, T + 8000)}
    assert {(r["job_id"], r["at_ms"]) for r in log.table("inflight")} == {("j02", T + 33_000), ("j06", T + 11_000)}
    assert [r["job_id"] for r in log.table("payloads")] == ["j04"]
    assert not any(log.table(n) for n in ("scheduled", "dedup", "dead_letter", "closing"))


def test_dead_letters_off_still_reports():
    log = Log()
    log("enqueue", T, jobs=[job("a", "q", attempts=1), job("b", "q")])
    log("reserve", T, queues=["q"], lease_ms=10, max_jobs=1)
    assert log.status("nack", T, job_id="a", attempt=1, strategy="default", dead_letter_enabled=False) == ["dead_lettered"]
    assert log.status("dead_letter_jobs", T, queue="q", state="ready", keys=[{"job_id": "b"}], dead_letter_enabled=False) == ["dead_lettered"]
    assert not list(log.fold.rows())


@pytest.mark.parametrize("late,status", [(-1, "deduplicated"), (0, "enqueued"), (1, "enqueued")])
def test_dedup_window_is_fixed_and_half_open(late, status):
    log = Log()
    log("enqueue", T, jobs=[job("a", "q", key="k", window=1000)])
    log("enqueue", T + 900, jobs=[job("b", "q", key="k", window=1000)])
    assert log.status("enqueue", T + 1000 + late, jobs=[job("c", "q", key="k", window=1000)]) == [status]


def test_repeat_bypasses_cap_but_counts_in_a_batch():
    log = Log()
    log("enqueue", T, jobs=[job("a", "q", cap=1, key="k")])
    assert log.status("enqueue", T, jobs=[job("b", "q", cap=1, key="k"), job("c", "q", cap=1)]) == ["deduplicated", "queue_full"]
    assert log.status("enqueue_atomic", T, jobs=[job("d", "q", cap=1, key="k")]) == ["queue_full"]
    assert log.status("enqueue", T, jobs=[job("e", "z", cap=0)]) == ["queue_full"]


def test_atomic_rejects_only_jobs_of_full_queues_and_commits_nothing():
    log = Log()
    out = log("enqueue_atomic", T, jobs=[job(str(i), "full", cap=2) for i in range(3)] + [job("o", "other")])
    assert [(o["idx"], o["status"]) for o in out] == [(0, "queue_full"), (1, "queue_full"), (2, "queue_full")]
    assert not list(log.fold.rows())


def test_priority_fifo_and_order_of_queues():
    log = Log()
    log("enqueue", T, jobs=[job("low", "q", priority=1), job("high", "q", priority=9), job("high2", "q", priority=12)])
    log("enqueue", T, jobs=[job("r", "r")])
    assert [o["job_id"] for o in log("reserve", T, queues=["r", "q"], lease_ms=1, max_jobs=9)] == ["r", "high", "high2", "low"]


def test_lapsed_lease_counts_until_a_sweep():
    log = Log()
    log("enqueue", T, jobs=[job("a", "q"), job("b", "q", attempts=1)])
    log("reserve", T, queues=["q"], lease_ms=10, max_jobs=2)
    assert log.status("extend", T + 50, job_id="a", attempt=1, lease_ms=10) == ["extended"]
    assert log.status("sweep", T + 60, budget=10, dead_letter_enabled=True) == ["swept", "dead_lettered", "redelivered"]
    assert [r["reason"] for r in log.table("dead_letter")] == ["lease_expired"]
    assert [(r["attempt"], r["at_ms"]) for r in log.table("ready")] == [(2, T)]


def test_purge_takes_tables_in_order_and_tells_what_remains():
    log = Log()
    log("enqueue", T, jobs=[job("a", "q", key="k"), job("b", "q", at=T + 99)])
    first = log("purge_queue_chunk", T, queue="q", max=2)[0]
    assert (first["value"], first["reason"]) == (2, "remaining")
    last = log("purge_queue_chunk", T, queue="q", max=2)[0]
    assert (last["value"], last["reason"]) == (1, None) and not list(log.fold.rows())


def test_purge_takes_dedup_records_by_deadline():
    log = Log()
    log("enqueue", T, jobs=[job("a", "q", key="z", window=100), job("b", "q", key="a", window=900)])
    assert log("purge_queue_chunk", T, queue="q", max=3)[0]["reason"] == "remaining"
    assert [r["key"] for r in log.table("dedup")] == ["a"]


def test_a_lease_of_zero_ends_at_once():
    log = Log()
    log("enqueue", T, jobs=[job("a", "q")])
    assert log("reserve", T, queues=["q"], lease_ms=0, max_jobs=1)[0]["value"] == T
    assert log.status("sweep", T, budget=1, dead_letter_enabled=True) == ["swept", "redelivered"]


def test_delete_queue():
    log = Log()
    log("enqueue", T, jobs=[job(str(i), "q", key=str(i)) for i in range(5)] + [job("x", "other")])
    assert log.fold.delete_queue("q", T)["status"] == "not_empty" and not log.fold.closing
    log("reserve", T, queues=["q"], lease_ms=10, max_jobs=1)
    assert log.fold.delete_queue("q", T, purge=True)["status"] == "inflight" and not log.fold.closing
    log("ack", T, job_id="0", attempt=1)
    assert log.fold.delete_queue("q", T, purge=True, chunk=2) == {"status": "deleted", "queue": "q", "value": 9}
    assert {r["queue"] for r in log.fold.rows() if r.get("queue")} == {"other"} and log.fold.delete_queue("q", T)["value"] == 0


def random_ops(seed, n=300):
    rng, now, ops, live = random.Random(seed), T, [], []
    for seq in range(1, n + 1):
        step = rng.random()
        now += rng.randint(1, 500) if step < 0.7 else 0 if step < 0.85 else rng.randint(500, 5000) if step < 0.95 else -rng.randint(1, 100)
        queue = lambda: rng.choice(["alpha", "beta", "gamma"])
        kind = rng.choices(["enqueue", "enqueue_atomic", "reserve", "ack", "nack", "extend", "sweep", "close_queue", "open_queue", "purge_queue_chunk", "audit_append"], [30, 8, 20, 12, 10, 5, 8, 2, 1, 2, 1])[0]
        make = lambda i: job(f"{seed}-{seq}-{i}", queue(), cap=6, window=5000, priority=rng.choice([0, 0, 3, 9]), attempts=rng.randint(1, 2), key=rng.choice(["a", "b", "c", "d"]) if rng.random() < 0.25 else None, at=now + rng.randint(1, 3000) if rng.random() < 0.3 else None)
        target = {"job_id": rng.choice(live) if live and rng.random() > 0.15 else "bogus", "attempt": rng.choice([1, 1, 1, 2])}
        body = {
            "enqueue": lambda: {"jobs": [make(i) for i in range(rng.randint(1, 3))]},
            "enqueue_atomic": lambda: {"jobs": [make(i) for i in range(rng.randint(1, 3))]},
            "reserve": lambda: {"queues": rng.sample(["alpha", "beta", "gamma"], rng.randint(1, 2)), "lease_ms": rng.randint(1, 3000), "max_jobs": rng.randint(1, 4)},
            "ack": lambda: target,
            "nack": lambda: target | {"strategy": rng.choice(["default", "delay", "dead_letter"]), "retry_delay_ms": rng.choice([0, 500]), "dead_letter_enabled": seed % 2 == 1},
            "extend": lambda: target | {"lease_ms": 1000},
            "sweep": lambda: {"budget": 10_000, "retention_cutoff_ms": now - 20_000, "dead_letter_enabled": seed % 2 == 1},
            "close_queue": lambda: {"queue": queue(), "grace_ms": 500},
            "open_queue": lambda: {"queue": queue()},
            "purge_queue_chunk": lambda: {"queue": queue(), "max": 3},
            "audit_append": lambda: {"actor": "a", "role": "admin", "action": "x", "details_json": "{}"},
        }[kind]()
        live += [p["job_id"] for p in body.get("jobs", [])]
        live = live[-30:]
        ops.append({"seq": seq, "now_ms": now, "kind": kind, "body": body})
    return ops


def test_random_logs_keep_invariants_and_reach_every_branch():
    seen = set()
    for seed in range(1, 7):
        ops, one, two = random_ops(seed), Fold(), Fold()
        for op in ops:
            a, b = one.apply(op), two.apply(json.loads(json.dumps(op)))
            assert a == b
            seen |= {o["status"] for o in a}
            places = list(one.ready_attempt) + list(one.scheduled_attempt) + list(one.inflight)
            assert sorted(places) == sorted(one.jobs)  # each live job is in one place
            for q in ("alpha", "beta", "gamma"):
                assert one.live.get(q, 0) == sum(j["queue"] == q for j in one.jobs.values())
        assert list(one.rows()) == list(two.rows())
    assert {"enqueued", "deduplicated", "queue_full", "queue_closing", "dead_lettered", "failed_precondition", "not_found", "purged", "promoted"} <= seen


def test_order_is_a_sorted_set_in_parts_of_bounded_length():
    from flowloom.operators.fold import Order

    rng, order, plain = random.Random(8), Order(), set()
    for _ in range(20_000):
        key = (rng.randrange(9000), "k")
        if rng.random() < 0.7:
            order.add(key)
            plain.add(key)
        else:
            order.discard(key)
            plain.discard(key)
        assert (key in order) == (key in plain)
    assert list(order) == sorted(plain) and max(map(len, order.parts)) <= Order.MOST < len(plain)
    assert order.first() == min(plain) and order.upto(4000, 1 << 53) == sorted(k for k in plain if k[0] <= 4000) and len(order.upto(4000, 7)) == 7
    for key in plain:
        order.discard(key)
    assert not order and not list(order)
