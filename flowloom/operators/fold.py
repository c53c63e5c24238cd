"""The ordered state machine over an op log, in plain Python: a pure function of its ops.

Ops carry every clock and limit they need, so equal logs give equal outcomes and
equal state wherever they are folded. ``Fold.apply`` takes one op as a dict and
returns its outcomes; ``Fold.rows`` lists all state tables as tagged rows. Nothing
here knows of Spark; batch and streaming replay both call it.
"""

from __future__ import annotations

import bisect
import itertools
import json
import sys
from collections.abc import Iterator
from typing import NamedTuple

MAX_LONG = 2**63 - 1
PURGE_MOST = 1000


class Order:
    """A set of comparable keys that can be walked from the least: sorted lists of bounded length, so that no change moves all keys."""

    MOST = 1024

    def __init__(self) -> None:
        self.parts: list[list[tuple]] = []
        self.last: list[tuple] = []  # of each part

    def add(self, key: tuple) -> None:
        if not self.parts:
            self.parts, self.last = [[key]], [key]
            return
        i = min(bisect.bisect_left(self.last, key), len(self.parts) - 1)
        part = self.parts[i]
        at = bisect.bisect_left(part, key)
        if at < len(part) and part[at] == key:
            return
        part.insert(at, key)
        if len(part) > self.MOST:
            half = len(part) // 2
            self.parts[i : i + 1] = [part[:half], part[half:]]
            self.last[i : i + 1] = [part[half - 1], part[-1]]
        else:
            self.last[i] = part[-1]

    def discard(self, key: tuple) -> None:
        i = bisect.bisect_left(self.last, key)
        if i == len(self.parts):
            return
        part = self.parts[i]
        at = bisect.bisect_left(part, key)
        if part[at] != key:
            return
        del part[at]
        if part:
            self.last[i] = part[-1]
        else:
            del self.parts[i], self.last[i]

    def __contains__(self, key: tuple) -> bool:
        i = bisect.bisect_left(self.last, key)
        return i < len(self.parts) and self.parts[i][bisect.bisect_left(self.parts[i], key)] == key

    def __iter__(self) -> Iterator[tuple]:
        return itertools.chain.from_iterable(self.parts)

    def __bool__(self) -> bool:
        return bool(self.parts)

    def first(self) -> tuple:
        return self.parts[0][0]

    def upto(self, now: int, most: int) -> list[tuple]:
        """The first ``most`` keys whose time is not after now."""
        due = itertools.takewhile(lambda k: k[0] <= now, self)
        return list(itertools.islice(due, min(max(most, 0), sys.maxsize)))


class Job(NamedTuple):
    """Rows, not dicts: a queue may hold a great many jobs and dead letters."""

    job_id: str
    queue: str
    job_type: str | None
    priority: int
    max_attempts: int
    enqueued_at_ms: int
    scheduled_at_ms: int | None
    custom: dict | None
    trace_context: dict | None

    def __getitem__(self, name):
        return getattr(self, name) if isinstance(name, str) else tuple.__getitem__(self, name)


class DeadLetter(NamedTuple):
    job: Job
    payload: dict | None
    cause: str
    final_attempt: int
    last_reason: str | None


def _same(text: str | None) -> str | None:
    """The one copy of a text that many jobs share."""
    return text if text is None else sys.intern(text)


def _plus(a: int, b: int) -> int:
    return min(a + b, MAX_LONG)


def _dead_key(failed_at: int, queue: str, job_id: str) -> tuple:
    return (failed_at, len(queue.encode()), queue, job_id)


class Fold:
    """State of all queues of one component."""

    def __init__(self) -> None:
        self.jobs: dict[str, Job] = {}
        self.payloads: dict[str, dict] = {}
        self.ready: dict[str, Order] = {}
        self.ready_attempt: dict[str, int] = {}
        self.scheduled = Order()
        self.scheduled_attempt: dict[str, int] = {}
        self.scheduled_at: dict[str, int] = {}
        self.inflight: dict[str, dict] = {}
        self.leases = Order()
        self.dedup: dict[tuple[str, str], dict] = {}
        self.dedup_timers = Order()
        self.dead: dict[tuple, DeadLetter] = {}
        self.dead_order = Order()
        self.closing: dict[str, int] = {}
        self.audit: list[dict] = []
        self.live: dict[str, int] = {}
        self.flying: dict[str, int] = {}

    def apply(self, op: dict) -> list[dict]:
        """Outcomes of one op {seq, now_ms, kind, body}: dicts with status and what the kind reports."""
        return getattr(self, f"_{op['kind']}")(op.get("body") or {}, op.get("now_ms") or 0)

    # --- placing and taking ---

    def _ready_key(self, job: Job) -> tuple:
        return (9 - min(job.priority, 9), job.enqueued_at_ms, job.job_id)

    def _to_ready(self, job: Job, attempt: int) -> None:
        order = self.ready.get(job.queue)
        if order is None:
            order = self.ready[job.queue] = Order()
        order.add(self._ready_key(job))
        self.ready_attempt[job.job_id] = attempt

    def _to_scheduled(self, job_id: str, deadline: int, attempt: int) -> None:
        self.scheduled.add((deadline, job_id))
        self.scheduled_at[job_id], self.scheduled_attempt[job_id] = deadline, attempt

    def _off_ready(self, job: Job) -> int:
        order = self.ready[job.queue]
        order.discard(self._ready_key(job))
        if not order:
            del self.ready[job.queue]
        return self.ready_attempt.pop(job.job_id)

    def _off_scheduled(self, job_id: str) -> int:
        self.scheduled.discard((self.scheduled_at.pop(job_id), job_id))
        return self.scheduled_attempt.pop(job_id)

    def _off_inflight(self, job_id: str) -> dict:
        held = self.inflight.pop(job_id)
        self.leases.discard((held["lease_expires_at_ms"], job_id))
        self.flying[held["queue"]] -= 1
        return held

    def _forget(self, job_id: str) -> Job:
        job = self.jobs.pop(job_id)
        self.payloads.pop(job_id, None)
        self.live[job.queue] -= 1
        return job

    def _bury(self, job_id: str, attempt: int, cause: str, reason: str | None, now: int, enabled: bool) -> None:
        """The record is a copy of all that is known; without dead letters it is dropped, and still reported."""
        payload = self.payloads.get(job_id)
        job = self._forget(job_id)
        if enabled:
            key = _dead_key(now, job.queue, job.job_id)
            self.dead[key] = DeadLetter(job, payload, cause, attempt, _same(reason))
            self.dead_order.add(key)

    # --- enqueue ---

    def _is_closing(self, queue: str, now: int) -> bool:
        return self.closing.get(queue, now) > now

    def _hit(self, request: dict, now: int) -> str | None:
        key = request.get("idempotency_key")
        record = self.dedup.get((request["queue"], key)) if key is not None else None
        return record["job_id"] if record and now < record["deadline_ms"] else None

    def _insert(self, prepared: dict, now: int) -> None:
        request, limits, job_id = prepared["request"], prepared.get("limits") or {}, prepared["job_id"]
        at = request.get("scheduled_at_ms")
        job = Job(
            job_id, _same(request["queue"]), _same(request.get("job_type")), int(limits.get("priority") or 0), int(limits.get("max_attempts") or 1),
            now, at, request.get("custom"), request.get("trace_context"),
        )
        self.jobs[job_id] = job
        self.live[job.queue] = self.live.get(job.queue, 0) + 1
        if request.get("payload") is not None:
            self.payloads[job_id] = request["payload"]
        if at is not None and at > now:
            self._to_scheduled(job_id, at, 1)
        else:
            self._to_ready(job, 1)
        key = request.get("idempotency_key")
        if key is not None:
            own = (job.queue, key)
            if own in self.dedup:
                self.dedup_timers.discard((self.dedup[own]["deadline_ms"], *own))
            deadline = _plus(now, int(limits.get("dedup_window_ms") or 0))
            self.dedup[own] = {"job_id": job_id, "enqueued_at_ms": now, "deadline_ms": deadline}
            self.dedup_timers.add((deadline, *own))

    def _enqueue(self, body: dict, now: int) -> list[dict]:
        out = []
        for p in body["jobs"]:
            queue, limits = p["request"]["queue"], p.get("limits") or {}
            cap = limits.get("max_queue_depth")
            if self._is_closing(queue, now):
                out.append({"status": "queue_closing", "queue": queue})
            elif (first := self._hit(p["request"], now)) is not None:
                out.append({"status": "deduplicated", "queue": queue, "job_id": first})
            elif cap is not None and self.live.get(queue, 0) >= cap:
                out.append({"status": "queue_full", "queue": queue, "value": cap})
            else:
                self._insert(p, now)
                out.append({"status": "enqueued", "queue": queue, "job_id": p["job_id"]})
        return out

    def _enqueue_atomic(self, body: dict, now: int) -> list[dict]:
        jobs = body["jobs"]
        shut = [i for i, p in enumerate(jobs) if self._is_closing(p["request"]["queue"], now)]
        if shut:
            return [{"status": "queue_closing", "queue": jobs[i]["request"]["queue"], "idx": i} for i in shut]
        demand: dict[str, int] = {}
        caps: dict[str, int | None] = {}
        for p in jobs:
            queue = p["request"]["queue"]
            demand[queue] = demand.get(queue, 0) + 1
            caps.setdefault(queue, (p.get("limits") or {}).get("max_queue_depth"))
        full = {q for q, n in demand.items() if caps[q] is not None and self.live.get(q, 0) + n > caps[q]}
        if full:
            return [{"status": "queue_full", "queue": q, "idx": i, "value": caps[q]} for i, p in enumerate(jobs) if (q := p["request"]["queue"]) in full]
        out = []
        for p in jobs:
            first = self._hit(p["request"], now)
            if first is None:
                self._insert(p, now)
            out.append({"status": "enqueued" if first is None else "deduplicated", "queue": p["request"]["queue"], "job_id": first or p["job_id"]})
        return out

    # --- leases ---

    def _reserve(self, body: dict, now: int) -> list[dict]:
        out: list[dict] = []
        expires = _plus(now, int(body.get("lease_ms") or 0))
        for queue in body["queues"]:
            order = self.ready.get(queue)
            while order and len(out) < body["max_jobs"]:
                job = self.jobs[order.first()[2]]
                attempt = self._off_ready(job)
                self.inflight[job.job_id] = {"attempt": attempt, "lease_expires_at_ms": expires, "queue": job.queue}
                self.flying[queue] = self.flying.get(queue, 0) + 1
                self.leases.add((expires, job.job_id))
                out.append({"status": "reserved", "queue": queue, "job_id": job.job_id, "attempt": attempt, "value": expires})
                order = self.ready.get(queue)
        return out or [{"status": "empty"}]

    def _fenced(self, body: dict) -> list[dict] | None:
        held = self.inflight.get(body["job_id"])
        if held is None:
            return [{"status": "not_found", "job_id": body["job_id"]}]
        if held["attempt"] != body["attempt"]:
            return [{"status": "failed_precondition", "job_id": body["job_id"]}]
        return None

    def _ack(self, body: dict, now: int) -> list[dict]:
        refused = self._fenced(body)
        if refused:
            return refused
        held = self._off_inflight(body["job_id"])
        self._forget(body["job_id"])
        return [{"status": "acked", "queue": held["queue"], "job_id": body["job_id"]}]

    def _nack(self, body: dict, now: int) -> list[dict]:
        refused = self._fenced(body)
        if refused:
            return refused
        job_id = body["job_id"]
        job, held = self.jobs[job_id], self._off_inflight(job_id)
        asked = body.get("strategy") == "dead_letter"
        base = {"queue": job.queue, "job_id": job_id, "attempt": held["attempt"]}
        if asked or held["attempt"] >= job.max_attempts:
            cause = "rejected" if asked else "attempts_exhausted"
            self._bury(job_id, held["attempt"], cause, body.get("reason"), now, bool(body.get("dead_letter_enabled")))
            return [base | {"status": "dead_lettered", "reason": cause}]
        delay = int(body.get("retry_delay_ms") or 0)
        if delay > 0:
            self._to_scheduled(job.job_id, _plus(now, delay), held["attempt"] + 1)
        else:
            self._to_ready(job, held["attempt"] + 1)
        return [base | {"status": "retry", "value": delay}]

    def _extend(self, body: dict, now: int) -> list[dict]:
        refused = self._fenced(body)
        if refused:
            return refused
        held = self.inflight[body["job_id"]]
        self.leases.discard((held["lease_expires_at_ms"], body["job_id"]))
        held["lease_expires_at_ms"] = _plus(now, max(1, int(body.get("lease_ms") or 0)))
        self.leases.add((held["lease_expires_at_ms"], body["job_id"]))
        return [{"status": "extended", "queue": held["queue"], "job_id": body["job_id"], "value": held["lease_expires_at_ms"]}]

    # --- dead letters ---

    def _unbury(self, key: tuple) -> DeadLetter:
        self.dead_order.discard(key)
        return self.dead.pop(key)

    def _drain_dead_letters(self, body: dict, now: int) -> list[dict]:
        queue = body.get("queue")
        seen = itertools.islice(self.dead_order, max(body["scan_cap"], 0))
        keys = list(itertools.islice((k for k in seen if queue is None or k[2] == queue), max(body["max"], 0)))
        out = []
        for key in keys:
            r = self._unbury(key)
            out.append({"status": "drained", "queue": key[2], "job_id": key[3], "attempt": r.final_attempt, "reason": r.cause, "value": key[0]})
        return out or [{"status": "empty"}]

    def _keyed(self, body: dict, done: str, act) -> list[dict]:
        """For each key: act on its record if it is the queue's own, else report it missing."""
        out = []
        for k in body["keys"]:
            key = _dead_key(k["failed_at_ms"], k["queue"], k["job_id"])
            if k["queue"] == body["queue"] and key in self.dead:
                act(self._unbury(key))
                out.append({"status": done, "queue": k["queue"], "job_id": k["job_id"]})
            else:
                out.append({"status": "missing", "queue": k["queue"], "job_id": k["job_id"]})
        return out

    def _requeue_dead_letters(self, body: dict, now: int) -> list[dict]:
        def back(record: DeadLetter) -> None:
            job = record.job._replace(enqueued_at_ms=now, scheduled_at_ms=None)
            self.jobs[job.job_id] = job
            self.live[job.queue] = self.live.get(job.queue, 0) + 1
            if record.payload is not None:
                self.payloads[job.job_id] = record.payload
            self._to_ready(job, 1)

        return self._keyed(body, "requeued", back)

    def _delete_dead_letters(self, body: dict, now: int) -> list[dict]:
        return self._keyed(body, "deleted", lambda record: None)

    def _dead_letter_jobs(self, body: dict, now: int) -> list[dict]:
        if body["state"] not in ("ready", "scheduled"):
            return [{"status": "invalid_argument", "queue": body["queue"]}]
        out = []
        for k in body["keys"]:
            job = self.jobs.get(k["job_id"])
            own = job is not None and job.queue == body["queue"]
            if own and body["state"] == "ready" and k["job_id"] in self.ready_attempt and self._ready_key(job)[1] == k.get("enqueued_at_ms", job.enqueued_at_ms):
                attempt = self._off_ready(job)
            elif own and body["state"] == "scheduled" and self.scheduled_at.get(k["job_id"]) == k.get("deadline_ms", self.scheduled_at.get(k["job_id"])) and k["job_id"] in self.scheduled_at:
                attempt = self._off_scheduled(k["job_id"])
            else:
                out.append({"status": "missing", "queue": body["queue"], "job_id": k["job_id"]})
                continue
            self._bury(k["job_id"], attempt, "admin", body.get("reason"), now, bool(body.get("dead_letter_enabled")))
            out.append({"status": "dead_lettered", "queue": body["queue"], "job_id": k["job_id"], "attempt": attempt, "reason": "admin"})
        return out

    # --- queues, timers, audit ---

    def _close_queue(self, body: dict, now: int) -> list[dict]:
        self.closing[body["queue"]] = _plus(now, int(body.get("grace_ms") or 0))
        return [{"status": "closed", "queue": body["queue"], "value": self.closing[body["queue"]]}]

    def _open_queue(self, body: dict, now: int) -> list[dict]:
        self.closing.pop(body["queue"], None)
        return [{"status": "opened", "queue": body["queue"]}]

    def _purge_queue_chunk(self, body: dict, now: int) -> list[dict]:
        queue, most = body["queue"], min(max(int(body["max"]), 1), PURGE_MOST)
        if self.flying.get(queue):
            return [{"status": "failed_precondition", "queue": queue}]
        every = itertools.chain(
            (("ready", k) for k in self.ready.get(queue, ())),
            (("scheduled", k) for k in self.scheduled if self.jobs[k[1]].queue == queue),
            (("dead", k) for k in self.dead_order if k[2] == queue),
            (("dedup", k[1:]) for k in self.dedup_timers if k[1] == queue),
        )
        steps = list(itertools.islice(every, most + 1))
        for table, k in steps[:most]:
            if table == "ready":
                self._off_ready(self.jobs[k[2]])
                self._forget(k[2])
            elif table == "scheduled":
                self._off_scheduled(k[1])
                self._forget(k[1])
            elif table == "dead":
                self._unbury(k)
            else:
                self.dedup_timers.discard((self.dedup.pop(k)["deadline_ms"], *k))
        return [{"status": "purged", "queue": queue, "value": min(len(steps), most), "reason": "remaining" if len(steps) > most else None}]

    def _sweep(self, body: dict, now: int) -> list[dict]:
        """Phases in order, each with the whole budget of its own; tombstones cost nothing of it but count."""
        budget, enabled, out = int(body["budget"]), bool(body.get("dead_letter_enabled")), []
        gone = [q for q, deadline in self.closing.items() if deadline <= now]
        for q in gone:
            del self.closing[q]
        count = len(gone)
        for deadline, job_id in self.scheduled.upto(now, budget):
            job = self.jobs[job_id]
            self._to_ready(job, self._off_scheduled(job_id))
            out.append({"status": "promoted", "queue": job.queue, "job_id": job_id})
        for deadline, job_id in self.leases.upto(now, budget):
            job, held = self.jobs[job_id], self._off_inflight(job_id)
            if held["attempt"] >= job.max_attempts:
                self._bury(job_id, held["attempt"], "lease_expired", None, now, enabled)
                out.append({"status": "dead_lettered", "queue": job.queue, "job_id": job_id, "attempt": held["attempt"], "reason": "lease_expired"})
            else:
                self._to_ready(job, held["attempt"] + 1)
                out.append({"status": "redelivered", "queue": job.queue, "job_id": job_id, "attempt": held["attempt"] + 1})
        for timer in self.dedup_timers.upto(now, budget):
            self.dedup_timers.discard(timer)
            own = timer[1:]
            if own in self.dedup and self.dedup[own]["deadline_ms"] <= now:
                del self.dedup[own]
            out.append({"status": "dedup_expired", "queue": own[0]})
        cutoff = body.get("retention_cutoff_ms")
        if cutoff is not None:
            for key in self.dead_order.upto(cutoff, budget):
                self._unbury(key)
                out.append({"status": "retention_expired", "queue": key[2], "job_id": key[3]})
        return [{"status": "swept", "value": count + len(out)}, *out]

    def _audit_append(self, body: dict, now: int) -> list[dict]:
        self.audit.append({"seq": len(self.audit) + 1, "ts_ms": now, **body})
        return [{"status": "appended", "value": len(self.audit)}]

    # --- what is due, and commands of several ops ---

    def earliest(self) -> int | None:
        """The first deadline of all timers and tombstones."""
        firsts = [order.first()[0] for order in (self.scheduled, self.leases, self.dedup_timers) if order]
        return min([*firsts, *self.closing.values()], default=None)

    def oldest_dead(self) -> int | None:
        return self.dead_order.first()[0] if self.dead_order else None

    def delete_queue(self, queue: str, now: int, purge: bool = False, grace_ms: int = 30_000, chunk: int = PURGE_MOST) -> dict:
        """Empty a queue under a tombstone that lasts until it ends: refused with jobs in flight, and without purge with any jobs.

        The tombstone stands before the queue is looked at, and is renewed after each chunk.
        """
        self._close_queue({"queue": queue, "grace_ms": grace_ms}, now)
        try:
            waiting = self.live.get(queue, 0) - self.flying.get(queue, 0) + sum(k[2] == queue for k in self.dead_order)
            if self.flying.get(queue):
                return {"status": "inflight", "queue": queue}
            if waiting and not purge:
                return {"status": "not_empty", "queue": queue}
            purged = 0
            while True:
                got = self._purge_queue_chunk({"queue": queue, "max": chunk}, now)[0]
                purged += got["value"]
                if got["reason"] is None:
                    return {"status": "deleted", "queue": queue, "value": purged}
                self._close_queue({"queue": queue, "grace_ms": grace_ms}, now)
        finally:
            self._open_queue({"queue": queue}, now)

    # --- state ---

    def rows(self) -> Iterator[dict]:
        """All state as tagged rows in the order of each table."""
        for job_id in sorted(self.jobs):
            job = self.jobs[job_id]
            attempt = self.ready_attempt.get(job_id) or self.scheduled_attempt.get(job_id) or self.inflight[job_id]["attempt"]
            body = {k: job[k] for k in ("job_type", "scheduled_at_ms", "custom", "trace_context")}
            yield {"table": "jobs", "queue": job.queue, "job_id": job_id, "attempt": attempt, "priority": job.priority, "max_attempts": job.max_attempts, "at_ms": job.enqueued_at_ms, "body": json.dumps(body, sort_keys=True)}
        for job_id in sorted(self.payloads):
            yield {"table": "payloads", "job_id": job_id, "body": json.dumps(self.payloads[job_id], sort_keys=True)}
        for queue in sorted(self.ready):
            for inv, at, job_id in self.ready[queue]:
                yield {"table": "ready", "queue": queue, "job_id": job_id, "priority": 9 - inv, "at_ms": at, "attempt": self.ready_attempt[job_id]}
        for deadline, job_id in self.scheduled:
            yield {"table": "scheduled", "queue": self.jobs[job_id].queue, "job_id": job_id, "at_ms": deadline, "attempt": self.scheduled_attempt[job_id]}
        for deadline, job_id in self.leases:
            job = self.jobs[job_id]
            yield {"table": "inflight", "queue": job.queue, "job_id": job_id, "at_ms": deadline, "attempt": self.inflight[job_id]["attempt"], "priority": job.priority, "max_attempts": job.max_attempts}
            yield {"table": "leases", "queue": job.queue, "job_id": job_id, "at_ms": deadline}
        for (queue, key), r in sorted(self.dedup.items()):
            yield {"table": "dedup", "queue": queue, "key": key, "job_id": r["job_id"], "at_ms": r["deadline_ms"]}
        for deadline, queue, key in self.dedup_timers:
            yield {"table": "dedup_timers", "queue": queue, "key": key, "at_ms": deadline}
        for key in self.dead_order:
            r = self.dead[key]
            yield {"table": "dead_letter", "queue": key[2], "job_id": key[3], "at_ms": key[0], "attempt": r.final_attempt, "reason": r.cause, "body": json.dumps({"last_reason": r.last_reason, "job": r.job._asdict(), "payload": r.payload}, sort_keys=True)}
        for queue in sorted(self.closing):
            yield {"table": "closing", "queue": queue, "at_ms": self.closing[queue]}
        for a in self.audit:
            yield {"table": "audit", "attempt": a["seq"], "at_ms": a["ts_ms"], "key": a.get("actor"), "reason": a.get("action"), "body": json.dumps(a, sort_keys=True)}
