"""Configuration: defaults, then a TOML file, then environment, as one checked dict; and its registry tables.

This is driver-side data of a few kilobytes; what plans use of it is the registry
DataFrame, a new version of which replaces the old whole.
"""

from __future__ import annotations

import copy
import hashlib
import json
import tomllib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.validation import DEFAULTS

#: Settings of the store and of upkeep.
STORAGE = {"persist_mode": "sync_all", "sweep_interval_ms": 1000, "sweep_limit": 10_000, "dead_letter_retention_ms": 0, "command_queue": 4096}
PERSIST_MODES = ("sync_all", "sync_data", "buffer")
#: Settings that take effect only at the next start.
RESTART_ONLY = ("storage.persist_mode", "storage.command_queue", "limits.dedup_window_ms")
_OVERRIDES = ("max_lease_ms", "default_priority", "default_max_attempts", "max_queue_depth", "dedup_window_ms", "max_payload_bytes", "retry_delay_ms")


def defaults() -> dict:
    return {"limits": dict(DEFAULTS), "storage": dict(STORAGE), "strict_queues": False, "queues": []}


def _merged(base: dict, over: Mapping) -> dict:
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = _merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), dict) else v
    return out


def _parsed(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def pins(environment: Mapping[str, str], prefix: str) -> dict[str, str]:
    """dotted setting -> text of every variable PREFIX__A__B, in order of the setting."""
    found = {k[len(prefix) + 2 :].replace("__", ".").lower(): v for k, v in environment.items() if k.startswith(f"{prefix}__")}
    return dict(sorted(found.items()))


def load(toml: str = "", environment: Mapping[str, str] | None = None, prefix: str = "FLOWLOOM") -> dict:
    """The layers merged and checked; the first rule that fails raises ValueError."""
    config = _merged(defaults(), tomllib.loads(toml))
    for path, text in pins(environment or {}, prefix).items():
        node = config
        *parents, leaf = path.split(".")
        for p in parents:
            node = node.setdefault(p, {})
        node[leaf] = _parsed(text)
    check(config)
    return config


def check(config: Mapping) -> None:
    def must(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(what)

    limits, storage = config["limits"], config["storage"]
    must(storage["persist_mode"] in PERSIST_MODES, "storage.persist_mode is not known")
    must(storage["sweep_interval_ms"] > 0 and storage["sweep_limit"] > 0, "sweeps need a positive interval and limit")
    must(0 <= limits["default_priority"] <= 9, "limits.default_priority must be 0 to 9")
    must(1 <= limits["default_max_attempts"] <= limits["max_attempts_ceiling"], "limits.default_max_attempts must be 1 to the ceiling")
    for k in ("max_lease_ms", "max_payload_bytes", "dedup_window_ms", "schedule_horizon_ms", "max_enqueue_batch", "max_reserve_batch", "max_reserve_queues"):
        must(limits[k] > 0, f"limits.{k} must be positive")
    must(limits["retry_backoff"] in ("none", "exponential"), "limits.retry_backoff is not known")
    names = [q.get("name") for q in config["queues"]]
    must(all(names), "every queue needs a name")
    must(len(set(names)) == len(names), "queue names must be unique")
    for q in config["queues"]:
        must(q.get("default_priority") is None or 0 <= q["default_priority"] <= 9, f"queue {q['name']}: default_priority must be 0 to 9")
        must(q.get("max_lease_ms") is None or q["max_lease_ms"] > 0, f"queue {q['name']}: max_lease_ms must be positive")


def changed(old: Mapping, new: Mapping, prefix: str = "") -> list[str]:
    """Dotted names of settings that differ, in order."""
    out: list[str] = []
    for k in sorted({*old, *new}):
        a, b = old.get(k), new.get(k)
        if isinstance(a, Mapping) and isinstance(b, Mapping):
            out += changed(a, b, f"{prefix}{k}.")
        elif a != b:
            out.append(f"{prefix}{k}")
    return out


def needs_restart(old: Mapping, new: Mapping) -> list[str]:
    return [p for p in changed(old, new) if p in RESTART_ONLY]


def etag(toml: str) -> str:
    return hashlib.sha256(toml.encode()).hexdigest()


class Registry:
    """The live configuration: replaced whole, with a generation that rises at each change."""

    def __init__(self, config: dict):
        self.boot = self.live = config
        self.generation = 0

    def replace(self, config: dict, expected_etag: str | None = None, current_toml: str = "") -> None:
        if expected_etag is not None and expected_etag != etag(current_toml):
            raise ValueError("the configuration has changed meanwhile")
        check(config)
        if changed(self.live, config):
            self.live, self.generation = config, self.generation + 1

    @staticmethod
    def table(spark: SparkSession, config: Mapping) -> DataFrame:
        """Declared queues with their overrides; null falls back."""
        kinds = {"queue": "string", **dict.fromkeys(_OVERRIDES, "bigint"), "retry_backoff": "string", "allowed_encodings": "array<string>", "allowed_job_types": "array<string>"}
        rows = [(q["name"], *[q.get(k) for k in list(kinds)[1:]]) for q in config["queues"]]
        return spark.createDataFrame(rows, ", ".join(f"{k} {t}" for k, t in kinds.items()))
