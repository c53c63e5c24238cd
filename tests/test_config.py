import pytest

from flowloom.operators.validation import with_limits
from flowloom.sources import config as cf

TOML = """
[limits]
default_max_attempts = 4
[[queues]]
name = "emails"
max_lease_ms = 60000
default_priority = 7
"""


def test_layers_and_fallback(spark):
    c = cf.load(TOML, {"FLOWLOOM__STORAGE__SWEEP_LIMIT": "5", "OTHER__X": "1"})
    assert (c["limits"]["default_max_attempts"], c["storage"]["sweep_limit"], c["limits"]["max_lease_ms"]) == (4, 5, 300_000)
    names = spark.createDataFrame([("emails",), ("sms",)], "queue string")
    got = {r["queue"]: r for r in with_limits(names, cf.Registry.table(spark, c)).collect()}
    assert (got["emails"]["lim_max_lease_ms"], got["emails"]["lim_default_priority"], got["emails"]["declared"]) == (60_000, 7, True)
    assert (got["sms"]["lim_max_lease_ms"], got["sms"]["declared"]) == (300_000, False)


@pytest.mark.parametrize("toml", ['[storage]\npersist_mode = "x"', "[limits]\ndefault_priority = 10", "[limits]\ndefault_max_attempts = 101", '[[queues]]\nname = "a"\n[[queues]]\nname = "a"', "[[queues]]\nmax_lease_ms = 1"])
def test_wrong_settings_are_refused(toml):
    with pytest.raises(ValueError):
        cf.load(toml)


def test_replacement_is_versioned_and_guarded():
    first = cf.load(TOML)
    r = cf.Registry(first)
    r.replace(cf.load(TOML))
    assert r.generation == 0
    r.replace(cf.load(TOML + '[[queues]]\nname = "b"\n'), cf.etag(TOML), TOML)
    assert r.generation == 1 and r.boot is first
    with pytest.raises(ValueError):
        r.replace(first, "stale", TOML)
    assert cf.needs_restart(first, cf.load('[storage]\npersist_mode = "buffer"' + TOML)) == ["storage.persist_mode"]
