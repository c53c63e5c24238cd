"""Column functions against plain Python."""

import pytest
from pyspark.sql import functions as F

from flowloom.functions import text as fn
from flowloom.operators import admission as ad, validation as va


def one(spark, c, **given):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()] or [F.lit(1).alias("x")])
    return df.select(c.alias("r")).first()["r"]


def test_siphash_of_reference_input():
    # The vector of the public C test for SipHash-1-3 has another key; this is CPython's own hash under a zero seed.
    import subprocess, sys

    said = subprocess.run([sys.executable, "-c", "print([hash(x) for x in (b'a', b'hello world', bytes(range(33)))])"], capture_output=True, text=True, env={"PYTHONHASHSEED": "0"})
    assert [fn.siphash13(x) for x in (b"a", b"hello world", bytes(range(33)))] == [h % 2**64 for h in eval(said.stdout)]


@pytest.mark.parametrize("base,backoff,attempt,want", [(1000, "exponential", 1, 1000), (1000, "exponential", 3, 4000), (1000, "exponential", 60, 10_000), (8000, "none", 9, 8000), (0, "exponential", 5, 0)])
def test_retry_cap(spark, base, backoff, attempt, want):
    cap = ad.retry_cap(F.col("b"), F.col("k"), F.col("a"), F.lit(10_000), F.lit(2**40))
    assert one(spark, cap, b=base, k=backoff, a=attempt) == want


def test_jitter_stays_in_a_quarter_and_spreads(spark):
    df = spark.range(20).select(F.concat(F.lit("job-"), F.col("id").cast("string")).alias("j"))
    got = {r[0] for r in df.select(fn.jittered(F.lit(10_000).cast("bigint"), fn.jitter_hash("j", F.lit(5)))).collect()}
    assert all(7500 <= x <= 10_000 for x in got) and len(got) > 10


def test_cursor_and_details(spark):
    assert one(spark, fn.cursor_decode(fn.cursor_encode(F.lit("a/é")))) == "a/é"
    assert one(spark, fn.cursor_decode(F.lit("***"))) is None
    assert one(spark, fn.details(F.lit("not json")).cast("string")) == "not json"


def test_custom_from_json_keeps_types(spark):
    got = one(spark, fn.custom_from_json(F.lit('{"a": 1, "b": 1.5, "c": "x", "d": true}')))
    assert {k: [n for n in "sdib" if v[n] is not None] for k, v in got.items()} == {"a": ["i"], "b": ["d"], "c": ["s"], "d": ["b"]}
    assert one(spark, fn.custom_from_json(F.lit('{"a": [1]}'))) is None


def test_pin_path_and_rate_text(spark):
    assert one(spark, fn.pin_path(F.lit("QX__STORAGE__SWEEP_LIMIT"), "QX")) == "storage.sweep_limit"
    assert [one(spark, fn.rate_text(F.lit(x))) for x in (12345.0, 123.4, 7.25)][:2] == ["12.3k", "123"]


@pytest.mark.parametrize("change,reason,actual", [({"queue": "a/b"}, "invalid_request", None), ({"queue": "q" * 513}, "queue_name_too_long", 513), ({"job_type": "é" * 129}, "job_type_name_too_long", 258), ({"idempotency_key": "k" * 257}, "idempotency_key_too_long", 257), ({"scheduled_at_ms": 2_592_000_001}, "scheduled_too_far", 2_592_000_001), ({}, None, None)])
def test_classify(spark, change, reason, actual):
    row = {"queue": "ok", "job_type": "j", "payload": None, "encoding": None, "idempotency_key": None, "priority": None, "max_attempts": None, "custom": None, "scheduled_at_ms": None} | change
    schema = "queue string, job_type string, payload string, encoding string, idempotency_key string, priority bigint, max_attempts bigint, custom map<string,struct<s:string,d:double,i:bigint,b:boolean>>, scheduled_at_ms bigint"
    registry = spark.createDataFrame([("ok", 5)], "queue string, max_queue_depth bigint").withColumn("allowed_encodings", F.lit(None).cast("array<string>")).withColumn("allowed_job_types", F.lit(None).cast("array<string>"))
    got = va.classify_enqueue(spark.createDataFrame([tuple(row.values())], schema), registry, False, F.lit(0)).first()
    assert (got["reason"], got["actual"]) == (reason, actual)


def test_payload_text(spark):
    rows = [(b'{"b": 1}', "application/json"), ("é".encode(), "text"), (b"\xff\x00A", "text"), (b"{", "json"), (b"plain", ""), (b"plain", None), (b"ab", "image/png"), (b"", "x"), (bytes(range(40)), "x")]
    df = spark.createDataFrame([(bytearray(d), e) for d, e in rows], "data binary, encoding string")

    def dump(d):
        return "\n".join(f"{o:08x}  {' '.join(f'{x:02x}' for x in d[o : o + 16]):<47}  {''.join(chr(x) if 0x20 <= x < 0x7F else '.' for x in d[o : o + 16])}" for o in range(0, len(d), 16))

    want = ['{"b":1}', "é", dump(rows[2][0]), "{", "plain", "plain", dump(b"ab"), "", dump(bytes(range(40)))]
    assert [r[0] for r in df.select(fn.payload_text(F.col("data"), F.col("encoding"))).collect()] == want
    long = spark.createDataFrame([(bytearray(b"x" * 5000),)], "data binary").select(fn.hex_dump(F.col("data"))).first()[0]
    assert len(long.split("\n")) == 256


def test_custom_maps_both_ways(spark):
    text = '{"a":1,"b":1.5,"c":"x \\"y\\"","d":true}'
    assert one(spark, fn.custom_json(fn.custom_from_json(F.lit(text)))) == text


def test_dead_letter_key_bytes(spark):
    from flowloom.sources.wire import dead_key_bytes

    key = {"failed_at_ms": 1_705_000_000_123, "queue": "é-queue", "job_id": "j-1"}
    assert bytes(one(spark, fn.dead_letter_key(F.col("f"), F.col("q"), F.col("j")), f=key["failed_at_ms"], q=key["queue"], j=key["job_id"])) == dead_key_bytes(key)


def test_keys_and_roles(spark):
    keys = lambda v: F.lit(None).cast("array<string>") if v is None else F.array(*map(F.lit, v)).cast("array<string>")
    assert [one(spark, fn.key_allowed(keys(v), F.lit("k"))) for v in (None, [], ["k"], ["x"])] == [True, False, True, False]
    assert [one(spark, fn.role_allows(F.lit(a), F.lit(b))) for a, b in (("admin", "viewer"), ("viewer", "admin"), ("x", "viewer"))] == [True, False, False]


def test_frames_to_files(spark, sf_dir, tmp_path):
    import json

    from flowloom.plans import catalog
    from flowloom.streaming.sinks import write_frames

    frames = catalog.queries()["stats_frames_hourly"](spark, sf_dir)
    n = frames.count()
    frames.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    write_frames(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == n and {"ts_ms", "queues"} == set(json.loads(back.first()["frame"]))
