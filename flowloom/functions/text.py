"""Labels, JSON projections and small codecs as column expressions; one Pandas UDF for the jitter hash."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

INLINE_BYTES = 4096


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp, rounded down."""
    return F.unix_millis(ts.cast("timestamp"))


def duration_ms(ms: Column) -> Column:
    """A duration; a negative one is 0."""
    return F.greatest(ms, F.lit(0)).cast("bigint")


def add_saturating(a: Column, b: Column) -> Column:
    """a + b held to the largest long, for b that is not negative."""
    return F.when(a > F.lit(2**63 - 1) - b, F.lit(2**63 - 1)).otherwise(a + b)


def base64_text(data: Column) -> Column:
    """Base64 in one line; the built-in breaks lines every 76 characters."""
    return F.translate(F.base64(data), "\r\n", "")


def payload_json(data: Column, encoding: Column, full: bool = False) -> Column:
    """Size and encoding always; the bytes in base64 if asked for in full or small."""
    inline = F.when(F.lit(full) | (F.octet_length(data) <= INLINE_BYTES), base64_text(data))
    return F.struct(F.octet_length(data).cast("bigint").alias("size"), encoding.alias("encoding"), inline.alias("data"))


def job_json(state: Column) -> Column:
    """A job as JSON; its lease only while in flight, its schedule only if it has one."""
    return F.to_json(
        F.struct(
            "job_id", "queue", "job_type", "priority", "attempt", "max_attempts", F.col("enq").alias("enqueued_at_ms"), F.col("sched").alias("scheduled_at_ms"),
            F.when(state == "inflight", F.col("lease_end")).alias("lease_expires_at_ms"), state.alias("state"),
        )
    )


def custom_from_json(text: Column) -> Column:
    """A map of typed primitives from JSON text; null if any value is no string, number or boolean, or the text no object.

    Whole numbers stay whole.
    """
    shape = F.from_json(text, "map<string,variant>")
    typed = F.transform_values(
        shape,
        lambda k, v: F.struct(
            F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).alias("s"),
            F.when(F.schema_of_variant(v).rlike("^(DOUBLE|FLOAT|DECIMAL)"), v.cast("double")).alias("d"),
            F.when(F.schema_of_variant(v) == "BIGINT", v.cast("bigint")).alias("i"),
            F.when(F.schema_of_variant(v) == "BOOLEAN", v.cast("boolean")).alias("b"),
        ),
    )
    bad = F.exists(F.map_values(shape), lambda v: ~F.schema_of_variant(v).rlike("^(STRING|DOUBLE|FLOAT|DECIMAL|BIGINT|BOOLEAN)"))
    return F.when(shape.isNotNull() & ~F.coalesce(bad, F.lit(True)), typed)


def details(text: Column) -> Column:
    """Audit details parsed, or as a plain string where they are no JSON."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


def cursor_encode(c: Column) -> Column:
    return base64_text(F.encode(c, "UTF-8"))


def cursor_decode(c: Column) -> Column:
    """Null for text that is not base64."""
    return F.decode(F.try_to_binary(c, F.lit("base64")), "UTF-8")


def etag(text: Column) -> Column:
    return F.sha2(text, 256)


def pin_path(name: Column, prefix: str) -> Column:
    """The setting an environment variable pins: PREFIX__A__B is a.b."""
    return F.when(F.startswith(name, F.lit(f"{prefix}__")), F.replace(F.lower(F.substr(name, F.lit(len(prefix) + 3))), F.lit("__"), F.lit(".")))


def exposition(name: Column, queue: Column, value: Column) -> Column:
    """A sample line of the Prometheus text format; the label's quotes, backslashes and line ends are escaped."""
    label = F.replace(F.replace(F.replace(queue, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(name, F.lit('{queue="'), label, F.lit('"} '), value.cast("string"))


def redacted(keys: Column) -> Column:
    """Access keys without their secrets."""
    return F.transform(keys, lambda k: F.struct(k["name"].alias("name"), k["role"].alias("role")))


def rate_text(rate: Column) -> Column:
    """Ten thousand and more in thousands; a hundred and more whole; below with one place."""
    return F.when(rate >= 10_000, F.concat(F.format_string("%.1f", rate / 1000), F.lit("k"))).when(rate >= 100, F.format_string("%.0f", rate)).otherwise(F.format_string("%.1f", rate))


_MASK = (1 << 64) - 1


def _rotl(x: int, n: int) -> int:
    return (x << n | x >> 64 - n) & _MASK


def siphash13(data: bytes) -> int:
    """SipHash with one compression and three final rounds under the zero key."""
    v = [0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573]

    def round_() -> None:
        v[0] = (v[0] + v[1]) & _MASK
        v[2] = (v[2] + v[3]) & _MASK
        v[1] = _rotl(v[1], 13) ^ v[0]
        v[3] = _rotl(v[3], 16) ^ v[2]
        v[0] = _rotl(v[0], 32)
        v[2] = (v[2] + v[1]) & _MASK
        v[0] = (v[0] + v[3]) & _MASK
        v[1] = _rotl(v[1], 17) ^ v[2]
        v[3] = _rotl(v[3], 21) ^ v[0]
        v[2] = _rotl(v[2], 32)

    tail = len(data) % 8
    words = [int.from_bytes(data[i : i + 8], "little") for i in range(0, len(data) - tail, 8)]
    words.append(int.from_bytes(data[len(data) - tail :], "little") | (len(data) & 0xFF) << 56)
    for m in words:
        v[3] ^= m
        round_()
        v[0] ^= m
    v[2] ^= 0xFF
    for _ in range(3):
        round_()
    return v[0] ^ v[1] ^ v[2] ^ v[3]


@F.pandas_udf(T.DecimalType(20, 0))
def jitter_hash(job_id: pd.Series, attempt: pd.Series) -> pd.Series:
    """The hash that spreads retries: of the id's bytes, 0xFF, and the attempt as a little-endian word."""
    return pd.Series([Decimal(siphash13(j.encode() + b"\xff" + int(a).to_bytes(4, "little"))) for j, a in zip(job_id, attempt)])


def jittered(capped: Column, hash_: Column) -> Column:
    """The delay less a part of at most a quarter."""
    quarter = F.floor(capped / 4).cast("decimal(20,0)")
    return (capped - F.when(quarter > 0, hash_ % (quarter + 1)).otherwise(F.lit(0)).cast("bigint")).cast("bigint")


def hex_dump(data: Column) -> Column:
    """Lines of 16 bytes: offset, hexadecimal, printable characters; the first INLINE_BYTES bytes."""
    rows = F.ceil(F.least(F.octet_length(data), F.lit(INLINE_BYTES)) / 16).cast("int")

    def line(k: Column) -> Column:
        row = F.substr(data, k * 16 + 1, F.least(F.lit(16), F.lit(INLINE_BYTES) - k * 16))
        codes = F.regexp_replace(F.lower(F.hex(row)), "(..)(?!$)", "$1 ")
        shown = F.regexp_replace(F.decode(row, "ISO-8859-1"), "[^\\x20-\\x7e]", ".")
        return F.concat(F.lpad(F.lower(F.hex(k * 16)), 8, "0"), F.lit("  "), F.rpad(codes, 47, " "), F.lit("  "), shown)

    return F.when(rows > 0, F.array_join(F.transform(F.sequence(F.lit(0), rows - 1), line), "\n")).otherwise(F.lit(""))


def payload_text(data: Column, encoding: Column) -> Column:
    """A payload to look at, by its encoding: JSON in its canonical text, text as it is, anything else as a hex dump.

    Bytes that are no UTF-8 are dumped whatever the encoding says.
    """
    text = F.try_validate_utf8(data.cast("string"))
    parsed = F.to_json(F.try_parse_json(text))
    kind = F.lower(F.coalesce(encoding, F.lit("")))
    json = F.contains(kind, F.lit("json"))
    plain = (kind == "") | F.contains(kind, F.lit("text")) | F.contains(kind, F.lit("utf")) | F.contains(kind, F.lit("plain"))
    return F.when(json & text.isNotNull(), F.coalesce(parsed, text)).when(~json & plain & text.isNotNull(), text).otherwise(hex_dump(data))


def dead_letter_json(key_b64: Column) -> Column:
    """A dead letter as JSON: its attempt is the final one, and its key names it in commands."""
    return F.to_json(
        F.struct(
            F.col("job_id").alias("id"), key_b64.alias("key_b64"), "job_type", "priority", F.col("attempt"), "max_attempts", F.col("enq").alias("enqueued_at_ms"),
            F.col("failed_at").alias("failed_at_ms"), "cause", F.col("sched").alias("scheduled_at_ms"),
        )
    )


def dead_letter_key(failed_at: Column, queue: Column, job_id: Column) -> Column:
    """The bytes of a dead letter's key: time, length of the queue's name, name, id; numbers big-endian."""
    at = F.unhex(F.lpad(F.hex(failed_at), 16, "0"))
    size = F.unhex(F.lpad(F.hex(F.octet_length(queue).cast("bigint")), 4, "0"))
    return F.concat(at, size, F.encode(queue, "UTF-8"), F.encode(job_id, "UTF-8"))


def custom_json(custom: Column) -> Column:
    """A map of typed primitives as JSON, keys in byte order; a value without a type is null."""
    text = lambda s: F.to_json(F.array(s))
    inner = lambda s: F.substr(text(s), F.lit(2), F.length(text(s)) - 2)
    value = lambda v: F.coalesce(F.when(v["s"].isNotNull(), inner(v["s"])), F.when(v["d"].isNotNull(), inner(v["d"])), v["i"].cast("string"), v["b"].cast("string"), F.lit("null"))
    parts = F.transform(F.array_sort(F.map_keys(custom)), lambda k: F.concat(inner(k), F.lit(":"), value(F.element_at(custom, k))))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


ROLES = ("viewer", "operator", "admin")


def role_allows(role: Column, needed: Column) -> Column:
    """Whether a role is at least the one needed; an unknown role allows nothing."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, ROLES)), c)
    return (rank(role) > 0) & (rank(role) >= rank(needed))


def key_allowed(keys: Column, key: Column) -> Column:
    """Without a list of keys everyone is let in; with an empty one no one is."""
    return F.when(keys.isNull(), F.lit(True)).otherwise(F.coalesce(F.array_contains(keys, key), F.lit(False)))
