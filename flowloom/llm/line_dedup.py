"""Line dedup by site-relative frequency.

A line is boilerplate on a host if the pages of that host that contain it are more
than its ratio of all pages of the host. The ratio is ``ratio`` for short lines and
halves for every ``HALVING`` characters beyond ``SHORT``: the longer a line, the less
likely pages that have nothing to do with each other hold it by chance. Every
occurrence on that host goes. Lines are compared whole, without white space at
either end; a line of white space only is never counted and never dropped.

Copies of one page are one page here, else their own text would be their
boilerplate, and nothing of them would be left. What tells pages apart, as a line
sees them, is the least and the greatest digest among their other lines: pages
that differ in few lines mostly share both. A line counts once for each least
digest, and goes only if these are at least ``LEAST_PAGES`` (``LEAST_LONG`` for lines
of ``LONG`` characters), no fewer than a third of its pages, and their greatest
digests are not all the same. So a page of one line never counts.

Counts are partial sums per (host and line, least digest), so a hot host or line is
added up before it is shuffled and then dealt by digests. Boilerplate keys are
broadcast as sorted arrays up to ``BROADCAST_LINES``, and rows look them up where they
lie; beyond, lines meet them in a join by key, and pages get the keys of their own
lines in a join by page.

Defined results: pages with a null host are one host of their own; a null text
stays null with 0 lines; a text whose lines all go becomes ``""``; repeated rows
are copies; an empty table stays empty; all input columns are passed on, but for
those named n_lines or n_dropped, which give way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .scratch import Scratch, small_batches

RATIO, SHORT, HALVING = 0.01, 24, 24
LEAST_PAGES, LEAST_LONG, LONG = 5, 3, 150
BROADCAST_LINES = 1_000_000
ENDS = " \t\r\x0b\x0c"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; null if it has none."""
    host = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.lower(host))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(ENDS))


def _tag(host: Column) -> Column:
    """What a line's digest begins with; no line holds a line end, so hosts and lines cannot run together."""
    return F.concat(F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit("n")), F.lit("\n"))


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def boilerplate(df: DataFrame, host_col: str, text_col: str, ratio: float = RATIO) -> DataFrame:
    """(host, key, pages, distinct, total) of every boilerplate line; key is the digest of host and line."""
    pages = df.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    total = pages.groupBy(F.col("host").alias("h")).agg(F.count(F.lit(1)).alias("total"))
    bare = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _bare), lambda x: x != ""))
    tag = _tag(F.col("host"))
    keyed = pages.select("host", F.transform(bare, lambda x: F.struct(F.md5(F.concat(tag, x)).alias("key"), F.length(x).alias("chars"))).alias("own"))
    sorted_ = keyed.select("host", "own", F.sort_array(F.transform("own", lambda x: _short(x["key"]))).alias("all"))
    rows = sorted_.select("host", "all", F.explode("own").alias("x")).select("host", "x.key", "x.chars", "all", _short(F.col("x.key")).alias("g"))
    n = F.size("all")
    least = F.when(F.col("g") == F.get("all", F.lit(0)), F.get("all", F.lit(1))).otherwise(F.get("all", F.lit(0)))
    most = F.when(F.col("g") == F.get("all", n - 1), F.when(n > 1, F.get("all", n - 2))).otherwise(F.get("all", n - 1))
    rows = rows.select("host", "key", "chars", least.alias("least"), most.alias("most"))
    kinds = rows.groupBy("host", "key", "least").agg(F.max("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.min("most").alias("lo"), F.max("most").alias("hi"))
    counted = kinds.groupBy("host", "key").agg(
        F.max("chars").alias("chars"), F.sum("n").alias("pages"), F.count("least").alias("distinct"), (F.min("lo") < F.max("hi")).alias("differ")
    )
    often = counted.where((F.col("distinct") >= F.when(F.col("chars") >= LONG, LEAST_LONG).otherwise(LEAST_PAGES)) & F.col("differ") & (3 * F.col("distinct") >= F.col("pages")))
    share = F.lit(ratio) * F.pow(F.lit(2.0), -F.greatest(F.col("chars") - SHORT, F.lit(0)) / float(HALVING))
    met = often.join(total, F.col("host").eqNullSafe(F.col("h"))).where(F.col("distinct") > share * F.col("total"))
    return met.select("host", "key", "pages", "distinct", "total")


def _cutter(shared, host_col: str, text_col: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = shared.value
        for batch in batches:
            texts = batch.column(text_col).cast(pa.binary())
            pages = [None if t is None else t.split(b"\n") for t in texts.to_pylist()]
            tags = [b"n\n" if h is None else f"h{h}\n".encode() for h in batch.column("__host").to_pylist()]
            bare = [[x.strip(ENDS.encode()) for x in p or ()] for p in pages]
            digests = b"".join(hashlib.md5(tag + x).digest() for tag, p in zip(tags, bare) for x in p)
            asked = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64)
            at = np.searchsorted(high, asked[:, 0])
            hit = np.zeros(len(asked), bool)
            while len(high):  # keys that share their first half follow each other
                same = (at < len(high)) & (high[np.minimum(at, len(high) - 1)] == asked[:, 0])
                hit |= same & (low[np.minimum(at, len(high) - 1)] == asked[:, 1])
                if not (same & ~hit).any():
                    break
                at = at + same
            out, n_lines, n_dropped, k = [], [], [], 0
            for page, own in zip(pages, bare):
                if page is None:
                    out.append(None)
                    n_lines.append(0)
                    n_dropped.append(0)
                    continue
                keep = [x for x, b, h in zip(page, own, hit[k : k + len(page)].tolist()) if not (h and b)]
                k += len(page)
                out.append(b"\n".join(keep))
                n_lines.append(len(page))
                n_dropped.append(len(page) - len(keep))
            done = {text_col: pa.array(out, pa.binary()).cast(pa.string())}
            names = [c for c in batch.schema.names if c != "__host"]
            yield pa.RecordBatch.from_arrays([*(done.get(c, batch.column(c)) for c in names), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return cut


def line_dedup(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """df with boilerplate lines cut from text_col, and n_lines, n_dropped."""
    spark = df.sparkSession
    scratch = Scratch(spark, "line-dedup")
    found = scratch.write(boilerplate(df, host_col, text_col, ratio).select("key"), "boilerplate")
    rest = df.select([c for c in df.columns if c not in ("n_lines", "n_dropped")])
    long = T.LongType()
    if found.count() <= broadcast_lines:
        small_batches(spark)
        keys = found.toArrow().column("key").to_pylist()
        halves = np.frombuffer(bytes.fromhex("".join(keys)), ">u8").reshape(-1, 2).astype(np.uint64)
        halves = halves[np.lexsort((halves[:, 1], halves[:, 0]))]
        shared = spark.sparkContext.broadcast((np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])))
        schema = T.StructType([*rest.schema.fields, T.StructField("n_lines", long), T.StructField("n_dropped", long)])
        return rest.withColumn("__host", F.col(host_col).cast("string")).mapInArrow(_cutter(shared, host_col, text_col), schema)
    pages = scratch.write(rest.withColumn("__page", F.monotonically_increasing_id()), "pages")
    tag = _tag(F.col(host_col))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col(text_col)), lambda x: _bare(x) != ""), lambda x: F.md5(F.concat(tag, _bare(x)))))
    own = pages.select("__page", F.explode(keys).alias("key")).join(found, "key", "left_semi")
    own = own.groupBy(F.col("__page").alias("__p")).agg(F.collect_set("key").alias("__keys"))  # of one page's own lines
    joined = pages.join(own, F.col("__page") == F.col("__p"), "left")
    lines = _lines(F.col(text_col))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__keys"), F.md5(F.concat(tag, _bare(x)))))
    staged = joined.withColumn("__kept", F.when(F.col("__keys").isNull(), lines).otherwise(kept))
    n = F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(lines).cast("long")), F.lit(0).cast("long"))
    return staged.select(
        *[F.array_join("__kept", "\n").alias(c) if c == text_col else F.col(c) for c in rest.columns],
        n.alias("n_lines"),
        (n - F.coalesce(F.when(F.col(text_col).isNotNull(), F.size("__kept").cast("long")), F.lit(0).cast("long"))).alias("n_dropped"),
    )
