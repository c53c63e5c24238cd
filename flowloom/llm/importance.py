"""Quality by importance resampling.

Texts are bags of hashed 1- and 2-word grams. The target model is the bucket
distribution of texts labelled good, the raw model that of all texts. A text's
weight is its log-likelihood ratio; adding Gumbel noise and keeping the k
largest keys samples k texts without replacement in proportion to the weights.

The target model is fitted on about ``TARGET_ROWS`` labelled ids at most, those whose
hash lies below a threshold that follows from their number; the raw model counts all texts. The k-th key is found by narrowing a
histogram, so keys are neither sorted nor gathered.

Defined results: null and wordless texts have weight 0; without any good label
all weights are 0 and the sample is uniform; noise is fixed by seed and id, so
rows that repeat an id get equal noise, and rows equal to the last one chosen in
key and id are all chosen; null ids share one noise, and if more than ``LAST_ROWS``
rows tie with the last one in key, all of them are chosen; an empty table stays
empty; columns other than id, text and label are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytetext import ALNUM, U64, Words, mix, slices
from .scratch import Scratch, small_batches

BUCKETS = 10_000
TARGET_ROWS = 200_000
FRACTION = 0.5
SMOOTHING = 1.0
SEED = "importance-1"
BINS = 2048
#: Rows at most that the last step of the selection takes to the driver.
LAST_ROWS = 20_000


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of all 1- and 2-grams of a slice of texts."""
    h = words.hashes()
    owner = words.owner()
    one = (h % U64(BUCKETS)).astype(np.int64)
    if len(h) < 2:
        return owner, one
    two = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])
    same = owner[:-1] == owner[1:]
    return np.concatenate([owner, owner[:-1][same]]), np.concatenate([one, (two[same] % U64(BUCKETS)).astype(np.int64)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, texts in slices(batch, "__text"):
            total += np.bincount(grams(Words(texts, ALNUM, lower=True))[1], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])


def _weigher(shared):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part, texts in slices(batch, "__text"):
                owner, bucket = grams(Words(texts, ALNUM, lower=True))
                weight = np.bincount(owner, weights=table[bucket], minlength=len(texts)).astype(np.float64)
                n = np.bincount(owner, minlength=len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(weight)], [part.schema.names[0], "n_grams", "log_weight"])

    return weigh


def _model(texts: DataFrame) -> np.ndarray:
    total = np.zeros(BUCKETS)
    for bucket, n in texts.mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        total[bucket] = n
    return (total + SMOOTHING) / (total.sum() + SMOOTHING * BUCKETS)


def cut(keys: DataFrame, k: int) -> tuple[float, object] | None:
    """The k-th row of keys (key, id) by falling key and rising id; None if there are no more than k rows."""
    if k <= 0:
        return (float("inf"), None)
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count(F.lit(1))).first()
    if n <= k:
        return None
    wanted = k
    inside = keys
    while n > LAST_ROWS and hi > lo:
        width = (hi - lo) / BINS
        spot = F.least(F.floor((F.col("key") - lo) / width), F.lit(BINS - 1))
        bins = {b: (c, x, y) for b, c, x, y in inside.groupBy(spot.alias("b")).agg(F.count(F.lit(1)), F.min("key"), F.max("key")).collect()}
        for b in sorted(bins, reverse=True):
            if bins[b][0] >= wanted:
                break
            wanted -= bins[b][0]
        n, lo, hi = bins[b]
        inside = keys.where((F.col("key") >= lo) & (F.col("key") <= hi))
    if n > LAST_ROWS:  # all of one key
        return lo, inside.agg(F.max("id")).first()[0]
    last = inside.orderBy(F.col("key").desc(), F.col("id")).limit(wanted).agg(F.min("key"), F.max_by("id", F.struct(-F.col("key"), "id"))).first()
    return last[0], last[1]


def importance_sample(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fraction: float = FRACTION, seed: str = SEED
) -> DataFrame:
    """id, n_grams, log_weight, key and chosen of each row of df."""
    spark = df.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "importance")
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(id_col).distinct()
    n_good = good.count()
    if n_good > TARGET_ROWS:
        good = good.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_003)) < int(1_000_003 * TARGET_ROWS / n_good))
    texts = df.select(id_col, F.col(text_col).alias("__text"))
    raw = _model(texts.select("__text"))
    target = _model(texts.join(F.broadcast(good), id_col, "left_semi").select("__text"))
    table = np.log(target) - np.log(raw) if n_good else np.zeros(BUCKETS)
    id_type = df.schema[id_col].dataType.simpleString()
    weighed = texts.mapInArrow(_weigher(spark.sparkContext.broadcast(table)), f"`{id_col}` {id_type}, n_grams long, log_weight double")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(2**52)
    keyed = scratch.write(weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(u))), "keyed")
    rows = keyed.count()
    last = cut(keyed.select("key", F.col(id_col).alias("id")), int(np.ceil(fraction * rows)))
    if last is None:
        chosen = F.lit(True)
    else:
        chosen = (F.col("key") > last[0]) | ((F.col("key") == last[0]) & (F.col(id_col).isNull() | (F.col(id_col) <= last[1])))
    return keyed.withColumn("chosen", F.coalesce(chosen, F.lit(False)))
