"""Benchmark decontamination as a prefix-filtered set join over item-sized windows.

A window is 10 consecutive words of an item (all of a shorter item). Containment
must be whole, so the necessary prefix of a window is its single rarest word:
a document that lacks it cannot contain the window. Two scans do the work:

1. how many documents hold each benchmark word (partial counts per partition,
   over all documents), which orders every window's words by rarity;
2. the join: only document positions that hold some window's prefix word become
   candidates; the positional bound (the window must begin and end inside the
   text) and the words themselves, one by one, decide.

The benchmark is broadcast in blocks of at most ``BLOCK_BYTES`` of item text;
one block is the usual case. More items mean more blocks, each joined with all
documents, and per-document results of the blocks are merged by id.

Defined results: null or wordless texts have no words and no hits; items without
words have no windows; a null item_id names the item ``""``; several rows with
one item_id are one item with the windows of all; with several blocks rows that
repeat a doc_id and text get the same answer each; either table may be empty;
columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .bytetext import ALNUM, U64, Words, buffers, slices
from .scratch import small_batches

WINDOW_WORDS = 10
#: Item text broadcast at once; beyond it, items go in several blocks.
BLOCK_BYTES = 16 << 20


@dataclass
class Index:
    """The windows of one block of items, by their rarest word."""

    vocab: np.ndarray  # sorted word hashes
    words: np.ndarray  # windows x WINDOW_WORDS, ranks in vocab, -1 beyond a window's length
    lengths: np.ndarray
    items: np.ndarray  # window -> item
    names: list[str]
    offset: np.ndarray | None = None  # where in its window the prefix word stands
    by_word: np.ndarray | None = None  # vocab rank -> range in order
    order: np.ndarray | None = None

    def arrange(self, rarity: np.ndarray) -> None:
        """Choose each window's rarest word (the first place of the least count) and group windows by it."""
        cost = np.where(self.words >= 0, rarity[np.maximum(self.words, 0)], np.iinfo(np.int64).max)
        self.offset = np.argmin(cost, axis=1)
        prefix = self.words[np.arange(len(self.words)), self.offset]
        self.order = np.argsort(prefix, kind="stable")
        self.by_word = np.searchsorted(prefix[self.order], np.arange(len(self.vocab) + 1))


def build_index(items: list[tuple[str | None, str | None]], k: int = WINDOW_WORDS) -> Index:
    texts = buffers(pa.array([t or "" for _, t in items], pa.large_string()))
    words = Words(texts, ALNUM, lower=True)
    h = words.hashes()
    vocab = np.unique(h)
    ids = np.searchsorted(vocab, h)
    names = sorted({i or "" for i, _ in items})
    place = {x: j for j, x in enumerate(names)}
    seen: dict[tuple[int, bytes], None] = {}
    for row, (item, _) in enumerate(items):
        own = ids[words.bounds[row] : words.bounds[row + 1]]
        width = min(k, len(own))
        if width:
            for w in np.lib.stride_tricks.sliding_window_view(own, width):
                seen[place[item or ""], w.tobytes()] = None
    grid = np.full((len(seen), k), -1, np.int64)
    lengths = np.zeros(len(seen), np.int64)
    owner = np.zeros(len(seen), np.int64)
    for j, (item, raw) in enumerate(seen):
        w = np.frombuffer(raw, np.int64)
        grid[j, : len(w)], lengths[j], owner[j] = w, len(w), item
    return Index(vocab, grid, lengths, owner, names)


def _ranks(index: Index, h: np.ndarray) -> np.ndarray:
    """Ranks in the benchmark vocabulary, -1 for other words."""
    if not len(index.vocab):
        return np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(index.vocab, h), len(index.vocab) - 1)
    return np.where(index.vocab[at] == h, at, -1)


def occurrences(index: Index, ranks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window inside one text."""
    known = np.flatnonzero(ranks >= 0)
    r = ranks[known]
    n = index.by_word[r + 1] - index.by_word[r]
    if not n.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.repeat(index.by_word[r] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    window = index.order[first]
    at = np.repeat(known, n)
    start = at - index.offset[window]
    text = np.searchsorted(bounds, at, side="right") - 1
    ok = (start >= bounds[text]) & (start + index.lengths[window] <= bounds[text + 1])
    start, window = start[ok], window[ok]
    for j in range(index.words.shape[1]):
        want = index.words[window, j]
        ok = (want < 0) | (ranks[np.minimum(start + j, len(ranks) - 1)] == want)
        start, window = start[ok], window[ok]
    return start, window


def _counter(shared, text_col: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        total = np.zeros(len(index.vocab), np.int64)
        for batch in batches:
            for _, texts in slices(batch, text_col):
                words = Words(texts, ALNUM, lower=True)
                r = _ranks(index, words.hashes())
                own = words.owner()[r >= 0]
                pairs = np.unique(own * len(index.vocab) + r[r >= 0]) if len(index.vocab) else own[:0]
                total += np.bincount(pairs % max(len(index.vocab), 1), minlength=len(total))[: len(total)]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["rank", "n"])

    return count


def _joiner(shared, text_col: str):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for part, texts in slices(batch, text_col):
                words = Words(texts, ALNUM, lower=True)
                start, window = occurrences(index, _ranks(index, words.hashes()), words.bounds)
                n = len(words.starts)
                edge = np.bincount(start, minlength=n + 1) - np.bincount(start + index.lengths[window], minlength=n + 1)
                hit = np.cumsum(edge[:n]) > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                text = np.searchsorted(words.bounds, start, side="right") - 1
                pairs = np.unique(text * max(len(index.names), 1) + index.items[window])
                items: list[list[str]] = [[] for _ in range(len(texts))]
                for p in pairs.tolist():
                    items[p // len(index.names)].append(index.names[p % len(index.names)])
                spans: list[list[dict]] = [[] for _ in range(len(texts))]
                for t in np.unique(text).tolist():
                    a, b = words.bounds[t], words.bounds[t + 1]
                    flips = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)))
                    spans[t] = [{"first": int(x), "end": int(y)} for x, y in zip(flips[::2], flips[1::2])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in part.schema.names if c != text_col),
                        pa.array(words.counts()),
                        pa.array(total[words.bounds[1:]] - total[words.bounds[:-1]]),
                        pa.array(items, pa.list_(pa.string())),
                        pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                    ],
                    [*(c for c in part.schema.names if c != text_col), "n_words", "n_hit", "items", "spans"],
                )

    return join


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded text, streamed to the driver one partition at a time."""
    block: list[tuple[str, str]] = []
    held = 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        size = len(text.encode())
        if block and held + size > most:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += size
    yield block


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    carry: list[str] | None = None,
) -> DataFrame:
    """Per row of df: id, n_words, n_hit, items (sorted names) and spans (hit word ranges).

    Columns named in ``carry`` come back in a struct column ``row``.
    """
    spark: SparkSession = df.sparkSession
    small_batches(spark)
    # A hash of the text tells apart rows that repeat an id, when blocks are merged.
    row = [F.struct(*carry).alias("row")] if carry else []
    texts = df.select(F.col(id_col), F.xxhash64(text_col).alias("__key"), *row, F.col(text_col).alias("__text"))
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("__key", T.LongType()),
            *([texts.schema["row"]] if carry else []),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
        ]
    )
    found: list[DataFrame] = []
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        index = build_index(block)
        raw = spark.sparkContext.broadcast(index)
        counts = texts.select("__text").mapInArrow(_counter(raw, "__text"), "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n"))
        rarity = np.zeros(len(index.vocab), np.int64)
        for rank, n in counts.collect():  # at most one row for each word of the block
            rarity[rank] = n
        index.arrange(rarity)
        raw.unpersist()
        found.append(texts.mapInArrow(_joiner(spark.sparkContext.broadcast(index), "__text"), schema))
    if len(found) == 1:
        return found[0].drop("__key")
    return _merged(found, id_col)


def _merged(found: list[DataFrame], id_col: str) -> DataFrame:
    """Unite the blocks' hits: the union of item names and of spans, per row id and text."""
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    # Each block returns one row for each input row, so the first block's rows carry the multiplicity.
    key = [F.col(id_col), F.col("__key")]
    hits = every.where("n_hit > 0").groupBy(*key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"),
    )
    union = F.aggregate(
        "spans",
        F.array().cast("array<struct<first:bigint,end:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["first"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    hits = hits.select(F.col(id_col).alias("__id"), F.col("__key").alias("__k"), "items", union.alias("spans"))
    rows = found[0].drop("n_hit", "items", "spans")
    joined = rows.join(hits, rows[id_col].eqNullSafe(hits["__id"]) & (rows["__key"] == hits["__k"]), "left")
    empty_items = F.array().cast("array<string>")
    empty_spans = F.array().cast("array<struct<first:bigint,end:bigint>>")
    spans = F.coalesce("spans", empty_spans)
    return joined.select(
        id_col,
        *(["row"] if "row" in rows.columns else []),
        "n_words",
        F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"]).alias("n_hit"),
        F.coalesce("items", empty_items).alias("items"),
        spans.alias("spans"),
    )
