"""Near-duplicate documents by SetSketch bands, joint likelihood and full verification.

1. Each text becomes its set of 5-word shingles, a 128-bit identity of that set
   and its registers. Equal sets are one class, whose least id represents it; a
   class of any size is one row from here on.
2. Class registers are cut into bands. A band value shared by several classes is
   a bucket; every member is paired with the bucket's least member only.
3. A pair goes on if size bounds allow the similarity and the joint likelihood
   estimate is within ``ESTIMATE_MARGIN`` of it (four standard deviations), and is
   then decided on both full sets.
4. Confirmed links give components. Only a bucket that still holds several
   components can hide another link, and only between members of different ones.
5. Members of such open buckets are held to their prefixes: with shingles in order
   of rarity among all these members, two sets similar enough share one of the
   first n - ceil(0.75 n) + 1 of either. A member that shares none of these with a
   member of another component has no link to find and leaves; what many have in
   common (a template, say) is no one's rarity.
6. Buckets that are still open are cut into tiles of bounded rows and bytes, a tile
   for each two parts of a bucket. A tile estimates all pairs of different components
   on registers, takes promising ones by falling agreement, verifies them on full
   sets and skips those it has connected meanwhile, so that it gives at most one
   link for each row. A tile copies its rows, so here alone work grows with the
   square of a bucket's parts: of members that do share rare shingles.

Joins in which one key can hold many rows (the hub of a star, a large bucket) deal
that key's rows to as many tasks as they need, with a copy of the other side each.

Defined results: null and wordless texts have no set, ``n_shingles`` 0 and link
with nothing. Rows that share an id count as one document and get its component.
A row with a null id takes part through its class; its component is that of its
class if the class has an id, else null, and it is kept if its component is null.
Ties cannot occur: the least id represents. Empty tables give empty tables;
columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import setsketch
from .bytetext import SPACED, U64, Words, mix, sequence_hash, slices, windows
from .components import components
from .scratch import Scratch, small_batches

SHINGLE_WORDS = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
ESTIMATE_MARGIN = 0.13
#: Rows and bytes of sets in a part of a bucket; a tile holds two parts.
PART_ROWS, PART_BYTES = 256, 8 << 20
#: Rows of one key that a join leaves together.
HOT_ROWS = 1000
#: Ids of documents to be verified, and open buckets, are broadcast up to this many, and joined by shuffle beyond.
BROADCAST_IDS = 500_000


def shingle_sets(words: Words) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    h = words.hashes()
    runs = windows(h, SHINGLE_WORDS)
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= SHINGLE_WORDS:
            s = np.sort(runs[a : b - SHINGLE_WORDS + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield sequence_hash(h[a:b])
        else:
            yield np.zeros(0, U64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, "__text"):
            sets = list(shingle_sets(Words(texts, SPACED, lower=True)))
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            regs: list[bytes | None] = [None] * len(sets)
            keys = np.zeros((2, len(sets)), U64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                found = setsketch.registers(flat, starts)
                for i, r in zip(full.tolist(), found):
                    regs[i] = r.tobytes()
                keys[0, full] = np.add.reduceat(flat, starts)
                keys[1, full] = np.add.reduceat(mix(flat ^ U64(0x5851F42D4C957F2D)), starts)
            empty = sizes == 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(keys[0].view(np.int64), mask=empty),
                    pa.array(keys[1].view(np.int64), mask=empty),
                    pa.array(regs, pa.binary()),
                ],
                ["id", "n", "k1", "k2", "regs"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        regs = _matrix(batch.column(1))
        keys = setsketch.bands(regs)
        rows = np.repeat(np.arange(len(regs)), setsketch.BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows))], ["key", "id", "n"])


def _matrix(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(-1, setsketch.REGISTERS)


def _estimated(batch: pa.RecordBatch) -> np.ndarray:
    a, b = _matrix(batch.column("regs_a")), _matrix(batch.column("regs_b"))
    n, m = (np.asarray(batch.column(c)).astype(float) for c in ("n_a", "n_b"))
    return setsketch.at_least(a, b, n, m, PERCENT / 100 - ESTIMATE_MARGIN)


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield batch.select(["a", "b"]).filter(pa.array(_estimated(batch)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, "__text"):
            sets = [s.tobytes() for s in shingle_sets(Words(texts, SPACED, lower=True))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "set"])


def _shared_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a batch's sets hold each shingle."""
    for batch in batches:
        if batch.num_rows:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), U64)
            token, n = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            sets = [np.frombuffer(x, U64) for x in part.column("set").to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            flat = np.concatenate(sets) if sets else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("k").take(rows), pa.array(flat.view(np.int64)), pa.array([len(sets[i]) for i in rows.to_pylist()], pa.int64())], ["id", "k", "token", "n"])


def prefix_length(n):
    """Shingles of a set of n of which a similar set must share one; of a number or a column."""
    least = F.ceil(n * PERCENT / 100) if not isinstance(n, int) else -(-n * PERCENT // 100)
    return n - least + 1


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted distinct sets are similar enough."""
    n = len(a) + len(b)
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (n - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("set_a"), batch.column("set_b")
        keep = [linked(np.frombuffer(left[i].as_buffer(), U64), np.frombuffer(right[i].as_buffer(), U64)) for i in range(batch.num_rows)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def tile_links(band: int, components: np.ndarray, regs: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between rows of different components that connect whatever the rows' sets connect.

    Two rows may meet in several bands; only the first band in which they agree decides on them.
    """
    root = {c: c for c in components.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    rows, cols, guess = [], [], []
    for i in range(len(sizes) - 1):
        other = np.arange(i + 1, len(sizes))
        near = 100 * np.minimum(sizes[i], sizes[other]) >= PERCENT * np.maximum(sizes[i], sizes[other])
        other = other[near & (components[other] != components[i])]
        if len(other):
            own, size = np.broadcast_to(regs[i], (len(other), regs.shape[1])), np.full(len(other), float(sizes[i]))
            other = other[setsketch.at_least(own, regs[other], size, sizes[other].astype(float), PERCENT / 100 - ESTIMATE_MARGIN)]
            agree = (regs[other] == regs[i]).reshape(-1, setsketch.BANDS, setsketch.BAND_ROWS).all(axis=2)
            other = other[np.argmax(agree, axis=1) == band]
            rows.append(np.full(len(other), i))
            cols.append(other)
            guess.append((regs[other] == regs[i]).sum(axis=1))
    out: list[tuple[int, int]] = []
    if rows:
        x, y, g = np.concatenate(rows), np.concatenate(cols), np.concatenate(guess)
        for k in np.argsort(-g, kind="stable").tolist():
            i, j = int(x[k]), int(y[k])
            a, b = find(components[i].item()), find(components[j].item())
            if a != b and linked(sets[i], sets[j]):
                root[a] = b
                out.append((i, j))
    return out


def _tile(table: pa.Table) -> pa.Table:
    ids = table.column("id")
    _, components = np.unique(np.array(table.column("component").to_pylist(), dtype=object), return_inverse=True)
    regs = _matrix(table.column("regs"))
    sets = [np.frombuffer(x, U64) for x in table.column("set").to_pylist()]
    band = table.column("key")[0].as_py() >> (8 * setsketch.BAND_ROWS)
    found = tile_links(band, components, regs, np.array([len(x) for x in sets]), sets)
    take = lambda side: ids.take(pa.array([p[side] for p in found], pa.int64()))
    return pa.table({"a": take(0), "b": take(1)})


SIZED = f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)"


class _Job:
    def __init__(self, df: DataFrame, id_col: str, text_col: str):
        self.spark = df.sparkSession
        small_batches(self.spark)
        self.scratch = Scratch(self.spark, "near-duplicates")
        self.texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
        self.id = df.schema[id_col].dataType
        self.round = 0

    def _schema(self, *fields: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t in fields])

    def sketch(self) -> None:
        long, raw = T.LongType(), T.BinaryType()
        schema = self._schema(("id", self.id), ("n", long), ("k1", long), ("k2", long), ("regs", raw))
        self.sketches = self.scratch.write(self.texts.mapInArrow(_sketch, schema), "sketches")
        self.classes = self.scratch.write(
            self.sketches.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes"
        )
        # One sketch for each representative: the row of its id within its class.
        reps = self.classes.where("rep is not null").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep")
        one = self.sketches.where("id is not null and n > 0").join(
            reps, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("id") == F.col("rep"))
        )
        # An id that represents two classes (rows that share an id) stays one node with both sketches.
        self.reps = self.scratch.write(one.select("id", "regs", "n").dropDuplicates(["id", "regs"]), "reps")
        self.bands = self.scratch.write(
            self.reps.mapInArrow(_bands, self._schema(("key", long), ("id", self.id), ("n", long))), "bands"
        )
        self.buckets = self.scratch.write(
            self.bands.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("members")).where("least <> most"),
            "buckets",
        )
        self.members = self.scratch.write(self.dealt(self.bands, self.buckets.select("key", "least", "members"), "key", "id"), "members")
        self.scratch.drop("bands")

    def dealt(self, rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
        """rows joined with a table of few rows a key; a key with many rows is dealt to several tasks by another column."""
        self.round += 1
        many = rows.groupBy(F.col(key).alias("__key")).agg(F.ceil(F.count(F.lit(1)) / HOT_ROWS).cast("int").alias("__parts")).where("__parts > 1")
        many = self.scratch.write(many, f"many-{self.round}")
        n = many.count()
        if not n:
            return rows.join(table, key)
        many = F.broadcast(many) if n <= BROADCAST_IDS else many
        parts = lambda df: df.join(many, df[key] == F.col("__key"), "left").withColumn("__parts", F.coalesce("__parts", F.lit(1))).drop("__key")
        left = parts(rows).withColumn("__part", F.pmod(F.xxhash64(by), F.col("__parts")).cast("int")).drop("__parts")
        right = parts(table).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
        return left.join(right, [key, "__part"]).drop("__part")

    def side(self, table: DataFrame, s: str) -> DataFrame:
        return table.select(*[F.col(c).alias(s if c == "id" else f"{c}_{s}") for c in table.columns])

    def sets(self, ids: DataFrame, name: str) -> DataFrame:
        """(id, set) of the documents asked for, from their whole texts."""
        asked = self.scratch.write(ids.distinct(), f"asked-{name}")
        few = asked.count() <= BROADCAST_IDS
        texts = self.texts.join(F.broadcast(asked) if few else asked, "id", "left_semi")
        schema = self._schema(("id", self.id), ("set", T.BinaryType()))
        sets = self.scratch.write(texts.mapInArrow(_sets, schema).dropDuplicates(["id", "set"]), f"sets-{name}")
        self.scratch.drop(f"asked-{name}")
        return sets

    def verified(self, pairs: DataFrame, known: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        small_batches(self.spark, 128)
        joined = self.dealt(pairs.join(self.side(known, "b"), "b"), self.side(known, "a"), "a", "b")
        links = self.scratch.write(joined.mapInArrow(_verify, self.pair).distinct(), name)
        self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        return links

    def link(self) -> DataFrame:
        """(node, component) of every document with a link to a different set."""
        self.pair = self._schema(("a", self.id), ("b", self.id))
        star = self.members.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
        found = self.star(star, "first")
        rest = self.open(self.members.where("members > 2").select("key", "id", "n"), found, "rest")
        self.scratch.drop("members", "buckets", "bands")
        if not rest.isEmpty():
            sets = self.sets(rest.select("id"), "rest")
            known = self.scratch.write(self.reps.join(sets, "id"), "known")
            self.scratch.drop("sets-rest")
            rest = self.meeting(rest, self.prefixes(known))
            if not rest.isEmpty():
                found = self.joined(found, self.tiled(rest, known), "found-tiles")
            self.scratch.drop("known", "prefixes", "tiles")
        self.scratch.drop("reps")
        return found

    def star(self, star: DataFrame, name: str) -> DataFrame:
        """(node, component) by the confirmed links among pairs (a, b)."""
        pairs = self.dealt(star.join(self.side(self.reps, "b"), "b"), self.side(self.reps, "a"), "a", "b").where(SIZED)
        hopeful = self.scratch.write(pairs.mapInArrow(_promising, self.pair).distinct(), f"hopeful-{name}")
        sets = self.sets(hopeful.select(F.col("a").alias("id")).unionByName(hopeful.select(F.col("b").alias("id"))), name)
        links = self.verified(hopeful, sets, f"links-{name}")
        self.scratch.drop(f"sets-{name}", f"hopeful-{name}")
        return self.scratch.write(components(links, self.scratch, name), f"found-{name}")

    def prefixes(self, known: DataFrame) -> DataFrame:
        """(key, id, n): each member under its rarest shingles, as many as two similar sets must share one of."""
        long = T.LongType()
        often = known.select("set").mapInArrow(_shared_out, self._schema(("token", long), ("n", long))).groupBy("token").agg(F.sum("n").alias("often")).where("often > 1")
        often = self.scratch.write(often, "often")
        schema = self._schema(("id", self.id), ("k", long), ("token", long), ("n", long))
        # An id that stands for two sets has the prefixes of both, each in its own order.
        flat = known.select("id", F.xxhash64("set").alias("k"), "set").mapInArrow(_exploded, schema)
        shared = self.dealt(flat, often, "token", "id")
        # Shingles of one member only come first in the order and are no one's bucket, so they are but counted.
        ranked = shared.groupBy("id", "k", "n").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("s"))
        alone = F.col("n") - F.size("s")
        took = F.greatest(prefix_length(F.col("n")) - alone, F.lit(0)).cast("int")
        rows = ranked.select("id", "n", F.explode(F.slice("s", 1, took)).alias("x")).select(F.col("x.token").alias("key"), "id", "n")
        rows = self.scratch.write(rows.distinct(), "prefixes")
        self.scratch.drop("often")
        return rows

    def meeting(self, rest: DataFrame, prefixes: DataFrame) -> DataFrame:
        """Rows of open buckets whose members share a prefix shingle with a member of another component, where buckets stay open."""
        own = rest.select(F.col("id").alias("own"), "component").distinct()
        placed = self.scratch.write(prefixes.join(own, F.col("id") == F.col("own")).select("key", "id", "component"), "placed-prefixes")
        met = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        ids = self.scratch.write(self.dealt(placed, met, "key", "id").select("id").distinct(), "meeting")
        few = ids.count() <= BROADCAST_IDS
        left = self.scratch.write(rest.join(F.broadcast(ids) if few else ids, "id", "left_semi"), "left")
        still = left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        out = self.scratch.write(self.dealt(left, still, "key", "id"), "still")
        self.scratch.drop("placed-prefixes", "left", "meeting")
        return out

    def joined(self, found: DataFrame, links: DataFrame, name: str) -> DataFrame:
        every = links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return self.scratch.write(components(every, self.scratch, f"{name}-steps"), name)

    def open(self, members: DataFrame, found: DataFrame, name: str) -> DataFrame:
        """Members, with components, of buckets in which several components meet."""
        placed = members.join(found, F.col("id") == F.col("node"), "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
        placed = self.scratch.write(placed, f"placed-{name}")
        mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        mixed = self.scratch.write(mixed, f"mixed-{name}")
        n = mixed.count()
        if not n:
            rest = placed.limit(0)
        elif n <= BROADCAST_IDS:  # with few open buckets their table goes to the rows
            rest = placed.join(F.broadcast(mixed), "key")
        else:
            rest = self.dealt(placed, mixed, "key", "id")
        rest = self.scratch.write(rest, name)
        self.scratch.drop(f"placed-{name}", f"mixed-{name}")
        return rest

    def tiled(self, rest: DataFrame, known: DataFrame) -> DataFrame:
        """Links found in tiles of the open buckets."""
        parts = rest.groupBy("key").agg(
            F.greatest(F.ceil(F.count(F.lit(1)) / PART_ROWS), F.ceil(F.sum("n") * 8 / PART_BYTES)).cast("int").alias("parts")
        )
        parts = self.scratch.write(parts, "parts")
        few = parts.count() <= BROADCAST_IDS
        spread = (rest.join(F.broadcast(parts), "key") if few else self.dealt(rest, parts, "key", "id")).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
        # A row of part p stands in the tiles (p, q) and (q, p) of all parts q, each named by its lower part first.
        spread = spread.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        spread = spread.select("key", F.least("part", "q").alias("lo"), F.greatest("part", "q").alias("hi"), "id", "component")
        rows = spread.join(known.select("id", "regs", "set"), "id").select("key", "lo", "hi", "id", "component", "regs", "set")
        return self.scratch.write(rows.groupBy("key", "lo", "hi").applyInArrow(_tile, self.pair).distinct(), "tiles")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept of each row of df."""
    job = _Job(df, id_col, text_col)
    job.sketch()
    found = job.link()
    # Only classes of several rows or with links need looking up; any other row is its own component.
    classes = job.classes.join(found, F.col("rep") == F.col("node"), "left").where("rows > 1 or component is not null")
    classes = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.coalesce("component", "rep").alias("component"))
    s = job.sketches.select("id", "n", "k1", "k2")
    joined = s.join(classes, (s["k1"] == classes["c1"]) & (s["k2"] == classes["c2"]), "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )
