"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are words of the lower-cased text and their prefixes of 4 to 6 bytes, so
that inflected forms meet. Of all terms those stay whose presence weakly depends
on the label in the examples (chi-square), each weighted by its document frequency
over all texts. The cut is weak and does not rise with the examples, so that words
of a language with few examples stay too. Examples are an inverted index in blocks; a block's greatest weight
for each term bounds what any of its examples can score, so blocks are opened by
falling bound until none can reach the k-th best: the k nearest are exact.

Neighbours vote with weights 1 / (NEAR + 1 - cosine); votes become probabilities
by monotone regression over the examples, each judged without itself and its
copies, reweighted to the class sizes of all labelled rows.

Fitting takes at most ``EXAMPLES`` labelled texts of each class, chosen by a hash
of their id among twice as many. Of texts that share a minimum of their hashed
5-word shingles under any of three hash functions one stays, so that a group of
near copies does not pass for many examples. Ids, languages and sources are not
inputs.

Defined results: a null or wordless text, like one without any term, has no
neighbours and gets the share of label 1 among examples without terms; without
examples of both classes every score is the share of label 1 (0 if there is no
label). Labels that are null or name no row are ignored; an id labelled twice
has its larger label; repeated rows get equal scores; null ids are never examples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytetext import ALNUM, SPACED, U64, Words, mix, slices
from .language_id import held_out
from .near_duplicates import shingle_sets
from .scratch import Scratch, small_batches

EXAMPLES = 3000
#: Holds the index within the driver's memory.
MOST_TERMS = 65_536
#: A term's least chi-square (one degree of freedom) and least examples.
CHI_SQUARE, LEAST_TEXTS = 5.0, 4
PREFIXES = (4, 5, 6)
NEIGHBOURS = 15
BLOCK = 64
#: Cells of the dense matrix of the queries searched at once, and what sums of single precision may be off.
QUERY_CELLS = 1 << 20
ROUNDING = 1e-5
NEAR = 0.1
#: Votes are drawn to the prior with the weight of so many neighbours at cosine 0.
PRIOR_VOTES = 2.0
THRESHOLD = 0.7


def terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(owner, term) of every word and of its proper prefixes."""
    owner, h = words.owner(), words.hashes()
    owners, found = [owner], [h]
    size = words.ends - words.starts
    for k in PREFIXES:
        rows = np.flatnonzero(size >= k)
        cut = Words.__new__(Words)
        cut.texts, cut.data, cut.bounds = words.texts, words.data, words.bounds
        cut.starts, cut.ends = words.starts[rows], words.starts[rows] + k
        owners.append(owner[rows])
        found.append(mix(cut.hashes() + U64(k)))
    return np.concatenate(owners), np.concatenate(found)


def counted(words: Words, vocab: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, term, occurrences), each pair once; with a sorted vocab, terms are ranks in it and others drop out."""
    owner, term = terms(words)
    if vocab is not None:
        if not len(vocab):
            return owner[:0], owner[:0], owner[:0]
        at = np.minimum(np.searchsorted(vocab, term), len(vocab) - 1)
        ok = vocab[at] == term
        pair, n = np.unique(owner[ok] * len(vocab) + at[ok], return_counts=True)
        return pair // len(vocab), pair % len(vocab), n
    order = np.lexsort((term, owner))
    owner, term = owner[order], term[order]
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])])) if len(owner) else np.zeros(0, int)
    return owner[first], term[first], np.diff(np.concatenate([first, [len(owner)]]))


class BlockMaxIndex:
    """Examples as sparse unit vectors over ranked terms.

    Queries are searched many at once. A block is opened for the queries whose bound
    for it still reaches their k-th best, as one product of small dense matrices.
    Whatever comes within rounding of the k-th best is then scored once more, each
    pair by itself in double precision, so that results depend on the pair only.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], size: int):
        lead = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        self.ids = np.array(sorted(range(len(vectors)), key=lambda i: (lead[i], i)), dtype=np.int64)  # similar examples share blocks
        self.blocks = -(-len(vectors) // BLOCK)
        self.size = size
        self.top = np.zeros((size, max(self.blocks, 1)), np.float32)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t, _ in vectors])]).astype(np.int64)
        self.terms = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        self.weights = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        # The lists of a block, laid out as a small matrix: its own terms, in order, by its examples.
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []
        for b in range(self.blocks):
            own = [vectors[i] for i in self.ids[b * BLOCK : (b + 1) * BLOCK].tolist()]
            block_terms = np.unique(np.concatenate([t for t, _ in own]))
            weights = np.zeros((len(block_terms), len(own)), np.float32)
            for place, (t, w) in enumerate(own):
                weights[np.searchsorted(block_terms, t), place] = w
            self.lists.append((block_terms, weights))
            self.top[block_terms, b] = weights.max(axis=1)

    def search(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest of each of n queries, by falling cosine, then by example.

        A query is the rows of its owner number; zero cosines never count, and free places hold -1 and 0.
        """
        ids, cos = np.full((n, k), -1, np.int64), np.zeros((n, k))
        if not self.blocks or not n:
            return ids, cos
        step = max(1, QUERY_CELLS // self.size)
        cuts = np.searchsorted(owner, np.arange(0, n + step, step))
        for j, a in enumerate(range(0, n, step)):
            rows = slice(cuts[j], cuts[j + 1])
            m = min(step, n - a)
            ids[a : a + m], cos[a : a + m] = self._search(owner[rows] - a, term[rows], weight[rows], m, k)
        return ids, cos

    def _search(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        asked = np.zeros((n, self.size), np.float32)
        asked[owner, term] = weight
        bound = asked @ self.top
        scores = np.zeros((n, self.blocks * BLOCK), np.float32)
        done = np.zeros((n, self.blocks), bool)

        def open_(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                rows = np.flatnonzero(wanted[:, b])
                block_terms, weights = self.lists[b]
                scores[rows, b * BLOCK : b * BLOCK + weights.shape[1]] = asked[np.ix_(rows, block_terms)] @ weights
            np.logical_or(done, wanted, out=done)

        def kth() -> np.ndarray:
            if scores.shape[1] <= k:
                return np.zeros(n, np.float32)
            return -np.partition(-scores, k - 1, axis=1)[:, k - 1]

        # The most hopeful block of each query first, then the next ones, then all that can still matter.
        for first in (1, 4, self.blocks):
            at = np.argpartition(-bound, min(first, self.blocks) - 1, axis=1)[:, :first]
            hopeful = np.zeros_like(done)
            np.put_along_axis(hopeful, at, True, axis=1)
            open_(hopeful & ~done & (bound > 0) & (bound * (1 + ROUNDING) + ROUNDING >= kth()[:, None]))
        floor = np.maximum(kth() - ROUNDING, 0)
        row, place = np.nonzero((scores > 0) & (scores >= floor[:, None]))
        example = self.ids[place]
        size = self.starts[example + 1] - self.starts[example]
        first = np.concatenate([[0], np.cumsum(size)])
        flat = np.repeat(self.starts[example] - first[:-1], size) + np.arange(first[-1])
        exact = np.zeros((n, self.size))
        exact[owner, term] = weight
        products = exact[np.repeat(row, size), self.terms[flat]] * self.weights[flat]
        found = np.add.reduceat(products, first[:-1]) if len(row) else np.zeros(0)
        order = np.lexsort((example, -found, row))
        row, example, found = row[order], example[order], found[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        ids, cos = np.full((n, k), -1, np.int64), np.zeros((n, k))
        ids[row[keep], rank[keep]] = example[keep]
        cos[row[keep], rank[keep]] = np.minimum(found[keep], 1.0)
        return ids, cos


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the weighted monotone regression of y on x: (values of x, levels)."""
    order = np.argsort(x, kind="stable")
    at, total, mass = [], [], []
    for i in order.tolist():
        at.append([x[i]])
        total.append(weight[i] * y[i])
        mass.append(weight[i])
        while len(at) > 1 and (at[-1][0] == at[-2][-1] or total[-2] * mass[-1] >= total[-1] * mass[-2]):
            a, t, m = at.pop(), total.pop(), mass.pop()
            at[-1] = [at[-1][0], a[-1]]
            total[-1] += t
            mass[-1] += m
    xs = np.array([v for a in at for v in (a[0], a[-1])])
    ys = np.repeat(np.array(total) / np.array(mass), 2)
    return xs, ys


class Voter:
    """The fitted index, weights and calibration."""

    def __init__(self, vocab: np.ndarray, idf: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], share: dict[int, float]):
        """examples: (id, label, ranks, occurrences); share: rows that an example of each label stands for."""
        self.vocab, self.idf = vocab, idf
        some = [e for e in examples if len(e[2])]
        size = np.array([len(e[2]) for e in some], np.int64)
        owner = np.repeat(np.arange(len(some)), size)
        ranks = np.concatenate([e[2] for e in some]) if some else np.zeros(0, np.int64)
        weights = self.unit(owner, ranks, np.concatenate([e[3] for e in some]) if some else np.zeros(0), len(some))
        cuts = np.concatenate([[0], np.cumsum(size)])
        self.index = BlockMaxIndex([(ranks[a:b], weights[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], len(vocab))
        self.keys = np.array([e[0] for e in some], np.int64)
        self.labels = np.array([e[1] for e in some], float)
        self.weight = np.array([share[e[1]] for e in some])
        mass = sum(share[e[1]] for e in examples)
        self.prior = sum(share[e[1]] for e in examples if e[1] == 1) / mass if mass else 0.0
        none = [e[1] for e in examples if not len(e[2])]
        self.bare = sum(share[1] for y in none if y == 1) / sum(share[y] for y in none) if none else self.prior
        self.steps = None
        if some and len(set(self.labels)) == 2:
            ids, cos = self.index.search(owner, ranks, weights, len(some), NEIGHBOURS + 6)
            # Without itself and its copies, which keep their place but lose their vote.
            other = (ids >= 0) & (ids != np.arange(len(some))[:, None]) & (cos < 0.98)
            other &= np.cumsum(other, axis=1) <= NEIGHBOURS
            self.steps = monotone(self.votes(np.where(other, ids, -1), cos), self.labels, self.weight)

    def unit(self, owner: np.ndarray, ranks: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
        """TF-IDF weights of the rows of several texts, each text of length 1."""
        w = (1 + np.log(n)) * self.idf[ranks]
        return w / np.maximum(np.sqrt(np.bincount(owner, weights=w * w, minlength=rows)), 1e-12)[owner]

    def votes(self, ids: np.ndarray, cos: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among each row's neighbours, drawn to the prior."""
        own = np.where(ids >= 0, self.weight[ids] / (NEAR + 1 - cos), 0.0) if len(self.weight) else np.zeros(ids.shape)
        drawn = PRIOR_VOTES * (self.weight.mean() if len(self.weight) else 1.0) / (NEAR + 1)
        ones = (own * self.labels[ids]).sum(axis=1) if len(self.weight) else np.zeros(len(ids))
        return (ones + drawn * self.prior) / (own.sum(axis=1) + drawn)

    def score(self, owner: np.ndarray, ranks: np.ndarray, n: np.ndarray, rows: int) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores and evidence of texts given by (owner, rank, occurrences) rows in order of owner."""
        ids, cos = self.index.search(owner, ranks, self.unit(owner, ranks, n, rows), rows, NEIGHBOURS)
        v = self.votes(ids, cos)
        p = np.interp(v, *self.steps) if self.steps is not None else np.full(rows, self.prior)
        p = np.where(np.bincount(owner, minlength=rows) > 0, p, self.bare)
        keys, labels = (self.keys[ids], self.labels[ids]) if len(self.keys) else (ids, cos)
        shown = [
            [{"example": int(e), "label": int(y), "cosine": c} for e, y, c, i in zip(es, ys, cs, own) if i >= 0]
            for es, ys, cs, own in zip(keys[:, :3].tolist(), labels[:, :3].tolist(), cos[:, :3].tolist(), ids[:, :3].tolist())
        ]
        return p, shown


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, "__text"):
            owner, term, n = counted(Words(texts, ALNUM, lower=True))
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [part.column("k").take(rows), part.column("y").take(rows), pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "y", "term", "n"]
            )


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, "__text"):
            mins = np.zeros((3, len(texts)), U64)
            for i, s in enumerate(shingle_sets(Words(texts, SPACED, lower=True))):
                for j in range(3):
                    mins[j, i] = mix(s + U64(j + 1)).min() if len(s) else 0
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), part.column("y"), *(pa.array(m.view(np.int64)) for m in mins)], ["k", "y", "m0", "m1", "m2"]
            )


def _frequency(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        total, rows = np.zeros(len(vocab), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, texts in slices(batch, "__text"):
                total += np.bincount(counted(Words(texts, ALNUM, lower=True), vocab)[1], minlength=len(vocab))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(vocab))), pa.array(np.concatenate([[rows], total]))], ["rank", "n"])

    return count


_EVIDENCE = "array<struct<example:bigint,label:int,cosine:double>>"


def _scorer(shared):
    kind = pa.list_(pa.struct([("example", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Voter = shared.value
        for batch in batches:
            for part, texts in slices(batch, "__text"):
                owner, rank, n = counted(Words(texts, ALNUM, lower=True), model.vocab)
                scores, shown = model.score(owner, rank, n, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array(shown, kind)], [*part.schema.names[:2], "score", "evidence"])

    return score


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES) -> DataFrame:
    """id, held_out, score, predicted and evidence (the three nearest examples) of each row of df."""
    spark = df.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "toxicity")
    out = held_out(id_col, 3, 1)
    texts = df.select(F.col(id_col), out.alias("held_out"), F.col(text_col).alias("__text"))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, 3, 1))
    known = known.groupBy(id_col).agg(F.max(label_col).alias("y"))
    size = {int(r["y"]): r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Twice as many ids as examples, so that copies can be left out.
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64(id_col, F.lit(7)), id_col).limit(2 * examples) for y in (0, 1)]
    ids = F.broadcast(first[0].unionByName(first[1]))
    rows = texts.where(F.col(id_col).isNotNull()).join(ids, id_col).select("__text", F.col("y").cast("int").alias("y"), F.xxhash64("__text").alias("k"))
    rows = scratch.write(rows, "rows")
    keys = rows.mapInArrow(_signatures, "k long, y int, m0 long, m1 long, m2 long").groupBy("k").agg(F.max("y").alias("y"), *[F.min(m).alias(m) for m in ("m0", "m1", "m2")])
    for m in ("m0", "m1", "m2"):  # at most 4 * examples rows
        keys = keys.groupBy(m).agg(F.min_by(F.struct(*keys.columns), F.struct(-F.col("y"), "k")).alias("r")).select("r.*")
    keep = [keys.where(F.col("y") == y).select("k", "y").orderBy(F.xxhash64("k")).limit(examples) for y in (0, 1)]
    keep = scratch.write(keep[0].unionByName(keep[1]), "examples")
    chosen = rows.drop("y").join(F.broadcast(keep), "k").dropDuplicates(["k"])
    chosen = scratch.write(chosen.select("__text", "y", "k").mapInArrow(_example_terms, "k long, y int, term long, n long"), "chosen")
    scratch.drop("rows")
    held = {int(r["y"]): r["n"] for r in keep.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = held.get(0, 0), held.get(1, 0)
    share = {y: size.get(y, 0) / held[y] if held.get(y) else 0.0 for y in (0, 1)}
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    total = float(max(n0 + n1, 1))
    chi = total * F.pow(b * (n0 - a) - a * (n1 - b), 2) / (float(max(n0, 1)) * float(max(n1, 1)) * (a + b) * (total - a - b + 1e-9))
    by_term = chosen.groupBy("term").agg(F.sum(1 - F.col("y")).alias("a"), F.sum("y").alias("b"))
    best = by_term.where(a + b >= LEAST_TEXTS).withColumn("chi", chi).where(F.col("chi") >= CHI_SQUARE)
    best = best.orderBy(F.col("chi").desc(), "term").limit(MOST_TERMS)
    vocab = np.sort(np.array([r["term"] for r in best.select("term").collect()] if n0 and n1 else [], np.int64).view(U64))
    shared = spark.sparkContext.broadcast(vocab)
    sums = dict(texts.select("__text").mapInArrow(_frequency(shared), "rank long, n long").groupBy("rank").agg(F.sum("n")).collect())
    df_counts = np.array([sums.get(i, 0) for i in range(len(vocab))], float)
    idf = np.log((1 + sums.get(-1, 0)) / (1 + df_counts)) + 1
    place = {int(t): i for i, t in enumerate(vocab.view(np.int64).tolist())}
    table = {r["k"]: (int(r["y"]), [], []) for r in keep.collect()}
    wanted = spark.createDataFrame([(t,) for t in place] or [(0,)], "term long")
    rows = chosen.join(F.broadcast(wanted), "term").select("k", "term", "n").toArrow()
    for k, term, n in zip(*(rows.column(c).to_pylist() for c in ("k", "term", "n"))):
        if term in place:
            table[k][1].append(place[term])
            table[k][2].append(n)
    made = []
    for k, (y, ranks, n) in sorted(table.items()):
        order = np.argsort(ranks)
        made.append((k, y, np.array(ranks, np.int64)[order], np.array(n, float)[order]))
    model = spark.sparkContext.broadcast(Voter(vocab, idf, made, share))
    id_type = df.schema[id_col].dataType.simpleString()
    scored = texts.mapInArrow(_scorer(model), f"`{id_col}` {id_type}, held_out boolean, score double, evidence {_EVIDENCE}")
    return scored.select(id_col, "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
