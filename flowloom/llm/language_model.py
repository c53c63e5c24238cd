"""Scoring texts with a log-bilinear model trained by noise-contrastive estimation.

Tokens are lower-cased words and one end for each text.

1. Themes. A mixture of ``THEMES`` unigram models over hashed words tells kinds of
   text (languages, say) apart. It is fitted to all training texts, in ``THEME_STEPS``
   passes that deal each to its likeliest theme and take the themes' sums; about
   ``SAMPLE`` of them only give the values that the first pass starts from.
2. Exact training counts of every token, by theme of its text, added up per
   partition and shuffled by token. The most frequent, up to ``HEAD``, are
   broadcast. Of these all with ``LEAST_COUNT`` occurrences (``MOST_WORDS`` at
   most, to bound what is broadcast) are the model's words, so the vocabulary
   grows with the corpus; the others fall into one class for each theme, and all
   tokens beyond the head are the far class.
3. Training. The two words before a token and the theme of the text so far
   predict it: the sum of their vectors, scaled by place, times the vector of the
   outcome, plus its bias. The output is factored, group first, then word within
   its group of ``GROUP_WORDS`` at most, each by NCE updates in numpy with unigram
   noise shared by a minibatch. Training texts are dealt by a hash of id and text
   into ``ROUNDS`` rounds of parts of about ``PART_TOKENS`` tokens; the parts of a
   round start from the same parameters, and their changes are averaged, each
   row's by how often it was seen. So the model does not depend on how the input
   is laid out in files and partitions.
4. Scoring. Scores of all groups for each distinct context of a chunk, and of the
   words of a group for each context in which one of them stands, are matrix
   products; their log-sums normalise every token's probability.

Probabilities of all tokens add up to one, with one share for a token never seen:
in a theme's class a token has its share of the counts; in the far class counts are
discounted by N1 / (N1 + 2 N2), and what is taken off is the share of the unseen.

Counts beyond the head are joined by shuffle, as (text, token, times), so that no
table that grows without a bound is broadcast.

Defined results: a null text is empty, and an empty text is one end; without any
training text N and V are 0 and scores are those of the base; rows that repeat an
id are texts each; null ids are never held out and learned from; an empty table
stays empty; columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytetext import SPACED, U64, Words, slices
from .language_id import held_out
from .scratch import Scratch, forget_shuffles, small_batches

THEMES, SAMPLE, BUCKETS = 8, 2000, 2048
THEME_STEPS = 2
HEAD = 200_000
LEAST_COUNT, MOST_WORDS, FEWEST_WORDS = 50, 32_768, 1000
GROUP_WORDS = 128
DIM = 16
CONTEXT = 2
NOISE = 12
#: Places of the context that learn from words within groups too; all learn from groups.
PLACES = 1
BATCH = 8192
RATE = 0.015
ROUNDS, PART_TOKENS = 3, 1_000_000
#: Bytes of text handled together.
CHUNK = 4 << 20
#: Averaging: changes are added up so many parts, then so many such sums, at a time.
GROUP = 64
#: Parts of the parameter vector, each added up in tasks of its own.
PIECES = 32
END = U64(0x0E5D_0E5D_0E5D_0E5D)


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of all tokens, an END after each text's words."""
    n = len(words.texts)
    bounds = words.bounds + np.arange(n + 1)
    out = np.empty(int(bounds[-1]), U64)
    ends = bounds[1:] - 1
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = words.hashes()
    out[ends] = END
    return out, bounds


def bags(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of hashed words of each text: texts x BUCKETS."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    flat = owner * BUCKETS + ((h >> U64(20)) % U64(BUCKETS)).astype(np.int64)
    return np.bincount(flat, minlength=(len(bounds) - 1) * BUCKETS).reshape(-1, BUCKETS).astype(np.float32)


def mixture(x: np.ndarray, steps: int = 15) -> np.ndarray:
    """Log-probabilities BUCKETS x THEMES of a mixture of unigram models, from starts that lie far apart."""
    if not len(x):
        return np.zeros((BUCKETS, THEMES), np.float32)
    mean = (x.sum(axis=0) + 1) / (x.sum() + BUCKETS)
    root = np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1))
    size = x.sum(axis=1)
    far = np.where(size >= np.median(size), 2.0, 0.0)  # short texts lie far from all others by chance
    own = [int(np.argmax(far))]
    for _ in range(THEMES - 1):
        far = np.minimum(far, 1 - root @ root[own[-1]])
        own.append(int(np.argmax(far)))
    share = np.zeros((len(x), THEMES), np.float32)
    share[np.arange(len(x)), np.argmax(root @ root[own].T, axis=1)] = 1
    for _ in range(steps):
        total = share.T @ x
        theta = _smoothed(total, mean)
        like = x @ np.log(theta).T + np.log(share.sum(axis=0) + 1)
        share = np.exp(np.maximum(like - like.max(axis=1, keepdims=True), -30)).astype(np.float32)
        share /= share.sum(axis=1, keepdims=True)
    return np.log(theta).T.astype(np.float32)


def _smoothed(total: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return (total + 20 * mean) / (total.sum(axis=1, keepdims=True) + 20)


def _theme_sums(shared):
    """Counts of hashed words of all texts by the theme each is likeliest of: whole numbers, so their sums don't depend on the layout."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((THEMES, BUCKETS), np.int64)
        for batch in batches:
            for _, texts in slices(batch, "__text", CHUNK):
                x = bags(*tokens(Words(texts, SPACED, lower=True)))
                theme = np.argmax(x @ shared.value, axis=1)
                for t in np.unique(theme).tolist():
                    total[t] += x[theme == t].sum(axis=0, dtype=np.float64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(THEMES), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["theme", "x"])

    return add


def _theme_added(table: pa.Table) -> pa.Table:
    x = sum(np.frombuffer(r.as_py(), np.int64) for r in table.column("x"))
    return pa.table({"theme": table.column("theme")[:1], "x": pa.array([x.tobytes()], pa.binary())})


def fitted_themes(learn: DataFrame, theta: np.ndarray) -> np.ndarray:
    """Log-probabilities BUCKETS x THEMES after passes over all texts of learn, from the values theta."""
    spark = learn.sparkSession
    for _ in range(THEME_STEPS):
        shared = spark.sparkContext.broadcast(theta)
        sums = learn.select("__text").mapInArrow(_theme_sums(shared), "theme int, x binary").groupBy("theme").applyInArrow(_theme_added, "theme int, x binary").toArrow()
        total = np.zeros((THEMES, BUCKETS))
        for t, x in zip(sums.column("theme").to_pylist(), sums.column("x").to_pylist()):
            total[t] = np.frombuffer(x, np.int64)
        theta = np.log(_smoothed(total, (total.sum(axis=0) + 1) / (total.sum() + BUCKETS))).T.astype(np.float32)
        shared.unpersist()
    return theta


def _bagger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, "__text"):
            x = bags(*tokens(Words(texts, SPACED, lower=True)))
            yield pa.RecordBatch.from_arrays([part.column("h"), pa.array([np.minimum(r, 65535).astype(np.uint16).tobytes() for r in x], pa.binary())], ["h", "x"])


def _counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        pending = 0

        def compact():
            # The theme takes the lowest bits of a key; hashes that share all others are told apart by their order only.
            h, n = (np.concatenate([x[i] for x in held]) for i in range(2))
            order = np.lexsort((h["theme"], h["token"]))
            h, n = h[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[first], np.add.reduceat(n, first)

        for batch in batches:
            for _, texts in slices(batch, "__text", CHUNK):
                h, bounds = tokens(Words(texts, SPACED, lower=True))
                theme = np.repeat(np.argmax(bags(h, bounds) @ theta, axis=1), np.diff(bounds))
                for t in range(THEMES):
                    some, n = np.unique(h[theme == t], return_counts=True)
                    keys = np.zeros(len(some), [("token", U64), ("theme", np.int32)])
                    keys["token"], keys["theme"] = some, t
                    held.append((keys, n))
                    pending += len(some)
                if pending > 2_000_000:
                    held = [compact()]
                    pending = len(held[0][0])
                    if pending > 1_500_000:  # what does not shrink is passed on
                        yield _rows(*held[0])
                        held, pending = [], 0
        if held:
            yield _rows(*compact())

    return count


def _rows(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    token, theme = np.ascontiguousarray(h["token"]), np.ascontiguousarray(h["theme"])
    return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(theme), pa.array(n.astype(np.int64))], ["token", "theme", "n"])


class Vocabulary:
    """The head with its counts by theme, the model's words in groups, and the symbols of all tokens.

    Symbols below ``size`` are words, in order of their groups; then a class for
    each theme, the far class, and, in contexts only, the start of a text.
    """

    def __init__(self, hashes: np.ndarray, by_theme: np.ndarray, far: float):
        order = np.argsort(hashes)
        self.hashes, by_theme = hashes[order], by_theme[order].astype(float)
        self.counts = by_theme.sum(axis=1)
        n = len(hashes)
        theme = np.argmax(by_theme, axis=1) if n else np.zeros(0, np.int64)
        best = np.lexsort((self.hashes, -self.counts))
        size = min(max(int((self.counts >= LEAST_COUNT).sum()), FEWEST_WORDS), MOST_WORDS, n)
        words = best[:size]
        words = words[np.lexsort((self.hashes[words], -self.counts[words], theme[words]))]
        within = np.arange(size) - np.searchsorted(theme[words], theme[words])
        cuts = np.flatnonzero(within % GROUP_WORDS == 0)
        self.size, self.groups = size, len(cuts)
        self.group_bounds = np.concatenate([cuts, [size]]).astype(np.int64)
        self.group = np.repeat(np.arange(self.groups), np.diff(self.group_bounds))
        self.symbol = size + theme.astype(np.int64)
        self.symbol[words] = np.arange(size)
        self.word_counts = self.counts[words]
        rest = self.symbol >= size
        self.class_counts = np.bincount(theme[rest], weights=self.counts[rest], minlength=THEMES)
        self.far = size + THEMES
        self.start = self.far + 1
        # Outcomes of the first step: groups, classes of themes, the far class.
        masses = np.concatenate([np.add.reduceat(self.word_counts, cuts) if size else np.zeros(0), self.class_counts + 1, [far + 1]])
        self.masses = masses / masses.sum()
        total = by_theme.sum(axis=0) + 1
        rate = (by_theme + 0.5 * total / total.sum()) / total
        self.votes = np.log(rate / np.maximum(rate.mean(axis=1, keepdims=True), 1e-300)).astype(np.float32)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the head or -1, symbol) of tokens."""
        if not len(self.hashes):
            return np.full(len(h), -1), np.full(len(h), self.far)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        return np.where(known, at, -1), np.where(known, self.symbol[at], self.far)

    def outcome(self, symbols: np.ndarray) -> np.ndarray:
        """The first step's outcome of each symbol."""
        out = symbols - self.size + self.groups
        words = symbols < self.size
        out[words] = self.group[symbols[words]]
        return out

    def contexts(self, at: np.ndarray, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each token the symbols 1 .. CONTEXT before it in its text, and the theme of the text so far (THEMES: none)."""
        out = np.full((len(symbols), CONTEXT + 1), self.start, np.int64)
        within = np.arange(len(symbols)) - np.repeat(bounds[:-1], np.diff(bounds))
        for k in range(CONTEXT):
            ok = np.flatnonzero(within > k)
            out[ok, k] = symbols[ok - k - 1]
        if not len(self.votes) or not len(symbols):
            out[:, CONTEXT] = THEMES
            return out
        said = self.votes[at] * (at >= 0)[:, None]
        upto = np.cumsum(said, axis=0, dtype=np.float64)
        before = upto - said
        before -= np.repeat(before[bounds[:-1]], np.diff(bounds), axis=0)
        out[:, CONTEXT] = np.where(within > 0, np.argmax(np.round(before, 3), axis=1), THEMES)
        return out


class LogBilinear:
    """Vectors of context symbols, places and themes, and of groups and words with their biases."""

    NAMES = ("source", "place", "theme", "target", "bias", "word", "word_bias")

    def __init__(self, vocabulary: Vocabulary, seed: int = 5):
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        v = self.v = vocabulary
        self.source = small(v.start + 1, DIM)
        self.place = np.ones((CONTEXT, DIM), np.float32)
        self.theme = small(THEMES + 1, DIM)
        self.target, self.bias = small(len(v.masses), DIM), np.log(v.masses).astype(np.float32)
        share = v.word_counts / np.maximum(np.bincount(v.group, weights=v.word_counts, minlength=max(v.groups, 1))[v.group], 1e-12)
        self.word, self.word_bias = small(v.size, DIM), np.log(np.maximum(share, 1e-12)).astype(np.float32)
        self.shares = share

    def pack(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES]).astype(np.float64)

    def unpack(self, flat: np.ndarray) -> None:
        for k in self.NAMES:
            x = getattr(self, k)
            setattr(self, k, flat[: x.size].reshape(x.shape).astype(np.float32))
            flat = flat[x.size :]

    def spread(self, seen: dict[str, np.ndarray]) -> np.ndarray:
        """How often each parameter's row was seen, in the layout of pack()."""
        return np.concatenate([np.repeat(seen[k], getattr(self, k)[0].size) if len(seen[k]) else seen[k] for k in self.NAMES])

    def predicted(self, context: np.ndarray) -> np.ndarray:
        q = self.theme[context[:, CONTEXT]]
        for k in range(CONTEXT):
            q = q + self.source[context[:, k]] * self.place[k]
        return q

    def log_probabilities(self, context: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log of each symbol's probability after its context, normalised over all symbols."""
        v, base = self.v, self.v.start + 1
        code = context[:, CONTEXT].astype(np.int64)
        for k in range(CONTEXT):
            code = code * base + context[:, k]
        # Each distinct context is computed once: tokens in order of their contexts.
        order = np.argsort(code, kind="stable")
        new = np.flatnonzero(np.diff(code[order], prepend=-1))
        which = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
        q = self.predicted(context[order[new]])
        own = symbols[order]
        outcome = v.outcome(own.copy())
        log = self._log_shares(q, which, outcome, self.target, self.bias)
        by_group = np.argsort(outcome.astype(np.uint16), kind="stable")  # contexts stay in order within a group
        cuts = np.searchsorted(outcome[by_group], np.arange(v.groups + 1))
        for g in range(v.groups):
            rows = by_group[cuts[g] : cuts[g + 1]]
            if len(rows):
                a, b = v.group_bounds[g], v.group_bounds[g + 1]
                w = which[rows]
                first = np.flatnonzero(np.diff(w, prepend=-1))
                again = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w))))
                log[rows] += self._log_shares(q[w[first]], again, own[rows] - a, self.word[a:b], self.word_bias[a:b])
        out = np.empty(len(symbols))
        out[order] = log
        return out

    @staticmethod
    def _log_shares(q: np.ndarray, which: np.ndarray, wanted: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Log of the softmax of row which[i] of q over vectors, at wanted[i]; which rises."""
        out = np.empty(len(wanted))
        turned = np.ascontiguousarray(vectors.T)
        cuts = np.searchsorted(which, np.arange(0, len(q) + 1024, 1024))
        for j, a in enumerate(range(0, len(q), 1024)):
            s = q[a : a + 1024] @ turned
            s += bias
            s -= s.max(axis=1, keepdims=True)
            rows = slice(cuts[j], cuts[j + 1])
            at = which[rows] - a
            own = s[at, wanted[rows]]
            np.exp(s, out=s)
            out[rows] = own - np.log(s.sum(axis=1))[at]
        return out

    def train(self, context: np.ndarray, symbols: np.ndarray, state: dict, rng: np.random.Generator) -> None:
        """One pass of minibatch NCE with AdaGrad steps: groups of all tokens, then words within each group."""
        v = self.v
        outcome = v.outcome(symbols.copy())
        order = rng.permutation(len(symbols))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            self._step(context[rows], outcome[rows], state["noise"], "target", "bias", 0, state, rng)
        words = order[symbols[order] < v.size]
        words = words[np.argsort(outcome[words], kind="stable")]
        cuts = np.searchsorted(outcome[words], np.arange(v.groups + 1))
        for g in rng.permutation(v.groups).tolist():
            for a in range(cuts[g], cuts[g + 1], BATCH):
                rows = words[a : min(a + BATCH, cuts[g + 1])]
                self._step(context[rows], symbols[rows], state["groups"][g], "word", "word_bias", v.group_bounds[g], state, rng, PLACES)

    def _step(self, context, wanted, noise_model, vectors: str, biases: str, offset: int, state: dict, rng: np.random.Generator, places: int = CONTEXT) -> None:
        cumulative, log_noise = noise_model
        noise = np.searchsorted(cumulative, rng.random(NOISE)) + offset
        target, bias = getattr(self, vectors), getattr(self, biases)
        own = [self.source[context[:, k]] for k in range(CONTEXT)]
        q = self.theme[context[:, CONTEXT]]
        for k in range(CONTEXT):
            q += own[k] * self.place[k]
        t, tn = target[wanted], target[noise]
        positive = np.einsum("ij,ij->i", q, t) + (bias - self._noise_of(log_noise, offset, len(bias)))[wanted]
        gp = 1 / (1 + np.exp(np.clip(positive, -30, 30)))  # rises with the data's score
        gn = q @ tn.T
        gn += bias[noise] - log_noise[noise - offset]
        np.negative(gn, out=gn)
        np.clip(gn, -30, 30, out=gn)
        np.exp(gn, out=gn)
        gn += 1
        np.divide(-1, gn, out=gn)  # falls with the noise's
        ids = np.concatenate([wanted, noise])
        change = np.empty((len(ids), DIM + 1), np.float32)
        np.multiply(gp[:, None], q, out=change[: len(wanted), :DIM])
        change[len(wanted) :, :DIM] = gn.T @ q
        change[: len(wanted), DIM], change[len(wanted) :, DIM] = gp, gn.sum(axis=0)
        gq = gn @ tn
        t *= gp[:, None]
        gq += t
        self._move((vectors, biases), ids, change, state)
        for k in range(places):
            self._move(("source",), context[:, k], gq * self.place[k], state)
        if places == CONTEXT:
            for k in range(CONTEXT):
                self._step_by("place", np.array([k]), np.einsum("ij,ij->j", gq, own[k])[None] / len(wanted), np.array([len(wanted)]), state)
            which = np.equal.outer(np.arange(THEMES + 1), context[:, CONTEXT]).astype(np.float32)
            n = which.sum(axis=1)
            rows = np.flatnonzero(n)
            self._step_by("theme", rows, (which @ gq)[rows], n[rows], state)

    @staticmethod
    def _noise_of(log_noise: np.ndarray, offset: int, size: int) -> np.ndarray:
        out = np.zeros(size, np.float32)
        out[offset : offset + len(log_noise)] = log_noise
        return out

    def _move(self, names: tuple[str, ...], ids: np.ndarray, gradient: np.ndarray, state: dict) -> None:
        """Add up the gradient's rows by id, and step; with two names the last column is that of the second."""
        order = np.argsort(ids.astype(np.uint16), kind="stable")  # by radix; symbols are fewer than 2 ** 16
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        g = np.add.reduceat(gradient[order], first, axis=0)
        rows, n = ids[first], np.diff(np.append(first, len(ids)))
        if len(names) == 2:
            self._step_by(names[1], rows, g[:, DIM:], n, state)
            g = g[:, :DIM]
        self._step_by(names[0], rows, g, n, state)

    def _step_by(self, name: str, rows: np.ndarray, g: np.ndarray, n: np.ndarray, state: dict) -> None:
        squares, seen = state[name]
        squares[rows] += np.einsum("ij,ij->i", g, g) / g.shape[1]
        seen[rows] += n
        step = g * (RATE / np.sqrt(squares[rows])).astype(np.float32)[:, None]
        x = getattr(self, name)
        x[rows] += step[:, 0] if x.ndim == 1 else step

    def state(self) -> dict:
        """Sums of squares and numbers of uses of all rows, and the noise of each step."""
        noise = lambda p: (np.cumsum(p)[:-1], (np.log(p) + np.log(NOISE)).astype(np.float32))
        own = {k: (np.full(len(getattr(self, k)), 1.0), np.zeros(len(getattr(self, k)))) for k in self.NAMES}
        bounds = self.v.group_bounds
        return own | {"noise": noise(self.v.masses), "groups": [noise(self.shares[a:b] / self.shares[a:b].sum()) for a, b in zip(bounds[:-1], bounds[1:])]}


def _trainer(shared):
    def train(table: pa.Table) -> pa.Table:
        vocabulary, start = shared.value
        model = LogBilinear(vocabulary)
        model.unpack(start)
        state = model.state()
        part = table.column("part")[0].as_py()
        rng = np.random.default_rng(11 + part)
        # Rows of one hash are equal rows, so the order is that of the data alone.
        for batch in table.sort_by("h").combine_chunks().to_batches(max_chunksize=1000):
            for _, texts in slices(batch, "__text", CHUNK):
                h, bounds = tokens(Words(texts, SPACED, lower=True))
                at, symbols = vocabulary.look_up(h)
                model.train(vocabulary.contexts(at, symbols, bounds), symbols, state, rng)
        seen = model.spread({k: state[k][1] for k in model.NAMES})
        change = (model.pack() - start) * seen
        pieces = [x.tobytes() for x in np.array_split(change, PIECES)]
        counts = [x.astype(np.float64).tobytes() for x in np.array_split(seen, PIECES)]
        return pa.table({"part": pa.array([part] * PIECES, pa.int64()), "piece": pa.array(range(PIECES), pa.int64()), "change": pa.array(pieces, pa.binary()), "seen": pa.array(counts, pa.binary())})

    return train


_SUMS = "part long, piece long, change binary, seen binary"


def _added(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    add = lambda c: sum(np.frombuffer(x.as_py()) for x in table.column(c))
    part, piece = table.column("part")[0].as_py() // GROUP, table.column("piece")[0].as_py()
    return pa.table({"part": [part], "piece": [piece], "change": pa.array([add("change").tobytes()], pa.binary()), "seen": pa.array([add("seen").tobytes()], pa.binary())})


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, parameters = shared.value
        model = LogBilinear(vocabulary)
        model.unpack(parameters)
        own_class = np.log10(np.maximum(vocabulary.class_counts, 1e-12))
        for batch in batches:
            for part, texts in slices(batch, "__text", CHUNK):
                h, bounds = tokens(Words(texts, SPACED, lower=True))
                at, symbols = vocabulary.look_up(h)
                starts = bounds[:-1]
                inside = at >= 0
                count = np.where(inside, vocabulary.counts[at], 1.0) if len(vocabulary.counts) else np.ones(len(h))
                base = np.where(inside, np.log10(count + 0.1), 0.0)
                lm = model.log_probabilities(vocabulary.contexts(at, symbols, bounds), symbols) / np.log(10)
                # A token of a theme's class takes its share of the class; those of the far class follow by join.
                rest = np.flatnonzero((symbols >= vocabulary.size) & inside)
                lm[rest] += np.log10(count[rest]) - own_class[symbols[rest] - vocabulary.size]
                owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
                far = np.flatnonzero(~inside)
                order = far[np.lexsort((h[far], owner[far]))]
                o, t = owner[order], h[order]
                first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (t[1:] != t[:-1])])) if len(o) else np.zeros(0, int)
                times = np.diff(np.concatenate([first, [len(o)]])).astype(np.int32)
                cuts = np.searchsorted(o[first], np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("uid", "id", "held_out")),
                        pa.array(np.diff(bounds)),
                        pa.array(np.add.reduceat(inside.astype(np.int64), starts)),
                        pa.array(np.add.reduceat(base, starts)),
                        pa.array(np.add.reduceat(lm, starts)),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(t[first].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(times)),
                    ],
                    ["uid", "id", "held_out", "n_tokens", "near_known", "near_base", "near_score", "far", "times"],
                )

    return score


def _bin(c):
    """Counts in narrow bins, sixteen for each doubling."""
    return F.floor(F.log2(c) * 16).cast("int")


#: The bin of what occurs twice; what occurs once is never in the head.
_TWICE = 16


class Fitted:
    """What training leaves: the counts table, its totals, vocabulary and parameters."""

    def __init__(self, learn: DataFrame, scratch: Scratch):
        """learn: h (a hash of id and text) and __text of all training texts."""
        spark = learn.sparkSession
        rows = learn.count()
        part = F.pmod(F.col("h"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, SAMPLE / max(rows, 1))) + 1
        bag = learn.where(part).orderBy("h").limit(2 * SAMPLE).mapInArrow(_bagger, "h long, x binary").toArrow().sort_by("h")
        x = np.frombuffer(b"".join(bag.column("x").to_pylist()), np.uint16).reshape(-1, BUCKETS).astype(np.float32)
        self.themes = fitted_themes(learn, mixture(x))
        theta = spark.sparkContext.broadcast(self.themes)
        by_theme = [F.sum(F.when(F.col("theme") == t, F.col("n")).otherwise(F.lit(0))).alias(f"t{t}") for t in range(THEMES)]
        counts = learn.select("__text").mapInArrow(_counter(theta), "token long, theme int, n long").groupBy("token").agg(F.sum("n").alias("c"), *by_theme)
        self.counts = scratch.write(counts.withColumn("bin", _bin(F.col("c"))), "counts")
        # The head is all tokens above a bin, so that no order over all tokens is needed.
        bins = sorted(((r["bin"], r["n"], r["c"]) for r in self.counts.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()), reverse=True)
        once = {r["c"]: r["n"] for r in self.counts.where("c <= 2").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.total, self.distinct = sum(c for _, _, c in bins), sum(n for _, n, _ in bins)
        fits = np.cumsum([n for _, n, _ in bins]) <= HEAD
        near = [b for (b, _, _), ok in zip(bins, fits) if ok and b >= _TWICE]
        self.least = min(near, default=_TWICE + 1_000_000)
        self.far_types = sum(n for b, n, _ in bins if b < self.least)
        self.far_mass = sum(c for b, _, c in bins if b < self.least)
        n1, n2 = once.get(1, 0), once.get(2, 0)
        self.discount = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 else 0.5
        head = self.counts.where(F.col("bin") >= self.least).select("token", *[f"t{t}" for t in range(THEMES)]).toArrow()
        hashes = np.asarray(head.column("token").combine_chunks()).view(U64)
        counted = np.stack([np.asarray(head.column(f"t{t}").combine_chunks()) for t in range(THEMES)], axis=1)
        self.vocabulary = Vocabulary(hashes, counted, self.far_mass)
        self.parameters = LogBilinear(self.vocabulary).pack()
        # Parts are named by hash, and their number follows from the tokens counted.
        parts = max(1, round(self.total / (ROUNDS * PART_TOKENS)))
        dealt = learn.withColumn("part", F.pmod(F.col("h"), F.lit(parts))).withColumn("round", F.pmod(F.shiftright("h", 40), F.lit(ROUNDS)))
        for k in range(ROUNDS if self.total else 0):
            shared = spark.sparkContext.broadcast((self.vocabulary, self.parameters))
            flat = dealt.where(F.col("round") == k).select("part", "h", "__text").groupBy("part").applyInArrow(_trainer(shared), _SUMS)
            for _ in range(2):  # one sum for GROUP ** 2 parts reaches the driver, in parallel sums of bounded size
                flat = flat.groupBy(F.floor(F.col("part") / GROUP).alias("g"), "piece").applyInArrow(_added, _SUMS)
            sums = flat.toArrow().sort_by([("piece", "ascending"), ("part", "ascending")])
            change, seen = np.zeros(len(self.parameters)), np.zeros(len(self.parameters))
            cuts = np.cumsum([0, *(len(x) for x in np.array_split(change, PIECES))])
            for piece, c, n in zip(*(sums.column(x).to_pylist() for x in ("piece", "change", "seen"))):
                change[cuts[piece] : cuts[piece + 1]] += np.frombuffer(c)
                seen[cuts[piece] : cuts[piece + 1]] += np.frombuffer(n)
            self.parameters = self.parameters + change / np.maximum(seen, 1)
            shared.unpersist()
            # Else the disk holds the texts and parameters of all rounds until the driver happens to collect its garbage.
            del flat, sums
            forget_shuffles(spark)


def _learned_from(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    learn = df.where(~held_out(id_col, 10, 0))
    return learn.select(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).alias("h"), text.alias("__text"))


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of df."""
    spark = df.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "language-model")
    fitted = Fitted(_learned_from(df, id_col, text_col), scratch)
    texts = df.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), held_out(id_col, 10, 0).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")
    )
    id_type = df.schema[id_col].dataType.simpleString()
    schema = (
        f"uid long, id {id_type}, held_out boolean, n_tokens long, near_known long, near_base double, near_score double, far array<bigint>, times array<int>"
    )
    shared = spark.sparkContext.broadcast((fitted.vocabulary, fitted.parameters))
    near = scratch.write(texts.mapInArrow(_scorer(shared), schema), "near")
    far = near.where(F.size("far") > 0).select("uid", F.explode(F.arrays_zip("far", "times")).alias("z")).select("uid", F.col("z.far").alias("f"), F.col("z.times").alias("k"))
    # Tokens of the head are never looked up here, so they stay out of the join.
    tail = fitted.counts.where(F.col("bin") < fitted.least).select("token", "c")
    joined = far.join(tail, F.col("f") == F.col("token"), "left")
    base = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.1) * F.col("k")
    mass, off = float(max(fitted.far_mass, 1)), fitted.discount
    unseen = off * fitted.far_types / mass if fitted.far_types else 1.0
    share = F.log10(F.when(F.col("c").isNull(), F.lit(unseen)).otherwise((F.col("c") - off) / mass)) * F.col("k")
    sums = joined.groupBy(F.col("uid").alias("u")).agg(
        F.sum(base).alias("far_base"), F.sum(share).alias("far_score"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(F.lit(0))).alias("far_known")
    )
    done = near.drop("far", "times").join(sums, F.col("uid") == F.col("u"), "left")
    zero = F.lit(0.0)
    below = float(np.log10(fitted.total + 0.1 * (fitted.distinct + 1)))
    base_score = F.col("near_base") + F.coalesce("far_base", zero) - F.col("n_tokens") * F.lit(below)
    return done.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("near_known") + F.coalesce("far_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(fitted.total)).cast("long").alias("train_tokens"),
        base_score.alias("base_score"),
        (F.col("near_score") + F.coalesce("far_score", zero) if fitted.total else base_score).alias("score"),
    )
