"""Hierarchical language identification: family first, then one-versus-one within it.

Features are hashed byte 2- and 3-grams of the lower-cased text, square-rooted
and scaled to unit length. One linear support vector machine per family against
the rest picks the family; within a family of several languages, one machine
for each two languages votes, ties going to the larger summed margin.

Machines are fitted on at most ``SAMPLE_TOTAL`` texts with a language, spread
evenly over languages by a hash of the id; every text is then predicted.

Defined results: ``und`` with score 0 for a null text or one without a letter; if
no row has a language all are ``und``; one learned language is predicted for all
other texts. Null ids are never learned from. Repeated rows get equal answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bytetext import LOWER, Texts, slices
from .scratch import small_batches

DIM = 4096
SAMPLE_TOTAL = 2000
EPOCHS = 12
COST = 1.0
#: ISO 639-1 codes by family. A language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "indic": "hi bn mr ne pa gu ur",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[list(range(0x41, 0x5B)) + list(range(0x61, 0x7B))] = True


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], f"only:{lang}")


def features(texts: Texts) -> np.ndarray:
    """A unit row of DIM values for each text; zero for an empty one."""
    data = LOWER[texts.data].astype(np.uint32)
    n = len(texts)
    out = np.zeros((n, DIM), np.float32)
    owner = np.repeat(np.arange(n), np.diff(texts.bounds))
    for k, odd in ((2, 2654435761), (3, 2246822519)):
        if len(data) < k:
            continue
        code = data[: len(data) - k + 1].copy()
        for j in range(1, k):
            code = code * np.uint32(257) + data[j : len(data) - k + 1 + j]
        bucket = (code * np.uint32(odd)) >> np.uint32(20)
        same = owner[: len(bucket)] == owner[k - 1 :]
        flat = owner[: len(bucket)][same] * DIM + bucket[same]
        out += np.bincount(flat, minlength=n * DIM).reshape(n, DIM)
    out = np.sqrt(out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def has_letter(texts: Texts) -> np.ndarray:
    """Whether each text has a letter of any script."""
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[texts.data])])
    found = total[texts.bounds[1:]] > total[texts.bounds[:-1]]
    for i in np.flatnonzero(~found & (np.diff(texts.bounds) > 0)).tolist():
        text = texts.data[texts.bounds[i] : texts.bounds[i + 1]].tobytes().decode("utf-8", "replace")
        found[i] = any(c.isalpha() for c in text)
    return found


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 1) -> np.ndarray:
    """Weights, bias last, of a linear machine by dual coordinate descent; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros(x.shape[1])
    alpha = np.zeros(len(x))
    norm = (x * x).sum(axis=1)
    # Both classes weigh the same, however many texts each has.
    share = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9)) * cost
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            step = (y[i] * (x[i] @ w) - 1) / norm[i]
            new = min(max(alpha[i] - step, 0.0), share[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Hierarchy:
    """The fitted machines."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(family_of(lang), []).append(lang)
        names = list(self.families)
        family = np.array([family_of(v) for v in langs])
        lang = np.array(langs)
        self.names = names
        self.top = np.stack([fit_svm(x, np.where(family == f, 1.0, -1.0)) for f in names]) if len(names) > 1 else None
        self.pairs = {}
        for members in self.families.values():
            for a, b in combinations(members, 2):
                rows = (lang == a) | (lang == b)
                self.pairs[a, b] = fit_svm(x[rows], np.where(lang[rows] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        n = len(x)
        sure = np.ones(n)
        at = np.zeros(n, int)
        if self.top is not None:
            margin = x @ self.top.T
            at = np.argmax(margin, axis=1)
            rest = np.sort(margin, axis=1)
            sure = _sigmoid(2 * (rest[:, -1] - rest[:, -2]))
        out = np.empty(n, object)
        for k, name in enumerate(self.names):
            rows = np.flatnonzero(at == k)
            members = self.families[name]
            votes = np.zeros((len(rows), len(members)))
            margins = np.zeros((len(rows), len(members)))
            for (a, b), w in self.pairs.items():
                if a in members:
                    m = x[rows] @ w
                    i, j = members.index(a), members.index(b)
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    margins[:, i] += m
                    margins[:, j] -= m
            best = np.argmax(votes + 1e-3 * np.tanh(margins), axis=1)
            out[rows] = np.array(members, object)[best]
            if len(members) > 1:
                sure[rows] *= _sigmoid(3 * margins[np.arange(len(rows)), best] / (len(members) - 1))
        return out, sure


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, "__text", 1 << 19):
            x = features(texts)
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, texts in slices(batch, "__text", 1 << 19):
                said = has_letter(texts) & texts.valid
                langs, sure = np.full(len(texts), "und", object), np.zeros(len(texts))
                if model is not None and said.any():
                    langs[said], sure[said] = (v[said] for v in model.predict(features(texts)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(langs.tolist(), pa.string()), pa.array(sure)], [*part.schema.names[:2], "lang_pred", "score"]
                )

    return predict


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_TOTAL) -> DataFrame:
    """id, held_out, lang_pred and score of each row of df."""
    spark = df.sparkSession
    small_batches(spark)
    named = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col, 5, 0))
    named = named.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("__text"), F.xxhash64(id_col).alias("h"))
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = None
    if counts:
        each = max(20, sample // len(counts))
        # First a fraction by hash, then a rank within what is left of each language.
        share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 2.0 * each / n + 20 / n))])
        few = named.where(F.pmod(F.col("h"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
        ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= each)
        rows = ranked.select("lang", "__text").mapInArrow(_featurise, "lang string, x binary").orderBy("lang", "x").toArrow()
        x = np.concatenate([np.frombuffer(c.buffers()[2], np.float32)[c.offset * DIM : (c.offset + len(c)) * DIM] for c in rows.column("x").chunks]).reshape(-1, DIM)
        model = Hierarchy(x, rows.column("lang").to_pylist())
    shared = spark.sparkContext.broadcast(model)
    texts = df.select(F.col(id_col), held_out(id_col, 5, 0).alias("held_out"), F.col(text_col).alias("__text"))
    id_type = df.schema[id_col].dataType.simpleString()
    return texts.mapInArrow(_predictor(shared), f"`{id_col}` {id_type}, held_out boolean, lang_pred string, score double")
