"""Quality rules: a threshold table compiled into one Spark projection.

Counts and ratios are built-in expressions on the row's own text; no rule needs
another row, so nothing is shuffled and the scan reads id and text only.

Defined results: a null text has no words and fails; an empty one likewise;
rows with null or repeated ids are each judged on their own; an empty table
gives an empty table; input columns other than id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GAP = "[ \\t-\\r]+"
GAP_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Function words of the languages the corpus is written in.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or from at which "
    "der die das und in zu den ist von mit auf für ein eine im nicht dem des als auch "
    "le la les de des et en un une du que est pour dans qui par sur au "
    "el los las del y en que un una por con para su se no es"
).split()
#: rule: lowest and highest ratio accepted (None leaves a side open), and the fewest words to which it applies.
THRESHOLDS: dict[str, tuple[float | None, float | None, int]] = {
    "mean_word_chars": (2.0, 25.0, 1),
    "symbol_ratio": (None, 0.25, 1),
    "dup_line_ratio": (None, 0.7, 1),
    "stop_word_ratio": (0.001, None, 40),
}
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def _words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def _window_hashes(words: Column, n: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]),
    )


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words and n_lines of each row.

    n_repeat_words counts words inside 5-word windows that occur twice or more,
    first occurrences included. Window hashes are compared first as a set, which
    settles most texts; only a text with a repeat sorts (hash, position) pairs,
    finds equal neighbours and adds up the union of their windows. Columns named
    in ``carry`` come back in a struct column ``row``.
    """
    text = F.coalesce(F.col("__t"), F.lit(""))
    words = F.col("__w")
    n = F.size(words)
    row = ["row"] if carry else []
    given = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"), *([F.struct(*carry).alias("row")] if carry else []))
    base = given.select(
        "__id",
        *row,
        F.length(F.translate(text, GAP_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, GAP_CHARS, "") != "").alias("__l"),
        _words(text).alias("__w"),
    )
    grams = base.select(
        "*",
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(_window_hashes(words, n)).alias("__g"),
    )
    # Positions of repeated windows: neighbours of equal hash after sorting (hash, position).
    pairs = F.sort_array(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    repeated = F.size(F.array_distinct("__g")) < F.size("__g")
    sorted_ = grams.select(
        "*", F.when(repeated, pairs).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")).alias("__s")
    )
    at = F.sort_array(
        F.transform(
            F.filter(
                F.col("__s"),
                lambda s, k: (F.get(F.col("__s"), k - 1)["g"].eqNullSafe(s["g"])) | (F.get(F.col("__s"), k + 1)["g"].eqNullSafe(s["g"])),
            ),
            lambda s: s["i"],
        )
    )
    placed = sorted_.select("*", at.alias("__p"))
    covered = F.aggregate(
        F.transform("__p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__p"), k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x.cast("long"),
    )
    # A column that Catalyst takes for nondeterministic keeps filters on the measures above this
    # projection: pushed below it, they would copy every array expression into each use of it.
    barrier = F.monotonically_increasing_id() * 0
    return placed.select(
        *row,
        F.col("__id").alias(id_col),
        F.size("__w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        covered.alias("n_repeat_words"),
        "n_stop_words",
        (F.size("__l").cast("long") + barrier).alias("n_lines"),
    )


def verdict() -> tuple[Column, Column]:
    """base_failed, and kept by the threshold table."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    ratio = {
        "mean_word_chars": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "stop_word_ratio": F.col("n_stop_words") / n,
    }
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = ~failed
    for rule, (low, high, least) in THRESHOLDS.items():
        within = F.lit(True)
        if low is not None:
            within = within & (ratio[rule] >= low)
        if high is not None:
            within = within & (ratio[rule] <= high)
        kept = kept & ((F.col("n_words") < least) | within)
    return failed, kept


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Measures, base_failed and kept of each row of df, with a struct ``row`` of the columns in ``carry``."""
    failed, kept = verdict()
    return measures(df, id_col, text_col, carry).withColumns({"base_failed": failed, "kept": kept})
