"""Mixing sources to target weights by Pareto order sampling.

Targets: each source's share of all words by weight, held to ``most_copies``
times the source's size, the excess shared again by weight; in closed form
min(cap, level * weight) for the level at which all targets add up to all words.

Of a source that is to give r times its words, every document is certain of
floor(r) whole copies. The rest is a fixed-size sample of unequal probabilities:
inclusion probabilities are in proportion to a preference (the number of binary
digits of a document's size with ``by_length``, so that longer texts are likelier
without ruling the mix), and whatever would exceed 1 is certain of a further copy.
A document with inclusion probability p gets rank (u / (1 - u)) / (p / (1 - p)) for
a uniform u that a digest of seed and id fixes, and the lowest ranks are taken
until the words that are still due are reached to the nearest document. The factor
of proportion follows in closed form from the words of each (source, preference).

Running sums over ranks are two-level: word sums per range of ranks, then single
documents in the one range of each source in which the sample ends. So no task
sorts a whole source, however many rows it has.

Defined results: a null or wordless text has size 0 and takes 0 words; a null
source is a source of its own, the last in order; a null id is an id; rows that
repeat an id have the same u, ordered by size; an empty table gives an empty
table; input columns other than those named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = "mix-1"
#: Documents in a range of ranks, about, and the fewest and most ranges.
RANGE_ROWS, FEWEST, MOST_RANGES = 2000, 64, 65536
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """source, source_size -> with target: one row a source, so windows over all of them are narrow."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    k = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int"))
    s = sources.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * most_copies)
    filling = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumns(
        {
            "level": (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        }
    )
    full = F.col("cap") / F.col("w") < F.col("level")
    # Sources below the first that is not full have no higher level, so the greatest is the level at which the words run out.
    s = s.withColumn("water", F.max(F.when(~full, F.col("level"))).over(every))
    return s.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("w"))).alias("target"))


def _uniform(id_col: str, seed: str):
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(2**52)


def _level(x: Column) -> Column:
    """A preference in steps of a sixteenth of a doubling, which bounds the number of levels; null counts as 1."""
    x = F.coalesce(x.cast("double"), F.lit(1.0))
    return F.pow(F.lit(2.0), F.round(F.log2(F.least(F.greatest(x, F.lit(2.0**-32)), F.lit(2.0**32))) * 16) / 16)


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    most_copies: int = MOST_COPIES,
    preference_col: str | None = None,
    by_length: bool = False,
    seed: str = SEED,
    carry: list[str] | None = None,
) -> DataFrame:
    """id, source, size, source_size, target, copies and taken of each row of df.

    Preferences are those of ``preference_col`` (positive numbers, in steps of a
    sixteenth of a doubling; null counts as 1), or follow the size with
    ``by_length``; with neither all documents of a source are alike. Columns named
    in ``carry`` come back in a struct column ``row``.
    """
    scratch = Scratch(df.sparkSession, "mix")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    liking = _level(F.col(preference_col)) if preference_col else F.length(F.bin("size")).cast("double") if by_length else F.lit(1.0)
    sized = df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        size.alias("size"),
        _uniform(id_col, seed).alias("u"),
        *([_level(F.col(preference_col)).alias("x")] if preference_col else []),
        *([F.struct(*carry).alias("row")] if carry else []),
    )
    sized = sized if preference_col else sized.withColumn("x", liking)
    docs = scratch.write(sized.drop("row"), "docs")
    levels = scratch.write(docs.groupBy("source", "x").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")), "levels")
    by_source = levels.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(by_source, weights, most_copies).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    )
    plan = plan.withColumn("due", F.col("target") - F.col("whole") * F.col("source_size"))
    scale = _scales(levels, plan.select(F.col("source").alias("p"), "due"))
    plan = plan.join(scale, F.col("source").eqNullSafe(F.col("q")), "left").withColumn("scale", F.coalesce("scale", F.lit(0.0)))
    plan = scratch.write(plan.select(F.col("source").alias("s"), "source_size", "target", "whole", "due", "scale"), "plan")
    ranges = min(MOST_RANGES, max(FEWEST, (levels.agg(F.sum("docs")).first()[0] or 0) // RANGE_ROWS))
    ranked = _ranked(docs, plan, ranges)
    sums = ranked.groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("due").alias("due"))
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    # The range in which the words due run out, one a source; ranges before it are taken whole.
    last = sums.where("before < due").groupBy("source").agg(F.max("part").alias("last"), F.max_by("before", "part").alias("before"))
    last = scratch.write(last.select(F.col("source").alias("e"), "last", "before"), "last")
    ends = ranked.join(last, F.col("source").eqNullSafe(F.col("e")) & (F.col("part") == F.col("last"))).drop("e")
    running = Window.partitionBy("source").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("before") + F.coalesce(F.sum("size").over(running), F.lit(0))
    cut = ends.where("rank < double('inf')").withColumn("so_far", so_far).where(F.col("so_far") + F.col("size") / 2.0 <= F.col("due"))
    cut = cut.groupBy(F.col("source").alias("c")).agg(F.max(F.struct("rank", "id", "size")).alias("cut"))
    plan = plan.join(last.drop("before"), F.col("s").eqNullSafe(F.col("e")), "left").drop("e")
    plan = scratch.write(plan.join(cut, F.col("s").eqNullSafe(F.col("c")), "left").drop("c"), "cuts")
    # Every row decides by its own rank and its source's row of the plan: no join by id.
    done = _ranked(sized, plan, ranges)
    before = F.struct("rank", "id", "size") <= F.col("cut")
    more = F.coalesce((F.col("part") < F.col("last")) | ((F.col("part") == F.col("last")) & F.coalesce(before, F.lit(False))), F.lit(False))
    copies = (F.col("whole") + more.cast("long")).cast("long")
    return done.select(
        *(["row"] if carry else []),
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def _scales(levels: DataFrame, due: DataFrame) -> DataFrame:
    """(q, scale) of each source: the factor at which min(1, scale * preference) of all words are those due.

    Levels are few for each source. From the greatest preference down a level is
    certain as long as the factor for it and all below would give it more than 1.
    """
    rows = levels.join(due, F.col("source").eqNullSafe(F.col("p")))
    falling = Window.partitionBy("source").orderBy(F.col("x").desc())
    above = F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("x") * F.col("words")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    factor = F.when(below > 0, (F.col("due") - above) / below).otherwise(F.lit(0.0))
    open_ = rows.withColumn("factor", factor).where(F.col("factor") * F.col("x") < 1)
    return open_.groupBy(F.col("source").alias("q")).agg(F.max_by("factor", "x").alias("scale"))


def _ranked(docs: DataFrame, plan: DataFrame, ranges: int) -> DataFrame:
    """Pareto rank of each document and the range of ranks it falls in."""
    chance = F.least(F.col("scale") * F.col("x"), F.lit(1.0))
    odds = (F.col("u") / (1 - F.col("u"))) / (chance / (1 - chance))
    rank = F.when(chance >= 1, F.lit(0.0)).when(chance <= 0, F.lit(float("inf"))).otherwise(odds)
    part = F.when(F.col("rank") == float("inf"), F.lit(ranges)).otherwise(F.floor(F.col("rank") / (1 + F.col("rank")) * ranges))
    joined = docs.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return joined.withColumn("rank", rank).withColumn("part", part.cast("int"))
