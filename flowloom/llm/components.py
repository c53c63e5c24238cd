"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a minimum per node joined back to its links, so no node's links are
ever gathered in one row or task, and nothing but two numbers reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger neighbours (large) or smaller ones and itself (small) to its least neighbour."""
    if large:
        around = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
    near = around.join(least, F.col("a") == F.col("n"))
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch, label: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of links (a, b); the component is its least node."""
    now = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-0")
    before = _state(now)
    last = f"{label}-0"
    for k in range(1, most_rounds + 1):
        if not before[0]:
            break
        name = f"{label}-{k}"
        after_links = scratch.write(_star(_star(now, large=True), large=False), name)
        after = _state(after_links)
        scratch.drop(last)
        now, last = after_links, name
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
