"""From raw documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and
read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm.decontaminate import contamination
from flowloom.llm.line_dedup import line_dedup
from flowloom.llm.mix_sources import mix_sources
from flowloom.llm.near_duplicates import near_duplicates
from flowloom.llm.quality_rules import quality_rules
from flowloom.llm.scratch import Scratch


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality rules keep; rows are carried beside their measures, so nothing is joined."""
    return quality_rules(docs, carry=docs.columns).where("kept").select("row.*")


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut boilerplate lines; a document left without any text goes."""
    cut = line_dedup(docs, "source", "text")
    changed = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.where("trim(text) <> ''").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates; the others' ids are the small side of the join."""
    others = near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=docs.columns)
    return found.where("n_hit = 0").select("row.*")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: documents with at least one copy, and how many copies."""
    mixed = mix_sources(docs, by_length=True, carry=docs.columns).where("copies > 0")
    return mixed.select("row.*", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", rules_stage),
    ("line dedup", lines_stage),
    ("near duplicates", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("source mix", mix_stage),
]

#: Connected components of near-duplicates and the order of ranges are tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        scratch.drop(f"stage-{k - 1}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
