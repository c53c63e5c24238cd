"""The corpus pipeline against a brute-force version of its stages."""

import collections

import corpus_pipeline as cp
import pytest
from test_operators import brute_components

from flowloom.llm.decontaminate import contamination
from flowloom.llm.line_dedup import line_dedup
from flowloom.llm.mix_sources import mix_sources
from flowloom.llm.quality_rules import quality_rules


@pytest.fixture
def kept(spark):
    """Frames cached for one test only: other tests read the same files in the same session."""
    held = []
    yield lambda df: held.append(df.cache()) or held[-1]
    for df in held:
        df.unpersist()


def test_stages_in_order_with_their_columns(spark, sf_dir, kept):
    keep = kept
    docs = keep(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    start = docs.columns
    kept = keep(cp.rules_stage(spark, docs, sf_dir))
    good = {r["doc_id"] for r in quality_rules(docs).where("kept").collect()}
    assert kept.columns == start and {r["doc_id"] for r in kept.collect()} == good
    cut = keep(cp.lines_stage(spark, kept, sf_dir))
    want = {r["doc_id"]: r["text"] for r in line_dedup(kept).collect() if r["text"].strip()}
    assert cut.columns == start and {r["doc_id"]: r["text"] for r in cut.collect()} == want
    near = keep(cp.near_stage(spark, cut, sf_dir))
    one = {i for i, (_, c) in brute_components(want.items()).items() if i == c}
    assert near.columns == start and {r["doc_id"] for r in near.collect()} == one
    clean = keep(cp.benchmark_stage(spark, near, sf_dir))
    leaks = {r["doc_id"] for r in contamination(near, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0").collect()}
    assert clean.columns == start and {r["doc_id"] for r in clean.collect()} == one - leaks
    mixed = cp.mix_stage(spark, clean, sf_dir).collect()
    assert collections.Counter(r["doc_id"] for r in mixed) == collections.Counter(r["doc_id"] for r in mix_sources(clean, by_length=True).where("copies > 0").collect())


def test_run_is_registered_and_runs(spark, sf_dir):
    assert [n for n, _ in cp.STAGES] == ["quality rules", "line dedup", "near duplicates", "benchmark decontamination", "source mix"]
    assert cp.queries()["pipeline"](spark, sf_dir).count() > 0
