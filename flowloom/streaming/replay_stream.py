"""Replay as a stream: the same fold as keyed state, a micro-batch of the log at a time.

A micro-batch commits with the checkpoint, so a restart goes on where the last
one ended. Ops of one micro-batch are put in order; the log's files must come in
order themselves. All queues are one key, or each component of a routed log is one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fold import Fold
from ..plans.replay import OUTCOME, ROUTED, op_from, outcome_rows, packed, restored, routed_log
from ..sources.shared import written
from ..sources.tables import stream_ops

LEAST_SLICES = 4
#: Rows of a micro-batch, which bound what a key's step holds besides its state.
SLICE_ROWS = 500_000
_NAMES = [c.split()[0] for c in OUTCOME.split(", ")]


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    fold = pickle.loads(state.get[0]) if state.exists else Fold()
    ops = pd.concat(list(frames)).sort_values(["seq", "pos"])
    rows: list[tuple] = []
    for row in zip(*(ops[c].tolist() for c in ("seq", "now_ms", "kind", "body"))):
        op = op_from(*row)
        rows += outcome_rows(op, fold.apply(op))
    state.update((pickle.dumps(fold),))
    # Objects from the start: a column with gaps would turn into floats, and long numbers lose digits.
    yield pd.DataFrame(rows, columns=_NAMES, dtype=object)


def outcomes_stream(ops: DataFrame, component=None) -> DataFrame:
    """Outcomes of a streaming op log; audit records and all queues in one component by default."""
    return _keyed(packed(ops).withColumn("component", component if component is not None else F.lit("all")))


def _keyed(routed: DataFrame) -> DataFrame:
    return routed.groupBy("component").applyInPandasWithState(_step, OUTCOME, "fold binary", "append", GroupStateTimeout.NoTimeout)


def _run(outcomes: DataFrame, out: str, checkpoint: str) -> None:
    q = outcomes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()


def run_replay(spark: SparkSession, log: str, out: str, checkpoint: str, files_per_trigger: int = 1) -> None:
    """Replay what the log holds now into Parquet at ``out`` and stop; a later call goes on from the checkpoint."""
    _run(outcomes_stream(stream_ops(spark, log, files_per_trigger)), out, checkpoint)


def replay_slices(ops: DataFrame, root: str) -> DataFrame:
    """Outcomes of an op log by a stream keyed by component: slices of the routed log arrive in order, each of several files and one micro-batch."""
    spark = ops.sparkSession
    routed = written(routed_log(ops), "routed")
    lo, hi, n = routed.agg(F.min("seq"), F.max("seq"), F.count(F.lit(1))).first()
    slices = max(LEAST_SLICES, -(-n // SLICE_ROWS))
    for k in range(slices if n else 0):
        a, b = (lo + (hi - lo + 1) * i // slices for i in (k, k + 1))
        routed.where((F.col("seq") >= a) & (F.col("seq") < b)).write.mode("append").parquet(f"{root}/log")
        arriving = spark.readStream.schema(ROUTED).parquet(f"{root}/log")  # no bound on files: what is new is one slice
        _run(_keyed(arriving), f"{root}/out", f"{root}/checkpoint")
    outcomes = spark.read.schema(OUTCOME).parquet(f"{root}/out") if n else spark.createDataFrame([], OUTCOME)
    return restored(outcomes, ops)
