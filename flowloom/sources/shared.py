"""Tables written to the folder that all executors share, to be read more than once."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and all of it runs on one machine, as in tests.
ONE_MACHINE = "file:///tmp/checkpoints/flowloom"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = ONE_MACHINE
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written and read back: later plans read a table instead of repeating its plan."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: nothing is left to call
        pass
