"""Intermediate tables in the folder all executors share.

A step that several later steps read is written once as Parquet below
``spark.checkpoint.dir`` and read back, which cuts its lineage: an executor
lost later costs a reread, never a recomputation of everything before.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and all of it runs on one machine, as in tests.
ONE_MACHINE = "file:///tmp/checkpoints/flowloom"


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.partition("[")[0] == "local":
        return ONE_MACHINE
    raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")


class Scratch:
    """A folder of written tables, dropped one by one or all at exit."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._made: set[str] = set()
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self._made.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self._made:
                self._delete(f"{self.root}/{name}")
                self._made.discard(name)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended: nothing is left to call
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, which their own Python path need not hold; once a context."""
    context = spark.sparkContext
    if getattr(context, "_flowloom_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="flowloom-")
    archive = Path(folder) / "flowloom_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent).as_posix())
    context.addPyFile(str(archive))
    atexit.register(shutil.rmtree, folder, True)
    context._flowloom_shipped = True


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound an Arrow batch of whole texts; the default of 10,000 rows is for narrow tables."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def forget_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
