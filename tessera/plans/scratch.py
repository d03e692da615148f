"""Written tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Bytes of a table, as stored, up to which it may be sent to every executor.
SMALL_BYTES = 16_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a single-JVM session without one may set its own,
    in Spark's warehouse."""
    found = spark.conf.get(SETTING, None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir', os.getcwd()).rstrip('/')}/_tessera-{uuid.uuid4().hex}"
        spark.conf.set(SETTING, found)
        atexit.register(shutil.rmtree, urlparse(found).path, ignore_errors=True)
    return found.rstrip("/")


class Scratch:
    """A folder of intermediate tables under the shared folder, one per call of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` once and returns the table read back: a lost executor costs no recomputation."""
        at = f"{self.path}/{name}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more (all of them if none is named)."""
        jvm = self.spark.sparkContext._jvm
        for at in [f"{self.path}/{n}" for n in names] or [self.path]:
            p = jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored_bytes(df: DataFrame) -> int:
    """Catalyst's size of ``df``, without running anything: that of its files for a written table, an upper
    bound for what filters and projections make of one, far too much for joins."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """``df``, best a written table, with a broadcast hint if it is stored in at most ``max_bytes``, else as it
    is, for a join that Spark plans by the sizes it meets."""
    return F.broadcast(df) if stored_bytes(df) <= max_bytes else df
