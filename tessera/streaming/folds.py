"""Models, beliefs and counters that arriving batches bring forward.

A state is a written table, a version a batch: batch n reads version n - 1 and writes version n, so a batch
that is run again after a failure writes the same version once more, and nothing counts twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.text import normalize_name
from tessera.operators import context, models
from tessera.operators.models import BELIEF_KEYS, MODEL_KEYS


class Versions:
    """Versions of tables under a folder that all executors share. Versions before the last two are deleted."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str, version: int):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{version}")

    def _files(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, name: str, version: int) -> DataFrame | None:
        """The table as of a version; None before the first one."""
        done = self._path(name, version).suffix("/_SUCCESS")
        return self.spark.read.parquet(f"{self.folder}/{name}/{version}") if self._files(done).exists(done) else None

    def write(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/{version}")
        old = self._path(name, version - 2)
        self._files(old).delete(old, True)

    def last(self, name: str) -> int:
        """The latest version written, -1 if there is none."""
        root = self._path(name, 0).getParent()
        files = self._files(root)
        found = [int(x.getPath().getName()) for x in files.listStatus(root)] if files.exists(root) else []
        return max((v for v in found if self.read(name, v) is not None), default=-1)


def _versioned(step: Callable[[Versions, DataFrame, int], None], folder: str) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, n: int) -> None:
        step(Versions(batch.sparkSession, folder), batch, n)

    return run


def fold_models(folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that brings the person-topic state of a folder forward by observations.
    A batch reads the states and the evidence of the version before, not the observations of old."""

    def step(v: Versions, batch: DataFrame, n: int) -> None:
        state, seen = v.read("models", n - 1), v.read("model-evidence", n - 1)
        new = batch.select(*MODEL_KEYS, "memory_id").distinct()
        v.write(models.model_state(batch, state, seen), "models", n)
        v.write(new if seen is None else new.union(seen).distinct(), "model-evidence", n)

    return _versioned(step, folder)


def fold_beliefs(folder: str) -> Callable[[DataFrame, int], None]:
    """The same for beliefs; batches are folded as they arrive, a batch in the order of ``seq``."""

    def step(v: Versions, batch: DataFrame, n: int) -> None:
        state, seen = v.read("beliefs", n - 1), v.read("belief-evidence", n - 1)
        new = batch.withColumn("key", normalize_name(batch["claim"])).select(*BELIEF_KEYS, "memory_id").distinct()
        v.write(models.belief_state(batch, state, seen), "beliefs", n)
        v.write(new if seen is None else new.union(seen).distinct(), "belief-evidence", n)

    return _versioned(step, folder)


def http_counters(requests: DataFrame) -> DataFrame:
    """The cumulative counters of a stream of requests, for the update or complete output mode."""
    return context.http_metrics(requests)


def resume(spark: SparkSession, folder: str, items: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], key: str = "id") -> DataFrame:
    """Runs items through stages in order and returns (key, <stage>_status, failed_stage, last_error).

    A stage gets the items (all their columns) that it hasn't completed before and whose earlier stages are
    complete, and returns (key, error), null for success. What is complete is in the written status of the
    folder, so another call repeats nothing that succeeded and starts where an item failed."""
    from pyspark.sql import functions as F

    v = Versions(spark, folder)
    last = v.last("status")
    known = v.read("status", last)
    start = items.select(key).distinct()
    for s in stages:
        start = start.withColumn(f"{s}_status", F.lit("pending"))
    start = start.withColumns({"failed_stage": F.lit(None).cast("string"), "last_error": F.lit(None).cast("string")})
    status = start if known is None else known.unionByName(start.join(known.select(key), key, "left_anti"))
    version = last + 1
    v.write(status, "status", version)
    done_before: list[str] = []
    for s, run in stages.items():
        status = v.read("status", version)
        ready = status.filter((F.col(f"{s}_status") != "completed") & (F.array_min(F.array(F.lit(True), *(F.col(f"{p}_status") == "completed" for p in done_before)))))
        result = run(items.join(ready.select(key), key, "left_semi")).select(key, F.col("error").alias("_error")).withColumn("_ran", F.lit(True))
        after = status.join(result, key, "left")
        failed = F.col("_ran") & F.col("_error").isNotNull()
        now = F.when(failed, "failed").when(F.col("_ran"), "completed").otherwise(F.col(f"{s}_status"))
        fields = {f"{s}_status": now, "failed_stage": F.when(failed, s).when(F.col("_ran") & (F.col("failed_stage") == s), None).otherwise(F.col("failed_stage")), "last_error": F.when(failed, F.col("_error")).when(F.col("_ran") & (F.col("failed_stage") == s), None).otherwise(F.col("last_error"))}
        version += 1
        v.write(after.withColumns(fields).select(*status.columns), "status", version)
        done_before.append(s)
    return v.read("status", version)
