"""Queries of the streaming forms: each runs a stream over the given tables to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import models
from tessera.operators.context import HTTP_BOUNDS
from tessera.operators.queries_context import _BUCKETS, _ROUTE
from tessera.operators.queries_store import _BELIEFS, _MODELS
from tessera.plans.registry import query
from tessera.plans.scratch import Scratch
from tessera.sources.views import belief_observations, observations, requests
from tessera.streaming import folds, limiter


#: Rows of a file of a batch, at least, if a batch has several.
FILE_ROWS = 200_000


def _arriving(df: DataFrame, scratch: Scratch, order: str, files: int = 3) -> DataFrame:
    """``df`` as a stream of batches, ``files`` of them, in order of a column. Each is of equally many files, so
    that large ones are written and read by many tasks."""
    spark, at = df.sparkSession, f"{scratch.path}/arriving"
    df = scratch.write(df, "given")
    ends = df.stat.approxQuantile(order, [i / files for i in range(1, files)], 0.01)
    part = sum((F.when(F.col(order) > e, 1).otherwise(0) for e in ends), F.lit(0))
    batches = [df.filter(part == i) for i in range(files)]
    rows = {r["p"]: r["n"] for r in df.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    each = max(1, min(4 * spark.sparkContext.defaultParallelism, min(rows.get(i, 0) for i in range(files)) // FILE_ROWS))
    for i, batch in enumerate(batches):
        # dealt in turn: with so many rows every file gets some
        (batch.repartition(each) if each > 1 else batch.coalesce(1)).write.mode("append").parquet(at)
        if len(spark.read.schema(df.schema).parquet(at).inputFiles()) != (i + 1) * each:
            raise RuntimeError(f"batch {i} isn't of {each} files")
    scratch.drop("given")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(at)


def _run(stream: DataFrame, scratch: Scratch, mode: str = "append", **sink) -> None:
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{scratch.path}/checkpoint")
    writer = writer.foreachBatch(sink["batch"]) if "batch" in sink else writer.format("parquet").option("path", sink["path"])
    q = writer.start()
    q.awaitTermination()


@query("t01_sliding_log", None)
def t01(spark: SparkSession, d: str) -> DataFrame:
    return limiter.sliding_log(requests(spark, d), 5, 86400.0)


@query("t01_limiter_stream", None)
def t01_stream(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "limiter")
    r = requests(spark, d).select("client", "event_id", "ts").withColumn("order", F.col("ts").cast("double"))
    stream = _arriving(r, scratch, "order")
    _run(limiter.limited_stream(stream, 5, 86400.0, idle_seconds=90 * 86400.0), scratch, path=f"{scratch.path}/out")
    return spark.read.parquet(f"{scratch.path}/out")


@query("t04_model_stream", f"with {_MODELS} select * from models")
def t04_models(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "models")
    _run(_arriving(observations(spark, d), scratch, "seq"), scratch, batch=folds.fold_models(f"{scratch.path}/state"))
    v = folds.Versions(spark, f"{scratch.path}/state")
    return models.models_of(v.read("models", v.last("models")))


@query("t04_belief_stream", f"with {_BELIEFS} select user_id, topic_id, claim, f.s as stance, round(f.c, 9) as confidence, f.n as evidence_count, f.x as contradiction, last_observed_at from beliefs")
def t04_beliefs(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "beliefs")
    _run(_arriving(belief_observations(spark, d), scratch, "seq"), scratch, batch=folds.fold_beliefs(f"{scratch.path}/state"))
    v = folds.Versions(spark, f"{scratch.path}/state")
    return models.beliefs_of(v.read("beliefs", v.last("beliefs"))).drop("stance_history")


@query("t09_http_counter_stream", f"select upper(method) as method, {_ROUTE} as route, status, count(*) as n, round(sum(seconds), 4) as seconds, sum(bytes)::bigint as bytes, {_BUCKETS(HTTP_BOUNDS)} as buckets from requests group by 1, 2, 3")
def t09(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "counters")
    stream = _arriving(requests(spark, d), scratch, "event_id")
    _run(folds.http_counters(stream), scratch, "complete", batch=lambda df, n: df.write.mode("overwrite").parquet(f"{scratch.path}/out"))
    return spark.read.parquet(f"{scratch.path}/out")


@query("t05_resumable_stages", "select event_id as id, case when event_id % 3 = 0 then 'failed' else 'completed' end as extract_status, case when event_id % 3 = 0 then 'pending' else 'completed' end as index_status, case when event_id % 3 = 0 then 'extract' end as failed_stage, case when event_id % 3 = 0 then 'boom' end as last_error from events")
def t05(spark: SparkSession, d: str) -> DataFrame:
    """Two calls: in the first each stage fails for a third of the items, in the second only the first stage."""
    at, items = f"{Scratch(spark, 'stages').path}/state", requests(spark, d).select(F.col("event_id").alias("id"))
    fails = lambda k: lambda df: df.select("id", F.when(F.col("id") % 3 == k, "boom").alias("error"))
    folds.resume(spark, at, items, {"extract": fails(0), "index": fails(1)})
    return folds.resume(spark, at, items, {"extract": fails(0), "index": fails(9)})
