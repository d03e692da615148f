"""Sources and sinks beside the parquet tables: evaluation datasets, database pools, appends, the search
index as a table, and report files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip

_MEMORY = "struct<key:string,raw_text:string,summary:string,type:string,source:string,people:array<string>,topics:array<string>,importance:double,utility:double,belief_impact:double,confidence:double>"
_MODEL = "struct<person_name:string,person_aliases:array<string>,topic_name:string,topic_aliases:array<string>,niceness:double,readiness:double,competence:double,capacity:double,confidence:double,evidence_memory_keys:array<string>>"
_BELIEF = "struct<topic_name:string,topic_aliases:array<string>,claim:string,stance:string,confidence:double,evidence_memory_keys:array<string>>"
_TEXTS = "id title query goal instructions strategy_instructions outcome_text follow_up_query manual_rating_instructions manual_precision_assessment judge_focus".split()
_LISTS = "people topics expected_memory_keys expected_augmented_cues expected_follow_up_cues judge_failure_modes".split()
CASE = f"struct<{','.join([f'{c}:string' for c in _TEXTS] + [f'{c}:array<string>' for c in _LISTS])},memories:array<{_MEMORY}>,people_models:array<{_MODEL}>,beliefs:array<{_BELIEF}>>"
DATASET = f"name string, cases array<{CASE}>"


def evaluation_dataset(spark: SparkSession, path: str) -> DataFrame:
    """One row a case of JSON datasets (one object a file), with their name. A file that isn't such JSON
    fails the read."""
    read = spark.read.schema(DATASET).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return read.select("name", F.explode("cases").alias("c")).select(F.col("name").alias("dataset"), "c.*")


def pool(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, connections: int = 10, **options: str) -> DataFrame:
    """A table of a database. With a numeric ``key`` and its ``bounds`` it is read over at most
    ``connections`` connections at a time, each for a range of keys (rows beyond the bounds go to the
    outer ranges); filters and columns are pushed down to the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=max(1, connections))
    return reader.load()


def append(rows: DataFrame, path: str, required: tuple[str, ...] = (), roles: tuple[str, ...] | None = None) -> None:
    """Appends messages, sessions or entities. Blank required texts, and roles other than those
    allowed, fail the write before any row is committed."""
    checked = rows
    for c in required:
        ok = strip(F.coalesce(F.col(c), F.lit(""))) != ""
        checked = checked.withColumn(c, F.when(ok, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is required"))))
    if roles:
        checked = checked.withColumn("role", F.when(F.col("role").isin(*roles), F.col("role")).otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce("role", F.lit("null"))))))
    checked.write.mode("append").parquet(path)


def ensure_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The index table at ``path``, made empty if there is none; one that is there already is no error."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def upsert_points(index: DataFrame, points: DataFrame, order: str | None = None) -> DataFrame:
    """The index with points by id, those of the same id replaced as a whole; of points that repeat an
    id the last by ``order`` (any, without one) counts. One shuffle of the points, one of the index."""
    own = points
    if order:
        rest = [c for c in points.columns if c != "id"]
        own = points.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("id", "_r.*")
    else:
        own = points.dropDuplicates(["id"])
    own = own.select(*index.columns)
    return index.join(own.select("id"), "id", "left_anti").select(*index.columns).unionByName(own)


def delete_points(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without some ids; unknown ones are no error."""
    return index.join(ids.select("id").distinct(), "id", "left_anti")


def report_markdown(summary: dict, cases: list[dict]) -> str:
    """The Markdown form of an evaluation report."""
    lines = ["# Evaluation", "", "| Measure | Value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in summary.items()), "", "## Cases", ""]
    for c in cases:
        lines += [f"### {c.get('title') or c.get('id')}", "", *(f"- {k}: {v}" for k, v in c.items() if k not in ("id", "title")), ""]
    return "\n".join(lines)


def write_report(spark: SparkSession, summary: DataFrame, cases: DataFrame, folder: str, stamp: str) -> list[str]:
    """The report as JSON and Markdown, each under its time and as ``latest``, which is replaced. A
    report is one row of totals and a row a case of a labelled dataset, so the driver writes it."""
    total = summary.first().asDict(recursive=True)
    rows = [r.asDict(recursive=True) for r in cases.orderBy("id").toLocalIterator()]
    texts = {"json": json.dumps({"generated_at": stamp, "summary": total, "cases": rows}, indent=2, default=str) + "\n", "md": report_markdown(total, rows) + "\n"}
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for kind, text in texts.items():
        for name in (stamp.replace(":", "").replace(" ", "T"), "latest"):
            path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.{kind}")
            stream = path.getFileSystem(conf).create(path, True)
            stream.write(bytearray(text.encode()))
            stream.close()
            out.append(f"{folder}/{name}.{kind}")
    return out
