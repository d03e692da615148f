"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``; columns are pruned and filters pushed by Catalyst."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
