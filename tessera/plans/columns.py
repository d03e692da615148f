"""Choosing columns by position, so that extra or repeated names never clash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def position(df: DataFrame, name: str) -> int:
    """Index of the first column called ``name``, or else of the first that differs only in case."""
    names = df.columns
    if name in names:
        return names.index(name)
    for i, x in enumerate(names):
        if x.lower() == name.lower():
            return i
    raise ValueError(f"no column {name!r} among {names}")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Selects ``alias=column`` pairs; other columns, whatever their names, are left out."""
    at = {alias: position(df, name) for alias, name in wanted.items()}
    flat = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    return flat.select(*(F.col(f"_c{i}").alias(alias) for alias, i in at.items()))


def numbered(df: DataFrame) -> DataFrame:
    """All columns renamed to ``_c0, _c1, ...``; rename back with ``toDF(*df.columns)``."""
    return df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
