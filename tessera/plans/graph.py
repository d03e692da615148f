"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node of its component.

    Each round links all larger neighbours of a node to its smallest one (large star), then a node and
    its smaller neighbours to the smallest (small star). The rounds are logarithmic in the longest
    chain; each is written, so that neither plans nor lost executors grow the work. Nodes of many
    neighbours cost no more than their edges, as minima are combined before the shuffle."""
    now = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}0")
    before, turn = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before, turn = mark, turn + 1
        both = _neighbours(now)
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.write(large, f"{label}{turn}l")
        # a > b in every edge: b are the smaller neighbours of a
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a")
        small = linked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = scratch.write(small, f"{label}{turn}")
        scratch.drop(f"{label}{turn - 1}", f"{label}{turn}l")
