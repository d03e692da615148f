"""Similar sets by bits against all pairs, whatever the blocks, and what they shuffle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import rerank, sets
from tessera.plans.scratch import Scratch


def _shuffled(spark, df) -> int:
    """Records that all stages since have shuffled, once ``df`` is computed."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    total = lambda: sum(s.shuffleWriteRecords() for s in (lambda xs: [xs.apply(i) for i in range(xs.size())])(stages()))
    before = total()
    df().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


def _texts(n):
    rnd = random.Random(n)
    words = [f"w{i}" for i in range(150)]
    return [(i, 0, " ".join(rnd.sample(words, 40))) for i in range(n)]


def test_what_is_shuffled_grows_with_the_rows(spark):
    few, many = (_shuffled(spark, lambda n=n: rerank.similar_summaries(spark.createDataFrame(_texts(n), "id bigint, user_id bigint, summary string"))) for n in (200, 1600))
    assert 0 < many < 8 * few + 1000


@pytest.mark.parametrize("threshold", [0.5, 0.82, 1.0])
@pytest.mark.parametrize("most", [8192, 20])
def test_no_similar_pair_is_lost(spark, monkeypatch, threshold, most):
    monkeypatch.setattr(sets, "ROWS", most)
    rnd = random.Random(most)
    rows = []
    for i in range(60):
        base = rnd.sample(range(1 << 62), rnd.choice([1, 2, 5, 41, 50, 100, 400, 3000]))
        rows += [(10 * i + k, rnd.choice([0, 0, 0, 1]), base[: round(len(base) * s) or 1]) for k, s in enumerate((1, 0.9, 0.82, 0.75, 0.5))]
    df = spark.createDataFrame([(u, i, len(x), x) for i, u, x in rows], "user_id bigint, node bigint, n int, hashes array<bigint>")
    got = sorted(tuple(r) for r in sets.near(Scratch(spark, "near"), df, threshold).collect())
    assert len(got) == len(set(got)) < len(rows) ** 2 / 20
    held = [(i, u, set(x)) for i, u, x in rows]
    want = {(a, b) for a, u, x in held for b, v, y in held if a < b and u == v and len(x & y) / len(x | y) >= threshold}
    assert want <= set(got)


def test_sizes_a_band_apart_by_a_hair(spark):
    x = list(range(1, 51))
    df = spark.createDataFrame([(0, n, n, x[:n]) for n in (1, 41, 50)] + [(1, 7, 50, x)], "user_id bigint, node bigint, n int, hashes array<bigint>").withColumn("hashes", F.transform("hashes", lambda h: F.xxhash64(h)))
    assert [tuple(r) for r in sets.near(Scratch(spark, "near"), df, 0.82).collect()] == [(41, 50)]
