"""Scores in blocks against plain loops over all pairs, whatever the blocks."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, retrieval

WORDS = [f"w{i}" for i in range(40)] + [f"rare{i}" for i in range(400)]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    text = lambda: " ".join(rnd.choices(WORDS[:40], k=20) + rnd.choices(WORDS, k=9))
    pick = lambda xs, n: rnd.sample(xs, rnd.randrange(n))
    memories = [(i, rnd.choice([0, 0, 0, 1, None]), rnd.choice(["a", "b"]), pick(["p", "q", "r"], 3), pick(["s", "t", "u"], 3), rnd.choice([0.05, 0.4, 0.9, None]), rnd.choice([text(), text(), text(), "", None]), [float(rnd.randrange(-3, 4)) for _ in range(4)]) for i in range(300)]
    queries = [(1000 + i, rnd.choice([0, 0, 1, 2]), rnd.choice(["", " a ", None]), pick(["p", "q"], 3), rnd.choice([None, [], ["s"], ["t", "x"]]), rnd.choice([0.0, 0.1, 0.5]), text(), rnd.choice(["", text()]), [float(rnd.randrange(-3, 4)) for _ in range(4)]) for i in range(60)]
    m = spark.createDataFrame(memories, "id bigint, user_id bigint, memory_type string, people array<string>, topics array<string>, confidence double, summary string, dense array<double>").withColumn("raw_text", F.col("summary"))
    q = spark.createDataFrame(queries, "query_id bigint, user_id bigint, memory_type string, people_any array<string>, topics_any array<string>, min_confidence double, query string, goal string, query_dense array<double>")
    return memories, queries, m, q


def _ranked(pairs, k):
    out = {}
    for (query, i), x in pairs.items():
        out.setdefault(query, []).append((-x, i))
    return {(query, i): (pytest.approx(-x), rank) for query, xs in out.items() for rank, (x, i) in enumerate(sorted(xs)[:k], 1)}


@pytest.mark.parametrize("block", [(1024, 8192), (16, 50)])
def test_blocks_give_what_all_pairs_give(spark, rows, monkeypatch, block):
    memories, queries, m, q = rows
    monkeypatch.setattr(retrieval, "BLOCK", block)
    monkeypatch.setattr(retrieval, "ALL_BLOCK", block)
    monkeypatch.setattr(blocks, "STEP", 1000)
    passed = {(r["query_id"], r["id"]) for r in retrieval.eligible(q, m).select("q.query_id", "m.id").collect()}
    assert 0 < len(passed) < len(memories) * len(queries)
    held, asked = {r[0]: r for r in memories}, {r[0]: r for r in queries}
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v]
    cos = {(a, b): round(sum(x * y for x, y in zip(unit(asked[a][8]), unit(held[b][7]), strict=True)), 6) + 0.0 for a, b in passed}
    words = {(a, b): sum((held[b][6] or "").split().count(t) for t in asked[a][6].split()) for a, b in passed}
    got = {(r["query_id"], r["id"]): (r["dense"], r["rank"]) for r in retrieval.dense_topk(q, m, 7).collect()}
    assert got == _ranked(cos, 7)
    got = {(r["query_id"], r["id"]): (r["sparse"], r["rank"]) for r in retrieval.sparse_topk(q, m, 7).collect()}
    assert got == _ranked({p: float(x) for p, x in words.items() if x}, 7)
    got = {(r["query_id"], r["id"]): r["goal_relevance"] for r in retrieval.goal_relevance(q, m).collect()}
    want = {}
    for a in queries:
        for b in memories:
            if a[1] == b[1]:
                goal, own = set(a[7].split()), {*(b[6] or "").split()}
                want[a[0], b[0]] = pytest.approx(len(goal & own) / len(goal), abs=1e-9) if goal else 0.0
    assert got == want


def test_vectors_of_other_lengths_come_last(spark):
    q = spark.createDataFrame([(1, 0, [1.0, 0.0])], "query_id bigint, user_id bigint, query_dense array<double>")
    m = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [-1.0, 0.0]), (3, 0, None), (4, 0, [2.0, 0.0])], "id bigint, user_id bigint, dense array<double>")
    assert [tuple(r) for r in retrieval.dense_topk(q, m, 9).select("id", "dense", "rank").orderBy("rank").collect()] == [(4, 1.0, 1), (2, -1.0, 2), (1, None, 3), (3, None, 4)]


def test_thousands_of_queries_send_a_memory_once(spark):
    from test_sets import _shuffled

    q = spark.createDataFrame([(i, 0, [1.0, i / 10]) for i in range(3000)], "query_id bigint, user_id bigint, query_dense array<double>")
    few, many = (_shuffled(spark, lambda n=n: retrieval.dense_topk(q, spark.createDataFrame([(i, 0, [i / 7, 1.0]) for i in range(n)], "id bigint, user_id bigint, dense array<double>"), 1)) for n in (500, 1500))
    assert 1000 <= many - few < 1500


def test_best_of_numbers_that_rounding_makes_equal():
    x = np.array([0.1, 0.5000001, 0.5000002, 0.5, 0.5000004, 0.7])
    for k, want in ((2, [5, 1]), (3, [5, 1, 2]), (5, [5, 1, 2, 3, 4]), (9, [5, 1, 2, 3, 4, 0])):
        at, of = blocks.best(x, x > 0, k, 6)
        assert list(at) == want and list(of) == [round(x[i], 6) for i in want]
