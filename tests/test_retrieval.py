"""Fixed cases of ranking and retrieval, and the similarity join by brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.config import Scoring
from tessera.functions import lists, text
from tessera.operators import models, rerank, retrieval

AS_OF = "2026-05-10T10:00:00Z"


def test_three_candidates(spark):
    same = "Alex wants scoped API reviews with action items and evidence"
    rows = [("old", "Alex prefers tightly scoped API review requests", 0.25, 0.2, 0.1, 0.35, 90 * 24, 1.0), ("fresh", same, 0.95, 0.95, 0.55, 0.95, 24, 0.72), ("copy", same, 0.9, 0.9, 0.5, 0.9, 2, 0.7)]
    df = spark.createDataFrame(rows, "id string, summary string, importance double, utility double, belief_impact double, confidence double, hours int, retrieval double")
    as_of = F.to_timestamp(F.lit(AS_OF))
    df = df.select("*", F.lit(1).alias("query_id"), F.col("summary").alias("raw_text"), F.lit("person_preference").alias("memory_type"), F.array(F.lit("Alex")).alias("people"), F.array(F.lit("api_review")).alias("topics"), F.lit("api scoped review request").alias("goal"), F.lit("").alias("query"), F.timestamp_seconds(as_of.cast("bigint") - F.col("hours") * 3600).alias("created_at"))
    scored = rerank.features(df, as_of, Scoring(redundancy=0.8))
    got = sorted(rerank.greedy(rerank.ranked(scored), 5, Scoring(redundancy=0.8), most=5).collect(), key=lambda r: r["rank"])
    assert [r["id"] for r in got] == ["fresh", "old"]
    assert got[0]["final"] > got[1]["final"] and got[1]["max_similarity"] > 0
    held = {r["id"]: r for r in scored.collect()}
    assert held["fresh"]["goal_relevance"] > 0
    assert held["fresh"]["recency"] > held["old"]["recency"]


def test_sparse_vectors(spark):
    got = spark.createDataFrame([("API review api scope",), ("",), (None,), ("b " * 5 + "aa aa zz",)], "t string").select(retrieval.sparse_vector(F.col("t")).alias("v")).select("v", F.map_keys("v").alias("k")).collect()
    assert sorted(got[0]["v"].values()) == [1.0, 1.0, 2.0] and got[0]["k"] == sorted(got[0]["k"])
    assert got[1]["v"] == got[2]["v"] == {}
    assert sorted(got[3]["v"].values()) == [1.0, 2.0]


@pytest.mark.parametrize(
    ("query", "needed"),
    [("Please summarize how the migration stands for our committee, with its risk, and what to emphasize to Dana.", False), ("Help me ask Alex to review the infrastructure proposal this week.", True)],
)
def test_people_filter(spark, query, needed):
    names = F.array(F.lit("Dana"))
    got = spark.range(1).select(retrieval.people_filter_needed(F.lit(query), F.lit(""), names, names).alias("with_topics"), retrieval.people_filter_needed(F.lit(query), F.lit(""), names, F.array().cast("array<string>")).alias("without")).first()
    assert (got["with_topics"], got["without"]) == (needed, True)


def test_similar_summaries_are_those_of_all_pairs(spark):
    rnd = random.Random(4)
    words = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(160):
        base = rnd.sample(words, 40)
        rows.append((i, i % 2, " ".join(base)))
        if i % 4 == 0:
            rows.append((1000 + i, i % 2, " ".join(base[: rnd.choice([33, 36, 40])])))
    rows += [(2000 + i, i % 2, "the same words again") for i in range(400)] + [(3000, 0, ""), (3001, 0, None)]
    got = {(r["a"], r["b"]): r["similarity"] for r in rerank.similar_summaries(spark.createDataFrame(rows, "id bigint, user_id bigint, summary string")).collect()}
    classes = {}
    for i, u, t in rows:
        classes.setdefault((u, frozenset((t or "").split())), []).append(i)
    want = {}
    heads = [(u, s, min(ids)) for (u, s), ids in classes.items() if s]
    for (_, s), ids in classes.items():
        want |= {(min(ids), i): 1.0 for i in ids if s and i != min(ids)}
    for k, (u, s, a) in enumerate(heads):
        for v, t, b in heads[k + 1 :]:
            if u == v and len(s & t) / len(s | t) >= 0.82:
                want[min(a, b), max(a, b)] = len(s & t) / len(s | t)
    assert got == pytest.approx(want)


def test_contradicting_beliefs(spark):
    rows = [(1, None, m, " Claim  A", s, c, q) for q, (m, s, c) in enumerate([(1, "supports", 0.74), (2, "contradicts", 0.68), (2, "supports", 1.0), (3, "support", 0.9)])]
    df = spark.createDataFrame(rows, "user_id int, topic_id int, memory_id int, claim string, stance string, confidence double, seq int").withColumn("observed_at", F.lit("2024-01-01").cast("timestamp"))
    r = models.fold_beliefs(df.filter("seq < 3")).first()
    assert (r["stance"], r["confidence"], r["evidence_count"], r["contradiction"], r["stance_history"]) == ("unknown", 0.6, 2, True, ["supports", "contradicts"])
    r = models.fold_beliefs(df).first()
    assert (r["stance"], r["confidence"], r["contradiction"]) == ("supports", 0.7, True)
    state = models.belief_state(df.filter("seq < 1"))
    for q in (1, 2, 3):  # an observation at a time
        old = df.filter(F.col("seq") < q).withColumn("key", text.normalize_name(F.col("claim")))
        state = models.belief_state(df.filter(F.col("seq") == q), state, old)
    assert models.beliefs_of(state).drop("last_observed_at").first() == models.fold_beliefs(df).drop("last_observed_at").first()


def test_scores_and_lists(spark):
    got = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (0.104,), (None,), (7.0,)], "x double").select(text.score_text(F.col("x")).alias("a"), text.bare_score(F.col("x")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("0", ""), ("0.5", "0.5"), ("1", "1"), ("0.1", "0.1"), ("0", ""), ("1", "1")]
    got = spark.createDataFrame([(["A  b", "a b", " ", "C"],)], "x array<string>").select(lists.unique_names(F.col("x")).alias("n"), lists.unique(F.col("x")).alias("u")).first()
    assert got["n"] == ["A  b", "C"] and got["u"] == ["A  b", "a b", "C"]
    got = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>").select(lists.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r["c"] for r in got] == pytest.approx([1.0, 0.0])
