"""The entry points end to end, on a small store."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera import api
from tessera.config import Scoring
from tessera.operators import context, models
from tessera.sources import datasets

AS_OF = "2026-05-10T10:00:00Z"


def _answer(**kw):
    return json.dumps({"people": ["Ann"], "topics": ["Reviews"], "importance": 0.8, "confidence": 0.9, "type": "person_preference", "summary": "Ann likes short reviews"} | kw)


def test_from_answers_to_a_prompt(spark):
    as_of = F.to_timestamp(F.lit(AS_OF))
    rows = [(1, 7, "k1", 1, "note", _answer()), (2, 7, "k1", 2, "again", _answer()), (3, 7, None, 3, "n", _answer(summary="Budget risk in the migration", topics=["Migration"], people=[" ann ", "Bob"])), (4, 7, "old", 4, "n", _answer()), (5, 7, "k5", 5, "n", "no JSON"), (6, 8, "k1", 6, "n", _answer(summary="Another tenant"))]
    answers = spark.createDataFrame(rows, "id int, user_id int, idempotency_key string, seq int, raw_text string, raw string")
    good, bad = api.extract(answers)
    assert [(r["id"], r["error"]) for r in bad.collect()] == [(5, "invalid_json")]
    stored = spark.createDataFrame([(7, "old")], "user_id int, idempotency_key string")
    memories = api.new_memories(good, stored, as_of)
    assert sorted(r["id"] for r in memories.collect()) == [1, 3, 6]
    people = {(r["user_id"], r["normalized_name"]) for r in api.names_of(memories, "people").collect()}
    assert people == {(7, "ann"), (7, "bob"), (8, "ann")}
    first = spark.createDataFrame([(7, "Ann", ["Annie"])], "user_id int, name string, aliases array<string>").withColumn("created_at", as_of)
    for keep, want in ((False, []), (True, ["Annie"])):
        found = {(r["user_id"], r["normalized_name"]): r["aliases"] for r in api.names_of(memories, "people", first, keep).collect()}
        assert found[7, "ann"] == want
    held = memories.withColumn("dense", F.array(F.col("id").cast("double"), F.lit(1.0)))
    asked = spark.createDataFrame([(1, 7, "normal_answer", "short reviews", "what does Ann like", [1.0, 1.0], ["Ann"], ["reviews"])], "query_id int, user_id int, mode string, goal string, query string, query_dense array<double>, people array<string>, topics array<string>")
    none = spark.createDataFrame([], "query_id int, pos int, line string")
    packets = api.packet(asked, held, none, none, as_of, Scoring())
    packet = packets.first()
    assert packet["memory_lines"][0] == "Ann likes short reviews" and "Another tenant" not in packet["memory_lines"]
    assert packet["people_context"][0] == "Ann: Ann likes short reviews"
    assert packet["topic_context"][0] == "reviews: Ann likes short reviews"
    prompt = context.render_prompt(packets).first()["prompt"]
    assert "- Ann likes short reviews" in prompt
    assert sorted(r["id"] for r in api.list_memories(memories, 7).collect()) == [1, 3]
    assert [r["id"] for r in api.delete_memories(memories, memories.filter("user_id = 7")).collect()] == [6]


def test_outcomes_converge(spark):
    stored = spark.createDataFrame([("a", "x", 1)], "idempotency_key string, text string, user_id int")
    stored = stored.withColumn("request_hash", F.concat(F.lit("derived:"), F.sha2(F.to_json(F.struct("text", "user_id")), 256)))
    requests = spark.createDataFrame([("a", 1, "x", 1), ("b", 2, "y", 1), ("b", 3, "y", 1), ("b", 4, "other", 1), (None, 5, "z", 2), (" ", 6, "z", 2)], "idempotency_key string, seq int, text string, user_id int")
    done, conflicts = api.apply_outcomes(stored, requests, ("text", "user_id"))
    assert sorted(r["text"] for r in done.collect()) == ["x", "y", "z"]
    assert [tuple(r) for r in conflicts.collect()] == [("b", 2)]


def test_profiles(spark):
    m = models.models_of(spark.createDataFrame([(1, "t", 2, 1.6, 0.2, 1.0, 1.0, 0.0, None, None), (1, "u", 1, 0.5, 0.5, 0.5, 0.5, 0.9, None, None)], "person int, topic string, n bigint, sum_niceness double, sum_readiness double, sum_competence double, sum_capacity double, sum_confidence double, last_observed_at timestamp, last_evidence struct<seq:bigint,evidence_summary:string>"))
    got = api.person_profile(m, spark.createDataFrame([(1, "Ann")], "person int, name string")).collect()
    assert [r["topic"] for r in got] == ["u", "t"]
    assert got[1]["line"] == "1 on t: working estimate only; niceness high, readiness low, competence mixed, capacity mixed; confidence=; evidence_count=2. Treat as topic-specific and uncertain."


def test_evaluation_of_a_dataset(spark, tmp_path):
    cases = [{"id": "a", "title": "A", "expected_memory_keys": ["m1", "m2"], "expected_augmented_cues": ["short review", "evidence", "nothing here", " "], "expected_follow_up_cues": ["done"]}, {"id": "b", "title": "B", "expected_memory_keys": ["m3"], "expected_augmented_cues": [], "expected_follow_up_cues": []}, {"id": "c", "title": "C", "expected_memory_keys": ["m4"]}]
    (tmp_path / "d.json").write_text(json.dumps({"name": "tiny", "cases": cases}))
    read = datasets.evaluation_dataset(spark, str(tmp_path / "d.json"))
    assert {r["dataset"] for r in read.collect()} == {"tiny"}
    retrieved = spark.createDataFrame([("a", "m1"), ("a", "m9"), ("b", "m3"), ("c", "m4")], "id string, key string")
    outputs = spark.createDataFrame([("a", "augmented", "Short reviews with EVIDENCE"), ("a", "follow_up", "it is done"), ("b", "augmented", "x")], "id string, kind string, output string")
    runs = spark.createDataFrame([("a", False, 0.5, 0.5, 0.9, True, False), ("b", False, 0.0, 0.0, 0.0, False, False), ("c", True, 1.0, 1.0, 1.0, True, True)], "id string, failed boolean, strategy double, success double, likelihood double, has_outcome boolean, has_outcome_memory boolean")
    rows, total = api.evaluate(read, retrieved, outputs, runs)
    got = {r["id"]: r for r in rows.collect()}
    assert (got["a"]["hits"], got["a"]["precision"], got["a"]["coverage"], got["a"]["augmented_hits"], got["a"]["augmented_misses"], got["a"]["changed"]) == (1, 0.2, 0.5, 2, 2, True)
    assert (got["b"]["coverage"], got["b"]["augmented_hits"], got["b"]["changed"]) == (1.0, 0, False)
    s = total.first()
    assert (s["completed"], s["mean_precision"], s["mean_strategy"], s["mean_success"], s["mean_prediction_error"], s["behaviour_changed"], s["evaluated"]) == (2, 0.2, 0.5, 0.5, 0.4, 1, 1)
