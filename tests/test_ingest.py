"""Parsing, addresses, sources and sinks: the cases that the tables don't have."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.config import Scoring, Search, candidate_limit, list_limit, prefetch_limit
from tessera.operators import context, ingest, models, rerank
from tessera.sources import datasets

FIELDS = {"name": str, "tags": [str], "n": int, "x": float, "inner": {"a": str}, "meta": object}


@pytest.mark.parametrize(
    ("raw", "error"),
    [
        ('{"name":"a"}', None), (' {"NAME":null,"x":1}\n', None), ('{"inner":{"a":"b"},"meta":[1,{"z":2}]}', None), ("null", None),
        ("", "empty_body"), (" \n", "empty_body"), (None, "empty_body"), ('{"name":"a"', "invalid_json"), ('{"name":1}', "invalid_json"), ('{"n":1.5}', "invalid_json"), ('{"n":true}', "invalid_json"),
        ('{"other":1}', "invalid_json"), ('{"inner":{"b":1}}', "invalid_json"), ("[1]", "invalid_json"), ('{"x":NaN}', "invalid_json"), ('{"name":"a"} {}', "trailing_json"), ('{"name":"a"}5', "trailing_json"), ('{"name":"a"} what', "invalid_json"), ("[" * 100_000, "invalid_json"),
    ],
)
def test_bodies(raw, error):
    assert ingest.decode_body(raw, FIELDS)[1] == error


def test_unknown_fields_pass_where_not_strict():
    assert ingest.decode_body('{"other":1,"inner":{"b":2}}', FIELDS, strict=False) == ({"other": 1, "inner": {"b": 2}}, None)


@pytest.mark.parametrize("letter", ["a", "é"])
def test_body_of_exactly_one_mebibyte(spark, letter):
    width = len(letter.encode())
    room = (1 << 20) - len('{"name":""}')
    body = '{"name":"' + letter * (room // width) + " " * (room % width) + '"}'
    assert len(body.encode()) == 1 << 20
    assert ingest.decode_body(body, FIELDS)[1] is None
    assert ingest.decode_body(body + " ", FIELDS)[1] == "request_too_large"
    got = spark.createDataFrame([(body,), (body + " ",), (None,)], "raw string").select(ingest.request_body(F.col("raw"), FIELDS).alias("p")).select("p.error").collect()
    assert [r[0] for r in got] == [None, "request_too_large", "empty_body"]


def test_extractions():
    good = {"summary": " S ", "type": "outcome", "people": ["Ann", " ann ", ""], "topics": None, "entities": [{"name": "Ann", "type": "person"}, {"name": "ANN", "type": "person"}, {"name": "x", "type": " "}, None], "importance": 7, "expires_in_days": -1}
    value, error = ingest.parse_extraction("```json\n" + json.dumps(good) + "\n```")
    assert error is None
    assert value == {"summary": "S", "type": "outcome", "people": ["Ann"], "topics": [], "entities": [{"name": "Ann", "confidence": 0.0, "type": "person"}], "importance": 1.0, "utility": 0.0, "belief_impact": 0.0, "confidence": 0.0, "expires_in_days": None}
    for change, want in (({"summary": " "}, "summary is required"), ({"type": "gossip"}, "unknown type"), ({"entities": [{"type": "alien", "name": "x"}]}, "unknown entity type"), ({"more": 1}, "invalid_json"), ({"people": "Ann"}, "invalid_json")):
        assert ingest.parse_extraction(json.dumps(good | change))[1] == want
    assert ingest.parse_extraction(json.dumps(good) + json.dumps(good))[1] == "trailing_json"
    assert ingest.parse_extraction("no JSON")[1] == "invalid_json"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('" hi "', [("user", "hi")]), ('{"role":"assistant","content":"x"}', [("assistant", "x")]), ('[{"content":[{"text":"a"},{"text":" "},{"text":"b"},{"image":1}]},{"role":5,"content":"c"},{"content":7}]', [("user", "a\nb"), ("user", "c")]),
        ("", "input is required"), ("null", "input is required"), ("12", "unsupported input format"), ('" "', "input must not be empty"), ('{"content":""}', "input content must not be empty"), ("[]", "input produced no messages"), ('["a"]', "invalid input"), ('{"a"', "invalid input"),
    ],
)
def test_inputs(raw, want):
    got, error = ingest.parse_input(None, raw)
    assert (error if got is None else [(m["role"], m["content"]) for m in got]) == want
    got, _ = ingest.parse_input(" be kind ", raw)
    assert got is None or got[0] == {"role": "system", "content": "be kind"}


@pytest.mark.parametrize(
    ("remote", "forwarded", "want"),
    [
        ("10.0.0.1:9", None, "10.0.0.1"), ("10.0.0.1:9", "1.2.3.4", "1.2.3.4"), ("10.0.0.1:9", "9.9.9.9, 1.2.3.4, 10.0.0.2", "1.2.3.4"), ("8.8.8.8:9", "1.2.3.4", "8.8.8.8"), ("10.0.0.1:9", "1.2.3.4, bad, 10.0.0.2", "10.0.0.1"),
        ("10.0.0.1:9", "10.0.0.3,10.0.0.2", "10.0.0.3"), ("[::ffff:10.0.0.1]:9", "::ffff:1.2.3.4", "1.2.3.4"), ("[fd00::1]:80", "2001:db8::5", "2001:db8::5"), ("10.0.0.1", "fe80::1%eth0", "10.0.0.1"), ("", "1.2.3.4", ""), ("what", "1.2.3.4", ""), ("10.0.0.1:9", " ", "10.0.0.1"),
    ],
)
def test_client_addresses(remote, forwarded, want):
    assert ingest.resolve_client(remote, forwarded, ("10.0.0.0/8", "fd00::/8")) == want


def test_limits():
    assert [candidate_limit(n) for n in (0, 1, 50, 2**63 - 1)] == [40, 20, 200, 200]
    assert prefetch_limit(2**63 - 1) == 600
    for wrong in (-1, 51, 2**63 - 1):
        with pytest.raises(ValueError):
            Search(limit=wrong)
    with pytest.raises(ValueError):
        list_limit(101)
    assert (list_limit(0), list_limit(100), Search(limit=0).results) == (50, 100, 10)


def test_weights_and_thresholds():
    w = Scoring({"retrieval": 0.0, "recency": -1.0, "goal": None, "utility": 0.3}).normalized()
    assert w["goal"] == 0
    assert w["retrieval"] / w["recency"] == pytest.approx(0.35 / 0.15)
    assert sum(w.values()) == pytest.approx(1)
    assert [Scoring(redundancy=x).threshold for x in (0, -1, 0.5, 3)] == [0.82, 0.82, 0.5, 1.0]
    assert Scoring(half_life_days=0).half_life == 30


def test_greedy_goes_on_behind_the_first_block(spark):
    """500 copies of one summary come first; the walk must reach the others behind them."""
    rows = spark.range(700).selectExpr("1 as query_id", "id", "cast(id + 1 as int) as place", "1.0 - id / 1000 as final", "if(id < 500, 'same words here', concat('own', id, ' word', id * 7)) as summary")
    got = sorted((r["rank"], r["id"]) for r in rerank.greedy(rows, 5).collect())
    assert got == [(1, 0), (2, 500), (3, 501), (4, 502), (5, 503)]
    assert rerank.greedy(rows.limit(0), 5).collect() == []


def test_budget_fold_by_a_plain_loop(spark):
    import random

    rnd = random.Random(1)
    rows = [(q, r, q * 1000 + r, "x" * rnd.choice([5, 40, 90, 180, 400]) + str(rnd.randrange(60)), "") for q in range(4) for r in range(300)]
    df = spark.createDataFrame(rows, "query_id int, rank int, id int, summary string, raw_text string")
    for budget in (100, 400, 2200):
        want = {}
        for q in range(4):
            ids, seen, used, omitted = [], set(), 0, 0
            for _, _, i, s, _ in [r for r in rows if r[0] == q]:
                if s in seen:
                    continue
                seen.add(s)
                n = min(len(s), 180)
                if len(ids) >= 6 or used + n > budget:
                    omitted += 1
                else:
                    ids.append(i)
                    used += n
            want[q] = (ids, omitted)
        assert {r["query_id"]: (r["ids"], r["omitted"]) for r in context.memory_context(df, budget=budget).collect()} == want


def test_context_packet(spark):
    packets = spark.createDataFrame([(1, "normal_answer", "g", "q", ["Ann", "Bob"], ["x"]), (2, "normal_answer", "", "", [], [])], "query_id int, mode string, goal string, query string, people array<string>, topics array<string>")
    results = spark.createDataFrame([(1, 1, 11, "first", "", ["bob"], ["X", "y"]), (1, 2, 12, "second", "", ["ann", "cy"], ["y"]), (1, 3, 13, "First", "", ["dan"], [])], "query_id int, rank int, id int, summary string, raw_text string, people array<string>, topics array<string>")
    model = spark.createDataFrame([(1, 0, "Ann: second"), (1, 1, "Ann is calm")], "query_id int, pos int, line string")
    belief = spark.createDataFrame([(1, 0, "b"), (1, 1, " B ")], "query_id int, pos int, line string")
    got = {r["query_id"]: r for r in context.context_packet(packets, results, model, belief).collect()}
    assert got[1]["memory_lines"] == ["first", "second"] and got[1]["omitted"] == 0
    assert got[1]["people_context"] == ["Ann: second", "Ann is calm", "Bob: first", "cy: second", "dan: First"]
    assert got[1]["topic_context"] == ["x: first", "y: first", "y: second"]
    assert got[1]["belief_context"] == ["b"]
    assert got[2]["memory_lines"] == got[2]["people_context"] == []
    prompts = {r["query_id"]: r["prompt"] for r in context.render_prompt(context.context_packet(packets, results, model, belief), "Be brief.").collect()}
    assert "- Bob: first" in prompts[1] and "No relevant memories." in prompts[2] and "Be brief." in prompts[1]


def test_manual_edits_weigh_by_their_count(spark):
    stored = spark.createDataFrame([("a", "t", 0.5, 0.5, 0.5, 0.5, 0.5, 3, None), ("b", "t", 0.9, 0.9, 0.9, 0.9, 0.9, 0, None)], "person string, topic string, niceness double, readiness double, competence double, capacity double, confidence double, evidence_count bigint, last_observed_at timestamp")
    seen = spark.createDataFrame([(p, "t", 1, 1, 0.1, 0.1, 0.1, 0.1, 0.1, "") for p in "ab"], "person string, topic string, memory_id bigint, seq bigint, niceness double, readiness double, competence double, capacity double, confidence double, evidence_summary string").withColumn("observed_at", F.lit("2024-01-01").cast("timestamp"))
    got = {r["person"]: (r["niceness"], r["evidence_count"]) for r in models.person_topic_models(seen, models.state_of(stored)).collect()}
    assert got == {"a": (0.4, 4), "b": (0.1, 1)}


def test_reports_appends_and_pools(spark, tmp_path):
    summary = spark.createDataFrame([(2, 0.5)], "completed bigint, mean_precision double")
    cases = spark.createDataFrame([("b", "Second", 1), ("a", "First", 2)], "id string, title string, hits bigint")
    files = datasets.write_report(spark, summary, cases, str(tmp_path), "2024-02-01 10:00:00")
    datasets.write_report(spark, summary, cases.limit(1), str(tmp_path), "2024-02-02 10:00:00")
    assert len(files) == 4
    assert len(json.loads(Path(files[0]).read_text())["cases"]) == 2
    assert len(json.loads((tmp_path / "latest.json").read_text())["cases"]) == 1
    assert "### First" in Path(files[2]).read_text()
    at = str(tmp_path / "messages")
    m = spark.createDataFrame([("user", "hello")], "role string, content string")
    datasets.append(m, at, ("content",), ("user",))
    datasets.append(m, at, ("content",), ("user",))
    for bad in (spark.createDataFrame([("user", " ")], m.schema), spark.createDataFrame([("robot", "x")], m.schema)):
        with pytest.raises(Exception, match=r"required|unknown role"):
            datasets.append(bad, at, ("content",), ("user",))
    assert spark.read.parquet(at).count() == 2
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        spark.range(100).selectExpr("id", "id % 7 as k").write.format("jdbc").options(url=url, dbtable="t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    except Exception as e:  # no such driver beside Spark
        pytest.skip(str(e)[:80])
    got = datasets.pool(spark, url, "t", "ID", (0, 100), 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert got.rdd.getNumPartitions() == 4
    assert got.filter("K = 3").count() == 14


def test_dataset_that_is_none_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"name": "d", "cases": [{"id": "1", "people": 5}]}')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        datasets.evaluation_dataset(spark, str(tmp_path / "x.json")).collect()


def test_sentence_query_leaves_blank_texts(spark, tmp_path):
    """F09 as its SQL has it; the function itself has words for a missing draft."""
    import duckdb

    from tessera.functions import text
    from tessera.operators import catalogue

    rows = [(1, " \n\t"), (2, ""), (3, None), (4, " a b "), (5, "x" * 130)]
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' as lang", "'s' as source").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(catalogue.ORACLE_SQL["f09_sentence"]).fetchall())
    assert sorted(tuple(r) for r in catalogue.QUERIES["f09_sentence"](spark, str(tmp_path)).select("doc_id", "value").collect()) == want
    assert spark.range(1).select(text.sentence(F.lit(" ")).alias("x")).first()["x"] == "No message draft available."
