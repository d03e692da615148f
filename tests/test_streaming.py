"""Streams against their batch forms, and the limiter against a plain loop."""

from __future__ import annotations

import random

from tessera.operators.queries_stream import _arriving, _run
from tessera.operators.catalogue import QUERIES
from tessera.plans.scratch import Scratch
from tessera.sources.views import requests
from tessera.streaming import folds, limiter


def loop(rows, limit, window):
    """rows of (client, t, event_id), by the definition: a list of allowed times a client."""
    out, logs = {}, {}
    for client, t, event in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        log = logs.setdefault(client, [])
        log[:] = [x for x in log if x >= t - window]
        if len(log) < limit:
            log.append(t)
            out[event] = (client, True, 0.0)
        else:
            out[event] = (client, False, round(max(log[0] + window - t, 1.0), 3))
    return out


def _got(df):
    return {r["event_id"]: (r["client"], r["allowed"], r["retry_after"]) for r in df.collect()}


def test_sliding_log_of_all_requests(spark, data):
    rows = [(r["client"], r["ts"].timestamp(), r["event_id"]) for r in requests(spark, data).select("client", "event_id", "ts").collect()]
    want = loop(rows, 5, 86400.0)
    assert not all(x[1] for x in want.values())
    assert _got(QUERIES["t01_sliding_log"](spark, data)) == want
    assert _got(QUERIES["t01_limiter_stream"](spark, data)) == want


def test_one_busy_client_and_null_clients(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([7, 7, 7, 8, None]), rnd.randrange(20_000) / 2, i) for i in range(30_000)]
    df = spark.createDataFrame(rows, "client bigint, t double, event_id bigint").selectExpr("client", "timestamp_micros(cast(t * 1000000 as bigint)) as ts", "event_id")
    assert _got(limiter.sliding_log(df, 60, 60.0)) == loop(rows, 60, 60.0)


def test_idle_clients_lose_their_state(spark):
    """A client that comes back after the window and the idle time starts anew, as it would without."""
    scratch = Scratch(spark, "idle")
    rows = [(1, 10.0 + 10 * i, i) for i in range(8)] + [(2, 5000.0 + i, 100 + i) for i in range(3)] + [(1, 9000.0 + i, 200 + i) for i in range(8)]
    df = spark.createDataFrame(rows, "client bigint, t double, event_id bigint").selectExpr("client", "timestamp_micros(cast(t * 1000000 as bigint)) as ts", "event_id", "t as order")
    _run(limiter.limited_stream(_arriving(df, scratch, "order"), 4, 60.0, idle_seconds=600.0), scratch, path=f"{scratch.path}/out")
    assert _got(spark.read.parquet(f"{scratch.path}/out")) == loop(rows, 4, 60.0)


def test_a_batch_run_again_counts_once(spark, tmp_path):
    kinds = "person string, topic string, memory_id bigint, seq bigint, niceness double, readiness double, competence double, capacity double, confidence double, evidence_summary string, observed_at timestamp"
    rows = spark.createDataFrame([("a", "t", i, i, 0.2, 0.2, 0.2, 0.2, 0.2, "", None) for i in range(5)], kinds)
    run = folds.fold_models(str(tmp_path))
    run(rows.limit(3), 0)
    for _ in range(2):
        run(rows, 1)
    v = folds.Versions(spark, str(tmp_path))
    assert v.last("models") == 1
    assert [r["n"] for r in v.read("models", 1).collect()] == [5]


def test_stages_resume_where_they_failed(spark, tmp_path):
    ran, bad = [], {"index": 3}

    def stage(name):
        def run(df):
            ids = sorted(r["id"] for r in df.select("id").collect())
            ran.append((name, ids))
            return spark.createDataFrame([(i, "no" if bad.get(name) == i else None) for i in ids], "id bigint, error string")

        return run

    items, stages = spark.range(1, 5), {s: stage(s) for s in ("extract", "index", "model")}
    got = {r["id"]: r for r in folds.resume(spark, str(tmp_path), items, stages).collect()}
    assert (got[3]["extract_status"], got[3]["index_status"], got[3]["model_status"], got[3]["failed_stage"], got[3]["last_error"]) == ("completed", "failed", "pending", "index", "no")
    assert got[1]["model_status"] == "completed"
    ran.clear()
    bad.clear()
    got = {r["id"]: r for r in folds.resume(spark, str(tmp_path), spark.range(1, 7), stages).collect()}
    assert [(s, set(i)) for s, i in ran] == [("extract", {5, 6}), ("index", {3, 5, 6}), ("model", {3, 5, 6})]
    assert all(r["model_status"] == "completed" and r["last_error"] is None for r in got.values())


def test_large_batches_are_of_several_files(spark, monkeypatch):
    """A batch for each part of the order, whole, in order, and written by several tasks."""
    from tessera.operators import queries_stream

    monkeypatch.setattr(queries_stream, "FILE_ROWS", 100)
    scratch, seen = Scratch(spark, "several"), []
    stream = _arriving(spark.range(3000).withColumnRenamed("id", "order"), scratch, "order")
    _run(stream, scratch, batch=lambda df, n: seen.append((sorted(r["order"] for r in df.collect()), len(df.inputFiles()))))
    rows = [x for xs, _ in seen for x in xs]
    assert rows == list(range(3000)) and len(seen) == 3
    assert len(spark.read.parquet(f"{scratch.path}/arriving").inputFiles()) > 2 * len(seen)
