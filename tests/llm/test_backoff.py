"""Stupid backoff on small and odd tables, and on any type of id."""

from __future__ import annotations

import math

import pytest

from tessera.llm import lm

A = math.log(lm.BACKOFF)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(1, None)], {1: (0, 0.0)}),
        ([(1, ""), (2, " ?!\n")], {1: (0, 0.0), 2: (0, 0.0)}),
        ([(1, "one")], {1: (1, 2 * A)}),
        ([(1, "a b")], {1: (2, 2 * A + math.log(1 / 2) + A)}),
        ([(1, "a b c d e")], {1: (5, 3 * A + math.log(1 / 5))}),
        ([(1, "a b c a b")], {1: (5, 3 * A + math.log(2 / 5) + math.log(1 / 2))}),
        ([(1, "x y"), (None, "x z"), (2, None)], {1: (2, 3 * A + 2 * math.log(1 / 2)), None: (2, 3 * A + 2 * math.log(1 / 2)), 2: (0, 0.0)}),
    ],
)
def test_small_tables(spark, rows, want):
    for chunk_bytes in (1, lm.CHUNK_BYTES):
        got = {r["doc_id"]: (r["n_words"], r["log_score"]) for r in lm.score(spark.createDataFrame(rows, "doc_id bigint, text string"), chunk_bytes=chunk_bytes).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()})


@pytest.mark.parametrize("kind", ["smallint", "int", "bigint", "string", "binary", "date", "decimal(9,2)"])
def test_any_type_of_id(spark, kind):
    docs = spark.range(30).selectExpr("cast(null as string) as extra", "concat('a b c ', id % 4, ' d e') as text", f"cast({'concat(id)' if kind == 'binary' else 'date_add(current_date(), cast(id as int))' if kind == 'date' else 'id'} as {kind}) as key")
    got = lm.score(docs, "key", chunk_bytes=40)
    assert got.schema["key"].dataType.simpleString() == kind
    assert got.count() == got.select("key").distinct().count() == 30
    assert got.agg({"n_words": "sum"}).first()[0] == 180


def test_many_chunks_score_like_one(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 3 + cast(id % 50 as int)), x -> concat('w', pmod(hash(id, x), 40)))) as text")
    one = {r[0]: r[2] for r in lm.score(docs).collect()}
    assert {r[0]: r[2] for r in lm.score(docs, chunk_bytes=500).collect()} == pytest.approx(one)
