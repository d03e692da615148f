"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import pytest

from tessera.llm import arc, encoding, html, langid, lm, media, mixing, neardup, prefix, quality

LONG = "der lange Text hat viele Wörter und kein Ende " * 5000 + "x" * 70_000
TEXTS = [(1, "the cat sat on the mat with another cat"), (1, "the cat sat on the mat with another cat"), (2, "The cat sat on the mat, with another cat!"), (3, ""), (4, "  \n\t"), (5, None), (None, "the dog has no id at all here"), (6, LONG), (7, "?!"), (8, "a"), (9, "İ\U0001f600\u0000é")]
NAMES = ["doc_id", "text", "lang", "source", "DOC_ID", "text", "_c0", "id"]
KINDS = "doc_id bigint, a string, b string, c string, d string, e string, f string, g string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, [None, "en", "de"][(i or 0) % 3], [None, "s"][(i or 0) % 2], "x", "clash", None, "id") for i, t in TEXTS]
    return spark.createDataFrame(rows, KINDS).toDF(*NAMES)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KINDS).toDF(*NAMES)


OPERATORS = {
    "mixing": lambda d: mixing.take(d, budgets=("1/1",)),
    "language": langid.identify,
    "known": langid.keep_known,
    "encode": encoding.encode,
    "quality": quality.keep_good,
    "scores": quality.scores,
    "prefix": prefix.count_prefixes,
    "backoff": lm.score,
    "groups": neardup.groups,
    "copies": neardup.drop_copies,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(none, name):
    assert OPERATORS[name](none).collect() == []


@pytest.mark.parametrize("name", ["known", "quality", "copies", "mixing"])
def test_filters_keep_the_columns(odd, name):
    assert OPERATORS[name](odd).columns == NAMES


def test_mixing_of_odd_rows(odd):
    assert sum(r[0] == 1 for r in mixing.take(odd, budgets=("1/1",)).collect()) in (0, 2)
    assert {r["source"] for r in mixing.thresholds(odd, budgets=("1/2",)).collect()} == {None, "s"}


def test_mixing_is_nested_and_within_budget(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('w ', 1 + cast(id % 7 as int)) as text", "concat('src', id % 3) as source")
    rows = mixing.mix(docs, budgets=("1/4", "1/2")).collect()
    spent = lambda level, s: sum(len(r[1].split()) for r in rows if r["_level"] <= level and r[2] == s)
    total = sum(1 + i % 7 for i in range(2000))
    for level, share in ((0, 0.25), (1, 0.5)):
        for s, w in (("src0", 4), ("src1", 1), ("src2", 1)):
            assert spent(level, s) <= total * share * w / 6
            own = sum(1 + i % 7 for i in range(2000) if f"src{i % 3}" == s)
            assert spent(level, s) > min(own, total * share * w / 6) - 8


def test_language_of_odd_rows(odd):
    got = [r["_language"] for r in langid.identify(odd).collect()]
    assert len(got) == len(TEXTS)
    assert [got[i] for i in (3, 4, 5)] == ["und"] * 3
    assert got[0] == got[1]


def test_one_language_only_identifies_none(spark):
    docs = spark.createDataFrame([(1, "some text", "en")], "doc_id bigint, text string, lang string")
    assert [r["_language"] for r in langid.identify(docs).collect()] == ["und"]


def test_encoding_of_odd_rows(odd):
    rows = encoding.encode(odd).collect()
    assert len(rows) == len(TEXTS)
    assert all(r["round_trip"] for r in rows)
    assert sorted(r["n_tokens"] for r in rows)[:2] == [0, 0]
    back = encoding.decode(encoding.encode(odd)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t in TEXTS)


def test_decoding_of_odd_lists(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [None])], "doc_id bigint, token_ids array<int>")
    assert [r["text"] for r in encoding.decode(rows).collect()] == ["", "", ""]


def test_decoding_keeps_to_its_columns(spark):
    rows = spark.createDataFrame([(1, [64, 65], "x", "y"), (None, [66], "x", "y"), (1, [64, 65], "x", "y")], "doc_id bigint, token_ids array<int>, a string, b string").toDF("doc_id", "token_ids", "text", "DOC_ID")
    back = encoding.decode(rows)
    assert back.columns == ["doc_id", "text"]
    assert sorted(map(str, back.collect())) == sorted(["Row(doc_id=1, text='ab')", "Row(doc_id=None, text='c')", "Row(doc_id=1, text='ab')"])
    assert encoding.decode(rows.limit(0)).collect() == []


def test_stored_counts_of_nulls(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(None, 1), (bytearray(b"\x01\x01"), None), (bytearray(b""), 3), (bytearray(b"\x01\x00\xff\x01"), 2)], "d binary, n int")
    got = rows.select(prefix.count_at(F.col("d"), F.col("n")).alias("c"), prefix.fit(F.col("d"), F.col("n") - 2).alias("f")).collect()
    assert [tuple(r) for r in got] == [(None, None), (None, None), (0, 0), (1, 3)]


def test_quality_drops_what_has_no_words(odd):
    ids = [r[0] for r in quality.keep_good(odd).collect()]
    assert not {3, 4, 5} & set(ids)
    assert ids.count(1) in (0, 2)


def test_prefix_counts_of_odd_rows(odd):
    rows = {r["doc_id"]: r for r in prefix.count_prefixes(odd).collect()}
    assert (rows[5]["n_chars"], rows[5]["n_tokens"], bytes(rows[5]["prefix_deltas"])) == (0, 0, b"")
    assert rows[6]["n_chars"] == len(LONG)
    assert rows[6]["fit_128"] < rows[6]["fit_512"] < rows[6]["fit_2048"]


def test_backoff_of_odd_rows(odd):
    rows = lm.score(odd).collect()
    assert len(rows) == len(TEXTS)
    assert all(r["log_score"] == 0 for r in rows if r["n_words"] == 0)
    assert len({r["log_score"] for r in rows if r["doc_id"] == 1}) == 1


def test_near_duplicates_of_odd_rows(odd):
    assert sorted(map(tuple, neardup.groups(odd).collect())) == [(1, 1), (2, 1)]
    left = neardup.drop_copies(odd).collect()
    assert sorted(str(r[0]) for r in left) == sorted(["1", "3", "4", "5", "None", "6", "7", "8", "9"])


def test_null_kinds(spark):
    page = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "<p>" * 9), (3, "<!-- open"), (4, "a" * 300_000), (5, "<")], "page_id bigint, html string")
    assert [r["n_words"] for r in html.extract(page, weights=html.learn([])).collect()] == [0, 0, 0, 0, 0, 1, 1]
    assert html.extract(page.limit(0)).collect() == []
    vec = spark.createDataFrame([(None, None), (1, []), (2, [0.1, None])], "vec_id bigint, embedding array<float>")
    assert media.fingerprint(media.render(vec)).count() == 3
    bad = spark.createDataFrame([(1, None), (2, b""), (3, b"RIFFxxxx")], "id bigint, wav binary")
    assert [r["sample_rate"] for r in media.fingerprint(bad).collect()] == [None] * 3
    assert media.fingerprint(bad.limit(0)).collect() == []
    old = spark.createDataFrame([(None, None), ("a", b""), ("b", b"no archive\n"), ("b", b"no archive\n")], "archive string, content binary")
    assert [r["error"] for r in arc.convert(old).collect()] == ["empty archive"] * 2 + ["no version block"] * 2
    assert arc.convert(old.limit(0)).collect() == []
    assert arc.convert(arc.to_archives(spark.createDataFrame([(None, None, None)], "page_id bigint, url string, html string"))).count() == 2
