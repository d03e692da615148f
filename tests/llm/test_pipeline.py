"""The pipeline on odd and empty tables."""

from __future__ import annotations

import corpus_pipeline
from tessera.sources.tables import table

KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _c0 string, id string, extra array<int>"


def _folder(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, _folder(spark, spark.createDataFrame([], KINDS), tmp_path)).collect() == []


def test_odd_rows_and_extra_columns(spark, data, tmp_path):
    own = table(spark, data, "documents").selectExpr("doc_id", "text", "lang", "source", "n_chars", "'a' as _c0", "'b' as id", "array(1) as extra")
    texts = {r["doc_id"]: r["text"] for r in own.collect()}
    some = max((t for t in texts.values() if t and len(t) < 4000), key=len)
    odd = [(None, some + " end", "en", "src1", None, None, None, None), (9001, None, None, None, None, None, None, None), (9002, "", "en", "src1", 0, "", "", []), (9003, " \n\t", None, "src1", 3, None, None, None), (9004, some[: len(some) // 2] * 60, None, None, 1, None, None, None), (None, None, None, None, None, None, None, None)]
    docs = own.unionByName(spark.createDataFrame(odd, KINDS)).unionByName(own.filter("doc_id % 3 = 0"))
    folder = _folder(spark, docs, tmp_path)
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, folder)
        assert after.columns == columns, name
        rows = after.collect()
        assert 0 < len(rows) <= now.count()
        now = spark.createDataFrame(rows, docs.schema)
    kept = [r["doc_id"] for r in now.collect()]
    assert not {9001, 9002, 9003} & set(kept)
    known = [k for k in kept if k is not None]
    assert len(known) == len(set(known))
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, (r["doc_id"] for r in out))) == sorted(map(str, kept))
    assert all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) > 0 for r in out)
