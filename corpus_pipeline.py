"""The corpus pipeline: quality rules, language, near duplicates, source mix, tokens.

Each stage takes the documents that the one before wrote and works on all of them. The first four
return documents with their columns as they are, extra ones included; the last returns the tokens. Any
column may be null in any row, texts may be empty or very long, rows may be repeated and the table empty:
what becomes of such rows is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import encoding, langid, mixing, neardup, quality
from tessera.plans.scratch import Scratch
from tessera.sources.tables import table

#: Share of the tokens left after the first three stages that the mix may have, by mixing.WEIGHTS.
MIX_BUDGET = ("9/10",)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the quality fences of their language and source (operator 7). Null, empty and blank
    texts go; a null language or source is one like any other; a value on a fence is within; repeated rows
    share their fate."""
    return quality.keep_good(docs)


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages (operator 5), whatever their own label. Without two labels
    none is known and all go; of equal scores the first language of the alphabet counts; repeated rows share
    their fate."""
    return langid.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates, and all without any (operator 10). Of rows
    that repeat a kept id one stays; rows without an id stay, as nothing tells them apart."""
    return neardup.drop_copies(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix of sources at the target weights, which bound what a source gets (operator 1). A null
    source has the default weight; rows without an id come in or stay out together, as do equal hashes."""
    return mixing.take(docs, budgets=MIX_BUDGET)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and round_trip of every document left (operator 6); null ids are kept."""
    return encoding.encode(docs)


STAGES = [
    ("quality", good_documents),
    ("language", known_languages),
    ("near_duplicates", one_of_each_group),
    ("mixing", mixed_sources),
    ("bpe", encoded),
]

#: Language identification has no SQL; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents of ``sf_dir``. What a stage returns is written as
    Parquet to the shared folder, read again by the next and then deleted; only the documents that the
    last stage reads, when its result is, stay."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.write(docs, name)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
