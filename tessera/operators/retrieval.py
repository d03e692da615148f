"""Hybrid retrieval for batches of queries: filters, dense and sparse top-k, rank fusion.

Queries and memories of a tenant meet in blocks (see ``blocks``), of which only the results inside the cut
are shuffled, by query. ``candidates`` writes the queries, and the two lists that are used twice, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Scoring, Search
from tessera.functions.lists import unit
from tessera.functions.text import clamp, contains_any, first_non_blank, hash_token, strip, token_set, tokens
from tessera.operators import blocks
from tessera.operators.rerank import features, greedy, memory_tokens, ranked
from tessera.plans.scratch import Scratch, small

STATE_CUES = "approval current delay incident issue launch migration risk rollout status summarize summary timeline".split()
#: Most queries and memories of a block, for a cut and where every pair is a result.
BLOCK, ALL_BLOCK = (8192, 4096), (512, 4096)
GUIDE_CUES = ["board", "committee", "emphasize to", "leadership", "stakeholder", "what to emphasize"]


def any_match(column: Column, wanted: Column) -> Column:
    """Nothing wanted, or an exact common element."""
    return F.coalesce(F.size(wanted) <= 0, F.lit(True)) | F.arrays_overlap(column, wanted)


def of_type(column: Column, wanted: Column) -> Column:
    """The type asked for, stripped, or no type asked for."""
    asked = strip(F.coalesce(wanted, F.lit("")))
    return (asked == "") | (column == asked)


def confident(column: Column, least: Column) -> Column:
    """At least the clamped threshold."""
    return column >= clamp(least)


def people_filter_needed(query: Column, goal: Column, people: Column, topics: Column) -> Column:
    """People are required, unless topics are given too and the text asks about the state of a
    project on behalf of stakeholders."""
    text = F.lower(F.concat_ws(" ", query, goal))
    mixed = contains_any(text, STATE_CUES) & contains_any(text, GUIDE_CUES)
    return (F.size(people) > 0) & ~((F.size(topics) > 0) & mixed)


def unexpired(expires_at: Column, as_of: Column) -> Column:
    """Expired is strictly before."""
    return expires_at.isNull() | (expires_at >= as_of)


def sparse_vector(text: Column) -> Column:
    """A map of token hash to count in ascending order of the hash; tokens whose hashes collide
    add up. Runs of the sorted hashes are counted, so it costs no more than the sort."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        return F.transform(F.array(starts), lambda at: F.map_from_arrays(F.transform(at, lambda i: F.get(s, i)), F.transform(at, lambda i, k: (F.coalesce(F.get(at, k + 1), n) - i).cast("double"))))[0]

    return F.transform(F.array(F.array_sort(F.transform(tokens(text), hash_token))), runs)[0]


def sparse_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """V04 exploded: (key, idx, w), built by a grouped count rather than in one row."""
    return df.select(key, F.explode(F.transform(tokens(F.col(text)), hash_token)).alias("idx")).groupBy(key, "idx").agg(F.count("*").cast("double").alias("w"))


def _wanted(queries: DataFrame) -> Column:
    """P01-P06 as a condition between rows of a query ``q`` and a memory ``m``. Optional columns of
    ``queries``: memory_type, people_any, topics_any, min_confidence."""
    on, have = F.col("q.user_id") == F.col("m.user_id"), queries.columns
    if "memory_type" in have:
        on &= of_type(F.col("m.memory_type"), F.col("q.memory_type"))
    topics = F.col("q.topics_any") if "topics_any" in have else F.array().cast("array<string>")
    if "topics_any" in have:
        on &= any_match(F.col("m.topics"), topics)
    if "people_any" in have:
        need = people_filter_needed(F.col("q.query"), F.col("q.goal"), F.col("q.people_any"), topics)
        on &= ~need | F.arrays_overlap(F.col("m.people"), F.col("q.people_any"))
    if "min_confidence" in have:
        on &= confident(F.col("m.confidence"), F.col("q.min_confidence"))
    return on


def eligible(queries: DataFrame, memories: DataFrame) -> DataFrame:
    """Pairs of a query and the memories of its tenant that pass the index filters."""
    return memories.alias("m").join(small(queries).alias("q"), _wanted(queries))


def _top(scored: DataFrame, k: int, score: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _needed(queries: DataFrame) -> Column | None:
    topics = F.col("topics_any") if "topics_any" in queries.columns else F.array().cast("array<string>")
    return people_filter_needed(F.col("query"), F.col("goal"), F.col("people_any"), topics) if "people_any" in queries.columns else None


def dense_topk(queries: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """(query_id, id, dense, rank) by cosine. Vectors are brought to length 1 once a row, and multiplied
    in blocks."""
    asked, held = blocks.conditions(queries, _needed(queries))
    q = queries.select("query_id", "user_id", unit(F.col("query_dense")).alias("_v"), *(c.alias(n) for n, c in asked.items()))
    m = memories.select("id", "user_id", unit(F.col("dense")).alias("_v"), *(c.alias(n) for n, c in held.items()))
    found = blocks.scored(Scratch(queries.sparkSession, "dense"), q, m, "_v", BLOCK, blocks.top(k, blocks.cosines, float("-inf"), 6), "dense")
    return _top(found.withColumn("dense", F.when(F.col("dense") > -2, F.col("dense"))), k, "dense")


def sparse_topk(queries: DataFrame, memories: DataFrame, k: int, text: str = "summary") -> DataFrame:
    """(query_id, id, sparse, rank) by the dot product of term frequencies, above 0, in blocks. Tokens are
    told apart by 64 bits."""
    asked, held = blocks.conditions(queries, _needed(queries))
    q = queries.select("query_id", "user_id", blocks.hashes(tokens(F.col("query"))).alias("_t"), *(c.alias(n) for n, c in asked.items()))
    m = memories.select("id", "user_id", blocks.hashes(tokens(F.col(text))).alias("_t"), *(c.alias(n) for n, c in held.items()))
    found = blocks.scored(Scratch(queries.sparkSession, "sparse"), q, m, "_t", BLOCK, blocks.top(k, blocks.products, 0.0), "sparse")
    return _top(found, k, "sparse")


def goal_relevance(queries: DataFrame, memories: DataFrame) -> DataFrame:
    """V10 of every query and every memory of its tenant: (query_id, id, goal_relevance). The tokens of a row are
    found once."""
    q = queries.select("query_id", "user_id", blocks.hashes(token_set(F.col("goal"))).alias("_t"))
    m = memories.select("id", "user_id", blocks.hashes(memory_tokens(*map(F.col, ("summary", "raw_text", "people", "topics", "memory_type")))).alias("_t"))
    return blocks.scored(Scratch(queries.sparkSession, "goals"), q, m, "_t", ALL_BLOCK, blocks.shares, "goal_relevance")


def fuse(dense: DataFrame, sparse: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """(query_id, id, hybrid, rank): sum of 1 / (rrf_k + rank) over both lists."""
    a = dense.select("query_id", "id", (1 / (F.lit(rrf_k) + F.col("rank"))).alias("s"))
    b = sparse.select("query_id", "id", (1 / (F.lit(rrf_k) + F.col("rank"))).alias("s"))
    both = a.unionByName(b).groupBy("query_id", "id").agg(F.round(F.sum("s"), 9).alias("hybrid"))
    return _top(both, k, "hybrid")


def attach(hybrid: DataFrame, dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Ids come from the fused list alone; scores of the other lists or 0; ``retrieval``
    is the share of the list's best."""
    w = Window.partitionBy("query_id")
    top = F.max("hybrid").over(w)
    out = hybrid.select("query_id", "id", "hybrid").join(dense.select("query_id", "id", "dense"), ["query_id", "id"], "left").join(sparse.select("query_id", "id", "sparse"), ["query_id", "id"], "left")
    out = out.select("query_id", "id", "hybrid", F.coalesce("dense", F.lit(0.0)).alias("dense"), F.coalesce("sparse", F.lit(0.0)).alias("sparse"))
    return out.withColumn("retrieval", F.round(F.when(top > 0, F.col("hybrid") / top).otherwise(0.0), 9))


def attached(queries: DataFrame, memories: DataFrame, search: Search, scratch: Scratch) -> DataFrame:
    """The fused list with its scores. The two lists are used twice and written once."""
    dense = scratch.write(dense_topk(queries, memories, search.prefetch), "dense")
    sparse = scratch.write(sparse_topk(queries, memories, search.prefetch), "sparse")
    hybrid = fuse(dense, sparse, search.candidates, search.rrf_k)
    return attach(hybrid, dense.filter(F.col("rank") <= search.candidates), sparse.filter(F.col("rank") <= search.candidates))


def candidates(queries: DataFrame, memories: DataFrame, as_of: Column, search: Search = Search()) -> DataFrame:
    """Candidates with their memory's columns. Filters on expiry and confidence
    follow the cut, so fewer than the limit may be left."""
    scratch = Scratch(queries.sparkSession, "search")
    queries = scratch.write(queries.withColumn("goal_tokens", blocks.hashes(token_set(first_non_blank(F.col("goal"), F.col("query"))))), "queries")
    found = scratch.write(attached(queries, memories, search, scratch), "found")
    # Tokens are found once a memory and once a query, not once a pair
    held = memories.drop("dense").join(small(found.select("id").distinct()), "id", "left_semi").withColumns({
        "held_tokens": blocks.hashes(memory_tokens(*map(F.col, ("summary", "raw_text", "people", "topics", "memory_type")))),
        "summary_tokens": blocks.hashes(token_set(F.col("summary"))),
    })
    keys = queries.select("query_id", "query", "goal", "goal_tokens", *(["min_confidence"] if "min_confidence" in queries.columns else []))
    # The query first: memories inside the cut have the longer texts
    out = found.join(small(keys), "query_id").join(held, "id")
    if "min_confidence" in keys.columns:
        out = out.filter(confident(F.col("confidence"), F.col("min_confidence")))
    return out if search.include_expired else out.filter(unexpired(F.col("expires_at"), as_of))


def search(queries: DataFrame, memories: DataFrame, as_of: Column, config: Search = Search(), scoring: Scoring = Scoring()) -> DataFrame:
    """Ranked, de-duplicated results of each query: (query_id, id, rank, final, max_similarity)."""
    scored = features(candidates(queries, memories, as_of, config), as_of, scoring)
    return greedy(ranked(scored), config.results, scoring, most=config.candidates)
