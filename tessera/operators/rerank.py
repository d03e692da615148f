"""The salience score and greedy removal of redundant results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Scoring
from tessera.functions.lists import jaccard, overlap_share
from tessera.functions.text import clamp, first_non_blank, token_set
from tessera.operators import sets
from tessera.operators.blocks import SPREAD, hashes
from tessera.plans.scratch import Scratch, small

PLACES = 9


def recency(created_at: Column, as_of: Column, half_life_days: float = 30.0) -> Column:
    """Halves every half life; 1 for the future, 0 without a time."""
    age = (as_of.cast("double") - created_at.cast("double")) / 86400
    decayed = F.exp(F.lit(-math.log(2)) * age / half_life_days)
    return F.when(created_at.isNull(), 0.0).when(age <= 0, 1.0).otherwise(decayed)


def goal_relevance(goal: Column, summary: Column, raw_text: Column, people: Column, topics: Column, memory_type: Column) -> Column:
    """Share of the goal's tokens that the memory has."""
    return overlap_share(token_set(goal), memory_tokens(summary, raw_text, people, topics, memory_type))


def memory_tokens(summary: Column, raw_text: Column, people: Column, topics: Column, memory_type: Column) -> Column:
    """The tokens that a goal may find in a memory."""
    return token_set(summary, raw_text, F.array_join(people, " "), F.array_join(topics, " "), memory_type)


def features(candidates: DataFrame, as_of: Column, scoring: Scoring = Scoring()) -> DataFrame:
    """Adds recency, goal_relevance and final to candidates (query_id, id, retrieval, ...), by their
    hashed tokens (goal_tokens, held_tokens) where they have them."""
    w = scoring.normalized()
    if "goal_tokens" in candidates.columns:
        relevance = overlap_share(F.col("goal_tokens"), F.col("held_tokens"))
    else:
        goal = first_non_blank(F.col("goal"), F.col("query"))
        relevance = goal_relevance(goal, F.col("summary"), F.col("raw_text"), F.col("people"), F.col("topics"), F.col("memory_type"))
    out = candidates.withColumns({
        "recency": F.round(recency(F.col("created_at"), as_of, scoring.half_life), PLACES),
        "goal_relevance": F.round(relevance, PLACES),
    })
    columns = {"retrieval": "retrieval", "recency": "recency", "importance": "importance", "utility": "utility", "goal": "goal_relevance", "belief_impact": "belief_impact", "confidence": "confidence"}
    final = sum((F.lit(w[k]) * clamp(F.col(c)) for k, c in columns.items()), F.lit(0.0))
    return out.withColumn("final", F.round(final, PLACES))


def ranked(scored: DataFrame) -> DataFrame:
    """Adds ``place``, the rank before redundancy removal; ids break ties."""
    w = Window.partitionBy("query_id").orderBy(F.desc("final"), F.desc("retrieval"), F.desc("created_at"), "id")
    return scored.withColumn("place", F.row_number().over(w))


def similar_summaries(memories: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """(a, b, similarity) of one tenant's memories whose summaries' token sets are as similar as the
    greedy walk takes for redundant.

    Memories of equal sets are one class, told by pairs of its smallest id with the others; other pairs
    are of classes. Those that may be similar are found by bits (see ``sets``), and their tokens compared."""
    t, scratch = scoring.threshold, Scratch(memories.sparkSession, "similar")
    own = memories.select("id", "user_id", F.array_sort(token_set(F.col("summary"))).alias("tokens")).filter((F.size("tokens") > 0) & F.col("user_id").isNotNull())
    own = scratch.write(own.withColumn("key", F.sha2(F.array_join("tokens", " "), 256)), "sets")
    classes = scratch.write(own.groupBy("user_id", "key").agg(F.min("id").alias("node"), F.any_value("tokens").alias("tokens")), "classes")
    copies = own.join(classes.select("user_id", "key", "node"), ["user_id", "key"]).filter("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    near = scratch.write(sets.near(scratch, classes.select("user_id", "node", F.size("tokens").alias("n"), hashes(F.col("tokens")).alias("hashes")), t), "near")
    held = classes.select("node", "tokens")
    pairs = held.select(F.col("node").alias("a"), F.col("tokens").alias("x")).join(small(near), "a")
    pairs = pairs.join(held.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    pairs = pairs.select("a", "b", jaccard(F.col("x"), F.col("y")).alias("similarity")).filter(F.col("similarity") >= t)
    return copies.unionByName(pairs.withColumn("similarity", F.round("similarity", PLACES)))


#: Results of a query that one pass of the greedy walk looks at; a search has no more candidates.
BLOCK = 200


def _walk(rows: DataFrame, kept: DataFrame | None, limit: int, threshold: float) -> DataFrame:
    """(query_id, kept) after the rows of one block, at most BLOCK a query, folded inside the JVM."""
    tokens = F.col("summary_tokens") if "summary_tokens" in rows.columns else hashes(token_set(F.col("summary")))
    row = F.struct("place", F.col("id").alias("id"), "final", tokens.alias("tokens"))
    lists = rows.repartition(SPREAD * rows.sparkSession.sparkContext.defaultParallelism, "query_id").groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    id_type = lists.schema["rows"].dataType.elementType["id"].dataType.simpleString()
    kind = f"array<struct<id:{id_type},rank:int,final:double,max_similarity:double,tokens:array<bigint>>>"
    start = F.array().cast(kind)
    if kept is not None:
        lists, start = lists.join(kept, "query_id", "full"), F.coalesce("kept", start)

    def step(kept: Column, x: Column) -> Column:
        worst = F.coalesce(F.array_max(F.transform(kept, lambda k: jaccard(k["tokens"], x["tokens"]))), F.lit(0.0))
        own = lambda w: F.struct(x["id"].alias("id"), (F.size(kept) + 1).alias("rank"), x["final"].alias("final"), w.alias("max_similarity"), x["tokens"].alias("tokens"))
        more = F.transform(F.array(worst), lambda w: F.when((F.size(kept) > 0) & (w >= threshold), kept).otherwise(F.concat(kept, F.array(own(w)))))[0]
        return F.when(F.size(kept) >= limit, kept).otherwise(more)

    none = F.array().cast(lists.schema["rows"].dataType)
    return lists.select("query_id", F.aggregate(F.coalesce("rows", none), start, step).alias("kept"))


def greedy(placed: DataFrame, limit: int, scoring: Scoring = Scoring(), most: int | None = None) -> DataFrame:
    """In rank order, skips what is too similar to anything kept before, up to ``limit``.

    (query_id, id, rank, final, max_similarity). The walk goes on in blocks of BLOCK results a query until
    each query has its limit or no more results, so no array grows with a query's list. ``most`` says that
    no query has more results than that; with up to BLOCK it is one lazy pass."""
    if most is not None and most <= BLOCK:
        kept = _walk(placed, None, limit, scoring.threshold)
    else:
        scratch = Scratch(placed.sparkSession, "greedy")
        rest = scratch.write(placed.select("query_id", "id", "place", "final", hashes(token_set(F.col("summary"))).alias("summary_tokens")), "placed")
        kept, block = None, 0
        while not rest.isEmpty():
            kept = scratch.write(_walk(rest.filter(F.col("place") <= (block + 1) * BLOCK), kept, limit, scoring.threshold), f"kept{block}")
            open_ = kept.filter(F.size("kept") < limit).select("query_id")
            block += 1
            rest = scratch.write(rest.filter(F.col("place") > block * BLOCK).join(open_, "query_id", "left_semi"), f"rest{block}")
        if kept is None:
            kept = _walk(placed, None, limit, scoring.threshold)
    flat = kept.select("query_id", F.explode("kept").alias("k"))
    return flat.select("query_id", F.col("k.id").alias("id"), F.col("k.rank").cast("bigint").alias("rank"), F.col("k.final").alias("final"), F.round("k.max_similarity", PLACES).alias("max_similarity"))
