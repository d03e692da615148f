"""The engine's entry points as functions of DataFrames, one for each call of a service built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Scoring, Search, list_limit
from tessera.functions.text import clamp, normalize_name
from tessera.operators import context, ingest, models, retrieval, store


def extract(answers: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Models' answers to (rows with an ``extraction``, rows with an ``error``)."""
    good, bad = ingest.split_valid(answers.withColumn("_p", ingest.extraction(F.col(raw))), "_p")
    return good.withColumn("extraction", F.col("_p.value")).drop("_p"), bad.withColumn("error", F.col("_p.error")).drop("_p")


def new_memories(extracted: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """Memories of extractions (id, user_id, idempotency_key, seq, raw_text, extraction) that ``stored``
    (user_id, idempotency_key) doesn't have: of one key the first is made, a null key always."""
    e = F.col("extraction")
    rows = extracted.select("id", "user_id", "idempotency_key", "seq", "raw_text", e["summary"].alias("summary"), e["type"].alias("memory_type"), e["people"].alias("people"), e["topics"].alias("topics"), *(clamp(e[c]).alias(c) for c in ("importance", "utility", "belief_impact", "confidence")), ingest.expiry(e["expires_in_days"], as_of).alias("expires_at"), as_of.alias("created_at"))
    known = stored.filter("idempotency_key is not null").select("user_id", "idempotency_key").distinct()
    return store.first_kept(rows.join(known, ["user_id", "idempotency_key"], "left_anti"), ["user_id", "idempotency_key"], "seq").drop("seq")


def names_of(memories: DataFrame, column: str, stored: DataFrame | None = None, preserve_aliases: bool = False) -> DataFrame:
    """People or topics (user_id, normalized_name, name, aliases, created_at) after memories that name them.
    A later write replaces the aliases, unless they are to be preserved."""
    none = F.array().cast("array<string>")
    new = memories.select("user_id", F.explode(column).alias("name"), none.alias("aliases"), "created_at", F.lit(1).alias("seq"))
    if stored is None:
        return store.upsert_names(new)
    old = stored.select("user_id", "name", "aliases", "created_at", F.lit(0).alias("seq"))
    out = store.upsert_names(old.unionByName(new))
    if preserve_aliases:
        kept = stored.select("user_id", normalize_name(F.col("name")).alias("normalized_name"), F.col("aliases").alias("_a"))
        out = out.join(kept, ["user_id", "normalized_name"], "left").withColumn("aliases", F.when(F.size("_a") > 0, F.col("_a")).otherwise(F.col("aliases"))).drop("_a")
    return out


def list_memories(memories: DataFrame, user_id, limit: int = 0) -> DataFrame:
    """The newest memories of a user, 50 by default and 100 at most."""
    return store.newest(memories, F.col("user_id") == user_id, list_limit(limit))


def delete_memories(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return store.delete(memories, ids, "id")


def search(queries: DataFrame, memories: DataFrame, as_of: Column, config: Search = Search(), scoring: Scoring = Scoring()) -> DataFrame:
    """Ranked results of a batch of queries (see ``retrieval.search``)."""
    return retrieval.search(queries, memories, as_of, config, scoring)


def packet(queries: DataFrame, memories: DataFrame, model_lines: DataFrame, belief_lines: DataFrame, as_of: Column, scoring: Scoring = Scoring()) -> DataFrame:
    """Context packets of queries (query_id, user_id, mode, goal, query, query_dense, people, topics): a search
    for six memories and what goes around them. Without memories (mode alone) use ``render_prompt``."""
    found = search(queries, memories, as_of, Search(limit=context.ITEMS), scoring)
    results = found.join(memories.select("id", "summary", "raw_text", "people", "topics"), "id")
    return context.context_packet(queries.drop("query_dense", "user_id"), results, model_lines, belief_lines)


def person_profile(person_models: DataFrame, people: DataFrame) -> DataFrame:
    """(person, name, topic, line, confidence, evidence_count) of people (person, name), surest models first."""
    named = person_models.join(people, "person")
    return named.select("person", "name", "topic", models.person_lines(named).alias("line"), "confidence", "evidence_count").orderBy("person", F.desc("confidence"), F.desc("evidence_count"), "topic")


def apply_outcomes(stored: DataFrame, requests: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(outcomes, conflicts) after outcome requests (idempotency_key, seq and ``fields``). The key is the caller's
    or one derived from the request; the first request of a key makes its outcome, a repeat changes
    nothing, and keys that came with different requests are conflicts."""
    identity = store.request_identity(*fields)
    given = F.nullif(F.trim(F.coalesce("idempotency_key", F.lit(""))), F.lit(""))
    keyed = requests.withColumn("request_hash", identity).withColumn("idempotency_key", F.coalesce(given, identity))
    both = keyed.select("idempotency_key", "seq", "request_hash", *fields).unionByName(stored.select("idempotency_key", F.lit(-1).cast(keyed.schema["seq"].dataType).alias("seq"), "request_hash", *fields))
    return store.first_kept(both, ["idempotency_key"], "seq").drop("seq"), store.conflicts(both, "idempotency_key", F.col("request_hash"))


def evaluate(cases: DataFrame, retrieved: DataFrame, outputs: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row a case, the summary) of an evaluation: ``cases`` as ``datasets.evaluation_dataset`` reads them,
    ``retrieved`` (id, key) their results, ``outputs`` (id, kind augmented or follow_up, output), ``runs`` (id,
    failed, strategy, success, likelihood, has_outcome, has_outcome_memory)."""
    case = lambda df: df.withColumnRenamed("id", "case_id")
    gold = cases.select(F.col("id").alias("case_id"), F.explode("expected_memory_keys").alias("id"))
    found = context.precision_coverage(case(retrieved).withColumnRenamed("key", "id"), gold)

    def cues(kind: str, column: str) -> DataFrame:
        wanted = cases.select(F.col("id").alias("case_id"), F.explode(column).alias("cue"))
        own = case(outputs.filter(F.col("kind") == kind)).select("case_id", F.col("case_id").alias("id"), "output")
        hits = context.cue_hits(own, wanted, "id")
        return hits.select(F.col("id").alias("case_id"), F.col("hits").alias(f"{kind}_hits"), F.col("misses").alias(f"{kind}_misses"))

    rows = case(runs).join(found, "case_id", "left").join(cues("augmented", "expected_augmented_cues"), "case_id", "left").join(cues("follow_up", "expected_follow_up_cues"), "case_id", "left")
    rows = rows.na.fill(0).withColumns({"precision": F.col("precision_at_5"), "prediction_error": context.prediction_error(F.col("likelihood"), F.col("success")), "changed": context.behaviour_changed(F.col("has_outcome_memory"), F.col("follow_up_hits"))})
    return rows.withColumnRenamed("case_id", "id"), context.evaluation_summary(rows)
