"""Person-by-topic models and beliefs as folds over observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lists import unique
from tessera.functions.text import band, bare_score, clamp, normalize_name, quoted, score_text, stance, strip

MODEL_KEYS = ["person", "topic"]
SCORES = ["niceness", "readiness", "competence", "capacity", "confidence"]


def _first_of_memory(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of observations of one key in one memory the first counts (replays change nothing)."""
    w = Window.partitionBy(*keys, "memory_id").orderBy("seq")
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def model_state(observations: DataFrame, prior: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(person, topic, n, sum_<score>..., last_observed_at, last_evidence): the state of the fold.
    Sums of clamped scores need no order, so it is one combined aggregation, and states of earlier
    batches are rows like any other: ``prior`` is such a state and ``seen`` (person, topic, memory_id) the
    evidence that it holds, so that replays across batches change nothing either."""
    own = _first_of_memory(observations, MODEL_KEYS)
    if seen is not None:
        own = own.join(seen.select(*MODEL_KEYS, "memory_id").distinct(), [*MODEL_KEYS, "memory_id"], "left_anti")
    summary = F.when(strip(F.col("evidence_summary")) != "", F.struct("seq", "evidence_summary"))
    rows = own.select(*MODEL_KEYS, F.lit(1).cast("bigint").alias("n"), *(clamp(F.col(s)).alias(f"sum_{s}") for s in SCORES), "observed_at", summary.alias("last_evidence"))
    rows = rows.withColumnRenamed("observed_at", "last_observed_at")
    if prior is not None:
        rows = rows.unionByName(prior.select(*rows.columns))
    return rows.groupBy(*MODEL_KEYS).agg(*(F.sum(c).alias(c) for c in ("n", *(f"sum_{s}" for s in SCORES))), F.max("last_observed_at").alias("last_observed_at"), F.max("last_evidence").alias("last_evidence"))


def models_of(state: DataFrame, places: int = 9) -> DataFrame:
    """The models of a state: means, rounded once, count of evidence, latest time and summary."""
    return state.select(*MODEL_KEYS, *(F.round(F.col(f"sum_{s}") / F.col("n"), places).alias(s) for s in SCORES), F.col("n").alias("evidence_count"), "last_observed_at", F.col("last_evidence.evidence_summary").alias("last_summary"))


def state_of(models: DataFrame) -> DataFrame:
    """The state of stored models, whose means weigh by their evidence count: those of a count of 0 or less
    (manual edits) not at all."""
    counted = models.filter("evidence_count > 0")
    none = F.lit(None).cast("struct<seq:bigint,evidence_summary:string>")
    return counted.select(*MODEL_KEYS, F.col("evidence_count").alias("n"), *((F.col(s) * F.col("evidence_count")).alias(f"sum_{s}") for s in SCORES), "last_observed_at", none.alias("last_evidence"))


def person_topic_models(observations: DataFrame, prior: DataFrame | None = None, places: int = 9) -> DataFrame:
    """(person, topic) means of five clamped scores, evidence count, latest time and summary;
    ``prior`` is a state (see ``model_state``)."""
    return models_of(model_state(observations, prior), places)


def evidence(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence ids in order of arrival, each once."""
    rows = F.array_sort(F.collect_list(F.struct("seq", F.col("memory_id").cast("string").alias("m"))))
    return observations.groupBy(*keys).agg(unique(F.transform(rows, lambda r: r["m"])).alias("evidence"))


def edit_models(models: DataFrame, edits: DataFrame) -> DataFrame:
    """Given fields overwrite, clamped; the count is at least 0 and the size of the evidence."""
    e = edits.select("person", "topic", *(F.col(s).alias(f"_{s}") for s in SCORES), F.col("evidence_count").alias("_n"), F.col("evidence_size").alias("_e"), F.col("last_observed_at").alias("_t"))
    j = models.join(e, ["person", "topic"], "left")
    count = F.greatest(F.coalesce("_n", "evidence_count"), F.lit(0), F.coalesce("_e", F.lit(0)))
    return j.select("person", "topic", *(F.coalesce(F.when(F.col(f"_{s}").isNotNull(), clamp(F.col(f"_{s}"))), F.col(s)).alias(s) for s in SCORES), count.cast("bigint").alias("evidence_count"), F.greatest("last_observed_at", "_t").alias("last_observed_at"))


def person_lines(models: DataFrame) -> Column:
    """One cautious sentence about a model."""
    traits = F.concat_ws(", ", *(F.concat(F.lit(f"{s} "), band(F.col(s))) for s in SCORES[:4]))
    return F.concat(F.col("person").cast("string"), F.lit(" on "), "topic", F.lit(": working estimate only; "), traits, F.lit("; confidence="), bare_score(F.col("confidence")), F.lit("; evidence_count="), F.col("evidence_count").cast("string"), F.lit(". Treat as topic-specific and uncertain."))


CAP = 0.6


def bears_belief(impact: Column, memory_type: Column) -> Column:
    """P10: memories that beliefs are drawn from."""
    return (impact > 0) | memory_type.isin("belief_update", "outcome")


def bears_models(people: Column, topics: Column) -> Column:
    """Memories that models of people are drawn from."""
    return (F.size(people) > 0) & (F.size(topics) > 0)



BELIEF_KEYS = ["user_id", "topic_id", "key"]


def belief_state(observations: DataFrame, prior: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """The state of each (user_id, topic_id or null, normalized claim) in order of arrival:
    claim, s (stance), c (confidence, not rounded), n, x (contradiction), history, last_observed_at.

    Replays of a memory change nothing; stances that are known and differ make the stance unknown, cap
    the running mean of the confidence at .6 and set a lasting contradiction flag; unknown stances
    leave the stance as it is; the first claim text stays. The fold depends on order, so the new
    observations of a key, small structs, meet in one sorted array; what arrived before is ``prior``, such
    a state, with its evidence ``seen`` (the keys and memory_id). So batches bound the arrays, and a batch
    reads no history."""
    own = _first_of_memory(observations.withColumn("key", normalize_name(F.col("claim"))).filter("key <> ''"), BELIEF_KEYS)
    if seen is not None:
        old = seen.select(*(F.col(k).alias(f"_{k}") for k in (*BELIEF_KEYS, "memory_id"))).distinct()
        same = own["memory_id"] == old["_memory_id"]
        for k in BELIEF_KEYS:
            same = same & own[k].eqNullSafe(old[f"_{k}"])
        own = own.join(old, same, "left_anti")
    row = F.struct("seq", stance(F.col("stance")).alias("s"), clamp(F.col("confidence")).alias("c"))
    kind = "struct<s:string,c:double,n:bigint,x:boolean,history:array<string>>"
    lists = own.groupBy(*BELIEF_KEYS).agg(F.collect_list(row).alias("rows"), F.min_by("claim", "seq").alias("claim"), F.max("observed_at").alias("last_observed_at"))
    lists = lists.withColumns({"rows": F.array_sort("rows"), "old": F.lit(None).cast(kind)})
    if prior is not None:
        none = F.array().cast(lists.schema["rows"].dataType)
        old = prior.select(*BELIEF_KEYS, none.alias("rows"), "claim", "last_observed_at", F.struct("s", "c", "n", "x", "history").alias("old"))
        both = lists.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
        lists = both.groupBy(*BELIEF_KEYS).agg(F.flatten(F.collect_list("rows")).alias("rows"), F.min_by("claim", "_new").alias("claim"), F.max("last_observed_at").alias("last_observed_at"), F.max("old").alias("old"))
    start = F.coalesce("old", F.struct(F.lit("unknown").alias("s"), F.lit(0.0).alias("c"), F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("x"), F.array().cast("array<string>").alias("history")))

    def step(a: Column, r: Column) -> Column:
        known = (a["s"] != "unknown") & (r["s"] != "unknown")
        clash = known & (a["s"] != r["s"])
        merged = F.when(a["s"] == "unknown", r["s"]).when((r["s"] == "unknown") | (a["s"] == r["s"]), a["s"]).otherwise("unknown")
        mean = (a["c"] * a["n"] + r["c"]) / (a["n"] + 1)
        return F.struct(merged.alias("s"), F.when(clash, F.least(mean, F.lit(CAP))).otherwise(mean).alias("c"), (a["n"] + 1).alias("n"), (a["x"] | clash).alias("x"), F.array_union(a["history"], F.array(r["s"])).alias("history"))

    done = lists.withColumn("f", F.aggregate("rows", start, step))
    return done.select(*BELIEF_KEYS, "claim", "f.*", "last_observed_at")


def beliefs_of(state: DataFrame, places: int = 9) -> DataFrame:
    """The beliefs of a state, the confidence rounded once."""
    return state.select("user_id", "topic_id", "claim", F.col("s").alias("stance"), F.round("c", places).alias("confidence"), F.col("n").alias("evidence_count"), F.col("x").alias("contradiction"), F.col("history").alias("stance_history"), "last_observed_at")


def fold_beliefs(observations: DataFrame, prior: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """The beliefs after all observations (see ``belief_state``)."""
    return beliefs_of(belief_state(observations, prior, seen))


def belief_view(beliefs: DataFrame, topics: DataFrame) -> DataFrame:
    """Beliefs with the name of their topic ("general" without one) and a sentence."""
    j = beliefs.join(topics.select(F.col("topic_id").alias("_t"), F.col("name").alias("_name")), F.col("topic_id") == F.col("_t"), "left")
    name = F.coalesce(F.nullif(strip(F.col("_name")), F.lit("")), F.lit("general"))
    words = F.when(F.col("stance") == "supports", "currently supported").when(F.col("stance") == "weakens", "currently weakened").when(F.col("stance") == "contradicts", "currently contradicted").otherwise("currently uncertain")
    line = F.concat(name, F.lit(": claim "), quoted(F.col("claim")), F.lit(" is "), words, F.lit(" (confidence="), score_text(F.col("confidence")), F.lit(", evidence_count="), F.col("evidence_count").cast("string"), F.lit(")."), F.when(F.col("contradiction"), " Conflicting evidence exists, so treat this as uncertain.").otherwise(""))
    return j.select("user_id", "topic_id", "claim", name.alias("topic"), line.alias("summary"))


def resolve_names(names: DataFrame, entities: DataFrame, owner: list[str]) -> DataFrame:
    """Each (owner..., name) with the entity of that normalized name, or else the
    first with such an alias; names without any are left out. Entities: owner..., id, name, aliases."""
    by_name = entities.select(*owner, normalize_name(F.col("name")).alias("_k"), F.lit(0).alias("_p"), "id")
    by_alias = entities.select(*owner, F.posexplode("aliases").alias("_p", "_a"), "id").select(*owner, normalize_name(F.col("_a")).alias("_k"), (F.col("_p") + 1).alias("_p"), "id")
    found = by_name.unionByName(by_alias).groupBy(*owner, "_k").agg(F.min(F.struct("_p", "id")).alias("m"))
    return names.withColumn("_k", normalize_name(F.col("name"))).join(found, [*owner, "_k"]).select(*owner, "name", F.col("m.id").alias("id"))


def requested(models: DataFrame, names: DataFrame, entities: DataFrame) -> DataFrame:
    """Models of requested names (pos, name) in the order asked; unknown ones are skipped."""
    resolved = names.join(entities.select(normalize_name(F.col("name")).alias("_k"), "id"), normalize_name(names["name"]) == F.col("_k"))
    return resolved.join(models, F.col("id") == F.col("person")).select("pos", "name", "person", "topic", "confidence", "evidence_count")


def with_fallback(topic_rows: DataFrame, all_rows: DataFrame, key: str) -> DataFrame:
    """Rows of the topic, or all rows for those keys that have none."""
    none = all_rows.join(topic_rows.select(key).distinct(), key, "left_anti")
    return topic_rows.unionByName(none)


def union_once(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union distinct by id, rows of the first winning."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)))
    rest = [c for c in first.columns if c != key]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), "_o").alias("r")).select(key, "r.*")


