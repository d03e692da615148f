"""Tables of the store: lookups, ordered listings, upserts and resumable status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import list_limit
from tessera.functions.lists import unique
from tessera.functions.text import normalize_name
from tessera.plans.scratch import small


def newest(df: DataFrame, condition: Column, limit: int = 50, by: str = "created_at", tie: str = "id", most: int = 100) -> DataFrame:
    """Matching rows, newest first, up to a limit (a top-k, no full sort)."""
    return df.filter(condition).orderBy(F.desc(by), tie).limit(list_limit(limit, most=most))


def oldest(df: DataFrame, condition: Column, limit: int, by: str) -> DataFrame:
    """Matching rows in order of arrival."""
    return df.filter(condition).orderBy(by).limit(limit)


def in_given_order(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the ids of one array column ``ids``, with their place ``pos``; unknown ids are
    left out."""
    wanted = ids.select(F.posexplode("ids").alias("pos", "_id"))
    return df.join(small(wanted), df[key] == F.col("_id")).drop("_id")


def first_kept(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with one idempotency key the first stays; a null in the key never conflicts."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    w = Window.partitionBy(*keys).orderBy(order)
    return df.filter(~null).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").unionByName(df.filter(null))


def upsert_names(df: DataFrame, order: str = "seq") -> DataFrame:
    """People or topics by (user_id, normalized_name); the last write wins in every column but
    created_at, which is that of the first. One shuffle, combined before it."""
    keyed = df.withColumn("normalized_name", normalize_name(F.col("name"))).filter("normalized_name <> ''")
    agg = keyed.groupBy("user_id", "normalized_name").agg(F.max_by(F.struct("name", "aliases"), order).alias("r"), F.min_by("created_at", order).alias("created_at"))
    return agg.select("user_id", "normalized_name", F.col("r.name").alias("name"), unique(F.col("r.aliases")).alias("aliases"), "created_at")


def upsert_users(df: DataFrame, order: str = "seq") -> DataFrame:
    """By external_id the last name and the last email that isn't null; an email that another user
    took first is left out."""
    folded = df.groupBy("external_id").agg(F.max_by("name", order).alias("name"), F.max_by(F.when(F.col("email").isNotNull(), F.col("email")), F.when(F.col("email").isNotNull(), F.col(order))).alias("email"), F.min(order).alias("since"))
    w = Window.partitionBy("email").orderBy("since", "external_id")
    named = folded.filter("email is not null").withColumn("n", F.row_number().over(w))
    named = named.select("external_id", "name", F.when(F.col("n") == 1, F.col("email")).alias("email"))
    # users without email, who may be most, don't meet in one group
    return named.unionByName(folded.filter("email is null").select("external_id", "name", "email"))


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """State rows by key, the latest write of old and new rows winning."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


EDGE = ["source_kind", "source_name", "target_kind", "target_name", "relationship"]


def upsert_edges(df: DataFrame, order: str = "seq") -> DataFrame:
    """Within an outcome an edge is known by its five names in lower case; the first casing and
    the last values stay, of equal times those of the larger confidence. Rows without outcome are all
    kept."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("user_id", "outcome_id")] + [F.coalesce(F.lower(c), F.lit("\0")) for c in EDGE]
    # 128 bits stand for the seven parts of the key, so that what is shuffled and sorted by is two numbers
    keyed = df.filter("outcome_id is not null").withColumns({"_h": F.xxhash64(*parts), "_g": F.xxhash64(F.lit("again"), *parts)})
    known = keyed.groupBy("_h", "_g").agg(F.min(F.struct(order, *EDGE, "user_id", "outcome_id")).alias("names"), F.max(F.struct(order, "confidence", "evidence")).alias("values"))
    known = known.select("names.user_id", "names.outcome_id", *(f"names.{c}" for c in EDGE), "values.*")
    return known.unionByName(df.filter("outcome_id is null").select(*known.columns))


def stage_status(events: DataFrame, key: str, stages: list[str], order: str = "seq") -> DataFrame:
    """The current status of each stage from status events (key, stage, status, error, seq);
    a completed stage stays completed, a stage without events is pending."""
    out = []
    for s in stages:
        own = F.col("stage") == s
        done = F.max(F.when(own & (F.col("status") == "completed"), 1).otherwise(0)) == 1
        last = F.max_by(F.when(own, F.col("status")), F.when(own, F.col(order)))
        out.append(F.when(done, "completed").otherwise(F.coalesce(last, F.lit("pending"))).alias(f"{s}_status"))
    failed = F.max_by(F.when(F.col("status") == "failed", F.col("error")), F.when(F.col("status") == "failed", F.col(order)))
    return events.groupBy(key).agg(*out, failed.alias("last_error"))


def complete_outcomes(outcomes: DataFrame, updates: DataFrame) -> DataFrame:
    """Later non-null memory ids and statuses win, completion clears the error, metadata merge with
    the right side winning."""
    u = updates.select(F.col("outcome_id").alias("_k"), F.col("memory_id").alias("_m"), F.col("status").alias("_s"), F.col("metadata").alias("_d"))
    j = outcomes.join(u, F.col("outcome_id") == F.col("_k"), "left")
    status = F.coalesce("_s", "status")
    return j.select("outcome_id", F.coalesce("_m", "memory_id").alias("memory_id"), status.alias("status"), F.when(status != "completed", F.col("error")).alias("error"), merge_maps(F.col("metadata"), F.col("_d")).alias("metadata"))


def merge_maps(left: Column, right: Column) -> Column:
    """Top-level merge, right wins, null values on the right are skipped."""
    empty = F.create_map().cast("map<string,string>")
    r = F.map_filter(F.coalesce(right, empty), lambda k, v: v.isNotNull())
    kept = F.map_filter(F.coalesce(left, empty), lambda k, v: ~F.map_contains_key(r, k))
    return F.map_concat(kept, r)


def delete(df: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Without the deleted keys."""
    return df.join(small(tombstones.select(key).distinct()), key, "left_anti")


def conflicts(requests: DataFrame, key: str, fingerprint: Column) -> DataFrame:
    """Keys that came with more than one request."""
    own = requests.withColumn("_f", fingerprint).filter(F.col(key).isNotNull())
    return own.groupBy(key).agg(F.count_distinct("_f").alias("n_requests")).filter("n_requests > 1")


def request_identity(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of the request."""
    return F.concat(F.lit("derived:"), F.sha2(F.to_json(F.struct(*columns)), 256))
