"""Views of the engine's data model over the given tables, for Spark and, as SQL, for DuckDB.

Every view fixes its clock at AS_OF, so that results can be reproduced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

AS_OF = 1706745600  # 2024-02-01 00:00:00 UTC
MEMORY_TYPES = "belief_update interaction_observation outcome person_observation person_preference project_fact topic_fact".split()


def moment(seconds: Column | int) -> Column:
    return F.timestamp_seconds(seconds if isinstance(seconds, Column) else F.lit(seconds))


def score(id: str, factor: int) -> Column:
    """A repeatable number in 0..1 made of an id."""
    return (F.col(id) * factor) % 101 / 100


def memory_items(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("dense"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    j = e.join(docs, "id")
    kinds = F.array(*map(F.lit, MEMORY_TYPES))
    expiry = F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 == 1, AS_OF + 864000).when(F.col("id") % 4 == 2, AS_OF - 259200).otherwise(AS_OF)
    return j.select(
        "id", (F.col("id") % 5).alias("user_id"), (F.col("id") % 23).alias("session_id"), F.element_at(kinds, (F.col("id") % 7 + 1).cast("int")).alias("memory_type"),
        F.col("text").alias("raw_text"), F.col("text").alias("summary"), F.array(F.concat(F.lit("p"), (F.col("id") % 11).cast("string"))).alias("people"), F.array("lang", "source").alias("topics"),
        score("id", 37).alias("importance"), score("id", 53).alias("utility"), score("id", 71).alias("belief_impact"), score("id", 29).alias("confidence"),
        moment(AS_OF - F.col("id") * 3600).alias("created_at"), moment(expiry.cast("bigint")).alias("expires_at"), "dense",
    )


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every memory whose id is divisible by 20 as a query; half of them have no goal of their own."""
    m = memory_items(spark, d).filter("id % 20 = 0")
    return m.select(
        F.col("id").alias("query_id"), "user_id", F.col("summary").alias("query"), F.when(F.col("id") % 40 == 0, F.concat_ws(" ", "memory_type", F.array_join("topics", " "), "summary")).otherwise(" ").alias("goal"), F.col("dense").alias("query_dense"),
        F.when(F.col("id") % 40 == 0, F.array(F.lit("en"), F.lit("de"), F.lit("fr"), F.lit("es"))).otherwise(F.array().cast("array<string>")).alias("topics_any"), F.lit(0.1).alias("min_confidence"),
    )


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    own = e.select(F.col("event_id").alias("memory_id"), F.col("user_id").alias("person"), F.col("event_type").alias("topic"), score("event_id", 37).alias("niceness"), score("event_id", 53).alias("readiness"), score("event_id", 71).alias("competence"), score("event_id", 29).alias("capacity"), F.least(F.col("value") / 200, F.lit(1.0)).alias("confidence"), F.col("ts").alias("observed_at"), F.concat(F.lit("seen "), F.col("event_id").cast("string")).alias("evidence_summary"), F.col("event_id").alias("seq"))
    again = own.filter("memory_id % 10 = 0").withColumns({"niceness": F.lit(0.0), "seq": F.col("seq") + 1_000_000_000_000})
    return own.unionByName(again)


def belief_observations(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "supports").when(F.col("event_type") == "error", "refutes").when(F.col("event_type") == "view", "questions").otherwise("neutral")
    own = _events(spark, d).select(F.col("user_id"), (F.col("event_id") % 3).alias("topic_id"), F.col("event_id").alias("memory_id"), F.concat(F.lit("Claim  of "), F.col("user_id").cast("string")).alias("claim"), kind.alias("stance"), F.least(F.col("value") / 200, F.lit(1.0)).alias("confidence"), F.col("ts").alias("observed_at"), F.col("event_id").alias("seq"))
    own = own.withColumn("topic_id", F.when(F.col("topic_id") > 0, F.col("topic_id")))
    again = own.filter("memory_id % 10 = 0").withColumns({"stance": F.lit("refutes"), "seq": F.col("seq") + 1_000_000_000_000})
    return own.unionByName(again)


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").cast("bigint").alias("seq"), "role", F.col("text").alias("content"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("outcome_id"), F.col("o_custkey").alias("user_id"), (F.col("o_custkey") % 97).alias("session_id"), F.concat(F.lit("key-"), (F.col("o_orderkey") % 5000).cast("string")).alias("idempotency_key"), status.alias("status"), score("o_orderkey", 1).alias("success_score"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    name = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "Supplier ").otherwise("SUPPLIER "), F.col("l_suppkey").cast("string"))
    return li.select(F.lit("supplier").alias("source_kind"), name.alias("source_name"), F.lit("part").alias("target_kind"), F.concat(F.lit("part "), (F.col("l_partkey") % 3).cast("string")).alias("target_name"), F.col("l_returnflag").alias("relationship"), F.when(F.col("l_orderkey") % 9 > 0, (F.col("l_orderkey") % 500)).alias("outcome_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("seq"), (F.col("l_quantity") / 50).alias("confidence"), F.array(F.col("l_orderkey").cast("string")).alias("evidence"), (F.col("l_suppkey") % 5).alias("user_id"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    path = F.concat(F.lit("/v1/"), "event_type", F.lit("/"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("item-0000"), F.col("event_id").cast("string"))).otherwise("list"))
    return e.select("event_id", F.col("user_id").alias("client"), F.when(F.col("event_type") == "signup", "post").otherwise("GET").alias("method"), path.alias("path"), F.when(F.col("event_type") == "error", 500).otherwise(200).cast("bigint").alias("status"), (F.col("value") / 100).alias("seconds"), (F.col("event_id") % 4096).alias("bytes"), "ts")


VIEWS = {f.__name__: f for f in (memory_items, search_queries, observations, belief_observations, messages, outcomes, graph_edges, requests)}

_KINDS = "[" + ", ".join(f"'{k}'" for k in MEMORY_TYPES) + "]"
_TS = "make_timestamp(({}) * 1000000::bigint)"
SQL = {
    "memory_items": f"""select e.vec_id as id, e.vec_id % 5 as user_id, e.vec_id % 23 as session_id, {_KINDS}[1 + e.vec_id % 7] as memory_type, d.text as raw_text, d.text as summary,
        ['p' || (e.vec_id % 11)] as people, [d.lang, d.source] as topics, (e.vec_id * 37) % 101 / 100 as importance, (e.vec_id * 53) % 101 / 100 as utility, (e.vec_id * 71) % 101 / 100 as belief_impact, (e.vec_id * 29) % 101 / 100 as confidence,
        {_TS.format(f"{AS_OF} - e.vec_id * 3600")} as created_at, case e.vec_id % 4 when 0 then null when 1 then {_TS.format(AS_OF + 864000)} when 2 then {_TS.format(AS_OF - 259200)} else {_TS.format(AS_OF)} end as expires_at,
        e.embedding::double[] as dense from embeddings e join documents d on d.doc_id = e.vec_id""",
    "search_queries": """select id as query_id, user_id, summary as query, case when id % 40 = 0 then concat_ws(' ', memory_type, array_to_string(topics, ' '), summary) else ' ' end as goal, dense as query_dense, case when id % 40 = 0 then ['en', 'de', 'fr', 'es'] else []::varchar[] end as topics_any, 0.1::double as min_confidence from memory_items where id % 20 = 0""",
    "observations": """select memory_id, person, topic, case when k = 1 then 0 else niceness end as niceness, readiness, competence, capacity, confidence, observed_at, evidence_summary, memory_id + k * 1000000000000 as seq from
        (select event_id as memory_id, user_id as person, event_type as topic, (event_id * 37) % 101 / 100 as niceness, (event_id * 53) % 101 / 100 as readiness, (event_id * 71) % 101 / 100 as competence, (event_id * 29) % 101 / 100 as capacity,
        least(value / 200, 1.0::double) as confidence, ts::timestamp as observed_at, 'seen ' || event_id as evidence_summary from events), (values (0), (1)) r(k) where k = 0 or memory_id % 10 = 0""",
    "belief_observations": """select user_id, topic_id, memory_id, claim, case when k = 1 then 'refutes' else stance end as stance, confidence, observed_at, memory_id + k * 1000000000000 as seq from
        (select user_id, case when event_id % 3 > 0 then event_id % 3 end as topic_id, event_id as memory_id, 'Claim  of ' || user_id as claim, case event_type when 'purchase' then 'supports' when 'error' then 'refutes' when 'view' then 'questions' else 'neutral' end as stance,
        least(value / 200, 1.0::double) as confidence, ts::timestamp as observed_at from events), (values (0), (1)) r(k) where k = 0 or memory_id % 10 = 0""",
    "messages": "select conv_id as session_id, turn::bigint as seq, role, text as content from conversations",
    "outcomes": """select o_orderkey as outcome_id, o_custkey as user_id, o_custkey % 97 as session_id, 'key-' || (o_orderkey % 5000) as idempotency_key, case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'failed' end as status,
        o_orderkey % 101 / 100 as success_score, o_orderdate::timestamp as created_at from orders""",
    "graph_edges": """select 'supplier' as source_kind, case when l_linenumber % 2 = 0 then 'Supplier ' else 'SUPPLIER ' end || l_suppkey as source_name, 'part' as target_kind, 'part ' || (l_partkey % 3) as target_name, l_returnflag as relationship,
        case when l_orderkey % 9 > 0 then l_orderkey % 500 end as outcome_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as seq, l_quantity / 50 as confidence, [l_orderkey::varchar] as evidence, l_suppkey % 5 as user_id from lineitem""",
    "requests": """select event_id, user_id as client, case when event_type = 'signup' then 'post' else 'GET' end as method, '/v1/' || event_type || '/' || case when event_id % 2 = 0 then 'item-0000' || event_id else 'list' end as path,
        case when event_type = 'error' then 500 else 200 end::bigint as status, value / 100 as seconds, event_id % 4096 as bytes, ts::timestamp as ts from events""",
}


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names defined in front."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in SQL:
            if name not in need and re.search(rf"\b{name}\b", text):
                add(SQL[name])
                need.append(name)

    add(sql)
    if not need:
        return sql
    head = ",\n".join(f"{n} as ({SQL[n]})" for n in need)
    m = re.match(r"\s*with\s+(recursive\s+)?", sql, re.IGNORECASE)
    return f"with {m[1] or ''}{head},\n{sql[m.end() :]}" if m else f"with {head}\n{sql}"
