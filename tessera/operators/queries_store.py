"""Queries of the store and the models, over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import normalize_name
from tessera.operators import models, store
from tessera.plans.registry import query
from tessera.sources.tables import table
from tessera.sources.views import belief_observations, graph_edges, memory_items, messages, observations, outcomes

_NORM = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
_L = lambda c, n="n": F.col(c).cast("bigint").alias(n)


@query("s01_recent_by_user", "select id, created_at from memory_items where user_id = 2 order by created_at desc, id limit 50")
def s01(spark, d):
    return store.newest(memory_items(spark, d), F.col("user_id") == 2).select("id", "created_at")


@query("s02_recent_by_session", "select id, created_at from memory_items where session_id = 7 order by created_at desc, id limit 10")
def s02(spark, d):
    return store.newest(memory_items(spark, d), F.col("session_id") == 7, 10).select("id", "created_at")


@query("s03_multi_get_ordered", "select pos::bigint as pos, id from (select unnest([9, 3, 99999999, 41, 7]) as i, unnest(range(5)) as pos) join memory_items on i = id")
def s03(spark, d):
    ids = spark.range(1).select(F.array(*(F.lit(x).cast("bigint") for x in (9, 3, 99999999, 41, 7))).alias("ids"))
    return store.in_given_order(memory_items(spark, d), ids, "id").select(_L("pos", "pos"), "id")


@query("s04_memory_by_id", "select id, memory_type from memory_items where id = 17")
def s04(spark, d):
    return memory_items(spark, d).filter("id = 17").select("id", "memory_type")


@query("s05_session_messages", "select session_id, seq, content from messages where session_id = 3 order by seq limit 20")
def s05(spark, d):
    return store.oldest(messages(spark, d), F.col("session_id") == 3, 20, "seq").select("session_id", "seq", "content")


@query("s06_message_by_id", "select session_id, seq, role from messages where session_id = 5 and seq = 1")
def s06(spark, d):
    return messages(spark, d).filter("session_id = 5 and seq = 1").select("session_id", "seq", "role")


@query("s07_session_lookup", "select session_id, count(*) as n from messages where session_id = 8 group by session_id")
def s07(spark, d):
    return messages(spark, d).filter("session_id = 8").groupBy("session_id").agg(F.count("*").alias("n"))


@query("s08_user_lookup", "select c_custkey, c_name from customer where c_name = 'Customer#000000042' or c_custkey = 7")
def s08(spark, d):
    return table(spark, d, "customer").filter("c_name = 'Customer#000000042' or c_custkey = 7").select("c_custkey", "c_name")


@query("s09_person_by_name", f"select s_suppkey, s_name from supplier where {_NORM('s_name')} = 'supplier#000000003'")
def s09(spark, d):
    return table(spark, d, "supplier").filter(normalize_name(F.col("s_name")) == normalize_name(F.lit(" SUPPLIER#000000003 "))).select("s_suppkey", "s_name")


@query("s10_topic_by_name", f"select p_partkey, p_name from part where {_NORM('p_name')} = (select {_NORM('p_name')} from part where p_partkey = 5)")
def s10(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", normalize_name(F.col("p_name")).alias("k"))
    return p.join(F.broadcast(p.filter("p_partkey = 5").select("k")), "k", "left_semi").select("p_partkey", "p_name")


_MODELS = """models as (select person, topic, round(avg(niceness), 9) as niceness, round(avg(readiness), 9) as readiness, round(avg(competence), 9) as competence, round(avg(capacity), 9) as capacity, round(avg(confidence), 9) as confidence,
    count(*) as evidence_count, max(observed_at) as last_observed_at, arg_max(evidence_summary, seq) as last_summary from (select * from observations qualify row_number() over (partition by person, topic, memory_id order by seq) = 1) group by person, topic)"""


@query("s11_model_by_key", f"with {_MODELS} select person, topic, evidence_count from models where person = 3 and topic = 'click'")
def s11(spark, d):
    return models.person_topic_models(observations(spark, d).filter("person = 3 and topic = 'click'")).select("person", "topic", "evidence_count")


@query("s12_models_by_person", f"with {_MODELS} select topic, confidence, evidence_count from models where person = 4 order by confidence desc, evidence_count desc, last_observed_at desc")
def s12(spark, d):
    m = models.person_topic_models(observations(spark, d).filter("person = 4"))
    return m.orderBy(F.desc("confidence"), F.desc("evidence_count"), F.desc("last_observed_at")).select("topic", "confidence", "evidence_count")


@query("s13_nullsafe_lookup", f"select memory_id, seq from belief_observations where {_NORM('claim')} = 'claim of 6' and topic_id is not distinct from null order by observed_at desc, seq desc limit 1")
def s13(spark, d):
    b = belief_observations(spark, d).filter((normalize_name(F.col("claim")) == normalize_name(F.lit("CLAIM of  6"))) & F.col("topic_id").eqNullSafe(F.lit(None)))
    return b.orderBy(F.desc("observed_at"), F.desc("seq")).limit(1).select("memory_id", "seq")


@query("s14_beliefs_by_topic", "select memory_id, observed_at from belief_observations where topic_id = 2 order by observed_at desc, confidence desc, seq desc limit 25")
def s14(spark, d):
    return belief_observations(spark, d).filter("topic_id = 2").orderBy(F.desc("observed_at"), F.desc("confidence"), F.desc("seq")).limit(25).select("memory_id", "observed_at")


@query("s15_beliefs_by_user", "select memory_id, observed_at from belief_observations where user_id = 9 order by observed_at desc, confidence desc, seq desc limit 10")
def s15(spark, d):
    return belief_observations(spark, d).filter("user_id = 9").orderBy(F.desc("observed_at"), F.desc("confidence"), F.desc("seq")).limit(10).select("memory_id", "observed_at")


@query("s16_edges_by_user", "select seq, source_name from graph_edges where user_id = 1 order by seq desc limit 30")
def s16(spark, d):
    return store.newest(graph_edges(spark, d), F.col("user_id") == 1, 30, "seq", "source_name").select("seq", "source_name")


@query("s17_outcome_by_key", "select outcome_id, status from outcomes where idempotency_key = 'key-77' or outcome_id = 5")
def s17(spark, d):
    return outcomes(spark, d).filter("idempotency_key = 'key-77' or outcome_id = 5").select("outcome_id", "status")


@query("s18_outcomes_by_session", "select outcome_id, created_at from outcomes where session_id = 11 order by created_at desc, outcome_id limit 20")
def s18(spark, d):
    return store.newest(outcomes(spark, d), F.col("session_id") == 11, 20, "created_at", "outcome_id").select("outcome_id", "created_at")


@query("s19_entities_by_memory", "select l_orderkey, l_linenumber::bigint as line from lineitem where l_orderkey = 33 order by l_linenumber")
def s19(spark, d):
    return table(spark, d, "lineitem").filter("l_orderkey = 33").orderBy("l_linenumber").select("l_orderkey", _L("l_linenumber", "line"))


@query("s20_incomplete_work", "select outcome_id, status from outcomes where status <> 'completed'")
def s20(spark, d):
    return outcomes(spark, d).filter("status <> 'completed'").orderBy("created_at").select("outcome_id", "status")


@query("s25_unnest_cast", "select outcome_id, seq, list_transform(coalesce(evidence, []), lambda x: x::varchar) as evidence from graph_edges")
def s25(spark, d):
    return graph_edges(spark, d).select("outcome_id", "seq", F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda x: x.cast("string")).alias("evidence"))


@query("k01_insert_or_keep_first", "select seq, outcome_id from graph_edges where outcome_id is null union all select seq, outcome_id from (select *, row_number() over (partition by user_id, outcome_id order by seq) as n from graph_edges where outcome_id is not null) where n = 1")
def k01(spark, d):
    return store.first_kept(graph_edges(spark, d), ["user_id", "outcome_id"], "seq").select("seq", "outcome_id")


@query("k02_outcome_keep_first", "select idempotency_key, min(outcome_id) as outcome_id from outcomes group by idempotency_key")
def k02(spark, d):
    return store.first_kept(outcomes(spark, d), ["idempotency_key"], "outcome_id").select("idempotency_key", "outcome_id")


_PEOPLE = "people as (select user_id, case when id % 3 = 0 then '  ' || upper(people[1]) else people[1] end as name, ['alias' || (id % 4), 'ALIAS' || (id % 4)] as aliases, created_at, id as seq from memory_items)"


def people(spark, d):
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("  "), F.upper(F.col("people")[0]))).otherwise(F.col("people")[0])
    tail = (F.col("id") % 4).cast("string")
    return memory_items(spark, d).select("user_id", name.alias("name"), F.array(F.concat(F.lit("alias"), tail), F.concat(F.lit("ALIAS"), tail)).alias("aliases"), "created_at", F.col("id").alias("seq"))


@query("k03_upsert_last_wins", f"with {_PEOPLE} select user_id, {_NORM('name')} as normalized_name, arg_max(name, seq) as name, [arg_max(aliases, seq)[1]] as aliases, arg_min(created_at, seq) as created_at from people group by 1, 2")
def k03(spark, d):
    return store.upsert_names(people(spark, d))


@query("k04_upsert_user", """with u as (select o_custkey as external_id, o_orderstatus as name, case when o_orderkey % 3 = 0 then 'm' || (o_orderkey % 700) end as email, o_orderkey as seq from orders),
    f as (select external_id, arg_max(name, seq) as name, arg_max(email, seq) filter (where email is not null) as email, min(seq) as since from u group by external_id)
    select external_id, name, case when row_number() over (partition by email order by since, external_id) = 1 then email end as email from f""")
def k04(spark, d):
    u = table(spark, d, "orders").select(F.col("o_custkey").alias("external_id"), F.col("o_orderstatus").alias("name"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("m"), (F.col("o_orderkey") % 700).cast("string"))).alias("email"), F.col("o_orderkey").alias("seq"))
    return store.upsert_users(u)


@query("k05_upsert_models", "select person, topic, arg_max(confidence, seq) as confidence, max(seq) as seq from observations group by person, topic")
def k05(spark, d):
    o = observations(spark, d).select("person", "topic", "confidence", "seq")
    return store.replace_by_key(o.filter("seq % 2 = 0"), o.filter("seq % 2 = 1"), ["person", "topic"], "seq")


@query("k06_belief_save", "select user_id, topic_id, arg_max(stance, seq) as stance, max(seq) as seq from belief_observations group by user_id, topic_id")
def k06(spark, d):
    o = belief_observations(spark, d).select("user_id", "topic_id", "stance", "seq")
    return store.replace_by_key(o.filter("seq % 2 = 0"), o.filter("seq % 2 = 1"), ["user_id", "topic_id"], "seq").select("user_id", "topic_id", "stance", "seq")


@query("k07_edge_upsert", """select user_id, outcome_id, arg_min(source_name, seq) as source_name, arg_min(target_name, seq) as target_name, max({'s': seq, 'c': confidence}).c as confidence, arg_max(evidence, seq) as evidence, max(seq) as seq
    from graph_edges where outcome_id is not null group by user_id, outcome_id, lower(source_kind), lower(source_name), lower(target_kind), lower(target_name), lower(relationship)
    union all select user_id, outcome_id, source_name, target_name, confidence, evidence, seq from graph_edges where outcome_id is null""")
def k07(spark, d):
    return store.upsert_edges(graph_edges(spark, d)).select("user_id", "outcome_id", "source_name", "target_name", "confidence", "evidence", "seq")


_STAGES = "events_by_stage as (select user_id as k, ['extract', 'model', 'belief'][1 + event_id % 3] as stage, case when event_type = 'error' then 'failed' when event_type = 'purchase' then 'completed' else 'pending' end as status, case when event_type = 'error' then 'e' || event_id end as error, event_id as seq from events)"


def stage_events(spark, d):
    names = F.array(F.lit("extract"), F.lit("model"), F.lit("belief"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("pending")
    return table(spark, d, "events").select(F.col("user_id").alias("k"), F.element_at(names, (F.col("event_id") % 3 + 1).cast("int")).alias("stage"), status.alias("status"), F.when(status == "failed", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"), F.col("event_id").alias("seq"))


_ST = lambda s: f"case when bool_or(stage = '{s}' and status = 'completed') then 'completed' else coalesce(arg_max(status, seq) filter (where stage = '{s}'), 'pending') end as {s}_status"


@query("k08_stage_status", f"with {_STAGES} select k, {_ST('extract')}, {_ST('model')}, {_ST('belief')}, arg_max(error, seq) filter (where status = 'failed') as last_error from events_by_stage group by k")
def k08(spark, d):
    return store.stage_status(stage_events(spark, d), "k", ["extract", "model", "belief"])


@query("k09_complete_outcomes", """select outcome_id, case when outcome_id % 2 = 0 then 'm' || outcome_id else 'old' end as memory_id, case when outcome_id % 2 = 0 then 'completed' else status end as status,
    case when outcome_id % 2 = 0 or status = 'completed' then null else 'boom' end as error, case when outcome_id % 2 = 0 then 2 else 1 end::bigint as n_keys, case when outcome_id % 2 = 0 then 'new' else 'old' end as a from outcomes""")
def k09(spark, d):
    o = outcomes(spark, d).select("outcome_id", F.lit("old").alias("memory_id"), "status", F.lit("boom").alias("error"), F.create_map(F.lit("a"), F.lit("old")).alias("metadata"))
    u = outcomes(spark, d).filter("outcome_id % 2 = 0").select("outcome_id", F.concat(F.lit("m"), F.col("outcome_id").cast("string")).alias("memory_id"), F.lit("completed").alias("status"), F.create_map(F.lit("a"), F.lit("new"), F.lit("b"), F.lit("x"), F.lit("c"), F.lit(None).cast("string")).alias("metadata"))
    return store.complete_outcomes(o, u).select("outcome_id", "memory_id", "status", "error", F.size("metadata").cast("bigint").alias("n_keys"), F.col("metadata")["a"].alias("a"))


@query("k10_delete", "select id from memory_items where id % 10 <> 3")
def k10(spark, d):
    return store.delete(memory_items(spark, d), memory_items(spark, d).filter("id % 10 = 3"), "id").select("id")


@query("t06_idempotency_conflicts", "select idempotency_key, count(distinct user_id) as n_requests from outcomes group by 1 having count(distinct user_id) > 1")
def t06(spark, d):
    return store.conflicts(outcomes(spark, d), "idempotency_key", store.request_identity("user_id"))


@query("f24_request_identity", """select outcome_id, 'derived:' || sha256('{"user_id":' || user_id || ',"status":"' || status || '"}') as identity from outcomes""")
def f24(spark, d):
    return outcomes(spark, d).select("outcome_id", store.request_identity("user_id", "status").alias("identity"))


@query("a01_person_topic_model", f"with {_MODELS} select * from models")
def a01(spark, d):
    return models.person_topic_models(observations(spark, d))


@query("a01_replay_idempotent", f"with {_MODELS} select person, topic, niceness, confidence, evidence_count, last_observed_at from models")
def a01_replay(spark, d):
    twice = observations(spark, d)
    again = twice.withColumns({"seq": F.col("seq") + 10**15, "niceness": F.lit(1.0)})
    return models.person_topic_models(twice.unionByName(again)).select("person", "topic", "niceness", "confidence", "evidence_count", "last_observed_at")


@query("a01_incremental", f"with {_MODELS} select * from models")
def a01_incremental(spark, d):
    o = observations(spark, d)
    early, late = o.filter("memory_id % 2 = 0"), o.filter("memory_id % 2 = 1 or memory_id % 20 = 0")  # with replays
    return models.models_of(models.model_state(late, models.model_state(early), early))


@query("a02_evidence_union", "select person, topic, list(memory_id::varchar order by s) as evidence from (select person, topic, memory_id, min(seq) as s from observations group by all) group by person, topic")
def a02(spark, d):
    return models.evidence(observations(spark, d), ["person", "topic"])


@query("a03_manual_edit", f"with {_MODELS} select person, topic, case when person % 2 = 0 then 1.0 else niceness end as niceness, confidence, case when person % 2 = 0 then 7 else evidence_count end::bigint as evidence_count from models")
def a03(spark, d):
    m = models.person_topic_models(observations(spark, d))
    none = F.lit(None).cast("double")
    e = m.filter("person % 2 = 0").select("person", "topic", F.lit(3.5).alias("niceness"), *(none.alias(s) for s in models.SCORES[1:]), F.lit(-4).cast("bigint").alias("evidence_count"), F.lit(7).cast("bigint").alias("evidence_size"), F.lit(None).cast("timestamp").alias("last_observed_at"))
    return models.edit_models(m, e).select("person", "topic", "niceness", "confidence", "evidence_count")


@query("f10_person_summary", f"""with {_MODELS} select person, topic, person || ' on ' || topic || ': working estimate only; ' || {" || ', ' || ".join(f"'{s} ' || case when {s} >= 0.7 then 'high' when {s} <= 0.35 then 'low' else 'mixed' end" for s in models.SCORES[:4])}
    || '; confidence=' || regexp_replace(regexp_replace(regexp_replace(printf('%.2f', confidence), '0+$', ''), '\\.$', ''), '^0$', '') || '; evidence_count=' || evidence_count || '. Treat as topic-specific and uncertain.' as summary from models""")
def f10(spark, d):
    m = models.person_topic_models(observations(spark, d))
    return m.select("person", "topic", models.person_lines(m).alias("summary"))


_NS = "case s when 'supports' then 'supports' when 'questions' then 'weakens' when 'refutes' then 'contradicts' else 'unknown' end"
_MERGE = "case when a.s = 'unknown' then x.s when x.s = 'unknown' or a.s = x.s then a.s else 'unknown' end"
_CLASH = "(a.s <> 'unknown' and x.s <> 'unknown' and a.s <> x.s)"
_MEAN = "(a.c * a.n + x.c) / (a.n + 1)"
_BELIEFS = f"""b0 as (select *, {_NORM('claim')} as key, {_NS.replace('case s', 'case stance')} as ns from belief_observations qualify row_number() over (partition by user_id, topic_id, {_NORM('claim')}, memory_id order by seq) = 1),
    b1 as (select user_id, topic_id, key, arg_min(claim, seq) as claim, max(observed_at) as last_observed_at, list({{'s': ns, 'c': confidence, 'n': 1::bigint, 'x': false}} order by seq) as rows from b0 group by user_id, topic_id, key),
    beliefs as (select *, list_reduce(rows, lambda a, x: {{'s': {_MERGE}, 'c': case when {_CLASH} then least({_MEAN}, 0.6) else {_MEAN} end, 'n': a.n + 1, 'x': a.x or {_CLASH}}}) as f from b1)"""


@query("a04_belief_fold", f"with {_BELIEFS} select user_id, topic_id, claim, f.s as stance, round(f.c, 9) as confidence, f.n as evidence_count, f.x as contradiction, last_observed_at from beliefs")
def a04(spark, d):
    return models.fold_beliefs(belief_observations(spark, d)).drop("stance_history")


@query("t04_incremental_beliefs", f"with {_BELIEFS} select user_id, topic_id, claim, f.s as stance, round(f.c, 9) as confidence, f.n as evidence_count, f.x as contradiction, last_observed_at from beliefs")
def t04(spark, d):
    b = belief_observations(spark, d)
    late = F.col("memory_id") > F.lit(b.agg(F.avg("memory_id")).first()[0])
    early = b.filter(~late).withColumn("key", normalize_name(F.col("claim")))
    replayed = b.filter(~late & (F.col("memory_id") % 7 == 0)).withColumn("seq", F.col("seq") + 10**15)
    state = models.belief_state(b.filter(late).unionByName(replayed), models.belief_state(early.drop("key")), early)
    return models.beliefs_of(state).drop("stance_history")


@query("a06_stance_fold", f"with {_BELIEFS} select user_id, topic_id, f.s as stance, f.x as contradiction from beliefs")
def a06(spark, d):
    return models.fold_beliefs(belief_observations(spark, d)).select("user_id", "topic_id", "stance", "contradiction")


@query("j04_belief_topic", f"""with {_BELIEFS} select user_id, topic_id, claim, case topic_id when 1 then 'ASIA "x"' else 'general' end as topic,
    case topic_id when 1 then 'ASIA "x"' else 'general' end || ': claim "' || claim || '" is ' || case f.s when 'supports' then 'currently supported' when 'weakens' then 'currently weakened' when 'contradicts' then 'currently contradicted' else 'currently uncertain' end
    || ' (confidence=' || regexp_replace(regexp_replace(printf('%.2f', round(f.c, 9)), '0+$', ''), '\\.$', '') || ', evidence_count=' || f.n || ').' || case when f.x then ' Conflicting evidence exists, so treat this as uncertain.' else '' end as summary from beliefs""")
def j04(spark, d):
    topics = spark.range(1, 2).select(F.col("id").alias("topic_id"), F.lit('ASIA "x"').alias("name"))
    return models.belief_view(models.fold_beliefs(belief_observations(spark, d)), topics)


@query("j03_models_of_topics", f"with {_MODELS} select person, topic, evidence_count from models join (values ('click'), ('view')) t(name) on topic = name")
def j03(spark, d):
    names = spark.createDataFrame([("click",), ("view",)], "topic string")
    return models.person_topic_models(observations(spark, d).join(F.broadcast(names), "topic", "left_semi")).select("person", "topic", "evidence_count")


@query("j05_requested_models", f"with {_MODELS} select pos, name, person, topic, evidence_count from (values (0::bigint, 'Supplier#000000002'), (1, 'nobody'), (2, ' supplier#000000001')) r(pos, name) join supplier on {_NORM('name')} = {_NORM('s_name')} join models on person = s_suppkey")
def j05(spark, d):
    names = spark.createDataFrame([(0, "Supplier#000000002"), (1, "nobody"), (2, " supplier#000000001")], "pos bigint, name string")
    entities = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return models.requested(models.person_topic_models(observations(spark, d)), F.broadcast(names), entities).select("pos", "name", "person", "topic", "evidence_count")


_ENT = "ent as (select p_partkey as id, 'Part ' || p_partkey as name, ['part  ' || (p_partkey + 1), 'alias ' || (p_partkey % 9)] as aliases from part)"


@query("j06_alias_resolution", f"""with {_ENT}, k as (select {_NORM('name')} as k, 0 as p, id from ent union all select {_NORM('unnest(aliases)')}, unnest([1, 2]), id from ent),
    n as (select distinct 'PART ' || l_partkey as name from lineitem union select 'Alias  ' || (l_suppkey % 12) from lineitem union select 'PART ' || (o_orderkey + 1) from orders)
    select name, arg_min(id, p * 1000000 + id) as id from n join k on {_NORM('name')} = k group by name""")
def j06(spark, d):
    p = table(spark, d, "part")
    ent = p.select(F.lit(1).alias("user_id"), F.col("p_partkey").alias("id"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("name"), F.array(F.concat(F.lit("part  "), (F.col("p_partkey") + 1).cast("string")), F.concat(F.lit("alias "), (F.col("p_partkey") % 9).cast("string"))).alias("aliases"))
    li = table(spark, d, "lineitem")
    tail = lambda head, c: F.concat(F.lit(head), c.cast("string")).alias("name")
    n = li.select(tail("PART ", F.col("l_partkey"))).union(li.select(tail("Alias  ", F.col("l_suppkey") % 12))).union(table(spark, d, "orders").select(tail("PART ", F.col("o_orderkey") + 1))).distinct()
    return models.resolve_names(n.withColumn("user_id", F.lit(1)), ent, ["user_id"]).select("name", "id")


@query("j07_belief_topic_resolution", f"""with {_ENT}, k as (select {_NORM('name')} as k, 0 as p, id from ent union all select {_NORM('unnest(aliases)')}, unnest([1, 2]), id from ent),
    r as (select arg_min(id, p * 1000000 + id) as id, k from k group by k)
    select o_orderkey, coalesce(r.id, -1)::bigint as topic from orders left join r on 'part ' || (o_custkey + 1) = k""")
def j07(spark, d):
    p = table(spark, d, "part")
    ent = p.select(F.lit(1).alias("user_id"), F.col("p_partkey").alias("id"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("name"), F.array(F.concat(F.lit("part  "), (F.col("p_partkey") + 1).cast("string")), F.concat(F.lit("alias "), (F.col("p_partkey") % 9).cast("string"))).alias("aliases"))
    docs = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("PART  "), (F.col("o_custkey") + 1).cast("string")).alias("name"))
    found = models.resolve_names(docs.select("name").distinct().withColumn("user_id", F.lit(1)), ent, ["user_id"])
    return docs.join(found, "name", "left").select("o_orderkey", F.coalesce("id", F.lit(-1)).cast("bigint").alias("topic"))


@query("u04_union_once", "select id, case when min(o) = 0 then 'first' else 'second' end as origin from (select id, 0 as o from memory_items where id % 2 = 0 union all select id, 1 from memory_items where id % 3 = 0) group by id")
def u04(spark, d):
    m = memory_items(spark, d)
    return models.union_once(m.filter("id % 2 = 0").select("id", F.lit("first").alias("origin")), m.filter("id % 3 = 0").select("id", F.lit("second").alias("origin")), "id")


@query("u05_fallback_union", "with t as (select * from belief_observations where topic_id = 1 and stance = 'supports') select user_id, memory_id, seq from t union all select user_id, memory_id, seq from belief_observations where user_id not in (select user_id from t)")
def u05(spark, d):
    b = belief_observations(spark, d)
    return models.with_fallback(b.filter("topic_id = 1 and stance = 'supports'"), b, "user_id").select("user_id", "memory_id", "seq")


@query("u06_json_merge", """select event_id, coalesce((props::json->>'k'), 'none') as k, case when event_id % 2 = 0 then 'new' else 'old' end as a from events""")
def u06(spark, d):
    e = table(spark, d, "events")
    left = F.map_concat(F.create_map(F.lit("a"), F.lit("old")), F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>")))
    right = F.create_map(F.lit("a"), F.when(F.col("event_id") % 2 == 0, "new"), F.lit("k"), F.lit(None).cast("string"))
    merged = store.merge_maps(left, right)
    return e.select("event_id", F.coalesce(merged["k"], F.lit("none")).alias("k"), merged["a"].alias("a"))


