"""Queries of parsing, validation, sources and sinks, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import candidate_limit, list_limit, prefetch_limit
from tessera.functions import text
from tessera.operators import context, ingest, retrieval
from tessera.operators.queries_context import _RES, _UNIQ, results
from tessera.operators.queries_search import _FNV, _TOK
from tessera.plans.registry import query
from tessera.plans.scratch import Scratch
from tessera.sources import datasets
from tessera.sources.tables import table
from tessera.sources.views import memory_items, messages

_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


# -- request bodies: whole messages as JSON, some of them spoilt in one of the ways that requests are

_BODIES = """bodies as (select session_id, seq, (session_id * 31 + seq) % 8 as k, to_json({'role': role, 'content': content})::varchar as j from messages),
    raws as (select session_id, seq, case k when 1 then j[:-2] || ',"extra":1}' when 2 then j || ' ' || j when 3 then ' ' when 4 then j[:-2] when 5 then '{"role":"user","content":5}' when 6 then chr(10) || j || ' ' when 7 then '{"role":null}' else j end as raw from bodies)"""
_VALID = "(json_valid(raw) and len(list_filter(json_keys(raw), lambda x: x not in ('role', 'content'))) = 0 and coalesce(json_type(raw, '$.content') in ('VARCHAR', 'NULL'), true))"


def bodies(spark, d):
    j, k = F.to_json(F.struct("role", "content")), (F.col("session_id") * 31 + F.col("seq")) % 8
    open_ = F.substring(j, F.lit(1), F.length(j) - 1)
    raw = F.when(k == 1, F.concat(open_, F.lit(',"extra":1}'))).when(k == 2, F.concat(j, F.lit(" "), j)).when(k == 3, " ").when(k == 4, open_).when(k == 5, '{"role":"user","content":5}').when(k == 6, F.concat(F.lit("\n"), j, F.lit(" "))).when(k == 7, '{"role":null}').otherwise(j)
    return messages(spark, d).select("session_id", "seq", raw.alias("raw"))


@query("s22_request_bodies", f"""with {_BODIES} select session_id, seq, case when trim(raw) = '' then 'empty_body' when {_VALID} then null when not json_valid(raw) and json_valid('[' || replace(raw, '}} {{', '}},{{') || ']') then 'trailing_json' else 'invalid_json' end as error,
    case when trim(raw) <> '' and {_VALID} then raw->>'content' end as content from raws""")
def s22(spark, d):
    b = bodies(spark, d).withColumn("p", ingest.request_body(F.col("raw"), {"role": str, "content": str}))
    return b.select("session_id", "seq", F.col("p.error").alias("error"), F.get_json_object("p.body", "$.content").alias("content"))


# -- extractions: documents as a model would hand them in

_KINDS = "['project_fact', 'outcome', ' topic_fact ', 'gossip', 'person_observation', '', 'belief_update']"
_ANSWERS = f"""answers as (select doc_id, text, {_KINDS}[1 + doc_id % 7] as kind, case when doc_id % 5 = 0 then ' ' else text end as summary, [lang, upper(lang), ' ', source] as topics, [{{'type': 'person', 'name': source}}, {{'type': 'person', 'name': upper(source)}}, {{'type': case when doc_id % 11 = 0 then 'alien' else 'topic' end, 'name': case when doc_id % 3 = 0 then '' else lang end}}] as entities,
    doc_id % 300 / 100 - 1 as importance, doc_id % 4 - 1 as days, doc_id % 13 = 0 as extra from documents)"""


def answers(spark, d):
    x = F.col("doc_id")
    kinds = F.array(*map(F.lit, ("project_fact", "outcome", " topic_fact ", "gossip", "person_observation", "", "belief_update")))
    e = lambda t, n: F.struct(t.alias("type"), n.alias("name"))
    entities = F.array(e(F.lit("person"), F.col("source")), e(F.lit("person"), F.upper("source")), e(F.when(x % 11 == 0, "alien").otherwise("topic"), F.when(x % 3 == 0, "").otherwise(F.col("lang"))))
    body = F.struct(F.when(x % 5 == 0, " ").otherwise(F.col("text")).alias("summary"), F.element_at(kinds, (x % 7 + 1).cast("int")).alias("type"), F.array(F.col("lang"), F.upper("lang"), F.lit(" "), F.col("source")).alias("topics"), entities.alias("entities"), (x % 300 / 100 - 1).alias("importance"), (x % 4 - 1).alias("expires_in_days"), F.when(x % 13 == 0, 1).alias("extra"))
    j = F.to_json(body)
    raw = F.when(x % 2 == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).otherwise(j)
    return table(spark, d, "documents").select("doc_id", raw.alias("raw"))


@query("p12_extraction", f"""with {_ANSWERS}, e as (select *, case when extra then 'invalid_json' when {_STRIP('summary')} = '' then 'summary is required' when trim(kind) not in ('belief_update', 'interaction_observation', 'outcome', 'person_observation', 'person_preference', 'project_fact', 'topic_fact') then 'unknown type'
    when len(list_filter(entities, lambda e: e.name <> '' and e.type not in ('claim', 'document', 'event', 'organization', 'person', 'project', 'system', 'topic'))) > 0 then 'unknown entity type' end as error from answers)
    select doc_id, error, case when error is null then {_STRIP('summary')} end as summary, case when error is null then trim(kind) end as type, case when error is null then {_UNIQ('topics')} end as topics, case when error is null then len(list_distinct(list_transform(list_filter(entities, lambda e: e.name <> ''), lambda e: e.type || ':' || lower(e.name)))) end::bigint as n_entities,
    case when error is null then greatest(least(importance, 1), 0) end as importance, case when error is null and days > 0 then days end::bigint as expires_in_days from e""")
def p12(spark, d):
    v = answers(spark, d).withColumn("p", ingest.extraction(F.col("raw")))
    return v.select("doc_id", "p.error", "p.value.summary", "p.value.type", "p.value.topics", F.size("p.value.entities").cast("bigint").alias("n_entities"), "p.value.importance", "p.value.expires_in_days").withColumn("n_entities", F.when(F.col("error").isNull(), F.col("n_entities")))


@query("p12_split_valid", f"with {_ANSWERS} select case when extra or {_STRIP('summary')} = '' or trim(kind) in ('gossip', '') or (doc_id % 11 = 0 and doc_id % 3 > 0) then 'bad' else 'good' end as side, count(*) as n from answers group by 1")
def p12_split(spark, d):
    good, bad = ingest.split_valid(answers(spark, d).withColumn("p", ingest.extraction(F.col("raw"))), "p")
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(good, "good").unionByName(count(bad, "bad")).filter("n > 0")


@query("p13_valid_observations", f"""select doc_id, (case when {_STRIP('text')} <> '' and doc_id % 3 > 0 then 1 else 0 end)::bigint + 1 as pairs, (case when {_STRIP('text')} <> '' then 1 else 0 end)::bigint as beliefs, (case when doc_id % 4 > 0 then 1 else 0 end)::bigint as edges, {_STRIP('text')} <> '' as summary from documents""")
def p13(spark, d):
    x, t = F.col("doc_id"), F.col("text")
    pair = lambda p, q: F.struct(p.alias("person_name"), q.alias("topic_name"))
    pairs = F.array(pair(t, F.when(x % 3 > 0, F.col("lang"))), pair(F.col("lang"), F.col("source")), pair(F.lit("\t"), F.col("lang")))
    edge = F.struct(F.lit("person").alias("source_kind"), F.col("lang").alias("source_name"), F.lit("topic").alias("target_kind"), F.when(x % 4 > 0, F.col("source")).otherwise(" ").alias("target_name"), F.lit("likes").alias("relationship"))
    n = lambda c: F.size(c).cast("bigint")
    beliefs = F.array(F.struct(t.alias("claim")), F.struct(F.lit(None).cast("string").alias("claim")))
    return table(spark, d, "documents").select("doc_id", n(ingest.valid_pairs(pairs)).alias("pairs"), n(ingest.valid_beliefs(beliefs)).alias("beliefs"), n(ingest.valid_edges(F.array(edge))).alias("edges"), ingest.valid_analysis(t).alias("summary"))


@query("v05_candidate_limits", "select i as n, least(200, greatest(20, 4 * case when i > 0 then i else 10 end)) as candidates, least(600, 3 * least(200, greatest(20, 4 * case when i > 0 then i else 10 end))) as prefetch from range(0, 101) r(i)")
def v05(spark, d):
    return spark.createDataFrame([(i, candidate_limit(i), prefetch_limit(candidate_limit(i))) for i in range(101)], "n bigint, candidates bigint, prefetch bigint")


@query("p14_limits", "select i as n, case when i > 100 then null when i = 0 then 50 else i end as list, case when i > 50 then null when i = 0 then 10 else i end as search from range(0, 131) r(i)")
def p14(spark, d):
    def asked(i, most, default):
        try:
            return list_limit(i, default, most)
        except ValueError:
            return None

    return spark.createDataFrame([(i, asked(i, 100, 50), asked(i, 50, 10)) for i in range(131)], "n bigint, list bigint, search bigint")


@query("o03_sorted_sparse_vector", f"select session_id, seq, list(idx order by idx) as indices, list(w order by idx) as weights from (select session_id, seq, {_FNV.format(t='t')} as idx, count(*)::double as w from (select session_id, seq, unnest({_TOK('content')}) as t from messages) group by all) group by session_id, seq")
def o03(spark, d):
    m = messages(spark, d).select("session_id", "seq", retrieval.sparse_vector(F.col("content")).alias("v")).filter(F.size("v") > 0)
    return m.select("session_id", "seq", F.map_keys("v").alias("indices"), F.map_values("v").alias("weights"))


_TOP6 = "t6 as (select * from res where rank <= 6)"


def packets(spark, d):
    """A packet for each tenant, with names in several casings."""
    users = memory_items(spark, d).select(F.col("user_id").alias("query_id")).distinct()
    return users.select("query_id", F.array(F.lit("P3"), F.lit(" p7 "), F.lit("nobody")).alias("people"), F.array(F.lit("DE"), F.lit("src1")).alias("topics"))


@query("u02_packet_names", f"""with {_RES}, {_TOP6}, f as (select query_id, flatten(list(people order by rank)) as people, flatten(list(topics order by rank)) as topics from t6 group by query_id)
    select query_id, {_UNIQ("list_concat(['P3', ' p7 ', 'nobody'], people)")} as people, {_UNIQ("list_concat(['DE', 'src1'], topics)")} as topics from f""")
def u02(spark, d):
    r, p = results(spark, d).filter("rank <= 6"), packets(spark, d)
    a, b = context.packet_names(p, r, "people"), context.packet_names(p, r, "topics")
    return a.withColumnRenamed("names", "people").join(b.withColumnRenamed("names", "topics"), "query_id")


@query("a07_topic_context", f"""with {_RES}, {_TOP6}, m as (select query_id, rank, unnest(topics) as name, unnest(range(2)) as spot, {_STRIP('summary')} as s from t6), l as (select query_id, name || ': ' || case when length(s) <= 120 then s else substr(s, 1, 117) || '...' end as line, name, rank, spot from m),
    w as (select * from (values ('DE', 0), ('src1', 1)) v(wanted, ask)), h as (select query_id, ask, arg_min(wanted || substr(line, length(name) + 1), rank) as line from l join w on lower(name) = lower(wanted) group by query_id, ask),
    x as (select query_id, line, 1000000 + ask as o from h union all select query_id, line, 2000000 + rank * 10 + spot from l), f as (select query_id, arg_min(trim(line), o) as line, min(o) as o from x group by query_id, lower({_STRIP('line')}))
    select query_id, row_number() over (partition by query_id order by o)::bigint as pos, line from f qualify pos <= 6""")
def a07_topics(spark, d):
    found = context.name_context(packets(spark, d), results(spark, d).filter("rank <= 6"), "topics")
    return found.withColumn("pos", F.col("pos").cast("bigint"))


@query("f12_model_score", "select doc_id, case when x = 0 then '' else regexp_replace(regexp_replace(printf('%.2f', x), '0+$', ''), '\\.$', '') end as value from (select doc_id, least(greatest(doc_id % 103 / 100 - 0.01, 0), 1) as x from documents)")
def f12(spark, d):
    return table(spark, d, "documents").select("doc_id", text.bare_score(F.col("doc_id") % 103 / 100 - 0.01).alias("value"))


@query("f25_json_getters", f"select doc_id, {_STRIP('text')} as text, '' as wrong, doc_id % 2 = 0 as flag, false as no_flag, [lang, source] as texts from documents")
def f25(spark, d):
    x = F.col("doc_id")
    v = F.parse_json(F.concat(F.lit('{"t":'), F.regexp_extract(F.to_json(F.struct(F.concat(F.lit(" "), "text").alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1), F.lit(',"n":5,"b":'), F.when(x % 2 == 0, "true").otherwise("false"), F.lit(',"l":["'), "lang", F.lit('",7,null,"'), "source", F.lit('"]}')))
    return table(spark, d, "documents").select("doc_id", ingest.text_at(v, "t").alias("text"), ingest.text_at(v, "n").alias("wrong"), ingest.flag_at(v, "b").alias("flag"), ingest.flag_at(v, "t").alias("no_flag"), ingest.texts_at(v, "l").alias("texts"))


_INPUTS = f"""i as (select session_id, seq, role, content, {_STRIP('content')} as c, (session_id + seq) % 5 as k from messages)"""


@query("f27_input_messages", f"""with {_INPUTS} select session_id, seq, case when k = 4 then 'unsupported input format' when c = '' and k = 0 then 'input must not be empty' end as error,
    case k when 0 then 'user' when 1 then role when 2 then role || '|user' when 3 then 'user' end as roles, case k when 0 then c when 1 then c when 2 then c || '|' || c || chr(10) || 'end' when 3 then c || chr(10) || c end as contents from i""")
def f27(spark, d):
    k = (F.col("session_id") + F.col("seq")) % 5
    j = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)
    c, r = j(F.col("content")), j(F.col("role"))
    blocks = lambda *xs: F.concat(F.lit('{"content":[{"text":'), xs[0], *(y for x in xs[1:] for y in (F.lit('},{"text":'), x)), F.lit('},{"kind":1}]}'))
    raw = F.when(k == 0, c).when(k == 1, F.concat(F.lit('{"role":'), r, F.lit(',"content":'), c, F.lit("}"))).when(k == 2, F.concat(F.lit('[{"role":'), r, F.lit(',"content":'), c, F.lit('},{"content":" "},'), blocks(c, F.lit('"end"')), F.lit("]"))).when(k == 3, blocks(c, c)).otherwise("17")
    m = messages(spark, d).select("session_id", "seq", ingest.messages_of(F.lit(" "), raw).alias("p"))
    joined = lambda f: F.when(F.col("p.error").isNull(), F.array_join(F.transform("p.messages", lambda x: x[f]), "|"))
    return m.select("session_id", "seq", "p.error", joined("role").alias("roles"), joined("content").alias("contents"))


_HOP = "('203.0.113.' || event_id % 250)"


@query("f34_client_address", f"select event_id, case event_id % 5 when 0 then {_HOP} when 1 then '10.0.0.9' when 2 then {_HOP} when 3 then '198.51.100.7' else '' end as address from events")
def f34(spark, d):
    e, hop = F.col("event_id"), F.concat(F.lit("203.0.113."), (F.col("event_id") % 250).cast("string"))
    remote = F.when(e % 5 == 3, "198.51.100.7:80").when(e % 5 == 4, "nowhere").otherwise("[::ffff:10.0.0.9]:443")
    header = F.when(e % 5 == 0, F.concat(F.lit("1.1.1.1, "), hop, F.lit(" , 10.1.2.3"))).when(e % 5 == 1, F.concat(hop, F.lit(", what, 10.1.2.3"))).when(e % 5 == 2, F.concat(F.lit("::ffff:"), hop)).otherwise("9.9.9.9")
    return table(spark, d, "events").select("event_id", ingest.client_address(remote, header, ["10.0.0.0/8"]).alias("address"))


# -- sources and sinks


@query("s21_json_dataset", "select 'cases ' || lang as dataset, doc_id::varchar as id, text as query, 1::bigint as n_memories, n_chars / 1e6 as importance from documents")
def s21(spark, d):
    docs = table(spark, d, "documents")
    memory = F.struct(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("raw_text"), (F.col("n_chars") / 1e6).alias("importance"))
    case = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("query"), F.array(memory).alias("memories"))
    # one object a file, as datasets are: a file for each language and id range of a few documents
    sets = docs.groupBy("lang", F.floor(F.col("doc_id") / 500).alias("part")).agg(F.concat(F.lit("cases "), "lang").alias("name"), F.collect_list(case).alias("cases"))
    at = f"{Scratch(spark, 'dataset').path}/json"
    sets.select("lang", "part", F.to_json(F.struct("name", "cases")).alias("value")).write.partitionBy("lang", "part").text(at)
    read = datasets.evaluation_dataset(spark, f"{at}/*/*")
    return read.select("dataset", "id", "query", F.size("memories").cast("bigint").alias("n_memories"), F.col("memories")[0]["importance"].alias("importance"))


@query("k11_index_upsert", "select id, case when id % 3 = 0 then 'new' else 'old' end as state from memory_items where id % 10 <> 3 union all select id + 1000000000, 'new' from memory_items where id % 3 = 0")
def k11(spark, d):
    m, scratch = memory_items(spark, d).select("id"), Scratch(spark, "index")
    index = datasets.ensure_index(spark, f"{scratch.path}/points", "id bigint, state string")
    index = datasets.upsert_points(index, m.withColumn("state", F.lit("old")))
    new = m.filter("id % 3 = 0")
    twice = new.select("id", F.lit("lost").alias("state"), F.lit(1).alias("seq")).unionByName(new.union(new.select(F.col("id") + 1_000_000_000)).select("id", F.lit("new").alias("state"), F.lit(2).alias("seq")))
    return datasets.delete_points(datasets.upsert_points(index, twice, "seq"), m.filter("id % 10 = 3"))


@query("k13_append", "select session_id, seq, role, content from messages")
def k13(spark, d):
    at = f"{Scratch(spark, 'messages').path}/messages"
    m = messages(spark, d)
    for part in (m.filter("seq % 2 = 0"), m.filter("seq % 2 <> 0 or seq is null")):
        datasets.append(part, at, ("content",), ("system", "user", "assistant"))
    return spark.read.parquet(at).select("session_id", "seq", "role", "content")
