"""Queries of retrieval, ranking and their filters, over the memory views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import Scoring, Search
from tessera.functions.lists import folded_member, trimmed_overlap
from tessera.functions.text import TOKEN, token_set
from tessera.operators import models, rerank, retrieval
from tessera.plans.registry import query
from tessera.plans.scratch import Scratch
from tessera.sources.views import AS_OF, memory_items, moment, search_queries

CONFIG = Search(limit=10)
NOW = f"make_timestamp({AS_OF} * 1000000::bigint)"
_TOK = lambda x: f"list_filter(regexp_extract_all(lower({x}), '{TOKEN}'), lambda t: length(t) >= 2)"
_SET = lambda x: f"list_distinct({_TOK(x)})"
_JAC = lambda a, b: f"(case when len({a}) = 0 or len({b}) = 0 then 0 else len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) end)"
_FNV = "list_reduce(list_transform(range(1, length({t}) + 1), lambda i: ascii(substr({t}, i, 1))::bigint), lambda h, c: (xor(h, c) * 16777619) % 4294967296, 2166136261::bigint)"


def _as_of():
    return moment(AS_OF)


PAIRS = "pairs as (select q.query_id, m.id from search_queries q join memory_items m on q.user_id = m.user_id and (len(q.topics_any) = 0 or list_has_any(m.topics, q.topics_any)) and m.confidence >= q.min_confidence)"
DENSE = f"dense as (select query_id, id, dense, rank from (select p.query_id, p.id, round(list_cosine_similarity(m.dense, q.query_dense), 6) as dense, row_number() over (partition by p.query_id order by round(list_cosine_similarity(m.dense, q.query_dense), 6) desc, p.id) as rank from pairs p join memory_items m on m.id = p.id join search_queries q on q.query_id = p.query_id) where rank <= {CONFIG.prefetch})"
SPARSE = f"""mt as (select id, t, count(*) as w from (select id, unnest({_TOK("summary")}) as t from memory_items) group by all),
    qt as (select query_id, t, count(*) as v from (select query_id, unnest({_TOK("query")}) as t from search_queries) group by all),
    dots as (select p.query_id, p.id, sum(w * v)::double as sparse from mt join qt using (t) join pairs p on p.id = mt.id and p.query_id = qt.query_id group by p.query_id, p.id),
    sparse as (select query_id, id, sparse, row_number() over (partition by query_id order by sparse desc, id) as rank from dots qualify rank <= {CONFIG.prefetch})"""
HYBRID = f"""fused as (select query_id, id, round(sum(s), 9) as hybrid from (select query_id, id, 1 / ({CONFIG.rrf_k} + rank) as s from dense union all select query_id, id, 1 / ({CONFIG.rrf_k} + rank) from sparse) group by query_id, id),
    hybrid as (select query_id, id, hybrid, row_number() over (partition by query_id order by hybrid desc, id) as rank from fused qualify rank <= {CONFIG.candidates})"""
SCORED = f"""scored as (select h.query_id, h.id, h.hybrid, coalesce(d.dense, 0) as dense, coalesce(s.sparse, 0) as sparse, round(h.hybrid / max(h.hybrid) over (partition by h.query_id), 9) as retrieval
    from hybrid h left join (from dense where rank <= {CONFIG.candidates}) d on h.query_id = d.query_id and h.id = d.id left join (from sparse where rank <= {CONFIG.candidates}) s on h.query_id = s.query_id and h.id = s.id)"""
W = Scoring().normalized()
_GOAL = lambda goal: f"""(case when len({_SET(goal)}) = 0 then 0 else len(list_intersect({_SET(goal)}, {_SET("concat_ws(' ', m.summary, m.raw_text, array_to_string(m.people, ' '), array_to_string(m.topics, ' '), m.memory_type)")})) / len({_SET(goal)}) end)"""
_ASKED = "case when trim(goal) = '' then query else goal end"
_REC = "exp(-ln(2) * (epoch(make_timestamp(1706745600 * 1000000::bigint)) - epoch(created_at)) / 86400 / 30)"
_FINAL = f"round({W['retrieval']!r} * retrieval + {W['recency']!r} * recency + {W['importance']!r} * importance + {W['utility']!r} * utility + {W['goal']!r} * goal_relevance + {W['belief_impact']!r} * belief_impact + {W['confidence']!r} * confidence, 9)"
FINAL = f"""feat as (select s.*, m.summary, m.created_at, m.importance, m.utility, m.belief_impact, m.confidence, round({_REC}, 9) as recency, round({_GOAL(_ASKED)}, 9) as goal_relevance
        from scored s join memory_items m on m.id = s.id join search_queries q on q.query_id = s.query_id where m.confidence >= q.min_confidence and (m.expires_at is null or m.expires_at >= {NOW})),
    fin as (select *, {_FINAL} as final from feat), placed as (select *, row_number() over (partition by query_id order by final desc, retrieval desc, created_at desc, id) as place from fin)"""
_STEP = _JAC("k.tokens", "x[1].tokens")
_WORST = f"coalesce(list_max(list_transform(acc, lambda k: {_STEP})), 0)"
GREEDY = lambda limit, thr: f"""lists as (select query_id, list([{{'id': id, 'final': final, 'sim': 0::double, 'tokens': {_SET("summary")}}}] order by place) as rows from placed group by query_id),
    kept as (select query_id, unnest(list_reduce(rows, lambda acc, x: case when len(acc) >= {limit} or (len(acc) > 0 and {_WORST} >= {thr}) then acc
        else list_append(acc, {{'id': x[1].id, 'final': x[1].final, 'sim': {_WORST}::double, 'tokens': x[1].tokens}}) end, list_filter(rows[1], lambda z: false))) as k,
        generate_subscripts(list_reduce(rows, lambda acc, x: case when len(acc) >= {limit} or (len(acc) > 0 and {_WORST} >= {thr}) then acc
        else list_append(acc, {{'id': x[1].id, 'final': x[1].final, 'sim': {_WORST}::double, 'tokens': x[1].tokens}}) end, list_filter(rows[1], lambda z: false)), 1) as rank from lists)"""  # noqa: E731
ALL = ", ".join([PAIRS, DENSE, SPARSE, HYBRID, SCORED, FINAL])


@query("v15_hybrid_search_rerank", f"with {ALL}, {GREEDY(10, 0.82)} select query_id, k.id as id, rank::bigint as rank, k.final as final, round(k.sim, 9) as max_similarity from kept")
def v15(spark, d):
    return retrieval.search(search_queries(spark, d), memory_items(spark, d), _as_of(), CONFIG)


@query("v12_salience_score", f"with {ALL} select query_id, id, retrieval, recency, goal_relevance, final, place::bigint as place from placed")
def v12(spark, d):
    scored = rerank.features(retrieval.candidates(search_queries(spark, d), memory_items(spark, d), _as_of(), CONFIG), _as_of())
    return rerank.ranked(scored).select("query_id", "id", "retrieval", "recency", "goal_relevance", "final", F.col("place").cast("bigint").alias("place"))


@query("v01_dense_topk", f"with {PAIRS}, {DENSE} select query_id, id, dense, rank::bigint as rank from dense")
def v01(spark, d):
    return retrieval.dense_topk(search_queries(spark, d), memory_items(spark, d), CONFIG.prefetch).withColumn("rank", F.col("rank").cast("bigint"))


@query("v02_sparse_topk", f"with {PAIRS}, {SPARSE} select query_id, id, sparse, rank::bigint as rank from sparse")
def v02(spark, d):
    return retrieval.sparse_topk(search_queries(spark, d), memory_items(spark, d), CONFIG.prefetch).withColumn("rank", F.col("rank").cast("bigint"))


@query("v03_rrf_fusion", f"with {PAIRS}, {DENSE}, {SPARSE}, {HYBRID} select query_id, id, hybrid, rank::bigint as rank from hybrid")
def v03(spark, d):
    q, m = search_queries(spark, d), memory_items(spark, d)
    return retrieval.fuse(retrieval.dense_topk(q, m, CONFIG.prefetch), retrieval.sparse_topk(q, m, CONFIG.prefetch), CONFIG.candidates).withColumn("rank", F.col("rank").cast("bigint"))


@query("v04_sparse_vectors", f"select id, {_FNV.format(t='t')} as idx, count(*)::double as w from (select id, unnest({_TOK('summary')}) as t from memory_items) group by 1, 2")
def v04(spark, d):
    return retrieval.sparse_rows(memory_items(spark, d), "id", "summary")


@query("v06_score_attachment", f"with {PAIRS}, {DENSE}, {SPARSE}, {HYBRID}, {SCORED} select query_id, id, hybrid, dense, sparse, retrieval from scored")
def v06(spark, d):
    return retrieval.attached(search_queries(spark, d), memory_items(spark, d), CONFIG, Scratch(spark, "attached"))


@query("v09_recency", f"select id, round({_REC}, 9) as recency from memory_items")
def v09(spark, d):
    return memory_items(spark, d).select("id", F.round(rerank.recency(F.col("created_at"), _as_of()), 9).alias("recency"))


@query("v10_goal_relevance", f"select query_id, m.id, round({_GOAL("goal")}, 9) as goal_relevance from search_queries q join memory_items m on m.user_id = q.user_id")
def v10(spark, d):
    return retrieval.goal_relevance(search_queries(spark, d), memory_items(spark, d))


_SORTED = f"list_sort({_SET('summary')})"


@query("v11_summary_jaccard", f"""with t as (select id, user_id, {_SORTED} as tokens from memory_items), r as (select min(id) as id, user_id, tokens from t where len(tokens) > 0 group by user_id, tokens)
    select r.id as a, t.id as b, 1::double as similarity from t join r on t.user_id = r.user_id and t.tokens = r.tokens where t.id <> r.id
    union all select a.id, b.id, round({_JAC('a.tokens', 'b.tokens')}, 9) from r a join r b on a.user_id = b.user_id and a.id < b.id where {_JAC('a.tokens', 'b.tokens')} >= {Scoring().threshold}""")
def v11(spark, d):
    return rerank.similar_summaries(memory_items(spark, d), Scoring())


_PLACED = "placed as (select user_id as query_id, id, summary, importance as final, row_number() over (partition by user_id order by importance desc, utility desc, created_at desc, id) as place from memory_items)"


@query("v14_greedy_redundancy", f"with {_PLACED}, {GREEDY(50, 0.82)} select query_id, k.id as id, rank::bigint as rank, k.final as final, round(k.sim, 9) as max_similarity from kept")
def v14(spark, d):
    m = memory_items(spark, d).select(F.col("user_id").alias("query_id"), "id", "summary", "created_at", F.col("importance").alias("final"), F.col("utility").alias("retrieval"))
    return rerank.greedy(rerank.ranked(m), 50)


@query("p01_tenant_filter", "select id from memory_items where user_id = 3")
def p01(spark, d):
    return memory_items(spark, d).filter("user_id = 3").select("id")


@query("p02_memory_type", "select id from memory_items where memory_type = 'outcome'")
def p02(spark, d):
    return memory_items(spark, d).filter(retrieval.of_type(F.col("memory_type"), F.lit(" outcome "))).select("id")


@query("p03_people_any", "select id from memory_items where list_has_any(people, ['p1', 'p4'])")
def p03(spark, d):
    return memory_items(spark, d).filter(retrieval.any_match(F.col("people"), F.array(F.lit("p1"), F.lit("p4")))).select("id")


@query("p04_topics_any", "select id from memory_items where list_has_any(topics, ['de', 'src3'])")
def p04(spark, d):
    return memory_items(spark, d).filter(retrieval.any_match(F.col("topics"), F.array(F.lit("de"), F.lit("src3")))).select("id")


@query("p05_confidence_range", "select id from memory_items where confidence >= 0.6")
def p05(spark, d):
    return memory_items(spark, d).filter(retrieval.confident(F.col("confidence"), F.lit(0.6))).select("id")


_TEXT = "lower('summarize the risk for the ' || case when doc_id % 2 = 0 then 'committee ' else 'team ' end || text)"
_ANY = lambda cues: " or ".join(f"contains({_TEXT}, '{c}')" for c in cues)


@query("p06_people_filter_relaxation", f"select doc_id, not (doc_id % 3 > 0 and ({_ANY(retrieval.STATE_CUES)}) and ({_ANY(retrieval.GUIDE_CUES)})) as needed from documents")
def p06(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = F.concat(F.lit("summarize the risk for the "), F.when(F.col("doc_id") % 2 == 0, "committee ").otherwise("team "), "text")
    topics = F.when(F.col("doc_id") % 3 > 0, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>"))
    return docs.select("doc_id", retrieval.people_filter_needed(text, F.lit(""), F.array(F.lit("dana")), topics).alias("needed"))


@query("p07_expiry_filter", f"select id from memory_items where expires_at is null or expires_at >= {NOW}")
def p07(spark, d):
    return memory_items(spark, d).filter(retrieval.unexpired(F.col("expires_at"), _as_of())).select("id")


@query("p08_evidence_overlap", "select outcome_id, seq from graph_edges where list_has_any(list_transform(evidence, lambda x: trim(x)), ['1', '7', '33'])")
def p08(spark, d):
    from tessera.sources.views import graph_edges

    return graph_edges(spark, d).filter(trimmed_overlap(F.col("evidence"), F.array(F.lit(" 1"), F.lit("7 "), F.lit("33")))).select("outcome_id", "seq")


@query("p09_folded_membership", "select id from memory_items where list_contains(list_transform(topics, lambda x: lower(trim(x))), 'src1')")
def p09(spark, d):
    return memory_items(spark, d).filter(folded_member(F.lit(" SRC1"), F.col("topics"))).select("id")


@query("p10_belief_gate", "select id from memory_items where belief_impact > 0 or memory_type in ('belief_update', 'outcome')")
def p10(spark, d):
    return memory_items(spark, d).filter(models.bears_belief(F.col("belief_impact"), F.col("memory_type"))).select("id")


@query("p11_person_model_gate", "select id from memory_items where len(people) > 0 and len(topics) > 0")
def p11(spark, d):
    return memory_items(spark, d).filter(models.bears_models(F.col("people"), F.col("topics"))).select("id")


@query("f04_token_sets", f"select doc_id, list_sort({_SET('text')}) as tokens from documents")
def f04(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_sort(token_set(F.col("text"))).alias("tokens"))
