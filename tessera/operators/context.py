"""Context packets, plans, evaluation and operational aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lists import unique
from tessera.functions.text import clamp, collapse, contains_any, first_non_blank, fixed, join_or, path_label, sentence, strip, truncate, winner, with_likelihood
from tessera.plans.scratch import small

ITEMS, SUMMARY_CHARS, BUDGET = 6, 180, 2200


def memory_context(results: DataFrame, items: int = ITEMS, chars: int = SUMMARY_CHARS, budget: int = BUDGET) -> DataFrame:
    """(query_id, ids, omitted): results in rank order, each summary once; what doesn't fit the
    number or the running budget counts as omitted and the scan goes on.

    Of the summaries of one length only the first ``items`` can be taken, as earlier ones fit wherever a
    later one does; so the fold sees at most ``chars * items`` rows a query, whatever its results."""
    text = first_non_blank(F.col("summary"), F.col("raw_text"))
    own = results.select("query_id", "rank", "id", F.lower(text).alias("key"), F.length(truncate(text, chars)).cast("bigint").alias("n"))
    once = own.groupBy("query_id", "key").agg(F.min(F.struct("rank", "id", "n")).alias("r")).select("query_id", "r.*")
    first = once.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "n").orderBy("rank")))
    row = F.when(F.col("k") <= items, F.struct("rank", "id", "n"))
    lists = first.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.count("*").alias("distinct"))
    id_type = lists.schema["rows"].dataType.elementType["id"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{id_type}>").alias("ids"), F.lit(0).cast("bigint").alias("used"))

    def step(a: Column, r: Column) -> Column:
        add = (F.size(a["ids"]) < items) & (a["used"] + r["n"] <= budget)
        return F.struct(F.when(add, F.concat(a["ids"], F.array(r["id"]))).otherwise(a["ids"]).alias("ids"), F.when(add, a["used"] + r["n"]).otherwise(a["used"]).alias("used"))

    done = lists.withColumn("ids", F.aggregate("rows", start, step)["ids"])
    return done.select("query_id", "ids", (F.col("distinct") - F.size("ids")).alias("omitted"))


def top_lines(lines: DataFrame, key: str, order: str, cap: int = ITEMS) -> DataFrame:
    """The first ``cap`` distinct lines (by stripped lower case) of each key, in order."""
    folded = lines.withColumn("_k", F.lower(strip(F.col("line")))).filter("_k <> ''")
    first = folded.groupBy(key, "_k").agg(F.min_by("line", order).alias("line"), F.min(order).alias(order))
    w = Window.partitionBy(key).orderBy(order)
    return first.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= cap).select(key, "pos", F.trim("line").alias("line"))


def first_mention(results: DataFrame, names: DataFrame) -> DataFrame:
    """For each (query_id, name) the best ranked result that mentions it."""
    mentions = results.select("query_id", "rank", "id", F.explode("people").alias("p")).withColumn("_k", F.lower(strip(F.col("p"))))
    asked = names.select("query_id", "name", F.lower(strip(F.col("name"))).alias("_k"))
    return asked.join(mentions, ["query_id", "_k"]).groupBy("query_id", "name").agg(F.min(F.struct("rank", "id")).alias("m")).select("query_id", "name", F.col("m.id").alias("id"), F.col("m.rank").alias("rank"))


def mentions(results: DataFrame, column: str) -> DataFrame:
    """All names of a list column, by rank and place."""
    return results.select("query_id", "rank", F.posexplode(column).alias("pos", "name"))


def packet_names(packets: DataFrame, results: DataFrame, column: str) -> DataFrame:
    """(query_id, names): the names that a packet asks for and then those of its results in rank order,
    each once. Results of a query are bounded by the search's limit."""
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", column))).alias("r"))
    held = F.flatten(F.transform("r", lambda x: x[column]))
    none = F.array().cast("array<string>")
    return packets.join(rows, "query_id", "left").select("query_id", unique(F.concat(F.coalesce(F.col(column), none), F.coalesce(held, none))).alias("names"))


def name_context(packets: DataFrame, results: DataFrame, column: str, lines: DataFrame | None = None, cap: int = ITEMS) -> DataFrame:
    """(query_id, pos, line): first ready ``lines`` (query_id, pos, line), then for each name that
    the packet asks for its best ranked result not told by then, then all names of all results in rank
    order; each line once, at most ``cap``."""
    line = lambda name: F.concat(name, F.lit(": "), truncate(F.col("summary"), 120))
    told = results.select("query_id", "rank", "summary", F.posexplode(column).alias("at", "name"))
    asked = packets.select("query_id", F.posexplode(column).alias("ask", "wanted"))
    ready = lines.select("query_id", F.lit(0).alias("phase"), F.col("pos").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), "line") if lines is not None else None
    hits = asked.join(told, ["query_id"]).filter(F.lower(strip(F.col("name"))) == F.lower(strip(F.col("wanted"))))
    hits = hits.select("query_id", "ask", "rank", line(F.col("wanted")).alias("line")).withColumn("_k", F.lower("line"))
    if ready is not None:
        hits = hits.join(ready.select("query_id", F.lower(strip(F.col("line"))).alias("_k")), ["query_id", "_k"], "left_anti")
    first = hits.groupBy("query_id", "ask").agg(F.min_by("line", "rank").alias("line"))
    rows = first.select("query_id", F.lit(1).alias("phase"), F.col("ask").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), "line")
    rows = rows.unionByName(told.select("query_id", F.lit(2).alias("phase"), F.col("rank").cast("bigint").alias("a"), F.col("at").cast("bigint").alias("b"), line(F.col("name")).alias("line")))
    if ready is not None:
        rows = rows.unionByName(ready)
    return top_lines(rows.select("query_id", "line", F.struct("phase", "a", "b").alias("at")), "query_id", "at", cap)


def context_packet(packets: DataFrame, results: DataFrame, model_lines: DataFrame, belief_lines: DataFrame) -> DataFrame:
    """The context of each packet (query_id, mode, goal, query, people, topics) from its ranked results and the
    lines (query_id, pos, line) of models and beliefs, for ``render_prompt``: memory_lines, omitted,
    people_context, topic_context and belief_context, each within its budget. Results are those of a search,
    so at most its limit a query."""
    kept = memory_context(results)
    short = results.select("query_id", "id", truncate(first_non_blank(F.col("summary"), F.col("raw_text")), SUMMARY_CHARS).alias("text"))
    memory = kept.select("query_id", F.posexplode("ids").alias("pos", "id")).join(short, ["query_id", "id"])
    gather = lambda df, name: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias(name))
    parts = [
        gather(memory.select("query_id", "pos", F.col("text").alias("line")), "memory_lines"),
        gather(name_context(packets, results, "people", model_lines), "people_context"),
        gather(name_context(packets, results, "topics"), "topic_context"),
        gather(top_lines(belief_lines, "query_id", "pos"), "belief_context"),
    ]
    out = packets.join(kept.select("query_id", "omitted"), "query_id", "left")
    for p in parts:
        out = out.join(p, "query_id", "left")
    none = F.array().cast("array<string>")
    lists = [c.columns[1] for c in parts]
    return out.withColumns({c: F.coalesce(F.col(c), none) for c in lists} | {"omitted": F.coalesce("omitted", F.lit(0))})


def edges_with_evidence(edges: DataFrame, memories: DataFrame, newest: int = 100) -> DataFrame:
    """Of the newest edges those whose evidence has one of the memories (a semi join)."""
    recent = edges.orderBy(F.desc("seq")).limit(newest)
    hit = recent.select("seq", F.explode("evidence").alias("m")).withColumn("m", strip(F.col("m"))).join(memories.select(F.col("id").cast("string").alias("m")), "m", "left_semi")
    return recent.join(hit.select("seq").distinct(), "seq", "left_semi")


def latest_with_property(messages: DataFrame, has: Column) -> DataFrame:
    """Per session the last assistant message with the property, else the last one."""
    own = messages.filter("role = 'assistant'").withColumn("_h", has)
    return own.groupBy("session_id").agg(F.max_by(F.struct("seq", F.col("_h").alias("has")), F.struct("_h", "seq")).alias("m")).select("session_id", F.col("m.seq").alias("seq"), F.col("m.has").alias("has_property"))


def user_text(messages: DataFrame) -> DataFrame:
    """per session the user's texts joined by line ends and the session's title."""
    own = messages.filter("role = 'user'").withColumn("t", strip(F.col("content"))).filter("t <> ''")
    rows = F.array_sort(F.collect_list(F.struct("seq", "t")))
    all_ = own.groupBy("session_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("query"), F.min_by("t", "seq").alias("first"))
    sessions = messages.select("session_id").distinct()
    return sessions.join(all_, "session_id", "left").select("session_id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce(F.substring("first", 1, 80), F.lit("Untitled Session")).alias("title"))


# -- plans

DEFAULT_FALLBACK = "Ask for less, name concrete next steps, or take the option of least friction."


def normalize_plan(strategies: Column, recommended: Column, rationale: Column) -> Column:
    """struct(strategies, recommended, rationale). Strategies without label and draft go, ids
    and labels default to their place in the input, lists are distinct, likelihoods clamped, four stay;
    an unknown recommendation gives way to the best score, the first of equals."""
    numbered = F.transform(strategies, lambda s, i: F.struct(s.alias("s"), (i + 1).alias("i")))
    blank = lambda x: strip(F.coalesce(x, F.lit(""))) == ""
    kept = F.slice(F.filter(numbered, lambda x: ~(blank(x["s"]["label"]) & blank(x["s"]["message_draft"]))), 1, 4)

    def clean(x: Column) -> Column:
        s = x["s"]
        return F.struct(
            F.when(blank(s["id"]), F.concat(F.lit("strategy_"), x["i"].cast("string"))).otherwise(s["id"]).alias("id"), F.when(blank(s["label"]), F.concat(F.lit("Strategy "), x["i"].cast("string"))).otherwise(s["label"]).alias("label"),
            s["message_draft"].alias("message_draft"), s["predicted_response"].alias("predicted_response"), unique(s["benefits"]).alias("benefits"), unique(s["risks"]).alias("risks"), clamp(s["likelihood_of_success"]).alias("likelihood"),
            F.when(blank(s["fallback_option"]), DEFAULT_FALLBACK).otherwise(s["fallback_option"]).alias("fallback"),
        )

    own = F.transform(kept, clean)
    scored = F.transform(own, lambda s, i: F.struct(F.round(s["likelihood"] + (F.size(s["benefits"]) - F.size(s["risks"])) * 0.01, 9).alias("score"), (-i).alias("place"), s["id"].alias("id")))
    known = F.exists(own, lambda s: s["id"] == recommended)
    chosen = F.when(known, recommended).otherwise(F.array_max(scored)["id"])
    label = F.element_at(F.filter(own, lambda s: s["id"] == chosen), 1)["label"]
    why = F.when(~blank(rationale), strip(rationale)).otherwise(F.concat(F.lit("Recommend "), label, F.lit(": it balances fit to the goal, expected response and risk best.")))
    return F.when(F.size(own) > 0, F.struct(own.alias("strategies"), chosen.alias("recommended"), why.alias("rationale")))


def predicted_outcome(plan: Column) -> Column:
    """The recommended strategy's predicted response, else the first's, else ''."""
    hit = F.filter(plan["strategies"], lambda s: s["id"] == plan["recommended"])
    return F.coalesce(F.get(hit, F.lit(0))["predicted_response"], F.get(plan["strategies"], F.lit(0))["predicted_response"], F.lit(""))


RISK_CUES = ["migration", "risk", "steering committee", "tradeoff"]
SUMMARY_CUES = ["briefing", "executive summary", "steering committee", "summarize", "summary"]


def is_decision_summary(goal: Column, query: Column, topics: Column) -> Column:
    """The goal or a cue asks for a summary to decide by."""
    return F.lower(strip(goal)).isin("prepare_meeting", "summarize_topic", "assess_risk") | contains_any(F.lower(F.concat_ws(" ", query, F.array_join(topics, " "))), SUMMARY_CUES)


def is_risk_summary(goal: Column, query: Column, topics: Column) -> Column:
    return (F.lower(strip(goal)) == "assess_risk") | contains_any(F.lower(F.concat_ws(" ", query, F.array_join(topics, " "))), RISK_CUES)


def render_plan(plan: Column, mode: Column, risk: Column, likelihoods: Column) -> Column:
    """F32: advice, risk summary or list of scenarios, as text."""
    strategies = plan["strategies"]
    best = F.element_at(F.filter(strategies, lambda s: s["id"] == plan["recommended"]), 1)
    others = F.filter(strategies, lambda s: s["id"] != plan["recommended"])
    bullets = lambda xs: F.transform(xs, lambda x: F.concat(F.lit("- "), x))
    none = F.array().cast("array<string>")
    part = lambda head, xs: F.when(F.size(xs) > 0, F.concat(F.array(*map(F.lit, head)), bullets(xs))).otherwise(none)
    offer = F.transform(others, lambda s: F.concat(with_likelihood(s["label"], s["likelihood"], likelihoods), F.lit(": "), sentence(s["message_draft"])))
    plain = F.transform(others, lambda s: F.concat(s["label"], F.lit(": "), sentence(s["message_draft"])))
    advice = F.concat(F.array(with_likelihood(F.concat(F.lit("Recommended approach: "), best["label"]), best["likelihood"], likelihoods), F.concat(F.lit("Why: "), plan["rationale"]), F.lit("Draft message:"), strip(best["message_draft"]), F.concat(F.lit("Predicted response: "), strip(best["predicted_response"]))), part(["Benefits:"], best["benefits"]), part(["Risks:"], best["risks"]), F.array(F.concat(F.lit("Fallback: "), strip(best["fallback"]))), part(["Other viable options:"], offer))
    summary = F.concat(F.array(F.lit("Executive summary:"), strip(best["message_draft"]), F.lit(""), F.lit("Why this framing:"), plan["rationale"]), part(["", "What to emphasize:"], best["benefits"]), part(["", "Watchouts:"], best["risks"]), F.array(F.lit(""), F.concat(F.lit("Next step: "), strip(best["fallback"]))), part(["", "Alternative framings:"], plain))
    shown = lambda s: F.when(likelihoods, F.array(F.concat(F.lit("Likelihood of success: "), fixed(s["likelihood"] * 100, 0), F.lit("%")))).otherwise(none)
    one = lambda s, i: F.concat(F.array(F.concat(F.lit("Strategy "), (i + 1).cast("string"), F.lit(" - "), s["label"])), shown(s), F.array(F.lit("Message draft:"), strip(s["message_draft"]), F.concat(F.lit("Predicted response: "), strip(s["predicted_response"])), F.concat(F.lit("Benefits: "), join_or(s["benefits"], "; ")), F.concat(F.lit("Risks: "), join_or(s["risks"], "; ")), F.concat(F.lit("Fallback: "), strip(s["fallback"]))))
    listed = F.concat(F.array(with_likelihood(F.concat(F.lit("Recommended strategy: "), best["label"]), best["likelihood"], likelihoods), F.concat(F.lit("Recommendation rationale: "), plan["rationale"])), F.flatten(F.transform(strategies, one)))
    return F.when(plan.isNull(), None).when(mode != "communication_advice", F.array_join(listed, "\n\n")).when(risk, F.array_join(summary, "\n")).otherwise(F.array_join(advice, "\n"))


MODE_TEXT = {
    "communication_advice": "Give advice on wording, tone, detail and what to leave out. What is known of a person is uncertain and holds for one topic.",
    "scenario_generation": "Offer a few plausible strategies with their tradeoffs and prefer the one nearest to the goal.",
    "normal_answer": "Answer directly, helped by the context where it is relevant.",
}
RULES = ["Grounding rules:", "- Use the context where it helps; if it is thin, say less about it.", "- Never present as remembered what the context doesn't hold.", "- Memories are evidence of some confidence; models of people are estimates, to be worded with care.", "- Give no numbers that neither the user nor the context gave."]
RISK_RULE = "- On risks name drivers and ranges in words; repeat only numbers from the context."


def render_prompt(packets: DataFrame, instructions: str = "") -> DataFrame:
    """(query_id, prompt) of packets (query_id, mode, goal, query, topics, memory_lines,
    people_context, topic_context, belief_context, omitted)."""
    intro = F.lit(MODE_TEXT["normal_answer"])
    for mode, text in MODE_TEXT.items():
        intro = F.when(F.col("mode") == mode, text).otherwise(intro)
    goal = F.coalesce(F.nullif(strip(F.col("goal")), F.lit("")), F.lit("No explicit interaction goal was provided."))
    query = strip(F.col("query"))
    goal_part = F.when(query == "", F.concat(F.lit("Interaction goal:\n- "), goal)).otherwise(F.concat(F.lit("Interaction goal:\n- Goal: "), goal, F.lit("\n- Query: "), query))
    part = lambda head, c, empty: F.concat(F.lit(f"{head}:\n- "), F.when(F.size(c) > 0, F.array_join(c, "\n- ")).otherwise(empty))
    omitted = F.when(F.col("omitted") > 0, F.concat(F.lit("\n- "), F.col("omitted").cast("string"), F.lit(" more memories were left out of the budget."))).otherwise("")
    sensitive = contains_any(F.lower(F.concat_ws(" ", "goal", "query", F.array_join("topics", " "))), [*RISK_CUES, "approval", "quantified"])
    rules = F.concat(F.lit("\n".join(RULES)), F.when(sensitive, "\n" + RISK_RULE).otherwise(""))
    extra = [F.lit("Additional instructions:\n" + instructions.strip())] if instructions.strip() else []
    return packets.select("query_id", F.concat_ws("\n\n", intro, *extra, goal_part, F.concat(part("Memory context", "memory_lines", "No relevant memories."), omitted), part("People context", "people_context", "No context on people."), part("Topic context", "topic_context", "No context on topics."), part("Belief context", "belief_context", "No tracked beliefs."), rules).alias("prompt"))


# -- evaluation


def cue_present(output: Column, cue: Column) -> Column:
    """A cue is in a text as a whole or with all of its words; case and a blank cue don't count."""
    hay, needle = F.lower(output), F.lower(strip(cue))
    return (needle != "") & (F.contains(hay, needle) | F.forall(F.split(collapse(needle), " "), lambda t: F.contains(hay, t)))


def cue_hits(outputs: DataFrame, cues: DataFrame, id: str) -> DataFrame:
    """(id, hits, misses) of outputs (id, case_id, output) held against the cues (case_id, cue) of their
    case. Cues are few a case and texts are long, so the texts stay where they are while cues are small."""
    own = outputs.join(small(cues), "case_id").select(id, cue_present(F.col("output"), F.col("cue")).alias("hit"))
    return own.groupBy(id).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def word_count(text: Column) -> Column:
    """A15"""
    t = collapse(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("bigint")


def precision_coverage(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Per case hits among the results, hits / 5 (0 without results) and hits / expected."""
    hits = gold.join(results, ["case_id", "id"], "left_semi").groupBy("case_id").agg(F.count("*").alias("hits"))
    base = gold.groupBy("case_id").agg(F.count("*").alias("expected"))
    out = base.join(hits, "case_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.select("case_id", "hits", "expected", (F.col("hits") / 5).alias("precision_at_5"), (F.col("hits") / F.col("expected")).alias("coverage"))


def prediction_error(likelihood: Column, success: Column) -> Column:
    """The distance of estimate and outcome; 0 without an estimate."""
    return F.when(likelihood > 0, F.abs(likelihood - success)).otherwise(0.0)


def behaviour_changed(outcome_memory: Column, follow_up_hits: Column) -> Column:
    """The outcome came back as a memory, or the follow-up met a cue."""
    return outcome_memory | (follow_up_hits > 0)


def evaluation_summary(cases: DataFrame) -> DataFrame:
    """Means over completed cases, each with its own denominator."""
    done = cases.filter("not failed")
    gap = prediction_error(F.col("likelihood"), F.col("success"))
    mean = lambda x, where: F.round(F.coalesce(F.avg(F.when(where, x)), F.lit(0.0)), 6)
    changed = F.col("has_outcome") & behaviour_changed(F.col("has_outcome_memory"), F.col("follow_up_hits"))
    return done.agg(F.count("*").alias("completed"), mean(F.col("precision"), F.lit(True)).alias("mean_precision"), mean(F.col("strategy"), F.col("strategy") > 0).alias("mean_strategy"), mean(F.col("success"), F.col("has_outcome")).alias("mean_success"), mean(gap, gap > 0).alias("mean_prediction_error"), F.count_if(changed).alias("behaviour_changed"), F.count_if("has_outcome").alias("evaluated"))


def win_tally(judgements: DataFrame, dimensions: list[str]) -> DataFrame:
    """Per dimension wins of either side; unknown and blank are ties."""
    stack = ", ".join(f"'{x}', `{x}`" for x in dimensions)
    long = judgements.select(F.expr(f"stack({len(dimensions)}, {stack}) as (dimension, raw)")).withColumn("w", winner(F.col("raw")))
    return long.groupBy("dimension").agg(*(F.count_if(F.col("w") == k).alias(k) for k in ("augmented", "baseline", "tie")))


# -- operations

HTTP_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]
LLM_BOUNDS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]


def http_metrics(requests: DataFrame, bounds: list[float] = HTTP_BOUNDS) -> DataFrame:
    """Count, seconds, bytes and cumulative buckets by method, route and status."""
    keyed = requests.withColumns({"method": F.upper(strip(F.col("method"))), "route": path_label(F.col("path"))})
    buckets = F.array(*(F.count_if(F.col("seconds") <= b) for b in bounds))
    return keyed.groupBy("method", "route", "status").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 4).alias("seconds"), F.sum("bytes").alias("bytes"), buckets.alias("buckets"))


def llm_metrics(calls: DataFrame, bounds: list[float] = LLM_BOUNDS) -> DataFrame:
    """By operation, model ("unknown" if blank) and outcome; negative token counts are 0."""
    model = F.coalesce(F.nullif(strip(F.col("model")), F.lit("")), F.lit("unknown"))
    buckets = F.array(*(F.count_if(F.col("seconds") <= b) for b in bounds))
    return calls.groupBy("operation", model.alias("model"), "outcome").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 4).alias("seconds"), F.sum(F.greatest("tokens", F.lit(0))).alias("tokens"), buckets.alias("buckets"))


def in_flight(events: DataFrame) -> DataFrame:
    """The running sum of starts (+1) and ends (-1) of each client."""
    w = Window.partitionBy("client").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("in_flight", F.sum("step").over(w))


def limiter_key(subject: Column, ip: Column) -> Column:
    """T03"""
    named = lambda tag, x: F.when(strip(x) != "", F.concat(F.lit(tag), strip(x)))
    return F.coalesce(named("subject:", subject), named("ip:", ip), F.lit("unknown"))
