"""Every query of the engine against its SQL."""

from __future__ import annotations

import pytest
from conftest import assert_same_as_sql

from tessera.operators import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, data, name):
    assert_same_as_sql(spark, data, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_prompts(spark, data):
    """F33 by a plain version, for every memory."""
    from tessera.operators import context
    from tessera.sources.views import memory_items

    rows = {r["query_id"]: r["prompt"] for r in catalogue.QUERIES["f33_prompt_rendering"](spark, data).collect()}
    for m in memory_items(spark, data).collect():
        goal, text = " ".join(m["topics"]), m["summary"].strip(" \t\n\r\f\v")
        seen = " ".join([goal, m["summary"], " ".join(m["topics"])]).lower()
        rules = context.RULES + ([context.RISK_RULE] if any(c in seen for c in [*context.RISK_CUES, "approval", "quantified"]) else [])
        memory = "Memory context:\n- " + m["summary"] + (f"\n- {m['id'] % 3} more memories were left out of the budget." if m["id"] % 3 else "")
        goal_part = f"Interaction goal:\n- Goal: {goal}\n- Query: {text}" if text else f"Interaction goal:\n- {goal}"
        want = [context.MODE_TEXT["normal_answer"], goal_part, memory, "People context:\n- No context on people.", "Topic context:\n- " + "\n- ".join(m["topics"]), "Belief context:\n- No tracked beliefs.", "\n".join(rules)]
        assert rows[m["id"]] == "\n\n".join(want)


def test_plans_and_their_layouts(spark, data):
    """A09, A10, F32 by a plain version, for a plan of every document."""
    from tessera.operators import context
    from tessera.operators.queries_context import plans
    from tessera.sources.tables import table

    blank = " \t\n\r\f\v"
    docs = {r["doc_id"]: r for r in table(spark, data, "documents").collect()}
    held = {r["doc_id"]: r["plan"] for r in plans(spark, data).collect()}
    bodies = {r["doc_id"]: r["body"] for r in catalogue.QUERIES["f32_plan_rendering"](spark, data).collect()}

    def unique(xs):
        seen = {}
        for v in xs:
            if v.strip(blank):
                seen.setdefault(v.strip(blank).lower(), v.strip(blank))
        return list(seen.values())

    for x, r in docs.items():
        own = []
        for i in range(x % 7):
            label, draft = "" if (x * 3 + i) % 5 == 0 else r["lang"].upper() + str(i), "" if (x + i * 2) % 3 == 0 else r["text"].strip(blank)
            if label or draft:
                score = min(max((x * 37 + i * 17) % 14 / 10 - 0.1, 0), 1)
                own.append({"id": f"strategy_{i + 1}" if (x + i) % 4 == 0 else f"s{i}", "label": label or f"Strategy {i + 1}", "draft": draft, "reply": f"reply {x}/{i}", "benefits": unique([r["source"], r["source"].upper(), r["lang"], " "][: (x + i) % 5]), "risks": unique([r["lang"], "slow"][: (x + i) % 3]), "p": score, "fallback": context.DEFAULT_FALLBACK if (x + i) % 2 == 0 else "wait a week"})
        own = own[:4]
        if not own:
            assert held[x] is None and bodies[x] is None
            continue
        by_id = {s["id"]: s for s in reversed(own)}
        chosen = f"s{x % 9}"
        if chosen not in by_id:
            top = [round(s["p"] + (len(s["benefits"]) - len(s["risks"])) * 0.01, 9) for s in own]
            chosen = own[top.index(max(top))]["id"]
        best, others = by_id[chosen], [s for s in own if s["id"] != chosen]
        why = r["source"] if x % 2 else f"Recommend {best['label']}: it balances fit to the goal, expected response and risk best."
        plan = held[x]
        assert ([s["id"] for s in plan["strategies"]], plan["recommended"], plan["rationale"]) == ([s["id"] for s in own], chosen, why)
        shown = x % 2 == 0
        odds = lambda s: f"{s['label']} (likelihood {s['p'] * 100:.0f}%)" if shown else s["label"]
        short = lambda s: (s["draft"] if len(s["draft"]) <= 120 else s["draft"][:117] + "...") or "No message draft available."
        part = lambda head, rows: [*head, *("- " + y for y in rows)] if rows else []
        if x % 3 == 1:
            lines = ["Executive summary:", best["draft"], "", "Why this framing:", why, *part(["", "What to emphasize:"], best["benefits"]), *part(["", "Watchouts:"], best["risks"]), "", f"Next step: {best['fallback']}", *part(["", "Alternative framings:"], [f"{s['label']}: {short(s)}" for s in others])]
            want = "\n".join(lines)
        elif x % 3 == 2:
            head = "Recommended approach: " + odds(best)
            lines = [head, f"Why: {why}", "Draft message:", best["draft"], f"Predicted response: {best['reply']}", *part(["Benefits:"], best["benefits"]), *part(["Risks:"], best["risks"]), f"Fallback: {best['fallback']}", *part(["Other viable options:"], [f"{odds(s)}: {short(s)}" for s in others])]
            want = "\n".join(lines)
        else:
            lines = ["Recommended strategy: " + odds(best), f"Recommendation rationale: {why}"]
            for i, s in enumerate(own):
                lines += [f"Strategy {i + 1} - {s['label']}", *([f"Likelihood of success: {s['p'] * 100:.0f}%"] if shown else []), "Message draft:", s["draft"], f"Predicted response: {s['reply']}", "Benefits: " + ("; ".join(s["benefits"]) or "none"), "Risks: " + ("; ".join(s["risks"]) or "none"), f"Fallback: {s['fallback']}"]
            want = "\n\n".join(lines)
        assert bodies[x] == want
