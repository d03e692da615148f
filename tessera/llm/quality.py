"""Operator 7: quality rules with adaptive thresholds.

Each measure of a document is held against fences Q3 + high * (Q3 - Q1) and Q1 - low * (Q3 - Q1), whose
quartiles come from mergeable KLL quantile sketches of the documents of its language and source; no fence
has a fixed part. Sketches of groups under ``min_docs`` documents say too little: such a group takes the
fences of its language, whose sketch is merged from those of its groups, and a language under
``min_docs`` those of the whole corpus. Where the quartiles of a group are equal, the next larger one
gives the spread. One pass makes the sketches (all that is shuffled), a second one filters by a join with
the fences.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.columns import numbered, pick, position
from tessera.plans.scratch import Scratch, small
from tessera.sources.tables import table

#: The signs of ASCII and Latin-1, one by one: of such a class the regex engine makes a table.
SIGNS = r"[!\"#$%&\x27()*+,\-./:;<=>?@\[\\\]^_`{|}~¡¦§¨©«¬®¯°±´¶·¸»¿×÷]"
BLANKS = r"[^ \t\n\r]+"
#: Values that a sketch holds one by one before it starts to thin them. A quantile is then off by a rank of
#: 2.296 / k^0.9021 at most, which is 0.45 % (of 100 sketches, 99 keep it).
SKETCH_K = 1024
#: Words of a window in which words are held against each other, and of a passage sought in longer texts (a
#: power of 2).
WINDOW = 1000
PASSAGE = 8
#: Signs and capitals of a text that don't count, and characters and words added to one, so that a name, a
#: number or an address in a text of a few words says little.
FREE_SIGNS, FREE_CAPITALS, MORE_CHARS, MORE_WORDS = 5, 2, 24, 4
MIN_DOCS = 50


@dataclass(frozen=True)
class Rule:
    """A measure and how many spreads above the upper and below the lower quartile it may lie."""

    name: str
    high: float | None = None
    low: float | None = None


RULES = (Rule("sign_ratio", 6.0), Rule("upper_ratio", 6.0), Rule("repeat_ratio", 3.0), Rule("word_length", 8.0, 5.0))


def _repeats(words: Column, n: Column) -> Column:
    """Share of repeated words, free of the length of the text. Each window of WINDOW words counts those
    that it has before, all windows together cover the text. What repeats over longer distances is the
    share of passages of PASSAGE words that occurred before anywhere in the text; the larger one counts."""

    def bind(x: Column, f: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(x), f)[0]  # so that x is made once, not for each of its uses

    def joined(h: Column, k: int) -> Column:
        n = F.size(h) - k
        return F.zip_with(F.slice(h, 1, n), F.slice(h, 1 + k, n), lambda x, y: F.xxhash64(x, y))

    def long(h: Column) -> Column:
        near, far = F.transform(h, lambda x, i: F.xxhash64(x, F.floor(i / WINDOW))), h
        for k in (1 << i for i in range(PASSAGE.bit_length() - 1)):
            far = bind(far, partial(lambda k, x: joined(x, k), k))
        share = lambda x: 1 - F.size(F.array_distinct(x)) / F.size(x)
        return F.greatest(share(near), bind(far, share))

    longer = bind(F.transform(words, lambda x: F.xxhash64(x)), long)
    return F.when(n <= WINDOW, 1 - F.size(F.array_distinct(words)) / n).otherwise(longer)


def measures(text: Column) -> dict[str, Column]:
    """Per document: shares of signs and of capitals among the
    characters, the share of words that occurred before in their window (see ``_repeats``), and characters
    a word. All are null for a null text or one of blanks only."""
    words = F.regexp_extract_all(text, F.lit(BLANKS), F.lit(0))
    n, chars = F.size(words), F.length(text)
    some = n > 0
    return {
        "sign_ratio": F.when(some, F.greatest(F.regexp_count(text, F.lit(SIGNS)) - FREE_SIGNS, F.lit(0)) / chars),
        "upper_ratio": F.when(some, F.greatest(F.regexp_count(text, F.lit("[A-Z]")) - FREE_CAPITALS, F.lit(0)) / chars),
        "repeat_ratio": F.when(some, _repeats(words, n)),
        "word_length": F.when(some, (chars + MORE_CHARS) / (n + MORE_WORDS)),
    }


def _names(rules: tuple[Rule, ...]) -> list[str]:
    return [f"{r.name}_{k}" for r in rules for k, reach in (("min", r.low), ("max", r.high)) if reach is not None]


def fences(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", rules: tuple[Rule, ...] = RULES, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, n_docs, level, <rule>_min, <rule>_max...) for each language and source of ``docs``;
    null is a language or source like any other. A fence is null only where no document has a measure."""
    flat, at = numbered(docs), {k: position(docs, k) for k in (lang, source, text)}
    return _fences(flat.select(F.col(f"_c{at[lang]}").alias("lang"), F.col(f"_c{at[source]}").alias("source"), *(c.alias(k) for k, c in measures(F.col(f"_c{at[text]}")).items())), rules, min_docs)


def _fences(own: DataFrame, rules: tuple[Rule, ...], min_docs: int) -> DataFrame:
    """The same from (lang, source, measures) of the documents."""
    sketches = own.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(r.name, F.lit(SKETCH_K)).alias(r.name) for r in rules))
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(r.name, F.lit(SKETCH_K)).alias(r.name) for r in rules)]

    def quartiles(df: DataFrame, level: str) -> DataFrame:
        def both(r: Rule) -> Column:
            known = F.kll_sketch_get_n_double(r.name) > 0
            return F.struct(*(F.when(known, F.kll_sketch_get_quantile_double(F.when(known, F.col(r.name)), F.lit(q))).alias(k) for k, q in (("q1", 0.25), ("q3", 0.75))))

        return df.select("*", F.struct("n", *(both(r).alias(r.name) for r in rules)).alias(level)).drop("n", *(r.name for r in rules))

    group = quartiles(sketches, "g").withColumn("key", F.struct("lang"))
    language = quartiles(sketches.groupBy("lang").agg(*merged), "l").select(F.struct("lang").alias("key"), "l")
    corpus = quartiles(sketches.agg(*merged), "c")
    all_ = group.join(language, group["key"].eqNullSafe(language["key"])).crossJoin(corpus)
    level = F.when(F.col("g.n") >= min_docs, "source").when(F.col("l.n") >= min_docs, "language").otherwise("corpus")
    found = []
    for r in rules:
        q1, q3 = (F.when(level == "source", F.col(f"g.{r.name}.{q}")).when(level == "language", F.col(f"l.{r.name}.{q}")).otherwise(F.col(f"c.{r.name}.{q}")) for q in ("q1", "q3"))
        wide = [F.nullif(F.col(f"{k}.{r.name}.q3") - F.col(f"{k}.{r.name}.q1"), F.lit(0.0)) for k in "glc"]
        spread = F.when(level == "source", F.coalesce(*wide, F.lit(0.0))).when(level == "language", F.coalesce(*wide[1:], F.lit(0.0))).otherwise(F.coalesce(wide[2], F.lit(0.0)))
        found += [(q1 - F.lit(r.low) * spread).alias(f"{r.name}_min")] if r.low is not None else []
        found += [(q3 + F.lit(r.high) * spread).alias(f"{r.name}_max")] if r.high is not None else []
    return all_.select("lang", "source", F.col("g.n").alias("n_docs"), level.alias("level"), *found)


def judge(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", rules: tuple[Rule, ...] = RULES, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` as ``_c0, _c1, ...``, the measures ``_m0, ...`` in the order of
    ``measures`` and ``_keep``. The fences (one row a language and source) are written once and joined by
    broadcast if they are small, by shuffle beyond."""
    spark, flat = docs.sparkSession, numbered(docs)
    limit = Scratch(spark, "quality").write(fences(docs, lang, source, text, rules, min_docs), "fences")
    found = measures(F.col(f"_c{position(docs, text)}"))
    flat = flat.select("*", *(c.alias(f"_m{i}") for i, c in enumerate(found.values())))
    return _judged(flat, limit, f"_c{position(docs, lang)}", f"_c{position(docs, source)}", {k: f"_m{i}" for i, k in enumerate(found)}, rules)


def _judged(rows: DataFrame, fences: DataFrame, lang: str, source: str, names: dict[str, str], rules: tuple[Rule, ...]) -> DataFrame:
    """``rows`` with ``_keep``, by the fences (a written table) of their language and source."""
    limit = small(fences).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *_names(rules))
    same = F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source"))
    keep = F.lit(True)
    for r in rules:
        keep = keep & F.coalesce(F.col(names[r.name]) <= F.col(f"{r.name}_max"), F.lit(False)) if r.high is not None else keep
        keep = keep & F.coalesce(F.col(names[r.name]) >= F.col(f"{r.name}_min"), F.lit(False)) if r.low is not None else keep
    return rows.join(limit, same).withColumn("_keep", keep).drop("_lang", "_source", *_names(rules))


def scores(docs: DataFrame, id: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text", rules: tuple[Rule, ...] = RULES, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, lang, source, measures, keep) of every row of ``docs``. As the texts aren't wanted, the measures
    are written and the texts read once; rows share the fate that ``keep_good`` gives them."""
    own, scratch = pick(docs, id=id, lang=lang, source=source, text=text), Scratch(docs.sparkSession, "quality")
    rows = scratch.write(own.select("id", "lang", "source", *(c.alias(k) for k, c in measures(F.col("text")).items())), "measures")
    limit = scratch.write(_fences(rows.drop("id"), rules, min_docs), "fences")
    out = _judged(rows, limit, "lang", "source", {r.name: r.name for r in rules}, rules)
    return out.select(F.col("id").alias(id), "lang", "source", *(r.name for r in rules), F.col("_keep").alias("keep"))


def keep_good(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` within all fences of their language and source, with the same columns.

    Null, empty and blank texts have no measures and are dropped; a value on a fence is within; texts of
    any length are measured whole; repeated rows share their fate; a null language or source is a group of its own; extra
    columns pass through, whatever their names; an empty table stays empty."""
    n = len(docs.columns)
    return judge(docs, **kw).filter("_keep").select(*(f"_c{i}" for i in range(n))).toDF(*docs.columns)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents within all fences, with their measures."""
    kept = scores(table(spark, sf_dir, "documents")).filter("keep")
    return kept.select("doc_id", "lang", "source", *(F.round(r.name, 6).alias(r.name) for r in RULES))


def _sql(docs: str, min_docs: int = MIN_DOCS) -> str:
    """DuckDB SQL: rows of ``docs`` with measures and keep. Quantiles are exact, as the sketches are up
    to SKETCH_K values a group."""
    letters = SIGNS.replace("[", "[^", 1)
    near = f"1 - len(list_distinct(list_transform(w, lambda x, i: ((i - 1) // {WINDOW}) || ' ' || x))) / len(w)"
    far = f"1 - len(list_distinct(list_transform(range(1, len(w) - {PASSAGE - 2}), lambda i: array_to_string(w[i : i + {PASSAGE - 1}], ' ')))) / (len(w) - {PASSAGE - 1})"
    ratios = f"""
        case when len(w) > 0 then greatest(length(regexp_replace(text, '{letters}', '', 'g')) - {FREE_SIGNS}, 0) / length(text) end as sign_ratio,
        case when len(w) > 0 then greatest(length(regexp_replace(text, '[^A-Z]', '', 'g')) - {FREE_CAPITALS}, 0) / length(text) end as upper_ratio,
        case when len(w) > {WINDOW} then greatest({near}, {far}) when len(w) > 0 then 1 - len(list_distinct(w)) / len(w) end as repeat_ratio,
        case when len(w) > 0 then (length(text) + {MORE_CHARS}) / (len(w) + {MORE_WORDS}) end as word_length"""
    quartiles = ", ".join(f"quantile_disc({r.name}, 0.25) as {r.name}_q1, quantile_disc({r.name}, 0.75) as {r.name}_q3" for r in RULES)
    wide = lambda r, levels: ", ".join(f"nullif({k}.{r.name}_q3 - {k}.{r.name}_q1, 0)" for k in levels)
    at = lambda x: f"case when g.n >= {min_docs} then {x('glc')} when l.n >= {min_docs} then {x('lc')} else {x('c')} end"
    upper = lambda r: at(lambda k: f"{k[0]}.{r.name}_q3 + {r.high} * coalesce({wide(r, k)}, 0)")
    lower = lambda r: at(lambda k: f"{k[0]}.{r.name}_q1 - {r.low} * coalesce({wide(r, k)}, 0)")
    limits = ", ".join([f"{upper(r)} as {r.name}_max" for r in RULES if r.high is not None] + [f"{lower(r)} as {r.name}_min" for r in RULES if r.low is not None])
    keep = " and ".join([f"coalesce(m.{r.name} <= {r.name}_max, false)" for r in RULES if r.high is not None] + [f"coalesce(m.{r.name} >= {r.name}_min, false)" for r in RULES if r.low is not None])
    return f"""
        with m as (select *, {ratios} from (select *, regexp_extract_all(coalesce(text, ''), '{BLANKS}') as w from {docs})),
        g as (select lang, source, count(*) as n, {quartiles} from m group by all),
        l as (select lang, count(*) as n, {quartiles} from m group by all),
        c as (select {quartiles} from m),
        t as (select g.lang, g.source, {limits} from g join l on g.lang is not distinct from l.lang cross join c)
        select m.* exclude (w), {keep} as keep from m
        join t on m.lang is not distinct from t.lang and m.source is not distinct from t.source"""


SQL = f"""select doc_id, lang, source, {", ".join(f"round({r.name}, 6) as {r.name}" for r in RULES)} from ({_sql("documents")}) where keep"""
