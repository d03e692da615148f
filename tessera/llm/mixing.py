"""Operator 1: mixing sources to target weights by hash-threshold histograms.

Every document has a uniform 60-bit hash of its id. Tokens are summed by source and hash bucket; along
the buckets of a source the running sum crosses each budget inside one bucket, and only the documents
of that boundary bucket are looked at again, by finer buckets, until a bucket is one hash value. What
remains is a threshold for each source and budget, and a filter: nothing is sorted, and as budgets
share the order of the hashes, a smaller budget's documents are among a larger one's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.columns import numbered, position
from tessera.plans.scratch import Scratch, small
from tessera.sources.tables import table

#: Bits of the hash that each round of buckets looks at.
ROUNDS = (12, 12, 36)
BITS = sum(ROUNDS)
#: Target weights of the documents' sources; the hot one is to have four times another's tokens.
WEIGHTS = {"src0": 4}
#: Nested budgets, as shares of the tokens of the corpus.
BUDGETS = ("1/4", "1/2", "3/4")


def hashed(id: Column) -> Column:
    """60 uniform bits of an id; null ids all have the hash of the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def words_of(text: Column) -> Column:
    """Token estimate: words between blanks; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("bigint")


def _budgets(totals: DataFrame, weights: Mapping[str, int], default: int, budgets: Sequence[Fraction]) -> DataFrame:
    """(source, level, budget): integer shares of the corpus's tokens, in proportion to the weights of
    the sources that have documents."""
    weight = F.lit(default)
    for k, w in weights.items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(int(w))).otherwise(weight)
    own = totals.select("source", "tokens", weight.cast("bigint").alias("weight"))
    every = Window.partitionBy()
    own = own.withColumns({"total": F.sum("tokens").over(every), "weights": F.sum("weight").over(every)})
    levels = F.array(*(F.struct(F.lit(i).alias("level"), F.lit(b.numerator).cast("bigint").alias("num"), F.lit(b.denominator).cast("bigint").alias("den")) for i, b in enumerate(budgets)))
    share = F.expr("case when weights > 0 then ((total * b.num) div (b.den * weights)) * weight else 0 end")
    return own.select("source", "total", "weights", "weight", F.explode(levels).alias("b")).select("source", F.col("b.level").alias("level"), share.cast("bigint").alias("budget"))


def thresholds(docs: DataFrame, tokens: Column | None = None, id: str = "doc_id", source: str = "source", text: str = "text", weights: Mapping[str, int] = WEIGHTS, default_weight: int = 1, budgets: Sequence[str] = BUDGETS) -> DataFrame:
    """(source, level, threshold): documents with a hash below the threshold are within the budget.

    A budget is floor(corpus tokens * share / sum of weights) * weight of the source: weights bound what a
    source gets. A source with fewer tokens than its budget is taken whole, and what it leaves isn't given
    to others, so that a mix never has more of a source than its weight allows. The threshold is the largest for which the tokens below it don't exceed the budget, 2^60 where all fit. Documents of
    one hash (repeated rows, null ids) come in or stay out together. One row a source and level, read
    from a written table."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    flat = numbered(docs)
    text_at = F.col(f"_c{position(docs, text)}") if tokens is None else None
    amount = words_of(text_at) if tokens is None else tokens
    own = flat.select(F.col(f"_c{position(docs, source)}").alias("source"), hashed(F.col(f"_c{position(docs, id)}")).alias("h"), F.coalesce(amount, F.lit(0)).cast("bigint").alias("tokens"))
    own = scratch.write(own, "hashed")  # the texts are split once, not in each round
    left = BITS - ROUNDS[0]
    first = scratch.write(own.groupBy("source", F.shiftright("h", left).alias("bucket")).agg(F.sum("tokens").alias("tokens")), "round0")
    goal = scratch.write(_budgets(first.groupBy("source").agg(F.sum("tokens").alias("tokens")), weights, default_weight, [Fraction(b) for b in budgets]), "budgets")
    # (source, level, rest of the budget, prefix of the hash found so far)
    state = goal.select("source", "level", F.col("budget").alias("rest"), F.lit(0).cast("bigint").alias("prefix"))
    counts, done = first.withColumn("prefix", F.lit(0).cast("bigint")), None
    for i, bits in enumerate(ROUNDS):
        w = Window.partitionBy("source", "prefix").orderBy("bucket")
        run = counts.withColumn("upto", F.sum("tokens").over(w))
        run = run.select(F.col("source").alias("s"), F.col("prefix").alias("p"), "bucket", "upto", (F.col("upto") - F.col("tokens")).alias("before"))
        joined = state.join(run, state["source"].eqNullSafe(run["s"]) & (state["prefix"] == run["p"]) & (run["upto"] > state["rest"]), "left")
        crossed = joined.groupBy("source", "level", "rest", "prefix").agg(F.min(F.struct("bucket", "before")).alias("at"))
        crossed = scratch.write(crossed, f"crossed{i}")
        left = BITS - sum(ROUNDS[: i + 1])
        # no bucket crosses the budget: all of the prefix's documents are in
        whole = crossed.filter(F.col("at.bucket").isNull()).select("source", "level", F.expr(f"shiftleft(prefix + 1, {BITS - sum(ROUNDS[:i])})").alias("threshold"))
        state = crossed.filter(F.col("at.bucket").isNotNull()).select("source", "level", (F.col("rest") - F.col("at.before")).alias("rest"), F.expr(f"shiftleft(prefix, {bits}) + at.bucket").alias("prefix"))
        done = whole if done is None else done.unionByName(whole)
        if i + 1 < len(ROUNDS):
            edge = small(scratch.write(state.select(F.col("source").alias("s"), F.col("prefix").alias("p")).distinct(), f"edge{i}"))
            near = own.withColumn("prefix", F.shiftright("h", left)).join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("prefix") == F.col("p")), "left_semi")
            bucket = F.expr(f"shiftright(h, {left - ROUNDS[i + 1]}) & {(1 << ROUNDS[i + 1]) - 1}L")
            counts = scratch.write(near.groupBy("source", "prefix", bucket.alias("bucket")).agg(F.sum("tokens").alias("tokens")), f"round{i + 1}")
    done = done.unionByName(state.select("source", "level", F.col("prefix").alias("threshold")))
    done = scratch.write(done, "thresholds")
    scratch.drop("hashed", "budgets", *(f"{k}{i}" for i in range(len(ROUNDS)) for k in ("round", "crossed")), *(f"edge{i}" for i in range(len(ROUNDS) - 1)))
    return done


def mix(docs: DataFrame, tokens: Column | None = None, id: str = "doc_id", source: str = "source", text: str = "text", **kw) -> DataFrame:
    """The columns of ``docs`` as ``_c0, ...`` and ``_level``, the smallest budget (0, 1, ...) that the
    document is within; documents within none are left out.

    Null ids share one hash; a null source is a source of its own with the default weight; empty and
    null texts cost nothing and are in if their hash is below the threshold; repeated rows come in
    together; extra columns pass through; an empty table gives an empty one. ``tokens`` may give the
    cost of a document as a column over ``_c0, ...``."""
    found = thresholds(docs, tokens, id, source, text, **kw)
    by_source = found.groupBy(F.col("source").alias("_source")).agg(F.array_sort(F.collect_list(F.struct("level", "threshold"))).alias("_levels"))
    flat, here = numbered(docs), F.col(f"_c{position(docs, source)}")
    flat = flat.withColumn("_hash", hashed(F.col(f"_c{position(docs, id)}")))
    joined = flat.join(small(Scratch(docs.sparkSession, "levels").write(by_source, "levels")), here.eqNullSafe(F.col("_source")))
    within = F.filter("_levels", lambda x: F.col("_hash") < x["threshold"])
    return joined.withColumn("_level", F.array_min(F.transform(within, lambda x: x["level"]))).filter(F.col("_level").isNotNull()).drop("_hash", "_source", "_levels")


def take(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` within the largest budget, with the same columns (see ``mix``)."""
    return mix(docs, **kw).drop("_level").toDF(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix with the smallest budget that each is within."""
    docs = table(spark, sf_dir, "documents")
    c = {k: F.col(f"_c{position(docs, k)}") for k in ("doc_id", "source", "text")}
    return mix(docs).select(c["doc_id"].alias("doc_id"), c["source"].alias("source"), words_of(c["text"]).alias("tokens"), F.col("_level").cast("bigint").alias("level"))


def sql(docs: str, weights: Mapping[str, int] = WEIGHTS, budgets: Sequence[str] = BUDGETS) -> str:
    """DuckDB SQL: doc_id, source, tokens and level of the documents of the mix."""
    cases = " ".join(f"when source = '{k}' then {w}" for k, w in weights.items())
    levels = ", ".join(f"({i}, {Fraction(b).numerator}, {Fraction(b).denominator})" for i, b in enumerate(budgets))
    return f"""
        with d as (select doc_id, source, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h,
            len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) as tokens from {docs}),
        s as (select source, sum(tokens)::bigint as t, (case {cases} else 1 end)::bigint as w from d group by source),
        b as (select source, level, ((((select sum(t) from s)::bigint * num) // (den * (select sum(w) from s)::bigint)) * w)::bigint as budget
            from s cross join (values {levels}) v(level, num, den)),
        r as (select *, sum(tokens) over (partition by source order by h range between unbounded preceding and current row) as upto from d)
        select r.doc_id, r.source, r.tokens::bigint as tokens, min(b.level)::bigint as level
        from (select *, row_number() over () as k from r) r join b on r.source is not distinct from b.source and r.upto <= b.budget
        group by r.k, r.doc_id, r.source, r.tokens"""


SQL = sql("documents")
