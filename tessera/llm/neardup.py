"""Operator 10: near duplicates by bottom-k sketches of one hash function.

1. The distinct word 3-grams of a document are hashed once; the k smallest hashes are its sketch.
   Documents of one and the same set (exact copies, other case or punctuation) become one node.
2. Inverted lists of retained values find candidates. Two sketches that agree in the values that the
   estimate asks for must share one among the rarest ``size - required + 1`` of each, so only those
   are listed: passages that thousands of documents share are rare in few, and their lists stay
   short without any being cut.
3. In each list all nodes are held against its smallest one. Candidates pass the estimate from the
   sketch of the union (its k smallest values, how many are in both) and then the exact Jaccard
   similarity of the whole sets. What is found to be in one group needs no further pairs.
4. Pairs of a list between different groups follow in the same way, where a list is short. Long lists,
   of documents that have a passage in common but aren't duplicates of the smallest, are listed anew by
   the values of their whole sets: similar sets share ``threshold`` of the values of either, so one among
   the rarest ``1 - threshold`` of each, and the passage isn't there unless it makes up as much of a
   document. Values within one group alone need no list.
5. Groups are the connected components of the verified pairs.

So a group of thousands costs thousands of pairs, not their square, so do thousands of documents that
share less than ``threshold`` of their text, and the groups are those that all candidate pairs would
give. What remains quadratic is documents that share more than that share of their shingles without
being similar (from a half to two thirds of documents of equal length).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chunks import by_batches, mix, over_texts
from tessera.llm.words import WORDS_SQL, ngram_hashes, word_hashes
from tessera.plans.columns import numbered, pick, position
from tessera.plans.graph import components
from tessera.plans.scratch import Scratch, small
from tessera.sources.tables import table

#: Words of a shingle; documents of fewer words are one shingle.
SHINGLE = 3
K = 64
#: Jaccard similarity of near duplicates.
THRESHOLD = 0.5
#: Standard errors below the threshold at which the estimate still lets a pair be verified.
MARGIN = 3.2
#: Nodes of a list whose pairs are all looked at; longer lists are listed anew by whole sets.
SHORT = 32


def shingle_sets(texts: list[str], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (63 bits) of each text; none for a text without words."""
    words, counts = word_hashes(texts)
    grams = (ngram_hashes(words, n) >> np.uint64(1)).astype(np.int64)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(grams[at : at + c - n + 1]))
        elif c:
            out.append((ngram_hashes(words[at : at + c], c) >> np.uint64(1)).astype(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        at += c
    return out


def _sums(x: np.ndarray) -> tuple[int, int]:
    u = x.astype(np.uint64)
    return int(mix(u + np.uint64(1)).sum().astype(np.int64)), int(mix(u ^ np.uint64(0xA0761D6478BD642F)).sum().astype(np.int64))


def sketches(own: DataFrame, k: int = K) -> DataFrame:
    """(id, n, h1, h2, sketch): size and 128-bit hash of the shingle set, its k smallest hashes."""
    kind = own.schema["id"].dataType.simpleString()

    def kernel(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        sets = shingle_sets(texts)
        sums = [_sums(x) for x in sets]
        low = [x[:k] for x in sets]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *low])))
        return pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in sets], pa.int64()), pa.array([a for a, _ in sums], pa.int64()), pa.array([b for _, b in sums], pa.int64()), lists], names=["id", "n", "h1", "h2", "sketch"])

    return by_batches(own, over_texts(kernel), f"id {kind}, n bigint, h1 bigint, h2 bigint, sketch array<bigint>")


def _whole_sets(own: DataFrame) -> DataFrame:
    kind = own.schema["id"].dataType.simpleString()

    def kernel(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in shingle_sets(texts)], pa.binary())], names=["id", "set"])

    return by_batches(own, over_texts(kernel), f"id {kind}, set binary")


def _shingles(own: DataFrame) -> DataFrame:
    """(id, values): the whole shingle sets."""
    kind = own.schema["id"].dataType.simpleString()

    def kernel(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        sets = shingle_sets(texts)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))], names=["id", "values"])

    return by_batches(own, over_texts(kernel), f"id {kind}, values array<bigint>")


def _pairs(left: DataFrame, close: Column) -> DataFrame:
    """Distinct pairs (a, b) of the nodes of each list (v, node, n, root) that are in different groups."""
    right = left.select("v", F.col("node").alias("b"), F.col("n").alias("o"), F.col("root").alias("other"))
    pairs = left.join(right, "v").filter((F.col("node") < F.col("b")) & (F.col("root") != F.col("other"))).filter(close)
    return pairs.select(F.col("node").alias("a"), "b").distinct()


def _exact(pairs: DataFrame, kind: str, threshold: float) -> DataFrame:
    """The pairs (a, b, x, y) whose sets x and y are similar enough."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return by_batches(pairs, run, f"a {kind}, b {kind}")


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, k: int = K, margin: float = MARGIN) -> DataFrame:
    """(id, group_id) of every document that has a near duplicate; group_id is the smallest id.

    Rows with a null id or without words (null, empty, signs only) have none. Rows that repeat an id
    are one document with the shingle sets of all of them: it is in the group of each. Whole texts of any length count; other
    columns are not looked at; an empty table gives an empty one."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    own = pick(docs, id=id, text=text).filter(F.col("id").isNotNull())
    kind = own.schema["id"].dataType.simpleString()
    sketch = scratch.write(sketches(own, k).filter("n > 0"), "sketches")
    nodes = scratch.write(sketch.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.max("id").alias("last"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")

    # rarest values first: those of one document count as the head of its prefix but need no list
    values = nodes.select("node", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    low = threshold - margin * math.sqrt(threshold * (1 - threshold) / k)
    required = F.ceil(F.lit(low) * F.col("m"))
    held = values.join(shared, "v").groupBy("node", "n", "m").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("held"))
    listed = F.slice("held", F.lit(1), F.greatest(F.lit(0), F.size("held") - required + 1))
    lists = scratch.write(held.select("node", "n", F.explode(listed).alias("x")).select("node", "n", F.col("x.v").alias("v")), "lists")

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) that pass the estimate and the exact check, written."""
        side = nodes.select("node", "n", "sketch")
        both = pairs.join(side.select(F.col("node").alias("a"), F.col("sketch").alias("s"), F.col("n").alias("ns")), "a").join(side.select(F.col("node").alias("b"), F.col("sketch").alias("t"), F.col("n").alias("nt")), "b")
        union = F.slice(F.array_sort(F.array_union("s", "t")), 1, k)
        common = F.array_intersect("s", "t")
        few = (F.col("ns") <= k) & (F.col("nt") <= k)
        # sketches of small sets are the sets themselves
        whole = F.size(common) / F.size(F.array_union("s", "t"))
        estimate = F.when(few, whole).otherwise(F.size(F.array_intersect(union, common)) / F.size(union))
        likely = both.select("a", "b", few.alias("small"), estimate.alias("e")).filter(F.col("e") >= F.when(F.col("small"), threshold).otherwise(low))
        likely = scratch.write(likely.select("a", "b", "small").distinct(), f"{name}-likely")
        open_ = likely.filter("not small")
        wanted = scratch.write(open_.select(F.col("a").alias("id")).union(open_.select("b")).distinct(), f"{name}-wanted")
        sets = scratch.write(_whole_sets(own.join(small(wanted), "id", "left_semi")), f"{name}-sets")
        loaded = open_.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
        found = scratch.write(_exact(loaded, kind, threshold).unionByName(likely.filter("small").select("a", "b")).distinct(), name)
        scratch.drop(f"{name}-wanted", f"{name}-sets")
        return found

    close = (F.least("n", "o") >= F.lit(threshold) * F.greatest("n", "o"))
    heads = lists.groupBy("v").agg(F.min(F.struct("node", "n")).alias("h"), F.count("*").alias("c")).filter("c > 1").select("v", F.col("h.node").alias("a"), F.col("h.n").alias("o"))
    stars = lists.join(heads, "v").filter(F.col("node") != F.col("a")).filter(close).select("a", F.col("node").alias("b")).distinct()
    stars = scratch.write(stars, "stars")
    first = similar(stars, "first")
    root = components(first, scratch, "r")
    placed = scratch.write(lists.join(root, "node", "left").select("v", "node", "n", F.coalesce("root", "node").alias("root")), "placed")
    mixed = placed.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).filter("lo <> hi").select("v", "c")
    mixed = scratch.write(mixed, "mixed")
    rest = _pairs(placed.join(mixed.filter(F.col("c") <= SHORT), "v", "left_semi"), close)

    # long lists anew, by the whole sets of their nodes and by values that several groups have
    hot = scratch.write(placed.join(mixed.filter(F.col("c") > SHORT), "v", "left_semi").select("node", "n", "root").distinct(), "hot")
    full = _shingles(own.join(small(hot.select(F.col("node").alias("id"))), "id", "left_semi")).select(F.col("id").alias("node"), F.explode("values").alias("v"))
    full = scratch.write(full.join(small(hot), "node"), "hot-values")
    shared = full.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("df")).filter("lo <> hi").select("v", "df")
    held = full.join(shared, "v").groupBy("node", "n", "root").agg(F.array_sort(F.collect_set(F.struct("df", "v"))).alias("held"))
    listed = F.slice("held", F.lit(1), F.greatest(F.lit(0), F.size("held") - F.ceil(F.lit(threshold) * F.col("n")) + 1).cast("int"))
    again = scratch.write(held.select("node", "n", "root", F.explode(listed).alias("x")).select("node", "n", "root", F.col("x.v").alias("v")), "hot-lists")
    scratch.drop("hot-values")
    rest = rest.unionByName(_pairs(again, close)).distinct().join(stars, ["a", "b"], "left_anti")
    second = similar(scratch.write(rest, "rest"), "second")
    linked = components(first.unionByName(second), scratch, "g")
    # what is returned reads the sketches, the nodes and the last table of components
    scratch.drop("lists", "stars", "placed", "mixed", "hot", "hot-lists", "rest", *(f"{a}{b}" for a in ("first", "second") for b in ("", "-likely")))

    member = sketch.select("id", "h1", "h2").join(nodes.select("h1", "h2", "node", "last"), ["h1", "h2"])
    found = member.join(linked, "node", "left").filter((F.col("node") != F.col("last")) | F.col("root").isNotNull())
    return found.select(F.col("id").alias(id), F.coalesce("root", "node").alias("group_id")).groupBy(id).agg(F.min("group_id").alias("group_id"))


def drop_copies(docs: DataFrame, id: str = "doc_id", **kw) -> DataFrame:
    """The rows of ``docs`` without those that have a near duplicate of smaller id; of rows that repeat
    the id of a kept document one stays. Rows with a null id or without words stay. The columns are
    the same, extra ones pass through."""
    scratch = Scratch(docs.sparkSession, "copies")
    at = f"_c{position(docs, id)}"
    found = groups(docs, id, **kw)
    out = scratch.write(found.filter(F.col(id) != F.col("group_id")).select(F.col(id).alias("_gone")), "gone")
    kept = numbered(docs).join(small(out), F.col(at) == F.col("_gone"), "left_anti")
    ids = pick(docs, i=id).filter("i is not null").groupBy("i").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("i").alias("_gone"))
    repeated = scratch.write(ids, "repeated")
    if not repeated.isEmpty():
        hint = small(repeated)
        again = kept.join(hint, F.col(at) == F.col("_gone"), "left_semi").dropDuplicates([at])
        kept = kept.join(hint, F.col(at) == F.col("_gone"), "left_anti").unionByName(again)
    return kept.toDF(*docs.columns)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has near duplicates, with the smallest id of its group."""
    return groups(table(spark, sf_dir, "documents"))


#: All pairs of documents that share a shingle, whatever their number, and the components by recursion.
GROUPS_SQL = f"""
    w as (select doc_id, {WORDS_SQL} as w from documents),
    s as (select distinct doc_id, w[i : i + {SHINGLE - 1}] as s from
        (select doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) as i from w where len(w) > 0)),
    c as (select doc_id, count(*) as n from s group by doc_id),
    p as (select x.doc_id as a, y.doc_id as b, count(*) as o from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by all),
    e as (select a, b from p join c x on a = x.doc_id join c y on b = y.doc_id where o >= {THRESHOLD} * (x.n + y.n - o)),
    r as (select a as node, a as root from e union select e.b, r.root from r join e on e.a = r.node)"""
SQL = f"with recursive {GROUPS_SQL} select node as doc_id, min(root) as group_id from r group by node"
