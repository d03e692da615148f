"""Scores between all queries and all memories of a tenant, a block of either at a time.

Rows of a tenant are dealt by hash to blocks of bounded rows and bytes, and every block of queries meets every
block of memories in a task of its own. There a matrix product scores the pairs, so that no pair is a row unless
it is a result, and a tenant that has all the queries is spread like any other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clamp, strip
from tessera.plans.scratch import Scratch, small

#: Bytes of vectors or tokens in a block. Tasks a core.
BYTES, SPREAD = 32_000_000, 4
#: Share of the pairs of a block that must share a token for a matrix product; other tokens add up pair by pair.
DENSE_SHARE, SLAB, STEP = 0.005, 512, 4_000_000
#: Queries of a matrix of scores, of which there are as many in a block as keep memories from being sent again.
QUERIES = 1024


def hashes(xs: Column) -> Column:
    """64 bits of each string."""
    return F.transform(F.filter(xs, lambda x: x.isNotNull()), lambda x: F.xxhash64(x))


def conditions(queries: DataFrame, need: Column | None) -> tuple[dict[str, Column], dict[str, Column]]:
    """P02-P06 as columns that ``allowed`` reads, of the queries (null: nothing asked for) and of the memories.
    ``need``: whether a query's people are required."""
    asked, held, none = {}, {}, F.array().cast("array<bigint>")
    if "memory_type" in queries.columns:
        asked["_type"], held["_type"] = F.nullif(strip(F.coalesce("memory_type", F.lit(""))), F.lit("")), F.col("memory_type")
    for name, column, own in (("_topics", "topics_any", "topics"), ("_people", "people_any", "people")):
        if column in queries.columns:
            wanted = F.size(column) > 0 if name == "_topics" else F.coalesce(need, F.lit(True))
            asked[name] = F.when(wanted, F.array_sort(F.coalesce(hashes(F.col(column)), none)))
            held[name] = F.coalesce(hashes(F.col(own)), none)
    if "min_confidence" in queries.columns:
        asked["_least"], held["_confidence"] = clamp(F.col("min_confidence")), F.nanvl(F.col("confidence").cast("double"), F.lit(float("inf")))
    return asked, held


def scored(scratch: Scratch, queries: DataFrame, memories: DataFrame, payload: str, rows: tuple[int, int], score: Callable, value: str) -> DataFrame:
    """(query_id, id, ``value``) that ``score`` makes of blocks of queries (query_id, user_id, ...) and of memories
    (id, user_id, ...). ``payload`` is the array that counts as bytes, ``rows`` the most of a block of either."""
    q = scratch.write(queries.filter("user_id is not null"), f"{value}-queries")
    tenants = small(q.select("user_id").distinct())
    m = scratch.write(memories.join(tenants, "user_id", "left_semi"), f"{value}-memories")

    def blocks(df: DataFrame, most: int, name: str) -> DataFrame:
        n = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum(F.coalesce(F.size(payload), F.lit(0))) * 8 / BYTES))
        return df.groupBy("user_id").agg(n.cast("int").alias(name))

    n = small(scratch.write(blocks(q, rows[0], "_nq").join(blocks(m, rows[1], "_nm"), "user_id"), f"{value}-blocks"))
    keys = ["user_id", "_q", "_m"]
    deal = lambda df, key, own, other: df.join(n, "user_id").withColumn(f"_{own}", F.pmod(F.xxhash64(key), f"_n{own}").cast("int")).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1))).drop("_nq", "_nm")
    # Blocks are few and large, and lie in partitions by hash: more partitions for a more even load
    parts = 4 * SPREAD * scratch.spark.sparkContext.defaultParallelism
    left, right = (x.repartition(parts, *keys).groupBy(*keys) for x in (deal(q, "query_id", "q", "m"), deal(m, "id", "m", "q")))
    kinds = q.schema["query_id"].dataType.simpleString(), m.schema["id"].dataType.simpleString()
    empty = pa.table({})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            found = [(empty, empty, [], [], [])]
        else:
            right = right.take(pc.sort_indices(right, [("id", "ascending")]))
            found = score(left.combine_chunks(), right.combine_chunks())
        out = []
        for qs, ms, i, j, x in found:
            if len(x):
                out.append(pa.record_batch([qs["query_id"].take(pa.array(i)).combine_chunks(), ms["id"].take(pa.array(j)).combine_chunks(), pa.array(x, pa.float64(), from_pandas=True)], ["query_id", "id", value]))
        if out:
            return pa.Table.from_batches(out)
        return pa.table({"query_id": left["query_id"].slice(0, 0), "id": right["id"].slice(0, 0), value: pa.array([], pa.float64())})

    return left.cogroup(right).applyInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, {value} double")


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the elements of lists."""
    xs = column.combine_chunks()
    n = pc.fill_null(pc.list_value_length(xs), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(xs)), n), xs.flatten().to_numpy(zero_copy_only=False)


def allowed(asked: pa.Table, held: pa.Table) -> Callable[[int], np.ndarray]:
    """Of the number of a query, which memories pass its filters. Queries that ask alike share the answer."""
    known: dict = {}
    column = lambda t, name: t[name].to_pylist() if name in t.column_names else [None] * len(t)
    wanted = list(zip(*(column(asked, c) for c in ("_type", "_topics", "_people", "_least")), strict=True))
    own = {c: flat(held[c]) for c in ("_topics", "_people") if c in held.column_names}
    types = np.array(column(held, "_type"), object)
    sure = held["_confidence"].to_numpy() if "_confidence" in held.column_names else None

    def of(i: int) -> np.ndarray:
        kind, topics, people, least = wanted[i]
        key = kind, topics and tuple(topics), people if people is None else tuple(people), least
        if key not in known:
            ok = np.ones(len(held), bool) if kind is None else types == kind
            for name, xs in (("_topics", topics), ("_people", people)):
                if xs is not None:
                    rows, values = own[name]
                    hit = np.zeros(len(held), bool)
                    hit[rows[np.isin(values, np.array(xs, np.int64))]] = True
                    ok = ok & hit
            known[key] = ok if least is None else ok & (sure >= least)
        return known[key]

    return of


def best(x: np.ndarray, ok: np.ndarray, k: int, places: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The k places of the largest numbers among those that are ok, the first of equal ones first, and the numbers,
    rounded. Only those that rounding may bring among the k are rounded."""
    at = np.flatnonzero(ok)
    if len(at) > k:
        own = x[at]
        at = at[own >= np.partition(own, len(at) - k)[len(at) - k] - (0 if places is None else 2 * 10.0**-places)]
    own = x[at] if places is None else rounded(x[at], places)
    order = np.argsort(-own, kind="stable")[:k]
    return at[order], own[order]


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Half away from zero."""
    by = 10.0**places
    return np.copysign(np.floor(np.abs(x) * by + 0.5) / by, x)


def top(k: int, matrix: Callable[[pa.Table], Callable[[pa.Table], np.ndarray]], above: float, places: int | None = None) -> Callable:
    """A ``score`` for ``scored``: the k best memories of each query with more than ``above``. The matrix has QUERIES
    queries at a time."""

    def score(asked: pa.Table, held: pa.Table):
        of, scores = allowed(asked, held), matrix(held)
        for s in range(0, len(asked), QUERIES):
            xs = scores(asked.slice(s, QUERIES))
            found = [best(x, of(s + i) & (x > above), k, places) for i, x in enumerate(xs)]
            i = np.repeat(np.arange(s, s + len(xs)), [len(at) for at, _ in found])
            yield asked, held, i, np.concatenate([at for at, _ in found]), np.concatenate([x for _, x in found])

    return score


def cosines(held: pa.Table) -> Callable[[pa.Table], np.ndarray]:
    """Of queries, products of vectors of length 1 with those of memories; -2 where there is none, as lengths differ."""
    return lambda asked: _cosines(asked, held)


def _cosines(asked: pa.Table, held: pa.Table) -> np.ndarray:
    out = np.full((len(asked), len(held)), -2.0)
    sizes = [pc.fill_null(pc.list_value_length(t["_v"].combine_chunks()), -1).to_numpy(zero_copy_only=False) for t in (asked, held)]
    for n in np.unique(sizes[0]):
        i, j = (np.flatnonzero(s == n) for s in sizes)
        if n >= 0 and len(j):
            a, b = (t["_v"].take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(at), n) for t, at in ((asked, i), (held, j)))
            x = a @ b.T
            x[np.isnan(x)] = -2.0
            if x.shape == out.shape:
                return x
            out[np.ix_(i, j)] = x
    return out


def products(held: pa.Table) -> Callable[[pa.Table], np.ndarray]:
    """Of queries, products of the counts of tokens with those of memories, exact. Tokens that many pairs share go
    through a matrix product. Tokens of the memories are counted once."""
    j, b = flat(held["_t"])
    own, b = np.unique(b, return_inverse=True)
    counted = _counted(j, b, len(own)) if len(own) else (j, b, np.zeros(0))
    return lambda asked: _products(asked, own, counted, len(held))


def _products(asked: pa.Table, known: np.ndarray, counted: tuple[np.ndarray, np.ndarray, np.ndarray], nm: int) -> np.ndarray:
    i, a = flat(asked["_t"])
    nq = len(asked)
    out = np.zeros((nq, nm))
    words, a = np.unique(a, return_inverse=True)
    if not len(words) or not len(known):
        return out
    at = np.minimum(np.searchsorted(words, known), len(words) - 1)
    j, b, w = counted
    b = np.where(words[at] == known, at, -1)[b]
    j, b, w = (x[b >= 0] for x in (j, b, w))
    i, a, v = _counted(i, a, len(words))
    nq_with, nm_with = np.bincount(a, minlength=len(words)), np.bincount(b, minlength=len(words))
    common = nq_with * nm_with > DENSE_SHARE * nq * nm
    places, many = np.cumsum(common) - 1, int(common.sum())
    for s in range(0, many, SLAB):
        x, y = (common[c] & (places[c] >= s) & (places[c] < s + SLAB) for c in (a, b))
        left, right = np.zeros((nq, min(SLAB, many - s))), np.zeros((min(SLAB, many - s), nm))
        left[i[x], places[a[x]] - s] = v[x]
        right[places[b[y]] - s, j[y]] = w[y]
        out += left @ right
    x, y = ~common[a], ~common[b]
    i, a, v, j, b, w = i[x], a[x], v[x], j[y], b[y], w[y]
    order = np.argsort(a, kind="stable")
    i, v, first = i[order], v[order], np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(words)))])
    n = first[b + 1] - first[b]
    ends = np.cumsum(n)
    cells, start = out.reshape(-1), 0
    while start < len(b):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + STEP, "right")))
        own = n[start:stop]
        p = np.repeat(first[b[start:stop]] - (ends[start:stop] - own - done), own) + np.arange(own.sum())
        np.add.at(cells, i[p] * nm + np.repeat(j[start:stop], own), v[p] * np.repeat(w[start:stop], own))
        start = stop
    return out


def _counted(rows: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, count = np.unique(rows * n + words, return_counts=True)
    return key // n, key % n, count.astype(float)


def shares(asked: pa.Table, held: pa.Table):
    """A ``score``: every pair, with the share of the query's tokens that the memory has; 0 if it has none."""
    n = np.bincount(flat(asked["_t"])[0], minlength=len(asked))
    xs = rounded(products(held)(asked) / np.maximum(n, 1)[:, None], 9)
    j = np.arange(len(held))
    for i, x in enumerate(xs):
        yield asked, held, np.full(len(held), i), j, x
