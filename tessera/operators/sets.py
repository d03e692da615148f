"""Pairs of sets that may be similar, by bits, a block of sets against another.

A set is told by as many bits as twice its band's most elements, each the parity of the elements that hash to it.
Two sets differ in no more bits than elements, so those of a Jaccard similarity of t, which differ in at most
(1 - t) / (1 + t) of their sizes, are never missed. Only bits are shuffled, some hundredth of the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import BYTES, SPREAD, flat
from tessera.plans.scratch import Scratch, small

#: Most sets of a block. Sets and bits of a matrix product; the fewest bits of a set.
ROWS, SETS, BITS, LEAST = 8192, 1024, 2048, 128


def _bits(band: np.ndarray, width: float) -> np.ndarray:
    """Bits of the sets of a band, a power of two that grows with it."""
    return np.maximum(LEAST, 2 ** np.ceil(1 + (band + 1) * width / math.log(2))).astype(np.int64)


def parities(t: pa.Table, width: float) -> list[bytes]:
    """The bits of the sets ``hashes`` of bands ``band``, eight a byte."""
    row, value = flat(t["hashes"])
    n = _bits(t["band"].to_numpy(), width)
    ends = np.cumsum(n)
    at, count = np.unique((ends - n)[row] + (value & (n[row] - 1)), return_counts=True)
    bits = np.zeros(ends[-1] if len(n) else 0, np.uint8)
    bits[at[count % 2 == 1]] = 1
    held = np.packbits(bits).tobytes()
    return [held[(e - m) // 8 : e // 8] for e, m in zip(ends, n, strict=True)]


def _matrix(bits: pa.ChunkedArray, n: int) -> np.ndarray:
    """(sets, n / 8) bytes; longer ones are folded, as the parity of a bit is that of the bits it stands for."""
    rows = bits.combine_chunks()
    out = np.frombuffer(b"".join(x.as_py() for x in rows), np.uint8).reshape(len(rows), -1)
    while out.shape[1] * 8 > n:
        half = out.shape[1] // 2
        out = out[:, :half] ^ out[:, half:]
    return out


def close(left: pa.Table, right: pa.Table | None, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``left`` and ``right`` (none: pairs within ``left``) of sets that differ in at most ``share`` of their
    sizes as far as bits tell."""
    other = left if right is None else right
    n = 8 * min(len(left["bits"][0].as_py()), len(other["bits"][0].as_py()))
    a, b = _matrix(left["bits"], n), _matrix(other["bits"], n)
    own, its = (2 * share * t["n"].to_numpy().astype(float) for t in (left, other))
    signs = lambda x: np.unpackbits(x, axis=1).astype(np.float32) * 2 - 1
    for s in range(0, len(a), SETS):
        first = s if right is None else 0
        same = np.zeros((min(SETS, len(a) - s), len(b) - first), np.float32)
        for c in range(0, n // 8, BITS // 8):
            same += signs(a[s : s + SETS, c : c + BITS // 8]) @ signs(b[first:, c : c + BITS // 8]).T
        # bits that are equal less those that differ; the rest allows for the sizes being no whole numbers
        i, j = np.nonzero(same >= (n - 1 - own[s : s + SETS, None] - its[None, first:].max(initial=0)).astype(np.float32))
        keep = same[i, j] >= n - 1 - own[s + i] - its[first + j]
        if right is None:
            keep &= i < j
        yield s + i[keep], first + j[keep]


def near(scratch: Scratch, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, once each, of nodes of ``sets`` (user_id, node, n, hashes: not empty, distinct) of one user: all
    whose Jaccard similarity is ``threshold`` or more, and few others.

    Sets lie in bands by size, such that similar ones are of one band or of neighbours; bands in blocks."""
    width = -math.log(threshold * (1 - 1e-6))
    share = (1 - threshold) / (1 + threshold)
    kinds = {c: sets.schema[c].dataType.simpleString() for c in ("user_id", "node")}
    own = sets.select("user_id", "node", F.col("n").cast("bigint").alias("n"), F.floor(F.log("n") / F.lit(width)).cast("bigint").alias("band"), "hashes")

    def told(batches):
        for x in batches:
            t = pa.Table.from_batches([x])
            yield from t.drop_columns(["hashes"]).append_column("bits", pa.array(parities(t, width), pa.binary())).to_batches()

    own = scratch.write(own.mapInArrow(told, f"user_id {kinds['user_id']}, node {kinds['node']}, n bigint, band bigint, bits binary"), "bits")
    n = F.greatest(F.ceil(F.count("*") / ROWS), F.ceil(F.sum(F.length("bits")) / BYTES)).cast("int")
    n = scratch.write(own.groupBy("user_id", "band").agg(n.alias("_own")), "bands")
    beside = lambda by, name: n.select("user_id", (F.col("band") + by).alias("band"), F.col("_own").alias(name))
    n = small(n.join(beside(-1, "_next"), ["user_id", "band"], "left").join(beside(1, "_last"), ["user_id", "band"], "left"))
    p, kind = F.col("_p"), "array<struct<band:bigint,next:boolean,i:int,j:int,right:boolean>>"
    upto = lambda a, b: F.when(b > a, F.sequence(a, b - 1))
    cells = lambda xs, f: F.coalesce(F.transform(xs, f), F.array()).cast(kind)
    cell = lambda band, next_, i, j, right: F.struct(band.alias("band"), F.lit(next_).alias("next"), i.alias("i"), j.alias("j"), F.lit(right).alias("right"))
    zero = F.lit(0)
    at = F.concat(
        cells(upto(p, F.col("_own")), lambda j: cell(F.col("band"), False, p, j, False)),
        cells(upto(zero, p), lambda i: cell(F.col("band"), False, i, p, True)),
        cells(upto(zero, F.col("_next")), lambda j: cell(F.col("band"), True, p, j, False)),
        cells(upto(zero, F.col("_last")), lambda i: cell(F.col("band") - 1, True, i, p, True)),
    )
    dealt = own.join(n, ["user_id", "band"]).withColumn("_p", F.pmod(F.xxhash64("node"), "_own").cast("int"))
    dealt = dealt.select("user_id", "node", "n", "bits", F.explode(at).alias("at")).select("user_id", "node", "n", "bits", "at.*")
    keys = ["user_id", "band", "next", "i", "j"]

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side = t["right"].to_numpy()
        alone = not t["next"][0].as_py() and t["i"][0].as_py() == t["j"][0].as_py()
        left, right = t.filter(pa.array(~side)), None if alone else t.filter(pa.array(side))
        found = [] if not len(left) or (right is not None and not len(right)) else list(close(left, right, share))
        i, j = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
        return pa.table({"a": left["node"].take(pa.array(i)), "b": (left if right is None else right)["node"].take(pa.array(j))})

    parts = SPREAD * scratch.spark.sparkContext.defaultParallelism
    pairs = dealt.repartition(parts, *keys).groupBy(*keys).applyInArrow(run, f"a {kinds['node']}, b {kinds['node']}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
