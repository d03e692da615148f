"""Walking Arrow batches of texts in pieces that bound the memory of the numpy kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of text that a kernel sees at once; one longer text makes a piece of its own.
PIECE_CHARS = 1_000_000


def pieces(ids: pa.Array, texts: list[str], limit: int = PIECE_CHARS) -> Iterator[tuple[pa.Array, list[str]]]:
    """Consecutive runs of rows whose texts have at most ``limit`` characters together, or one row."""
    start, held = 0, 0
    for i, x in enumerate(texts):
        if held and held + len(x) > limit:
            yield ids.slice(start, i - start), texts[start:i]
            start, held = i, 0
        held += len(x)
    if start < len(texts):
        yield ids.slice(start), texts[start:]


#: Bytes of a batch that is handed to Python, so that rows of long texts don't make batches of many times that.
BATCH_BYTES = 8_000_000


def by_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over batches of at most some BATCH_BYTES, whatever the length of the texts (a longer
    row is a batch of its own)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def over_texts(kernel: Callable[..., pa.RecordBatch], limit: int = PIECE_CHARS, setup: Callable[[], object] | None = None):
    """A mapInArrow function: columns (id, text) in, what ``kernel(ids, texts)`` returns out.
    A null text reaches the kernel as an empty one. What ``setup`` makes once a task is handed to the
    kernel as a third argument and let go with the task, so that idle workers hold no memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (setup(),) if setup else ()
        for b in batches:
            step = max(500, limit // 2000)
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                texts = [x or "" for x in part.column("text").to_pylist()]
                for ids, own in pieces(part.column("id"), texts, limit):
                    yield kernel(ids, own, *held)

    return run


def runs(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``lengths``, joined."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    some = lengths[lengths > 0]
    ends = np.cumsum(some)
    out[0] = 0
    out[ends[:-1]] = 1 - some[:-1]
    return np.cumsum(out)


def gather(flat: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Joins flat[start[i] : start[i] + lengths[i]] over all i."""
    return flat[np.repeat(start, lengths) + runs(lengths)]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _ODD, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)


def hash_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans of ``data``, which must not overlap and be in order; every
    span must have at least one byte."""
    global _POWERS
    if not len(start):
        return np.zeros(0, np.uint64)
    if int(length.max()) > len(_POWERS):
        _POWERS = _powers(int(length.max()))
    dense = int(length.sum()) == int(start[-1] + length[-1] - start[0])
    if dense:
        own, at = data[start[0] : start[-1] + length[-1]], start - start[0]
    else:
        own, at = gather(data, start, length), np.cumsum(length) - length
    terms = (own.astype(np.uint64) + np.uint64(1)) * _POWERS[runs(length)]
    return mix(np.add.reduceat(terms, at) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
