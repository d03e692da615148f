"""Operator 8: exact token counts at every prefix, by dynamic programming over the arcs of the
tokenization automaton: c(i) = c(i - length of the last token) + 1.

The counts are stored once, as one signed byte a character (the change of the count from one prefix to
the next; tokens of up to 129 bytes keep it within -128..4), so that truncation and budget questions are
answered from the stored column alone, without the tokenizer.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.llm import bpe
from tessera.llm.chunks import by_batches, over_texts, runs
from tessera.plans.columns import pick
from tessera.sources.tables import table

BUDGETS = (128, 512, 2048)


#: Bytes of the longest token whose vocabulary's deltas always fit into one byte.
LONGEST = 129


def longest_within(counts: np.ndarray, sizes: np.ndarray, budgets: np.ndarray) -> np.ndarray:
    """Characters of the longest prefix of each text whose exact token count is at most its budget; the
    counts of all prefixes of all texts are joined. Counts can fall when a character is added, so this is
    the last such prefix, not the first one's neighbour."""
    out, some = np.zeros(len(sizes), np.int64), sizes > 0
    if some.any():
        fits = np.where(counts <= np.repeat(budgets, sizes), runs(sizes) + 1, 0)
        out[some] = np.maximum.reduceat(fits, (np.cumsum(sizes) - sizes)[some])
    return out


def count_prefixes(docs: DataFrame, id: str = "doc_id", text: str = "text", budgets: Sequence[int] = BUDGETS, vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """(id, n_chars, n_tokens, prefix_deltas, fit_<budget>...) of every row of ``docs``.

    prefix_deltas is a binary column, byte i the change of the exact token count from the prefix of i
    characters to that of i + 1; fit_<budget> the characters of the longest prefix within a budget. A
    vocabulary with tokens of over LONGEST bytes is refused. A null or empty text has counts of 0 and no bytes; null ids and repeated rows are kept, other
    columns not looked at, and an empty table gives an empty one."""
    own = pick(docs, id=id, text=text)
    tables = bpe.compiled(bpe.load_merges(vocabulary))
    if max(map(len, tables["tokens"])) > LONGEST:
        raise ValueError("this vocabulary's tokens are too long for deltas of one byte")
    shared = own.sparkSession.sparkContext.broadcast(tables)
    kind = own.schema["id"].dataType.simpleString()
    budgets = tuple(budgets)

    def kernel(ids: pa.Array, texts: list[str], automaton: bpe.Automaton) -> pa.RecordBatch:
        counts = bpe.prefix_counts(automaton, texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.cumsum(sizes) - sizes
        change = np.diff(counts, prepend=0)
        heads = at[sizes > 0]
        change[heads] = counts[heads]
        raw, total = change.astype(np.int8).tobytes(), np.zeros(len(texts), np.int64)
        total[sizes > 0] = counts[(at + sizes - 1)[sizes > 0]]
        fits = [longest_within(counts, sizes, np.full(len(sizes), b)) for b in budgets]
        columns = [ids, pa.array(sizes), pa.array(total), pa.array([raw[a : a + n] for a, n in zip(at, sizes, strict=True)], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in fits)], names=[id, "n_chars", "n_tokens", "prefix_deltas", *(f"fit_{b}" for b in budgets)])

    answers = "".join(f", fit_{b} bigint" for b in budgets)
    return by_batches(own, over_texts(kernel, bpe.TEXT_CHARS, lambda: bpe.Automaton(shared.value)), f"`{id}` {kind}, n_chars bigint, n_tokens bigint, prefix_deltas binary{answers}")


def _stored(deltas: pd.Series, wanted: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(counts of all prefixes, joined; their number by row; wanted, 0 where null; rows without nulls)."""
    known = (deltas.notna() & wanted.notna()).to_numpy()
    rows = [x if k else b"" for x, k in zip(deltas, known, strict=True)]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    upto = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(rows), np.int8), dtype=np.int64)])
    return upto[1:] - np.repeat(upto[np.cumsum(sizes) - sizes], sizes), sizes, wanted.fillna(0).to_numpy(np.int64), known


@F.pandas_udf(LongType())
def _count_at(deltas: pd.Series, chars: pd.Series) -> pd.Series:
    counts, sizes, chars, known = _stored(deltas, chars)
    n = np.clip(chars, 0, sizes)
    at = np.cumsum(sizes) - sizes + n - 1
    found = np.where(n > 0, counts[np.where(n > 0, at, 0)] if len(counts) else 0, 0)
    return pd.Series(found, dtype="Int64").where(known)


@F.pandas_udf(LongType())
def _fit(deltas: pd.Series, budget: pd.Series) -> pd.Series:
    counts, sizes, budget, known = _stored(deltas, budget)
    return pd.Series(longest_within(counts, sizes, budget), dtype="Int64").where(known)


def count_at(deltas: Column, chars: Column) -> Column:
    """Exact token count of the prefix of ``chars`` characters (all of the text if it is shorter, none
    if it is negative), from a stored prefix_deltas column. Null if either is null."""
    return _count_at(deltas, chars.cast("bigint"))


def fit(deltas: Column, budget: Column) -> Column:
    """Characters of the longest prefix within ``budget`` tokens, from a stored prefix_deltas column.
    Null if either is null."""
    return _fit(deltas, budget.cast("bigint"))


def op8_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts at every prefix of every document, and the cuts for the usual context sizes."""
    return count_prefixes(table(spark, sf_dir, "documents"))
