"""Operator 6: BPE encoding and decoding by a tokenization automaton (see ``bpe``).

Whole texts are split as the vocabulary's pattern splits them; each distinct word of a batch is read by
table-driven transitions and its tokens are the arc labels met on the way back. Narrow map stages only:
no shuffle, and what is broadcast has the size of the vocabulary file, whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe
from tessera.llm.chunks import by_batches, over_texts
from tessera.plans.columns import pick
from tessera.sources.tables import table


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """(id, token_ids, n_tokens, round_trip) of every row of ``docs``.

    ``round_trip`` tells whether decoding token_ids gives the text back. A null or empty text has no
    tokens (round_trip true); null ids are kept, repeated rows stay repeated, other columns are not
    looked at, and an empty table gives an empty one."""
    own = pick(docs, id=id, text=text)
    shared = own.sparkSession.sparkContext.broadcast(bpe.compiled(bpe.load_merges(vocabulary)))
    kind = own.schema["id"].dataType.simpleString()

    def kernel(ids: pa.Array, texts: list[str], automaton: bpe.Automaton) -> pa.RecordBatch:
        tokens, counts = bpe.encode(automaton, texts)
        same, at = [], np.concatenate([[0], np.cumsum(counts)])
        for lo in range(0, len(texts), 100):
            own = [x.encode("utf-8", "surrogatepass") for x in texts[lo : lo + 100]]
            spelled, sizes = automaton.spell(tokens[at[lo] : at[min(lo + 100, len(texts))]])
            ends = np.concatenate([[0], np.cumsum(sizes)])[at[lo : lo + 101] - at[lo]]
            same += [spelled[a:b].tobytes() == x for x, a, b in zip(own, ends, ends[1:], strict=False)]
        return pa.RecordBatch.from_arrays([ids, _lists(tokens, counts), pa.array(counts, pa.int64()), pa.array(same)], names=[id, "token_ids", "n_tokens", "round_trip"])

    return by_batches(own, over_texts(kernel, bpe.TEXT_CHARS, lambda: bpe.Automaton(shared.value)), f"`{id}` {kind}, token_ids array<int>, n_tokens bigint, round_trip boolean")


def decode(tokens: DataFrame, id: str = "doc_id", token_ids: str = "token_ids", vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """(id, text) by emitting the arc labels of ``token_ids`` in order.

    Null or empty token lists give an empty text; null tokens inside a list are skipped; ids outside
    the vocabulary raise. Bytes that are no UTF-8 (cut token lists) become U+FFFD. Null ids and repeated
    rows are kept, other columns not looked at, whatever their names, and an empty table gives an empty
    one."""
    own = pick(tokens, id=id, token_ids=token_ids)
    shared = own.sparkSession.sparkContext.broadcast(bpe.load_merges(vocabulary)["tokens"])
    kind = own.schema["id"].dataType.simpleString()

    def run(batches):
        labels = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                texts = [b"".join([labels[t] for t in x or [] if t is not None]).decode("utf-8", "replace") for x in b.column("token_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], names=[id, "text"])

    return by_batches(own, run, f"`{id}` {kind}, text string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, with the outcome of decoding it again."""
    return encode(table(spark, sf_dir, "documents"))
