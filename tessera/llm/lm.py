"""Operator 9: stupid-backoff scores from n-gram counts of the whole corpus.

The relations are n-grams of documents, count tables partitioned by hash, and their join, summed per
document. A row of them is not one n-gram but a column chunk: all distinct n-grams of one order that a
chunk of documents has in one hash bucket, as sorted hashes (packed as differences) with their counts.
So one shuffle by (order, bucket) brings together what is to be counted, already combined within its
chunk; the counts go back along it to their chunk, and there they are joined with the n-grams in document
order. An n-gram of any count is in the tables, those that occur once too:

    S(w | u v) = f(u v w) / f(u v)           if f(u v w) > 0
               = a * f(v w) / f(v)           else if f(v w) > 0
               = a * a * f(w) / N            else

What is shuffled is the texts once (compressed), a packed hash a distinct n-gram and chunk, and its
count back. Hashes have as many bits as keep the chance of an n-gram to share its hash with another under
2^-SPARE at the size of the corpus. Chunks and buckets grow in number with the corpus, not in size; the
rows between them by the square, with ever fewer n-grams each, so ``chunk_bytes`` should be as large as
executors allow on very large corpora.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chunks import by_batches, pieces
from tessera.llm.words import WORDS_SQL, ngram_hashes, word_hashes
from tessera.plans.columns import pick
from tessera.plans.scratch import Scratch
from tessera.sources.tables import table

ORDER = 3
BACKOFF = 0.4
#: Bytes of text of a chunk, on average.
CHUNK_BYTES = 12_000_000
#: Bits of an n-gram's hash beyond those that number the n-grams of the corpus.
SPARE = 27
#: Bytes of text that a task gathers before it packs them by chunk.
HELD_BYTES = 24_000_000


def _pack(x: np.ndarray) -> bytes:
    """uint64 values by planes of bytes, compressed, so that high zero bytes cost nothing."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    plain = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8")


_TEXTS = "chunk int, texts binary"


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, text, chunk) to rows of many: a compressed Arrow stream of those of one chunk."""
    held, size = [], 0

    def packed() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        chunk = t.column("chunk").to_numpy()
        order = np.argsort(chunk, kind="stable")
        own, ends = np.unique(chunk[order], return_index=True)
        rows = []
        for part in np.split(order, ends[1:]):
            sink = pa.BufferOutputStream()
            body = t.select(["id", "text"]).take(pa.array(part)).combine_chunks()
            with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(body)
            rows.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(rows, pa.binary())], names=["chunk", "texts"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= HELD_BYTES:
            yield packed()
            held, size = [], 0
    if held:
        yield packed()


def _documents(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """The documents (id, text) of the rows of a chunk."""
    for raw in t.column("texts"):
        yield from pa.ipc.open_stream(raw.as_buffer())


def _chunk(t: pa.Table) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """(ids, word hashes, words of each document) of a chunk."""
    ids, words, counts = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b in _documents(t):
        ids.append(b.column("id"))
        for lo in range(0, b.num_rows, 500):
            part = b.slice(lo, 500)
            for _, own in pieces(part.column("id"), [x or "" for x in part.column("text").to_pylist()]):
                h, n = word_hashes(own)
                words.append(h)
                counts.append(n)
    return ids, np.concatenate(words), np.concatenate(counts)


def _grams(words: np.ndarray, counts: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of ``width`` bits of the n-grams inside documents, index of the last word of each)."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    last = np.flatnonzero(place >= n - 1)
    hashes = ngram_hashes(words, n)[last - (n - 1)] if len(last) else np.zeros(0, np.uint64)
    return hashes >> np.uint64(64 - width), last


_OUT = "chunk int, ord int, bucket int, keys binary, counts binary"
_SCHEMA = pa.schema([("chunk", pa.int32()), ("ord", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _explode(bits: int, order: int, width: int):
    """The distinct n-grams of 1 .. order words of a chunk with their counts, a row for each bucket that
    has any."""

    def run(t: pa.Table) -> pa.Table:
        chunk, rows = t.column("chunk")[0].as_py(), []
        _, words, counts = _chunk(t)
        for n in range(1, order + 1):
            keys, f = np.unique(_grams(words, counts, n, width)[0], return_counts=True)
            if not len(keys):
                continue
            bucket = keys >> np.uint64(width - bits)
            heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for a, b in zip(heads, [*heads[1:], len(keys)], strict=True):
                base = bucket[a] << np.uint64(width - bits)
                rows.append((chunk, n, int(bucket[a]), _pack(np.diff(keys[a:b], prepend=base)), _pack(f[a:b])))
        return pa.Table.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows], _SCHEMA)

    return run


def _count(t: pa.Table) -> pa.Table:
    """The count table of one bucket, joined back to the chunks whose n-grams it counts."""
    parts = [(np.cumsum(_unpack(k), dtype=np.uint64), _unpack(c)) for k, c in zip(t.column("keys").to_pylist(), t.column("counts").to_pylist(), strict=True)]
    _, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.uint64)
    ends = np.cumsum([len(k) for k, _ in parts])
    counts = [_pack(total[at[e - len(k) : e]]) for (k, _), e in zip(parts, ends, strict=True)]
    return pa.table({"chunk": t.column("chunk"), "ord": t.column("ord"), "bucket": t.column("bucket"), "keys": pa.array([b""] * len(counts), pa.binary()), "counts": pa.array(counts, pa.binary())})


def _score(order: int, backoff: float, width: int):
    """(id, n_words, n_last, log_score) of the documents of a chunk, without the -ln N of the ``n_last``
    words that are scored by their own count."""

    def run(docs: pa.Table, counted: pa.Table) -> pa.Table:
        ids, words, n = _chunk(docs)
        rows: dict[int, list[tuple[int, bytes]]] = {}
        for o, b, c in zip(counted.column("ord").to_pylist(), counted.column("bucket").to_pylist(), counted.column("counts").to_pylist(), strict=True):
            rows.setdefault(o, []).append((b, c))
        log, open_, above = np.zeros(len(words)), np.ones(len(words), bool), None
        # from the longest n-grams down: f(u v w) of one order is divided by f(u v) of the next
        for o in range(order, 0, -1):
            h, last = _grams(words, n, o, width)
            keys, at = np.unique(h, return_inverse=True)
            found = np.concatenate([np.zeros(0, np.uint64), *(_unpack(c) for _, c in sorted(rows.get(o, ())))])
            if len(found) != len(keys):
                raise RuntimeError("the documents of a chunk changed between counting and scoring")
            f = np.zeros(len(words))
            f[last] = found[at]
            if above is not None:
                log[above] -= np.log(f[above - 1])
            hit = open_ & (f > 0)
            above = np.flatnonzero(hit)
            log[above] += np.log(f[above])
            open_ &= ~hit
            if o > 1:
                log[open_] += math.log(backoff)
        last = np.zeros(len(words), np.int64)
        last[above if above is not None else []] = 1
        ends = np.concatenate([[0], np.cumsum(n)])
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
        score = np.array([log[a:b].sum() for a, b in zip(ends, ends[1:], strict=False)])
        id_ = pa.chunked_array(ids, type=docs_type(docs)) if ids else pa.chunked_array([], type=docs_type(docs))
        return pa.table({"id": id_, "n_words": pa.array(n, pa.int64()), "n_last": pa.array(sums(last), pa.int64()), "log_score": pa.array(score, pa.float64())})

    def docs_type(t: pa.Table) -> pa.DataType:
        return next(_documents(t)).schema.field("id").type

    return run


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_words, log_score) of every row of ``docs``, under the counts of all of them.

    log_score is the sum of ln S over the words; shorter histories at the head of a document use the
    orders they have, with the backoff factor for each that is missing. A null, empty or wordless text
    has 0 words and a score of 0; ids may be of any type, null or repeated; repeated rows are counted and
    scored each; other columns are not looked at; an empty table gives an empty one. A chunk holds whole
    documents, so one very long text, or one that very many rows repeat with the same id, makes one
    large chunk. Runs when called; the scores are read from a written table."""
    own = pick(docs, id=id, text=text)
    kind, scratch = own.schema["id"].dataType.simpleString(), Scratch(docs.sparkSession, "backoff")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(size / chunk_bytes))
    bits = math.ceil(math.log2(chunks))
    # a word has at least one byte and a sign behind it
    width = min(64, SPARE + max(1, math.ceil(math.log2(order * max(size, 2) / 2))))
    kept = by_batches(own.withColumn("chunk", F.pmod(F.xxhash64("text", "id"), F.lit(chunks)).cast("int")), _pack_texts, _TEXTS)
    counted = kept.groupBy("chunk").applyInArrow(_explode(bits, order, width), _OUT).groupBy("ord", "bucket").applyInArrow(_count, _OUT)
    scored = kept.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_score(order, backoff, width), f"id {kind}, n_words bigint, n_last bigint, log_score double")
    scored = scratch.write(scored, "scores")
    total = scored.agg(F.sum("n_words").alias("total"))
    rest = F.when(F.col("n_last") > 0, F.col("n_last") * F.ln("total")).otherwise(0.0)
    return scored.crossJoin(F.broadcast(total)).select(F.col("id").alias(id), "n_words", (F.col("log_score") - rest).alias("log_score"))


def op9_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stupid-backoff score of every document under the trigram counts of all documents."""
    d = score(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


SQL = f"""
    with w as (select row_number() over () as k, doc_id, {WORDS_SQL} as w from documents),
    p as (select k, i, w[i] as c, case when i > 1 then w[i - 1] end as b, case when i > 2 then w[i - 2] end as a
        from (select k, w, unnest(range(1, len(w) + 1)) as i from w)),
    f1 as (select c as x, count(*) as f from p group by all),
    f2 as (select b as x, c as y, count(*) as f from p where b is not null group by all),
    f3 as (select a as x, b as y, c as z, count(*) as f from p where a is not null group by all),
    s as (select p.k, case
            when t.f is not null then ln(t.f / h.f)
            when u.f is not null then ln({BACKOFF}) + ln(u.f / v.f)
            else 2 * ln({BACKOFF}) + ln(o.f / (select sum(f) from f1)) end as l
        from p left join f3 t on p.a = t.x and p.b = t.y and p.c = t.z left join f2 h on p.a = h.x and p.b = h.y
        left join f2 u on p.b = u.x and p.c = u.y left join f1 v on p.b = v.x join f1 o on p.c = o.x)
    select doc_id, len(w.w)::bigint as n_words, round(coalesce(sum(l), 0), 4) as log_score
    from w left join s on w.k = s.k group by w.k, doc_id, len(w.w)"""
