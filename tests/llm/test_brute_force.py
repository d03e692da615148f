"""Operators without SQL, against plain loops, a public tokenizer library and held-out labels."""

from __future__ import annotations

import base64
import gzip
import hashlib
import pickle
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import arc, bpe, encoding, html, langid, media, mixing, neardup, prefix, quality
from tessera.sources.tables import table

SAMPLES = ["", "I'll say it's we're they've 'tis don't 'RE 're", "a  b   c \n\n d\t\t", "naïve Ünïcode 日本語 \U0001f600\U0001f600", "x" * 500, " lead", "trail   ", "12345 6.7e8 --- ###", "\r\n\r\n   　z", "'l 'll 'lll 'v've"]


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r["doc_id"]: r["text"] for r in table(spark, data, "documents").collect()}


def test_encoding_is_that_of_the_public_library(spark, data, public, texts):
    auto = bpe.Automaton(bpe.compiled(bpe.load_merges()))
    for t in SAMPLES:
        tokens, counts = bpe.encode(auto, [t])
        assert tokens.tolist() == public.encode(t, add_special_tokens=False).ids
        assert counts.tolist() == [len(tokens)]
    for r in encoding.op6_bpe(spark, data).collect():
        assert r["token_ids"] == public.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["round_trip"]


@settings(deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'srevl 1\n\té日")), max_size=25))
def test_prefix_counts_are_those_of_encoding_each_prefix(text):
    auto = test_prefix_counts_are_those_of_encoding_each_prefix.__dict__.setdefault("auto", bpe.Automaton(bpe.compiled(bpe.load_merges())))
    assert bpe.prefix_counts(auto, [text]).tolist() == [int(bpe.encode(auto, [text[: i + 1]])[1][0]) for i in range(len(text))]


def test_automaton_on_long_runs(public):
    """Runs without blanks: other scripts, one sign, letters, codes; the tables don't grow with them."""
    rnd = random.Random(7)
    auto = bpe.Automaton(bpe.compiled(bpe.load_merges()))
    common = "的一是不了人我在有他这中大来上个国和也子时道说出而要于就下得可你年生"
    long = ["".join(rnd.choices(x, k=3000)) for x in (common, "ab", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "-=_#")] + ["".join(chr(rnd.randint(0x4E00, 0x9FA5)) for _ in range(3000)), "x" * 5000, "-" * 700, base64.b64encode(rnd.randbytes(3000)).decode()]
    size = len(pickle.dumps(auto))
    tokens, counts = bpe.encode(auto, long)
    ends = np.cumsum(counts)
    for t, n, e in zip(long, counts, ends, strict=True):
        assert tokens[e - n : e].tolist() == public.encode(t, add_special_tokens=False).ids
    assert len(pickle.dumps(auto)) == size
    for t in long:
        want = [len(public.encode(t[: i + 1], add_special_tokens=False).ids) for i in range(200)]
        assert bpe.prefix_counts(auto, [t[:200]]).tolist() == want


def test_automaton_of_hand_made_merges():
    """Against merging by rank, over all strings of a small alphabet and random orders of merges."""
    rnd = random.Random(3)
    for _ in range(40):
        vocab, merges = {"a": 0, "b": 1}, []
        while len(merges) < 9:
            x, y = rnd.choice(list(vocab)), rnd.choice(list(vocab))
            if x + y not in vocab and len(x + y) < 9:
                merges.append((vocab[x], vocab[y], len(vocab)))
                vocab[x + y] = len(vocab)
        u, v, w = (np.array(c, np.int32) for c in zip(*merges, strict=True))
        auto = bpe.Automaton(bpe.compiled({"u": u, "v": v, "w": w, "bytes": np.array([0, 1], np.int32), "tokens": [k.replace("a", "\0").replace("b", "\1").encode() for k in vocab]}))
        for _ in range(60):
            data = np.array(rnd.choices((0, 1), k=rnd.randint(1, 40)), np.uint8)
            own = data.tolist()
            for x, y, z in merges:
                i = 0
                while i + 1 < len(own):
                    if (own[i], own[i + 1]) == (x, y):
                        own[i : i + 2] = [z]
                    i += 1
            assert auto.tokens_of(data, np.array([len(data)]))[0].tolist() == own


def test_prefix_counts_of_documents(spark, data, public, texts):
    """Every document of the table: all prefixes of the first ones of up to 1,500 characters, of others some of
    all parts of the text, and the stored answers."""
    from pyspark.sql import functions as F

    rnd = random.Random(11)
    rows = prefix.op8_prefix_counts(spark, data).withColumns({f"at_{n}": prefix.count_at(F.col("prefix_deltas"), F.lit(n)) for n in (-3, 0, 77, 10**9)} | {f"in_{n}": prefix.fit(F.col("prefix_deltas"), F.lit(n)) for n in (-1, 50)})
    count = lambda t: len(public.encode(t, add_special_tokens=False).ids)
    seen = 0
    for r in rows.collect():
        t = texts[r["doc_id"]] or ""
        got = np.cumsum(np.frombuffer(r["prefix_deltas"], np.int8), dtype=int)
        assert len(got) == r["n_chars"] == len(t)
        some = range(len(t)) if len(t) <= 1500 and seen < 12_000 else sorted(rnd.sample(range(len(t)), min(8, len(t))))
        seen += len(t) if len(some) == len(t) else 0
        for i in some:
            assert got[i] == count(t[: i + 1])
        for b in prefix.BUDGETS:
            assert r[f"fit_{b}"] == max(np.flatnonzero(got <= b) + 1, default=0)
        assert (r["at_-3"], r["at_0"], r["at_77"], r["at_1000000000"]) == (0, 0, count(t[:77]), r["n_tokens"])
        assert (r["in_-1"], r["in_50"]) == (0, max(np.flatnonzero(got <= 50) + 1, default=0))
    assert len(texts) == rows.count()


def test_language_of_held_out_documents(spark, data):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs.filter("doc_id % 2 = 0"))
    got = langid.identify(docs.filter("doc_id % 2 = 1").select("doc_id", "lang", "text"), model=model).filter("length(_c2) > 40").collect()
    assert np.mean([r["_c1"] == r["_language"] for r in got]) > 0.97


@given(st.lists(st.integers(-5, 5), max_size=30))
def test_best_run(values):
    a, b, s = html.best(np.array(values, float))
    runs = [sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)]
    assert s == max([0, *runs])
    assert s == 0 or sum(values[a:b]) == s


def test_content_of_held_out_pages(spark):
    pages = [r["html"] for r in table(spark, "/root/testdata/sf0.01", "pages").orderBy("page_id").collect()]
    labelled = [p for p in pages if html.label(p)]
    weights, scores = html.learn(labelled[::2]), []
    for p in labelled[1::2]:
        kinds, a, b = html.label(p)
        toks = html.tokens(p)
        want = [t for t, k in zip(toks[a:b], kinds[a:b], strict=True) if k == html.WORD]
        bare = "".join(" <x> " if html.kind(t) in html._MARK else f" {t} " for t in toks)
        got = set(html.content(bare, weights)[0].split())
        import html as std

        gold = set(std.unescape(" ".join(want)).split())
        scores.append(2 * len(got & gold) / max(len(got) + len(gold), 1))
    assert np.mean(scores) > 0.85


def test_fingerprints_by_plain_loops():
    raw = media.tones(list(np.random.default_rng(3).normal(size=24)))
    rate, blocks = media.read_wav(raw)
    x = np.concatenate(list(blocks))
    assert rate == media.RATE
    w = np.hanning(media.FFT)
    s = np.array([np.abs(np.fft.rfft(x[i : i + media.FFT] * w)) for i in range(0, len(x) - media.FFT + 1, media.HOP)])
    assert np.allclose(s, media.spectrum(x))
    near = lambda i, j: s[max(0, i - media.NEAR[0]) : i + media.NEAR[0] + 1, max(0, j - media.NEAR[1]) : j + media.NEAR[1] + 1]
    at = [(i, j) for i in range(s.shape[0]) for j in range(s.shape[1]) if s[i, j] == near(i, j).max() and s[i, j] >= media.FLOOR * s.max()]
    assert media.peaks([x])[0].tolist() == [list(p) for p in at]
    want = [(a << 32) | (f << 20) | (g << 8) | (b - a) for a, f in at for b, g in [p for p in at if a < p[0] <= a + media.REACH][: media.FAN]]
    assert media.fingerprints(np.array(at)).tolist() == want and want


def test_arc_versions_and_damage():
    def old(v: bytes, tail: bytes) -> bytes:
        body = v + b" 0 X\n" + b" ".join(arc.FIELDS[v]) + b"\n"
        return b"filedesc://f 0.0.0.0 20010101000000 text/plain %d\n" % len(body) + body + b"\n" + tail

    block = b"HTTP/1.0 200 OK\r\n\r\nhello"
    one = old(b"1", b"http://a/ 1.2.3.4 20010203040506 text/html %d\n" % len(block) + block + b"\n")
    rows = list(arc.records("x", one, True))
    assert [r["warc_type"] for r in rows] == ["warcinfo", "response"]
    assert rows[1]["warc_date"] == "2001-02-03T04:05:06Z" and rows[1]["ip_address"] == "1.2.3.4"
    assert rows[1]["payload_digest"] == arc.digest(b"hello") and arc.warc_bytes(rows[1]).endswith(block + b"\r\n\r\n")
    assert [r["record_id"] for r in arc.records("x", gzip.compress(one))] == [r["record_id"] for r in rows]
    two = old(b"2", b"dns:a 1.2.3.4 20010203040506 text/dns 200 - - 0 - 3\nabc\nftp://b 1.2.3.4 2001 text/plain 200 - - 0 - 9\nabc")
    rows = list(arc.records("x", two))
    assert [(r["warc_type"], r["truncated"], r["error"]) for r in rows] == [("warcinfo", None, None), ("response", None, None), ("resource", "length", "bad date")]
    assert list(arc.records("x", old(b"1", b"broken line\n")))[-1]["error"] == "bad record line"


def test_pipeline_by_plain_loops(spark, data, public):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    kept = con.execute(f"select doc_id, text, lang, source, n_chars from ({quality._sql('documents')}) where keep").fetchall()
    docs = spark.createDataFrame(kept, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    model = langid.train(docs)
    marks = [frozenset(model["known"][np.flatnonzero(m)].tolist()) for m in np.unpackbits(model["marks"], axis=0, count=model["rows"])]

    def language(text: str) -> bool:
        own = set(langid.grams(text).tolist())
        k = np.array([len(own & m) / np.sqrt(max(len(own), 1) * n) for m, n in zip(marks, model["size"], strict=True)])
        return (k @ model["coefficients"]).max() >= langid.LEAST_SCORE

    kept = [r for r in kept if language(r[1])]
    word = re.compile("[0-9a-z\u0080-\U0010ffff]+")
    sets = {}
    for r in kept:
        w = word.findall(r[1].lower())
        sets[r[0]] = {tuple(w[i : i + neardup.SHINGLE]) for i in range(max(1, len(w) - neardup.SHINGLE + 1))} if w else set()
    root = {k: k for k in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= neardup.THRESHOLD * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = [r for r in kept if find(r[0]) == r[0]]
    cost = {r[0]: len(re.findall("[^ \t\n\r]+", r[1])) for r in kept}
    code = {r[0]: int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16) for r in kept}
    sources = sorted({r[3] for r in kept})
    weight = {s: mixing.WEIGHTS.get(s, 1) for s in sources}
    share, out = Fraction(corpus_pipeline.MIX_BUDGET[0]), []
    for s in sources:
        left = sum(cost.values()) * share.numerator // (share.denominator * sum(weight.values())) * weight[s]
        for r in sorted((r for r in kept if r[3] == s), key=lambda r: code[r[0]]):
            left -= cost[r[0]]
            if left < 0:
                break
            out.append(r)
    got = {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, data).collect()}
    assert got == {r[0]: public.encode(r[1], add_special_tokens=False).ids for r in out}
