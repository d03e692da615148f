"""The queries without SQL, on their whole tables, against direct versions in plain Python."""

from __future__ import annotations

import gzip
import hashlib
import html as std
import io
import math
import random
import re
import wave

import numpy as np
import pytest

from tessera.llm import arc, html, langid, media
from tessera.llm.queries import QUERIES
from tessera.sources.tables import table


def test_op2_media(spark, data):
    vectors = {r["vec_id"]: r["embedding"] for r in table(spark, data, "embeddings").collect()}
    rows = {r["vec_id"]: r for r in QUERIES["op2_media"](spark, data).collect()}
    assert set(rows) == set(vectors)
    for k, v in vectors.items():
        with wave.open(io.BytesIO(media.tones(v))) as w:
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2") / 32768
        window = np.hanning(media.FFT)
        s = np.array([np.abs(np.fft.rfft(x[i : i + media.FFT] * window)) for i in range(0, len(x) - media.FFT + 1, media.HOP)])
        at = []
        for i, j in np.argwhere(s >= media.FLOOR * s.max()):
            if s[i, j] == s[max(0, i - media.NEAR[0]) : i + media.NEAR[0] + 1, max(0, j - media.NEAR[1]) : j + media.NEAR[1] + 1].max():
                at.append((int(i), int(j)))
        want = [(a << 32) | (f << 20) | (g << 8) | (b - a) for a, f in at for b, g in [p for p in at if a < p[0] <= a + media.REACH][: media.FAN]]
        r = rows[k]
        assert (r["sample_rate"], r["n_samples"], r["n_peaks"], r["fingerprints"]) == (media.RATE, len(x), len(at), want)


def test_media_in_blocks_is_media_at_once():
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=60_000) * 0.1
    x[20_000:30_000] = 0  # silence, with ties at its edges
    x[40_000:44_000] = np.tile(x[40_000:41_000], 4)
    whole, n = media.peaks([x])
    s = media.spectrum(x)
    top = media._largest(media._largest(s, media.NEAR[0], 0), media.NEAR[1], 1)
    assert whole.tolist() == np.argwhere((s == top) & (s >= media.FLOOR * s.max())).tolist()
    assert n == len(x)
    for size in (100, 1000, 7777, 59_999):
        assert media.peaks([x[i : i + size] for i in range(0, len(x), size)])[0].tolist() == whole.tolist()


@pytest.mark.parametrize(("width", "channels"), [(1, 1), (2, 2), (3, 1), (4, 3)])
def test_wav_of_any_width(width, channels):
    rnd = np.random.default_rng(9)
    frames = rnd.integers(0, 255, 5000 * width * channels, dtype=np.uint8).tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(44_100)
        w.writeframes(frames)
    rate, blocks = media.read_wav(out.getvalue(), 999)
    got = np.concatenate(list(blocks))
    value = lambda b: b[0] - 128 if width == 1 else int.from_bytes(b, "little", signed=True)
    flat = [value(frames[i : i + width]) for i in range(0, len(frames), width)]
    want = [sum(flat[i : i + channels]) / channels / (1 << (8 * width - 1)) for i in range(0, len(flat), channels)]
    assert rate == 44_100
    assert np.allclose(got, want)


def test_media_of_odd_rows(spark):
    raw = media.tones([0.1, -0.5, 0.7])
    rows = spark.createDataFrame([(1, raw, "x"), (1, raw, "x"), (None, raw, "x"), (2, raw[:-700], "x"), (3, raw[:50], "x")], "id bigint, wav binary, c string").toDF("id", "wav", "ID")
    got = media.fingerprint(rows).collect()
    assert [r["n_samples"] for r in got] == [768, 768, 768, 418, 3]
    assert got[0]["fingerprints"] == got[1]["fingerprints"] == got[2]["fingerprints"]
    assert media.fingerprint(rows).columns == ["id", "sample_rate", "n_samples", "n_peaks", "fingerprints"]


def _best(score):
    """Kadane's scan: the first end of the largest sum and the longest run to it."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(score):
        if run < 0:
            run, start = 0.0, i
        run += x
        if run > best + 1e-12:
            best, found = run, (start, i + 1)
    return *found, best


def test_op3_html(spark, data):
    pages = {r["page_id"]: r["html"] or "" for r in table(spark, data, "pages").collect()}
    mark = {"article", "/article", "main", "/main"}
    code = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    some = sorted((k for k, p in pages.items() if re.search("<(article|main)[ >]", p.lower())), key=code)[: html.LABELLED]
    gold = []
    for k in sorted(some, key=str):
        kinds = [html.kind(t) for t in html.tokens(pages[k])]
        heads = [i for i, x in enumerate(kinds) if x in ("article", "main")]
        tails = [i for i, x in enumerate(kinds) if x in ("/article", "/main")]
        if len(heads) == len(tails) == 1 and tails[0] > heads[0] + 1:
            gold.append(([html.OTHER if x in mark else x for x in kinds], heads[0] + 1, tails[0]))
    names = sorted({html.WORD, html.OTHER} | {x for kinds, _, _ in gold for x in kinds})
    w = {k: 1.0 if k == html.WORD else -1.0 for k in names}
    total, steps = dict(w), 1
    for _ in range(html.EPOCHS):
        wrong = False
        for kinds, a, b in gold:
            s, e, _ = _best([w[k] for k in kinds])
            change = {k: kinds[a:b].count(k) - kinds[s:e].count(k) for k in set(kinds)}
            most = max(map(abs, change.values()))
            if most:
                for k, c in change.items():
                    w[k] = max(w[k] + c / most, html.LEAST) if k == html.WORD else min(w[k] + c / most, -html.LEAST)
                wrong = True
            total = {k: total[k] + w[k] for k in names}
            steps += 1
        if not wrong:
            break
    w = {k: v / steps for k, v in total.items()}
    rows = {r["page_id"]: r for r in QUERIES["op3_html"](spark, data).collect()}
    assert set(rows) == set(pages)
    for k, p in pages.items():
        found = html.tokens(p)
        score = [w.get(html.kind(t), w[html.OTHER]) for t in found]
        a, b, s = _best(score)
        words = [t for t in found[a:b] if html.kind(t) == html.WORD]
        assert rows[k]["content"] == std.unescape(" ".join(words))
        assert rows[k]["score"] == pytest.approx(s)
        assert rows[k]["n_page_words"] == sum(html.kind(t) == html.WORD for t in found)


def test_html_of_hot_ids_and_odd_rows(spark):
    page = "<div>menu</div><article><p>{} the words of this page</p></article><a>x</a>"
    hot = spark.range(3000).selectExpr("cast(7 as bigint) as page_id", f"replace('{page}', '{{}}', id) as html").unionByName(spark.createDataFrame([(8, page), (None, page), (9, None)], "page_id bigint, html string"))
    seen = []
    keep = html.learn
    try:
        html.learn = lambda pages: seen.extend(pages) or keep(pages)
        html.train(hot)
    finally:
        html.learn = keep
    assert len(seen) == 2  # one a known id, the least of those that repeat it
    clash = hot.limit(3).selectExpr("page_id", "html", "1 as a", "2 as b").toDF("page_id", "html", "HTML", "page_id")
    assert html.extract(clash, weights={"word": 1.0, "other": -1.0}).columns == ["page_id", "content", "score", "n_words", "n_page_words"]
    assert html.best(np.array([1.0, -1.0, 1.0, -5.0, 1.0])) == (0, 1, 1.0)  # of equal regions the first


def test_op5_language(spark, data):
    docs = table(spark, data, "documents").select("doc_id", "text", "lang").collect()
    grams = {r["doc_id"]: {b[i : i + n] for b in [(r["text"] or "").lower().encode()] for n in (1, 2, 3) for i in range(len(b) - n + 1)} for r in docs}
    code = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    languages = sorted({r["lang"] for r in docs})
    sample = []
    for k in languages:
        own = sorted((r["doc_id"] for r in docs if r["lang"] == k and (r["text"] or "").strip(" ")), key=lambda i: (code(i), i))[: langid.PER_LANGUAGE]
        sample += [(k, i) for i in sorted(own, key=str)]
    marks = [i for k in languages for i in [i for x, i in sample if x == k][: langid.LANDMARKS]]
    # only n-grams of the landmarks count as common ones, all n-grams as present
    kernel = lambda i, j: len(grams[i] & grams[j]) / math.sqrt(max(len(grams[i]), 1) * max(len(grams[j]), 1))
    k = np.array([[kernel(i, j) for j in marks] for _, i in sample])
    inner = np.array([[kernel(i, j) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(inner)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = k @ root
    y = np.array([[1.0 if x == t else -1.0 for t in languages] for x, _ in sample])
    w = np.linalg.lstsq(np.vstack([phi, np.sqrt(langid.RIDGE * len(sample) / len(marks)) * np.eye(phi.shape[1])]), np.vstack([y, np.zeros((phi.shape[1], len(languages)))]), rcond=None)[0]
    rows = {r["doc_id"]: r for r in QUERIES["op5_language"](spark, data).collect()}
    assert set(rows) == {r["doc_id"] for r in docs}
    for r in docs:
        s = np.array([kernel(r["doc_id"], j) for j in marks]) @ root @ w
        top = int(s.argmax())
        got = rows[r["doc_id"]]
        assert got["score"] == pytest.approx(s[top], abs=2e-3)
        if abs(s[top] - langid.LEAST_SCORE) > 2e-3 and np.sort(s)[-1] - np.sort(s)[-2] > 2e-3:
            assert got["language"] == (languages[top] if s[top] >= langid.LEAST_SCORE else langid.UNKNOWN)


def test_language_of_hot_ids_and_ties(spark):
    hot = spark.range(3000).selectExpr("id % 2 as doc_id", "concat('some words of a text ', id) as text", "if(id % 2 = 0, 'en', 'xx') as lang")
    seen = []
    keep = langid.fit
    try:
        langid.fit = lambda texts, labels, landmarks: seen.extend(texts) or keep(texts, labels, landmarks)
        langid.train(hot)
    finally:
        langid.fit = keep
    assert sorted(seen) == ["some words of a text 0", "some words of a text 1"]
    same = [("a b c", "en"), ("a b c", "de"), ("x y z", "en"), ("x y z", "de")]
    model = langid.fit([t for t, _ in same], [k for _, k in same])
    assert langid.identify(spark.createDataFrame([("a b c",)], "text string"), model=model, least=-2.0).first()["_language"] == "de"


def _old(records):
    body = b"1 0 X\n" + b" ".join(arc.FIELDS[b"1"]) + b"\n"
    head = b"filedesc://f 0.0.0.0 20010101000000 text/plain %d\n" % len(body) + body + b"\n"
    return [head, *(b"http://a/%d 1.2.3.4 20010203040506 text/html %d\n" % (i, len(x)) + x + b"\n" for i, x in enumerate(records))]


def test_damaged_members_lose_only_themselves():
    parts = _old([b"HTTP/1.0 200 OK\r\n\r\n" + random.Random(i).randbytes(900) for i in range(6)])
    whole = [r["record_id"] for r in arc.records("x", b"".join(parts))]
    assert [r["record_id"] for r in arc.records("x", b"".join(map(gzip.compress, parts)))] == whole
    assert [r["record_id"] for r in arc.records("x", gzip.compress(b"".join(parts)))] == whole
    # records that lie across members
    flat = b"".join(parts)
    assert [r["record_id"] for r in arc.records("x", b"".join(gzip.compress(flat[i : i + 500]) for i in range(0, len(flat), 500)))] == whole
    for bad in range(7):
        members = [bytearray(gzip.compress(p)) for p in parts]
        members[bad][len(members[bad]) // 2] ^= 0xFF
        rows = list(arc.records("x", b"".join(members)))
        assert [r["error"] for r in rows].count("damaged gzip member") == 1
        kept = [r["target_uri"] for r in rows if r["error"] is None]
        assert kept == [None] * (bad > 0) + [f"http://a/{i}" for i in range(6) if i != bad - 1]
    cut = b"".join(map(gzip.compress, parts))[:-40]
    assert [r["error"] for r in arc.records("x", cut)] == [None] * 6 + ["damaged gzip member"]


def test_long_archives_and_clashing_names(spark):
    parts = _old([b"x" * 2000 for _ in range(5000)])
    rows = spark.createDataFrame([("a", bytearray(b"".join(parts)), 1, 2), ("a", bytearray(b"".join(map(gzip.compress, parts[:900]))), 1, 2)], "archive string, content binary, c int, d int").toDF("archive", "content", "CONTENT", "offset")
    got = arc.convert(rows)
    assert got.count() == 5001 + 900
    assert got.filter("error is not null").count() == 0
