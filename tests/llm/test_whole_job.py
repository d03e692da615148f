"""Cases that a cut of the work would get wrong, each by brute force or by construction."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from tessera.llm import langid, lm, mixing, neardup, quality
from tessera.sources.tables import table

UNSEEN = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах. ",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. ",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. ",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. ",
    "123 456 7890 42 ",
    "$$$ %%% ",
]


def test_unseen_languages_and_noise_have_no_language(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs.filter("doc_id % 2 = 0"))
    noise = random.Random(5)
    letters = ["".join(noise.choices("abcdefghijklmnopqrstuvwxyz ", k=400)) for _ in range(40)]
    rows = spark.createDataFrame([(t * k,) for t in UNSEEN for k in (1, 20)] + [(t,) for t in letters], "text string")
    assert {r["_language"] for r in langid.identify(rows, model=model).collect()} == {langid.UNKNOWN}
    assert langid.keep_known(rows, model=model).count() == 0
    own = langid.identify(docs.filter("doc_id % 2 = 1").select("text"), model=model).filter("length(_c0) > 40").collect()
    assert sum(r["_language"] == langid.UNKNOWN for r in own) < 0.01 * len(own)


def test_backoff_counts_what_occurs_once(spark, data):
    docs = table(spark, data, "documents").select("doc_id", "text")
    words = {r["doc_id"]: re.findall("[0-9a-z\u0080-\U0010ffff]+", (r["text"] or "").lower()) for r in docs.collect()}
    f = [Counter(tuple(w[i : i + n]) for w in words.values() for i in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total = sum(f[0].values())

    def s(w, i):
        if i > 1:
            return math.log(f[2][tuple(w[i - 2 : i + 1])] / f[1][tuple(w[i - 2 : i])])
        if i:
            return math.log(lm.BACKOFF) + math.log(f[1][tuple(w[i - 1 : i + 1])] / f[0][(w[i - 1],)])
        return 2 * math.log(lm.BACKOFF) + math.log(f[0][(w[i],)] / total)

    want = {k: sum(s(w, i) for i in range(len(w))) for k, w in words.items()}
    assert {r["doc_id"]: r["log_score"] for r in lm.op9_backoff(spark, data).collect()} == pytest.approx(want, abs=1e-3)


def test_quality_of_very_long_documents(spark):
    d = "/root/testdata/sf0.1"
    good = duckdb.execute(f"select min(text) from '{d}/documents.parquet' join '{d}/labels.parquet' using (doc_id) where lang = 'en' and quality = 1 group by text order by min(doc_id)").fetchall()
    prose = [w for (t,) in good for w in re.findall("[^ \t\n\r]+", t)]
    prose = prose[:200_000]
    passage = prose[:2000]
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source")
    long = [(-1, " ".join(prose)), (-2, " ".join(passage * 50)), (-3, "spam and ham " * 20_000)]
    rows = spark.createDataFrame([(i, t, "en", f"src{k}") for i, t in long for k in range(2)], docs.schema)
    kept = [r["doc_id"] for r in quality.keep_good(docs.unionByName(rows)).filter("doc_id < 0").select("doc_id").collect()]
    assert len(prose) == 200_000
    assert kept == [-1] * 2
    got = {r["_c0"]: r["_m2"] for r in quality.judge(rows.filter("source = 'src0'")).select("_c0", "_m2").collect()}
    for i, t in long:
        w = t.split()
        near = 1 - sum(len(set(w[a : a + quality.WINDOW])) for a in range(0, len(w), quality.WINDOW)) / len(w)
        far = [tuple(w[a : a + quality.PASSAGE]) for a in range(len(w) - quality.PASSAGE + 1)]
        assert got[i] == pytest.approx(max(near, 1 - len(set(far)) / len(far)), abs=1e-9)


def test_quality_keeps_the_good_and_drops_the_bad(spark):
    d = "/root/testdata/sf0.1"
    kept = {r["doc_id"] for r in quality.keep_good(table(spark, d, "documents")).select("doc_id").collect()}
    rows = duckdb.execute(f"select doc_id, quality, len(string_split(text, ' ')) > 50 from '{d}/labels.parquet' join '{d}/documents.parquet' using (doc_id)").fetchall()
    share = lambda q, long: sum(i in kept for i, k, n in rows if k == q and n >= long) / sum(k == q and n >= long for _, k, n in rows)
    assert share(1, True) > 0.999
    assert share(1, False) > 0.998
    assert share(0, False) < 0.03


def test_quality_fences_of_thinned_sketches_and_their_levels(spark):
    """Groups of 30,000 rows, whose sketches are thinned: each quartile lies within a rank of 0.5 % of the
    exact one. A small group takes the fences of its language, a small language those of the corpus."""
    word = "concat(repeat('x', 2 + cast(pmod(hash(id, k), 17) as int)), repeat('.', cast(pmod(hash(id, k, 1), 3) as int)))"
    docs = spark.range(60_000).selectExpr("id as doc_id", f"concat_ws(' ', transform(sequence(1, 12 + cast(id % 31 as int)), k -> {word})) as text", "'en' as lang", "concat('s', id % 2) as source")
    tiny = spark.range(20).selectExpr("id as doc_id", "'one two three' as text", "if(id < 15, 'en', 'de') as lang", "'tiny' as source")
    docs = docs.unionByName(tiny)
    rules = tuple(quality.Rule(r.name, 0.0, 0.0) for r in quality.RULES)  # fences at the quartiles themselves
    got = {(r["lang"], r["source"]): r for r in quality.fences(docs, rules=rules).collect()}
    assert {k: r["level"] for k, r in got.items()} == {("en", "s0"): "source", ("en", "s1"): "source", ("en", "tiny"): "language", ("de", "tiny"): "corpus"}
    from pyspark.sql import functions as F

    values = docs.select("lang", "source", *(c.alias(k) for k, c in quality.measures(F.col("text")).items())).toPandas()
    for key, level in (("s0", "source"), ("s1", "source"), ("tiny", "language")):
        own = values[(values["lang"] == "en") & ((values["source"] == key) | (level == "language"))]
        for r in rules:
            for name, q in (("min", 0.25), ("max", 0.75)):
                x = got["en", key][f"{r.name}_{name}"]
                assert (own[r.name] < x).mean() - 0.005 <= q <= (own[r.name] <= x).mean() + 0.005


def test_quality_ties_at_the_fence(spark):
    """All values equal: the spread is 0 at every level and each document lies on its fences."""
    docs = spark.range(200).selectExpr("id as doc_id", "'some words of one text' as text", "cast(null as string) as lang", "if(id < 100, 'a', null) as source")
    assert quality.keep_good(docs).count() == 200


def _counted(monkeypatch):
    """The number of rows of each table that an operator writes."""
    from tessera.plans.scratch import Scratch

    rows, write = {}, Scratch.write

    def counting(self, df, name):
        out = write(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "write", counting)
    return rows


@pytest.mark.parametrize("share", [0.25, 0.45])
def test_documents_that_share_a_passage_cost_no_square_of_pairs(spark, monkeypatch, share):
    """2,000 documents with one passage in common, and 40 pairs of near copies among them."""
    rnd = random.Random(13)
    words = 120
    passage = [f"p{i}" for i in range(int(words * share))]
    texts = []
    for k in range(2000):
        own = [f"w{rnd.randrange(10**9)}" for _ in range(words - len(passage))]
        cut = rnd.randrange(len(own))
        texts.append((k, " ".join(own[:cut] + passage + own[cut:])))
    for k in range(40):
        w = texts[k * 7][1].split()
        w[5] = "other"
        texts.append((5000 + k, " ".join(w)))
    rows = _counted(monkeypatch)
    got = {tuple(r) for r in neardup.groups(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {(x, k * 7) for k in range(40) for x in (k * 7, 5000 + k)}
    assert rows["stars"] + rows["rest"] < 10 * len(texts)


def test_groups_are_those_of_all_pairs(spark):
    """Copies, near copies and templates of several shares, in lists of over SHORT nodes: by brute force."""
    rnd = random.Random(17)
    texts = []
    for t in range(3):
        template = [f"t{t}x{i}" for i in range(60)]
        for k in range(60):
            n = rnd.choice([15, 25, 35, 45, 60, 120])
            body = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
            texts.append(" ".join(template + body if k % 2 else body + template))
            if k % 6 == 0:
                texts.append(" ".join(template[: rnd.randrange(30, 60)] + body))
    docs = list(enumerate(texts))
    sets = {i: {tuple(w[j : j + neardup.SHINGLE]) for j in range(len(w) - neardup.SHINGLE + 1)} for i, t in docs for w in [t.split()]}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in range(a + 1, len(docs)):
            both = len(sets[a] & sets[b])
            if both >= neardup.THRESHOLD * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    size = Counter(map(find, sets))
    want = {(i, find(i)) for i in sets if size[find(i)] > 1}
    assert {tuple(r) for r in neardup.groups(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()} == want
    assert len(want) > 50


def test_repeated_ids_with_different_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(5, one), (5, two), (2, one), (9, two + " end"), (7, "something else altogether")], "doc_id bigint, text string")
    assert {r["doc_id"] for r in neardup.groups(docs).collect()} == {2, 5, 9}
    assert sorted(r["doc_id"] for r in neardup.drop_copies(docs).collect()) in ([2, 5, 7], [2, 7], [2, 7, 9])


def test_mixing_budgets_met_exactly_and_null_sources(spark):
    docs = spark.range(100).selectExpr("id as doc_id", "'w w w w' as text", "cast(null as string) as source")
    assert mixing.take(docs, budgets=("1/1",)).count() == 100
    assert mixing.take(docs, budgets=("1/4",)).count() == 25  # 100 of 400 tokens, met to the token
    assert mixing.take(docs, budgets=("99/400",)).count() == 24
