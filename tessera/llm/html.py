"""Operator 3: the content of HTML pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; the contiguous run of
the largest sum, found by one linear scan, is the content. The weights are learned from labelled pages
(those with exactly one <article> or <main>, whose inside is the content) by a structured perceptron
whose updates keep words positive and tags negative.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chunks import by_batches
from tessera.llm.mixing import hashed
from tessera.plans.columns import pick
from tessera.sources.tables import table

#: Bound of the labelled sample: pages of the lowest hashes of their ids.
LABELLED = 400
EPOCHS = 12
LEAST = 0.05
WORD, OTHER = "word", "other"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<script\b.*?(?:</script\s*>|\Z)|<style\b.*?(?:</style\s*>|\Z)|<[!?/a-zA-Z][^<>]*>?|[^\s<]+|<", re.DOTALL | re.IGNORECASE)
_NAME = re.compile(r"<(/?[a-z][a-z0-9]*)", re.IGNORECASE)
_MARK = {"article", "/article", "main", "/main"}


def _tag(token: str) -> str:
    m = _NAME.match(token)
    return m[1].lower() if m else OTHER


def tokens(page: str) -> list[str]:
    """Words and tags; comments, scripts and styles are one tag each."""
    return _TOKEN.findall(page)


def kind(token: str) -> str:
    """``word`` or the name of the tag, with a slash if it closes."""
    if token[0] != "<" or len(token) == 1:
        return WORD
    return _tag(token)


def best(score: np.ndarray) -> tuple[int, int, float]:
    """(start, end, sum) of the contiguous run of the largest sum; the first such end and the longest
    run to it. (0, 0, 0.0) where no value is positive."""
    if not len(score):
        return 0, 0, 0.0
    upto = np.concatenate([[0.0], np.cumsum(score)])
    gain = upto[1:] - np.minimum.accumulate(upto[:-1])
    end = int(np.argmax(gain)) + 1
    if gain[end - 1] <= 0:
        return 0, 0, 0.0
    return int(np.argmin(upto[:end])), end, float(gain[end - 1])


def label(page: str) -> tuple[list[str], int, int] | None:
    """(kinds, start, end) of a page with one <article> or <main>; those tags count as ``other``, so
    that pages without them are scored alike."""
    kinds = [kind(t) for t in tokens(page)]
    heads = [i for i, k in enumerate(kinds) if k in ("article", "main")]
    tails = [i for i, k in enumerate(kinds) if k in ("/article", "/main")]
    if len(heads) != 1 or len(tails) != 1 or tails[0] <= heads[0] + 1:
        return None
    return [OTHER if k in _MARK else k for k in kinds], heads[0] + 1, tails[0]


def learn(pages: list[str], epochs: int = EPOCHS) -> dict[str, float]:
    """Weights by kind of token; kinds that no labelled page has score as ``other``."""
    rows = [x for x in map(label, pages) if x]
    names = sorted({WORD, OTHER} | {k for kinds, _, _ in rows for k in kinds})
    at = {k: i for i, k in enumerate(names)}
    word = at[WORD]
    low, high = np.full(len(names), -np.inf), np.full(len(names), -LEAST)
    low[word], high[word] = LEAST, np.inf
    w = np.clip(np.where(np.arange(len(names)) == word, 1.0, -1.0), low, high)
    coded = [(np.array([at[k] for k in kinds]), a, b) for kinds, a, b in rows]
    total, steps = w.copy(), 1
    for _ in range(epochs):
        wrong = 0
        for x, a, b in coded:
            s, e, _ = best(w[x])
            if (s, e) != (a, b):
                gold, got = (np.bincount(x[i:j], minlength=len(names)) for i, j in ((a, b), (s, e)))
                change = gold - got
                if change.any():
                    w = np.clip(w + change / max(np.abs(change).max(), 1), low, high)
                    wrong += 1
            total += w
            steps += 1
        if not wrong:
            break
    return dict(zip(names, (total / steps).tolist(), strict=True))


def content(page: str, weights: dict[str, float]) -> tuple[str, float, int]:
    """(text of the best region, its score, words of the page)."""
    found = tokens(page)
    kinds = [kind(t) for t in found]
    other = weights[OTHER]
    score = np.array([weights.get(k, other) for k in kinds])
    a, b, s = best(score)
    words = [t for t, k in zip(found[a:b], kinds[a:b], strict=True) if k == WORD]
    return html.unescape(" ".join(words)), s, sum(k == WORD for k in kinds)


def train(pages: DataFrame, id: str = "page_id", source: str = "html", labelled: int = LABELLED) -> dict[str, float]:
    """Weights from at most ``labelled`` pages that have an <article> or <main>. Pages without an id don't take
    part; of pages that repeat an id the least counts, so that what reaches the driver is bounded."""
    own = pick(pages, id=id, html=source).filter(F.col("id").isNotNull() & F.lower("html").rlike("<(article|main)[ >]"))
    ids = own.select("id").distinct().select("id", hashed(F.col("id")).alias("h"))
    chosen = ids.orderBy("h", "id").limit(labelled).select("id").collect()
    if not chosen:
        return learn([])
    wanted = pages.sparkSession.createDataFrame(chosen, own.select("id").schema)
    rows = own.join(F.broadcast(wanted), "id", "left_semi").groupBy("id").agg(F.min("html").alias("html")).collect()
    return learn([r["html"] for r in sorted(rows, key=lambda r: str(r["id"]))])


def extract(pages: DataFrame, id: str = "page_id", source: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """(id, content, score, n_words, n_page_words) of every page.

    Null, empty and wordless pages have empty content and a score of 0; without labelled pages words
    score 1 and tags -1; unclosed comments and scripts run to the end of the page; of equal regions the
    first and longest is taken; ids may be null or repeated; other columns are not looked at; an empty
    table gives an empty one."""
    own = pick(pages, id=id, html=source)
    shared = weights if weights is not None else train(pages, id, source)
    kind_ = own.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                got = [content(x or "", shared) for x in part.column("html").to_pylist()]
                columns = [part.column("id"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([len(x[0].split()) for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[id, "content", "score", "n_words", "n_page_words"])

    return by_batches(own, run, f"`{id}` {kind_}, content string, score double, n_words bigint, n_page_words bigint")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of every page, by weights from its labelled ones."""
    return extract(table(spark, sf_dir, "pages"))
