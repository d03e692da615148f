"""Operator 5: language identification with string kernels.

The kernel of two texts is the number of byte n-grams (1 to 3 bytes of the lower-cased UTF-8) present
in both, over the geometric mean of the numbers present in each: a blended-spectrum presence kernel.
Landmarks give its Nyström approximation, on which one ridge regression for each language against the
rest is solved in closed form. Scoring is two batched matrix products, presence x landmarks and
kernel x coefficients, on whole texts in one map stage without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.chunks import by_batches
from tessera.llm.mixing import hashed
from tessera.plans.columns import numbered, pick, position
from tessera.sources.tables import table

#: Bound of the labelled sample: rows a language, chosen by the hash of their ids.
PER_LANGUAGE = 400
#: Landmarks a language, the first of its sample.
LANDMARKS = 64
RIDGE = 1e-2
#: Texts whose best one-versus-rest score (targets -1 and 1) is lower have no language. A text that shares
#: nothing with the landmarks scores 0 in each; the best score of other languages and of noise from 60
#: characters on was -0.3 to 0.05 (noise of 20 characters: up to 0.13). Of 3,000 held-out rows of sf0.1,
#: 6 score lower: scraps of a few words, secrets and junk.
LEAST_SCORE = 0.1
UNKNOWN = "und"
_ROWS = 128
_CODES = 256 + 65536 + (1 << 24)


def codes(text: str) -> np.ndarray:
    """Codes of the n-grams of 1, 2 and 3 bytes of a text, in order, each as often as it occurs."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32)
    two = (b[:-1] << 8) | b[1:]
    return np.concatenate([b, two + 256, ((two[:-1] << 8) | b[2:]) + 65792])


def grams(text: str) -> np.ndarray:
    """Codes of the distinct n-grams of a text."""
    return np.unique(codes(text))


def _presence(texts: list[str], place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x known n-grams, 0 or 1; the number of n-grams of each text, known or not)."""
    x, n = np.zeros((len(texts), width), np.float32), np.ones(len(texts), np.float32)
    for i, t in enumerate(texts):
        c = codes(t)
        at = place[c]
        known = at >= 0
        x[i, at[known]] = 1
        n[i] = max(int(x[i].sum()) + len(np.unique(c[~known])), 1)
    return x, n


def _place(known: np.ndarray) -> np.ndarray:
    out = np.full(_CODES, -1, np.int16 if len(known) < 1 << 15 else np.int32)
    out[known] = np.arange(len(known))
    return out


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict | None:
    """The model of labelled texts; None with fewer than two labels. Its size is bounded by the
    landmarks: their presence matrix, packed to bits, and one coefficient a landmark and language."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        return None
    chosen = [i for k in languages for i in [i for i, x in enumerate(labels) if x == k][:landmarks]]
    known = np.unique(np.concatenate([grams(texts[i]) for i in chosen]))
    place = _place(known)
    marks, size = _presence([texts[i] for i in chosen], place, len(known))
    kernel = []
    for lo in range(0, len(texts), _ROWS):
        x, n = _presence(texts[lo : lo + _ROWS], place, len(known))
        kernel.append((x @ marks.T) / np.sqrt(np.outer(n, size)))
    k = np.concatenate(kernel).astype(np.float64)
    values, vectors = np.linalg.eigh(k[chosen])
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = k @ root
    target = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + ridge * len(texts) / len(chosen) * np.eye(phi.shape[1]), phi.T @ target)
    return {"languages": languages, "known": known, "marks": np.packbits(marks.astype(bool), axis=0), "rows": len(chosen), "size": size, "coefficients": (root @ w).astype(np.float32)}


class Scorer:
    """A model unpacked for scoring."""

    def __init__(self, model: dict):
        self.model, self.place = model, _place(model["known"])
        self.marks = np.unpackbits(model["marks"], axis=0, count=model["rows"]).T.astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = []
        for lo in range(0, len(texts), _ROWS):
            x, n = _presence(texts[lo : lo + _ROWS], self.place, len(self.model["known"]))
            k = (x @ self.marks) / np.sqrt(np.outer(n, self.model["size"]))
            out.append(k @ self.model["coefficients"])
        return np.concatenate(out) if out else np.zeros((0, len(self.model["languages"])), np.float32)


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> dict | None:
    """Fits on at most ``per_language`` texts of each language, those of the lowest hashes of their ids. Rows
    without id, text or language don't take part; of rows that repeat an id in a language the least text
    counts, so that what reaches the driver is bounded whatever repeats."""
    own = pick(docs, id=id, text=text, lang=lang).filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    ids = own.select("lang", "id").distinct().withColumn("h", hashed(F.col("id")))
    w = Window.partitionBy("lang").orderBy("h", "id")
    chosen = ids.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_language).select(F.col("lang").alias("_lang"), F.col("id").alias("_id")).collect()
    if not chosen:
        return None
    fields = own.select(F.col("lang").alias("_lang"), F.col("id").alias("_id")).schema
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, fields))
    rows = own.join(wanted, (F.col("lang") == F.col("_lang")) & (F.col("id") == F.col("_id")), "left_semi").groupBy("lang", "id").agg(F.min("text").alias("text"))
    rows = sorted(rows.collect(), key=lambda r: (r["lang"], str(r["id"])))  # one a chosen id
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], landmarks)


def identify(docs: DataFrame, text: str = "text", model: dict | None = None, least: float = LEAST_SCORE, **kw) -> DataFrame:
    """The columns of ``docs`` as ``_c0, ...`` with ``_language`` and ``_score``.

    Null, empty and blank texts, texts under the least score, and all texts when fewer than two
    languages are labelled are "und" (score null if there is none). Ties go to the first language of
    the alphabet. Whole texts count, of any length; repeated rows get equal answers; extra columns pass
    through, whatever their names; an empty table stays empty."""
    model = model or train(docs, text=text, **kw)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    flat, at = numbered(docs), position(docs, text)

    def run(batches):
        scorer = Scorer(shared.value) if shared.value is not None else None  # let go with the task
        for whole in batches:
            for lo in range(0, whole.num_rows, 4 * _ROWS):
                b = whole.slice(lo, 4 * _ROWS)
                texts = [x or "" for x in b.column(at).to_pylist()]
                names, best = [UNKNOWN] * len(texts), [None] * len(texts)
                if scorer is not None:
                    s = scorer.scores(texts)
                    top = s.argmax(axis=1)
                    for i, t in enumerate(texts):
                        if t and not t.isspace():
                            best[i] = float(s[i, top[i]])
                            if best[i] >= least:
                                names[i] = scorer.model["languages"][top[i]]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(best, pa.float64())], names=[*b.schema.names, "_language", "_score"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema.fields)
    return by_batches(flat, run, f"{fields}, _language string, _score double")


def keep_known(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that have a language (see ``identify``), with the same columns."""
    return identify(docs, **kw).filter(F.col("_language") != UNKNOWN).drop("_language", "_score").toDF(*docs.columns)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model trained on a bounded sample of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return identify(docs).select(F.col("_c0").alias("doc_id"), F.col("_c1").alias("lang"), F.col("_language").alias("language"), F.round("_score", 4).alias("score"))
