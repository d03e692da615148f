"""Vectorised splitting of texts into words and hashing of their n-grams.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased text.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.chunks import hash_spans, mix

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

#: The words of a column ``text`` in DuckDB SQL.
WORDS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+')"


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    parts = [x.lower().encode("utf-8", "surrogatepass") for x in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = _WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    bounds = np.cumsum(sizes + 1)
    upto = np.searchsorted(start, bounds)
    return hash_spans(data, start, end - start), np.diff(upto, prepend=0)


_A, _B = np.uint64(0xD1342543DE82EF95), np.uint64(0xA24BAED4963EE407)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i : i + n] for every i with n words left."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * _A + words[k : len(words) - n + 1 + k] * _B + np.uint64(k))
    return out
