"""A byte-pair tokenizer as a deterministic automaton, compiled once from the merges.

The automaton reads tokens: its states are the tokens last read (and the start), an arc a token that may
come next. It starts with the bytes, all of which may follow each other, and takes in the merges one by
one, by rank. The gadget of a merge (u, v) -> w at rank r closes the arc v behind u from r on and opens
arcs w wherever u could be read and v behind it; where another gadget closed v behind u before, w can
never come up and gets no arcs. Closed arcs aren't listed, of which there would be a billion, but kept in
factors: for each token the labels that the right and the left end of its string bear while the merges
are gone through, and from which rank to which. Two tokens have an arc unless a merge joins a label at the
right end of one to a label at the left end of the other while both last. So the size of the tables is that
of the vocabulary, whatever is read; they are made on the driver and sent to workers, who only look up.

A string is read by dynamic programming: for each of its prefixes one token alone ends it that has an arc
from the token before. That gives the token count at every prefix, and the way back the tokens. Strings
are cut beforehand at places that no token of the vocabulary spans, where no merge can reach across.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

from tessera.llm.chunks import gather, hash_spans, mix, pieces, runs

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Rank of what never ends.
_END = np.int32(2**31 - 1)
#: Slots of the table of arcs looked up before; it is overwritten, not grown.
_ARCS = 1 << 17
#: Characters of text whose distinct words are read together.
TEXT_CHARS = 3_000_000
#: Strings still open after so many bytes are read one by one once they are fewer than _FEW.
_DEEP, _FEW = 64, 12


def _byte_letters() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(path: str = DEFAULT_VOCABULARY) -> dict:
    """What workers need of a byte-level BPE file: u, v, w of each merge by rank, the id of each byte,
    and the bytes of each token id. Its size is that of the vocabulary, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocab = _byte_letters(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    u, v, w = (np.array(x, np.int32) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
    spelled = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if all(c in letters for c in s)}
    tokens = [spelled.get(i, b"") for i in range(max(vocab.values()) + 1)]
    return {"u": u, "v": v, "w": w, "bytes": np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32), "tokens": tokens}


def _table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open hash table, at most a quarter full."""
    size = 1 << max(4, (4 * len(keys)).bit_length())
    slots, held = np.full(size, -1, np.int64), np.zeros(size, np.int32)
    at, todo = (mix(keys.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64), np.arange(len(keys))
    while len(todo):
        free = slots[at] == -1
        slots[at[free]] = keys[todo[free]]
        won = slots[at] == keys[todo]
        held[at[won]] = values[todo[won]]
        todo, at = todo[~won], (at[~won] + 1) & (size - 1)
    return slots, held


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The values of the keys, -1 where there are none."""
    slots, held = table
    mask = len(slots) - 1
    at = (mix(keys.astype(np.uint64)) & np.uint64(mask)).astype(np.int64)
    found = slots[at]
    out = np.where(found == keys, held[at], np.int32(-1))
    todo = np.flatnonzero((found != keys) & (found != -1))
    at = at[todo]
    while len(todo):
        at = (at + 1) & mask
        found = slots[at]
        hit = found == keys[todo]
        out[todo[hit]] = held[at[hit]]
        on = ~hit & (found != -1)
        todo, at = todo[on], at[on]
    return out


def _joined(left: list[tuple[int, int, int]], right: list[tuple[int, int, int]], ranks: dict[tuple[int, int], int], below: int) -> bool:
    """Whether a merge of a rank under ``below`` joins the right end of a token to the left end of the next.
    Ends are (label, from rank, to rank). Of merges of one rank the leftmost goes first, so a label is
    gone at the rank that ends it inside the left token, but still there at that inside the right one."""
    for x, since, until in left:
        for y, since2, until2 in right:
            r = ranks.get((x, y))
            if r is not None and r < below and since < r < until and since2 < r <= until2:
                return True
    return False


def compiled(merges: dict) -> dict:
    """The tables of the automaton, by the gadgets of all merges in their order."""
    u, v, w, tokens = merges["u"].tolist(), merges["v"].tolist(), merges["w"].tolist(), merges["tokens"]
    size = len(tokens)
    ranks: dict[tuple[int, int], int] = {}
    for r, pair in enumerate(zip(u, v, strict=True)):
        ranks.setdefault(pair, r)
    right: dict[int, list[tuple[int, int, int]]] = {int(b): [(int(b), -1, int(_END))] for b in merges["bytes"]}
    left = dict(right)
    for r, (a, b, c) in enumerate(zip(u, v, w, strict=True)):
        if a not in right or b not in right or c in right or ranks[a, b] != r:
            continue  # a part that never comes up, or a token made before
        if r <= max(right[a][-1][1], left[b][-1][1]):
            raise ValueError("a merge comes before one that makes its parts")
        if _joined(right[a], left[b], ranks, r):
            continue
        right[c] = [*right[b][:-1], (b, right[b][-1][1], r), (c, r, int(_END))]
        left[c] = [*left[a][:-1], (a, left[a][-1][1], r), (c, r, int(_END))]

    def ends(chains: dict) -> dict:
        flat = [x for t in range(size) for x in chains.get(t, ())]
        label, since, until = (np.array(c, np.int32) for c in zip(*flat, strict=True))
        return {"at": np.cumsum([0, *(len(chains.get(t, ())) for t in range(size))]), "label": label, "since": since, "until": until}

    # the tokens from their last byte back, as a tree: what ends at a place is met on one way
    node_of: dict[int, int] = {}
    ending = [-1]
    for t in right:
        node = 0
        for byte in reversed(tokens[t]):
            key = node * 256 + byte
            if key not in node_of:
                node_of[key] = len(ending)
                ending.append(-1)
            node = node_of[key]
        ending[node] = t
    keys = np.array(list(node_of), np.int64)
    first = np.zeros(256, np.int32)
    for k, n in node_of.items():
        if k < 256:
            first[k] = n
    pairs = np.array([a * size + b for a, b in ranks], np.int64)
    return {"size": size, "tokens": tokens, "right": ends(right), "left": ends(left), "ranks": _table(pairs, np.array(list(ranks.values()), np.int32)), "tree": _table(keys, np.array(list(node_of.values()), np.int32)), "first": first, "ending": np.array(ending, np.int32)}


class Automaton:
    """The compiled tables, for looking up. Nothing in it grows with what is read."""

    def __init__(self, tables: dict):
        self.size, self.right, self.left, self.ranks, self.tree = tables["size"], tables["right"], tables["left"], tables["ranks"], tables["tree"]
        self.first, self.ending = tables["first"], tables["ending"]
        self.lengths = np.array([len(t) for t in tables["tokens"]], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tables["tokens"]), np.uint8)
        self.known, self.open = np.full(_ARCS, -1, np.int64), np.zeros(_ARCS, bool)

    def _arc(self, key: np.ndarray) -> np.ndarray:
        """Whether there is an arc for each (token, next token), by their labels and merges."""
        r, l = self.right, self.left  # noqa: E741
        a, b = key // self.size, key % self.size
        out = np.ones(len(key), bool)
        ra, na, lb, nb = r["at"][a], np.diff(r["at"])[a], l["at"][b], np.diff(l["at"])[b]
        for i in range(int(na.max(initial=0))):
            outer = np.flatnonzero(out & (na > i))
            for j in range(int(nb[outer].max(initial=0))):
                some = outer[out[outer] & (nb[outer] > j)]
                x, y = ra[some] + i, lb[some] + j
                rank = _find(self.ranks, r["label"][x].astype(np.int64) * self.size + l["label"][y])
                out[some] = ~((rank >= 0) & (r["since"][x] < rank) & (rank < r["until"][x]) & (l["since"][y] < rank) & (rank <= l["until"][y]))
        return out

    def arc(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b may be read behind token a; arcs met before are looked up in one step."""
        key = a.astype(np.int64) * self.size + b
        at = (mix(key.astype(np.uint64)) & np.uint64(_ARCS - 1)).astype(np.int64)
        lost = np.flatnonzero(self.known[at] != key)
        out = self.open[at]
        if len(lost):
            new, back = np.unique(key[lost], return_inverse=True)
            found = self._arc(new)
            out[lost] = found[back]
            slot = (mix(new.astype(np.uint64)) & np.uint64(_ARCS - 1)).astype(np.int64)
            self.known[slot], self.open[slot] = new, found
            clash = self.known[slot] != new  # of two arcs in one slot the last written stays
            self.open[slot[~clash]] = found[~clash]
        return out

    def _endings(self, data: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens that end at each byte, longest first, joined; where those of each byte begin; length of
        the longest). ``depth`` is the number of bytes of the string up to each byte."""
        at, node, found, n = np.arange(len(data), dtype=np.int32), self.first[data], [], 1
        count, longest = np.zeros(len(data) + 1, np.int64), np.ones(len(data), np.int32)
        while len(at):
            token = self.ending[node]
            some = token >= 0
            own = at[some]
            found.append((own, token[some]))
            count[own + 1] += 1
            longest[own] = n
            more = depth[at] > n
            at, node = at[more], node[more]
            node = _find(self.tree, node.astype(np.int64) * 256 + data[at - n])
            at, node, n = at[node >= 0], node[node >= 0], n + 1
        begin = np.cumsum(count)
        out, fill = np.zeros(int(begin[-1]), np.int32), begin[:-1].copy()
        for own, token in reversed(found):
            out[fill[own]] = token
            fill[own] += 1
        return out, begin, longest

    def read(self, data: np.ndarray, length: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last token at each byte, token count at each byte, where pieces that no token reaches out of
        begin) of strings joined in ``data``, of ``length`` bytes each. Without ``every`` only bytes on the
        way back from the ends of the pieces have tokens, and counts start anew with each."""
        n = len(data)
        token, count = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        if not n:
            return token, count, np.zeros(0, np.int64)
        tokens, begin, longest = self._endings(data, runs(length) + 1)
        head = np.arange(n) - longest + 1
        cut = np.minimum.accumulate(head[::-1])[::-1] >= np.arange(n)
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, n))
        last = start + size - 1
        if not every:
            one = longest[last] == size
            token[last[one]], count[last[one]] = tokens[begin[last[one]]], 1
            start, size = start[~one], size[~one]
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        for d in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -d, side="left"))
            if d >= _DEEP and k < _FEW:
                for a, m in zip(start[:k].tolist(), size[:k].tolist(), strict=True):
                    self._read_on(tokens, begin, token, count, a, d, m)
                break
            at = start[:k] + d
            pick, todo = begin[at], np.arange(k)
            while len(todo):
                t = tokens[pick]
                m = self.lengths[t]
                back = at[todo] - m
                whole = m == d + 1
                ok = whole.copy()
                rest = np.flatnonzero(~whole)
                ok[rest] = self.arc(token[back[rest]], t[rest])
                own = at[todo[ok]]
                token[own] = t[ok]
                count[own] = np.where(whole[ok], 0, count[back[ok]]) + 1
                todo, pick = todo[~ok], pick[~ok] + 1
        if every:
            # counts go on where strings were cut
            sums = np.cumsum(np.where(np.append(cut[1:], True), count, 0))
            before = np.concatenate([[0], sums])[np.flatnonzero(cut)]
            ends = np.cumsum(length)
            base = np.concatenate([[0], sums])[(ends - length)[length > 0]]
            total = np.repeat(before, np.diff(np.append(np.flatnonzero(cut), n))) - np.repeat(base, length[length > 0])
            count = count + total.astype(np.int32)
        return token, count, np.flatnonzero(cut)

    def _read_on(self, tokens: np.ndarray, begin: np.ndarray, token: np.ndarray, count: np.ndarray, a: int, d: int, m: int) -> None:
        """The same, one byte after the other, for the bytes d .. m - 1 of one string that begins at a."""
        own, counts, seen = token[a : a + d].tolist(), count[a : a + d].tolist(), {}
        lo, size, lengths = begin[a + d : a + m + 1].tolist(), self.size, self.lengths
        some = tokens[lo[0] : lo[-1]]
        all_, spans = some.tolist(), lengths[some].tolist()
        for i in range(d, m):
            for k in range(lo[i - d] - lo[0], lo[i - d + 1] - lo[0]):
                t, back = all_[k], i - spans[k]
                if back < 0:
                    break
                key = own[back] * size + t
                ok = seen.get(key)
                if ok is None:
                    ok = seen[key] = bool(self.arc(np.array([own[back]]), np.array([t]))[0])
                if ok:
                    break
            own.append(t)
            counts.append(counts[back] + 1 if back >= 0 else 1)
        token[a : a + m], count[a : a + m] = own, counts

    def tokens_of(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of the strings joined in ``data``; how many each has), by going back over their pieces."""
        token, count, first = self.read(data, length, every=False)
        start = first
        at = np.append(start[1:], len(data))[: len(start)] - 1
        own = count[at].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(own)])
        out, spot = np.zeros(int(upto[-1]), np.int32), upto[1:] - 1
        while len(at) >= _FEW:
            t = token[at]
            out[spot] = t
            at = at - self.lengths[t]
            more = at >= start
            at, spot, start = at[more], spot[more] - 1, start[more]
        for a, k, head in zip(at.tolist(), spot.tolist(), start.tolist(), strict=True):
            held = token[head : a + 1].tolist()
            i = a - head
            while i >= 0:
                out[k] = held[i]
                i, k = i - int(self.lengths[held[i]]), k - 1
        # a string begins where one of its pieces does
        return out, np.diff(upto[np.searchsorted(first, np.concatenate([[0], np.cumsum(length)]))])

    def counts_of(self, strings: list[bytes]) -> np.ndarray:
        """Token counts of whole strings, each of at least one byte."""
        length = np.fromiter(map(len, strings), np.int64, len(strings))
        count = self.read(np.frombuffer(b"".join(strings), np.uint8), length, every=True)[1]
        return count[np.cumsum(length) - 1].astype(np.int64)

    def spell(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes of the labels, joined; how many each has)."""
        n = self.lengths[tokens]
        return gather(self.flat, self.starts[tokens], n), n


# -- pre-splitting

_LETTER, _DIGIT, _SPACE, _OTHER = range(4)
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def _classes() -> np.ndarray:
    kind = {"L": _LETTER, "N": _DIGIT}
    out = np.array([kind.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)], np.uint8)
    out[_WHITE] = _SPACE
    return out


def split(texts: list[str]) -> dict:
    """Splits texts as the pattern of the byte-level vocabularies does:
    's 't 're 've 'm 'll 'd, letters, digits or other signs with one blank before them, white space.

    Returns bytes, start and length of each word, words of each text, and for the words' prefixes the
    code points: cp, chars (first character of each word), char_bytes (bytes of each character)."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    data = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    if not n:
        none = np.zeros(0, np.int64)
        return {"data": data, "start": none, "length": none, "words": np.zeros(len(texts), np.int64), "cp": cp, "chars": none, "width": width, "cls": np.zeros(0, np.uint8), "first": np.zeros(0, bool)}
    cls = _classes()[np.minimum(cp, 0x10FFFF)]
    first = np.zeros(n + 1, bool)
    first[0] = first[ends] = True
    run = first.copy()
    run[1:n] |= cls[1:] != cls[:-1]
    begin = run.copy()
    #: last characters of white space that other signs of the same text follow
    last = np.flatnonzero((cls[:-1] == _SPACE) & run[1:n] & ~first[1:n])
    begin[last] = True
    blank = last[cp[last] == 32]
    begin[blank + 1] = False
    quote = np.flatnonzero((cp == 39) & begin[:n] & run[1:])
    if len(quote):
        pad = np.concatenate([cp, np.zeros(3, np.uint32)])
        one, two = pad[quote + 1], pad[quote + 2]
        in1, in2 = ~first[quote + 1], ~first[np.minimum(quote + 2, n)] & (quote + 2 < n)
        short = in1 & np.isin(one, [ord(c) for c in "stmd"])
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        pair &= in1 & in2 & ~short
        for which, k in ((short, 2), (pair, 3)):
            q = quote[which]
            begin[q + 1] = False
            begin[q + k] = True
    at = np.flatnonzero(begin[:n])
    byte = np.concatenate([[0], np.cumsum(width)])
    start = byte[at]
    return {
        "data": data, "start": start, "length": np.diff(np.append(start, byte[n])), "words": np.diff(np.searchsorted(at, ends), prepend=0),
        "cp": cp, "chars": at, "width": width, "cls": cls, "first": first[:n],
    }


class Words:
    """The distinct words of many texts, gathered piece by piece, so that each is read once."""

    def __init__(self):
        self.keys, self.data, self.lengths, self.places = [], [], [], []

    def add(self, parts: dict) -> None:
        """The words of one piece (see ``split``)."""
        key, one, at = np.unique(hash_spans(parts["data"], parts["start"], parts["length"]), return_index=True, return_inverse=True)
        length = parts["length"][one]
        self.keys.append(key)
        self.lengths.append(length)
        self.data.append(gather(parts["data"], parts["start"][one], length))
        self.places.append(at.astype(np.int32))

    def joined(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(bytes of all distinct words; their lengths; for each piece the place of each of its words)."""
        length = np.concatenate([np.zeros(0, np.int64), *self.lengths])
        _, one, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.keys]), return_index=True, return_inverse=True)
        data = np.concatenate([np.zeros(0, np.uint8), *self.data])
        ends = np.cumsum([len(k) for k in self.keys])
        own = [at[e - len(k) : e][p] for k, e, p in zip(self.keys, ends, self.places, strict=True)]
        return gather(data, (np.cumsum(length) - length)[one], length[one]), length[one], own


def _pieces(texts: list[str]) -> list[list[str]]:
    return [own for _, own in pieces(pa.nulls(len(texts)), texts)]


def encode(automaton: Automaton, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all texts, joined; how many each text has)."""
    words, per_text = Words(), []
    for own in _pieces(texts):
        parts = split(own)
        words.add(parts)
        per_text.append(parts["words"])
    data, length, places = words.joined()
    flat, count = automaton.tokens_of(data, length)
    offset = np.cumsum(count) - count
    tokens, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at, n in zip(places, per_text, strict=True):
        tokens.append(gather(flat, offset[at], count[at]))
        upto = np.concatenate([[0], np.cumsum(count[at])])
        counts.append(np.diff(upto[np.concatenate([[0], np.cumsum(n)])]))
    return np.concatenate(tokens), np.concatenate(counts)


def prefix_counts(automaton: Automaton, texts: list[str]) -> np.ndarray:
    """The exact token count of every prefix (1, 2, ... characters) of every text, joined.

    c(i) = tokens of the words before + c(back) + 1 inside the word, where back is where the last token
    begins. Prefixes that end where the split of the prefix differs from that of the text (in white
    space, and between the letters of 're 've 'll) are counted as they would be split."""
    words = Words()
    for own in _pieces(texts):
        words.add(split(own))
    data, length, places = words.joined()
    flat = automaton.read(data, length, every=True)[1].astype(np.int64)
    offset = np.cumsum(length) - length
    found = [_piece_counts(automaton, split(own), flat, offset[at], length[at]) for own, at in zip(_pieces(texts), places, strict=True)]
    return np.concatenate([np.zeros(0, np.int64), *found])


def _piece_counts(automaton: Automaton, parts: dict, flat: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The same for the texts of one piece, from the counts inside its words."""
    n = len(parts["cp"])
    if not n:
        return np.zeros(0, np.int64)
    by_byte = gather(flat, at, length)
    upto = np.cumsum(parts["width"])
    inner = by_byte[upto - 1]
    total = flat[at + length - 1]
    before = np.cumsum(total) - total
    text_first = np.concatenate([[0], np.cumsum(parts["words"])[:-1]])
    has = parts["words"] > 0
    base = np.zeros(len(parts["words"]), np.int64)
    base[has] = before[text_first[has]]
    before = before - np.repeat(base, parts["words"])
    chars = np.diff(np.append(parts["chars"], n))
    out = np.repeat(before, chars) + inner
    _white_prefixes(automaton, parts, out, before)
    _quote_prefixes(automaton, parts, out, before, chars)
    return out


def _white_prefixes(automaton: Automaton, parts: dict, out: np.ndarray, before: np.ndarray) -> None:
    """A prefix that ends with white space has all of that run as one word. The run of two or more
    is split before its last character when other signs follow; that prefix alone changes."""
    cls, first, n = parts["cls"], parts["first"], len(out)
    white = cls == _SPACE
    i = np.flatnonzero(white[1:] & white[:-1] & ~first[1:]) + 1
    i = i[(i + 1 < n)]
    i = i[~white[i + 1] & ~first[i + 1]] if len(i) else i
    if not len(i):
        return
    word = np.searchsorted(parts["chars"], i, side="right") - 1
    head = word - 1  # the run without its last character is the word before
    upto = np.concatenate([[0], np.cumsum(parts["width"])])
    lo, hi = upto[parts["chars"][head]], upto[i + 1]
    seen = {x: k for k, x in enumerate(dict.fromkeys(parts["data"][a:b].tobytes() for a, b in zip(lo, hi, strict=True)))}
    whole = automaton.counts_of(list(seen))
    out[i] = before[head] + whole[[seen[parts["data"][a:b].tobytes()] for a, b in zip(lo, hi, strict=True)]]


def _quote_prefixes(automaton: Automaton, parts: dict, out: np.ndarray, before: np.ndarray, chars: np.ndarray) -> None:
    """'re, 've and 'll: cut after their first letter, the quote and the letter are two words."""
    at, cp = parts["chars"], parts["cp"]
    w = np.flatnonzero((chars == 3) & (cp[at] == 39))
    if not len(w):
        return
    w = w[parts["cls"][at[w] + 1] == _LETTER]
    for i in w:
        text = "".join(map(chr, cp[at[i] : at[i] + 2])).encode()
        out[at[i] + 1] = before[i] + automaton.counts_of([text[:1], text[1:]]).sum()
