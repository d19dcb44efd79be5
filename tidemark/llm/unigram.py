"""Token counts of a unigram vocabulary without building the tokens.

An Aho-Corasick automaton lists all vocabulary pieces that end at each character; dynamic programming keeps, per character,
the score of the best segmentation so far and the number of its pieces, nothing else. Ties go as in the tokenizer: among
segmentations of equal score the one whose last piece begins earliest. A character that no piece of length one covers may
also be one unknown piece, scored ten below the least score; it counts as its UTF-8 bytes where the vocabulary has byte
pieces, else neighbouring unknown characters count as one.

Spaces become the mark, and a mark is put first. Where the vocabulary has the mark only at the start of pieces (but for
pieces of marks alone), no piece goes over the place before a mark that follows another character, so words are
counted one by one and a word that returns is looked up.

Null and empty texts have no tokens. Extra columns stay as they are.
"""

from __future__ import annotations

import math
import struct

import ahocorasick
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import add_from, text_of

MARK = "▁"
PENALTY = 10.0
CACHED_WORDS = 600_000
#: Kinds of pieces in a vocabulary file; control, unused and byte pieces never match text.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MATCHING = (NORMAL, USER)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """Number and content of the fields of a serialised message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """``(piece, score, kind)`` of a vocabulary file in the public piece model format."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            out.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
    return out


class Counter(dict):
    """Counts of words met so far, up to a bound, and the automaton that counts new ones."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        super().__init__()
        normal = [s for _, s, kind in pieces if kind == NORMAL]
        low, high = min(normal, default=0.0), max(normal, default=0.0)
        self.unknown = low - PENALTY
        self.bytes = any(kind == BYTE for *_, kind in pieces)
        self.automaton = ahocorasick.Automaton()
        live = [(p, s if kind == NORMAL else len(p) * high - 0.1) for p, s, kind in pieces if kind in MATCHING]
        for piece, s in live:
            self.automaton.add_word(piece, (len(piece), s))
        self.automaton.make_automaton()
        self.singles = {p for p, _ in live if len(p) == 1}
        inner = any(MARK in p[1:] and p.strip(MARK) for p, _ in live) or any(p.endswith(MARK) and p.strip(MARK) for p, _ in live)
        # without such pieces the text falls apart before the marks that end a word
        self.whole = inner
        self.split = (lambda t: [t]) if inner else regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def __missing__(self, word: str) -> int:
        """``word`` as between single spaces; the mark before it counts."""
        if len(self) > CACHED_WORDS:
            self.clear()
        count = self.best(MARK + word)
        if len(word) < 48:
            self[word] = count
        return count

    def best(self, word: str) -> int:
        """Pieces of the best segmentation."""
        n = len(word)
        if self.singles.issuperset(word):  # no unknown character: matches come by their end, the longest first
            score, count = [0.0] + [-math.inf] * n, [0] * (n + 1)
            for last, (length, s) in self.automaton.iter(word):
                start = last + 1 - length
                total = score[start] + s
                if total > score[last + 1]:
                    score[last + 1], count[last + 1] = total, count[start] + 1
            return count[n]
        score, count, unknown = [0.0] + [-math.inf] * n, [0] * (n + 1), [False] * (n + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (length, s) in self.automaton.iter(word):
            found[last + 1].append((length, s))
        for end in range(1, n + 1):
            single = False
            # the longest piece begins earliest: it is tried first and kept on ties
            for length, s in sorted(found[end], reverse=True):
                single |= length == 1
                total = score[end - length] + s
                if total > score[end]:
                    score[end], count[end], unknown[end] = total, count[end - length] + 1, False
            if not single:
                total = score[end - 1] + self.unknown
                if total > score[end]:
                    extra = len(word[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not unknown[end - 1])
                    score[end], count[end], unknown[end] = total, count[end - 1] + extra, not self.bytes
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = text.split(" ")
        if self.whole or MARK in text or "" in words:
            return sum(map(self.best, self.split(MARK + text.replace(" ", MARK))))
        return sum(map(self.__getitem__, words))


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float, int]], keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with ``n_tokens`` of every whole text."""
    box = docs.sparkSession.sparkContext.broadcast(pieces)  # the vocabulary file

    def make_step():
        counter = Counter(box.value)
        return lambda texts: {"n_tokens": [counter.count(t) for t in texts.to_pylist()]}

    return add_from(docs, text_of(), make_step, "n_tokens long", keep)
