"""Trigram queries of regular expressions, and the inverted index of a segment of texts that answers them.

A query is a set of alternatives, each a set of trigrams that a matching text must hold together; an empty alternative
holds for any text, so its rule has to scan.  Trigrams are of UTF-8 bytes with A-Z folded to a-z, which keeps every
match in reach, whether or not the rule minds case.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np

Query = frozenset[frozenset[bytes]]

ANYTHING: Query = frozenset([frozenset()])
#: Strings that a part of an expression is spelled out to, and alternatives of a query; beyond it the query asks less.
MOST_STRINGS, MOST_ALTERNATIVES = 64, 64
#: Characters of a class that are still spelled out.
MOST_LETTERS = 6
#: Bytes of text looked at in one step.
STEP = 1 << 22

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def either(*queries: Query) -> Query:
    """Without alternatives that ask for more than another one does."""
    found = frozenset().union(*queries)
    least = frozenset(a for a in found if not any(b < a for b in found))
    return least if len(least) <= MOST_ALTERNATIVES else ANYTHING


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_ALTERNATIVES:
        return max(a, b, key=lambda q: min(map(len, q)))
    return either(frozenset(x | y for x in a for y in b))


def trigrams(text: str) -> frozenset[bytes]:
    raw = text.encode().lower()
    return frozenset(raw[i:i + 3] for i in range(len(raw) - 2))


@dataclass(frozen=True)
class Part:
    """What a part of an expression tells: all its strings, if few, else how they begin and end; and its query."""

    strings: frozenset[str] | None
    starts: frozenset[str]
    ends: frozenset[str]
    query: Query

    @staticmethod
    def of(strings: Iterable[str]) -> Part:
        few = frozenset(strings)
        return Part(few, few, few, ANYTHING) if len(few) <= MOST_STRINGS else UNKNOWN

    def all_needed(self) -> Query:
        if self.strings is None:
            return self.query
        return both(self.query, either(frozenset(map(trigrams, self.strings))))


UNKNOWN = Part(None, frozenset([""]), frozenset([""]), ANYTHING)
EMPTY = Part.of([""])


def _cross(a: frozenset[str], b: frozenset[str]) -> frozenset[str] | None:
    return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= MOST_STRINGS else None


def then(a: Part, b: Part) -> Part:
    if a.strings is not None and b.strings is not None and (strings := _cross(a.strings, b.strings)) is not None:
        return Part(strings, strings, strings, both(a.query, b.query))
    meeting = _cross(a.ends, b.starts)
    between = ANYTHING if meeting is None else either(frozenset(map(trigrams, meeting)))
    starts = (_cross(a.strings, b.starts) or a.strings) if a.strings is not None else a.starts
    ends = (_cross(a.ends, b.strings) or b.strings) if b.strings is not None else b.ends
    return Part(None, starts, ends, both(both(a.all_needed(), b.all_needed()), between))


def _repeated(part: Part, least: int, most: int) -> Part:
    if least == 0 and most == 1 and part.strings is not None:
        return Part.of(part.strings | {""})
    if least == 0:
        return UNKNOWN
    whole = part
    for _ in range(min(least, 8) - 1):
        whole = then(whole, part)
    if most == least <= 8:
        return whole
    known = whole.strings
    return Part(None, known if known is not None else whole.starts, known if known is not None else whole.ends, whole.all_needed())


def _letters(items: list) -> Part:
    found: set[str] = set()
    for kind, value in items:
        if kind is C.LITERAL:
            found.add(chr(value))
        elif kind is C.RANGE and value[1] - value[0] < MOST_LETTERS:
            found.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return UNKNOWN
    return Part.of(found) if len(found) <= MOST_LETTERS else UNKNOWN


def _part(tokens: Iterable) -> Part:
    whole = EMPTY
    for kind, value in tokens:
        if kind is C.LITERAL:
            part = Part.of([chr(value)])
        elif kind is C.IN:
            part = _letters(value)
        elif kind is C.BRANCH:
            ways = [_part(way) for way in value[1]]
            if all(w.strings is not None for w in ways):
                part = Part.of(frozenset().union(*(w.strings for w in ways)))
                part = part if part.strings is not None else Part(None, part.starts, part.ends, either(*(w.all_needed() for w in ways)))
            else:
                part = Part(None, frozenset([""]), frozenset([""]), either(*(w.all_needed() for w in ways)))
        elif kind is C.SUBPATTERN:
            part = _part(value[3])
        elif kind is C.ATOMIC_GROUP:
            part = _part(value)
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            part = _repeated(_part(value[2]), value[0], value[1])
        elif kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
            part = EMPTY
        else:  # any character, a back reference, a condition
            part = UNKNOWN
        whole = then(whole, part)
    return whole


def query_of(pattern: str, flags: int = 0) -> Query:
    """The trigrams that every text with a match must hold."""
    return _part(_parser.parse(pattern, flags)).all_needed()


class Vocabulary:
    """The trigrams that some queries ask for, numbered from 1."""

    def __init__(self, queries: Iterable[Query]):
        self.trigrams = sorted({t for q in queries for way in q for t in way})
        self.number = {t: i + 1 for i, t in enumerate(self.trigrams)}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, i in self.number.items():
            self.table[int.from_bytes(t, "big")] = i


class Segment:
    """Postings of a run of texts: for each trigram of the vocabulary, the places of the texts that hold it."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray):
        """data: the texts' bytes; offsets: where each begins, and where the last ends."""
        self.vocabulary, self.n = vocabulary, len(offsets) - 1
        pairs = [np.zeros(0, np.int64)]
        first, last = int(offsets[0]), int(offsets[-1])
        for start in range(first, max(first, last - 2), STEP):
            folded = FOLD[data[start:min(start + STEP + 2, last)]].astype(np.uint32)
            ids = vocabulary.table[(folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]]
            at = np.flatnonzero(ids)
            text = np.searchsorted(offsets, at + start, "right") - 1
            inside = at + start + 3 <= offsets[text + 1]
            pairs.append(np.unique(ids[at[inside]].astype(np.int64) * self.n + text[inside]))
        found = np.unique(np.concatenate(pairs))
        trigram, self.places = found // max(1, self.n), found % max(1, self.n)
        self.starts = np.searchsorted(trigram, np.arange(len(vocabulary.trigrams) + 2))

    def postings(self, trigram: bytes) -> np.ndarray:
        i = self.vocabulary.number[trigram]
        return self.places[self.starts[i]:self.starts[i + 1]]

    def candidates(self, query: Query) -> np.ndarray:
        """Places of the texts that hold all trigrams of some alternative, by intersecting postings, rarest first."""
        found = np.zeros(0, np.int64)
        for way in query:
            if not way:
                return np.arange(self.n)
            lists = sorted(map(self.postings, way), key=len)
            common = lists[0]
            for other in lists[1:]:
                if not len(common):
                    break
                common = np.intersect1d(common, other, assume_unique=True)
            found = np.union1d(found, common)
        return found
