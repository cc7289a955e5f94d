"""Many patterns at once: an automaton (Aho-Corasick) runs over a text once, however many patterns there are.

Values are found by the automaton itself. For the signatures of a feed it finds the literals that their patterns can't match without;
only signatures with such a literal in the text are searched for. Patterns are those of Python's re.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from re import _constants as op
from re import _parser

import ahocorasick
import numpy as np
import pyarrow as pa


def automaton(words: Iterable[tuple[str, object]]) -> ahocorasick.Automaton:
    """An automaton that gives the list of a word's values at each of its places; empty words are left out."""
    grouped: dict[str, list] = {}
    for word, value in words:
        if word:
            grouped.setdefault(word, []).append(value)
    made = ahocorasick.Automaton()
    for word, values in grouped.items():
        made.add_word(word, (len(word), values))
    made.make_automaton()
    return made


def occurrences(made: ahocorasick.Automaton, text: str | None, overlapping: bool = False) -> Iterator[tuple[int, int, list]]:
    """(start, end, values) of the words in a text, in code points; of places of one word that overlap only the leftmost, unless overlapping."""
    free: dict[int, int] = {}  # by the list of values: from where on a word may stand again
    for last, (length, values) in made.iter(text) if text and len(made) else ():
        start, end = last + 1 - length, last + 1
        if overlapping or start >= free.get(id(values), 0):
            free[id(values)] = end
            yield start, end, values


def _meets_itself(word: str) -> bool:
    return any(word.startswith(word[k:]) for k in range(1, len(word)))


class Values:
    """Known values (word, kind) and an automaton of their numbers; the places in a text are columns, as there may be one for each letter."""

    def __init__(self, pairs: Iterable[tuple[str, str | None]]):
        grouped: dict[str, list] = {}
        for word, kind in pairs:
            if word:
                grouped.setdefault(word, []).append(kind)
        self.made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(grouped):
            self.made.add_word(word, i)
        self.made.make_automaton()
        self.words = pa.array(list(grouped), pa.string())
        self.lengths = np.array([len(w) for w in grouped], np.int64)
        self.meets = np.array([_meets_itself(w) for w in grouped], bool)
        kinds = [sorted(k, key=lambda k: (k is not None, k)) for k in grouped.values()]
        self.kinds = pa.array([*chain.from_iterable(kinds)], pa.string())
        self.counts = np.array([len(k) for k in kinds], np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts

    def places(self, text: str | None, overlapping: bool = False) -> np.ndarray:
        """Rows of start, end, word and kind (numbers of words and kinds), in the order of start, end and kind; as in occurrences()."""
        if not text or not len(self.lengths):
            return np.empty((4, 0), np.int64)
        last, word = np.fromiter(chain.from_iterable(self.made.iter(text)), np.int64).reshape(-1, 2).T
        end = last + 1
        start = end - self.lengths[word]
        if not overlapping and (again := np.flatnonzero(self.meets[word])).size:
            kept, free = np.ones(len(word), bool), {}
            for i, s, e, w in zip(again.tolist(), start[again].tolist(), end[again].tolist(), word[again].tolist(), strict=True):
                if s < free.get(w, 0):
                    kept[i] = False
                else:
                    free[w] = e
            start, end, word = start[kept], end[kept], word[kept]
        order = np.lexsort((end, start))
        n = self.counts[word[order]]
        row = np.repeat(order, n)
        kind = self.firsts[word[row]] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return np.vstack((start[row], end[row], word[row], kind))


def fold(text: str) -> str:
    """Text in which all letters that match each other without case are the same; each letter's form is its own."""
    return text.casefold().replace("̇", "").replace("ı", "i")


def spaced(text: str) -> str:
    """Folded text with one space for each run of white space, and none at its ends."""
    return " ".join(fold(text).split())


def _blank(kind, value) -> bool:
    """Whether a part of a parsed pattern matches white space, of one character at least, and nothing else."""
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        return value[0] > 0 and len(value[2]) == 1 and _blank(*value[2][0])
    return kind is op.IN and all(v == (op.CATEGORY, op.CATEGORY_SPACE) or v[0] is op.LITERAL and chr(v[1]).isspace() for v in value)


def _required(parsed) -> Iterator[frozenset[str]]:
    """Sets of literals, one of which stands, spaced, in whatever matches the parsed pattern."""
    run: list[str] = []
    for kind, value in parsed:
        if kind is op.LITERAL or _blank(kind, value):
            run.append(chr(value) if kind is op.LITERAL else " ")
            continue
        if kind is op.AT:
            continue
        if "".join(run).strip():
            yield frozenset(["".join(run)])
        run = []
        if kind is op.SUBPATTERN:
            yield from _required(value[3])
        elif kind is op.BRANCH:
            each = [_best(_required(branch)) for branch in value[1]]
            if all(each):
                yield frozenset().union(*each)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0]:
            yield from _required(value[2])
        elif kind is op.ATOMIC_GROUP:
            yield from _required(value)
        elif kind is op.ASSERT:
            yield from _required(value[1])
    if "".join(run).strip():
        yield frozenset(["".join(run)])


def _folded(sets: Iterable[frozenset[str]]) -> list[frozenset[str]]:
    each = dict.fromkeys(frozenset(map(spaced, s)) for s in sets)
    return [s for s in each if s and all(s)]


def _best(sets: Iterable[frozenset[str]]) -> frozenset[str] | None:
    """The set whose shortest literal is longest."""
    return max(_folded(sets), key=lambda s: (min(map(len, s)), -len(s)), default=None)


def required_literals(pattern: str, case_sensitive: bool = True) -> list[frozenset[str]]:
    """Sets of spaced literals: of each set, one is in every spaced text that matches."""
    return _folded(_required(_parser.parse(pattern, 0 if case_sensitive else re.IGNORECASE)))


@lru_cache(4096)
def compiled(pattern: str, case_sensitive: bool) -> re.Pattern:
    return re.compile(pattern, 0 if case_sensitive else re.IGNORECASE)


@dataclass
class Feed:
    """Signatures (pattern, case sensitive) in the order of a feed; None: one that is left out."""

    signatures: list[tuple[str, bool] | None]
    made: ahocorasick.Automaton = field(init=False)
    sets: dict[int, int] = field(init=False)

    def __post_init__(self):
        needs = {i: required_literals(*s) for i, s in enumerate(self.signatures) if s}
        self.sets = {i: len(sets) for i, sets in needs.items()}
        self.made = automaton((word, (i, k)) for i, sets in needs.items() for k, words in enumerate(sets) for word in words)

    def candidates(self, forms: Iterable[str]) -> list[int]:
        """Places of the signatures that have a literal of each of their sets in the forms, in the order of the feed."""
        seen: set[int] = set()  # lists of values; each is of one word
        missing = dict(self.sets)
        found: set[tuple[int, int]] = set()
        for form in forms:
            for _, (_, values) in self.made.iter(spaced(form)) if form and len(self.made) else ():
                if id(values) not in seen:
                    seen.add(id(values))
                    found.update(values)
        for i, _ in found:
            missing[i] -= 1
        return sorted(i for i, n in missing.items() if not n)

    def first(self, forms: list[str]) -> int | None:
        """The place in the feed of the first signature that matches one of the forms."""
        return next((i for i in self.candidates(forms) if any(compiled(*self.signatures[i]).search(f) for f in forms)), None)
