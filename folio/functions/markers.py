"""Word lists of any length, counted in one pass over a text.

All keys of all lists that a measure asks for go into one Aho-Corasick automaton, which meets every occurrence of every key while
it reads a text once, in Arrow batches. The automaton is built once a worker process. Small lists inside folds over sentences
or words stay with functions.text, in the JVM.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between texts of an array that are read as one; no key can hold it.
BREAK = "\x00"


class Automaton:
    """Counts of the keys of several lists. A key that two lists share is met once and counted for both; each counts on its own,
    however it overlaps with others, and its own occurrences don't overlap each other (leftmost first)."""

    def __init__(self, lists: Sequence[Sequence[str]]):
        self.keys = list(dict.fromkeys(k for keys in lists for k in keys if k))
        # of how many lists' entries each key is one: a list that names a key twice counts it twice
        self.shares = np.array([[list(keys).count(k) for k in self.keys] for keys in lists], np.float64).reshape(len(lists), len(self.keys))
        # a key whose beginning is also its end can overlap itself
        self.bordered = [i for i, k in enumerate(self.keys) if any(k.startswith(k[-n:]) for n in range(1, len(k)))]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, k in enumerate(self.keys):
            self.automaton.add_word(k, i)
        if self.keys:
            self.automaton.make_automaton()

    def hits(self, text: str) -> np.ndarray:
        """Non-overlapping occurrences of each key."""
        if not self.keys:
            return np.zeros(0)
        found = np.bincount(np.fromiter(map(itemgetter(1), self.automaton.iter(text)), np.int64), minlength=len(self.keys))
        for i in self.bordered:
            if found[i] > 1:
                found[i] = text.count(self.keys[i])
        return found

    def counts(self, text: str) -> np.ndarray:
        """Occurrences of each list's keys."""
        return self.shares @ self.hits(text)


@functools.lru_cache(maxsize=64)
def automaton(lists: tuple[tuple[str, ...], ...]) -> Automaton:
    return Automaton(lists)


def counts_of(texts: pa.Array, lists: tuple[tuple[str, ...], ...]) -> pa.StructArray:
    """Occurrences of each list's keys in each text; NaN for a null one. A text becomes a Python string when its turn comes, so
    that a worker never holds those of a batch."""
    of, rows = automaton(lists), np.full((len(texts), max(1, len(lists))), np.nan)
    for row, x in zip(rows, texts, strict=True):
        if lists and x.is_valid:
            row[:] = of.counts(x.as_py())
    return pa.StructArray.from_arrays([pa.array(column) for column in rows.T.copy()], [f"c{i}" for i in range(rows.shape[1])])


def count_lists(text: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """A struct with the occurrences (double) of each list's keys in a text, by the names of `lists`. Null text: null.

    It is evaluated before the expressions around it, so it can't stand inside a fold."""
    keys, names = tuple(tuple(v) for v in lists.values()), list(lists)

    @F.arrow_udf(", ".join(f"c{i} double" for i in range(max(1, len(keys)))))
    def count(texts: pa.Array) -> pa.Array:
        return counts_of(texts, keys)

    found = count(text)
    return F.when(text.isNotNull(), F.struct(*(found[f"c{i}"].alias(n) for i, n in enumerate(names))))


def count_lists_in(texts: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """count_lists() summed over an array of texts; no occurrence goes from one text into the next."""
    return count_lists(F.array_join(texts, BREAK), lists)


def keys_in(text: Column, keys: Sequence[str]) -> Column:
    """The keys that occur in a text, in the order of the list. Null text: null."""
    listed = tuple(dict.fromkeys(k for k in keys if k))

    @F.arrow_udf("array<string>")
    def find(texts: pa.Array) -> pa.Array:
        of = automaton((listed,))
        return pa.array([[of.keys[i] for i in np.flatnonzero(of.hits(x.as_py()))] if x.is_valid else None for x in texts], pa.list_(pa.string()))

    return find(text)
