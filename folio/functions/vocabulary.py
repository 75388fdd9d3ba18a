"""Sums over the words of texts, where each distinct word is measured once.

Spark cuts the words; a batch of them is taken as numbers of its distinct words, so what is asked of a word (its length,
syllables, lists it is in) is asked once a batch, by Arrow's functions, and a text's sums are array operations.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are summed at once; a text of more is summed alone.
WORDS = 1 << 20
#: What is always given: different words, those of them that count for neighbours, the sum of n * log2(n) over words used n
#: times, and the shares that neighbour sentences have in common (of the larger one's different words), summed.
GENERAL = ("distinct", "distinct_kept", "spread", "shared")


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


#: From distinct words to an array a measure.
Measure = Callable[[pa.Array], Sequence[np.ndarray]]


def lengths(words: pa.Array) -> np.ndarray:
    return pc.utf8_length(words).to_numpy(zero_copy_only=False)


def syllables(words: pa.Array, vowels: str) -> np.ndarray:
    """Matches in each word, one at least."""
    return np.maximum(pc.count_substring_regex(words, vowels).to_numpy(zero_copy_only=False), 1)


def with_any(words: pa.Array, keys: Collection[str]) -> np.ndarray:
    """Whether any of the keys occurs in each word."""
    found = [pc.match_substring(words, k).to_numpy(zero_copy_only=False) for k in keys]
    return np.logical_or.reduce(found) if found else np.zeros(len(words), bool)


def listed(words: pa.Array, keys: Collection[str]) -> np.ndarray:
    """Whether each word is one of the keys."""
    return pc.is_in(words, pa.array(list(keys), words.type)).to_numpy(zero_copy_only=False)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how often each is there. (np.unique hashes first, which takes longer here.)"""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.diff(first, append=len(keys))


def sums_of(texts: pa.ListArray, measure: Measure, left_out: Collection[str] = ()) -> np.ndarray:
    """Texts as lists of sentences as lists of words -> a row a text: sums of what measure() gives for its words, and what GENERAL names."""
    in_text, sentences = _lengths(texts), texts.flatten()
    in_sentence, words = _lengths(sentences), sentences.flatten().dictionary_encode()
    at, n = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(texts)
    size, text_of = max(1, len(words.dictionary)), np.repeat(np.arange(n), in_text)
    sentence = np.repeat(np.arange(len(in_sentence)), in_sentence)
    kept = ~listed(words.dictionary, left_out)
    text = text_of[sentence]
    out = [np.bincount(text, values[at], n) for values in measure(words.dictionary)]
    key, times = _counted(text * size + at)
    whose = key // size
    out += [np.bincount(whose, minlength=n), np.bincount(whose, kept[key % size], n), np.bincount(whose, times * np.log2(times), n)]
    sets, _ = _counted((sentence * size + at)[kept[at]])
    many = np.bincount(sets // size, minlength=len(in_sentence))
    following = np.searchsorted(sets, sets + size)
    met = sets[np.minimum(following, len(sets) - 1)] == sets + size
    common = np.bincount(sets[met] // size, minlength=len(in_sentence))[:-1]
    share = np.where(text_of[1:] == text_of[:-1], common / np.maximum(np.maximum(many[1:], many[:-1]), 1), 0.0)
    return np.column_stack((*out, np.bincount(text_of[:-1], share, n)))


def often_used_of(texts: pa.ListArray, longer_than: int, more_than: int) -> np.ndarray:
    in_text, words = _lengths(texts), texts.flatten().dictionary_encode()
    at, size = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(words.dictionary))
    key = np.repeat(np.arange(len(texts)), in_text) * size + at
    key, times = _counted(key[(lengths(words.dictionary) > longer_than)[at]])
    often = times > more_than
    return np.bincount(key[often] // size, times[often], len(texts)).astype(np.int64)


def often_used(words: Column, longer_than: int, more_than: int) -> Column:
    """Of an array of words: how many are uses of words of more than `longer_than` characters that it has more than `more_than`
    times. Null: 0. Like word_sums(), it can't stand inside a fold."""

    @F.arrow_udf("long")
    def uses(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(often_used_of(part, longer_than, more_than) for part in _parts(texts))]))

    return uses(words)


def _parts(texts: pa.ListArray):
    """Some whole texts after others, of about WORDS words. Texts are lists of words, or of sentences that are."""
    ends = np.concatenate(([0], np.cumsum(_lengths(texts))))
    if pa.types.is_list(texts.type.value_type):
        ends = np.concatenate(([0], np.cumsum(_lengths(texts.flatten()))))[ends]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + WORDS, "right")) - 1)
        yield texts.slice(i, j - i)
        i = j


def word_sums(by_sentence: Column, names: Sequence[str], measure: Measure, left_out: Collection[str] = ()) -> Column:
    """A struct of doubles, of an array of sentences that are arrays of words: sums over its words of what measure() gives
    for each of `names`, and GENERAL, where words of `left_out` are in no sentence's set. Null: zeros.

    It is evaluated before the expressions around it, so it can't stand inside a fold."""
    fields, out = [*names, *GENERAL], frozenset(left_out)

    @F.arrow_udf(", ".join(f"{x} double" for x in fields))
    def sums(texts: pa.Array) -> pa.Array:
        rows = [sums_of(part, measure, out) for part in _parts(texts)]
        whole = np.concatenate(rows) if rows else np.zeros((0, len(fields)))
        return pa.StructArray.from_arrays([pa.array(column) for column in whole.T.copy()], fields)

    return sums(by_sentence)
