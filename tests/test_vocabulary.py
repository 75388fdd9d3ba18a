"""Sums over words, against plain Python; each distinct word is measured once."""

from collections import Counter
from math import log2

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.functions import vocabulary as v
from folio.operators import narrative, readability

TEXTS = [[["aa", "b", "aa"], ["b", "ccc"], []], None, [], [["b"], ["the", "the"], ["b", "the"]], [[]], [["ёж", "ёж", "aa"], ["ёж"]]]


def plain(sentences, left_out):
    words = [w for s in sentences or [] for w in s]
    sets = [set(s) - left_out for s in sentences or []]
    shared = sum(len(a & b) / max(len(a), len(b)) for a, b in zip(sets, sets[1:], strict=False) if a and b)
    counts = Counter(words)
    return [sum(map(len, words)), len(counts), len(set(words) - left_out), sum(n * log2(n) for n in counts.values()), shared]


@pytest.mark.parametrize("at_once", [1, 4, 1 << 20])
def test_sums(monkeypatch, at_once):
    monkeypatch.setattr(v, "WORDS", at_once)
    texts = pa.array([[["x"]], *TEXTS], pa.list_(pa.list_(pa.string())))[1:]  # with an offset
    got = np.concatenate([v.sums_of(part, lambda words: [v.lengths(words)], {"the"}) for part in v._parts(texts)])
    assert np.allclose(got, [plain(x, {"the"}) for x in TEXTS])


def test_each_word_is_measured_once():
    asked = []

    def measure(words):
        asked.extend(words.to_pylist())
        return [v.syllables(words, "[aeiou]+")]

    texts = pa.array([[["banana"] * 1000, ["tree", "banana"]]] * 50)
    assert v.sums_of(texts, measure)[0, 0] == 3004
    assert sorted(asked) == ["banana", "tree"]


def test_words():
    words = pa.array(["", "nation", "ёлка", "zzz"])
    assert v.lengths(words).tolist() == [0, 6, 4, 3]
    assert v.syllables(words, "[aeioёа]+").tolist() == [1, 2, 2, 1]
    assert v.with_any(words, ["tion", "лк"]).tolist() == [False, True, True, False]
    assert not v.with_any(words, []).any() and not v.listed(words, []).any()
    assert v.listed(words, ["zzz", "tion"]).tolist() == [False, False, False, True]


def test_words_are_not_measured_by_folds(spark):
    """No expression of Spark's runs over the words of a text one by one."""
    rows = spark.createDataFrame([("One two. Two three!",)], "text string")
    for made in (readability.readability(rows), readability.complexity(rows, ["one"])):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "flatten" not in plan and "array_distinct" not in plan and "array_contains" not in plan
    assert readability.readability(rows).select(F.col("readability.words")).first()[0] == 4


@pytest.mark.parametrize("at_once", [1, 1 << 20])
def test_often_used(monkeypatch, at_once):
    monkeypatch.setattr(v, "WORDS", at_once)
    texts = pa.array([["long", "abc"] * 6, None, [], ["longer"] * 5, ["ёлка"] * 7 + ["long"] * 6 + ["once"]])
    assert np.concatenate([v.often_used_of(part, 3, 5) for part in v._parts(texts)]).tolist() == [6, 0, 0, 0, 13]


def test_water_exchanges_no_words(spark):
    """Words of a text are counted in its row: no row a word."""
    rows = spark.createDataFrame([(1, 0, "many " * 4), (1, 1, "many " * 2 + "\x1cfew"), (2, 0, None), (3, 0, "")], "doc_id long, chunk_index int, content string")
    made = narrative.water_report(rows, patterns={"a": ["few"]}, repeats={"a": ["few"]})
    assert made._jdf.queryExecution().optimizedPlan().toString().count("explode(") == 1  # of what repeats
    got = {r.doc_id: (r.repetition_water, r.phrase_water, r.water) for r in made.collect()}
    assert got[1] == (100 * 6 / 7, 100 / 7, 100.0) and got[3][2] == 50.0


def test_keywords(spark):
    rows = spark.createDataFrame([("a-b-c-d-e it's, hou-ses abcd abcde12f\x1cghijk",)], "c string")
    assert rows.select(narrative.keywords(F.col("c"))).first()[0] == ["abcde", "houses", "abcdef", "ghijk"]
