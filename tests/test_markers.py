"""One-pass counts of word lists against a count of each key by itself."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folio.functions import markers as m
from folio.functions import text as t
from folio.operators import narrative, readability


def plain(text, keys):
    return float(sum(text.count(k) for k in keys if k))


def test_automaton():
    """Keys inside keys, keys that overlap themselves, keys of two lists, keys named twice, an empty list and an empty key."""
    chance = random.Random(5)
    lists = [["a", "ab", "aba", "abab"], ["ха-ха", "ха", "а"], [], ["", "b", "b"], ["aa", "aaa", "a"], ["漢", "🙂 ", " "]]
    of = m.Automaton(lists)
    for _ in range(500):
        text = "".join(chance.choices(["a", "b", "ab", "ха", "-", " ", "漢", "🙂"], k=chance.randrange(40)))
        assert of.counts(text).tolist() == [plain(text, keys) for keys in lists], text
    assert m.Automaton([]).counts("x").tolist() == [] and m.Automaton([[]]).counts("x").tolist() == [0]


def test_columns(spark):
    texts = ["one two ones", "", None, "ONE", "on e", "one" * 50_000]
    df = spark.createDataFrame([(i, x, [x, "one"] if x is not None else None) for i, x in enumerate(texts)], "i long, text string, many array<string>")
    lists = {"one": ["one", "on"], "two words": ["two", "zz"], "none": []}
    rows = df.select("i", m.count_lists(F.col("text"), lists).alias("x"), m.count_lists_in(F.col("many"), lists).alias("y"), m.keys_in(F.col("text"), ["two", "on", "one", "on"]).alias("k")).orderBy("i").collect()
    for r, text in zip(rows, texts, strict=True):
        assert (r.x is None) == (r.y is None) == (r.k is None) == (text is None)
        if text is not None:
            assert r.x.asDict() == {k: plain(text, v) for k, v in lists.items()}
            assert r.y.asDict() == {k: plain(text, v) + plain("one", v) for k, v in lists.items()}
            assert r.k == [k for k in ("two", "on", "one") if k in text]
    assert df.limit(0).select(m.count_lists(F.col("text"), lists)).collect() == []


def test_as_the_fold(spark):
    """The same as the fold over single keys, which stays for lists inside folds."""
    df = spark.createDataFrame([(x,) for x in ("the cat, the dog and then", "", "and and", None)], "text string")
    keys = ["the", "then", "and", "n"]
    assert all(r.a == r.b for r in df.select(m.count_lists(F.col("text"), {"k": keys})["k"].alias("a"), t.count_any(F.col("text"), keys).alias("b")).collect())


def test_clashing_columns(spark):
    """No helper column takes the place of a column of the table."""
    texts = ["One two. Three, four!\nFive six seven.", "", None]
    plain_df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    names = ["_w", "_words", "_s", "_low", "_text", "_hits", "_overall", "words", "step", "ordinal", "n", "0", "hits"]
    odd = plain_df.select("*", *(F.lit(f"mine {n}").alias(n) for n in names))
    measures = [("readability", readability.readability), ("complexity", lambda d: readability.complexity(d, ["one"])), ("style", readability.style), ("emotion", lambda d: readability.emotion(d, emotions={"радость": ["one"], "грусть": ["two"]}, negative=["грусть"]))]
    for name, fn in measures:
        got = fn(odd).orderBy("doc_id").collect()
        assert [r[name] for r in got] == [r[name] for r in fn(plain_df).orderBy("doc_id").collect()]
        assert all(r[n] == f"mine {n}" for r in got for n in names) and got[0].text == texts[0]
    chunks = spark.createDataFrame([(1, i, f"он сказал ей — {i}") for i in range(25)], "doc_id long, chunk_index long, content string")
    odd = chunks.select("*", *(F.lit(f"mine {n}").alias(n) for n in names))
    got = narrative.timeline(odd).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(0, 25, 2)) and all(r[n] == f"mine {n}" for r in got for n in names)
    assert all(r[n] == f"mine {n}" for r in narrative.relevant(odd, "character", 0.0).collect() for n in names)


def test_one_text_at_a_time():
    """A batch of 100 MB needs the room of one text, not of all."""
    texts = pa.array(["the one and two " * 62_500] * 100)
    tracemalloc.start()
    found = m.counts_of(texts, (("the", "one"), ("two",), ()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[99].as_py() == {"c0": 125_000.0, "c1": 62_500.0, "c2": 0.0} and peak < 20e6
    assert [np.isnan(x.as_py()["c0"]) for x in m.counts_of(pa.array(["a", None], pa.string()), (("a",),))] == [False, True]
