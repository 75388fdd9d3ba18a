import re

import pytest
from pyspark.sql import functions as F

from folio.functions import lexicons as lx
from folio.operators import description as d
from folio.operators import narrative

MARKERS, SENSES = {"лицо": ["глаза", "губы"], "дом": ["окно"]}, {"цвет": ["синий"], "слух": ["тихий"]}


def test_passages(spark):
    text = "глаза губы окно синий. просто слова. тихий синий глаза окно"
    df = spark.createDataFrame([(1, text), (2, "ничего"), (3, "")], "doc_id long, text string")
    rows = d.passages(df, MARKERS, SENSES).orderBy("place").collect()
    assert [(x.place, round(x.score, 6)) for x in rows] == [(0, 0.45 + (0.5 * 1 / 4 if re.search(r"\w+(ий)$", "глаза губы окно синий") else 0)), (2, 0.5)]
    assert set(rows[0].kinds) == {"лицо", "дом"}
    r = {x.doc_id: x for x in d.description_report(df, MARKERS, SENSES).collect()}
    assert r[1].passages == 2 and r[1].type_diversity == 1.0 and r[1].sensory_diversity == 1.0 and r[2].overall == 0.0 and r[3].passages == 0
    assert r[1].distribution == 0.2  # fewer than five sentences fall in the last segment


def test_transition(spark):
    x = spark.range(1).select(d.transition(F.lit("рыцарь вошёл в замок"), F.lit("однако замок пуст")).alias("a"), d.transition(F.lit("один"), F.lit("другой")).alias("b")).first()
    want = 0.5 + sum(0.3 for v in lx.LINKS.values() if any("однако замок пуст".startswith(k) or f" {k} " in "однако замок пуст" for k in v)) + 0.1
    assert x.a == pytest.approx(min(want, 1)) and x.b == 0.5
    units = spark.createDataFrame([(1, 0, "Первый раз. Рыцарь вошёл"), (1, 1, "Рыцарь вышел. Конец"), (2, 0, "один")], "doc_id long, chunk_index int, content string")
    got = {r.doc_id: r for r in d.unit_coherence(units).collect()}
    assert got[2].transitions == 1.0 and 0.5 < got[1].transitions <= 1 and 0 < got[1].thematic < 1


def test_voices(spark):
    df = spark.createDataFrame([(["Ну что? Я иду!", "Ну как? Я бегу!", "Позвольте, уважаемый господин, извините за беспокойство и долгое ожидание"],), ([],)], "p array<string>")
    assert [x.v for x in df.select(d.voices(F.col("p")).alias("v")).collect()] == [2, 0]


def test_patterns_and_spans(spark):
    text = "Во-первых, что? Да! 1999 год. Иван Петров пришёл. как сказал он"
    df = spark.createDataFrame([(text,), (None,)], "text string")
    x = df.select(d.pattern_counts(F.lower("text")).alias("m"), d.pattern_counts(F.col("text"), literal=True).alias("l"), d.information_density(F.col("text")).alias("i")).first()
    assert (x.m["вопрос"], x.m["восклицание"], x.m["перечисление"], x.m["цитирование"], x.l["вопрос"]) == (1, 1, 1, 1, 0)
    assert x.i == pytest.approx((0 + 2 / 5) / 3)
    rows = d.find_spans(df, r"\w+\?").collect()
    assert [(s.text, s.start, s.end) for s in rows[0].spans] == [(m[0], m.start(), m.end()) for m in re.finditer(r"\w+\?", text)] and rows[1].spans is None


def test_overall(spark):
    x = spark.range(1).select(d.overall_structure({"logical_flow": F.lit(1.0), "rhythm": F.lit(0.0)}).alias("s"), narrative.overall_dialogue({"structure": F.lit(1.0), "dialogue_ratio": F.lit(0.3)}, F.lit(1)).alias("g"), narrative.overall_dialogue({"structure": F.lit(1.0)}, F.lit(0)).alias("z")).first()
    assert (x.s, x.g, x.z) == (pytest.approx(0.25 / 0.4), 1.0, 0.0)
