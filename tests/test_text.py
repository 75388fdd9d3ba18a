"""Golden values of the formulas, on Russian and odd texts, against plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folio.functions import lexicons as lx
from folio.functions import text as t
from folio.operators import chunking, narrative, readability

RU = "Рыцарь сказал: — Мы идём в замок! Однако дорога была длинной, опасность ждала всех.\n\nПоэтому он быстро бежал. «Стой!» — крикнул враг. Информатизация общества."


def frame(spark, *texts):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")


def test_expressions(spark):
    row = frame(spark, RU).select(
        t.count_sub(F.col("text"), "о").alias("o"), t.count_any(F.col("text"), ["он", "она", "о"]).alias("any"), F.size(t.sentences(F.col("text"))).alias("s"), F.size(t.paragraphs(F.col("text"))).alias("p"),
        t.words(F.col("text"), t.RUSSIAN_WORD).alias("w"), t.tokens(F.col("text")).alias("k"), t.variance(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0, 5.0]))).alias("v"), t.variance(F.expr("cast(array() as array<double>)")).alias("v0"),
        t.ladder(F.lit(0.5), [(0.5, "a"), (0.7, "b")], "c").alias("l"), t.duration(F.lit(3723)).alias("d"), t.syllables(F.lit("информатизация")).alias("y"), t.summary(F.lit("x" * 300)).alias("m"),
    ).first()
    assert row.o == RU.count("о") and row.any == sum(RU.count(k) for k in ("он", "она", "о"))
    assert (row.s, row.p) == (len([x for x in re.split("[.!?]+", RU) if x.strip()]), 2)
    assert row.w == re.findall(r"\b[а-яёa-z]+\b", RU.lower()) and row.k == RU.split()
    assert (row.v, row.v0, row.l, row.d, row.y, len(row.m)) == (2.0, 0.0, "b", "1h 2m 3s", 6, 203)


def test_readability(spark):
    r = readability.readability(frame(spark, RU, "", None), word=t.RUSSIAN_WORD, vowels=t.RUSSIAN_VOWELS, separator="\n\n").orderBy("doc_id").collect()
    x, w = r[0].readability, re.findall(r"\b[а-яёa-z]+\b", RU.lower())
    syl = [max(1, len(re.findall("[аеёиоуыэюя]+", v))) for v in w]
    s = [v for v in re.split("[.!?]+", RU) if v.strip()]
    assert (x.words, x.sentences, x.paragraphs, x.syllables, x.chars) == (len(w), len(s), 2, sum(syl), len(re.sub(r"\s+", "", RU)))
    assert x.flesch == pytest.approx(min(100, max(0, 206.835 - 1.015 * len(w) / len(s) - 84.6 * sum(syl) / len(w))))
    assert x.stop_words_ratio == pytest.approx(sum(v in lx.STOP_WORDS for v in w) / len(w))
    content = [set(re.findall(r"\b[а-яёa-z]+\b", v.lower())) - set(lx.STOP_WORDS) for v in s]
    assert x.coherence == pytest.approx(sum(len(a & b) / max(len(a), len(b)) for a, b in zip(content, content[1:]) if a and b) / (len(s) - 1))
    lengths = [len(p.split()) for p in RU.split("\n\n")]
    m = sum(lengths) / 2
    regular = 1 / (1 + sum((v - m) ** 2 for v in lengths) / 2 / m**2)
    assert x.organization == pytest.approx(min(1, 0.3 + 0.3 * regular + min(10 * sum(RU.lower().count(k) for k in lx.CONNECTIVES) / len(RU.split()), 0.4)))
    assert r[1].readability.words == 0 and r[1].readability.flesch == 0 and r[2].readability is None
    assert x.grade in ("very_difficult", "difficult", "medium", "easy", "very_easy")


def test_complexity(spark):
    text = "aa bb aa cc. dd, ee, ff, gg aa bb aa."
    x = readability.complexity(frame(spark, text, ""), ["aa"], conjunctions=["zz"]).orderBy("doc_id").first().complexity
    c = Counter(re.findall("[a-z]+", text))
    n = sum(c.values())
    assert x.lexical_entropy == pytest.approx(min(-sum(v / n * math.log2(v / n) for v in c.values()) / 10, 1))
    assert (x.rare_words_ratio, x.complex_sentence_ratio) == (pytest.approx(1 - c["aa"] / n), 0.5)


def test_emotion(spark):
    x = readability.emotion(frame(spark, "счастье и радость, радость!", "")).orderBy("doc_id").collect()
    assert x[0].emotion.dominant == "радость" and x[0].emotion.tone == "positive" and x[0].emotion.scores["радость"] == 7.5
    assert x[1].emotion.dominant == "радость" and x[1].emotion.tone == "neutral"


def test_emotion_whole(spark):
    df = frame(spark, "слово " * 600 + "радость " * 600)
    x, y = (readability.emotion(df, **k).first().emotion for k in ({}, {"limit": 3000}))
    assert x.tone == "positive" and x.scores["радость"] == 5.0
    assert y.tone == "neutral" and y.scores["радость"] == 0.0


def test_chunks(spark):
    cut = lambda text, **k: chunking.chunk(frame(spark, text), chunking.Strategy(**k)).orderBy("chunk_index").collect()
    assert len(cut("A" * 200, base=30, least=1, overlap=0)) == 7 and len(cut("A" * 200, base=100, least=1, overlap=0)) == 2
    got = cut("ABCDEFGHIJ" * 10, base=30, least=1, overlap=0.33)
    assert len(got[0].content) <= 40 and [x.chunk_index for x in got] == list(range(len(got)))
    assert [x.content for x in cut("Short")] == ["Short"] and cut("") == []
    four = "Первое. Второе! Третье? Четвёртое."
    got = cut(four, unit="sentence", per_chunk=2, overlap=0)
    assert [x.content for x in got] == ["Первое. Второе! ", "Третье? Четвёртое."]
    assert len(cut("a\n\nb\n\nc", unit="paragraph", per_chunk=1, overlap=0)) == 3
    long = " ".join(f"Sentence number {i} is here." for i in range(200))
    got = cut(long, base=500, least=100, most=900, unit="sentence", overlap=0)
    assert "".join(x.content for x in got) == long and all(len(x.content) <= 900 for x in got) and len(got) > 5
    two = cut(long, base=500, least=100, most=900, overlap=0.1, two_sided=True)
    assert two[1].overlap_start == 50 and all(long[x.start_pos : x.end_pos] == x.content for x in two)
    with pytest.raises(ValueError):
        chunking.chunk(frame(spark, "x"), chunking.Strategy(overlap=0.9))


def test_scores(spark):
    low = RU.lower()
    n = len(RU.split())
    x = frame(spark, RU).select(narrative.tension_score(F.col("text")).alias("t"), narrative.event_density(F.col("text")).alias("e"), narrative.dialogue_ratio(F.col("text")).alias("d"), narrative.character_score(F.col("text")).alias("c")).first()
    parts = re.split("[.!?]+", RU)
    count = lambda keys: sum(low.count(k) for k in keys)
    assert x.t == pytest.approx(min(10, 5 * min(count(lx.TENSION) / n * 20, 1) + 3 * min(RU.count("!") / 5, 1) + 2 * sum(0 < len(p.split()) < 8 for p in parts) / len(parts)))
    assert x.e == pytest.approx(max(0, min(min(count(lx.EVENTS) / n, 1) + 0.3 * (count(lx.FAST) - count(lx.SLOW)) / n, 1)))
    assert x.d == pytest.approx(min(1, (RU.count("—") + RU.count("«") + 2 * RU.count('"')) / 20))
    names = len(re.findall(r"(?<=[а-яa-z]\s)[А-ЯA-Z][а-яa-z]+", RU))
    assert x.c == pytest.approx(min(1, 0.4 * min(count(lx.CHARACTER) / n, 1) + 0.4 * min((RU.count("—") + RU.count('"') + RU.count("«")) / 10, 1) + 0.2 * names / n))


def test_pace_and_water(spark):
    scored = spark.createDataFrame([(1, 0, 1.0, 0.0), (1, 1, 0.0, 1.0), (1, 2, 0.5, 0.5), (1, 3, 0.1, 0.1)], "doc_id long, chunk_index int, event_density double, dialogue_ratio double")
    scored = scored.withColumn("pace", F.least(10 * (7 * F.col("event_density") + 3 * F.col("dialogue_ratio")), F.lit(10.0)))
    x = narrative.pace_report(scored).first()
    assert (x.median_pace, x.pace_class) == (10.0, "fast")
    empty = spark.createDataFrame([(1, i, "") for i in range(5)], "doc_id long, chunk_index int, content string")
    assert narrative.water_report(empty).first().water == 50.0
    wordy = spark.createDataFrame([(1, 0, "в общем как бы " * 20)], "doc_id long, chunk_index int, content string")
    assert narrative.water_report(wordy).first().rating == "verbose"
    assert narrative.timeline(spark.range(40).selectExpr("1L doc_id", "int(id) chunk_index")).count() == 10


def test_speech(spark):
    rows = narrative.speech(frame(spark, "— Привет! — сказал он.\nТишина.\n«Да» ответил друг.")).orderBy("paragraph_index").collect()
    assert [(x.paragraph_index, x.author_words) for x in rows] == [(0, 1), (2, 1)] and "Да" in rows[1].parts
    report = narrative.dialogue_report(frame(spark, "— Привет! — сказал он.\nТишина.\n«Да» ответил друг.", "ничего")).orderBy("doc_id").collect()
    assert (report[0].dialogue_count, report[0].longest_run, report[1].dialogue_count, report[1].dialogue_ratio) == (2, 1, 0, 0.0)


def test_structure_and_terms(spark):
    x = narrative.structure_report(frame(spark, RU), separator="\n\n").first()
    assert x.paragraphs == 2 and 0 <= x.logical_flow <= 1 and x.short_paragraphs == 1.0
    terms = narrative.top_terms(frame(spark, "дом дом лес и дом"), word="[а-яё]{2,}", stop_words=["и"]).orderBy("rank").collect()
    assert terms[0].term == "дом" and terms[0].score == pytest.approx(3 / math.sqrt(9 + 1 + 1 + 1 + 1))
