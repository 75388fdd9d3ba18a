"""Descriptive passages, transitions between units, speech voices, narrative patterns, and terms over chunks."""

from __future__ import annotations

import re
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import lexicons as lx
from folio.functions import text as t
from folio.functions.markers import count_lists
from folio.operators.terms import best_terms, summed

# Results depend on these lists and patterns.
TRANSITION_STOPS = "и в на с по для от до при за через".split()
KEY_MARKERS = "важно главное основное ключевое центральное проблема решение результат вывод факт".split()
FACTS = [r"\d{4}", r"\d+%", r"\d+\.\d+", r"[А-Я][а-я]+ [А-Я][а-я]+"]
ADJECTIVES = [r"(?iU)\w+(ный|ная|ное|ые)$", r"(?iU)\w+(ий|ая|ое|ие)$"]
PATTERNS = {"вопрос": [r"\?"], "восклицание": ["!"], "прямая_речь": [r"[—–]\s*[А-Яа-я]", r"[\"«][^\"»]*[\"»]"], "перечисление": ["во-первых|во-вторых|в-третьих", r"\d+\)", r"•|·|\*"], "цитирование": ["как сказал|по словам|цитируя|согласно"]}
TIMES = {"утро": ["рассвет", "утром", "восход", "раннее утро", "утренний"], "день": ["днем", "полдень", "дневной", "солнечный день"], "вечер": ["вечером", "закат", "сумерки", "вечерний", "заходящее солнце"], "ночь": ["ночью", "полночь", "ночной", "темнота", "звездная ночь"]}
DEVICES = {"сравнение": [r"как\s+\w+", r"словно\s+\w+", r"будто\s+\w+", r"подобно\s+\w+"], "метафора": [r"\w+\s+—\s+\w+", r"\w+\s+есть\s+\w+"], "эпитеты": "прекрасный великолепный чудесный удивительный восхитительный таинственный волшебный загадочный мрачный печальный".split(), "олицетворение": [r"(солнце|луна|ветер|дождь|море|река)\s+(говорит|смеется|плачет|думает)"]}
DESCRIPTION_GRADES = [(0.3, "недостаточный"), (0.5, "слабый"), (0.65, "удовлетворительный"), (0.8, "хороший")]
PRONOUNS = r"(?U)\b(я|ты|мы|вы|он|она|они)\b"


def _safe(c: Column) -> Column:
    return F.greatest(c, F.lit(1))


def _sum(columns) -> Column:
    return sum(columns, F.lit(0.0))


def transition(last: Column, first: Column, links=lx.LINKS, stop_words=TRANSITION_STOPS) -> Column:
    """Score of the step from a last to a first sentence: a base, connectives by category, shared words."""
    return t.let(F.lower(last), lambda a: t.let(F.lower(first), lambda b: _transition(a, b, links, stop_words)))


def _transition(last: Column, first: Column, links, stop_words) -> Column:
    linked = _sum(F.when(F.exists(t.word_list(v), lambda k: F.startswith(first, k) | F.contains(first, F.concat(F.lit(" "), k, F.lit(" ")))), 0.3).otherwise(0.0) for v in links.values())
    content = lambda c: F.array_except(F.array_distinct(t.tokens(c)), t.word_list(stop_words))
    return F.least(0.5 + linked + F.least(0.1 * F.size(F.array_intersect(content(last), content(first))), F.lit(0.2)), F.lit(1.0))


def unit_coherence(units: DataFrame, key: str = "doc_id", order: str = "chunk_index", text: str = "content", stop_words=(), links=lx.LINKS) -> DataFrame:
    """Of neighbour units (chunks, paragraphs): mean transition score and mean Jaccard of words of four letters and more.
    One unit: 1."""
    w = Window.partitionBy(key).orderBy(order)
    s = t.sentences(F.col(text))
    words = F.array_except(F.array_distinct(t.words(F.col(text), r"(?U)\b\w{4,}\b")), t.word_list(list(stop_words)))
    rows = units.select(key, order, F.try_element_at(s, F.lit(-1)).alias("last"), F.get(s, F.lit(0)).alias("first"), words.alias("w"))
    rows = rows.withColumns({"next": F.lead("first").over(w), "v": F.lead("w").over(w)})
    jaccard = F.when((F.size("w") > 0) & (F.size("v") > 0), F.size(F.array_intersect("w", "v")) / F.size(F.array_union("w", "v")))
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.when(F.col("last").isNotNull() & F.col("next").isNotNull(), transition(F.col("last"), F.col("next"), links))).alias("t"), F.avg(jaccard).alias("j"))
    one = F.col("n") < 2
    return out.select(key, F.when(one, 1.0).otherwise(F.coalesce("t", F.lit(0.0))).alias("transitions"), F.when(one, 1.0).otherwise(F.coalesce("j", F.lit(0.0))).alias("thematic"))


def information_density(c: Column, markers=KEY_MARKERS, facts=FACTS, hits: Column | None = None, sentences: Column | None = None) -> Column:
    """(2 * key words a word + share of sentences with a fact) / 3; 0 without words. `hits` (occurrences of the key words) and
    `sentences` can be given where they are known already."""
    hits = count_lists(F.lower(c), {"keys": markers})["keys"] if hits is None else hits
    fact = lambda x: reduce(lambda a, b: a | b, [F.rlike(x, F.lit(p)) for p in facts], F.lit(False))
    score = lambda x: (2 * x["hits"] / _safe(x["n"]) + F.size(F.filter(x["s"], fact)) / _safe(F.size(x["s"]))) / 3
    known = F.struct((t.sentences(c) if sentences is None else sentences).alias("s"), t.token_count(c).alias("n"), hits.alias("hits"))
    return t.let(known, lambda x: F.when((F.size(x["s"]) == 0) | (x["n"] == 0), 0.0).otherwise(score(x)))


def pattern_counts(c: Column, patterns=PATTERNS, literal: bool = False) -> Column:
    """Matches of each kind as a map. `literal` counts every pattern as it is written, as a substring."""
    of = lambda p: t.count_sub(c, p) if literal else F.regexp_count(c, F.lit("(?U)" + p)).cast("double")
    return F.create_map(*(x for k, v in patterns.items() for x in (F.lit(k), _sum(map(of, v)))))


def descriptiveness(sentence: Column, markers: dict, senses: dict) -> Column:
    """0.1 for each marker word, 0.15 for each sensory word, half the share of adjective endings at the sentence's end."""

    def score(w):
        # an ending stands at the end, so it lies in the last word
        endings = _sum(F.when(F.element_at(w, -1).rlike(p), 1.0).otherwise(0.0) for p in ADJECTIVES)
        found = 0.1 * _sum(t.count_in(w, v) for v in markers.values()) + 0.15 * _sum(t.count_in(w, v) for v in senses.values()) + 0.5 * endings / F.size(w)
        return F.when(F.size(w) == 0, 0.0).otherwise(F.least(found, F.lit(1.0)))

    return t.let(t.tokens(F.lower(sentence)), score)


def passages(df: DataFrame, markers: dict, senses: dict, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Descriptive sentences: key, place, sentence, length (words), score, kinds (categories with a marker in it)."""
    rows = df.select(F.col(key), F.posexplode(t.sentences(F.col(text))).alias("place", "sentence"))
    rows = rows.withColumn("score", descriptiveness(F.col("sentence"), markers, senses)).where(F.col("score") > threshold)
    kinds = F.array_compact(F.array(*(F.when(t.contains_any(F.lower("sentence"), v), F.lit(k)) for k, v in markers.items())))
    return rows.select(key, "place", "sentence", F.size(t.tokens(F.col("sentence"))).alias("length"), "score", kinds.alias("kinds"))


def description_report(df: DataFrame, markers: dict, senses: dict, key: str = "doc_id", text: str = "text", threshold: float = 0.3, devices=DEVICES, times=TIMES) -> DataFrame:
    """One row a text: count, share of words, kinds, senses, devices, detail, spread over five segments, dense areas, times of day,
    overall score. Without passages: zeros. Marker lists are by category; they have no defaults."""
    found = passages(df, markers, senses, key, text, threshold)
    base = df.select(F.col(key), F.size(t.tokens(F.col(text))).alias("words"), F.size(t.sentences(F.col(text))).alias("sentences"))
    segment = F.floor(F.col("sentences") / 5)
    placed = found.join(base, key).withColumn("segment", F.when(segment == 0, 4).otherwise(F.least(F.floor(F.col("place") / _safe(segment)), F.lit(4))))
    low = F.lower("sentence")
    lists = {f"sense_{i}": v for i, v in enumerate(senses.values())} | {f"time_{i}": v for i, v in enumerate(times.values())}
    placed = placed.withColumn("hits", count_lists(low, lists))
    per = {name: F.col("hits")[name] for name in lists} | {f"device_{i}": pattern_counts(low, {"x": v})["x"] for i, v in enumerate(devices.values())}
    sums = placed.groupBy(key).agg(
        F.count("*").alias("n"), F.sum("length").alias("described"), F.avg("length").alias("mean_length"), F.max("length").alias("max_length"), F.stddev_pop("length").alias("sd"), F.avg("score").alias("mean_score"),
        F.count_distinct("segment").alias("segments"), F.size(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"), *(F.sum(v).alias(k) for k, v in per.items()),
    )
    # sliding areas of a tenth of the text, half a window apart, that hold three passages or more
    window = _safe(F.floor(F.col("sentences") / 10))
    step = _safe(F.floor(window / 2))
    first, last = F.greatest(F.ceil((F.col("place") - window + 1) / step), F.lit(0)), F.floor(F.col("place") / step)
    areas = placed.select(key, F.explode(F.sequence(first, F.greatest(first, last))).alias("area"), "place", "sentences").where(F.col("area") * step < _safe(F.col("sentences") - window + 1))
    dense = areas.groupBy(key, "area").agg(F.count("*").alias("c")).where("c >= 3").groupBy(key).agg(F.count("*").alias("dense_areas"))
    out = base.join(sums, key, "left").join(dense, key, "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    some = lambda p, d: _sum(F.when(zero(f"{p}_{i}") > 0, 1.0).otherwise(0.0) for i in range(len(d))) / max(1, len(d))
    share = zero("described") / _safe(F.col("words"))
    m = {
        "ratio": share, "type_diversity": zero("kinds") / max(1, len(markers)), "sensory_diversity": some("sense", senses), "literary_diversity": some("device", devices),
        "detail": F.least(zero("mean_length") / 20 * zero("mean_score"), F.lit(1.0)), "distribution": zero("segments") / 5,
    }
    out = out.select(
        key, zero("n").cast("long").alias("passages"), *(v.alias(k) for k, v in m.items()), zero("mean_length").alias("mean_length"), (1000 * zero("n") / _safe(F.col("words"))).alias("per_thousand_words"),
        F.when(F.col("n") > 0, F.greatest(F.lit(0.0), 1 - zero("sd") / _safe(zero("mean_length")))).otherwise(0.0).alias("consistency"), zero("dense_areas").cast("long").alias("dense_areas"), some("time", times).alias("time_diversity"),
    )
    fit = t.clamp(1 - F.abs(F.col("ratio") - 0.225) / 0.225)
    overall = 0.15 * fit + 0.2 * F.col("type_diversity") + 0.2 * F.col("sensory_diversity") + 0.15 * F.col("literary_diversity") + 0.15 * F.col("detail") + 0.15 * F.col("distribution")
    return out.withColumn("overall", F.when(F.col("passages") == 0, 0.0).otherwise(overall)).withColumn("grade", t.ladder(F.col("overall"), DESCRIPTION_GRADES, "превосходный"))


def description_rollup(chunks: DataFrame, markers: dict, senses: dict, key: str = "doc_id", order: str = "chunk_index", text: str = "content") -> DataFrame:
    """Descriptions chunk by chunk, rolled up to the text over the chunks where a measure is above 0. A chunk's score is
    of its ratio, kinds and senses."""
    each = description_report(chunks.select(F.struct(key, order).alias("__k"), F.col(text)), markers, senses, "__k", text)
    fit = t.clamp(1 - F.abs(F.col("ratio") - 0.225) / 0.225)
    overall = F.when(F.col("passages") > 0, (0.15 * fit + 0.2 * F.col("type_diversity") + 0.2 * F.col("sensory_diversity")) / 0.55).otherwise(0.0)
    rows = each.select(F.col(f"__k.{key}").alias(key), "passages", overall.alias("overall"), "ratio", "type_diversity", "sensory_diversity")
    aggs = [F.count("*").alias("chunks"), F.sum("passages").alias("total"), F.count_if(F.col("passages") > 0).alias("chunks_with_any")]
    for name in ("overall", "ratio", "type_diversity", "sensory_diversity"):
        some = F.when(F.col(name) > 0, F.col(name))
        aggs += [F.avg(some).alias(f"avg_{name}"), F.max(some).alias(f"max_{name}")]
    out = rows.groupBy(key).agg(*aggs).withColumn("share", F.col("chunks_with_any") / F.col("chunks"))
    return out.withColumn("grade", t.ladder(F.coalesce("avg_overall", F.lit(0.0)), DESCRIPTION_GRADES, "превосходный"))


def overall_structure(m: dict[str, Column]) -> Column:
    """Weighted mean of the measures that are there."""
    weights = {"paragraph_structure": 0.2, "logical_flow": 0.25, "completeness": 0.2, "rhythm": 0.15, "information_density": 0.1, "narrative_diversity": 0.1}
    top, bottom = t.weighted({k: m.get(k, F.lit(None).cast("double")) for k in weights}, weights)
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def voices(speeches: Column, features=lx.SPEECH_FEATURES, threshold: float = 0.7, pronouns: str = PRONOUNS) -> Column:
    """Voices among the speeches of a text (an array, in order): a speech joins the first voice whose first speech has a like
    signature, else starts one. A fold, since the order matters; its state is one signature a voice."""
    names = list(features)
    low = lambda x: F.lower(x)
    signature = lambda x: F.array(t.token_count(x).cast("double"), t.count_any(low(x), features[names[0]]), t.count_any(low(x), features[names[1]]), t.count_sub(x, "?"), t.count_sub(x, "!"), F.regexp_count(low(x), F.lit(pronouns)).cast("double"))
    like = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 1.0).otherwise(1 - F.abs(x - y) / F.greatest(x, y, F.lit(1.0)))), F.lit(0.0), lambda s, x: s + x) / 6 >= threshold
    start = F.expr("cast(array() as array<array<double>>)")
    return F.size(F.aggregate(F.transform(speeches, signature), start, lambda a, x: F.when(F.exists(a, lambda y: like(x, y)), a).otherwise(F.concat(a, F.array(x)))))


def find_spans(df: DataFrame, pattern: str, text: str = "text", name: str = "spans", group: int = 0) -> DataFrame:
    """Adds all matches of a Python pattern with their places: array of text, start, end. One Arrow batch at a time."""
    kind = "array<struct<text:string,start:int,end:int>>"

    @F.pandas_udf(kind)
    def find(texts: pd.Series) -> pd.Series:
        compiled = re.compile(pattern)
        return texts.map(lambda x: None if x is None else [{"text": m[group], "start": m.start(group), "end": m.end(group)} for m in compiled.finditer(x)])

    return df.withColumn(name, find(F.col(text)))


def chunk_terms(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_index", text: str = "content", word: str = r"\p{L}{2,}", stop_words=(), top: int = 20) -> DataFrame:
    """Term scores of chunks (normalised counts of words and pairs) summed over the text: key, term, score, rank, terms."""
    return best_terms(chunks, key, order, text, word, stop_words, partial(summed, top=top))
