"""Readability, complexity, style and emotion measures: one row a text in, the same row with measures out.

Every operator takes a DataFrame and the name of its text column, keeps all other columns, and adds one struct column.
Null text: all measures are null. Empty text: counts are 0 and ratios divide by 1. Values are not rounded.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import lexicons as lx
from folio.functions import text as t
from folio.functions import vocabulary as v
from folio.functions.markers import count_lists

GRADES = [(0.2, "very_difficult"), (0.4, "difficult"), (0.6, "medium"), (0.8, "easy")]
LEVELS = [(0.3, "elementary"), (0.6, "intermediate"), (0.8, "advanced")]
# The marks that count as punctuation.
MARKS = ',;:!?-—()[]{}«»"'


def _add(df: DataFrame, text: str, name: str, steps: list[dict[str, Column]], fields: list[str]) -> DataFrame:
    """Adds helper columns step by step, packs the named ones, and drops the rest. Meanwhile the columns of `df` go by
    their numbers, so that no helper can take the name of one; one that is called `name` is replaced. Steps know the text as _text."""
    keep = [(i, c) for i, c in enumerate(df.columns) if c != name]
    made = df.select(*(F.col(f"`{c}`").alias(f"{i}") for i, c in keep), F.col(f"`{text}`").alias("_text"))
    for step in steps:
        made = made.withColumns(step)
    packed = F.when(F.col("_text").isNotNull(), F.struct(*(F.col(f"_{f}").alias(f) for f in fields)))
    return made.select(*(F.col(f"`{i}`").alias(c) for i, c in keep), packed.alias(name))


def readability(
    df: DataFrame, text: str = "text", word: str = t.LETTERS, vowels: str = t.LATIN_VOWELS, separator: str = "\n",
    stop_words=lx.STOP_WORDS, suffixes=lx.COMPLEX_SUFFIXES, connectives=lx.CONNECTIVES, abstract=lx.ABSTRACT,
    enumeration: str = r"(?U)\b(во-первых|во-вторых|в-третьих|первый|второй|третий)", conditional: str = r"(?U)\b(если|когда|поскольку).*,.*то\b",
    subordinate: str = r"(?U)\b(который|которая|которые|что|чтобы)\b", marks: str = MARKS, name: str = "readability", fields: list[str] | None = None,
) -> DataFrame:
    """Counts, five indices, lexical, organisational and cognitive measures, and the overall score with its grade; or only
    the `fields` named, and what they need. Words are sought sentence by sentence, so none goes past a sentence's end.
    `vowels` is a pattern as RE2 (Arrow) reads it: classes, groups and repeats, as in Java, but no look-around."""
    c, s = F.col("_text"), F.col("_s")
    n, k = F.col("_n"), F.size(s)
    low = F.col("_low")
    of = lambda x: F.col("_sums")[x]
    stops, endings = tuple(stop_words), tuple(suffixes)

    def measure(words):
        size, y, suffix = v.lengths(words), v.syllables(words, vowels), v.with_any(words, endings)
        return y, y >= 3, (size > 10) | suffix | (y > 4), np.minimum(size / 15, 1.0) + 0.5 * suffix, (size > 8) & suffix, ~v.listed(words, stops)

    asked = ["syllables", "long", "complex", "morphology", "concepts", "content"]
    asl, asw, cpw = F.col("_words_per_sentence"), F.col("_syllables_per_word"), F.col("_chars_per_word")
    some = (F.col("_words") > 0) & (F.col("_sentences") > 0)
    index = lambda x: F.when(some, x).otherwise(0.0)
    per = lambda a, b: a / F.greatest(b, F.lit(1))
    steps = [
        {"_low": F.lower(c)},
        {"_s": t.sentences(low)},
        {"_by_sentence": F.transform(s, lambda x: F.regexp_extract_all(x, F.lit(word), F.lit(0)))},
        # what is asked of each word; both run in Python, so they stand in one step
        {"_sums": v.word_sums(F.col("_by_sentence"), asked, measure, stops), "_hits": count_lists(low, {"connectives": connectives, "abstract": abstract})},
        {"_n": t.total(F.col("_by_sentence"), F.size), "_p": F.split(c, separator.replace("\n", "\\n")), "_pl": F.transform(t.paragraphs(c, separator), lambda x: t.token_count(x).cast("double")), "_tok": t.token_count(c)},
        {"_chars": F.length(F.regexp_replace(c, r"(?U)\s+", "")).cast("long"), "_words": n.cast("long"), "_sentences": k.cast("long"), "_paragraphs": F.size(t.paragraphs(c, separator)).cast("long"), "_syllables": of("syllables").cast("long")},
        {
            "_words_per_sentence": per(F.col("_words"), F.col("_sentences")), "_sentences_per_paragraph": per(F.col("_sentences"), F.col("_paragraphs")), "_syllables_per_word": per(F.col("_syllables"), F.col("_words")), "_chars_per_word": per(F.col("_chars"), F.col("_words")),
            "_lexical_diversity": per(of("distinct"), n), "_stop_words_ratio": per(n - of("content"), n),
            "_complex_words_ratio": per(of("complex"), n), "_morphological_complexity": per(of("morphology"), n),
            "_punctuation_density": per((F.length(c) - F.length(F.translate(c, marks, ""))) * 1000.0, F.length(c)),
        },
        {
            "_flesch": index(t.clamp(206.835 - 1.015 * asl - 84.6 * asw, 0.0, 100.0)), "_flesch_kincaid": index(F.greatest(0.39 * asl + 11.8 * asw - 15.59, F.lit(0.0))),
            "_smog": index(F.when(F.col("_sentences") >= 3, 1.043 * F.sqrt(30.0 * of("long") / F.greatest(F.col("_sentences"), F.lit(1))) + 3.1291).otherwise(0.0)),
            "_ari": index(F.greatest(4.71 * cpw + 0.5 * asl - 21.43, F.lit(0.0))),
            "_coleman_liau": index(F.greatest(0.0588 * cpw * 100 - 0.296 * per(100.0 * F.col("_sentences"), F.col("_words")) - 15.8, F.lit(0.0))),
            "_organization": F.least(
                F.when(F.size("_p") > 1, 0.3).otherwise(0.0)
                + F.when(F.size("_pl") > 0, 0.3 / (1 + t.variance(F.col("_pl")) / F.pow(F.greatest(t.mean(F.col("_pl")), F.lit(1e-9)), 2))).otherwise(0.0)
                + F.least(per(F.col("_hits")["connectives"], F.col("_tok")) * 10, F.lit(0.4)), F.lit(1.0)),
            "_coherence": F.when(k < 2, 1.0).otherwise(of("shared") / F.greatest(k - 1, F.lit(1))),
            "_parallel": F.least(per(t.total(s, lambda x: x.rlike(enumeration).cast("int") + x.rlike(conditional).cast("int")), k), F.lit(1.0)),
            "_information_density": F.when(n == 0, 0.0).otherwise(F.least((per(of("content"), n) + per(of("distinct_kept"), of("content"))) / 2, F.lit(1.0))),
            "_concept_complexity": F.when(n == 0, 0.0).otherwise(F.least(5 * (F.col("_hits")["abstract"] + of("concepts")) / F.greatest(n, F.lit(1)), F.lit(1.0))),
            "_memory_load": (F.least(asl / 30, F.lit(1.0)) + F.least(per((F.regexp_count(low, F.lit(r"(?U)\b\w+,\s*\w+,\s*\w+\b")) + F.regexp_count(low, F.lit(r"\([^)]+\)")) + F.regexp_count(low, F.lit(subordinate))) * 1.0, k), F.lit(1.0))) / 2,
        },
        {"_overall": t.clamp(50 + F.col("_flesch") * 0.25 + 100 * (-0.1 * F.col("_lexical_diversity") - 0.2 * F.col("_complex_words_ratio") + 0.1 * F.col("_stop_words_ratio") + 0.15 * F.col("_coherence") + 0.15 * F.col("_organization") - 0.1 * F.col("_information_density") - 0.15 * (1 - F.least(F.abs(asl - 17.5) / 17.5, F.lit(1.0)))), 0.0, 100.0) / 100},
        {"_grade": t.ladder(F.col("_overall"), GRADES, "very_easy")},
    ]
    fields = fields or "chars words sentences paragraphs syllables words_per_sentence sentences_per_paragraph syllables_per_word chars_per_word flesch flesch_kincaid smog ari coleman_liau lexical_diversity complex_words_ratio stop_words_ratio morphological_complexity punctuation_density organization coherence parallel information_density concept_complexity memory_load overall grade".split()
    return _add(df, text, name, steps, fields)


def complexity(
    df: DataFrame, common_words, text: str = "text", word: str = t.LETTERS, vowels: str = t.LATIN_VOWELS, separator: str = "\n", conjunctions=lx.CONJUNCTIONS, name: str = "complexity"
) -> DataFrame:
    """Linguistic, structural, lexical and syntactic complexity, and the overall score with its level. `common_words` is the list
    of words that don't count as rare; it has no default.
    `vowels` is a pattern as RE2 (Arrow) reads it."""
    c, s = F.col("_text"), F.col("_s")
    n, k = F.col("_n"), F.size(s)
    asl, asw, share = F.col("_words_per_sentence"), F.col("_syllables_per_word"), F.col("_complex_words_ratio")
    some = (n > 0) & (k > 0)
    of = lambda x: F.when(some, x).otherwise(0.0)
    per = lambda a, b: a / F.greatest(b, F.lit(1))
    sums = lambda x: F.col("_sums")[x]
    known = tuple(common_words)

    def measure(words):
        y = v.syllables(words, vowels)
        return y, y > 3, v.lengths(words), ~v.listed(words, known)

    steps = [
        {"_low": F.lower(c)},
        {"_s": t.sentences(F.col("_low"))},
        {"_by_sentence": F.transform(s, lambda x: F.regexp_extract_all(x, F.lit(word), F.lit(0)))},
        {"_sums": v.word_sums(F.col("_by_sentence"), ["syllables", "complex", "chars", "rare"], measure), "_hits": count_lists(F.col("_low"), {"conjunctions": conjunctions})},
        {"_lengths": F.transform("_by_sentence", lambda x: F.size(x).cast("double")), "_n": t.total(F.col("_by_sentence"), F.size), "_paragraphs": F.size(t.paragraphs(c, separator)).cast("long")},
        {"_words_per_sentence": of(n / F.greatest(k, F.lit(1))), "_syllables_per_word": of(per(sums("syllables"), n)), "_complex_words_ratio": of(per(sums("complex"), n)), "_word_length": per(sums("chars"), n)},
        {
            "_flesch": of(t.clamp(206.835 - 1.52 * asl - 65.14 * asw, 0.0, 100.0) / 100), "_ari": of(t.clamp(4.71 * F.col("_word_length") + 0.5 * asl - 21.43, 0.0, 20.0) / 20), "_fog": of(t.clamp(0.4 * (asl + 100 * share), 0.0, 20.0) / 20),
            "_sentence_length_variance": t.variance(F.col("_lengths")),
            "_sentence_length_ratio": F.when(k > 0, (F.array_max("_lengths") - F.array_min("_lengths")) / F.greatest(F.array_max("_lengths"), F.lit(1.0))).otherwise(0.0),
            "_sentences_per_paragraph": per(k, F.col("_paragraphs")),
            "_lexical_diversity": F.when(n > 0, per(sums("distinct"), n)), "_rare_words_ratio": F.when(n > 0, per(sums("rare"), n)),
            "_lexical_entropy": F.when(n > 0, F.least((F.log2(F.greatest(n, F.lit(1)).cast("double")) - per(sums("spread"), n)) / 10, F.lit(1.0))),
            "_comma_density": per(t.count_sub(c, ",") * 1000, F.length(c)), "_conjunction_density": per(F.col("_hits")["conjunctions"], n),
            "_complex_sentence_ratio": per(F.size(F.filter(F.zip_with(s, "_lengths", lambda x, y: (t.count_sub(x, ",") > 2) | t.contains_any(x, conjunctions) | (y > 20)), lambda x: x)), k),
            "_commas_per_sentence": per(t.count_sub(c, ","), k),
        },
    ]
    weights = {"flesch": -0.3, "ari": 0.2, "fog": 0.2, "lexical_diversity": 0.15, "rare_words_ratio": 0.15, "conjunction_density": 0.1, "complex_sentence_ratio": 0.1, "lexical_entropy": 0.1}
    top, bottom = t.weighted({x: F.col(f"_{x}") for x in weights}, weights)
    steps += [{"_overall": t.clamp(F.abs(top) / bottom)}, {"_level": t.ladder(F.col("_overall"), LEVELS, "expert")}]
    fields = "flesch ari fog words_per_sentence syllables_per_word complex_words_ratio paragraphs sentences_per_paragraph sentence_length_variance sentence_length_ratio lexical_diversity rare_words_ratio word_length lexical_entropy comma_density conjunction_density complex_sentence_ratio commas_per_sentence overall level".split()
    return _add(df, text, name, steps, fields)


def style(df: DataFrame, text: str = "text", separator: str = "\n", name: str = "style") -> DataFrame:
    """Word, sentence and paragraph counts, mean lengths, share of words over 7 characters, type-token ratio."""
    c, w = F.col("_text"), F.col("_w")
    n = F.size(w)
    per = lambda a, b: a / F.greatest(b, F.lit(1))
    steps = [
        {"_w": t.words(c, r"(?U)\b\w+\b")},
        {"_words": n.cast("long"), "_unique_words": F.size(F.array_distinct(w)).cast("long"), "_sentences": F.size(t.sentences(c)).cast("long"), "_paragraphs": F.size(t.paragraphs(c, separator)).cast("long")},
        {"_words_per_sentence": per(F.col("_words"), F.col("_sentences")), "_word_length": per(t.total(w, lambda x: F.length(x)), n), "_long_words_ratio": per(F.size(F.filter(w, lambda x: F.length(x) > 7)), n), "_type_token_ratio": per(F.col("_unique_words"), n)},
    ]
    return _add(df, text, name, steps, "words unique_words sentences paragraphs words_per_sentence word_length long_words_ratio type_token_ratio".split())


def emotion(df: DataFrame, text: str = "text", emotions=lx.EMOTIONS, positive=("радость",), negative=("грусть", "гнев", "страх", "отвращение"), limit: int | None = None, name: str = "emotion") -> DataFrame:
    """Lexicon emotions of the whole text, or of its first `limit` characters: occurrences a word, times 10, rounded to
    3 places; the dominant one (the first of equals, in the order given), tone and tone score."""
    c = F.col("_text") if limit is None else F.left("_text", F.lit(limit))
    n = F.greatest(F.size(t.tokens(c)), F.lit(1))
    keys = list(emotions)
    steps = [{"_hits": count_lists(F.lower(c), {f"e{i}": emotions[k] for i, k in enumerate(keys)}), "_n": n}]
    steps += [{f"_e{i}": F.round(F.col("_hits")[f"e{i}"] / F.col("_n") * 10, 3) for i in range(len(keys))}]
    of = lambda names: sum((F.col(f"_e{keys.index(k)}") for k in names), F.lit(0.0))
    p, q = F.col("_p"), F.col("_q")
    best = F.array_max(F.array(*(F.struct(F.col(f"_e{i}").alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(keys))))
    tone = F.when(p > q * 1.2, "positive").when(q > p * 1.2, "negative").otherwise("neutral")
    steps += [
        {"_p": of(positive), "_q": of(negative), "_dominant": best["k"], "_scores": F.create_map(*(x for i, k in enumerate(keys) for x in (F.lit(k), F.col(f"_e{i}"))))},
        {"_tone": tone, "_tone_score": t.clamp(F.when(p > q * 1.2, 0.6 + (p - q) * 0.1).when(q > p * 1.2, 0.4 - (q - p) * 0.1).otherwise(0.5))},
    ]
    return _add(df, text, name, steps, ["dominant", "scores", "tone", "tone_score"])


def rollup(df: DataFrame, by: list[str], metrics: dict[str, Column]) -> DataFrame:
    """Average, least and greatest of chunk measures for each text, and consistency (1 - population variance, at least 0; only
    over several chunks). Partial sums are made before the shuffle."""
    aggs = [F.count("*").alias("chunks")]
    for name, m in metrics.items():
        aggs += [F.avg(m).alias(f"avg_{name}"), F.min(m).alias(f"min_{name}"), F.max(m).alias(f"max_{name}"), F.when(F.count(m) > 1, F.greatest(F.lit(0.0), 1 - F.var_pop(m))).alias(f"consistency_{name}")]
    return df.groupBy(*by).agg(*aggs)
