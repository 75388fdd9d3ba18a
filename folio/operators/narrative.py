"""Scores of chunks by word lists, and what texts make of them: characters, tension, pace, dialogue, water, structure.

Operators take and return DataFrames; word lists, thresholds and separators are arguments. Null texts give null scores.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import lexicons as lx
from folio.functions import text as t
from folio.functions.markers import count_lists, count_lists_in, keys_in
from folio.functions.vocabulary import often_used
from folio.operators.description import FACTS, KEY_MARKERS, PATTERNS, information_density, overall_structure, pattern_counts, transition
from folio.operators.readability import rollup
from folio.operators.terms import best_terms, frequent

PACE = [(4.0, "slow"), (7.0, "medium")]
WATER = [(20.0, "concise"), (50.0, "balanced")]


def _safe(n: Column) -> Column:
    return F.greatest(n, F.lit(1))


def _counted(c: Column, lists) -> Column:
    """Number of words, and occurrences of word lists in the lower-cased text."""
    return F.struct(t.token_count(c).alias("n"), count_lists(F.lower(c), lists).alias("hits"))


def character_score(c: Column, keywords=lx.CHARACTER) -> Column:
    marks = t.count_sub(c, "—") + t.count_sub(c, '"') + t.count_sub(c, "«")
    names = F.regexp_count(c, F.lit(r"(?<=[а-яa-z]\s)[А-ЯA-Z][а-яa-z]+"))

    def score(x):
        n = x["n"]
        found = 0.4 * F.least(x["hits"]["key"] / _safe(n), F.lit(1.0)) + 0.4 * F.least(marks / 10, F.lit(1.0)) + 0.2 * F.least(names / _safe(n), F.lit(1.0))
        return F.when(n == 0, 0.0).when(n > 0, F.least(found, F.lit(1.0)))

    return t.let(_counted(c, {"key": keywords}), score)


def tension_score(c: Column, keywords=lx.TENSION) -> Column:
    """0 to 10."""
    short = t.let(F.split(c, "[.!?]+"), lambda p: F.size(F.filter(p, lambda x: t.token_count(x).between(1, 7))) / F.size(p))

    def score(x):
        n = x["n"]
        found = 5 * F.least(20 * x["hits"]["key"] / _safe(n), F.lit(1.0)) + 3 * F.least(t.count_sub(c, "!") / 5, F.lit(1.0)) + 2 * short
        return F.when(n == 0, 0.0).when(n > 0, F.least(found, F.lit(10.0)))

    return t.let(_counted(c, {"key": keywords}), score)


def event_density(c: Column, events=lx.EVENTS, fast=lx.FAST, slow=lx.SLOW) -> Column:
    def score(x):
        n, hits = x["n"], x["hits"]
        found = F.least(hits["events"] / _safe(n), F.lit(1.0)) + 0.3 * (hits["fast"] - hits["slow"]) / _safe(n)
        return F.when(n == 0, 0.0).when(n > 0, t.clamp(found))

    return t.let(_counted(c, {"events": events, "fast": fast, "slow": slow}), score)


def dialogue_ratio(c: Column) -> Column:
    """The straight quote counts twice, as a mark of either side."""
    return F.least((t.count_sub(c, "—") + 2 * t.count_sub(c, '"') + t.count_sub(c, "«")) / 20, F.lit(1.0))


def relevant(chunks: DataFrame, kind: str, threshold: float | None = None, text: str = "content", key: str = "doc_id") -> DataFrame:
    """Chunks whose score for `kind` (character, tension; others keep all) reaches the threshold, with coverage of their text.
    Columns called score or coverage are replaced."""
    score, least = {"character": (character_score(F.col(text)), 0.3), "tension": (tension_score(F.col(text)), 0.5)}.get(kind, (F.lit(1.0), 0.0))
    least = least if threshold is None else threshold
    w = Window.partitionBy(key)
    return chunks.withColumn("score", score).withColumn("coverage", F.count_if(F.col("score") >= least).over(w) / F.count("*").over(w)).where(F.col("score") >= least)


# How many chunks of a text each analyzer takes.
MOST_CHUNKS = {"character": 30, "style": 3, "dialogue": 3}


def first_chunks(chunks: DataFrame, most: int, key: str = "doc_id", order: str = "chunk_index") -> DataFrame:
    """The first `most` chunks of each text; Spark keeps no more of a text in any task."""
    (place,) = t.free(chunks, "place")
    return chunks.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col(place) <= most).drop(place)


def pace_scores(chunks: DataFrame, text: str = "content") -> DataFrame:
    """Pace of each chunk: min(10 * (7 * events + 3 * dialogue), 10)."""
    out = chunks.withColumns({"event_density": event_density(F.col(text)), "dialogue_ratio": dialogue_ratio(F.col(text))})
    return out.withColumn("pace", F.least(10 * (7 * F.col("event_density") + 3 * F.col("dialogue_ratio")), F.lit(10.0)))


def pace_report(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    stats = scored.groupBy(key).agg(F.median("pace").alias("median_pace"), F.min("pace").alias("min_pace"), F.max("pace").alias("max_pace"), F.avg("pace").alias("avg_pace"), F.var_pop("pace").alias("pace_variance"), F.avg("event_density").alias("avg_event_density"), F.avg("dialogue_ratio").alias("avg_dialogue_ratio"))
    return stats.withColumn("pace_class", t.ladder(F.col("median_pace"), PACE, "fast"))


def timeline(scored: DataFrame, rate: float = 0.1, key: str = "doc_id", order: str = "chunk_index") -> DataFrame:
    """Every max(int(n * rate), 1)-th chunk."""
    w = Window.partitionBy(key)
    step, ordinal = t.free(scored, "step", "ordinal")
    rows = scored.withColumns({step: F.greatest(F.floor(F.count("*").over(w) * rate), F.lit(1)), ordinal: F.row_number().over(w.orderBy(order)) - 1})
    return rows.where(F.col(ordinal) % F.col(step) == 0).drop(step, ordinal)


def tension_report(chunks: DataFrame, peak: float = 0.6, peaks: int = 15, text: str = "content", key: str = "doc_id", order: str = "chunk_index") -> DataFrame:
    """Mean tension of each text and its first `peaks` chunks over the threshold, in order."""
    scored = chunks.select(key, order, tension_score(F.col(text)).alias("tension"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("tension") < peak, order))
    first = F.when((F.col("tension") >= peak) & (F.col("_n") <= peaks), F.struct(F.col(order), "tension"))
    return scored.withColumn("_n", place).groupBy(key).agg(F.avg("tension").alias("avg_tension"), F.count_if(F.col("tension") >= peak).alias("peak_count"), F.array_sort(F.collect_list(first)).alias("peaks"))


# Patterns, marks and words that results depend on.
SPEECH = [r"[—–]\s*([^—–\n]+?)(?=[.!?\n])", r"[\"«]([^\"»]+)[\"»]", r":\s*[—–]\s*([^—–\n]+?)(?=[.!?\n])"]
INCOMPLETE = r"(?iu)^[а-я].*[^.!?]$"
COLLOQUIAL = "ну вот блин типа короче слушай смотри".split()
INTERJECTIONS = "ах ох эх ух фу ба ого ага угу".split()
NATURAL = "ну вот да нет ага".split()
DIALOGUE_GRADES = [(0.2, "неудовлетворительный"), (0.4, "слабый"), (0.6, "удовлетворительный"), (0.8, "хороший")]
DIALOGUE_WEIGHTS = {"structure": 0.25, "speech_diversity": 0.2, "emotional_diversity": 0.2, "authenticity": 0.25, "dialogue_ratio": 0.1}


def _spoken(c: Column, verbs) -> Column:
    """Lines (stripped, blank ones left out and not counted) with direct speech: i, parts, author_words."""
    author = "(?iu)(" + "|".join(sorted(verbs, key=len, reverse=True)) + ")"

    def of(line, i):
        parts = F.transform(F.concat(*(F.regexp_extract_all(line, F.lit(p), F.lit(1)) for p in SPEECH)), t.strip)
        return F.struct(i.alias("i"), parts.alias("parts"), F.regexp_count(line, F.lit(author)).alias("author_words"))

    return F.filter(F.transform(t.pieces(c, "\\n"), of), lambda x: F.size(x["parts"]) > 0)


def speech(df: DataFrame, key: str = "doc_id", text: str = "text", verbs=lx.AUTHOR_VERBS) -> DataFrame:
    """One row a line with direct speech: key, paragraph_index (among lines that aren't blank), parts (texts of speech after a
    dash, in quotes, after a colon and a dash, stripped; a passage may match twice), author_words."""
    rows = df.select(F.col(key), F.explode(_spoken(F.col(text), verbs)).alias("x"))
    return rows.select(key, F.col("x.i").alias("paragraph_index"), "x.parts", "x.author_words")


def dialogue_report(
    df: DataFrame, key: str = "doc_id", text: str = "text", emotions=lx.SPEECH_EMOTIONS, features=lx.SPEECH_FEATURES, verbs=lx.AUTHOR_VERBS,
    colloquial=COLLOQUIAL, interjections=INTERJECTIONS, natural=NATURAL, separator: str = "\n",
) -> DataFrame:
    """One row a text, made in its own row: counts, ratio of speech to all words, spread and longest run of dialogue lines,
    author words, speech length and diversity, marker and punctuation rates, syntax, authenticity, overall score and grade.
    Texts without speech: zeros. Null texts: as texts without speech."""
    c = F.col(f"`{text}`")
    rows = df.select(F.col(key), c.alias("_t"), F.coalesce(_spoken(c, verbs), F.expr("cast(array() as array<struct<i:int,parts:array<string>,author_words:int>>)")).alias("_d"))
    rows = rows.withColumns({"_parts": F.flatten(F.transform("_d", lambda x: x["parts"])), "_at": F.transform("_d", lambda x: x["i"])})
    rows = rows.withColumns(
        {"_low": F.transform("_parts", F.lower), "_len": F.transform("_parts", lambda x: t.token_count(x).cast("double")), "_n": F.size("_parts"), "_w": F.flatten(F.transform("_parts", lambda x: t.words(x, r"(?U)\b\w+\b")))}
    )
    # a line after one with speech goes on with its run
    runs = F.aggregate(
        "_at", F.expr("named_struct('last', -2, 'run', 0, 'best', 0)"),
        lambda a, i: t.let(F.when(i == a["last"] + 1, a["run"] + 1).otherwise(1), lambda r: F.struct(i.alias("last"), r.alias("run"), F.greatest(a["best"], r).alias("best"))), lambda a: a["best"],
    )
    over = lambda column, value: t.total(F.col(column), value)
    lists = {f"_e{i}": v for i, v in enumerate(emotions.values())} | {f"_f{i}": v for i, v in enumerate(features.values())} | {"_natural": natural}
    rows = rows.withColumn("_hits", count_lists_in(F.col("_low"), lists))
    counted = {name: F.col("_hits")[name] for name in lists}
    marks = {"_q": over("_low", lambda x: t.count_sub(x, "?")), "_x": over("_low", lambda x: t.count_sub(x, "!")), "_dots": over("_low", lambda x: t.count_sub(x, "...")), "_dot": over("_low", lambda x: t.count_sub(x, "…"))}
    rows = rows.withColumns({
        **counted, **marks, "_run": runs, "_speech_words": over("_len", lambda x: x), "_speech_chars": over("_parts", lambda x: F.length(x)), "_words": t.token_count("_t"), "_author": over("_d", lambda x: x["author_words"]),
        "_simple": F.size(F.filter("_parts", lambda x: ~F.contains(x, F.lit(",")))), "_incomplete": F.size(F.filter("_parts", lambda x: x.rlike(INCOMPLETE))), "_open": F.size(F.filter("_parts", lambda x: ~x.rlike(r"[.!?]$"))),
        "_colloquial": t.count_in(F.col("_w"), colloquial), "_interjections": t.count_in(F.col("_w"), interjections),
        "_distinct": F.size(F.array_distinct("_w")), "_blocks": F.size(F.split("_t", separator.replace("\n", "\\n"))), "_length_variance": t.variance(F.col("_len")),
    })
    n, some, of_words = _safe(F.col("_n")), F.size("_d") > 0, _safe(F.size("_w"))
    emotional = sum((F.col(f"_e{i}") for i in range(len(emotions))), F.lit(0.0))
    ratio = F.when(some, F.col("_speech_words") / _safe(F.col("_words"))).otherwise(0.0)
    zero = lambda x: F.when(some, x).otherwise(0.0)
    out = rows.select(
        key, F.size("_d").cast("long").alias("dialogue_count"), F.col("_speech_words").cast("long").alias("speech_words"), F.col("_speech_chars").cast("long").alias("speech_chars"), ratio.alias("dialogue_ratio"),
        F.when(ratio < 1, ratio / (1 - ratio)).otherwise(F.lit(float("inf"))).alias("speech_to_narrative"), (F.col("_speech_words") / n).alias("avg_speech_length"), F.col("_length_variance").alias("speech_length_variance"),
        (F.col("_distinct") / of_words).alias("speech_diversity"), F.col("_run").cast("long").alias("longest_run"),
        zero(F.when(F.col("_blocks") > 1, 1 - (F.array_max("_at") - F.array_min("_at")) / F.col("_blocks")).otherwise(1.0)).alias("spread"), zero(F.greatest(F.lit(0.0), 1 - F.col("_run") / 10)).alias("alternation"),
        F.least(F.col("_author") / _safe(F.size("_d")) / 2, F.lit(1.0)).alias("author_integration"),
        (F.col("_q") / n).alias("questions_per_utterance"), (F.col("_x") / n).alias("exclamations_per_utterance"), ((F.col("_dots") + F.col("_dot")) / n).alias("ellipses_per_utterance"),
        (sum((F.when(F.col(f"_e{i}") > 0, 1).otherwise(0) for i in range(len(emotions))), F.lit(0)) / len(emotions)).alias("emotional_diversity"), (emotional / n).alias("emotional_intensity"),
        *(F.when(emotional > 0, F.col(f"_e{i}") / emotional).otherwise(0.0).alias(f"emotion_{i}_share") for i in range(len(emotions))), *((F.col(f"_f{i}") / n).alias(f"feature_{i}_rate") for i in range(len(features))),
        (F.col("_simple") / n).alias("simple_ratio"), (F.col("_incomplete") / n).alias("incomplete_ratio"), (F.col("_colloquial") / of_words).alias("colloquial_ratio"), (F.col("_interjections") / of_words).alias("interjection_ratio"),
        zero(F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), F.col("_speech_words") / n - 20) / 30)).alias("length_authenticity"), zero(F.least(F.col("_natural") / n, F.lit(1.0))).alias("colloquial_authenticity"),
        zero(F.least((F.col("_x") + F.col("_q") + F.col("_dots")) / n / 2, F.lit(1.0))).alias("emotional_authenticity"), zero(F.least(F.col("_open") / n * 2, F.lit(1.0))).alias("structural_authenticity"),
    )
    mean = lambda *names: sum((F.col(x) for x in names), F.lit(0.0)) / len(names)
    out = out.withColumns({"structure": mean("spread", "alternation", "author_integration"), "authenticity": mean("length_authenticity", "colloquial_authenticity", "emotional_authenticity", "structural_authenticity")})
    return out.withColumn("overall", overall_dialogue({k: F.col(k) for k in DIALOGUE_WEIGHTS}, F.col("dialogue_count"))).withColumn("grade", t.ladder(F.col("overall"), DIALOGUE_GRADES, "отличный"))


def overall_dialogue(m: dict[str, Column], count: Column) -> Column:
    """Weighted mean of the measures that are there; the ratio by its distance from 0.3. Without dialogues 0."""
    near = dict(m) | ({"dialogue_ratio": F.greatest(F.lit(0.0), 1 - F.abs(m["dialogue_ratio"] - 0.3) / 0.3)} if "dialogue_ratio" in m else {})
    top, bottom = t.weighted({k: near.get(k, F.lit(None).cast("double")) for k in DIALOGUE_WEIGHTS}, DIALOGUE_WEIGHTS)
    return F.when((count > 0) & (bottom > 0), top / bottom).otherwise(0.0)


def positive_rollup(df: DataFrame, by: list[str], count: Column, metrics: dict[str, Column]) -> DataFrame:
    """Chunk measures to their text: sum of a count, chunks that have any and their share, mean and greatest of each measure
    over the chunks where it is above 0 (none: null)."""
    aggs = [F.count("*").alias("chunks"), F.sum(count).alias("total"), F.count_if(count > 0).alias("chunks_with_any")]
    for name, m in metrics.items():
        aggs += [F.avg(F.when(m > 0, m)).alias(f"avg_{name}"), F.max(F.when(m > 0, m)).alias(f"max_{name}")]
    out = df.groupBy(*by).agg(*aggs)
    return out.withColumn("share", F.col("chunks_with_any") / F.col("chunks"))


def dialogue_rollup(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_index", text: str = "content", **options) -> DataFrame:
    """Dialogues chunk by chunk, rolled up to the text. A chunk's score has no structure and no authenticity part."""
    each = dialogue_report(chunks.select(F.struct(key, order).alias("__k"), F.col(text)), "__k", text, **options)
    overall = overall_dialogue({k: F.col(k) for k in ("speech_diversity", "emotional_diversity", "dialogue_ratio")}, F.col("dialogue_count"))
    rows = each.withColumn("overall", overall).select(F.col(f"__k.{key}").alias(key), "dialogue_count", "overall", "dialogue_ratio", "speech_diversity", "emotional_diversity")
    out = positive_rollup(rows, [key], F.col("dialogue_count"), {k: F.col(k) for k in ("overall", "dialogue_ratio", "speech_diversity", "emotional_diversity")})
    return out.withColumn("grade", t.ladder(F.coalesce("avg_overall", F.lit(0.0)), DIALOGUE_GRADES, "отличный"))


def keywords(c: Column, stop_words=lx.KEYWORD_STOPS) -> Column:
    """Letters of words with more than four of them, without stop words."""
    return F.filter(_long_words(c), lambda x: ~F.array_contains(t.word_list(stop_words), x))


def _long_words(c: Column) -> Column:
    """Letters of words with more than four of them: what is neither letter nor white space goes first, from the whole text."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\s\x1C-\x1F]+", ""), F.lit(r"\p{L}{5,}"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def repetitions(chunks: DataFrame, patterns=lx.REPEATS, text: str = "content", key: str = "doc_id", order: str = "chunk_index") -> DataFrame:
    """Neighbour chunks that say things again: a row for each marker phrase in either, where keyword Jaccard is over 0.3, and one
    where three or more keywords are shared: key, chunk_index, kind, phrase, similarity."""
    w = Window.partitionBy(key).orderBy(order)
    listed = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).alias("phrase")) for k, v in patterns.items() for p in v))
    nothing = F.expr("cast(array() as array<struct<kind:string,phrase:string>>)")
    # what a chunk has is found once, and only that is handed to its neighbour
    found = chunks.select(key, order, F.array_except(_long_words(F.col(text)), t.word_list(lx.KEYWORD_STOPS)).alias("ka"), keys_in(F.lower(text), [p for v in patterns.values() for p in v]).alias("found"))
    own = found.select(key, order, "ka", F.filter(listed, lambda x: F.array_contains("found", x["phrase"])).alias("pa"))
    pairs = own.withColumns({"kb": F.lead("ka").over(w), "pb": F.lead("pa").over(w)}).where("kb is not null").withColumn("both", F.size(F.array_intersect("ka", "kb")))
    # of sets, so the union needn't be made
    pairs = pairs.withColumn("similarity", F.when(F.col("both") > 0, F.col("both") / (F.size("ka") + F.size("kb") - F.col("both"))).otherwise(0.0))
    either = F.filter(listed, lambda x: F.array_contains("pa", x) | F.array_contains("pb", x))
    hits = F.when(F.col("similarity") > 0.3, either).otherwise(nothing)
    shared = F.when(F.col("both") >= 3, F.array(F.struct(F.lit("keywords").alias("kind"), F.lit(None).cast("string").alias("phrase")))).otherwise(nothing)
    return pairs.select(key, order, F.explode(F.concat(hits, shared)).alias("x"), "similarity").select(key, order, "x.*", "similarity")


def water_report(chunks: DataFrame, patterns=lx.WATER, text: str = "content", key: str = "doc_id", order: str = "chunk_index", repeats=lx.REPEATS) -> DataFrame:
    """Share of words that carry nothing: phrases, words used more than five times, neighbours that repeat; in percent, with a
    rating. No words: 50. Phrases are sought in the text of all chunks, joined by blanks; words are counted over it too."""
    by_size: dict[int, list[str]] = {}
    for phrase in (p for v in patterns.values() for p in v):
        by_size.setdefault(len(phrase.split()), []).append(phrase)
    sums = chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.count(text).alias("some"), F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("c")))).alias("parts"))
    # a text again, as long as it was; its words are those of its chunks
    sums = sums.select(key, "chunks", "some", F.lower(F.array_join(F.transform("parts", lambda x: x["c"]), " ")).alias("whole"))
    sums = sums.withColumn("tokens", t.tokens_at_blanks(F.col("whole")))
    sums = sums.withColumns({"hits": count_lists(F.col("whole"), {f"words_{k}": v for k, v in by_size.items()}), "repetitive": often_used(F.col("tokens"), 3, 5)})
    words = F.when(F.col("some") > 0, F.size("tokens"))
    sums = sums.select(key, "chunks", "repetitive", words.alias("words"), sum((F.col("hits")[f"words_{k}"] * k for k in by_size), F.lit(0.0)).alias("phrase_words"))
    again = repetitions(chunks, repeats, text, key, order).groupBy(key).agg(F.count("*").alias("repeats"))
    out = sums.join(again, key, "left")
    part = lambda c: 100 * F.coalesce(F.col(c), F.lit(0)) / _safe(F.col("words"))
    semantic = 100 * F.coalesce("repeats", F.lit(0)) / _safe(F.col("chunks"))
    water = F.when(F.col("words") == 0, 50.0).otherwise(F.least(part("phrase_words") + part("repetitive") + semantic, F.lit(100.0)))
    out = out.select(key, water.alias("water"), part("phrase_words").alias("phrase_water"), part("repetitive").alias("repetition_water"), semantic.alias("semantic_water"))
    return out.withColumn("info_density", 1 - F.col("water") / 100).withColumn("rating", t.ladder(F.col("water"), WATER, "verbose"))


def frequent_words(chunks: DataFrame, text: str = "content", key: str = "doc_id", least: int = 4, top: int = 10) -> DataFrame:
    """Words of more than three characters that a text uses `least` times or more: the `top` most frequent. Ties by word."""
    counts = chunks.select(key, F.explode(t.tokens(F.lower(text))).alias("word")).where("length(word) > 3").groupBy(key, "word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


STRUCTURE_GRADES = [(0.3, "неудовлетворительная"), (0.5, "слабая"), (0.65, "удовлетворительная"), (0.8, "хорошая")]


def structure_report(df: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n", links=lx.LINKS, parts=lx.COMPOSITION, markers=KEY_MARKERS, facts=FACTS, patterns=PATTERNS) -> DataFrame:
    """Paragraph and sentence statistics, paragraph classes and transitions, connectives, composition, rhythm and tempo,
    information density, narrative patterns, overall score and grade. One row a text, made in its own row.

    Lengths count parts between white space. `parts` are the composition markers by element, in order: introduction,
    development, climax, conclusion; with other numbers of elements the type is left out."""
    c = F.col(f"`{text}`")
    rows = df.select(F.col(key), c.alias("_t"), F.lower(c).alias("_l"), t.paragraphs(c, separator).alias("_p"), t.sentences(c).alias("_s"))
    rows = rows.withColumns({"_pl": F.transform("_p", lambda x: t.token_count(x).cast("double")), "_sl": F.transform("_s", lambda x: t.token_count(x).cast("double")), "_ends": F.transform("_p", lambda x: t.let(t.sentences(x), lambda s: F.struct(F.get(s, F.lit(0)).alias("first"), F.try_element_at(s, F.lit(-1)).alias("last"))))})
    steps = F.when(F.size("_ends") > 1, F.sequence(F.lit(1), F.size("_ends") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    step = lambda i: F.coalesce(transition(F.get("_ends", i - 1)["last"], F.get("_ends", i)["first"], links), F.lit(0.0))
    lists = {f"links_{i}": v for i, v in enumerate(links.values())} | {f"part_{i}": v for i, v in enumerate(parts.values())}
    rows = rows.withColumn("_hits", count_lists(F.col("_l"), {**lists, "_keys": markers}))
    kinds = {name: F.col("_hits")[name] for name in lists}
    marks = {f"_m{i}": sum((t.count_sub(F.col("_t"), x) for x in v), F.lit(0.0)) for i, v in enumerate(((",", ";", ":"), ("!", "?"), ("...", "—", "–")))}
    rows = rows.withColumns({
        **kinds, **marks, "_words": t.token_count("_t"), "mean_p": t.mean(F.col("_pl")), "sum_p": t.total(F.col("_pl")), "mean_s": t.mean(F.col("_sl")), "var_p": t.variance(F.col("_pl")), "var_s": t.variance(F.col("_sl")),
        "_steps": F.when(F.size("_ends") < 2, 1.0).otherwise(t.total(steps, step) / F.greatest(F.size("_ends") - 1, F.lit(1))), "information_density": information_density(F.col("_t"), markers, facts, F.col("_hits")["_keys"], F.col("_s")), "_kinds": pattern_counts(F.col("_t"), patterns),
    })
    k, size = _safe(F.size("_s")), _safe(F.size("_pl"))
    regular = F.when(F.col("mean_p") > 0, F.greatest(F.lit(0.0), 1 - t.mean(F.col("_pl"), lambda x: F.abs(x - F.col("mean_p"))) / F.greatest("mean_p", F.lit(1e-9)))).otherwise(0.0)
    short, medium, long = (F.size(F.filter("_pl", f)) / size for f in (lambda x: x < 50, lambda x: (x >= 50) & (x <= 150), lambda x: x > 150))
    link = sum((F.col(f"links_{i}") for i in range(len(links))), F.lit(0.0))
    part = [F.col(f"part_{i}") for i in range(len(parts))]
    whole = sum(part, F.lit(0.0))
    there = lambda p, n: sum((F.when(F.col(f"{p}_{i}") > 0, 1).otherwise(0) for i in range(n)), F.lit(0)) / max(1, n)
    spread = sum((F.pow(x / F.greatest(whole, F.lit(1e-9)) - 1 / max(1, len(parts)), 2) for x in part), F.lit(0.0)) / max(1, len(parts))
    variation = F.when(F.col("mean_s") > 0, F.sqrt("var_s") / F.greatest("mean_s", F.lit(1e-9))).otherwise(0.0)
    density = lambda x: 1000 * F.col(x) / _safe(F.length("_t"))
    types = F.lit(None).cast("string")
    if len(part) == 4:
        intro, development, climax, conclusion = part
        types = (
            F.when((intro > 0) & (conclusion > 0) & (development > 0), "linear").when((intro > 0) & (conclusion > 0), "circular").when(development > climax + conclusion, "parallel")
            .when((intro > 0) & (development > 0) & (climax > 0) & (conclusion > 0), "classical").otherwise("mosaic")
        )
    pattern_sum = F.aggregate(F.map_values("_kinds"), F.lit(0.0), lambda a, x: a + x)
    out = rows.select(
        key, F.size("_p").cast("long").alias("paragraphs"), F.size("_s").cast("long").alias("sentences"), F.col("mean_p").alias("paragraph_length"), F.when(F.size("_s") > 0, F.col("_words") / k).otherwise(0.0).alias("sentence_length"),
        F.col("var_p").alias("paragraph_variance"), F.col("var_s").alias("sentence_variance"), regular.alias("paragraph_regularity"), (F.size("_s") / size).alias("sentences_per_paragraph"),
        short.alias("short_paragraphs"), medium.alias("medium_paragraphs"), long.alias("long_paragraphs"), F.greatest(medium - 0.5 * short - 0.3 * long, F.lit(0.0)).alias("paragraph_balance"), F.col("_steps").alias("transition_quality"),
        (link / k).alias("connective_density"), F.when(F.size("_s") > 0, F.least(link / k / 0.3, F.lit(1.0))).otherwise(0.0).alias("logical_flow"), there("links", len(links)).alias("connective_diversity"),
        there("part", len(parts)).alias("completeness"), F.when(whole > 0, 1 - spread).otherwise(0.0).alias("composition_balance"), types.alias("composition_type"),
        variation.alias("variation"), F.when(F.size("_s") > 0, 1 - F.abs(variation - 0.5) / 0.5).otherwise(0.0).alias("rhythm"), (1000 * F.size("_p") / F.greatest("sum_p", F.lit(1.0))).alias("pause_frequency"),
        density("_m0").alias("slow_density"), density("_m1").alias("fast_density"), density("_m2").alias("pause_density"), (F.col("_m1") / F.greatest("_m0", F.lit(1.0))).alias("tempo_ratio"), "information_density",
        (F.size(F.filter(F.map_values("_kinds"), lambda x: x > 0)) / max(1, len(patterns))).alias("narrative_diversity"), F.when(F.size("_s") > 0, pattern_sum / k).otherwise(0.0).alias("narrative_density"),
    )
    structured = F.when(F.col("paragraphs") > 0, (F.col("paragraph_balance") + F.col("transition_quality")) / 2).otherwise(0.0)
    m = {"paragraph_structure": structured} | {x: F.col(x) for x in ("logical_flow", "completeness", "rhythm", "information_density", "narrative_diversity")}
    return out.withColumns({"paragraph_structure": structured, "overall": overall_structure(m)}).withColumn("grade", t.ladder(F.col("overall"), STRUCTURE_GRADES, "отличная"))


def structure_rollup(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_index", text: str = "content", **options) -> DataFrame:
    """Structure chunk by chunk, rolled up to the text with its consistency. A chunk's score is of its logical flow and rhythm."""
    each = structure_report(chunks.select(F.struct(key, order).alias("__k"), F.col(text)), "__k", text, **options)
    each = each.withColumn("overall", overall_structure({k: F.col(k) for k in ("logical_flow", "rhythm")})).select(F.col(f"__k.{key}").alias(key), "overall", "logical_flow", "rhythm", "connective_density")
    out = rollup(each, [key], {k: F.col(k) for k in ("overall", "logical_flow", "rhythm", "connective_density")})
    return out.withColumn("grade", t.ladder(F.col("avg_overall"), STRUCTURE_GRADES, "отличная"))


def coherence(df: DataFrame, key: str = "doc_id", text: str = "text", word: str = t.LETTERS, stop_words=()) -> DataFrame:
    """Overlap of the word sets of neighbour sentences, divided by the larger, averaged; texts of one sentence or none: 1. One
    row a text, made in its own row."""
    sets = F.transform(t.sentences(F.lower(text)), lambda x: F.array_except(F.array_distinct(F.regexp_extract_all(x, F.lit(word), F.lit(0))), t.word_list(list(stop_words))))
    pair = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).otherwise(0.0)

    def score(w):
        steps = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), pair)
        return F.when(F.size(w) < 2, 1.0).otherwise(t.total(steps) / (F.size(w) - 1))

    return df.select(key, F.coalesce(t.let(sets, score), F.lit(1.0)).alias("coherence"))


def top_terms(df: DataFrame, key: str = "doc_id", text: str = "text", word: str = r"\p{L}{2,}", stop_words=(), features: int = 100, top: int = 20) -> DataFrame:
    """TF-IDF of a one-text fit: words and pairs of neighbour words (after stop words are gone), the `features` most frequent of
    a text, each count divided by the root of the sum of squares; the `top` best with their rank. Ties by term."""
    return best_terms(df, key, None, text, word, stop_words, partial(frequent, features=features, top=top)).drop("terms")
