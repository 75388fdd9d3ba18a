"""All registered queries of the library, over the driver's tables, and the SQL that states their results.

The word classes, vowels and separators are those of the Latin-script test corpus; the Russian defaults are tested on
fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text as t
from folio.operators import chunking, description, narrative, readability, replies, reports, tiles, vectors
from folio.plans import records, sessions, sql, sql_texts
from folio.streaming import tasks

Query = Callable[[SparkSession, str], DataFrame]

#: English lists for the Latin corpus.
EN_STOPS = ["the", "of", "and", "a", "to", "in", "is", "was", "that", "it", "for", "on", "with", "he", "are", "this", "be", "from"]
EN_LINKS = ["for", "that", "with", "from"]
EN_WORDS = ["the", "of", "and", "that", "with", "from", "was", "are"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d):
    return read(spark, d, "documents")


SUFFIXES = ["tion", "ing", "ment"]
COUNTS = ["chars", "words", "sentences", "paragraphs", "syllables"]
RATES = ["words_per_sentence", "syllables_per_word", "chars_per_word", "lexical_diversity", "stop_words_ratio", "flesch", "flesch_kincaid", "smog", "ari", "coleman_liau"]


def _readability(spark, d, fields=None):
    return readability.readability(
        _docs(spark, d), stop_words=EN_STOPS, connectives=EN_LINKS, abstract=EN_LINKS, suffixes=SUFFIXES, enumeration="the|and", conditional="that.*,.*of", subordinate="that|from", fields=fields
    )


def _rounded(df, key, struct, texts=(), counts=()):
    """Fields of a struct column as columns, rounded where they are not counts or texts."""
    names = [f.name for f in df.schema[struct].dataType.fields] if struct else [c for c in df.columns if c not in key]
    at = lambda x: F.col(f"{struct}.{x}") if struct else F.col(x)
    return df.select(*key, *((at(x) if x in texts or x in counts else F.round(at(x), 6)).alias(x) for x in names))


def readability_by_lang(spark, d):
    r = F.col("readability")
    rows = _readability(spark, d, ["words", "sentences", "syllables", "words_per_sentence", "flesch", "ari"])
    return rows.groupBy("lang").agg(F.count("*").alias("documents"), F.sum(r["words"]).alias("words"), F.sum(r["sentences"]).alias("sentences"), F.sum(r["syllables"]).alias("syllables"), F.round(F.avg(r["words_per_sentence"]), 6).alias("avg_words_per_sentence"), F.round(F.avg(r["flesch"]), 6).alias("avg_flesch"), F.round(F.avg(r["ari"]), 6).alias("avg_ari"))


def readability_counts(spark, d):
    return _rounded(_readability(spark, d, COUNTS + RATES), ["doc_id"], "readability", counts=COUNTS)


def readability_full(spark, d):
    return _rounded(_readability(spark, d), ["doc_id"], "readability", ["grade"], COUNTS)


def _chunk_readability(spark, d):
    fields = ["overall", "flesch", "words_per_sentence", "lexical_diversity", "complex_words_ratio"]
    r = readability.readability(_chunks(spark, d), "content", stop_words=EN_STOPS, connectives=EN_LINKS, abstract=EN_LINKS, suffixes=SUFFIXES, fields=fields)
    return readability.rollup(r, ["doc_id"], {x: F.col(f"readability.{x}") for x in fields})


def readability_rollup(spark, d):
    return _rounded(_chunk_readability(spark, d), ["doc_id"], None, counts=["chunks"])


def complexity(spark, d):
    c = readability.complexity(_docs(spark, d), EN_WORDS, conjunctions=EN_LINKS)
    return _rounded(c, ["doc_id"], "complexity", ["level"], ["paragraphs"])


def style(spark, d):
    return readability.style(_docs(spark, d)).select("doc_id", *(f"style.{x}" for x in ("words", "unique_words", "sentences", "paragraphs")), *(F.round(f"style.{x}", 6).alias(x) for x in ("words_per_sentence", "word_length", "long_words_ratio", "type_token_ratio")))


def emotion(spark, d):
    lists = {"calm": ["the", "and"], "bright": ["tion", "ing"], "dark": ["wh", "th"]}
    e = readability.emotion(_docs(spark, d), emotions=lists, positive=["bright"], negative=["dark"])
    return e.select("doc_id", F.col("emotion.dominant"), F.col("emotion.scores")["bright"].alias("bright"), F.col("emotion.scores")["dark"].alias("dark"), "emotion.tone", F.round("emotion.tone_score", 6).alias("tone_score"))


def chunks_fixed(spark, d):
    c = chunking.chunk(_docs(spark, d), chunking.Strategy(1000, 250, 2000, 0.1))
    return c.select("doc_id", "chunk_index", "total_chunks", "start_pos", "end_pos", F.md5("content").alias("content_md5"))


def chunks_by_sentence(spark, d):
    c = chunking.chunk(_docs(spark, d), chunking.Strategy(1000, 250, 2000, 0.0, "sentence"))
    return c.select("doc_id", "chunk_index", "total_chunks", "start_pos", "end_pos", F.md5("content").alias("content_md5"))


def chunk_statistics(spark, d):
    return chunking.chunk_stats(chunking.chunk(_docs(spark, d), chunking.Strategy(1000, 250, 2000, 0.1))).withColumn("avg_length", F.round("avg_length", 6))


def _chunks(spark, d):
    return chunking.chunk(_docs(spark, d), chunking.Strategy(1000, 250, 2000, 0.0))


def _cut(spark, d, **values):
    c = chunking.chunk(_docs(spark, d), chunking.Strategy(**values))
    return c.select("doc_id", "chunk_index", "total_chunks", "start_pos", "end_pos", F.md5("content").alias("content_md5"))


def chunks_of_sentences(spark, d):
    return _cut(spark, d, unit="sentence", per_chunk=5, overlap=0.0)


def chunks_of_lines(spark, d):
    docs = _docs(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    c = chunking.chunk(docs, chunking.requested(600, 0, "paragraph"))
    return c.select("doc_id", "chunk_index", "total_chunks", "start_pos", "end_pos", F.md5("content").alias("content_md5"))


def chunks_by_paragraph(spark, d):
    docs = _docs(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    c = chunking.chunk(docs, chunking.Strategy(400, 100, 600, 0.0, "paragraph"))
    return c.select("doc_id", "chunk_index", "total_chunks", "start_pos", "end_pos", F.md5("content").alias("content_md5"))


def chunk_overlaps(spark, d):
    c = chunking.chunk(_docs(spark, d), chunking.Strategy(1000, 250, 2000, 0.15, two_sided=True))
    own = chunking.unique_content(F.col("content"), F.col("overlap_start"), F.col("overlap_end"))
    n = F.max("end_pos").over(Window.partitionBy("doc_id"))
    return c.select("doc_id", "chunk_index", "start_pos", "end_pos", "overlap_start", "overlap_end", F.md5(own).alias("own_md5"), F.round(chunking.position_ratio(F.col("start_pos"), n), 6).alias("position"))


def chunk_plans(spark, d):
    n = F.col("n")
    rows = _docs(spark, d).select("doc_id", F.length("text").alias("n"))
    sizes = {f"size_{k}": F.lit(v.base) for k, v in (("default", chunking.DEFAULT), ("small", chunking.SMALL), ("large", chunking.LARGE))}
    rows = rows.withColumns(sizes | {"adaptive": chunking.adaptive_size(n, 4096)})
    return rows.select("doc_id", "adaptive", *(chunking.estimated_chunks(n, F.col(f"size_{k}"), v.overlap).alias(f"chunks_{k}") for k, v in (("default", chunking.DEFAULT), ("small", chunking.SMALL), ("large", chunking.LARGE))))


def pace(spark, d):
    return _rounded(narrative.pace_report(narrative.pace_scores(_chunks(spark, d))), ["doc_id"], None, ["pace_class"])


def tension(spark, d):
    t = narrative.tension_report(_chunks(spark, d), peak=2.0)
    return t.select("doc_id", F.round("avg_tension", 6).alias("avg_tension"), "peak_count", F.array_join(F.transform("peaks", lambda x: x["chunk_index"].cast("string")), ",").alias("peaks"))


def relevant_chunks(spark, d):
    return narrative.relevant(_chunks(spark, d), "character", 0.1).select("doc_id", "chunk_index", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


def chunk_scores(spark, d):
    c = F.col("text")
    return _docs(spark, d).select("doc_id", F.round(narrative.tension_score(c, EN_WORDS), 6).alias("tension"), F.round(narrative.event_density(c, EN_WORDS, ["ing"], ["ed"]), 6).alias("event_density"), F.round(narrative.dialogue_ratio(c), 6).alias("dialogue_ratio"))


REPEATS = {"en": ["the", "and"]}


def water(spark, d):
    return _rounded(narrative.water_report(_chunks(spark, d), patterns={"en": ["of the", "in the", "that"]}, repeats=REPEATS), ["doc_id"], None, ["rating"])


def repetitions(spark, d):
    return narrative.repetitions(_chunks(spark, d), patterns=REPEATS).withColumn("similarity", F.round("similarity", 6))


def frequent_words(spark, d):
    return narrative.frequent_words(_chunks(spark, d))


#: Lists for speech in the Latin corpus, which has no dashes: commas stand for them.
SPEECH = {
    "emotions": {"a": ["the"], "b": ["and", "of"], "c": ["zz"]}, "features": {"formal": ["that"], "informal": ["is", "in"]}, "verbs": ["was", "said", "from"],
    "colloquial": ["the", "der"], "interjections": ["of"], "natural": ["and", "in"],
}


def _dashed(df, text):
    return df.withColumn(text, F.replace(text, F.lit(", "), F.lit(" — ")))


def dialogue(spark, d):
    r = narrative.dialogue_report(_dashed(_docs(spark, d), "text"), **SPEECH)
    return _rounded(r, ["doc_id"], None, ["grade"], ["dialogue_count", "speech_words", "speech_chars", "longest_run"])


def dialogue_rollup(spark, d):
    r = narrative.dialogue_rollup(_dashed(_chunks(spark, d), "content"), **SPEECH)
    return _rounded(r, ["doc_id"], None, ["grade"], ["chunks", "total", "chunks_with_any"])


STRUCTURE = {
    "links": {"a": ["and", "the"], "b": ["for", "from"]}, "parts": {"first": ["the"], "then": ["and"], "most": ["that"], "last": ["was", "is"]},
    "markers": ["for", "that"], "facts": [r"[0-9]{4}", "[0-9]+%"], "patterns": {"x": [r"\?"], "y": ["!", "the"], "z": ["qqq"]},
}


def structure(spark, d):
    r = narrative.structure_report(_docs(spark, d), **STRUCTURE)
    return _rounded(r, ["doc_id"], None, ["composition_type", "grade"], ["paragraphs", "sentences"])


def structure_rollup(spark, d):
    """The grade is that of the rounded average, as the SQL has it: a mean of 0.8 may come as 0.7999999999999999."""
    r = _rounded(narrative.structure_rollup(_chunks(spark, d), **STRUCTURE), ["doc_id"], None, ["grade"], ["chunks"])
    return r.withColumn("grade", t.ladder(F.col("avg_overall"), narrative.STRUCTURE_GRADES, "отличная"))


def coherence(spark, d):
    return narrative.coherence(_docs(spark, d)).withColumn("coherence", F.round("coherence", 6))


def tfidf_terms(spark, d):
    return narrative.top_terms(_docs(spark, d), stop_words=EN_STOPS).withColumn("score", F.round("score", 6))


DESCRIPTION = ({"a": ["the", "of"], "b": ["and", "was"]}, {"c": ["that"], "d": ["with", "from"]})
DESCRIBED = {"devices": {"x": ["and", "of"], "y": ["qq"]}, "times": {"m": ["the"], "n": ["zz"]}}


def description_measures(spark, d):
    return _rounded(description.description_report(_docs(spark, d), *DESCRIPTION, **DESCRIBED), ["doc_id"], None, ["grade"], ["passages", "dense_areas"])


def description_rollup(spark, d):
    return _rounded(description.description_rollup(_chunks(spark, d), *DESCRIPTION), ["doc_id"], None, ["grade"], ["chunks", "total", "chunks_with_any"])


def chunk_coherence(spark, d):
    r = description.unit_coherence(_chunks(spark, d), links=STRUCTURE["links"])
    return r.select("doc_id", F.round("transitions", 6).alias("transitions"), F.round("thematic", 6).alias("thematic"))


def fact_density(spark, d):
    c = F.col("text")
    return _docs(spark, d).select("doc_id", F.round(description.information_density(c, EN_LINKS), 6).alias("information_density"), description.pattern_counts(c, {"x": [r"\?", "!"]})["x"].alias("marks"))


def chunk_term_sums(spark, d):
    return description.chunk_terms(_chunks(spark, d), stop_words=EN_STOPS).withColumn("score", F.round("score", 6))


def speech_voices(spark, d):
    parts = narrative.speech(_dashed(_docs(spark, d), "text"), verbs=SPEECH["verbs"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("paragraph_index", "parts"))).alias("p"))
    found = parts.select("doc_id", description.voices(F.flatten(F.transform("p", lambda x: x["parts"])), SPEECH["features"], pronouns="the|of").alias("voices"))
    return _docs(spark, d).select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("voices", F.lit(0)).alias("voices"))


def complexity_rollup(spark, d):
    c = readability.complexity(_chunks(spark, d), EN_WORDS, text="content", conjunctions=EN_LINKS)
    r = readability.rollup(c, ["doc_id"], {x: F.col(f"complexity.{x}") for x in ("overall", "flesch", "lexical_diversity")})
    return _rounded(r, ["doc_id"], None, counts=["chunks"])


def _vectors(spark, d):
    return read(spark, d, "embeddings")


def knn(spark, d):
    v = _vectors(spark, d)
    return vectors.knn(v.where("vec_id % 20 = 0"), v, 10).withColumn("score", F.round("score", 5)).select("query_id", "vec_id", "score", "rank")


def ivf_recall(spark, d):
    """Share of the 10 exact neighbours that the index finds, at the recommended probes and at a third of the cells. The test
    vectors lie nearly without clusters, so each is kept in its two nearest cells."""
    v = _vectors(spark, d)
    q = v.where("vec_id % 20 = 0")
    n = vectors.recommended(v.count())
    indexed, centres = vectors.ivf(v, n["cells"], copies=2)
    out = vectors.knn(q, v, 10).select("query_id", "vec_id", F.lit(1).alias("hit"))
    for name, probes in (("wide", n["cells"] // 3), ("few", n["probes"])):
        found = vectors.ivf_search(q, indexed, centres, max(1, probes)).select("query_id", "vec_id", F.lit(1).alias(name))
        out = out.join(found, ["query_id", "vec_id"], "left")
    return out.groupBy("query_id").agg((F.count("wide") / F.count("hit")).alias("recall"), (F.count("few") / F.count("hit")).alias("recall_recommended"))


def similar_pairs(spark, d):
    return tiles.pairs_over(_vectors(spark, d), 0.25, "cosine", by=["label"]).select("label", "text1", "text2", F.round("score", 5).alias("score"))


def top_pairs(spark, d):
    return tiles.top_pairs(_vectors(spark, d), 20, "unit", by=["label"]).select("text1", "text2", F.round("score", 5).alias("score"))


def label_averages(spark, d):
    return vectors.group_averages(_vectors(spark, d), "label").select("text", F.round("average", 5).alias("average"))


def mean_vectors(spark, d):
    v = vectors.mean_vector(_vectors(spark, d), "label")
    return v.select("label", F.posexplode("embedding").alias("place", "x")).select("label", "place", F.round("x", 5).alias("x"))


def vector_water(spark, d):
    r = vectors.density(_vectors(spark, d), "label", "vec_id")
    low = F.array_sort(F.collect_list(F.when(F.col("low"), F.col("vec_id"))))  # the listed ids are the result
    sums = r.groupBy("label").agg((100 * (1 - F.avg("density"))).alias("water"), F.coalesce(F.avg("redundancy"), F.lit(0.0)).alias("redundancy"), low.alias("low"))
    return sums.select("label", F.round("water", 5).alias("water"), F.round("redundancy", 5).alias("redundancy"), F.array_join(F.transform("low", lambda x: x.cast("string")), ",").alias("verbose"))


def chat_prompts(spark, d):
    return replies.transcripts(read(spark, d, "conversations")).withColumn("tokens", replies.token_estimate(F.col("prompt")))


def genre_replies(spark, d):
    return read(spark, d, "events").select("event_id", replies.genre(F.concat(F.lit('{"main_genre": "'), F.col("event_type"), F.lit('", "confidence": '), F.round("value", 2).cast("string"), F.lit("}"))).alias("g")).select("event_id", "g.main_genre", "g.confidence")


def newest_page(spark, d):
    return reports.page(reports.where_equal(read(spark, d, "orders"), o_orderstatus="O"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 20, 50).select("o_orderkey", "o_orderstatus")


def title_search(spark, d):
    p = read(spark, d, "part")
    return p.where(reports.title_contains(F.col("p_name"), "A")).select("p_partkey", "p_name")


def size_classes(spark, d):
    return _docs(spark, d).groupBy(reports.size_class(F.col("n_chars")).alias("size_class")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def success_by_user(spark, d):
    e = F.col("event_type")
    return read(spark, d, "events").groupBy("user_id").agg(F.round(reports.success_rate(e == "purchase", e.isin("purchase", "error")), 6).alias("success_rate"), F.count("*").alias("n"))


def usage_counts(spark, d):
    return reports.counts_by(read(spark, d, "events"), "event_type", 5)


def recent_values(spark, d):
    return reports.recent_times(read(spark, d, "events").withColumn("value", F.round("value", 6)), "value", "ts").select(F.round("avg", 5).alias("avg"), "min", "max", F.round("median", 5).alias("median"), "n")


def value_trends(spark, d):
    return reports.trend(read(spark, d, "events"), ["event_type"], "ts", "value").select("event_type", F.round("early", 5).alias("early"), F.round("late", 5).alias("late"), "trend")


def latency_average(spark, d):
    return reports.moving_average(read(spark, d, "events"), ["user_id"], "ts", "value").select("user_id", F.round("ema", 5).alias("ema"), "n")


def order_progress(spark, d):
    return reports.progress(read(spark, d, "lineitem"), "l_orderkey", F.col("l_linestatus") == "F")


def orders_with_lines(spark, d):
    out = reports.nest(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", {"lines": (read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["l_linenumber", "l_partkey"])})
    return out.select("o_orderkey", "o_orderstatus", F.size("lines").cast("long").alias("n_lines"), F.array_join(F.transform("lines", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


def missing_customers(spark, d):
    known, missing = reports.split_known(read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")
    return known.withColumn("known", F.lit(True)).union(missing.withColumn("known", F.lit(False)))


def duplicate_texts(spark, d):
    return reports.duplicates(_docs(spark, d).withColumn("md5", F.md5("text")), ["md5"])


def latest_events(spark, d):
    return reports.latest(read(spark, d, "events").withColumn("at", F.struct("ts", "event_id")), ["user_id"], "at", 3).select("user_id", "event_id")


def best_suppliers(spark, d):
    return reports.best(read(spark, d, "supplier"), "s_nationkey", "s_suppkey", "s_acctbal")


def event_counters(spark, d):
    return tasks.counters(read(spark, d, "events"), "ts", "event_type", "1 day", ok="purchase", bad="error").select("start", "n", "ok", "bad", F.round("success_rate", 6).alias("success_rate"))


def metric_snapshots(spark, d):
    return tasks.snapshots(read(spark, d, "events"), "ts", "event_type", "value", "6 hours").select("start", "event_type", F.round("avg", 5).alias("avg"), F.round("min", 5).alias("min"), F.round("max", 5).alias("max"), "n")


def user_life_cycles(spark, d):
    e = read(spark, d, "events").withColumn("status", F.when(F.col("event_type") == "purchase", "completed").otherwise("running"))
    return tasks.life_cycle(e, "user_id", "status", "ts").select("user_id", F.round("seconds", 3).alias("seconds"))


def metric_alerts(spark, d):
    m = read(spark, d, "events").select("event_id", F.col("value").alias("memory_percent"), F.col("value").alias("temperature"), F.col("value").alias("hit_rate"), F.col("value").alias("success_rate"))
    return tasks.alerts(m).select("event_id", "alert", "severity")


def queries() -> dict[str, Query]:
    names = """readability_by_lang readability_counts readability_full complexity complexity_rollup style emotion chunks_fixed chunks_by_sentence chunks_of_sentences chunks_of_lines chunks_by_paragraph chunk_overlaps chunk_plans chunk_statistics pace
    tension relevant_chunks readability_rollup dialogue_rollup frequent_words chunk_scores water repetitions dialogue structure structure_rollup coherence tfidf_terms knn ivf_recall similar_pairs top_pairs label_averages mean_vectors vector_water
    chat_prompts genre_replies newest_page title_search size_classes success_by_user usage_counts recent_values value_trends latency_average order_progress orders_with_lines
    missing_customers duplicate_texts latest_events best_suppliers description_measures description_rollup chunk_coherence fact_density chunk_term_sums speech_voices event_counters metric_snapshots user_life_cycles metric_alerts"""
    return {n: globals()[n] for n in names.split()} | records.QUERIES | sessions.QUERIES


def oracle_sql() -> dict[str, str]:
    return sql.SQL | sql_texts.SQL | records.SQL | sessions.SQL
