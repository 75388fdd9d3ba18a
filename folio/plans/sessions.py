"""Queries over sessions, their results, prompts and files. Each stands beside the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import text as t
from folio.operators import chunking, narrative, ranges, replies, reports, vectors
from folio.plans import sql_texts
from folio.plans.records import _EDGES, _sessions, read
from folio.plans.sql_texts import chunks
from folio.sources import books, embeddings, exports
from folio.sources.shared import folder

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return add


@query(
    "SELECT n_nationkey, len(e) = 0 AS valid, array_to_string(e, ',') AS errors FROM (SELECT n_nationkey, list_filter([CASE WHEN s = 0 THEN 'texts' END, CASE WHEN c < 10 THEN 'analyzers' END, CASE WHEN s > 1 AND n_regionkey >= 3 THEN 'comparator' END, "
    "CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 THEN 'chunking' END], lambda x: x IS NOT NULL) AS e FROM (SELECT n_nationkey, n_regionkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c FROM nation))"
)
def session_modes(spark, d):
    """Validity of sessions, the chunking id of chunked ones included."""
    count = lambda n, k: read(spark, d, n).groupBy(F.col(k).alias("n_nationkey")).agg(F.count("*").alias(n))
    rows = read(spark, d, "nation").join(count("supplier", "s_nationkey"), "n_nationkey", "left").join(count("customer", "c_nationkey"), "n_nationkey", "left")
    number, key = lambda c: F.coalesce(c, F.lit(0)), F.col("n_nationkey")
    mode, strategy = F.when(key % 3 == 0, "chunked").otherwise("full"), F.when(key % 2 == 1, key)
    c = reports.session_checks(number("supplier"), F.floor(number("customer") / 10), F.when(F.col("n_regionkey") < 3, "cosine"), mode, strategy)
    return rows.select("n_nationkey", c.alias("c")).select("n_nationkey", "c.valid", F.array_join("c.errors", ",").alias("errors"))


_MARKS = "(length(text) - length(replace(replace(replace(text, '—', ''), '\"', ''), '«', '')))"
_ENDS = "(length(text) - length(replace(replace(replace(text, '.', ''), '!', ''), '?', '')))"
_BLANK_LINES = "((length(text) - length(replace(text, chr(10) || chr(10), ''))) / 2 + 1)"
_PIECES = "greatest(floor(length(text) / 2000), 1)"


@query(
    f"""WITH e AS (SELECT doc_id, 0.8 + {_MARKS} / 100 AS dialogue, {_MARKS} AS marks, 1.5 + ({_BLANK_LINES} / 20 + {_ENDS} / 100) AS structure, 1.2 + {_ENDS} / 200 AS description, 0.5 + length(text) / 10000 AS readability, 1.0 + length(text) / 5000 AS complexity, {_PIECES} AS pieces FROM documents)
SELECT doc_id, analyzer, round(whole, 6) AS whole, round(chunked, 6) AS chunked, round(with_model, 6) AS with_model FROM (
SELECT doc_id, 'dialogue' AS analyzer, dialogue AS whole, dialogue * pieces * 0.3 AS chunked, dialogue + CASE WHEN marks > 0 THEN 2 ELSE 0 END AS with_model FROM e
UNION ALL SELECT doc_id, 'structure', structure, structure * pieces * 0.5, structure + 2.5 FROM e UNION ALL SELECT doc_id, 'description', description, description * pieces * 0.4, description + 1.8 FROM e
UNION ALL SELECT doc_id, 'readability', readability, readability * pieces * 0.2, readability + 1.5 FROM e UNION ALL SELECT doc_id, 'complexity', complexity, complexity * pieces * 0.3, complexity + 2 FROM e)"""
)
def work_estimates(spark, d):
    """Seconds that each analyzer is to take for each text: whole, by chunks, and with a model."""
    c = F.col("text")
    each = F.array(*(F.struct(F.lit(a).alias("analyzer"), *(F.round(reports.analyzer_estimate(c, a, **o), 6).alias(n) for n, o in (("whole", {}), ("chunked", {"chunked": True}), ("with_model", {"model": True})))) for a in reports.ESTIMATES))
    return read(spark, d, "documents").select("doc_id", F.explode(each).alias("e")).select("doc_id", "e.*")


@query("SELECT event_type, (event_type = 'error') AS has_error, count(*) AS n, sum(CAST(value < 50 AS INT)) AS small FROM events GROUP BY ALL")
def result_errors(spark, d):
    """Results with and without an error."""
    e = read(spark, d, "events").withColumn("error", F.when(F.col("event_type") == "error", F.concat(F.lit("failed at "), "value")))
    return e.groupBy("event_type", reports.has_error(F.col("error")).alias("has_error")).agg(F.count("*").alias("n"), F.count_if(F.col("value") < 50).alias("small"))


@query("SELECT user_id AS text_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE event_type = 'view'")
def session_results(spark, d):
    """Results of one session by text, in the order of time."""
    e = read(spark, d, "events").select(F.col("event_type").alias("session_id"), F.col("user_id").alias("text_id"), F.struct("ts", "event_id").alias("created_at"), "event_id")
    return reports.results_of(e, "view").select("text_id", "event_id", "place")


@query(
    "SELECT count(*) AS total_models, count(*) FILTER (p_size < 20) AS llm_models, count(*) FILTER (p_size >= 20) AS embedding_models, count(*) FILTER (p_partkey % 3 = 0) AS busy_models, count(*) FILTER (p_partkey % 3 <> 0) AS available_models, "
    "round(sum(p_retailprice), 2) AS total_memory, round(100 * sum(p_retailprice) / 1000000, 4) AS memory_percent FROM part"
)
def model_counts(spark, d):
    """Parts as models: counts by kind and use, and their memory."""
    m = reports.model_summary(read(spark, d, "part"), F.when(F.col("p_size") < 20, "llm").otherwise("embedding"), F.col("p_partkey") % 3 == 0, F.col("p_retailprice"), 1e6)
    return m.withColumns({"total_memory": F.round("total_memory", 2), "memory_percent": F.round("memory_percent", 4)})


@query(
    "SELECT query_id, vec_id, CAST(rank AS INT) AS rank, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, b.label, "
    "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 3"
)
def neighbours_with_labels(spark, d):
    """Nearest vectors with what is known of each."""
    v = read(spark, d, "embeddings")
    found = vectors.knn(v.where("vec_id % 20 = 0"), v, 3)
    return reports.with_metadata(found, v.select("vec_id", "label")).select("query_id", "vec_id", "rank", "label")


_THEMES = ["love", "power", "freedom", "choice"]


@query(
    f"SELECT doc_id, chunk_index, md5(left(content, 1200) || chr(10) || 'love, power, freedom, choice') AS theme_md5, md5(coalesce(left(lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_index), 500), '') || '|' || left(content, 1500) || '|love, power, freedom, choice') AS character_md5 "
    f"FROM ({chunks()}) WHERE chunk_index < 3"
)
def first_chunk_prompts(spark, d):
    """Prompts of the first chunks of each text, with a list of themes; the character form with the chunk before."""
    c = narrative.first_chunks(chunking.chunk(read(spark, d, "documents"), chunking.Strategy(1000, 250, 2000, 0.0)), narrative.MOST_CHUNKS["style"])
    p = replies.analyzer_prompts(c, "theme", "{text}\n{themes}", {"themes": _THEMES}).withColumnRenamed("prompt", "theme")
    p = replies.analyzer_prompts(p, "character", "{context}|{text}|{traits}", {"traits": _THEMES})
    return p.select("doc_id", "chunk_index", F.md5("theme").alias("theme_md5"), F.md5("prompt").alias("character_md5"))


@query(sql_texts.SQL["chunks_of_lines"])
def chunks_by_flags(spark, d):
    """Chunks by flags: paragraphs go before sentences."""
    docs = read(spark, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    c = chunking.chunk(docs, chunking.by_flags(True, True, 3))
    return c.select("doc_id", "chunk_index", "total_chunks", "start_pos", "end_pos", F.md5("content").alias("content_md5"))


@query(
    "SELECT n_nationkey AS session_id, coalesce(t, 0) AS texts, coalesce(r, 0) AS results, coalesce(a, '') AS analyzers, coalesce(p, 0) AS pairs, round(coalesce(s, 0), 4) AS total FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS t FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey "
    "LEFT JOIN (SELECT c_nationkey, count(*) AS r, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS a FROM customer GROUP BY 1) ON c_nationkey = n_nationkey "
    f"LEFT JOIN (SELECT session_id, count(*) AS p, sum(score) AS s FROM ({_EDGES}) GROUP BY 1) ON session_id = n_nationkey"
)
def session_records(spark, d):
    """JSON records of sessions with analyzers, and of the pairs of their matrix, read back."""
    sessions, texts, found, edges = _sessions(spark, d)
    used = found.select("session_id", F.col("analyzer_name").alias("name")).distinct()
    j = books.session_json(sessions.select("session_id", "name"), texts, found, used)
    kind = "struct<data:struct<texts:array<struct<text_id:bigint>>,results:array<struct<text_id:bigint>>,analyzers:array<string>>>"
    x = F.from_json("json", kind)["data"]
    n = lambda c: F.coalesce(F.size(x[c]), F.lit(0)).alias(c)
    pairs = books.matrix_json(edges).select("session_id", F.from_json("json", "text1 bigint, text2 bigint, score double")["score"].alias("score"))
    sums = pairs.groupBy("session_id").agg(F.count("*").cast("int").alias("pairs"), F.sum("score").alias("sum"))
    rows = j.select("session_id", n("texts"), n("results"), F.coalesce(F.array_join(x["analyzers"], ","), F.lit("")).alias("analyzers"))
    return rows.join(sums, "session_id", "left").withColumns({"pairs": F.coalesce("pairs", F.lit(0)), "total": F.round(F.coalesce("sum", F.lit(0.0)), 4)}).drop("sum")


@query(
    """WITH l AS (SELECT n_nationkey AS s, 0 AS p, 0 AS o, 'Session ID,' || n_nationkey || ',Name,' || n_name || ',Status,completed,Mode,full' AS line FROM nation UNION ALL SELECT n_nationkey, 1, 0, '' FROM nation UNION ALL SELECT n_nationkey, 2, 0, 'Text ID,Title,Length' FROM nation
UNION ALL SELECT s_nationkey, 3, s_suppkey, s_suppkey || ',' || s_name || ',' || length(s_name) FROM supplier UNION ALL SELECT DISTINCT c_nationkey, 4, 0, '' FROM customer UNION ALL SELECT DISTINCT c_nationkey, 5, 0, 'Text ID,Analyzer,Summary' FROM customer
UNION ALL SELECT c_nationkey, 6, c_custkey, c_custkey || ',' || c_mktsegment || ',' || CASE WHEN length(repeat(c_name, 8)) > 100 THEN left(repeat(c_name, 8), 100) || '...' ELSE repeat(c_name, 8) END FROM customer)
SELECT s AS session_id, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY p, o)) AS file_md5 FROM l GROUP BY 1"""
)
def session_files(spark, d):
    """CSV files of sessions with a summary of each result: their lines."""
    sessions, texts, found, _ = _sessions(spark, d)
    lines = exports.session_csv(sessions, texts, found)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")  # one file's
    return lines.groupBy("session_id").agg(F.count("*").alias("lines"), F.md5(whole).alias("file_md5"))


@query(
    """WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) AS r(i) WHERE label IS NOT NULL GROUP BY 1, 2), v AS (SELECT label, list(x ORDER BY i) AS e FROM m GROUP BY 1),
s AS (SELECT a.label AS text1, b.label AS text2, least(greatest((list_dot_product(a.e, b.e) / ((sqrt(list_dot_product(a.e, a.e)) + 1e-10) * (sqrt(list_dot_product(b.e, b.e)) + 1e-10)) + 1) / 2, 0), 1) AS s FROM v a, v b),
p AS (SELECT *, row_number() OVER (ORDER BY s DESC, text1, text2) AS r FROM s WHERE text1 < text2)
SELECT 0 AS part, 0 AS place, 'Comparison Matrix' AS line UNION ALL SELECT 1, 0, ',' || string_agg(label, ',' ORDER BY label) FROM v UNION ALL SELECT 2, text1, text1 || ',' || string_agg(printf('%.4f', s), ',' ORDER BY text2) FROM s GROUP BY text1
UNION ALL SELECT 3, 0, 'Average Similarity,' || printf('%.4f', coalesce(avg(s), 0)) FROM p UNION ALL SELECT 4, r - 1, text1 || ',' || text2 || ',' || printf('%.4f', s) FROM p WHERE r <= 5"""
)
def matrix_file(spark, d):
    """The similarity matrix of labels, by their mean vectors, as the lines of a file."""
    means = vectors.mean_vector(read(spark, d, "embeddings").where("label is not null"), "label").select(F.col("label").cast("long").alias("vec_id"), "embedding")
    return exports.matrix_lines(means).select("place.part", F.col("place.order").alias("place"), "line")


@query(
    """WITH e AS (SELECT label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL), v AS (SELECT label, list_sum(e) / len(e) AS x, row_number() OVER (PARTITION BY label ORDER BY list_sum(e) / len(e)) AS r, count(*) OVER (PARTITION BY label) AS n FROM e)
SELECT label, round(avg(x), 6) AS median FROM v WHERE r BETWEEN floor((n + 1) / 2) AND ceil((n + 1) / 2) GROUP BY label"""
)
def label_medians(spark, d):
    """Exact medians of groups of any size, by ranges."""
    v = read(spark, d, "embeddings").where("label is not null").select("label", (t.total(F.transform("embedding", lambda x: x.cast("double"))) / F.size("embedding")).alias("x"))
    return ranges.medians(v, "label", "x").select("label", F.round("median", 6).alias("median"))


@query("SELECT count(*) * 2 AS vectors, count(*) * 2 AS ids, max(vec_id) + 1 AS first_new, max(vec_id) + count(*) AS last, round(sum(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1), 2) AS lengths FROM embeddings WHERE embedding IS NOT NULL")
def added_vectors(spark, d):
    """All vectors added once more, normalised, under new ids."""
    v = read(spark, d, "embeddings").where("embedding is not null")
    last = v.agg(F.max("vec_id").alias("last_old"))
    both = vectors.add(v.select("vec_id", "embedding"), v.select("embedding")).crossJoin(last)  # one row
    new = F.when(F.col("vec_id") > F.col("last_old"), F.col("vec_id"))
    return both.agg(F.count("*").alias("vectors"), F.count_distinct("vec_id").alias("ids"), F.min(new).alias("first_new"), F.max("vec_id").alias("last"), F.round(F.sum(vectors.norm(F.col("embedding"))), 2).alias("lengths"))


def _features(texts: list[str]) -> list[list[float]]:
    return [[len(x), x.count(" "), x.count("e")] for x in texts]


@query("SELECT CAST(doc_id AS VARCHAR) AS text_id, CAST(length(text) AS DOUBLE) AS length, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS blanks, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS es FROM documents WHERE text IS NOT NULL")
def embedded_texts(spark, d):
    """All texts through the embedding job, and what its store then holds."""
    path = folder(spark, "embeddings")
    embeddings.embed_missing(read(spark, d, "documents").select(F.col("doc_id").alias("text_id"), F.col("text").alias("content")), path, "features", lambda: _features)
    e = embeddings.read(spark, path)
    return e.select("text_id", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("length", "blanks", "es"))))
