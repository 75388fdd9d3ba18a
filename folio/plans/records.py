"""Queries over records: sessions, mentions, tasks, vectors, books. Each stands beside the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import text as t
from folio.functions.spans import register, with_spans
from folio.operators import analyzers, chunking, description, index, narrative, replies, reports, tiles, vectors
from folio.plans.sql_texts import BLANK, chunks, strip, tokens
from folio.sources import books
from folio.streaming import tasks

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- texts as records


@query(
    f"SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE len(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))) END AS INT) AS lines, CAST(len({tokens('text')}) AS INT) AS words, CAST(floor(length(text) / 3) AS BIGINT) AS tokens, "
    "md5(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END) AS summary_md5, round(0.5 + 0.1 * length(text) / 1000, 6) AS estimate FROM documents"
)
def text_facts(spark, d):
    c = F.col("text")
    return read(spark, d, "documents").select(
        "doc_id", reports.line_count(c).alias("lines"), t.token_count(c).alias("words"), replies.token_estimate(c).alias("tokens"), F.md5(t.summary(c)).alias("summary_md5"), F.round(reports.work_estimate(F.length(c), 0.5, 0.1), 6).alias("estimate")
    )


@query(
    "SELECT c_custkey, len(e) = 0 AS valid, array_to_string(e, ',') AS errors FROM (SELECT c_custkey, list_filter([CASE WHEN NOT length(trim(c_name)) > 0 THEN 'name' END, CASE WHEN NOT c_acctbal >= 0 THEN 'balance' END, "
    "CASE WHEN NOT regexp_matches(c_name, '^[a-zA-Z0-9_-]+$') THEN 'id' END, CASE WHEN NOT regexp_matches(c_mktsegment || '@example.org', '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') THEN 'email' END, "
    "CASE WHEN lower(c_mktsegment) NOT IN ('building', 'machinery') THEN 'extension' END], lambda x: x IS NOT NULL) AS e FROM customer)"
)
def customer_checks(spark, d):
    rules = {
        "name": F.length(F.trim("c_name")) > 0, "balance": F.col("c_acctbal") >= 0, "id": reports.is_id(F.col("c_name")), "email": reports.is_email(F.concat("c_mktsegment", F.lit("@example.org"))),
        "extension": reports.has_extension(F.concat(F.lit("file."), "c_mktsegment"), [".building", "MACHINERY"]),
    }
    return read(spark, d, "customer").select("c_custkey", reports.checks(rules).alias("c")).select("c_custkey", "c.valid", F.array_join("c.errors", ",").alias("errors"))


@query(
    "SELECT o_orderkey, CASE WHEN s IN ('draft', 'failed') THEN 'queued' ELSE s END AS after_run, CASE WHEN s IN ('queued', 'running') THEN 'cancelled' ELSE s END AS after_cancel, CASE WHEN o_totalprice > 200000 AND o_orderpriority = '1-URGENT' THEN 'a,b' WHEN o_totalprice > 200000 THEN 'a' WHEN o_orderpriority = '1-URGENT' THEN 'b' ELSE 'none' END AS advice "
    "FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'failed' ELSE 'draft' END AS s FROM orders)"
)
def status_changes(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "failed").otherwise("draft")
    advice = reports.recommendations([(F.col("o_totalprice") > 200000, "a"), (F.col("o_orderpriority") == "1-URGENT", "b")], "none")
    return read(spark, d, "orders").select("o_orderkey", reports.next_status(s, "queued").alias("after_run"), reports.next_status(s, "cancelled").alias("after_cancel"), F.array_join(advice, ",").alias("advice"))


@query(
    "SELECT p_partkey, CASE WHEN a = '' THEN 'Unknown' ELSE a END AS author, p_brand || ' #' || p_size AS series, CAST(CASE WHEN contains(lower(p_type), '3b') THEN 6000 WHEN contains(lower(p_type), '7b') THEN 14000 WHEN contains(lower(p_type), '13b') THEN 26000 ELSE 2000 END * CASE WHEN p_size > 25 THEN 0.25 ELSE 0.5 END AS DOUBLE) AS memory "
    "FROM (SELECT *, array_to_string(list_filter([CASE WHEN p_size > 10 THEN trim(p_brand) END, CASE WHEN p_size > 20 THEN trim(p_type) END], lambda x: x <> ''), ' ') AS a FROM part)"
)
def book_columns(spark, d):
    size = F.col("p_size")
    author = reports.author_name(F.when(size > 10, F.col("p_brand")), F.lit(" "), F.when(size > 20, F.col("p_type")))
    memory = reports.memory_estimate_mb(F.col("p_type"), F.when(size > 25, "4bit").otherwise("8bit"))
    return read(spark, d, "part").select("p_partkey", author.alias("author"), reports.series_title(F.col("p_brand"), size).alias("series"), memory.alias("memory"))


@query("SELECT l_orderkey, l_linenumber, round(epoch_us(l_shipdate) / 1000000.0 - epoch_us(o_orderdate) / 1000000.0, 3) AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def execution_times(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", F.round(reports.seconds_between(F.col("o_orderdate"), F.col("l_shipdate")), 3).alias("seconds"))


@query(
    "SELECT event_id, CASE WHEN n >= 1000000 THEN printf('%.1f', round(n / 1000000, 1)) || ' млн' WHEN n >= 1000 THEN printf('%.1f', round(n / 1000, 1)) || ' тыс' ELSE CAST(n AS VARCHAR) END AS shown, "
    "CASE WHEN s < 60 THEN 'только что' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || ' мин назад' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || ' ч назад' WHEN s < 604800 THEN CAST(floor(s / 86400) AS BIGINT) || ' д назад' ELSE strftime(ts, '%d.%m.%Y') END AS since, "
    "concat_ws(' ', CASE WHEN n >= 3600 THEN n // 3600 || 'h' END, CASE WHEN n >= 60 THEN n % 3600 // 60 || 'm' END, n % 60 || 's') AS lasted "
    "FROM (SELECT event_id, ts, CAST(floor(value * value * 10) AS BIGINT) AS n, epoch_us(TIMESTAMP '2024-01-31 00:00:00') / 1000000.0 - epoch_us(ts) / 1000000.0 AS s FROM events)"
)
def shown_texts(spark, d):
    n = F.floor(F.col("value") * F.col("value") * 10).cast("long")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return read(spark, d, "events").select("event_id", t.abbreviated(n).alias("shown"), t.ago(F.col("ts"), now).alias("since"), t.duration(n).alias("lasted"))


# ---- joins, changes, pages


@query("SELECT o_custkey, analyzer, count(*) AS n FROM orders, (SELECT unnest(['genre', 'style', 'water']) AS analyzer) GROUP BY ALL")
def work_items(spark, d):
    return reports.work_list(read(spark, d, "orders"), ["genre", "style", "water"]).groupBy("o_custkey", "analyzer").agg(F.count("*").alias("n"))


@query("SELECT source, round(sum(3 * 0.5 * n_chars / 1000) + 0.01 * count(*) * (count(*) - 1) / 2, 4) AS seconds FROM documents GROUP BY source")
def session_estimates(spark, d):
    return reports.session_estimate(read(spark, d, "documents"), "source", "n_chars", 3, 0.5, 0.01).select("source", F.round("seconds", 4).alias("seconds"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def order_lookup(spark, d):
    keys = reports.where_equal(read(spark, d, "customer"), c_mktsegment="BUILDING", c_nationkey=None).select(F.col("c_custkey").alias("o_custkey"))
    return reports.lookup(read(spark, d, "orders"), keys).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, total FROM (SELECT o_orderkey, o_orderdate, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F') ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 30")
def order_pages(spark, d):
    rows = reports.where_equal(read(spark, d, "orders"), o_orderstatus="F")
    return reports.page_with_total(rows, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 30, 100).select("o_orderkey", "total")


@query("SELECT l_orderkey, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def cascade_delete(spark, d):
    gone = read(spark, d, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_orderkey", "l_orderkey")
    kept = reports.cascade(gone, "l_orderkey", {"lines": read(spark, d, "lineitem")})["lines"]
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'renamed' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier WHERE s_suppkey % 2 = 0"
)
def changed_suppliers(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    out = reports.upsert(s, s.where("s_nationkey < 5").select("s_suppkey", F.lit("renamed").alias("s_name"), F.lit(1).alias("unknown")), "s_suppkey").select("s_suppkey", "s_name")
    out = vectors.remove(out, s.where("s_suppkey % 7 = 0"), "s_suppkey")
    more = s.select((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 2 == 0, 1000000).otherwise(0)).alias("s_suppkey"), "s_name")
    known = reports.append_new(out, more.where("s_suppkey % 7 <> 0 or s_suppkey >= 1000000"), ["s_suppkey"])
    return known


@query("SELECT p_partkey, p_brand, rn = 1 AND p_size > 20 AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 20 DESC, p_partkey DESC) AS rn FROM part)")
def default_parts(spark, d):
    rows = read(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") > 20).alias("chosen"))
    return reports.one_default(rows, "p_brand", "chosen", "p_partkey")


@query("SELECT o_custkey AS text_id, o_orderpriority AS model_name FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY ALL")
def missing_vectors(spark, d):
    store = read(spark, d, "customer").where("c_acctbal < 0").crossJoin(F.broadcast(read(spark, d, "orders").select("o_orderpriority").distinct())).select(F.col("c_custkey").alias("text_id"), F.col("o_orderpriority").alias("model_name"))
    return books.cache_vectors(store, read(spark, d, "orders").select(F.col("o_custkey").alias("text_id"), F.col("o_orderpriority").alias("model_name")))


# ---- rates, periods, tasks


@query("SELECT event_type, round(CASE WHEN count(*) FILTER (value > 40) > 0 THEN 100.0 * count(*) FILTER (value > 80) / count(*) FILTER (value > 40) ELSE 0 END, 6) AS hit_rate FROM events GROUP BY 1")
def cache_rates(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.round(reports.success_rate(F.col("value") > 80, F.col("value") > 40, 0.0), 6).alias("hit_rate"))


@query("SELECT round(avg(value) FILTER (value > 0), 5) AS avg, max(value) FILTER (value > 0) AS max, min(value) FILTER (value > 0) AS min, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOURS")
def period_report(spark, d):
    r = reports.period_stats(read(spark, d, "events"), "ts", "value", 24, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    return r.select(F.round("avg", 5).alias("avg"), "max", "min", "n")


@query("SELECT start, event_type, round(avg, 5) AS avg, n FROM (SELECT time_bucket(INTERVAL '12 hours', ts) - to_hours(12 * k) AS start, event_type, avg(value) AS avg, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2)")
def rolling_history(spark, d):
    r = tasks.snapshots(read(spark, d, "events"), "ts", "event_type", "value", "24 hours", "12 hours")
    return r.select("start", "event_type", F.round("avg", 5).alias("avg"), "n")


@query("SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_statuses(spark, d):
    return tasks.latest_status(read(spark, d, "events").select("user_id", "ts", "event_type", "value", "event_id"), "user_id", "ts").select("user_id", "event_type", "value", "event_id")


@query(
    "SELECT event_id, value > 50 AND 2 * value > 80 AND value / 2 <= 90 AS healthy, CASE WHEN value / 2 > 90 OR 2 * value < 70 THEN 'unhealthy' WHEN value > 80 OR value < 30 THEN 'degraded' ELSE 'healthy' END AS status FROM events"
)
def health_report(spark, d):
    v = F.col("value")
    m = read(spark, d, "events").select("event_id", (v / 2).alias("memory_percent"), v.alias("temperature"), v.alias("hit_rate"), (2 * v).alias("success_rate"))
    return tasks.health(m).select("event_id", "healthy", "status")


@query(
    "WITH h AS (SELECT user_id, 'failed' AS event_type, TIMESTAMP '2023-01-01' AS ts FROM events WHERE user_id % 3 = 0 GROUP BY 1), e AS (SELECT user_id, arg_min(s, {'t': ts, 's': s}) AS event_type, min(ts) AS ts FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS s FROM events WHERE event_type IN ('purchase', 'error')) GROUP BY 1) "
    "SELECT * FROM h UNION ALL SELECT * FROM e WHERE user_id NOT IN (SELECT user_id FROM h)"
)
def task_history(spark, d):
    e = read(spark, d, "events")
    history = e.where("user_id % 3 = 0").groupBy("user_id").agg(F.lit("failed").alias("event_type"), F.lit("2023-01-01").cast("timestamp_ntz").alias("ts"))
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return reports.finished_once(history, e.withColumn("event_type", status), "user_id", "event_type", "ts")


@query(
    "SELECT n_nationkey, len(e) = 0 AS valid, array_to_string(e, ',') AS errors FROM (SELECT n_nationkey, list_filter([CASE WHEN NOT t >= 1 THEN 'texts' END, CASE WHEN NOT a >= 10 THEN 'analyzers' END, CASE WHEN t > 1 AND n_regionkey >= 3 THEN 'comparator' END], lambda x: x IS NOT NULL) AS e "
    "FROM (SELECT n_nationkey, n_regionkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS t, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS a FROM nation))"
)
def session_validity(spark, d):
    count = lambda n, k: read(spark, d, n).groupBy(F.col(k).alias("n_nationkey")).agg(F.count("*").alias(n))
    rows = read(spark, d, "nation").join(count("supplier", "s_nationkey"), "n_nationkey", "left").join(count("customer", "c_nationkey"), "n_nationkey", "left")
    number = lambda c: F.coalesce(c, F.lit(0))
    c = reports.session_checks(number("supplier"), F.floor(number("customer") / 10), F.when(F.col("n_regionkey") < 3, "cosine"))
    return rows.select("n_nationkey", c.alias("c")).select("n_nationkey", "c.valid", F.array_join("c.errors", ",").alias("errors"))


# ---- chunks as records


@query("SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE 'file: ' || text END) AS content_md5 FROM documents")
def resolved_texts(spark, d):
    docs = read(spark, d, "documents")
    path = F.concat(F.lit("texts/"), F.col("doc_id").cast("string"))
    texts = docs.select("doc_id", path.alias("file_path"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("content"))
    return books.resolve(texts, docs.select(path.alias("file_path"), F.concat(F.lit("file: "), "text").alias("content"))).select("doc_id", F.md5("content").alias("content_md5"))


@query(
    f"SELECT doc_id, chunk_index, b AS in_timeline, c AS in_sample FROM (SELECT doc_id, chunk_index, i % greatest(CAST(floor(n * 0.25) AS BIGINT), 1) = 0 AS b, i % greatest(CAST(floor(n / 3) AS BIGINT), 1) = 0 AND i / greatest(floor(n / 3), 1) < 3 AS c "
    f"FROM (SELECT doc_id, chunk_index, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS i FROM ({chunks()}))) WHERE b OR c"
)
def sampled_chunks(spark, d):
    c = chunking.chunk(read(spark, d, "documents"), chunking.Strategy(1000, 250, 2000, 0.0)).select("doc_id", "chunk_index")
    a = narrative.timeline(c, 0.25).withColumn("in_timeline", F.lit(True))
    b = replies.strided(c, 3).withColumn("in_sample", F.lit(True))
    none = lambda x: F.coalesce(x, F.lit(False)).alias(x)
    return a.join(b, ["doc_id", "chunk_index"], "full").select("doc_id", "chunk_index", none("in_timeline"), none("in_sample"))


@query(
    f"SELECT doc_id, chunk_index, md5('Before: ' || coalesce(right(lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_index), 50), '') || chr(10) || 'Text: ' || left(content, 400)) AS prompt_md5, md5(CASE WHEN contains(content, '. ') THEN split_part(content, '. ', 1) WHEN contains(content, ', ') THEN split_part(content, ', ', 1) ELSE content END) AS cut_md5 FROM ({chunks()})"
)
def chunk_prompts(spark, d):
    c = chunking.chunk(read(spark, d, "documents"), chunking.Strategy(1000, 250, 2000, 0.0))
    p = replies.prompts(c, "Before: {context}\nText: {text}", "content", 400, "doc_id", "chunk_index", 50)
    return p.select("doc_id", "chunk_index", F.md5("prompt").alias("prompt_md5"), F.md5(replies.cut_at(F.col("content"), [". ", ", "])).alias("cut_md5"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE 'kind ' || event_type || ' of ' || user_id END AS prompt, CASE WHEN event_type = 'error' THEN 'why' ELSE '' END AS missing FROM events")
def filled_templates(spark, d):
    template = F.when(F.col("event_type") == "error", "kind {kind} {why}").otherwise("kind {kind} of {user}")
    f = read(spark, d, "events").select("event_id", replies.fill(template, {"kind": F.col("event_type"), "user": F.col("user_id")}).alias("f"))
    return f.select("event_id", "f.prompt", F.array_join("f.missing", ",").alias("missing"))


@query(
    "WITH m AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]{7,}') AS m, string_split_regex(text, '[A-Z][a-z]{7,}') AS g FROM documents), p AS (SELECT doc_id, m, list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)) AS s FROM m) "
    "SELECT doc_id, CAST(len(m) AS INT) AS matches, CAST(coalesce(list_sum(s), 0) AS BIGINT) AS starts, md5(array_to_string(m, ',')) AS texts_md5 FROM p"
)
def pattern_spans(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("start", "span"))), lambda x: x["span"])  # one text's
    found = with_spans(docs, ["[A-Z][a-z]{7,}"]).groupBy("doc_id").agg(F.count("*").cast("int").alias("matches"), F.sum("start").alias("starts"), listed.alias("spans"))
    s, none = docs.select("doc_id").join(found, "doc_id", "left"), F.expr("cast(array() as array<string>)")
    return s.select("doc_id", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("starts", F.lit(0)).alias("starts"), F.md5(F.array_join(F.coalesce("spans", none), ",")).alias("texts_md5"))


def speech_spans(spark, d):
    """Places of direct speech by kind, asked for in SQL."""
    register(spark)
    docs = read(spark, d, "documents").select("doc_id", F.replace("text", F.lit(", "), F.lit(" — ")).alias("text"))
    docs.createOrReplaceTempView("spoken_texts")
    patterns = dict(zip(("dash", "quote", "colon"), narrative.SPEECH, strict=True))
    found = spark.sql("SELECT doc_id, s.* FROM spoken_texts, LATERAL spans(text, :dash, :quote, :colon) s WHERE s.group = 1", args=patterns)
    return found.groupBy("doc_id", "pattern").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum(F.col("end") - F.col("start")).alias("chars"))


QUERIES["speech_spans"] = speech_spans


# ---- mentions


def _events(spark, d):
    return read(spark, d, "events").withColumn("text_id", F.col("user_id") % 40)


@query(
    """WITH m AS (SELECT user_id % 40 AS text_id, event_id, event_type AS name, CASE WHEN value > 100 THEN 0 WHEN value > 50 THEN 1 ELSE 2 END AS r, 't' || CAST(floor(value) AS INT) % 9 AS t1, 'T' || CAST(floor(value) AS INT) % 4 AS t2 FROM events),
g AS (SELECT text_id, name, min(r) AS r, count(*) AS appearances, min(event_id) AS first_position, max(event_id) AS last_position FROM m GROUP BY ALL),
e AS (SELECT text_id, name, event_id, 0 AS i, t1 AS t FROM m UNION ALL SELECT text_id, name, event_id, 1, t2 FROM m), o AS (SELECT text_id, name, lower(t) AS low, min(event_id * 2 + i) AS o, arg_min(t, event_id * 2 + i) AS t FROM e GROUP BY ALL),
k AS (SELECT text_id, name, string_agg(t, ',' ORDER BY o) AS traits FROM (SELECT *, row_number() OVER (PARTITION BY text_id, name ORDER BY o) AS n FROM o) WHERE n <= 5 GROUP BY ALL)
SELECT text_id, CAST(row_number() OVER (PARTITION BY text_id ORDER BY r, appearances DESC, name) AS INT) AS place, name, ['main', 'secondary', 'episodic'][r + 1] AS role, traits, appearances, CAST(first_position AS DOUBLE) AS first_position, CAST(last_position AS DOUBLE) AS last_position FROM g JOIN k USING (text_id, name)"""
)
def character_table(spark, d):
    v = F.col("value")
    trait = lambda p, n: F.struct(F.concat(F.lit(p), (F.floor(v).cast("int") % n).cast("string")).alias("trait"), F.lit("").alias("evidence"))
    m = _events(spark, d).select(
        "text_id", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("name"), F.when(v > 100, "main").when(v > 50, "secondary").otherwise("episodic").alias("role"),
        F.array(trait("t", 9), trait("T", 4)).alias("traits"), F.col("event_id").cast("double").alias("position"), F.lit(0).alias("chunk_index"),
    )
    return replies.characters(m).select("text_id", "place", F.lower("name").alias("name"), "role", F.array_join("traits", ",").alias("traits"), "appearances", "first_position", "last_position")


@query(
    """WITH m AS (SELECT user_id % 40 AS text_id, event_id, event_type AS low, 'd' || CAST(floor(value) AS INT) % 5 AS d FROM events WHERE event_type <> 'view'), g AS (SELECT text_id, low, count(*) AS frequency, avg(event_id) AS p FROM m GROUP BY ALL),
o AS (SELECT text_id, low, d, min(event_id) AS o FROM m GROUP BY ALL), k AS (SELECT text_id, low, string_agg(d, ',' ORDER BY o) AS descriptions FROM (SELECT *, row_number() OVER (PARTITION BY text_id, low ORDER BY o) AS n FROM o) WHERE n <= 3 GROUP BY ALL)
SELECT text_id, low AS theme, frequency, descriptions, round(p, 4) AS avg_position, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY frequency DESC, low) AS place FROM g JOIN k USING (text_id, low)) WHERE place <= 10"""
)
def theme_table(spark, d):
    theme = F.when(F.col("event_type") == "view", "Другое").when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    m = _events(spark, d).select("text_id", theme.alias("theme"), F.concat(F.lit("d"), (F.floor("value").cast("int") % 5).cast("string")).alias("description"), F.lit("").alias("example"), F.col("event_id").cast("double").alias("position"))
    return replies.themes(m).select("text_id", F.lower("theme").alias("theme"), "frequency", F.array_join("descriptions", ",").alias("descriptions"), F.round("avg_position", 4).alias("avg_position"), "place")


# ---- books and exports


def _xml(c: str) -> str:
    return f"regexp_replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[\\\\x00-\\\\x08\\\\x0B\\\\x0C\\\\x0E-\\\\x1F]', ' ')"


@query(
    "SELECT doc_id, false AS parse_error, doc_id % 10 <> 3 AS is_book, md5(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g'), '\\s+', ' ', 'g'))) AS body_md5, lang || ',' || source AS genres, 'Doc ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'Cycle' END AS series, "
    "CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN CAST(doc_id AS INT) END AS series_number, CASE WHEN doc_id % 5 <> 0 THEN CAST(1900 + doc_id % 100 AS INT) END AS year FROM documents"
)
def parsed_books(spark, d):
    docs = read(spark, d, "documents")
    root = F.when(F.col("doc_id") % 10 == 3, "book").otherwise("FictionBook")
    sequence = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<sequence name="Cycle" number="'), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).otherwise("x"), F.lit('"/>'))).otherwise("")
    year = F.when(F.col("doc_id") % 5 == 0, "unknown").otherwise((1900 + F.col("doc_id") % 100).cast("string"))
    xml = F.concat(
        F.lit("<"), root, F.lit("><description><title-info><genre>"), "lang", F.lit("</genre><genre>"), "source", F.lit("</genre><book-title>Doc "), F.col("doc_id").cast("string"), F.lit("</book-title>"), sequence,
        F.lit("</title-info><publish-info><year>"), year, F.lit("</year></publish-info></description><body><p>"), F.expr(_xml("text")), F.lit('</p></body><body name="notes"><p>a note</p></body></'), root, F.lit(">"),
    )
    b = books.parse_books(docs.select("doc_id", xml.alias("content")))
    return b.select("doc_id", "parse_error", "is_book", F.md5("body").alias("body_md5"), F.array_join("genre", ",").alias("genres"), "title", "series", "series_number", "year")


@query("SELECT CASE WHEN length(text) < 1000 THEN 'database' ELSE 'file' END AS storage_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) AS ids FROM documents GROUP BY 1")
def ingested_texts(spark, d):
    i = books.ingest(read(spark, d, "documents").select(F.col("text").alias("content")))
    return i.groupBy("storage_type").agg(F.count("*").alias("n"), F.sum("length").alias("characters"), F.count_distinct("text_id").alias("ids"))


@query("SELECT o_orderkey, regexp_replace(o_orderpriority || '/' || o_orderstatus, '[^\\p{L}\\p{N}_. -]', '_', 'g') || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.csv' AS file FROM orders")
def file_names(spark, d):
    return read(spark, d, "orders").select("o_orderkey", books.file_name(F.concat("o_orderpriority", F.lit("/"), "o_orderstatus"), "csv", F.col("o_orderdate")).alias("file"))


def _sessions(spark, d):
    """Nations as sessions, suppliers as their texts, customers' segments as analyzers."""
    n = read(spark, d, "nation")
    s = read(spark, d, "supplier")
    sessions = n.select(F.col("n_nationkey").alias("session_id"), F.col("n_name").alias("name"), F.lit("completed").alias("status"), F.lit("full").alias("mode"), F.lit(None).cast("string").alias("created_at"), F.lit(None).cast("string").alias("completed_at"))
    texts = s.select(F.col("s_nationkey").alias("session_id"), F.col("s_suppkey").alias("text_id"), F.col("s_name").alias("title"), F.col("s_suppkey").alias("position"), F.length("s_name").alias("length"))
    found = read(spark, d, "customer").select(F.col("c_nationkey").alias("session_id"), F.col("c_custkey").alias("position"), F.col("c_custkey").alias("text_id"), F.col("c_mktsegment").alias("analyzer_name"), F.repeat("c_name", F.lit(8)).alias("result_data"))
    shares = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "text_id")  # a few texts a task, since each meets all of its session
    edges = shares.alias("a").join(texts.alias("b"), "session_id").where("a.text_id < b.text_id").select("session_id", F.col("a.text_id").alias("text1"), F.col("b.text_id").alias("text2"), (1 / (1 + F.col("b.text_id") - F.col("a.text_id"))).alias("score"))
    return sessions, texts, found, edges


_EDGES = "SELECT a.s_nationkey AS session_id, a.s_suppkey AS text1, b.s_suppkey AS text2, 1 / (1 + b.s_suppkey - a.s_suppkey) AS score FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey"


@query(
    f"SELECT n_nationkey AS session_id, n_name AS name, 'completed' AS status, 'full' AS mode, coalesce(t, 0) AS texts, coalesce(a, 0) AS analyzers, coalesce(printf('%.4f', round(s, 4)), 'N/A') AS similarity, 'N/A' AS created_at, 'N/A' AS completed_at FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS t FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey "
    f"LEFT JOIN (SELECT c_nationkey, count(*) AS a FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT session_id, avg(score) AS s FROM ({_EDGES}) GROUP BY 1) e ON e.session_id = n_nationkey"
)
def session_table(spark, d):
    sessions, texts, found, edges = _sessions(spark, d)
    return books.sessions_table(sessions, texts, found, edges)


@query(
    "SELECT n_nationkey AS session_id, md5(to_json({'export_format': 'json', 'export_version': '1.0', 'data': {'session_id': n_nationkey, 'name': n_name, 'texts': t, 'results': r}})) AS json_md5 FROM nation LEFT JOIN (SELECT s_nationkey, list({'position': s_suppkey, 'text_id': s_suppkey, 'title': s_name} ORDER BY s_suppkey) AS t FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey "
    "LEFT JOIN (SELECT c_nationkey, list({'text_id': c_custkey, 'analyzer_name': c_mktsegment, 'result_data': repeat(c_name, 8)} ORDER BY c_custkey) AS r FROM customer GROUP BY 1) ON c_nationkey = n_nationkey WHERE t IS NOT NULL AND r IS NOT NULL"
)
def session_documents(spark, d):
    sessions, texts, found, _ = _sessions(spark, d)
    j = books.session_json(sessions.select("session_id", "name"), texts, found)
    return j.where(F.col("json").contains('"texts"') & F.col("json").contains('"results"')).select("session_id", F.md5("json").alias("json_md5"))


@query(
    f"""WITH e AS ({_EDGES}), l AS (SELECT n_nationkey AS s, 0 AS p, 0 AS o, '# ' || n_name || chr(10) || chr(10) || 'Status: completed' || chr(10) || chr(10) || '## Texts' || chr(10) AS line FROM nation
UNION ALL SELECT s_nationkey, 1, s_suppkey, '- ' || s_name || ' (' || length(s_name) || ')' FROM supplier UNION ALL SELECT c_nationkey, 2, c_custkey, '- ' || c_mktsegment || ': ' || CASE WHEN length(repeat(c_name, 8)) > 100 THEN left(repeat(c_name, 8), 100) || '...' ELSE repeat(c_name, 8) END FROM customer
UNION ALL SELECT session_id, 3, 0, 'Average similarity: ' || printf('%.4f', round(avg(score), 4)) FROM e GROUP BY 1
UNION ALL SELECT session_id, 4, r, '| ' || text1 || ' | ' || text2 || ' | ' || printf('%.4f', round(score, 4)) || ' |' FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, text1, text2) AS r FROM e) WHERE r <= 5)
SELECT s AS session_id, md5(string_agg(line, chr(10) ORDER BY p, o)) AS report_md5 FROM l GROUP BY 1"""
)
def session_reports(spark, d):
    r = books.full_report(*_sessions(spark, d))
    return r.select("session_id", F.md5("report").alias("report_md5"))


# ---- analyzers


@query(
    f"""WITH m AS (SELECT doc_id, len({tokens("text")}) AS w, CAST(length(text) AS DOUBLE) AS n, length(text) - length(replace(text, '?', '')) AS q FROM documents)
SELECT doc_id, 'size' AS analyzer, round(n, 4) AS first, round(n / greatest(w, 1), 4) AS second, w || ' words' AS interpretation FROM m UNION ALL SELECT doc_id, 'questions', CAST(q AS DOUBLE), round(1000 * q / greatest(n, 1), 4), NULL FROM m"""
)
def analyzer_results(spark, d):
    size = analyzers.Analyzer(
        "size", lambda c: {"first": F.length(c), "second": F.length(c) / F.greatest(t.token_count(c), F.lit(1)), "words": t.token_count(c)}, lambda m: F.concat(m["words"].cast("long").cast("string"), F.lit(" words"))
    )
    questions = analyzers.Analyzer("questions", lambda c: {"first": t.count_sub(c, "?"), "second": 1000 * t.count_sub(c, "?") / F.greatest(F.length(c), F.lit(1))})
    r = analyzers.analyze(read(spark, d, "documents"), [size, questions])
    return r.select("doc_id", "analyzer", F.round(F.col("metrics")["first"], 4).alias("first"), F.round(F.col("metrics")["second"], 4).alias("second"), "interpretation")


@query("SELECT doc_id, length(text) AS reply FROM documents")
def model_calls(spark, d):
    p = read(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"))
    return replies.call(p, lambda: lambda prompts: [len(x) for x in prompts], "prompt", "reply", "long").select("doc_id", "reply")


@query(
    f"""SELECT p_partkey, 'Структура текста: ' || p_brand || ' (' || printf('%.3f', round(p_size / 50, 3)) || ')' || chr(10) || 'Тип композиции: ' || p_type || CASE WHEN p_size > 10 THEN chr(10) || 'Логическая связность: ' || printf('%.3f', round((p_size - 10) / 50, 3)) ELSE '' END || CASE WHEN p_size > 20 THEN chr(10) || 'Качество абзацной структуры: ' || printf('%.3f', round((p_size - 20) / 50, 3)) ELSE '' END AS structure,
'Описания в тексте: ' || p_size || ' фрагментов' || chr(10) || 'Доля описаний: ' || printf('%.1f', round(p_size / 50 * 100, 1)) || '%' || chr(10) || 'Качество описаний: ' || p_brand || ' (' || printf('%.3f', round(p_size / 50, 3)) || ')' || CASE WHEN p_size > 30 THEN chr(10) || 'Сенсорное разнообразие: ' || printf('%.3f', round((p_size - 30) / 50, 3)) ELSE '' END AS description,
'Читаемость текста: ' || p_brand || ' (общая оценка: ' || printf('%.2f', round(p_size / 50, 2)) || ')' || chr(10) || 'Целевая аудитория: ' || p_type || chr(10) || 'Индекс Флеша: ' || printf('%.1f', round(2.0 * p_size::DOUBLE, 1)) AS readability,
CASE {" ".join(f"WHEN p_size * 2.0 < {b} THEN '{x}'" for b, x in analyzers.WATER_TEXTS)} ELSE 'Очень высокий уровень воды. Текст перегружен повторами и избыточными описаниями. Требуется серьёзная редактура.' END AS water FROM part"""
)
def interpretations(spark, d):
    size, q = F.col("p_size"), F.col("p_size") / 50
    return read(spark, d, "part").select(
        "p_partkey", analyzers.interpret_structure(q, F.col("p_brand"), F.col("p_type"), (size - 10) / 50, (size - 20) / 50).alias("structure"), analyzers.interpret_description(size, q, F.col("p_brand"), q, (size - 30) / 50).alias("description"),
        analyzers.interpret_readability(q, F.col("p_brand"), (2 * size).cast("double"), F.col("p_type")).alias("readability"), analyzers.interpret_water(size * 2.0).alias("water"),
    )


# ---- vectors

_UNIT = "least(greatest((list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / ((sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) + 1e-10) * (sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-10)) + 1) / 2, 0), 1)"


@query(
    f"""WITH p AS (SELECT a.label, {_UNIT} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, CASE WHEN s < 0.3 THEN 'very_low' WHEN s < 0.5 THEN 'low' WHEN s < 0.7 THEN 'medium' WHEN s < 0.9 THEN 'high' ELSE 'very_high' END AS level, min(CASE WHEN s < 0.3 THEN 'Тексты значительно отличаются' WHEN s < 0.5 THEN 'Тексты мало похожи' WHEN s < 0.7 THEN 'Тексты имеют умеренное сходство' WHEN s < 0.9 THEN 'Тексты очень похожи, вероятно схожая тематика' ELSE 'Тексты практически идентичны по содержанию' END) AS explanation,
count(*) AS pairs, count(*) FILTER (s >= 0.7) AS similar, round(avg(s * 100), 4) AS percentage FROM p GROUP BY 1, 2"""
)
def similarity_levels(spark, d):
    # pairs are counted by level in their tile, each once; all scores of a range have one level, and 0.7 is a bound of it
    rows = tiles.bins(read(spark, d, "embeddings"), [0.3, 0.5, 0.7, 0.9], "unit", by=["label"])
    one, pairs = F.col("one"), F.col("pairs")
    rows = rows.select("label", reports.similarity_level(one).alias("level"), "one", "pairs", F.when(reports.is_similar(one), pairs).otherwise(0).alias("similar"), reports.similarity_percentage(F.col("sum")).alias("sum"))
    sums = rows.groupBy("label", "level").agg(F.min(reports.similarity_explanation(one)).alias("explanation"), F.sum("pairs").alias("pairs"), F.sum("similar").alias("similar"), F.sum("sum").alias("sum"))
    return sums.select("label", "level", "explanation", "pairs", "similar", F.round(F.col("sum") / F.col("pairs"), 4).alias("percentage"))


@query(f"SELECT round(avg({_UNIT}), 5) AS average FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def average_similarity(spark, d):
    return tiles.average(read(spark, d, "embeddings"), ["label"]).select(F.round("average", 5).alias("average"))


@query(f"SELECT a.label, a.vec_id AS text1, count(*) AS n, round(sum({_UNIT}), 4) AS total FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY 1, 2")
def similarity_matrix(spark, d):
    m = tiles.matrix(read(spark, d, "embeddings"), "unit", by=["label"])
    return m.groupBy("label", F.col("text").alias("text1")).agg(F.sum(F.size("scores")).alias("n"), F.round(F.sum(t.total(F.col("scores"))), 4).alias("total"))


@query(f"SELECT a.vec_id AS chunk1, b.vec_id AS chunk2, round({_UNIT}, 5) AS score FROM embeddings a, embeddings b WHERE a.label = 0 AND b.label = 1 ORDER BY {_UNIT} DESC, 1, 2 LIMIT 10")
def chunk_pairs(spark, d):
    v = read(spark, d, "embeddings")
    return tiles.between(v.where("label = 0"), v.where("label = 1")).withColumn("score", F.round("score", 5))


@query(f"SELECT label, text1, text2, round(s, 5) AS score FROM (SELECT a.label, a.vec_id AS text1, b.vec_id AS text2, {_UNIT} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) ORDER BY s, text1, text2 LIMIT 15")
def least_similar(spark, d):
    return tiles.top_pairs(read(spark, d, "embeddings"), 15, "unit", least=True, by=["label"]).withColumn("score", F.round("score", 5))


@query("SELECT label, count(*) AS vectors, CAST(max(len(embedding)) AS INT) AS dimension, (SELECT count(*) FROM embeddings) AS all_vectors FROM embeddings GROUP BY 1")
def index_totals(spark, d):
    return vectors.index_totals(read(spark, d, "embeddings"), "label")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'error') AS error, count(*) AS total FROM events GROUP BY 1")
def index_activity(spark, d):
    return vectors.activity_totals(read(spark, d, "events"), "user_id", "event_type", ["click", "signup", "error"])


@query("SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 4) AS length, round(u[1], 4) AS first FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)")
def unit_vectors(spark, d):
    v = vectors.valid(read(spark, d, "embeddings"), 64).select("vec_id", vectors.normalised(F.col("embedding")).alias("u"))
    return v.select("vec_id", F.round(vectors.dot(F.col("u"), F.col("u")), 4).alias("length"), F.round(F.col("u")[0].cast("double"), 4).alias("first"))


@query(
    "SELECT query_id, vec_id, round(s, 5) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, "
    "-(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) - 2 * list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 5"
)
def knn_l2(spark, d):
    v = read(spark, d, "embeddings")
    return vectors.knn(v.where("vec_id % 20 = 0"), v, 5, "l2").select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


@query(
    "SELECT label, CASE WHEN n < 10000 THEN 'exact' WHEN n < 1000000 THEN 'ivf' ELSE 'ivf_pq' END AS method, c AS cells, CAST(greatest(floor(c / 10), 1) AS INT) AS probes, round((n * 8 * 8 / 8 + c * 64 * 4) / 1048576, 6) AS memory_mb FROM (SELECT label, n, CAST(least(greatest(floor(sqrt(n)), 10), 10000) AS INT) AS c FROM (SELECT label, count(*) * 100 AS n FROM embeddings GROUP BY 1))"
)
def search_plans(spark, d):
    rows = read(spark, d, "embeddings").groupBy("label").agg((F.count("*") * 100).alias("n"))
    return rows.select("label", vectors.search_plan(F.col("n"), 64).alias("p")).select("label", "p.method", "p.cells", "p.probes", F.round("p.memory_mb", 6).alias("memory_mb"))


def pq_recall(spark, d):
    """Share of the 10 exact neighbours that the index of residual codes finds, as it is recommended and measured."""
    v = read(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0")
    made = index.build(v)
    near = vectors.knn(q, v, 10).select("query_id", "vec_id")
    found = index.search(q, made, v).select("query_id", "vec_id", F.lit(1).alias("found"))
    return near.join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.count("found") / F.count("*")).alias("recall"))


QUERIES["pq_recall"] = pq_recall

SQL["top_pairs"] = f"SELECT text1, text2, round(s, 5) AS score FROM (SELECT a.vec_id AS text1, b.vec_id AS text2, {_UNIT} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) ORDER BY s DESC, text1, text2 LIMIT 20"
SQL["vector_water"] = """
WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, list_var_pop(embedding::DOUBLE[]) AS var, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS nx FROM embeddings),
r AS (SELECT label, vec_id, var / max(var) OVER (PARTITION BY label) AS scaled, CASE WHEN nx IS NOT NULL THEN list_dot_product(e, nx) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(nx, nx))) END AS red FROM v),
d AS (SELECT *, CASE WHEN red IS NULL THEN scaled ELSE (scaled + 1 - red) / 2 END AS density FROM r),
l AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY density, vec_id) <= greatest(floor(count(*) OVER (PARTITION BY label) * 0.2), 1) AS low FROM d)
SELECT label, round(100 * (1 - avg(density)), 5) AS water, round(coalesce(avg(red), 0), 5) AS redundancy, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) FILTER (low) AS verbose FROM l GROUP BY 1
"""
