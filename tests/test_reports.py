"""Vectors, reports, replies, sources and streams."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import replies, reports, vectors
from folio.sources import books
from folio.streaming import tasks

T0 = datetime(2024, 5, 1)


def test_vectors(spark, monkeypatch):
    r = np.random.default_rng(3)
    data = r.normal(size=(60, 8)).astype(np.float32)
    data[5] = 0
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id long, embedding array<float>")
    unit = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-30)
    for metric, score in (("cosine", unit @ unit.T), ("dot", data @ data.T), ("l2", -((data[:, None] - data[None]) ** 2).sum(axis=2))):
        for x in vectors.knn(v.where("vec_id < 4"), v, 3, metric).collect():
            assert x.score == pytest.approx(sorted(score[x.query_id], reverse=True)[x["rank"] - 1], abs=1e-5)
    assert vectors.knn(v.limit(1), v.limit(2), 10).count() == 2 and vectors.knn(v.limit(0), v).count() == 0
    x = v.where("vec_id = 1").select(vectors.cosine(F.col("embedding"), F.col("embedding")).alias("a"), vectors.cosine(F.col("embedding"), F.transform("embedding", lambda y: y * 0)).alias("b"), vectors.norm(vectors.normalised(F.col("embedding"))).alias("c")).first()
    assert (x.a, x.b, x.c) == (pytest.approx(1), 0.0, pytest.approx(1))
    plain = {(min(i, j), max(i, j)) for i in range(20) for j in range(20) if i != j}
    for rows in (2000, 3):  # one tile, and many
        monkeypatch.setattr(vectors, "PAIR_ROWS", rows)
        found = vectors.pairs(v.where("vec_id < 20"), "cosine").collect()
        assert len(found) == len(plain) and {(x.text1, x.text2) for x in found} == plain
        assert all(x.score == pytest.approx(float(unit[x.text1] @ unit[x.text2]), abs=1e-5) for x in found)
    indexed, centres = vectors.ivf(v, 6)
    exact = {(x.query_id, x.vec_id, x["rank"]) for x in vectors.knn(v.where("vec_id < 9"), v, 5).collect()}
    for rows in (20000, 4):  # all cells probed: as exact search, also where cells are split on both sides
        monkeypatch.setattr(vectors, "CELL_ROWS", rows)
        assert {(x.query_id, x.vec_id, x["rank"]) for x in vectors.ivf_search(v.where("vec_id < 9"), indexed, centres, 6, 5).collect()} == exact
    averages = {x.text: x.average for x in vectors.group_averages(v.withColumn("g", F.lit(1)), "g").collect()}
    assert all(averages[i] == pytest.approx((unit @ unit[i]).sum() / 59 - (1 / 59 if i != 5 else 0), abs=1e-5) for i in range(60))
    edges = vectors.pairs(v.limit(6), "unit", mirrored=True, with_self=True)
    assert edges.count() == 36 and vectors.top_pairs(edges, 3).count() == 3
    assert vectors.average_similarity(edges.limit(0)).first().average == 0.0
    assert vectors.add(v, v.limit(3)).agg(F.max("vec_id")).first()[0] == 62 and vectors.remove(v, v.limit(3)).count() == 57
    assert vectors.recommended(100)["method"] == "exact" and vectors.recommended(50_000)["method"] == "ivf"


def test_reports(spark):
    s = spark.createDataFrame([(1, "draft"), (2, "running"), (3, "completed")], "id long, status string")
    assert [x[0] for x in s.orderBy("id").select(reports.next_status(F.col("status"), "queued")).collect()] == ["queued", "running", "completed"]
    ok = s.select(reports.checks({"id": F.col("id") > 1, "status": F.col("status") != "draft"}).alias("c")).collect()
    assert [x.c.valid for x in ok] == [False, True, True] and ok[0].c.errors == ["id", "status"]
    changed = reports.upsert(s, spark.createDataFrame([(1, "queued", "x")], "id long, status string, other string"), "id")
    assert {x.id: x.status for x in changed.collect()}[1] == "queued" and changed.columns == s.columns
    assert reports.append_new(s, spark.createDataFrame([(3, "x"), (4, "y"), (4, "y")], "id long, status string"), ["id"]).count() == 4
    line = spark.createDataFrame([("a\nb\n",), ("",), ("x",)], "t string").select(reports.line_count(F.col("t")).alias("n")).collect()
    assert [x.n for x in line] == [2, 0, 1]
    e = spark.createDataFrame([("k", T0 + timedelta(minutes=i), float(i)) for i in range(12)], "g string, ts timestamp, v double")
    assert reports.trend(e, ["g"], "ts", "v", margin=1).first().trend == "increasing"
    value = None
    for i in range(12):
        value = i if value is None else 0.1 * i + 0.9 * value
    assert reports.moving_average(e, ["g"], "ts", "v").first().ema == pytest.approx(value)
    value = 0.0
    for i in range(12):
        value = 0.1 * i + 0.9 * value
    assert reports.moving_average(e, ["g"], "ts", "v", seed=0.0).first().ema == pytest.approx(value)
    assert reports.latest(e, ["g"], "ts", 3).count() == 3
    with pytest.raises(ValueError):
        reports.page(e, [F.col("ts")], 0, 500)


def test_mentions(spark):
    trait = "array<struct<trait:string,evidence:string>>"
    rows = [("t", "Иван", "secondary", [("смел", "")], 0.1, 0), ("t", "иван", "main", [("Смел", ""), *((f"t{i}", "") for i in range(9))], 0.9, 9), ("t", "Мария", "episodic", [], 0.5, 4), ("t", "Неизвестный", "main", [], 0.2, 1), ("t", "", "main", [], 0.2, 1), ("t", "Unknown", "main", None, 0.3, 1)]
    got = replies.characters(spark.createDataFrame(rows, f"text_id string, name string, role string, traits {trait}, position double, chunk_index int")).orderBy("place").collect()
    assert [(x.name, x.role, x.appearances) for x in got] == [("Иван", "main", 2), ("Мария", "episodic", 1)]
    assert len(got[0].traits) == 5 and got[0].traits[0] == "смел" and (got[0].first_position, got[0].last_position) == (0.1, 0.9)
    rows = [("t", "любовь", "d1", "e", 0.1), ("t", "Любовь", "d2", "", 0.5), ("t", "дружба", "d", "e", 0.2), ("t", "Другое", "d", "e", 0.2)]
    got = replies.themes(spark.createDataFrame(rows, "text_id string, theme string, description string, example string, position double")).orderBy("place").collect()
    assert [(x.theme, x.frequency) for x in got] == [("любовь", 2), ("дружба", 1)] and got[0].descriptions == ["d1", "d2"]


def test_replies(spark):
    rows = ['x {"main_genre": "роман", "confidence": 1.7, "sub_genres": ["a"]} y', "просто текст", '{"a": {"b": 1}, "main_genre": "эссе"}', "{broken"]
    got = [x.g for x in spark.createDataFrame([(r,) for r in rows], "r string").select(replies.genre(F.col("r")).alias("g")).collect()]
    assert [(g.main_genre, g.confidence) for g in got] == [("роман", 1.0), ("просто текст", 0.3), ("эссе", 0.5), ("{broken", 0.3)]
    x = spark.range(1).select(replies.fill(F.lit("a {x} {y}"), {"x": F.lit(1)}).alias("f"), replies.cut_at(F.lit("abc STOP d END"), ["END", "STOP"]).alias("c"), replies.slots(F.lit("{a}{b}{a}")).alias("s")).first()
    assert x.f.prompt is None and x.f.missing == ["y"] and x.c == "abc STOP d " and x.s == ["a", "b"]
    called = replies.call(spark.createDataFrame([("p",), ("q",)], "prompt string"), lambda: lambda ps: [p + "!" for p in ps], "prompt", "reply", "string")
    assert sorted(x.reply for x in called.collect()) == ["p!", "q!"]


BOOK = """<?xml version="1.0" encoding="utf-8"?>
<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info><genre>sf</genre><genre>prose</genre><author><first-name>Иван</first-name><last-name>Петров</last-name></author>
<book-title>Книга</book-title><lang>ru</lang><sequence name="Цикл" number="2"/></title-info><publish-info><publisher>Дом</publisher><year>%s</year><isbn>1-2</isbn></publish-info></description>
<body><p>Первый абзац.</p><p>Второй
абзац.</p></body><body name="notes"><p>Примечание</p></body><binary>xxxx</binary></FictionBook>"""


def test_books(spark, tmp_path):
    for name, text in {"a": BOOK % "1999", "b": BOOK % "год", "c": "<FictionBook><body>", "d": "<other><body><p>t</p></body></other>"}.items():
        (tmp_path / f"{name}.fb2").write_text(text)
    files = books.read_texts(spark, f"file://{tmp_path}/*.fb2")
    rows = books.parse_books(files).orderBy("file_path").collect()
    assert [x.parse_error for x in rows] == [False, False, True, False] and [x.is_book for x in rows] == [True, True, False, False]
    assert rows[0].body == "Первый абзац. Второй абзац." and rows[0].genre == ["sf", "prose"] and (rows[0].year, rows[1].year) == (1999, None)
    assert (rows[0].title, rows[0].first_name, rows[0].last_name, rows[0].series, rows[0].series_number, rows[0].isbn) == ("Книга", "Иван", "Петров", "Цикл", 2, "1-2")
    x = books.ingest(spark.createDataFrame([("a" * 1500,), ("b",)], "content string")).orderBy("length").collect()
    assert [r.storage_type for r in x] == ["database", "file"]


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([("s1", "n", "completed", "full", T0, None)], "session_id string, name string, status string, mode string, created_at timestamp, completed_at timestamp")
    texts = spark.createDataFrame([("s1", "t1", "Title", 1), ("s1", "t2", None, 0)], "session_id string, text_id string, title string, position int")
    edges = spark.createDataFrame([("s1", "t1", "t2", 0.5)], "session_id string, text1 string, text2 string, score double")
    analyzers = spark.createDataFrame([("s1", "a")], "session_id string, analyzer_name string")
    out = books.sessions_table(s, texts, analyzers, edges)
    assert (out.first().texts, out.first().similarity, out.first().completed_at) == (2, "0.5000", "N/A")
    books.write_csv(out, f"file://{tmp_path}/csv")
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).count() == 1
    assert books.matrix(edges.drop("session_id"), ["t1", "t2"]).first().t2 == "0.5000"
    results = spark.createDataFrame([("s1", "t1", "a", "x" * 150, T0)], "session_id string, text_id string, analyzer_name string, result_data string, created_at timestamp")
    report = books.reports(s, texts, results).first().report
    assert report.startswith("# n") and report.index("N/A") < report.index("Title") < report.index("- a: ") and report.endswith("...")
    books.write_results(results, f"file://{tmp_path}/res")
    assert spark.read.parquet(f"file://{tmp_path}/res").first().analyzer_name == "a"


def run_stream(spark, df, name, mode):
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a state store for each partition is what takes time here
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.table(name)


def test_streams(spark, tmp_path):
    schema = "task_id string, ts timestamp, status string, value double"
    rows = [(f"t{i % 3}", T0 + timedelta(minutes=i), "completed" if i > 8 else "running", float(i)) for i in range(12)]
    static = spark.createDataFrame(rows, schema)
    static.repartition(1).write.parquet(f"file://{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    got = run_stream(spark, tasks.counters(stream(), "ts", "status", "5 minutes"), "counters", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tasks.counters(static, "ts", "status", "5 minutes").collect()))
    cycle = {x.task_id: x for x in tasks.life_cycle(static).collect()}
    assert cycle["t0"].seconds == 540.0 and cycle["t0"].outcome == "completed"
    got = run_stream(spark, tasks.life_cycle(stream()), "cycle", "update")
    assert {x.task_id: x.seconds for x in got.collect()} == {k: v.seconds for k, v in cycle.items()}
    assert {x.task_id: x.value for x in tasks.latest_status(static).collect()} == {"t0": 9.0, "t1": 10.0, "t2": 11.0}
    metric = static.select("ts", F.lit(95).alias("memory_percent"), F.lit(10).alias("temperature"), F.lit(60).alias("hit_rate"), F.lit(90).alias("success_rate"))
    assert {(x.alert, x.severity) for x in tasks.alerts(metric).collect()} == {("memory", "critical")}
    assert {(x.healthy, x.status) for x in tasks.health(metric).collect()} == {(False, "unhealthy")}
    steps = run_stream(spark, tasks.followed(stream(), "2 hours"), "followed", "update").collect()
    last = {x.task_id: x for x in sorted(steps, key=lambda x: x.seconds)}
    assert {k: (x.status, x.seconds) for k, x in last.items()} == {f"t{i}": ("completed", 540.0) for i in range(3)}
    averages = run_stream(spark, tasks.moving_averages(stream().select(F.col("task_id").alias("key"), "ts", "value")), "averages", "update")
    value = None
    for x in (0, 3, 6, 9):
        value = x if value is None else 0.1 * x + 0.9 * value
    assert {x.key: x.ema for x in averages.collect()}["t0"] == pytest.approx(value)


@pytest.mark.parametrize("texts", [3, 40])
def test_best_edges(spark, texts):
    """The best pairs of sessions with few pairs, many ties, and one score only, without a sort of all of them."""
    pairs = [(k, a, b, {0: 1.0 / (b - a), 1: 0.5, 2: float(a * 7 % 5) if a > 1 else 9.0}[k]) for k in range(3) for a in range(texts) for b in range(a + 1, texts)]
    edges = spark.createDataFrame(pairs, "session_id int, text1 int, text2 int, score double")
    got = sorted((x.session_id, x.r, x.text1, x.text2) for x in books.best_edges(edges).collect())
    assert got == [(k, i + 1, a, b) for k in range(3) for i, (_, a, b) in enumerate(sorted((-s, a, b) for j, a, b, s in pairs if j == k)[:5])]


def test_matrix_lines_need_no_exchange(spark):
    """Pairs become JSON in their own rows; a session's document holds none of them."""
    s = spark.createDataFrame([("s1", "n")], "session_id string, name string")
    texts = spark.createDataFrame([("s1", "t1", "a", 1), ("s1", "t2", "b", 2)], "session_id string, text_id string, title string, position int")
    edges = spark.createDataFrame([("s1", "t1", "t2", 0.1), ("s1", "t1", "t3", 0.25)], "session_id string, text1 string, text2 string, score double")
    lines = books.matrix_json(edges)
    assert sorted(x.json for x in lines.collect()) == [f'{{"session_id":"s1","text1":"t1","text2":"{b}","score":{v}}}' for b, v in (("t2", 0.1), ("t3", 0.25))]
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    results = spark.createDataFrame([("s1", "t1", "x", "y")], "session_id string, text_id string, analyzer_name string, result_data string")
    assert "matrix" not in books.session_json(s, texts, results).first().json
