"""The sink of session files: failures stay alone, a run is written once."""

import csv
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.sources import exports


def lines(spark, bad=True):
    rows = [(f"s{i}", f"s{i}.csv", k, f"line {i} {k}", None) for i in range(12) for k in range(5)]
    if bad:
        rows[7] = ("s1", "s1.csv", 2, "x", "no such analyzer")  # in the middle of its lines
        rows[15] = ("s3", "s3.csv", 0, None, None)
        rows += [("s90", "a/b", 0, "x", None), ("s91", None, 0, "x", None), ("s92", "s92.csv", 0, "", None)]
    return spark.createDataFrame(rows, "session_id string, file_name string, place int, line string, error string")


def files(path):
    return {p.name: p.read_text() for p in path.glob("part-*/*")}


def test_failures_stay_alone(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    exports.export(lines(spark), path, "run1")
    got = files(tmp_path / "out/run1")
    assert got == {f"s{i}.csv": "".join(f"line {i} {k}\n" for k in range(5)) for i in range(12) if i not in (1, 3)} | {"s92.csv": "\n"}
    failed = {r.session_id: r.error for r in exports.failures(spark, path, "run1").collect()}
    assert set(failed) == {"s1", "s3", "s90", "s91"} and failed["s1"] == "no such analyzer"
    assert not list((tmp_path / "out").glob(".staging*"))


def test_once(spark, tmp_path):
    """The same run again writes nothing; one that broke off while it was moved is made anew; another run stands beside it."""
    path, top = f"file://{tmp_path}/out", tmp_path / "out/run1"
    exports.export(lines(spark, False), path, "run1")
    before = {p: p.stat().st_mtime_ns for p in top.rglob("*")}
    exports.export(lines(spark), path, "run1")
    assert {p: p.stat().st_mtime_ns for p in top.rglob("*")} == before and not list((tmp_path / "out").glob(".staging*"))
    (top / "_SUCCESS").unlink()
    next(top.glob("part-*/s5.csv")).write_text("half")
    exports.export(lines(spark, False), path, "run1")
    assert len(files(top)) == 12 and "half" not in files(top).values()
    exports.export(lines(spark, False).limit(0), path, "run2")
    assert files(tmp_path / "out/run2") == {} and (tmp_path / "out/run2/_SUCCESS").exists()


def test_abort(spark, tmp_path):
    """A job that fails as a whole leaves nothing behind."""
    broken = lines(spark).withColumn("line", F.when(F.col("session_id") == "s5", F.raise_error(F.lit("broken input"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken input"):
        exports.export(broken, f"file://{tmp_path}/out", "run1")
    assert not list((tmp_path / "out").glob("run1/*")) and not list((tmp_path / "out").glob(".staging*"))


def test_session_csv(spark):
    sessions = spark.createDataFrame([("s1", 'a "name", quoted', "done", "full"), ("s2", None, "new", "full")], "session_id string, name string, status string, mode string")
    texts = spark.createDataFrame([("s1", 1, "t2", "T,2", 5), ("s1", 0, "t1", None, 3)], "session_id string, position int, text_id string, title string, length int")
    results = spark.createDataFrame([("s1", 0, "t1", "a", "x" * 150), ("s1", 1, "t1", "b", "line\nbreak")], "session_id string, position int, text_id string, analyzer_name string, result_data string")
    got = exports.session_csv(sessions, texts, results).orderBy("session_id", "place").collect()
    rows = list(csv.reader(io.StringIO("".join(r.line + "\n" for r in got if r.session_id == "s1"))))
    assert rows[0] == ["Session ID", "s1", "Name", 'a "name", quoted', "Status", "done", "Mode", "full"] and rows[3:5] == [["t1", "", "3"], ["t2", "T,2", "5"]]
    assert rows[-3:] == [["Text ID", "Analyzer", "Summary"], ["t1", "a", "x" * 100 + "..."], ["t1", "b", "line\nbreak"]]
    assert [r.line for r in got if r.session_id == "s2"] == ["Session ID,s2,Name,,Status,new,Mode,full", "", "Text ID,Title,Length"]


def test_matrix(spark, tmp_path):
    v = np.random.default_rng(1).normal(size=(9, 4))
    df = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = [r.line for r in exports.matrix_lines(df).orderBy("place").collect()]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = (unit @ unit.T + 1) / 2
    assert got[0] == "Comparison Matrix" and got[1] == "," + ",".join(str(i * 3) for i in range(9))
    assert got[2:11] == [f"{i * 3}," + ",".join(f"{x:.4f}" for x in s[i]) for i in range(9)]
    upper = sorted(((-s[i, j], i * 3, j * 3) for i in range(9) for j in range(i + 1, 9)))
    assert got[11] == f"Average Similarity,{-np.mean([x[0] for x in upper]):.4f}" and got[12:] == [f"{a},{b},{-x:.4f}" for x, a, b in upper[:5]]
    from folio.operators import tiles

    exports.write_matrix(tiles.matrix(df.withColumn("session_id", F.lit("s")), by=["session_id"]), f"file://{tmp_path}/m", "session_id")
    assert spark.read.parquet(f"file://{tmp_path}/m").count() == 9
