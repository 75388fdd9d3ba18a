"""Files of sessions, written by a sink that commits whole runs and keeps a log of what failed.

The sink takes lines: (session_id, file_name, place, line, error), streams each session's lines into its file, and stages the files of each
task. A session with an error, or a line that isn't there, leaves no file but a row in the run's failures; the others are
not touched by it. The commit moves whole task folders and writes _SUCCESS last, so a run is there or not; the same run again
finds that and writes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from folio.operators import tiles

FORMAT = "session_files"
LINES = "session_id string, file_name string, line string, error string"


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: its folder and how many sessions."""

    folder: str
    written: int
    failed: int


class SessionFiles(DataSource):
    """format("session_files"), options: path, run (the name of the run)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return SessionWriter(self.options["path"], self.options["run"])


class SessionWriter(DataSourceArrowWriter):
    def __init__(self, path: str, run: str):
        self.path, self.run, self.attempt = path.rstrip("/"), run, uuid.uuid4().hex
        store, base = self._store()
        self.there = store.get_file_info(f"{base}/{run}/_SUCCESS").type != fs.FileType.NotFound

    def _store(self):
        return fs.FileSystem.from_uri(self.path)

    def _staging(self, base: str) -> str:
        return f"{base}/.staging-{self.run}-{self.attempt}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, base = self._store()
        to = f"{self._staging(base)}/{uuid.uuid4().hex}"
        if self.there:
            return Staged("", 0, 0)
        store.create_dir(f"{to}/files")
        now, out, written, failed = None, None, 0, []  # the session at hand; its file, none once it has failed

        def close(good: bool):
            nonlocal out, written
            if out is not None:
                out.close()
                out = None
                if good:
                    written += 1
                else:
                    store.delete_file(f"{to}/files/{now[1]}")

        def fail(why: str):
            close(False)
            failed.append({"session_id": now[0], "file_name": now[1], "error": why})

        for batch in iterator:
            for session, name, line, error in zip(*(batch.column(c).to_pylist() for c in ("session_id", "file_name", "line", "error")), strict=True):
                if now is None or now[0] != session:
                    close(True)
                    now = (session, name)
                    try:
                        if not name or "/" in name or name.startswith((".", "_")):
                            raise ValueError("no fit name for a file")
                        out = store.open_output_stream(f"{to}/files/{name}", compression=None)
                    except Exception as e:  # of this session alone
                        fail(f"{type(e).__name__}: {e}")
                        continue
                if out is None:
                    continue  # it has failed already
                if error is not None or line is None:
                    fail(error or "a line is not there")
                    continue
                try:
                    out.write(line.encode() + b"\n")
                except Exception as e:
                    fail(f"{type(e).__name__}: {e}")
        close(True)
        with store.open_output_stream(f"{to}/failures.json", compression=None) as log:
            log.write("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in failed).encode())
        return Staged(to, written, len(failed))

    def commit(self, messages: list[Staged | None]) -> None:
        if self.there:
            return
        store, base = self._store()
        final = f"{base}/{self.run}"
        if store.get_file_info(final).type != fs.FileType.NotFound:  # of a run that broke off while it was moved
            store.delete_dir(final)
        store.create_dir(f"{final}/_failures")
        good = [m for m in messages if m is not None and m.folder]
        for i, m in enumerate(good):  # a task each
            store.move(f"{m.folder}/files", f"{final}/part-{i:05d}")
            store.move(f"{m.folder}/failures.json", f"{final}/_failures/part-{i:05d}.json")
        with store.open_output_stream(f"{final}/_SUCCESS", compression=None) as out:
            out.write(json.dumps({"run": self.run, "written": sum(m.written for m in good), "failed": sum(m.failed for m in good)}).encode())
        self._clean(store, base)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean(*self._store())

    def _clean(self, store, base: str) -> None:
        if store.get_file_info(self._staging(base)).type != fs.FileType.NotFound:
            store.delete_dir(self._staging(base))


def export(lines: DataFrame, path: str, run: str) -> None:
    """Writes lines (session_id, file_name, place, line, error) as a file a session under path/run. A session's lines stream through
    one task in the order of `place`; none is held. Two sessions may have one file name only in different tasks' folders, so names
    should hold the id."""
    spark = lines.sparkSession
    spark.dataSource.register(SessionFiles)
    rows = lines.repartition("session_id").sortWithinPartitions("session_id", "place")
    rows.select(F.col("session_id").cast("string").alias("session_id"), "file_name", "line", F.col("error").cast("string").alias("error")).write.format(FORMAT).mode("append").option("run", run).save(path)


def failures(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Sessions that a run could not write: session_id, file_name, error."""
    return spark.read.schema("session_id string, file_name string, error string").json(f"{path.rstrip('/')}/{run}/_failures")


def csv_row(*cells: Column) -> Column:
    """One line of CSV; null cells are empty."""
    quoted = lambda c: F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", *(F.coalesce(quoted(c.cast("string")), F.lit("")) for c in cells))


def _line(part: int, order: Column, line: Column) -> list[Column]:
    return [F.struct(F.lit(part).alias("part"), order.cast("long").alias("order")).alias("place"), line.alias("line")]


def session_csv(sessions: DataFrame, texts: DataFrame, results: DataFrame) -> DataFrame:
    """Lines of the CSV file of each session: session_id, place, line. Its columns, then texts (session_id, position, text_id, title,
    length), then results (session_id, position, text_id, analyzer_name, result_data) with the first 100 characters of each."""
    short = F.when(F.length("result_data") > 100, F.concat(F.left("result_data", F.lit(100)), F.lit("..."))).otherwise(F.col("result_data"))
    fixed = lambda part, *cells: sessions.select("session_id", *_line(part, F.lit(0), csv_row(*map(F.lit, cells))))
    head = csv_row(F.lit("Session ID"), F.col("session_id"), F.lit("Name"), F.col("name"), F.lit("Status"), F.col("status"), F.lit("Mode"), F.col("mode"))
    out = sessions.select("session_id", *_line(0, F.lit(0), head))
    out = out.union(fixed(1)).union(fixed(2, "Text ID", "Title", "Length")).union(texts.select("session_id", *_line(3, F.col("position"), csv_row(F.col("text_id"), F.col("title"), F.col("length")))))
    heads = results.select("session_id").distinct()  # sessions without results have no such part
    out = out.union(heads.select("session_id", *_line(4, F.lit(0), F.lit("")))).union(heads.select("session_id", *_line(5, F.lit(0), csv_row(*map(F.lit, ("Text ID", "Analyzer", "Summary"))))))
    return out.union(results.select("session_id", *_line(6, F.col("position"), csv_row(F.col("text_id"), F.col("analyzer_name"), short))))


def matrix_lines(vectors: DataFrame, metric: str = "unit", key: str = "vec_id", column: str = "embedding", top: int = 5) -> DataFrame:
    """Lines of a similarity matrix as CSV: place, line. A head of ids, a line a text with four decimals (made from rows of tiles, not by a
    pivot), the average, and the `top` most similar pairs."""
    four = lambda c: F.format_string("%.4f", c)
    blocks = tiles.matrix(vectors, metric, key=key, column=column)
    cells = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("others", "scores"))))  # one text's row
    rows = blocks.groupBy("text").agg(cells.alias("cells"))
    text = rows.select(*_line(2, F.col("text"), F.concat_ws(",", F.col("text").cast("string"), F.transform("cells", lambda x: four(x["scores"])))))
    head = rows.orderBy("text").limit(1).select(*_line(1, F.lit(0), F.concat_ws(",", F.lit(""), F.transform("cells", lambda x: x["others"].cast("string")))))
    title = vectors.sparkSession.range(1).select(*_line(0, F.lit(0), F.lit("Comparison Matrix")))
    average = tiles.average(vectors, key=key, column=column) if metric == "unit" else None
    out = title.union(head).union(text)
    if average is not None:
        out = out.union(average.select(*_line(3, F.lit(0), F.concat(F.lit("Average Similarity,"), four("average")))))
    best = tiles.top_pairs(vectors, top, metric, key=key, column=column)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "text1", "text2", csv_row(F.col("text1"), F.col("text2"), four(F.col("score"))).alias("line"))))
    pairs = best.agg(listed.alias("all")).select(F.posexplode("all").alias("i", "x"))  # `top` rows
    return out.union(pairs.select(*_line(4, F.col("i"), F.col("x.line"))))


def write_matrix(matrix: DataFrame, path: str, by: str) -> None:
    """Appends rows of tiles.matrix() as JSON payloads, by session: a payload holds a text, the others of one block, and the scores."""
    matrix.select(by, F.lit("matrix").alias("kind"), F.to_json(F.struct("text", "others", "scores")).alias("payload")).write.mode("append").partitionBy("kind").parquet(path)
