"""A store of text embeddings, and the job that fills it: only texts that are new or have changed go through the model.

The store is a folder of Parquet, one subfolder a run, and a row for each text, model and content that was embedded. Of several rows of
a text the latest run's counts, so a run that is repeated or breaks off, or a compaction at work, changes nothing that is read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "text_id string, model_name string, content_sha256 string, embedding array<float>, error string, run long"
KEY = ["text_id", "model_name"]


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the runs that are complete."""
    store, p = _files(spark, path)
    if not store.exists(p):
        return []
    done = [s.getPath() for s in store.listStatus(p) if s.getPath().getName().startswith("run=") and store.exists(s.getPath().suffix("/_SUCCESS"))]
    return sorted(int(x.getName()[4:]) for x in done)


def read(spark: SparkSession, path: str) -> DataFrame:
    """What is embedded: the latest good row of each text and model."""
    there = runs(spark, path)
    if not there:
        return spark.createDataFrame([], ROWS).drop("error", "run")
    rows = spark.read.schema(ROWS).option("basePath", path).parquet(*(f"{path}/run={r}" for r in there)).where("error is null")
    names = ["content_sha256", "embedding"]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*names), "run").alias("x")).select(*KEY, "x.*")


def missing(texts: DataFrame, path: str, model: str) -> DataFrame:
    """Texts (text_id, content) whose content the model has not embedded yet, each once: text_id, model_name, content_sha256, content."""
    own = texts.select(F.col("text_id").cast("string").alias("text_id"), F.lit(model).alias("model_name"), F.sha2("content", 256).alias("content_sha256"), "content").where("content is not null")
    have = read(texts.sparkSession, path).select(*KEY, "content_sha256")
    return own.dropDuplicates(KEY).join(have, [*KEY, "content_sha256"], "left_anti")


def _call(make: Callable[[], Callable[[list[str]], list]], batch: int, tries: int, wait: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                some = pdf.iloc[i : i + batch]
                vectors, error = [None] * len(some), None
                for k in range(tries):
                    try:
                        model = model or make()
                        vectors, error = [[float(x) for x in v] for v in model(some["content"].tolist())], None
                        if len(vectors) != len(some):
                            raise ValueError(f"{len(vectors)} vectors for {len(some)} texts")
                        break
                    except Exception as e:  # a batch is tried again by itself, with the model opened anew
                        model, vectors, error = None, [None] * len(some), f"{type(e).__name__}: {e}"
                        time.sleep(wait * 2**k if k + 1 < tries else 0)
                yield pd.DataFrame({"text_id": some["text_id"], "model_name": some["model_name"], "content_sha256": some["content_sha256"], "embedding": vectors, "error": error})

    return run


def embed_missing(texts: DataFrame, path: str, model: str, make: Callable[[], Callable[[list[str]], list]], batch: int = 64, tries: int = 3, wait: float = 0.5) -> int:
    """One run: embeds what is missing and appends it; gives the run's number. `make` opens the model in a task; it takes a list of
    texts and gives a vector for each. A batch that fails `tries` times leaves rows with its error, and is missing still: the
    next run tries it again. Texts that are null are left out; of repeated ids one is taken. Nothing missing: an empty run."""
    spark = texts.sparkSession
    number = max(runs(spark, path), default=0) + 1
    todo = missing(texts, path, model)
    kind = "text_id string, model_name string, content_sha256 string, embedding array<float>, error string"
    todo.mapInPandas(_call(make, batch, tries, wait), kind).write.mode("overwrite").parquet(f"{path}/run={number}")
    return number


def errors(spark: SparkSession, path: str, run: int) -> DataFrame:
    """Texts that a run could not embed, with why."""
    return spark.read.schema(ROWS).parquet(f"{path}/run={run}").where("error is not null").select("text_id", "model_name", "error")


def compact(spark: SparkSession, path: str, files: int = 1) -> None:
    """Writes what counts as one new run of about `files` files, and then removes the runs before it."""
    before = runs(spark, path)
    if len(before) < 2:
        return
    read(spark, path).withColumn("error", F.lit(None).cast("string")).coalesce(files).write.mode("overwrite").parquet(f"{path}/run={before[-1] + 1}")
    store, _ = _files(spark, path)
    for r in before:
        store.delete(_files(spark, f"{path}/run={r}")[1], True)
