"""Intermediate tables in the folder that all machines share, and small helpers of the operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, with its scheme, so that Spark and workers mean the same place. Only where that is
    unset and all runs on this machine (tests), under a local folder that is then set as the session's."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="folio-"))
        base = context.getCheckpointDir()
    path = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    full = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if re.match("file:/(?!/)", full) else full


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """While this lasts, a query's shuffle files go when it ends. For jobs of several steps that each leave a written result:
    at scale, disk is the greatest step's then, not the sum of all."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read; other columns, whatever their names, stay out of the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def carry(docs: DataFrame, fn, schema: str) -> DataFrame:
    """Runs fn over batches of (row struct, text string); it returns row and the columns of `schema`. All columns of docs
    travel in `row`, so no name of theirs can clash, and the text is sent once."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = StructType([packed.schema["row"], *StructType.fromDDL(schema).fields])

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            text = pc.struct_field(row, "text")
            if not pa.types.is_string(text.type) and not pa.types.is_large_string(text.type):
                text = text.cast(pa.string())
            yield from fn(iter([pa.RecordBatch.from_arrays([row, text], ["row", "text"])]))

    return packed.mapInArrow(run, out)
