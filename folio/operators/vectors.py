"""Similarity and nearest neighbours of vector columns. Dot products are summed in double."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from folio.functions.text import let
from folio.operators.ranges import ranks, with_next
from folio.sources.shared import cut

#: Query vectors in one broadcast block, at most; more are searched block by block. Queries that are scored at once.
QUERY_BLOCK, TILE = 20_000, 512
#: Vectors, or queries, of a cell that one task compares; rows of a group on a side of a tile of pairs.
CELL_ROWS, PAIR_ROWS = 20_000, 2_000
#: Numbers of a matrix that a worker makes at a time, about.
SCORES = 1_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """0 if either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine, euclidean (1 / (1 + distance)), dot, or unit (cosine moved to 0 .. 1)."""
    if metric == "euclidean":
        return 1 / (1 + F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)))
    return {"cosine": lambda: cosine(a, b), "dot": lambda: dot(a, b), "unit": lambda: F.least(F.greatest((dot(a, b) / ((norm(a) + 1e-10) * (norm(b) + 1e-10)) + 1) / 2, F.lit(0.0)), F.lit(1.0))}[metric]()


def valid(vectors: DataFrame, size: int, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has the right number of values."""
    return vectors.where(F.col(column).isNotNull() & (F.size(column) == size))


def add(store: DataFrame, new: DataFrame, key: str = "vec_id", column: str = "embedding", size: int | None = None) -> DataFrame:
    """The store with new vectors, normalised, under ids that go on from the greatest. New vectors are written with their numbers within
    each part, and then get what comes before their part: they are made once, whatever makes them. A vector that isn't there,
    or hasn't `size` values (that of the store's, where it is not given), raises an error; valid() leaves such ones out."""
    base, own = store.agg(F.coalesce(F.max(key), F.lit(-1)), F.max(F.size(column))).first()
    size = size or own
    fit = F.col(column).isNotNull() & (F.size(column) == size if size else F.lit(True))
    checked = new.select(F.when(fit, normalised(F.col(column))).otherwise(F.raise_error(F.lit(f"a vector without {size or 'any'} values"))).alias(column))
    local = cut(checked.select(F.spark_partition_id().alias("__part"), (F.monotonically_increasing_id() % (1 << 33)).alias("__place"), column), "added")
    parts = local.groupBy("__part").agg(F.count("*").alias("__n"))
    before = parts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a part
    numbered = local.join(F.broadcast(before), "__part").select((F.lit(base + 1) + F.col("__before") + F.col("__place")).cast("long").alias(key), column)
    return store.select(key, column).unionByName(numbered)


def remove(store: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return store.join(ids.select(key).distinct(), key, "left_anti")


def _unit_rows(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _top(score: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and score of the k best of each row, ties by key. Only what reaches the k-th score is sorted."""
    k = min(k, score.shape[1])
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    row, at = np.nonzero(score >= least[:, None])
    key = keys[at] if keys.ndim == 1 else keys[row, at]
    value = score[row, at]
    order = np.lexsort((key, -value, row))
    row, key, value = row[order], key[order], value[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], key[keep], value[keep]


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Of rows of two matrices, which are unit rows for cosine."""
    if metric == "l2":
        return -((q**2).sum(axis=1)[:, None] - 2 * q @ v.T + (v**2).sum(axis=1)[None, :])
    return q @ v.T


def _parts(batch: pa.RecordBatch, wide: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of so many rows that `wide` numbers for each are up to SCORES, or of one."""
    step = max(1, SCORES // max(1, wide))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def _search(queries, k: int, metric: str):
    """Scores of one block of queries against a partition's vectors, a tile at a time: its k best a query come out once."""

    def run(batches):
        ids, matrix = queries.value
        best = [(np.zeros((min(TILE, len(ids) - i), 0), np.int64), np.zeros((min(TILE, len(ids) - i), 0))) for i in range(0, len(ids), TILE)]
        for batch in (part for whole in batches for part in _parts(whole, TILE)):
            keys, v = batch.column("vec_id").to_numpy(), np.array(batch.column("embedding").to_pylist(), np.float64)
            v = _unit_rows(v) if metric == "cosine" else v
            for t, (old_keys, old) in enumerate(best):
                score = np.hstack((old, _scores(matrix[t * TILE : (t + 1) * TILE], v, metric)))
                _, key, value = _top(score, np.hstack((old_keys, np.broadcast_to(keys, (len(score), len(keys))))), k)
                best[t] = key.reshape(len(score), -1), value.reshape(len(score), -1)
        for t, (keys, score) in enumerate(best):
            if keys.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[t * TILE : (t + 1) * TILE], keys.shape[1])), pa.array(keys.ravel()), pa.array(score.ravel())], ["query_id", "vec_id", "score"])

    return run


def _blocks(queries: DataFrame, metric: str):
    ids, rows = [], []
    for r in queries.select("vec_id", "embedding").where("embedding is not null").toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == QUERY_BLOCK:
            yield _block(ids, rows, metric)
            ids, rows = [], []
    if ids:
        yield _block(ids, rows, metric)


def _block(ids, rows, metric):
    m = np.array(rows, np.float64)
    return np.array(ids), _unit_rows(m) if metric == "cosine" else m


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """Exact nearest neighbours: query_id, vec_id, score (l2: minus the squared distance), rank; min(k, n) rows a query. Both
    tables have vec_id and embedding. Blocks of queries go to all tasks; only k rows a query and task are shuffled."""
    spark, out = vectors.sparkSession, None
    data = vectors.select("vec_id", "embedding").where("embedding is not null")
    for block in _blocks(queries, metric):
        found = data.mapInArrow(_search(spark.sparkContext.broadcast(block), k, metric), "query_id long, vec_id long, score double")
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, score double")
    out = _best(out, k)
    return out if threshold is None else out.where(F.col("score") >= threshold)


def _sample(data: DataFrame, size: int) -> DataFrame:
    """About `size` rows, the same ones each time: those whose hash is in a fitting part of the range."""
    n = data.count()
    return data if n <= size else data.where(F.pmod(F.xxhash64("vec_id"), F.lit(-(-n // size))) == 0)


def ivf(vectors: DataFrame, cells: int, seed: int = 42, sample: int = 100_000, copies: int = 1) -> tuple[DataFrame, list[list[float]]]:
    """Vectors with the cell of their nearest centre, or a row for each of the `copies` nearest: where cells are not well
    apart, a neighbour across a border is then found with fewer probes. Centres are fitted on about `sample` vectors at
    most, chosen by hash; all vectors are given cells."""
    data = vectors.where("embedding is not null")
    fitted = _sample(data, sample).select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    centres = [c.tolist() for c in KMeans(k=cells, seed=seed, maxIter=10, initSteps=2).fit(fitted).clusterCenters()]
    given = vectors.sparkSession.sparkContext.broadcast(np.array(centres, np.float64))
    kind = StructType([StructField("vec_id", LongType()), StructField("embedding", vectors.schema["embedding"].dataType), StructField("cell", IntegerType())])
    return data.select("vec_id", "embedding").mapInArrow(_nearest(given, copies, ["vec_id", "embedding", "cell"]), kind), centres


def _nearest(centres, probes: int, names: list[str]):
    """Vectors in -> a row for each of their nearest cells."""

    def run(batches):
        c = centres.value
        for whole in batches:
            for batch in _parts(whole, max(len(c), probes * c.shape[1])):
                q = np.array(batch.column("embedding").to_pylist(), np.float64)
                row, cell, _ = _top(_scores(q, c, "l2"), np.arange(len(c)), probes)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(row)), batch.column("embedding").take(pa.array(row)), pa.array(cell.astype(np.int32))], names)

    return run


def _compare(k: int, metric: str):
    """Some queries and some vectors of a cell -> the k best of each query."""

    def run(asked: pa.Table, some: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and some.num_rows:
            ids, keys = asked["query_id"].to_numpy(), some["vec_id"].to_numpy()
            q, v = (np.array(x.to_pylist(), np.float64) for x in (asked["q"], some["embedding"]))
            if metric == "cosine":
                q, v = _unit_rows(q), _unit_rows(v)
            step = max(1, min(TILE, SCORES // len(keys)))
            for i in range(0, len(ids), step):
                row, key, value = _top(_scores(q[i : i + step], v, metric), keys, k)
                out.append(pa.table({"query_id": ids[i + row], "vec_id": key, "score": value}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    return run


def ivf_search(queries: DataFrame, indexed: DataFrame, centres: list, probes: int, k: int = 10, metric: str = "cosine") -> DataFrame:
    """Approximate neighbours: each query meets the vectors of its `probes` nearest cells. Centres are broadcast (at most
    10,000). A cell of very many vectors or queries is split on both sides, so no task holds more than CELL_ROWS of either."""
    near = queries.select("vec_id", "embedding").where("embedding is not null")
    given = queries.sparkSession.sparkContext.broadcast(np.array(centres, np.float64))
    asked = near.mapInArrow(_nearest(given, probes, ["query_id", "q", "cell"]), StructType([StructField("query_id", LongType()), StructField("q", near.schema["embedding"].dataType), StructField("cell", IntegerType())]))
    split = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias(name))
    sizes = F.broadcast(split(indexed, "vs").join(split(asked, "qs"), "cell"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = indexed.select("vec_id", "embedding", "cell").join(sizes, "cell").withColumn("x", F.pmod(F.xxhash64("vec_id"), "vs").cast("int")).withColumn("y", every("qs"))
    asked = asked.join(sizes, "cell").withColumn("y", F.pmod(F.xxhash64("query_id"), "qs").cast("int")).withColumn("x", every("vs"))
    grid = ["cell", "x", "y"]
    found = asked.select("query_id", "q", *grid).groupBy(*grid).cogroup(some.select("vec_id", "embedding", *grid).groupBy(*grid)).applyInArrow(_compare(k, metric), "query_id long, vec_id long, score double")
    return _best(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)  # a vector may lie in several cells


def recommended(count: int, priority: str = "balanced") -> dict:
    """Which search to use for so many vectors, and its settings."""
    cells = min(max(int(count**0.5), 10), 10_000)
    method = "exact" if count < 10_000 or priority == "accuracy" else "ivf" if count < 1_000_000 and priority != "memory" else "ivf_pq"
    return {"method": method, "cells": cells, "probes": max(1, cells // 10)}


def search_plan(count: Column, size: int, parts: int = 8, bits: int = 8) -> Column:
    """recommended() as a column of the number of vectors, with the size of codes and centres in MB."""
    cells = F.least(F.greatest(F.floor(F.sqrt(count)), F.lit(10)), F.lit(10_000)).cast("int")
    method = F.when(count < 10_000, "exact").when(count < 1_000_000, "ivf").otherwise("ivf_pq")
    return F.struct(method.alias("method"), cells.alias("cells"), F.greatest(F.floor(cells / 10), F.lit(1)).cast("int").alias("probes"), ((count * parts * bits / 8 + cells * size * 4) / 2**20).alias("memory_mb"))


def memory_estimate_mb(count: int, parts: int, bits: int, cells: int, size: int) -> float:
    return (count * parts * bits / 8 + cells * size * 4) / 2**20


def pairs(vectors: DataFrame, metric: str | Callable[[Column, Column], Column] = "unit", key: str = "vec_id", column: str = "embedding", with_self: bool = False, mirrored: bool = False, by: list[str] | None = None) -> DataFrame:
    """Similarity of all pairs within a group (`by`; a session, a label), each once with text1 < text2; optionally with
    themselves and mirrored. A stated group is compared whole; without one, the whole table is. `metric` may be a function
    of two columns. Rows without a vector are left out."""
    by = by or []
    some = vectors.where(F.col(column).isNotNull())
    # a large group is taken tile by tile, so that its pairs are made by many tasks
    size = F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("__n")
    sizes = some.groupBy(*by).agg(size)
    some = some.join(sizes, by) if by else some.crossJoin(F.broadcast(sizes))
    part, every = lambda c: F.pmod(F.xxhash64(c), "__n").cast("int"), F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    a = some.select(*by, F.col(key).alias("text1"), F.col(column).alias("v1"), part(key).alias("__x"), every.alias("__y"))
    b = some.select(*by, F.col(key).alias("text2"), F.col(column).alias("v2"), part(key).alias("__y"), every.alias("__x"))
    on = F.col("text1") <= F.col("text2") if with_self else F.col("text1") < F.col("text2")
    joined = a.join(b, [*by, "__x", "__y"]).where(on)
    score = metric(F.col("v1"), F.col("v2")) if callable(metric) else similarity(F.col("v1"), F.col("v2"), metric)
    out = joined.select(*by, "text1", "text2", score.alias("score"))
    if mirrored:
        out = out.union(out.where("text1 <> text2").select(*by, F.col("text2").alias("text1"), F.col("text1").alias("text2"), "score"))
    return out


def top_pairs(edges: DataFrame, k: int = 5, least: bool = False) -> DataFrame:
    order = F.col("score").asc() if least else F.col("score").desc()
    return edges.where("text1 < text2").orderBy(order, "text1", "text2").limit(k)


def index_totals(vectors: DataFrame, by: str, column: str = "embedding") -> DataFrame:
    """What an index of each group holds: vectors, their number of values, and vectors of all indexes together."""
    out = vectors.groupBy(by).agg(F.count("*").alias("vectors"), F.max(F.size(column)).alias("dimension"))
    return out.crossJoin(F.broadcast(vectors.agg(F.count("*").alias("all_vectors"))))


def activity_totals(log: DataFrame, by: str, kind: str, kinds: list[str]) -> DataFrame:
    """How often each kind of activity (searches, additions, removals) was logged for each index, and in all."""
    return log.groupBy(by).agg(*(F.count_if(F.col(kind) == k).alias(k) for k in kinds), F.count("*").alias("total"))


def average_similarity(edges: DataFrame) -> DataFrame:
    """Over pairs of different texts; 0 if there are none."""
    return edges.where("text1 <> text2").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("average"))


def text_averages(edges: DataFrame) -> DataFrame:
    """Of each text to the others, from pairs listed once."""
    one = edges.where("text1 < text2")
    both = one.select(F.col("text1").alias("text"), "score").union(one.select(F.col("text2").alias("text"), "score"))
    return both.groupBy("text").agg(F.avg("score").alias("average"))


def group_averages(vectors: DataFrame, by: str, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Of each vector the average cosine to the others of its group, without forming a pair: the sum of a group's unit
    vectors times the vector, less its own share. Sums are pre-aggregated place by place. A group of one: no row."""
    unit = vectors.where(F.col(column).isNotNull()).select(by, key, F.transform(column, lambda x: x.cast("double")).alias("v")).withColumn("n", norm(F.col("v")))
    unit = unit.withColumn("u", F.transform("v", lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(0.0)))
    places = unit.select(by, F.posexplode("u").alias("i", "x")).groupBy(by, "i").agg(F.sum("x").alias("x"))
    sums = places.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("sum"))
    sums = sums.join(unit.groupBy(by).agg(F.count("*").alias("c")), by)
    own = F.when(F.col("n") > 0, 1.0).otherwise(0.0)
    return unit.join(sums, by).where("c > 1").select(by, F.col(key).alias("text"), ((dot(F.col("u"), F.col("sum")) - own) / (F.col("c") - 1)).alias("average"))


def mean_vector(vectors: DataFrame, by: str, column: str = "embedding") -> DataFrame:
    """Mean of the vectors of a group, place by place."""
    rows = vectors.select(by, F.posexplode(column).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("x"))
    return rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(column))


def density(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_index", column: str = "embedding") -> DataFrame:
    """Information density of chunk vectors: key, order, redundancy (cosine to the next chunk of the text; null for the last),
    density (variance over the text's greatest, averaged with 1 - redundancy), low (among the lowest fifth of the text; one at
    least). Texts of any number of chunks are shared by tasks, range by range."""
    rows = with_next(chunks.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(column).alias("v")), "k", "o", {"next": "v"})
    rows = rows.select("k", "o", variance_of(F.col("v")).alias("var"), F.when(F.col("next").isNotNull(), cosine(F.col("v"), F.col("next"))).alias("redundancy"))
    rows = rows.join(rows.groupBy("k").agg(F.max("var").alias("most")), "k")
    scaled = F.col("var") / F.greatest("most", F.lit(1e-300))
    rows = rows.select("k", "o", "redundancy", F.when(F.col("redundancy").isNull(), scaled).otherwise((scaled + 1 - F.col("redundancy")) / 2).alias("density"))
    placed = ranks(rows, "k", ["density", "o"], "place", "n")
    low = F.col("place") <= F.greatest(F.floor(F.col("n") * 0.2), F.lit(1))
    return placed.select(F.col("k").alias(key), F.col("o").alias(order), "redundancy", "density", low.alias("low"))


def variance_of(a: Column) -> Column:
    """Population variance of the values of a vector."""
    v = F.transform(a, lambda x: x.cast("double"))
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return let(mean, lambda m: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(x - m, 2)) / F.size(a))


def density_report(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_index", column: str = "embedding") -> DataFrame:
    """density() by text: water percentage, redundancy, and how many chunks are in the lowest fifth."""
    rows = density(chunks, key, order, column)
    return rows.groupBy(key).agg((100 * (1 - F.avg("density"))).alias("water"), F.coalesce(F.avg("redundancy"), F.lit(0.0)).alias("redundancy"), F.count_if("low").alias("verbose"))
