"""An index of product-quantised residuals in inverted lists (IVF-PQ), with exact re-ranking.

A vector goes to the list of its nearest centre, and what it differs from the centre is written as one byte for each slice
of its values. A search opens the lists nearest to a query, scores their codes from a table of inner products of the query
with all code words, and compares the best of them with the query once more in full.

How many lists to open is measured, not guessed: a sample of vectors is searched exactly, and the share of true neighbours
by the rank of their list tells how many lists a wanted recall takes. Where vectors lie in clusters these are few; where
they don't, no index can do with few.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from folio.functions.text import let
from folio.operators.vectors import SCORES, _best, _parts, _sample, _top, _unit_rows, ivf, knn, recommended
from folio.sources.shared import cut

#: Rows that code books are fitted on, at most; queries that the number of lists is measured on; neighbours sought for each.
BOOK_ROWS, PROBE_QUERIES, NEIGHBOURS = 20_000, 200, 10
#: Code words of a slice: a code is a byte.
CODES = 256
#: Candidates that are compared in full, for each neighbour asked for.
SHORT_LIST = 20
#: Lists lie on shelves: how many, at least, and codes of one, at most. Queries that a task compares with a shelf; those it does at a time; tasks, at most.
SHELVES, SHELF_ROWS, ASKED_ROWS, TILE, TASKS = 8, 100_000, 2_000, 256, 10_000
LOWEST = np.finfo(float).min


@dataclass
class Index:
    """Lists: vec_id, cell, codes, as a written table; centres (cells x values) and code books (slices x codes x values of one)."""

    lists: DataFrame
    centres: np.ndarray
    books: np.ndarray
    metric: str
    probes: int


def _rows(column, metric: str) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return _unit_rows(v) if metric == "cosine" else v


def _distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (v**2).sum(1)[:, None] - 2 * v @ c.T + (c**2).sum(1)[None, :]


def _nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of each row of v, which row of c is nearest."""
    step = max(1, SCORES // len(c))
    return np.concatenate([_distances(v[i : i + step], c).argmin(1) for i in range(0, len(v), step)])


def _slices(centres, parts: int, metric: str):
    """Vectors in -> for each slice of their residuals: its number and values as bytes."""

    def run(batches):
        c = centres.value
        for batch in batches:
            if batch.num_rows:
                v = _rows(batch.column("embedding"), metric)
                r = (v - c[_nearest(v, c)]).reshape(len(v), parts, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(parts, dtype=np.int32), len(v))), pa.array([x.tobytes() for x in r.reshape(len(v) * parts, -1)], pa.binary())], ["part", "values"])

    return run


def _book(codes: int, seed: int, rounds: int = 10):
    """Code words of one slice by k-means; as many as there are different values, if these are fewer."""

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        x = np.unique(np.frombuffer(b"".join(sorted(part["values"].to_pylist())), np.float64).reshape(part.num_rows, -1), axis=0)
        k = min(codes, len(x))
        words = x[np.random.default_rng(seed + key[0].as_py()).choice(len(x), k, replace=False)]
        for _ in range(rounds):
            near = _nearest(x, words)
            n = np.bincount(near, minlength=k)
            sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], 1)
            words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([words.tobytes()], pa.binary())})

    return run


def _encode(fitted, metric: str):
    def run(batches):
        c, books = fitted.value
        parts, _, d = books.shape
        for batch in batches:
            if batch.num_rows:
                v = _rows(batch.column("embedding"), metric)
                cell = _nearest(v, c)
                r = (v - c[cell]).reshape(len(v), parts, d)
                codes = np.stack([_nearest(r[:, p], books[p]) for p in range(parts)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cell.astype(np.int32)), pa.array([x.tobytes() for x in codes], pa.binary())], ["vec_id", "cell", "codes"])

    return run


def _needed(centres, metric: str):
    """Queries with the vectors of their true neighbours in -> how many lists have to be opened to meet each of these."""

    def run(batches):
        c = centres.value
        for whole in batches:
            for batch in _parts(whole, len(c)):
                q, v = _rows(batch.column("q"), metric), _rows(batch.column("embedding"), metric)
                far = _distances(q, c)
                own = far[np.arange(len(q)), _nearest(v, c)]
                yield pa.RecordBatch.from_arrays([pa.array((far < own[:, None]).sum(1).astype(np.int32) + 1)], ["needed"])

    return run


def build(vectors: DataFrame, parts: int = 16, metric: str = "cosine", cells: int | None = None, recall: float = 0.95, seed: int = 42) -> Index:
    """An index of all rows of `vectors` (vec_id, embedding) that have a vector, by the recommended number of cells.

    Centres are fitted on about 100,000 vectors at most and code books on 20,000, chosen by hash; every vector is coded.
    `parts` has to divide the number of values. The number of lists to open is that which meets `recall` of the true
    neighbours of some 200 vectors. Null vectors are left out; repeated ids are indexed each; of no vectors there is no index."""
    spark = vectors.sparkSession
    data = vectors.select("vec_id", "embedding").where("embedding is not null")
    count = data.count()
    if not count:
        raise ValueError("no vectors to index")
    size = len(data.select("embedding").first()[0])
    if size % parts:
        raise ValueError("the number of values must be divisible by parts")
    cells = min(cells or recommended(count)["cells"], count)
    unit = data.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    if metric == "cosine":
        n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
        unit = unit.select("vec_id", let(n, lambda n: F.transform("embedding", lambda x: F.when(n > 0, x / n).otherwise(x))).alias("embedding"))
    centres = np.array(ivf(unit, cells, seed)[1], np.float64)
    given = spark.sparkContext.broadcast(centres)  # cells x values: at most 10,000 rows
    slices = _sample(data, BOOK_ROWS).mapInArrow(_slices(given, parts, metric), "part int, values binary")
    rows = slices.groupBy("part").applyInArrow(_book(CODES, seed), "part int, words binary").collect()  # a code book a slice
    books = [np.frombuffer(r["words"], np.float64).reshape(-1, size // parts) for r in sorted(rows, key=lambda r: r["part"])]
    wide = max(len(b) for b in books)
    books = np.stack([np.concatenate((b, np.full((wide - len(b), size // parts), np.inf))) if len(b) < wide else b for b in books])
    books = np.where(np.isfinite(books), books, 1e150)  # words that nothing is near
    fitted = spark.sparkContext.broadcast((centres, books))
    lists = data.mapInArrow(_encode(fitted, metric), StructType([StructField("vec_id", LongType()), StructField("cell", IntegerType()), StructField("codes", BinaryType())]))
    lists = cut(lists.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell"), "lists")
    asked = _sample(data, PROBE_QUERIES)
    near = knn(asked, data, NEIGHBOURS + 1, "cosine" if metric == "cosine" else metric).where("query_id <> vec_id")
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    needed = near.select("query_id", "vec_id").join(data, "vec_id").join(q, "query_id").select("q", "embedding").mapInArrow(_needed(given, metric), "needed int")
    probes = needed.agg(F.percentile("needed", recall)).first()[0]
    return Index(lists, centres, books, metric, min(cells, max(recommended(count)["probes"], int(np.ceil(probes or 1)))))


def _shelves(counts: dict[int, int], cells: int) -> tuple[np.ndarray, list[int]]:
    """The shelf of each list (-1: it is empty), and in how many parts a shelf is. Lists lie side by side while they fit; only one that fits no shelf is parted."""
    most = max(1, min(SHELF_ROWS, -(-sum(counts.values()) // SHELVES)))
    shelf, full = np.full(cells, -1, np.int32), []
    for cell, n in sorted(counts.items()):
        if not full or full[-1] + n > most:
            full.append(0)
        full[-1] += n
        shelf[cell] = len(full) - 1
    return shelf, [-(-n // most) for n in full]


def _open(given, probes: int, metric: str):
    """Queries in -> a row for each shelf with lists that they open: these, and the inner products with their centres."""

    def run(batches):
        c, shelf, split = given.value
        for whole in batches:
            for batch in _parts(whole, max(len(c), min(probes, len(split)) * c.shape[1])):
                q = _rows(batch.column("embedding"), metric)
                far = _distances(q, c)
                row, cell, _ = _top(-far, np.arange(len(c)), probes)
                order = np.lexsort((cell, shelf[cell], row))
                row, cell = row[order], cell[order]
                row, cell = row[shelf[cell] >= 0], cell[shelf[cell] >= 0]
                base = (q @ c.T)[row, cell] if metric != "l2" else np.zeros(len(row))
                first = np.flatnonzero(np.diff(row * len(split) + shelf[cell], prepend=-1))
                ends = pa.array(np.append(first, len(row)).astype(np.int32))
                row, place = row[first], shelf[cell[first]]
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * c.shape[1]), pa.array(q[row].ravel()))
                lists = pa.ListArray.from_arrays(ends, pa.array(cell.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(base))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(row)), values, *lists, pa.array(place), pa.array(split[place])], ["query_id", "q", "cells", "base", "shelf", "vs"])

    return run


def _better(old, score: np.ndarray, keys: np.ndarray, keep: int, last: bool):
    """Row, key and score of the `keep` best of each row, of those before and of a matrix; the score that a next one has to reach.
    Ties by key; minus infinity stands for what is not compared. Up to twice as many are kept until the last."""
    row, key, value, least = old
    if score.shape[1] > keep and (least == LOWEST).any():
        least = np.maximum(least, np.partition(score, score.shape[1] - keep, axis=1)[:, score.shape[1] - keep])
    r, at = np.divmod(np.flatnonzero(score >= least[:, None]), score.shape[1])
    row, key, value = np.concatenate((row, r)), np.concatenate((key, keys[at])), np.concatenate((value, score[r, at]))
    if last or len(row) > 2 * keep * len(least):
        order = np.lexsort((key, -value, row))
        row, key, value = row[order], key[order], value[order]
        good = np.arange(len(row)) - np.searchsorted(row, row) < keep
        row, key, value = row[good], key[good], value[good]
        n = np.bincount(row, minlength=len(least))
        least = np.where(n == keep, np.append(value, 0)[np.cumsum(n) - 1], least)
    return row, key, value, least


def _scan(fitted, metric: str, keep: int):
    """Some queries and the codes of a shelf -> the best candidates of each query, by table look-up; a tile of queries and of codes at a time."""

    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, some: pa.Table) -> pa.Table:
        centres, books = fitted.value
        parts, _, d = books.shape
        out = []
        if asked.num_rows and some.num_rows:
            cell = some["cell"].to_numpy()
            order = np.argsort(cell, kind="stable")
            cell, keys = cell[order], some["vec_id"].to_numpy()[order]
            codes = np.frombuffer(b"".join(some["codes"].to_pylist()), np.uint8).reshape(some.num_rows, -1)[order].T.astype(np.intp)
            here, starts = np.unique(cell, return_index=True)
            ends = np.append(starts[1:], len(cell))
            step = max(1, SCORES // TILE)
            for i in range(0, asked.num_rows, TILE):
                rows = asked.slice(i, TILE).combine_chunks()
                ids, lists = rows["query_id"].to_numpy(), rows["cells"].combine_chunks()
                q = rows["q"].combine_chunks().flatten().to_numpy().reshape(len(ids), parts, d)
                opened, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
                place = np.minimum(np.searchsorted(here, opened), len(here) - 1)
                base = np.full((len(ids), len(here)), -np.inf)
                found = here[place] == opened
                base[row[found], place[found]] = rows["base"].combine_chunks().flatten().to_numpy()[found]
                if metric != "l2":
                    words = np.stack([books[p] @ q[:, p].T for p in range(parts)])
                best = np.zeros(0, np.int64), keys[:0], np.zeros(0), np.full(len(ids), LOWEST)
                for a in range(0, len(keys), step):
                    score = np.full((len(ids), min(step, len(keys) - a)), -np.inf)
                    for j in range(np.searchsorted(ends, a, "right"), np.searchsorted(starts, a + step)):
                        asks = np.flatnonzero(base[:, j] > -np.inf)
                        at = slice(max(a, starts[j]), min(a + step, ends[j]))
                        if metric == "l2":
                            apart = q[asks] - centres[here[j]].reshape(parts, d)
                            total = np.zeros((at.stop - at.start, len(asks)))
                            for p in range(parts):
                                total += -_distances(apart[:, p], books[p]).T[codes[p, at]]
                        elif 4 * len(asks) < len(ids):
                            total = np.repeat(base[None, asks, j], at.stop - at.start, 0)
                            for p in range(parts):
                                total += words[p][codes[p, at, None], asks]
                        else:  # for all: what a query has not opened stays at minus infinity
                            asks = slice(None)
                            total = np.repeat(base[None, :, j], at.stop - at.start, 0)
                            for p in range(parts):
                                total += words[p].take(codes[p, at], 0)
                        score[asks, at.start - a : at.stop - a] = total.T
                    best = _better(best, score, keys[a : a + step], keep, a + step >= len(keys))
                out.append(pa.table({"query_id": ids[best[0]], "vec_id": best[1], "score": best[2]}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    return run


def _exact(metric: str):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                q, v = _rows(batch.column("q"), metric), _rows(batch.column("embedding"), metric)
                value = (q * v).sum(1) if metric != "l2" else -((q - v) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(value)], ["query_id", "vec_id", "score"])

    return run


def search(queries: DataFrame, index: Index, vectors: DataFrame, k: int = 10, probes: int | None = None, short: int = SHORT_LIST) -> DataFrame:
    """Approximate neighbours: query_id, vec_id, score (exact), rank. The lists that a query opens give up to k * short
    candidates, which are compared with it in full. A query goes once to each shelf with lists that it opens, and takes up to
    k * short codes from it; a shelf meets ASKED_ROWS queries or so in a task, and a list of very many codes is parted."""
    spark = queries.sparkSession
    asked = queries.select("vec_id", "embedding").where("embedding is not null")
    counts = {r["cell"]: r["count"] for r in index.lists.groupBy("cell").count().collect()}  # a row a cell
    shelf, split = _shelves(counts, len(index.centres))
    given, fitted = spark.sparkContext.broadcast((index.centres, shelf, np.array(split, np.int32))), spark.sparkContext.broadcast((index.centres, index.books))
    opened = asked.mapInArrow(_open(given, probes or index.probes, index.metric), "query_id long, q array<double>, cells array<int>, base array<double>, shelf int, vs int")
    qs = max(1, -(-asked.count() // ASKED_ROWS))
    cells = np.array(list(counts), np.int32)
    places = F.broadcast(spark.createDataFrame(pa.table({"cell": cells, "shelf": shelf[cells], "vs": np.array(split, np.int32)[shelf[cells]]})))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    grid = ["shelf", "x", "y"]
    lists = index.lists.join(places, "cell").select("vec_id", "codes", "cell", "shelf", F.pmod(F.xxhash64("vec_id"), "vs").cast("int").alias("x"), every(F.lit(qs)).alias("y"))
    opened = opened.select("query_id", "q", "cells", "base", "shelf", F.pmod(F.xxhash64("query_id"), F.lit(qs)).cast("int").alias("y"), every(F.col("vs")).alias("x"))
    tasks = min(sum(split) * qs, TASKS)  # stated, as partitions would be joined by their bytes, which are few for what they take
    opened, lists = opened.repartition(tasks, *grid), lists.repartition(tasks, *grid)
    found = opened.groupBy(*grid).cogroup(lists.groupBy(*grid)).applyInArrow(_scan(fitted, index.metric, k * short), "query_id long, vec_id long, score double")
    candidates = _best(found, k * short).select("query_id", "vec_id")
    full = candidates.join(vectors.select("vec_id", "embedding"), "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    return _best(full.mapInArrow(_exact(index.metric), "query_id long, vec_id long, score double"), k)
