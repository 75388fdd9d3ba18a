"""Similarities of all pairs of a group as products of blocks of rows.

Vectors of a group are dealt to blocks of a bounded number of rows; a tile is a pair of blocks, multiplied as matrices in one
task. A tile gives out what is asked for, never a row a pair: pairs past a threshold, its best pairs, or rows of the matrix.
For the best pairs of all, the tiles of blocks with themselves come first and set a bound, and only tiles that can beat it
(by the norms, or by the angles between blocks) are multiplied at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from folio.operators.vectors import norm
from folio.sources.shared import cut

#: Rows on a side of a tile.
BLOCK_ROWS = 2_000
#: What a bound may be off by rounding.
SLACK = 1e-9


def scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Similarities of rows of two matrices, as vectors.similarity() defines them for two columns."""
    if metric == "dot":
        return a @ b.T
    if metric == "euclidean":
        return 1 / (1 + np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :], 0)))
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    if metric == "unit":
        return np.clip((a @ b.T / ((na + 1e-10)[:, None] * (nb + 1e-10)[None, :]) + 1) / 2, 0, 1)
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric}")
    both = na[:, None] * nb[None, :]
    return np.divide(a @ b.T, both, out=np.zeros(both.shape), where=both > 0)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table["v"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return table["id"].to_numpy(), flat.reshape(len(table), -1)


def blocked(vectors: DataFrame, by: Sequence[str] = (), key: str = "vec_id", column: str = "embedding", rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows with a vector: the group's columns, id, v, n (blocks of the group), block."""
    some = vectors.where(F.col(column).isNotNull()).select(*by, F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v"))
    n = F.ceil(F.count("*") / rows).cast("int").alias("n")
    some = some.join(some.groupBy(*by).agg(n), [*by]) if by else some.crossJoin(F.broadcast(some.agg(n)))  # one row
    return some.withColumn("block", F.pmod(F.xxhash64("id"), "n").cast("int"))


def _every(last: Column | str, first: Column | int = 0) -> Column:
    first = F.lit(first) if isinstance(first, int) else first
    return F.explode(F.sequence(first, F.col(last) if isinstance(last, str) else last))


def _grid(rows: DataFrame, by: Sequence[str], tiles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of each tile (x <= y): rows of block x and rows of block y. `tiles` (group, x, y) names the ones wanted."""
    if tiles is None:
        return rows.select(*by, "id", "v", F.col("block").alias("x"), _every(F.col("n") - 1, F.col("block")).alias("y")), rows.select(*by, "id", "v", _every("block").alias("x"), F.col("block").alias("y"))
    side = lambda c: rows.withColumnRenamed("block", c).join(tiles, [*by, c]).select(*by, "id", "v", "x", "y")
    return side("x"), side("y")


def _products(left: DataFrame, right: DataFrame, by: Sequence[str], use: Callable, fields: list[StructField], metric: str) -> DataFrame:
    """use(ids, ids, scores, one block with itself) -> columns, of each tile, beside the group's columns."""
    keys = [left.schema[c] for c in by]
    names = [f.name for f in fields]

    def run(key: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        got = []
        if a.num_rows and b.num_rows:
            (i, u), (j, v) = _matrix(a), _matrix(b)
            got = use(i, j, scores(u, v, metric), key[-1].as_py() == key[-2].as_py())
        n = len(got[0]) if got else 0
        heads = {f.name: pa.repeat(k, n) for f, k in zip(keys, key, strict=False)}
        return pa.table(heads | dict(zip(names, got or [pa.array([], _ARROW[f.dataType.simpleString()]) for f in fields], strict=True)))

    schema = StructType([*keys, *fields])
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # both sides may come from one table
    return left.groupBy(*by, "x", "y").cogroup(right.groupBy(*by, "x", "y")).applyInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
_PAIR = [StructField("text1", LongType()), StructField("text2", LongType()), StructField("score", DoubleType())]


def _pairs(i, j, s, same, keep) -> list:
    """Pairs (smaller id first) that `keep` takes from the matrix; of a block with itself each once."""
    ok = keep(s) & (i[:, None] < j[None, :] if same else i[:, None] != j[None, :])
    a, b = np.nonzero(ok)
    return [np.minimum(i[a], j[b]), np.maximum(i[a], j[b]), s[a, b]]


def _best(k: int, least: bool, bound: float | None = None):
    def use(i, j, s, same):
        s = -s if least else s
        keep = (lambda s: s >= bound) if bound is not None else (lambda s: np.ones(s.shape, bool))
        a, b, v = _pairs(i, j, s, same, keep)
        if len(v) > k:
            top = np.flatnonzero(v >= np.partition(v, len(v) - k)[len(v) - k])  # ties too
            top = top[np.lexsort((b[top], a[top], -v[top]))[:k]]
            a, b, v = a[top], b[top], v[top]
        return [a, b, -v if least else v]

    return use


def pairs_over(vectors: DataFrame, threshold: float, metric: str = "cosine", by: Sequence[str] = (), key: str = "vec_id", column: str = "embedding", rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of a group (`by`; null groups have none) with a similarity of `threshold` or more: the group's columns, text1 < text2,
    score. Rows without a vector are left out; rows that repeat an id are no pair of each other."""
    left, right = _grid(blocked(vectors, by, key, column, rows), by)
    return _products(left, right, by, lambda i, j, s, same: _pairs(i, j, s, same, lambda s: s >= threshold), _PAIR, metric)


def _summary(metric: str, by: Sequence[str]):
    """Of a block: its greatest norm, the direction of its mean, and the greatest angle of a row to that."""

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        _, v = _matrix(part)
        n = np.linalg.norm(v, axis=1)
        u = np.divide(v, n[:, None], out=np.zeros_like(v), where=n[:, None] > 0)
        m = u.mean(0)
        m = m / np.linalg.norm(m) if np.linalg.norm(m) > 0 else m
        angle = np.arccos(np.clip(u @ m, -1, 1)).max()
        heads = {c: pa.repeat(k, 1) for c, k in zip([*by, "block"], key, strict=True)}
        return pa.table(heads | {"norm": [n.max()], "mean": pa.array([m.tolist()], pa.list_(pa.float64())), "angle": [angle]})

    return run


def top_pairs(vectors: DataFrame, k: int = 5, metric: str = "unit", least: bool = False, by: Sequence[str] = (), key: str = "vec_id", column: str = "embedding", rows: int = BLOCK_ROWS) -> DataFrame:
    """The k most (or least) similar pairs of all groups together; ties by text1, text2."""
    by = list(by)
    data = cut(blocked(vectors, by, key, column, rows), "blocked")
    order = [F.col("score").asc() if least else F.col("score").desc(), F.col("text1"), F.col("text2")]
    itself = data.select(*by, "id", "v", F.col("block").alias("x"), F.col("block").alias("y"))
    first = cut(_products(itself, itself, by, _best(k, least), _PAIR, metric), "first")
    best = first.orderBy(*order).limit(k).select("score").collect()  # k numbers
    bound = None if len(best) < k else best[-1]["score"]
    about = StructType([*(data.schema[c] for c in by), StructField("block", IntegerType()), StructField("norm", DoubleType()), StructField("mean", ArrayType(DoubleType())), StructField("angle", DoubleType())])
    blocks = cut(data.select(*by, "id", "v", "block").groupBy(*by, "block").applyInArrow(_summary(metric, by), about), "blocks")
    named = lambda c: blocks.select(*by, F.col("block").alias(c), *(F.col(f).alias(f"{f}_{c}") for f in ("norm", "mean", "angle")))
    # a row a tile: blocks, not rows, meet each other here
    tiles = named("x").join(named("y"), by) if by else named("x").crossJoin(named("y"))
    tiles = tiles.where("x < y")
    if bound is not None and metric in ("unit", "cosine", "dot"):
        cosine = F.aggregate(F.zip_with("mean_x", "mean_y", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        apart, spread = F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))), F.col("angle_x") + F.col("angle_y")
        # rows without a direction have cosine 0, which these bounds don't hold for: their angle is a right one to anything
        reach = F.cos(F.greatest(apart - spread, F.lit(0.0))) if not least else -F.cos(F.least(apart + spread, F.lit(float(np.pi))))
        if metric == "dot":
            reach = F.col("norm_x") * F.col("norm_y")
        reach = (reach + (-1 if least else 1)) / 2 if metric == "unit" else reach
        tiles = tiles.where(reach >= (-bound if least else bound) - SLACK)
    left, right = _grid(data, by, tiles.select(*by, "x", "y"))
    rest = _products(left, right, by, _best(k, least, None if bound is None else (-bound if least else bound)), _PAIR, metric)
    return first.unionByName(rest).orderBy(*order).limit(k).select("text1", "text2", "score", *by)


def between(left: DataFrame, right: DataFrame, k: int = 10, metric: str = "unit", key: str = "vec_id", column: str = "embedding", rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of one table against those of another: the k most similar pairs (chunk1, chunk2, score); ties by the ids."""
    a, b = blocked(left, (), key, column, rows), blocked(right, (), key, column, rows)
    na, nb = (F.broadcast(x.agg(F.coalesce(F.max("n"), F.lit(0)).alias("other"))) for x in (a, b))  # one row each
    a = a.crossJoin(nb).where("other > 0").select("id", "v", F.col("block").alias("x"), _every(F.col("other") - 1).alias("y"))
    b = b.crossJoin(na).where("other > 0").select("id", "v", F.col("block").alias("y"), _every(F.col("other") - 1).alias("x"))

    def use(i, j, s, same):
        v = s.ravel()
        top = np.flatnonzero(v >= np.partition(v, len(v) - k)[len(v) - k]) if len(v) > k else np.arange(len(v))
        p, q = i[top // len(j)], j[top % len(j)]
        top = np.lexsort((q, p, -v[top]))[:k], top
        return [p[top[0]], q[top[0]], v[top[1]][top[0]]]

    found = _products(a, b, (), use, [StructField("chunk1", LongType()), StructField("chunk2", LongType()), StructField("score", DoubleType())], metric)
    return found.orderBy(F.desc("score"), "chunk1", "chunk2").limit(k)


def matrix(vectors: DataFrame, metric: str = "unit", by: Sequence[str] = (), key: str = "vec_id", column: str = "embedding", with_self: bool = True, rows: int = BLOCK_ROWS) -> DataFrame:
    """The whole similarity matrix of each group by rows of tiles: the group's columns, text, others (ids, ascending), scores. A
    text has a row for each block of its group."""

    def use(i, j, s, same):
        order = np.argsort(j, kind="stable")
        j, s = j[order], s[:, order]
        if with_self:
            keep = np.ones(s.shape, bool)
        else:
            keep = i[:, None] != j[None, :]
        off = np.concatenate(([0], np.cumsum(keep.sum(1)))).astype(np.int32)
        return [i, pa.ListArray.from_arrays(off, pa.array(np.broadcast_to(j, s.shape)[keep])), pa.ListArray.from_arrays(off, pa.array(s[keep]))]

    data = blocked(vectors, by, key, column, rows)
    left = data.select(*by, "id", "v", F.col("block").alias("x"), _every(F.col("n") - 1).alias("y"))
    right = data.select(*by, "id", "v", _every(F.col("n") - 1).alias("x"), F.col("block").alias("y"))
    return _products(left, right, by, use, [StructField("text", LongType()), StructField("others", ArrayType(LongType())), StructField("scores", ArrayType(DoubleType()))], metric)


def bins(vectors: DataFrame, bounds: Sequence[float], metric: str = "unit", by: Sequence[str] = (), key: str = "vec_id", column: str = "embedding", rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of a group, each once, by the ranges that ascending `bounds` cut scores into: the group's columns, pairs, sum, one (a score
    of the range). A tile gives a row for each range that it meets; a range may have several rows."""

    def use(i, j, s, same):
        v = s[i[:, None] < j[None, :] if same else i[:, None] != j[None, :]]
        at = np.searchsorted(bounds, v, "right")
        found = [x for x in (v[at == b] for b in range(len(bounds) + 1)) if len(x)]
        return [pa.array([len(x) for x in found], pa.int64()), pa.array([x.sum() for x in found], pa.float64()), pa.array([x[0] for x in found], pa.float64())]

    left, right = _grid(blocked(vectors, by, key, column, rows), by)
    return _products(left, right, by, use, [StructField("pairs", LongType()), StructField("sum", DoubleType()), StructField("one", DoubleType())], metric)


def average(vectors: DataFrame, by: Sequence[str] = (), key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The average `unit` similarity of all pairs of a group, over all groups, without forming a pair: the square of a group's sum of
    unit vectors holds each pair's cosine twice, and each row's own. No pairs: 0."""
    v = F.transform(column, lambda x: x.cast("double"))
    rows = vectors.where(F.col(column).isNotNull()).select(*by, v.alias("v")).withColumn("n", norm(F.col("v")) + 1e-10)
    unit = rows.select(*by, F.transform("v", lambda x: x / F.col("n")).alias("u"))
    for c in by:
        unit = unit.where(F.col(c).isNotNull())
    places = unit.select(*by, F.posexplode("u").alias("i", "x")).groupBy(*by, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    sums = places.groupBy(*by).agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("twice"))
    counts = unit.groupBy(*by).agg(F.count("*").alias("c"))
    both = sums.join(counts, [*by]) if by else sums.crossJoin(counts)
    cosines, n = F.sum("twice") / 2, F.sum(F.col("c") * (F.col("c") - 1) / 2)
    return both.agg(F.when(n > 0, (cosines / n + 1) / 2).otherwise(0.0).alias("average"))
