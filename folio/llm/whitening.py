"""Embedding whitening from exact cross-products, counted on bit planes.

Entries become integers. Each distinct vector is a row of the fit list once; of every dimension, the integers (less the
dimension's least) are cut into bit planes, and each plane is packed across rows into 64-bit words. The cross-product of two
dimensions is then the sum over their planes p, q of 2^(p+q) times the number of ones in the AND of both planes, exact whatever
the number of rows. Tasks hand on one number for each pair of dimensions; these are summed as decimals, centred as integers and
divided once, and only then meet a floating-point solver, of a matrix whose size is that of the vectors, not of the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import cut, table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Rows that are packed into planes at once.
BLOCK_ROWS = 1 << 13
#: An eigenvalue of less than this share of the greatest is taken for zero: what it spans has no variance.
ZERO = 1e-13
#: Entries from here on can't be held as integers of 64 bits.
LIMIT = 2.0**62 / SCALE
#: Different lengths of vectors in one table; each is fitted apart, by a matrix on the driver.
MOST_LENGTHS = 16


def _integers(batches):
    """vec_id, embedding in -> vec_id, x (integers of 8 bytes, little-endian) of the vectors that are whole and finite."""
    for batch in batches:
        column = batch.column("embedding")
        off = column.offsets.to_numpy()
        flat = column.values.slice(off[0], off[-1] - off[0])
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
        keep = (np.diff(bad[off - off[0]]) == 0) & ~np.asarray(column.is_null())
        if (np.abs(np.where(np.isfinite(values), values, 0)) >= LIMIT).any():
            raise ValueError("an entry of a vector is too great for 64-bit integers")
        with np.errstate(invalid="ignore"):
            x = (np.floor(SCALE * np.where(np.isfinite(values), values, 0)).astype("<i8") + OFFSET).tobytes()
        start = ((off - off[0]) * 8).tolist()
        rows = np.flatnonzero(keep).tolist()
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows, pa.int64())), pa.array([x[start[i] : start[i + 1]] for i in rows], pa.binary())], ["vec_id", "x"])


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, x: the integer vectors, as bytes, of all rows that can be whitened."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_integers, "vec_id long, x binary")


def _matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vector: which rows of a column of bytes these are, and their integers as a matrix."""
    off, data = column.buffers()[1:]
    off = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = np.diff(off) // 8
    out = {}
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        out[n] = rows, data[off[rows][:, None] + np.arange(8 * n)].view("<i8") if n else np.zeros((len(rows), 0), np.int64)
    return out


def _ranges(batches):
    """Least and greatest integer of each dimension, by length."""
    low, high = {}, {}
    for batch in batches:
        for n, (_, x) in _matrices(batch.column("x")).items():
            low[n] = np.minimum(low[n], x.min(0)) if n in low else x.min(0)
            high[n] = np.maximum(high[n], x.max(0)) if n in high else x.max(0)
    for n in low:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, n), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(low[n]), pa.array(high[n])], ["size", "i", "low", "high"])


def planes(x: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of a matrix of non-negative integers (rows, dimensions), packed across rows: (bits, dimensions, words). Rows
    are filled up with zeros, which no AND counts."""
    rows = np.zeros((-(-max(len(x), 1) // 64) * 64, x.shape[1]), np.uint64)
    rows[: len(x)] = x
    out = np.empty((bits, x.shape[1], len(rows) // 64), np.uint64)
    for p in range(bits):
        ones = (rows >> np.uint64(p)).astype(np.uint8) & 1
        out[p] = np.packbits(np.ascontiguousarray(ones.T), axis=1, bitorder="little").view(np.uint64)
    return out


def scatter(x: np.ndarray, bits: int) -> tuple[list[int], list[list[int]]]:
    """Exact sums of each dimension, and of products of each with itself and those after it, by AND and popcount of planes."""
    words = planes(x, bits)
    d = x.shape[1]
    ones = np.bitwise_count(words).sum(2, dtype=np.int64)  # bits, dimensions
    weight = [1 << p for p in range(bits)]
    sums = [sum(w * int(c) for w, c in zip(weight, ones[:, i], strict=True)) for i in range(d)]
    narrow = 2 * bits + len(x).bit_length() < 63  # weighted counts fit 64 bits
    products = []
    for i in range(d):
        row = np.zeros(d - i, np.int64 if narrow else object)
        for p in range(bits):
            if ones[p, i]:
                both = np.bitwise_count(words[:, i:] & words[p, i]).sum(2, dtype=np.int64)  # bits, dimensions from i on
                for q in range(bits):
                    row += both[q] * (1 << p + q) if narrow else both[q].astype(object) * (1 << p + q)
        products.append([int(v) for v in row])
    return sums, products


def _sums(low: dict[int, np.ndarray], bits: dict[int, int]):
    """One row for each pair of dimensions i <= j and task: sum of products; i = -1: sum of dimension j; j = -1: rows."""

    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for n, (_, x) in _matrices(batch.column("x")).items():
                for at in range(0, len(x), BLOCK_ROWS):
                    block = x[at : at + BLOCK_ROWS] - low[n]
                    sums, products = scatter(block, bits[n])
                    new = np.array([len(block), *sums, *(v for row in products for v in row)], object)
                    total[n] = total[n] + new if n in total else new
        for n, values in total.items():
            i, j = np.triu_indices(n)
            i, j = np.concatenate(([-1], np.full(n, -1), i)), np.concatenate(([-1], np.arange(n), j))
            for at in range(0, len(values), 1 << 16):
                part = slice(at, at + (1 << 16))
                text = pa.array([str(v) for v in values[part]], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(text), n), pa.int32()), pa.array(i[part], pa.int32()), pa.array(j[part], pa.int32()), text], ["size", "i", "j", "value"])

    return run


@dataclass
class Fit:
    """What the fit list gives: n vectors, sums of each dimension, eigenvalues and unit eigenvectors (columns), best first."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers projected on the components, over the roots of their eigenvalues; NaN where there is no variance."""
        mean = [Fraction(s, self.n) for s in self.sums]
        whole = np.array([m.numerator // m.denominator for m in mean], np.int64)
        rest = np.array([float(m - w) for m, w in zip(mean, whole.tolist(), strict=True)])
        with np.errstate(divide="ignore", invalid="ignore"):
            return ((x - whole).astype(np.float64) - rest) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Of each row, the exact sum over dimensions of (n x - S)^2."""
        base = [s // self.n for s in self.sums]
        rest = [s - b * self.n for s, b in zip(self.sums, base, strict=True)]
        near = x - np.array(base, np.int64)
        if len(x) == 0 or x.shape[1] == 0:
            return [0] * len(x)
        most = (int(np.abs(near).max()) + 1) * self.n
        if most * most * x.shape[1] < 1 << 63:
            return ((self.n * near - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        out = (near.astype(object) * self.n - np.array(rest, object)) ** 2
        out = [int(v) for v in out.sum(1)]
        if max(out) >= 1 << 63:
            raise OverflowError("a deviation is too great for a 64-bit integer")
        return out


def _solve(n: int, sums: list[int], low: list[int], products: dict[tuple[int, int], int], count: int) -> Fit:
    """Centres as integers: n^2 times the covariance of i and j is n * (sum of products) - (sum of i) * (sum of j)."""
    d = len(sums)
    cov = np.zeros((d, d))
    for (i, j), v in products.items():
        cov[i, j] = cov[j, i] = float(Fraction(n * v - sums[i] * sums[j], n * n))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:count]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    trace = float(np.trace(cov))
    explained = values / trace if trace > 0 else np.zeros(len(order))
    values = np.where(values > ZERO * max(values.max(initial=0), 0), values, 0)
    return Fit(n, [s + n * m for s, m in zip(sums, low, strict=True)], values, vectors, explained)


def _moments(fits: dict[int, Fit]):
    """Sums and products of whitened columns over the fit list, one row for each pair and task; j = -1: sums."""

    def run(batches):
        total = {}
        for batch in batches:
            for n, (_, x) in _matrices(batch.column("x")).items():
                w = np.nan_to_num(fits[n].whiten(x), nan=0.0, posinf=0.0, neginf=0.0)
                new = np.concatenate((w.sum(0)[:, None], w.T @ w), 1)
                total[n] = total[n] + new if n in total else new
        for n, values in total.items():
            k = len(values)
            i, j = np.divmod(np.arange(k * (k + 1)), k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), n), pa.int32()), pa.array(i, pa.int32()), pa.array(j - 1, pa.int32()), pa.array(values.ravel())], ["size", "i", "j", "value"])

    return run


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """`distinct` (x binary, each vector once) -> what whitens vectors, by their length."""
    distinct = distinct.where(F.length("x") > 0)
    bounds = distinct.mapInArrow(_ranges, "size int, i int, low long, high long").groupBy("size", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    if bounds.select("size").distinct().limit(MOST_LENGTHS + 1).count() > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    low, bits = {}, {}
    for r in bounds.orderBy("size", "i").collect():  # a row a dimension
        low.setdefault(r["size"], []).append(r["low"])
        bits[r["size"]] = max(bits.get(r["size"], 0), (r["high"] - r["low"]).bit_length())
    sums = distinct.mapInArrow(_sums({n: np.array(v, np.int64) for n, v in low.items()}, bits), "size int, i int, j int, value string")
    got: dict[int, dict] = {}
    for r in sums.groupBy("size", "i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v")).collect():  # a row a pair of dimensions
        got.setdefault(r["size"], {})[r["i"], r["j"]] = int(r["v"])
    fits = {}
    for n, values in got.items():
        count, linear = values.pop((-1, -1)), [values.pop((-1, j)) for j in range(n)]
        fits[n] = _solve(count, linear, low[n], values, min(components, n))
    if fits:
        squares: dict[int, dict] = {}
        for r in distinct.mapInArrow(_moments(fits), "size int, i int, j int, value double").groupBy("size", "i", "j").agg(F.sum("value").alias("v")).collect():
            squares.setdefault(r["size"], {})[r["i"], r["j"]] = r["v"]
        for n, values in squares.items():
            f = fits[n]
            there = np.flatnonzero(f.values > 0).tolist()
            cov = lambda i, j, v=values, m=f.n: v[i, j] / m - v[i, -1] / m * v[j, -1] / m
            f.identity_error = max((abs(cov(i, j) - (i == j)) for i in there for j in there), default=0.0)
    return fits


def _whitened(fits: dict[int, Fit]):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for batch in batches:
            for n, (rows, x) in _matrices(batch.column("x")).items():
                if not n:
                    continue
                f, k, m = fits[n], len(fits[n].values), len(rows)
                each = lambda a, k=k: pa.array(np.repeat(a, k))
                w = f.whiten(x).ravel()
                columns = [
                    batch.column("vec_id").take(pa.array(np.repeat(rows, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    each(np.full(m, f.n)),
                    each(np.array(f.deviations(x), np.int64)),
                    pa.array(w, mask=~np.isfinite(w)),
                    pa.array(np.tile(f.explained, m)),
                    each(np.full(m, f.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitens `vectors` (vec_id, embedding): for each vector and component (1 is that of the greatest variance), vec_id,
    component, n (distinct integer vectors), deviation (sum over dimensions of (n x - S)^2, exact), whitened, explained (share
    of the whole variance), identity_error (of the covariance of whitened values over the fit list, as measured).

    Rows whose vector is null or holds null or non-finite entries have no result. Repeated rows and ids, null ids too, have
    a result each, though a vector is fitted once, however often it occurs. Ties between eigenvalues: any basis of their space.
    A component without variance has explained 0 and whitened null. Vectors of another length are fitted apart (at most 16
    lengths); empty ones have no components, so no rows. Fewer dimensions than components: as many as there are. Empty
    table: empty result. Integers over 64 bits (entries from 2^56 on, deviations) raise an error. Other columns are not looked at.
    """
    rows = cut(integers(vectors), "integers")
    distinct = cut(rows.select("x").distinct(), "distinct")
    return rows.mapInArrow(_whitened(fit(distinct, components)), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
