"""Whitening against plain numpy on exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from folio.llm import whitening as wh


def integers(rows):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in good]


def brute(rows, count=16):
    """By id: n, deviation; the eigenvalues; by id the whitened row (sign free)."""
    x = integers(rows)
    distinct = sorted({v for _, v in x})
    n, d = len(distinct), len(distinct[0])
    s = [sum(v[i] for v in distinct) for i in range(d)]
    centred = [[n * v[i] - s[i] for i in range(d)] for v in distinct]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:count]
    white = {i: np.array([float(Fraction(n * v[k] - s[k], n)) for k in range(d)]) @ vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-300)) for i, v in x}
    return n, {i: sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in x}, values[order], np.trace(cov), white


def test_planes():
    rng = np.random.default_rng(1)
    for rows in (1, 63, 64, 65, 300):
        x = rng.integers(0, 1 << 20, (rows, 5))
        x[:, 2] = 0
        sums, products = wh.scatter(x, 20)
        assert sums == x.sum(0).tolist()
        assert [[int(x[:, i] @ x[:, j]) for j in range(i, 5)] for i in range(5)] == products
    wide = rng.integers(0, 1 << 40, (100, 3))
    _, products = wh.scatter(wide, 40)  # past 64 bits
    assert products[0][1] == sum(a * b for a, b in zip(wide[:, 0].tolist(), wide[:, 1].tolist(), strict=True))


def test_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    n, deviation, values, trace, white = brute(rows)
    got = wh.op13_whitening(spark, sf).collect()
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n}
    assert all(r.deviation == deviation[r.vec_id] for r in got)
    assert all(abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-9 for r in got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    a = np.array([[0.0] * 16 for _ in rows])
    for r in got:
        a[r.vec_id, r.component - 1] = r.whitened
    b = np.array([white[i] for i in range(len(rows))])
    sign = np.sign((a * b).sum(0))
    assert np.abs(a * sign - b).max() < 1e-8


def test_repeats_count_once(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 3)).round(3).tolist()
    once = wh.whitened(spark.createDataFrame(list(enumerate(base)), "vec_id long, embedding array<float>")).collect()
    often = wh.whitened(spark.createDataFrame(list(enumerate([*base, *[base[0]] * 100])), "vec_id long, embedding array<float>")).collect()
    assert {r.n for r in often} == {r.n for r in once} and len(often) == 3 * 140
    first = {r.component: abs(r.whitened) for r in once if r.vec_id == 0}
    assert all(abs(abs(r.whitened) - first[r.component]) < 1e-9 for r in often if r.vec_id in (0, 40, 139))


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0], "a"), (2, None, "a"), (3, [None, 1.0], None), (4, [nan, 1.0], "b"), (5, [inf, 1.0], "b"), (None, [2.0, 3.0], "c"), (1, [0.5, 1.0], "d"), (6, [-1e6, 2.0], "e"), (7, [], "e"), (8, [1.0, 2.0, 3.0], "f")]
    df = spark.createDataFrame([(i, v, s, 1.0, 2) for i, v, s in rows], "vec_id long, embedding array<float>, x string, low double, size int")
    got = wh.whitened(df).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted([("1", 1), ("1", 2)] * 2 + [("None", 1), ("None", 2), ("6", 1), ("6", 2)] + [("8", k) for k in (1, 2, 3)])
    two = [r for r in got if r.vec_id != 8]
    n, deviation, *_ = brute([(i, v) for i, v, _ in rows if v is not None and len(v) == 2])
    assert {r.n for r in two} == {n} and all(r.deviation == deviation[r.vec_id] for r in two)
    alone = [r for r in got if r.vec_id == 8]  # a single vector has no variance
    assert all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained == 0 and r.identity_error == 0 for r in alone)
    assert wh.whitened(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="too great"):
        wh.whitened(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).collect()
