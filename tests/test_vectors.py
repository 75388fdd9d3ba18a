"""Blocks, ranges and the index against plain computations."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.operators import index, ranges, tiles, vectors
from folio.plans import records

METRICS = ["cosine", "unit", "dot", "euclidean"]


@pytest.fixture(scope="module")
def some(spark):
    """Two groups (one has two thirds of the rows), copies, a zero vector, a missing vector, a row without a group."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(90, 8)).round(3)
    v[7], v[8], v[50] = v[3], v[3], 0
    rows = [(i, int(i % 3 == 0), x.tolist()) for i, x in enumerate(v)] + [(90, 0, None), (91, None, v[1].tolist())]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").cache()


def plain(df, metric, by=True):
    rows = [r for r in df.collect() if r.embedding is not None]
    out = {}
    for a in rows:
        for b in rows:
            if a.vec_id < b.vec_id and (not by or (a.label is not None and a.label == b.label)):
                x, y = np.array(a.embedding), np.array(b.embedding)
                nx, ny = np.linalg.norm(x), np.linalg.norm(y)
                out[a.vec_id, b.vec_id] = {"cosine": x @ y / (nx * ny) if nx * ny else 0.0, "dot": x @ y, "euclidean": 1 / (1 + np.linalg.norm(x - y)), "unit": min(max((x @ y / ((nx + 1e-10) * (ny + 1e-10)) + 1) / 2, 0), 1)}[metric]
    return out


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("rows", [7, 2000])
def test_pairs(some, metric, rows):
    every = plain(some, metric)
    got = tiles.pairs_over(some, 0.3, metric, ["label"], rows=rows).collect()
    want = {p: s for p, s in every.items() if s >= 0.3}
    assert {(r.text1, r.text2) for r in got} == set(want) and len(got) == len(want) and all(abs(r.score - want[r.text1, r.text2]) < 1e-6 for r in got)
    for least in (False, True):
        got = tiles.top_pairs(some, 12, metric, least, ["label"], rows=rows).collect()
        order = sorted(((round(s if least else -s, 9), *p) for p, s in every.items()))[:12]
        assert [round(r.score if least else -r.score, 6) for r in got] == [round(x[0], 6) for x in order]
    whole = tiles.matrix(some, metric, ["label"], with_self=False, rows=rows).collect()
    cells = {(r.text, o): s for r in whole for o, s in zip(r.others, r.scores, strict=True)}
    assert len(cells) == 2 * len(every) and all(abs(cells[p] - s) < 1e-6 and abs(cells[p[::-1]] - s) < 1e-6 for p, s in every.items())


def test_bound(spark):
    """Tiles that can't hold a better pair are not multiplied: far clusters, whose best pairs lie within."""
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(4)[i % 4] * 50 + rng.normal(size=4) / 10).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(0))
    got = tiles.top_pairs(df, 5, "cosine", by=["label"], rows=20).collect()
    every = sorted(plain(df, "cosine").items(), key=lambda x: (-round(x[1], 12), x[0]))[:5]
    assert [round(r.score, 9) for r in got] == [round(s, 9) for _, s in every]
    assert tiles.top_pairs(df.limit(0), 5).collect() == [] and tiles.top_pairs(df.limit(1), 5).collect() == []


def test_sums(some):
    every = plain(some, "unit")
    assert abs(tiles.average(some, ["label"]).first().average - sum(every.values()) / len(every)) < 1e-9
    assert tiles.average(some.limit(0), ["label"]).first().average == 0.0
    both = plain(some, "cosine", by=False)
    got = tiles.between(some.where("label = 0"), some.where("label = 1"), 10, "cosine", rows=9).collect()
    label = {r.vec_id: r.label for r in some.collect()}
    want = sorted((-s for (a, b), s in both.items() if {label[a], label[b]} == {0, 1}))[:10]
    assert np.allclose([-r.score for r in got], want) and all(label[r.chunk1] == 0 and label[r.chunk2] == 1 for r in got)
    assert tiles.between(some.limit(0), some).collect() == []


def test_ranges(spark):
    """Neighbours, ranks and medians of a group that fills many ranges."""
    rows = [(0 if i < 2500 else i % 5, (i * 7919) % 10007, float((i * 31) % 997)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, v double").withColumn("part", F.lit("mine"))
    groups = {}
    for k, o, v in rows:
        groups.setdefault(k, []).append((o, v))
    got = ranges.with_next(df, "k", "o", {"after": "v"}, rows=100).collect()
    assert len(got) == 3000 and all(r.part == "mine" for r in got)
    for k, x in groups.items():
        x.sort()
        assert [r.after for r in sorted((r for r in got if r.k == k), key=lambda r: r.o)] == [v for _, v in x[1:]] + [None]
    placed = ranges.ranks(df, "k", ["v", "o"], "place", "n", rows=100)
    for k, x in groups.items():
        mine = sorted((r for r in placed.where(F.col("k") == k).collect()), key=lambda r: r.place)
        assert [(r.v, r.o) for r in mine] == sorted((v, o) for o, v in x) and [r.place for r in mine] == list(range(1, len(x) + 1)) and {r.n for r in mine} == {len(x)}
    assert {r.k: r.median for r in ranges.medians(df, "k", "v", rows=100).collect()} == {k: float(np.median([v for _, v in x])) for k, x in groups.items()}
    table = ranges.ranged(df, "k", ["o"], "__part", 100)
    assert table.groupBy("__part").count().agg(F.max("count")).first()[0] < 1000


def test_density_of_one_label(spark, monkeypatch):
    """One label that holds everything gives the same as plain Python, by ranges of a hundred rows."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1000, 6))
    df = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(v)], "label int, vec_id long, embedding array<double>")
    for name in ("ranks", "with_next"):
        monkeypatch.setattr(vectors, name, lambda *a, f=getattr(ranges, name): f(*a, rows=100))
    got = {r.vec_id: r for r in vectors.density(df, "label", "vec_id").collect()}
    scaled = v.var(1) / v.var(1).max()
    cos = [float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) for a, b in zip(v, v[1:], strict=False)]
    want = [(s + 1 - c) / 2 for s, c in zip(scaled, cos, strict=False)] + [scaled[-1]]
    assert np.allclose([got[i].density for i in range(1000)], want)
    assert {i for i in got if got[i].low} == set(np.argsort(want, kind="stable")[:200].tolist())


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_index(spark, metric):
    """Recall against exact search, in clusters and without; odd rows."""
    rng = np.random.default_rng(3)
    v = np.concatenate((rng.normal(size=(600, 16)), rng.normal(size=(6, 16))[rng.integers(0, 6, 600)] * 3 + rng.normal(size=(600, 16)) / 3))
    df = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(v)), (5000, None)], "vec_id long, embedding array<float>")
    made = index.build(df, 8, metric)
    q = df.where("vec_id % 20 = 0")
    near = {(r.query_id, r.vec_id) for r in vectors.knn(q, df, 10, metric).collect()}
    found = index.search(q, made, df).collect()
    assert len(near & {(r.query_id, r.vec_id) for r in found}) / len(near) >= 0.9 and made.lists.count() == 1200
    best = {(r.query_id, r.vec_id): r.score for r in vectors.knn(q, df, 10, metric).collect()}
    assert all(abs(r.score - best[r.query_id, r.vec_id]) < 1e-6 for r in found if (r.query_id, r.vec_id) in best)
    with pytest.raises(ValueError, match="divisible"):
        index.build(df, 5)
    with pytest.raises(ValueError, match="no vectors"):
        index.build(df.limit(0))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_recall(spark, sf):
    rows = records.pq_recall(spark, f"/root/testdata/sf{sf}").collect()
    assert sum(r.recall for r in rows) / len(rows) >= 0.9


def test_bins_give_few_rows(spark):
    """Counts of each range over tiles of a few rows, a row a range and tile."""
    v = np.random.default_rng(5).normal(size=(30, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = ((u @ u.T + 1) / 2)[np.triu_indices(30, 1)]
    rows = tiles.bins(df, [0.3, 0.7], rows=10).collect()
    at = lambda x: int(np.searchsorted([0.3, 0.7], x, "right"))
    got = [sum(r.pairs for r in rows if at(r.one) == b) for b in range(3)]
    assert got == np.bincount(np.searchsorted([0.3, 0.7], s, "right"), minlength=3).tolist() and len(rows) <= 18
    assert abs(sum(r["sum"] for r in rows) - s.sum()) < 1e-6


class Given:
    def __init__(self, value):
        self.value = value


def test_opened_lists_are_few_at_a_time():
    """A thousand queries that open 200 lists each: a query goes once to a shelf, and no batch holds a copy for each list."""
    rng = np.random.default_rng(6)
    centres, q = rng.normal(size=(256, 64)), rng.normal(size=(1000, 64))
    shelf, split = index._shelves({i: 100 for i in range(256) if i != 9}, 256)
    batch = pa.RecordBatch.from_pydict({"vec_id": np.arange(1000), "embedding": pa.array(list(q))})
    tracemalloc.start()
    out = [(b, b.nbytes) for b in index._open(Given((centres, shelf, np.array(split, np.int32))), 200, "dot")(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and max(n for _, n in out) < 20e6 and len(split) == 9 and set(split) == {1} and shelf[9] == -1
    near = ((q[:, None] - centres[None]) ** 2).sum(2).argsort(1)[:, :200]
    opened = {i: [] for i in range(1000)}
    for b, _ in out:
        for r in b.to_pylist():
            assert np.array_equal(r["q"], q[r["query_id"]]) and {shelf[c] for c in r["cells"]} == {r["shelf"]}
            assert np.allclose(r["base"], centres[r["cells"]] @ q[r["query_id"]])
            opened[r["query_id"]] += r["cells"]
    assert all(sorted(opened[i]) == sorted(set(near[i].tolist()) - {9}) for i in range(1000)) and sum(b.num_rows for b, _ in out) <= 9000


@pytest.mark.parametrize("metric", ["dot", "l2"])
@pytest.mark.parametrize("few", [False, True])
def test_scan_by_tiles(monkeypatch, metric, few):
    """Tiles of 8 queries and some codes give what a plain look-up gives; each query opens lists of its own, some that aren't there."""
    monkeypatch.setattr(index, "TILE", 8)
    monkeypatch.setattr(index, "SCORES", 8 * 37)
    rng = np.random.default_rng(7)
    centres, books = rng.normal(size=(30, 8)), rng.normal(size=(4, 16, 2))
    q, codes, cell = rng.normal(size=(50, 8)), rng.integers(0, 16, (400, 4)).astype(np.uint8), rng.integers(0, 25, 400).astype(np.int32)
    codes[200:260], cell[200:260] = codes[0], cell[0]  # copies: ties by id
    opens = [np.sort(rng.choice(30, 2 if few else 20, False)).astype(np.int32) for _ in q]
    base = [centres[c] @ x if metric == "dot" else np.zeros(len(c)) for x, c in zip(q, opens, strict=True)]
    asked = pa.table({"query_id": np.arange(50), "q": pa.array(list(q)), "cells": pa.array(opens), "base": pa.array(base)})
    some = pa.table({"vec_id": np.arange(400), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "cell": cell})
    got = index._scan(Given((centres, books)), metric, 12)((), asked, some).to_pylist()
    kept = centres[cell] + np.concatenate([books[p][codes[:, p]] for p in range(4)], 1)
    for i, x in enumerate(q):
        score = kept @ x if metric == "dot" else -((kept - x) ** 2).sum(1)
        want = sorted((-round(float(score[j]), 9), j) for j in range(400) if cell[j] in opens[i])[:12]
        assert [(r["vec_id"], round(r["score"], 9)) for r in got if r["query_id"] == i] == [(j, -s) for s, j in want]
    assert index._scan(Given((centres, books)), metric, 12)((), asked.slice(0, 0), some).num_rows == 0


def test_shelves(spark, monkeypatch):
    """Shelves of 30 codes and tasks of 7 queries find the same; a list of a hundred copies is parted."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 8)).round(3)
    v[100:200] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    made, q = index.build(df, 4), df.where("vec_id % 20 = 0")
    rows = lambda: sorted((r.query_id, r.vec_id, r["rank"], round(r.score, 9)) for r in index.search(q, made, df, 5).collect())
    whole = rows()
    monkeypatch.setattr(index, "SHELF_ROWS", 30)
    monkeypatch.setattr(index, "ASKED_ROWS", 7)
    split = index._shelves({r["cell"]: r["count"] for r in made.lists.groupBy("cell").count().collect()}, len(made.centres))[1]
    assert max(split) >= 4 and rows() == whole and len(whole) == 100


@pytest.mark.parametrize("rows", [1, 3000])
def test_batches_are_searched_in_parts(rows):
    """No matrix of scores is of a whole batch, in an exact search nor where cells are sought."""
    rng = np.random.default_rng(9)
    v, q = rng.normal(size=(rows, 4)), rng.normal(size=(1000, 4))
    batch = pa.RecordBatch.from_pydict({"vec_id": np.arange(rows), "embedding": pa.array(list(v))})
    seen = []
    scores = vectors._scores
    with pytest.MonkeyPatch.context() as m:
        m.setattr(vectors, "_scores", lambda a, b, metric: seen.append(len(a) * len(b)) or scores(a, b, metric))
        found = list(vectors._search(Given((np.arange(1000), q)), 3, "dot")(iter([batch])))
        cells = list(vectors._nearest(Given(q), 2, ["vec_id", "embedding", "cell"])(iter([batch])))
    assert max(seen) <= 1_000_000
    got = {}
    for b in found:
        for r in b.to_pylist():
            got.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["vec_id"]))
    exact = q @ v.T
    assert all(sorted(got[i]) == sorted((-round(float(s), 9), j) for j, s in enumerate(exact[i]))[:3] for i in range(1000))
    near = ((v[:, None] - q[None]) ** 2).sum(2).argsort(1)[:, :2]
    assert sorted((r["vec_id"], r["cell"]) for b in cells for r in b.to_pylist()) == sorted((i, int(c)) for i in range(rows) for c in near[i])
