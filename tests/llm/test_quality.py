import zlib

import numpy as np
import pyarrow as pa

from folio.llm import quality as q


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_trees():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = q.fit(x[:2000], y[:2000])
    assert auc(y[2000:], model.score(x[2000:])) > 0.97

    def walk(row):  # one node at a time
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.threshold[t, node])
            total += model.leaf[t, node - model.feature.shape[1]]
        return total

    assert np.allclose([walk(v) for v in x[:50]], model.raw(x[:50]))


def test_one_class():
    assert q.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (q.fit(np.zeros((9, 3)), np.ones(9)).score(np.zeros((2, 3))) > 0.9).all()


def test_blocks_few():
    few = lambda *texts: q.statistics(pa.array(texts))[:, q.NAMES.index("blocks_few")].tolist()
    words = [f"w{i}" for i in range(24)]
    plain, junk = " ".join(words), " ".join(words[:6] * 4)
    assert few(*(" ".join([plain] * n) for n in (1, 64, 65, 300))) == [0.0] * 4
    assert few(*(" ".join([junk] * n) for n in (1, 64, 65, 300))) == [1.0] * 4
    assert few(*(" ".join([plain, junk, plain, junk] * n) for n in (1, 16, 17, 75))) == [0.5] * 4

    def brute(text):
        w = text.split()
        blocks = [w[i : i + q.BLOCK] for i in range(0, len(w), q.BLOCK)]
        return sum(len(set(x)) / len(x) < 0.5 for x in blocks) / len(blocks)

    r = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in r.zipf(1.6, k) % 500) for k in (1, 23, 24, 25, 47, 1535, 1536, 1537, 1560, 5000)]
    assert np.allclose(few(*texts), [brute(x) for x in texts])


def test_sample(spark):
    """Bounded whatever repeats, and the same however rows are dealt."""
    docs = [(i % 40, f"text {i % 80} " * (1 + i % 7)) for i in range(2000)] + [(None, "no id"), (3, None)]
    labels = [(i % 60, i % 2) for i in range(600)] + [(5, 0), (5, 1), (None, 1), (6, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = [sorted(map(tuple, q.sample(docs.repartition(n), labels.repartition(n), 25).collect())) for n in (1, 7)]
    assert rows[0] == rows[1] and 10 < len(rows[0]) <= 25
    ids = {i for i in range(40) if zlib.crc32(str(i).encode()) % 5}
    whole = sorted(map(tuple, q.sample(docs, labels).collect()))
    assert {x[0] for x in whole} == ids and len(whole) == len(ids) + (5 in ids)
    want = {}
    for x in docs.collect():
        if x.doc_id is not None:
            s = q.statistics(pa.array([x.text], pa.string()))[0].tolist()
            want[x.doc_id] = min(want.get(x.doc_id, s), s)
    assert all(x[2] == want[x[0]] for x in whole)


def test_fit():
    """The first tree of two levels, split by split, against all thresholds tried one by one."""
    r = np.random.default_rng(4)
    x = r.integers(0, 12, (400, 3)).astype(float)
    y = ((x[:, 1] > 5) ^ (r.random(400) < 0.1)).astype(float)
    model = q.fit(x, y, trees=1, depth=2, bins=64, penalty=2.0, least=3.0)
    p = (y.sum() + 0.5) / (len(y) + 1)
    g, h = p - y, np.full(len(y), p * (1 - p))

    def best(rows):
        gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 2.0)
        out = (1e-6, None)
        for j in range(3):
            for t in np.unique(x[:, j])[:-1]:
                left, right = rows & (x[:, j] <= t), rows & (x[:, j] > t)
                if min(h[left].sum(), h[right].sum()) >= 3.0:
                    out = max(out, (gain(left) + gain(right) - gain(rows), (j, t)), key=lambda v: v[0])
        return out[1]

    def leaf(rows):
        return -0.15 * g[rows].sum() / (h[rows].sum() + 2.0)

    every = np.ones(len(y), bool)
    j, t = best(every)
    want = np.zeros(len(y))
    for side in (x[:, j] <= t, x[:, j] > t):
        split = best(side)
        for rows in [side] if split is None else [side & (x[:, split[0]] <= split[1]), side & (x[:, split[0]] > split[1])]:
            want[rows] = leaf(rows)
    assert j == 1 and np.allclose(model.raw(x), model.base + want)


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {x.doc_id: x for x in q.op2_quality(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for i, x in rows.items())
    labels = [x for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[x.doc_id].held_out]
    y, s = np.array([x.quality for x in labels]), np.array([rows[x.doc_id].score for x in labels])
    print("held out:", len(y), "auc", auc(y, s), "accuracy", ((s >= 0.3) == y).mean(), "good kept", (s[y == 1] >= 0.3).mean())
    assert auc(y, s) > 0.9


def test_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (7, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert q.quality_scores(odd_docs, labels).count() == odd_docs.count()
    kept = q.keep_good(odd_docs, labels.limit(0))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert q.quality_scores(no_docs, labels).count() == 0
