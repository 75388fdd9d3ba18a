import hashlib

import numpy as np
import pyarrow as pa

from folio.llm import fingerprint as fp


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        h = len(t) // 2
        e = t[: len(t) - h] + rows[(k + 1) % len(rows)][1][:h]
        a, b, c = fp.sketches(pa.array([t, e, rows[(k + 1) % len(rows)][1]]))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.fingerprint(a), fp.fingerprint(b), fp.likeness(a, b), fp.likeness(a, c), fp.containment(a, b), fp.containment(a, c)))
    return sorted(out, key=str)


def test_sketch():
    r = np.random.default_rng(1)
    w = [f"w{i}" for i in r.integers(0, 10**6, 6000)]
    long, short = " ".join(w), " ".join(w[1000:1400])
    a, b = fp.sketches(pa.array([long, short]))
    assert abs(fp.containment(b, a) - 1) < 1e-9 and abs(fp.containment(a, b) - 400 / 6000) < 0.02
    assert abs(fp.likeness(*fp.sketches(pa.array([" ".join(w[:4000]), " ".join(w[2000:])]))) - 1 / 3) < 0.04
    assert fp.parse(fp.fingerprint(a))[2].tolist() == a[2].tolist()
    c = fp.sketches(pa.array([" ".join(w[:3004]), " ".join(w[3000:])]))
    assert fp.merge(*c).tolist() == a[2].tolist()
    x = fp.sketches(pa.array(["a b", "a  b", "c d", "", None]))
    assert fp.likeness(x[0], x[1]) == 1 and fp.likeness(x[0], x[2]) == 0 and fp.likeness(x[3], x[4]) == 1


def shingle_set(text, k=5):
    w = text.split(" ")
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_against_sets():
    """With every shingle kept, the estimates are those of plain Python sets; with a part kept, the same part everywhere."""
    r = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 12, n)) for n in (1, 3, 4, 5, 6, 40, 200, 2000)]
    texts += [" ".join(t.split(" ")[len(t.split(" ")) // 3 :]) for t in texts]
    exact, part = fp.sketches(pa.array(texts), 1.0), fp.sketches(pa.array(texts))
    for i, a in enumerate(map(shingle_set, texts)):
        assert exact[i][1] == part[i][1] == len(a) == len(exact[i][2])
        assert set(part[i][2]) <= set(exact[i][2]) and (len(a) < 500 or abs(len(part[i][2]) / len(a) - fp.FRACTION) < 0.1)
        for j, b in enumerate(map(shingle_set, texts)):
            assert abs(fp.likeness(exact[i], exact[j]) - len(a & b) / len(a | b)) < 1e-12
            assert abs(fp.containment(exact[i], exact[j]) - len(a & b) / len(a)) < 1e-12
            assert set(part[i][2]) & set(part[j][2]) == set(part[i][2]) & set(exact[j][2])


def test_documents(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, fp.op3_fingerprint(spark, sf).collect()), key=str) == brute(rows)


def test_ranges(spark, monkeypatch):
    """More ranges than shuffle partitions, and ids that are far from even."""
    monkeypatch.setattr(fp, "RANGE_ROWS", 7)
    r = np.random.default_rng(2)
    rows = [(int(i), f"text {i} " * int(1 + i % 5)) for i in np.unique(np.concatenate((r.integers(0, 50, 30), r.integers(-(10**12), 10**12, 90))))] + [(None, "x"), (None, None), (7, "a"), (7, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert fp.with_next(docs).select("bucket").distinct().count() > 10
    assert sorted(map(tuple, fp.edited_fingerprints(docs).collect()), key=str) == brute(rows)


def test_odd(spark, odd_docs, no_docs):
    rows = [(x.doc_id, x.text) for x in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, fp.edited_fingerprints(odd_docs).collect()), key=str) == brute(rows)
    one = spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")
    assert sorted(map(tuple, fp.edited_fingerprints(one).collect()), key=str) == brute([(5, "a b c d e f g")])
    assert fp.edited_fingerprints(no_docs).count() == 0
    assert fp.fingerprints(odd_docs).count() == len(rows)
