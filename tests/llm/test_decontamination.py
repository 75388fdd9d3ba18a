import hashlib
import random
import re

import duckdb
import numpy as np

from folio.llm import decontamination as dc


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    phrases = {}
    for item, text in items:
        w = split(text)
        size = min(k, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            phrases.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, got = split(text), set(), set()
        for size in {len(p) for p in phrases}:
            for i in range(len(w) - size + 1):
                p = tuple(w[i : i + size])
                if p in phrases:
                    hit.update(range(i, i + size))
                    got |= phrases[p]
        names = sorted(str(x) for x in got if x is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_index():
    r = np.random.default_rng(1)
    runs = [r.integers(1, 5, r.integers(1, 40)) for _ in range(60)] + [np.ones(30, int)] * 3
    text = np.concatenate([np.append(x, 0) for x in runs])
    index = dc.FMIndex(text, 5)
    phrases = r.integers(1, 5, (50, 3))
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high, strict=True):
        want = [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_brute_force(spark, monkeypatch):
    r = random.Random(7)
    items = [(i % 25, " ".join(f"w{r.randrange(60)}" for _ in range(r.choice([1, 4, 10, 12, 30])))) for i in range(30)] + [(30, None), (None, "nobody has an id for this one"), (31, "")]
    docs = []
    for i in range(80):
        w = []
        for _ in range(r.randrange(5)):
            w += [f"W{r.randrange(90)}" for _ in range(r.randrange(20))]
            t = (r.choice(items)[1] or "").split()
            w += t[r.randrange(3) :]
        docs.append((i, ", ".join(w)))
    for size in (dc.BLOCK_PAIRS, 20):  # one block of phrases, and several
        monkeypatch.setattr(dc, "BLOCK_PAIRS", size)
        found = dc.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert sorted(map(tuple, dc.report(found).collect()), key=str) == brute(docs, items)


def test_documents_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = dc.op8_decontamination(spark, sf)
    rows = sorted(map(tuple, got.collect()), key=str)
    docs, items = ([tuple(x) for x in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert rows == brute(docs, items) and any(x[-1] for x in rows)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({dc.SQL})").fetchall(), key=str) == rows


def test_clean(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before, A b c d e f g h-i j after", "en", 9), (2, "a b c d e f g h i j", "en", 9), (3, "", "en", 0), (4, None, "en", None), (5, "a b c d", "en", 7)], "doc_id long, text string, lang string, n_chars long")
    assert sorted(map(tuple, dc.clean(docs, bench).collect())) == [(1, "before,  after", "en", 14), (3, "", "en", 0), (4, None, "en", None), (5, "a b c d", "en", 7)]


def test_names_as_ids(spark):
    bench = spark.createDataFrame([("b-2", "a b c"), ("b-10", "b c d")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x a b c d")], "doc_id long, text string")
    row = dc.decontaminate(docs, bench).first()
    assert row["items"] == ["b-10", "b-2"] and [tuple(x) for x in row.spans] == [(1, 5)]


def test_odd(spark, odd_docs, no_docs):
    items = [(1, "one two three four five six seven eight nine ten one"), (2, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(x.doc_id, x.text) for x in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, dc.report(dc.decontaminate(odd_docs, bench)).collect()), key=str) == brute(docs, items)
    assert dc.clean(odd_docs, bench).columns == odd_docs.columns
    assert not any(x.contaminated for x in dc.report(dc.decontaminate(odd_docs, bench.limit(0))).collect())
    assert dc.decontaminate(no_docs, bench).count() == 0 and dc.clean(no_docs, bench).count() == 0


def test_packed_ranks():
    """Ranks and symbols from packed words, at every place and past the last."""
    rng = np.random.default_rng(6)
    for n in (0, 1, 63, 64, 65, 200):
        symbols = rng.integers(0, 11, n)
        tree = dc.WaveletTree(symbols, 4)
        assert tree.get(np.arange(n)).tolist() == symbols.tolist()
        for s in range(11):
            want = [int((symbols[:i] == s).sum()) for i in range(n + 1)]
            assert tree.rank(np.full(n + 1, s), np.arange(n + 1)).tolist() == want
