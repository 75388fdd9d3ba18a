import hashlib
import random
import re

import pytest

from folio.llm import substring_dedup as sd


def brute(rows, k):
    """rows: (doc_id or None, text)"""
    split = [(sd.LAST if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for j in range(len(w) - k + 1):
            x = tuple(w[j : j + k])
            least[x] = min(i, least.get(x, i))
    out = []
    for (i, w), (raw, _) in zip(split, rows, strict=True):
        drop = [False] * len(w)
        for j in range(len(w) - k + 1):
            if least[tuple(w[j : j + k])] < i:
                drop[j : j + k] = [True] * k
        kept = " ".join(x for x, d in zip(w, drop, strict=True) if not d)
        out.append((raw, len(w), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed=3):
    r, rows = random.Random(seed), []
    passages = [[f"p{r.randrange(50)}" for _ in range(r.randrange(20, 90))] for _ in range(6)] + [["be"] * 70]
    for i in range(90):
        w = []
        for _ in range(r.randrange(4)):
            w += [f"w{r.randrange(400)}" for _ in range(r.randrange(60))]
            p = list(r.choice(passages))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = "edit"
            w += p[r.randrange(10) :]
        rows.append((r.randrange(60), " ".join(w)))
    return rows


@pytest.mark.parametrize("pieces", [sd.SHARD_PIECES, 2])
@pytest.mark.parametrize("k", [20, 50])
def test_brute_force(spark, monkeypatch, pieces, k):
    monkeypatch.setattr(sd, "SHARD_PIECES", pieces)
    monkeypatch.setattr(sd, "BROADCAST_PIECES", 0 if k == 20 else sd.BROADCAST_PIECES)
    rows = made()
    got = sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k).drop("spans", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k)


def test_documents(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, sd.op1_substring_dedup(spark, sf).collect()), key=str) == brute(rows, 50)


def test_odd(spark, odd_docs, no_docs):
    rows = [(x.doc_id, x.text) for x in odd_docs.select("doc_id", "text").collect()]
    got = sd.substring_dedup(odd_docs).drop("spans", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 50)
    assert sd.substring_dedup(no_docs).count() == 0


def test_automaton():
    a = sd.SuffixAutomaton()
    a.add(list("abcbc"))
    a.add(list("bcd"))
    assert list(a.matches(list("xabcdbcbc"))) == [0, 1, 2, 3, 3, 1, 2, 3, 4]
