import dataclasses
import math
import os
import random
import re
import shutil
import sys
import tempfile
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyarrow import fs

from folio.llm import kneser_ney as kn


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]  # None: the end


class Brute:
    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.uni.update(w)
            self.bi.update(zip(["<s>", *w], w, strict=False))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.ends, self.starts, self.total = Counter(), defaultdict(Counter), Counter()
        for (a, b), c in self.bi.items():
            self.ends[b] += 1
            self.starts[a][min(c, 3)] += 1
            self.total[a] += c
        times = lambda x: [sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]
        self.d, self.dl = kn.discounts(times(self.bi)), kn.discounts(times(self.ends))
        self.rest = sum(self.dl[min(c, 3)] for c in self.ends.values()) / len(self.bi) if self.bi else 1.0

    def lower(self, b):
        c = self.ends[b]
        return ((c - self.dl[min(c, 3)]) / len(self.bi) if self.bi else 0) + self.rest / (self.v + 1)

    def p(self, a, b):
        if not self.total[a]:
            return self.lower(b)
        c = self.bi[a, b]
        return (c - self.d[min(c, 3)] + sum(self.d[k] * n for k, n in self.starts[a].items()) * self.lower(b)) / self.total[a]

    def score(self, text):
        w = tokens(text)
        base = sum(math.log10((self.uni[x] + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in w)
        return len(w), sum(x in self.uni for x in w), base, sum(math.log10(self.p(a, b)) for a, b in zip(["<s>", *w], w, strict=False))


def test_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kn, "FLUSH", 500)
    monkeypatch.setattr(kn, "CHUNK", 2000)
    r = random.Random(4)
    make = lambda: " ".join(r.choices([f"W{int(r.paretovariate(0.7)) % 400}" for _ in range(30)], k=r.randrange(40)))
    learn, ask = [*(make() for _ in range(200)), None, ""], [*(make() for _ in range(50)), "never seen words w1", None]
    brute = Brute(learn)
    model = kn.train(spark.createDataFrame(list(enumerate(learn)), "doc_id long, text string"), f"file://{tmp_path}/m", 2)
    assert (model.words, model.tokens, model.pairs) == (brute.v, brute.n, len(brute.bi))
    assert np.allclose((model.discount, model.lower), (brute.d, brute.dl))
    for x in kn.score(spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string"), model).collect():
        assert (x.n_tokens, x.n_known, x.base_score, x.score) == pytest.approx(brute.score(ask[x.doc_id]))
    for a in ["w1", "w7", "<s>", "never"]:  # probabilities, with one unknown word, sum to 1
        assert sum(brute.p(a, b) for b in [*brute.uni, "never seen"]) == pytest.approx(1)


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    brute = Brute([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1])
    rows = kn.op9_kneser_ney(spark, sf, 2).collect()
    assert len(rows) == len(texts) and {x.train_tokens for x in rows} == {brute.n}
    for x in rows:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 1)
        if x.doc_id % 20 == 0:
            assert (x.n_tokens, x.n_known, x.base_score, x.score) == pytest.approx(brute.score(texts[x.doc_id]))
    held = [x for x in rows if x.held_out]
    print("held out: base", sum(x.base_score for x in held), "model", sum(x.score for x in held))
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
    longer = [x for x in kn.op9_kneser_ney(spark, sf).collect() if x.held_out]  # two words of context tell more than one
    assert sum(x.score for x in longer) > sum(x.score for x in held)
    assert sum(x.base_score for x in longer) == pytest.approx(sum(x.base_score for x in held))


def test_counts(tmp_path):
    """Small and great counts, read whole and by place."""
    r = np.random.default_rng(1)
    values = r.choice([0, 1, 2, 254, 255, 256, 70000, 1 << 40], (500, 3))
    kn._write_counts(f"file://{tmp_path}", "a", values)
    assert (kn._counts(f"file://{tmp_path}", "a", 3) == values).all()
    rows = r.integers(0, 500, 200)
    assert (kn._counts(f"file://{tmp_path}", "a", 3, rows) == values[rows]).all()


def test_odd(spark, odd_docs, no_docs, tmp_path):
    model = kn.train(odd_docs, f"file://{tmp_path}/a", 2)
    brute = Brute([x.text for x in odd_docs.select("text").collect()])
    got = sorted((x.n_tokens, x.n_known, x.base_score, x.score) for x in kn.score(odd_docs, model).collect())
    assert np.allclose(got, sorted(brute.score(x.text) for x in odd_docs.select("text").collect()))
    nothing = kn.train(no_docs, f"file://{tmp_path}/b")
    assert {(x.base_score, x.score) for x in kn.score(odd_docs, nothing).collect() if x.n_tokens == 1} == {(0.0, 0.0)}
    assert kn.score(no_docs, model).count() == 0


def test_other_store(spark, tmp_path, monkeypatch):
    """A worker that lives through all stages, and a folder that is no local path."""
    learn = ["a b a c", "b a b", "c a b d"]
    model = kn.train(spark.createDataFrame(list(enumerate(learn)), "doc_id long, text string"), f"file://{tmp_path}/m", 2)
    (tmp_path / "far").mkdir()
    far = fs.SubTreeFileSystem(str(tmp_path / "far"), fs.LocalFileSystem())
    monkeypatch.setattr(kn, "fs", SimpleNamespace(FileSystem=SimpleNamespace(from_uri=lambda uri: (far, "")), LocalFileSystem=fs.LocalFileSystem, copy_files=fs.copy_files))
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path / "own"))
    (tmp_path / "own").mkdir()
    model = dataclasses.replace(model, path="far://store/m")
    hashes, first = kn._tokens(next(kn.chunks(pa.array(["a b d", "x c"]))))

    def put(*starts):
        for file in (tmp_path / "m").iterdir():
            if file.name.startswith(starts):
                shutil.copy(file, tmp_path / "far")

    put("words", "counts")
    assert (model.ids(hashes) >= 0).sum() == 6  # pairs are counted while there are words only
    with pytest.raises(FileNotFoundError):
        kn.log_probabilities(model, hashes, first)
    put("")
    brute = Brute(learn)
    p, base, known = kn.log_probabilities(model, hashes, first)
    got = [(int(b - a), int(known[a:b].sum()), base[a:b].sum(), p[a:b].sum()) for a, b in zip(first, first[1:], strict=False)]
    assert np.allclose(got, [brute.score("a b d"), brute.score("x c")])
    assert not list((tmp_path / "own").iterdir())


@pytest.mark.parametrize("order", [2, 3, 4])
def test_order(spark, tmp_path, order):
    r = random.Random(6)
    make = lambda: " ".join(r.choices([f"w{int(r.paretovariate(0.9)) % 30}" for _ in range(20)], k=r.randrange(30)))
    learn, ask = [*(make() for _ in range(150)), None, ""], [*(make() for _ in range(30)), "never seen words w1 w2 w1", None]
    pad = ("<s>",) * (order - 1)
    value = {order: Counter(tuple(x[i : i + order]) for t in learn for x in [[*pad, *tokens(t)]] for i in range(len(x) - order + 1))}
    for k in range(order - 1, 0, -1):
        value[k] = Counter(g[1:] for g in value[k + 1])
    d = {k: kn.discounts([sum(c == j for c in v.values()) for j in (1, 2, 3, 4)]) for k, v in value.items()}
    after = {k: defaultdict(list) for k in value}
    for k, v in value.items():
        for g, c in v.items():
            after[k][g[:-1]].append(c)

    def p(k, g):
        rest, total = after[k][g[:-1]], sum(after[k][g[:-1]])
        if not total:
            return p(k - 1, g[1:])
        c = value[k][g]
        return (c - d[k][min(c, 3)] + sum(d[k][min(x, 3)] for x in rest) * (p(k - 1, g[1:]) if k > 1 else 1 / (len(value[1]) + 1))) / total

    model = kn.train(spark.createDataFrame(list(enumerate(learn)), "doc_id long, text string"), f"file://{tmp_path}/m", order)
    for x in kn.score(spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string"), model).collect():
        w = [*pad, *tokens(ask[x.doc_id])]
        assert x.score == pytest.approx(sum(math.log10(p(order, tuple(w[i : i + order]))) for i in range(len(w) - order + 1)))


def test_sums_past_32_bits(spark, tmp_path, monkeypatch):
    """Sums that a row of 32 bits can't hold go on in further rows; nothing is cut. Counts are patched to reach that."""
    keys, sums = np.array([3, 5, 9], np.uint64), np.array([[1, 0, 0, 2, 2**33], [0, 1, 0, 0, 7], [0, 0, 1, 1, 5 * 2**32 + 11]], np.int64)
    k, narrow = kn._narrow(keys, sums)
    assert narrow.dtype == np.uint32 and len(k) > 3
    assert all(narrow[k == key].sum(axis=0, dtype=np.int64).tolist() == row.tolist() for key, row in zip(keys, sums, strict=True))
    got, back = kn._merge(pa.Table.from_batches([kn._pack(k, narrow, np.zeros(len(k), np.int64))]), 5)
    assert got.tolist() == keys.tolist() and back.tolist() == sums.tolist()

    docs = spark.createDataFrame([(i, "a b a c a b") for i in range(3)], "doc_id long, text string")
    model = kn.train(docs, f"file://{tmp_path}/m", 2)
    real = kn._counts
    monkeypatch.setattr(kn, "_counts", lambda path, name, *a: real(path, name, *a) * (2**32 if name.startswith("gram_counts") else 1))
    rows = pa.Table.from_batches(list(kn._sums(model, 2)(iter([pa.record_batch([pa.array(range(len(model.places(2)) - 1))], ["id"])]))))
    rows = rows.filter(pc.not_equal(rows["bucket"], -1))
    total = sum(int(kn._merge(rows.filter(pc.equal(rows["bucket"], b)), 5)[1][:, 4].sum()) for b in set(rows["bucket"].to_pylist()))
    assert total == 3 * 7 * 2**32  # 7 pairs a text, with its start and end


def test_order_by_bucket():
    """Stable, with numbers of 16 bits (sorted by radix) and with larger ones."""
    for top in (7, 1 << 16, 1 << 20):
        bucket = np.random.default_rng(1).integers(0, top, 5000)
        assert (kn._by_bucket(bucket) == np.argsort(bucket, kind="stable")).all()
    assert len(kn._by_bucket(np.zeros(0, np.int64))) == 0


def test_equal_runs_are_looked_up_once(spark, tmp_path):
    """What a word or a run has is read once for all places that have it."""
    docs = spark.createDataFrame([(i, "a b c a b d") for i in range(40)], "doc_id long, text string")
    model = kn.train(docs, f"file://{tmp_path}/once", 3)
    chunk = next(kn.chunks(pa.array(["a b c a b d x"] * 500), 1 << 20))
    hashes, first = kn._tokens(chunk)
    ids, back = model.find_once(1, hashes)
    assert len(ids) == 6 and (ids[back] == model.ids(hashes)).all()  # a, b, c, d, x, the end
    score, base, known = kn.log_probabilities(model, hashes, first)
    assert (score.reshape(500, -1) == score[:8]).all() and known.reshape(500, -1)[0].tolist() == [True] * 6 + [False, True]


def test_sums_of_a_group_are_added_blob_by_blob(tmp_path):
    """Tasks have rows of sums for the same words again and again: 4 million here, 112 MB, which were merged at once."""
    n, blobs = 20_000, 200
    model = kn.Model(f"file://{tmp_path}", (0, n), n, n, 3, ((0, n), (0, n)))
    keys, sums = np.arange(n, dtype=np.uint64), np.tile(np.array([1, 0, 2, 300, 5], np.uint32), (n, 1))
    blob = kn._pack(keys, sums, np.zeros(n, np.int64))
    tracemalloc.start()
    (got,) = kn._write_sums(model, 1)((pa.scalar(0),), (blob for _ in range(blobs)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [{"bucket": 0, "times": [0, 0, 0, 0, 300 * blobs * n]}]
    assert (kn._counts(model.path, "sums1-00000", 5) == sums[0].astype(int) * blobs).all()
    assert peak < 20e6


def test_sums_of_words_are_dealt_by_their_number():
    model = kn.Model("", tuple(range(1025)), 1024, 1, 3, ((0, 3 * 10**8),))
    assert [dataclasses.replace(model, grams=((0, n),)).shift(1) for n in (10, 10**7, 10**8, 3 * 10**8, 10**10)] == [4, 4, 2, 0, 0]


def test_mapped_files_stay_closed(tmp_path):
    for i in range(50):
        kn._write(f"file://{tmp_path}", f"x{i}", np.arange(i, dtype=np.uint64))
    before = len(os.listdir("/proc/self/fd"))
    assert all((kn._map(f"file://{tmp_path}", f"x{i}", "u8") == np.arange(i)).all() for i in range(50))
    assert len(os.listdir("/proc/self/fd")) <= before + 2 or sys.version_info < (3, 13)
