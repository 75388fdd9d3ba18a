import random
import re
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from folio.llm import packing as p
from folio.llm import token_file as tf


def brute(sizes, capacities):
    """Best fit by looking at every open bin, with each way to open one; the cheapest packing."""
    caps, longest = sorted(capacities), max(capacities)

    def fill(room, rest):
        got = 0
        for s in rest:  # descending
            if s <= room - got:
                got += s
        return got

    def contents(s, rest):
        price = {}
        for c in caps:
            if c >= s:
                n = s + fill(c - s, rest)
                price[c] = p.cost(min(x for x in caps if x >= n), longest) / n
        return min(price, key=lambda c: (price[c], -c))

    def run(choose):
        bins, out = [], []
        for i, s in enumerate(sizes):
            fit = [b[0] - b[1] for b in bins if b[0] - b[1] >= s]
            if fit:
                # among bins with as much room, the one that came to it last
                k = max((k for k, b in enumerate(bins) if b[0] - b[1] == min(fit)), key=lambda k: bins[k][2])
            else:
                bins.append([choose(s, sizes[i + 1 :]), 0, 0])
                k = len(bins) - 1
            out.append((k, bins[k][1]))
            bins[k][1] += s
            bins[k][2] = i
        final = [min(c for c in caps if c >= b[1]) for b in bins]
        return sum(p.cost(c, longest) for c in final), out, final, [b[0] for b in bins]

    return min((run(f) for f in (contents, lambda s, rest: min(c for c in caps if c >= s), lambda s, rest: longest)), key=lambda x: x[0])[1:]


def test_brute_force():
    r = random.Random(2)
    for _ in range(60):
        caps = r.choice([(16,), (8, 16, 32), (5, 7, 40), (256, 512, 1024, 2048)])
        sizes = sorted((r.randint(1, max(caps)) for _ in range(r.randrange(60))), reverse=True)
        bins, offset, final, opened = p.pack(sizes, caps)
        want, capacity, first = brute(sizes, caps)
        assert list(zip(bins.tolist(), offset.tolist(), strict=True)) == want and final.tolist() == capacity and opened.tolist() == first


def test_joint_sizes():
    """With the production lengths, bins are opened longer than their first segment needs, some are downsized, and the whole
    never costs more than always opening the shortest fitting length or the longest."""
    r, larger, smaller, won = random.Random(5), 0, 0, 0
    caps, longest = sorted(p.CAPACITIES), max(p.CAPACITIES)
    for k in range(12):
        draw = (lambda: r.randint(1, 300), lambda: min(longest, int(r.lognormvariate(5, 1)) + 1), lambda: r.choice((40, 90, 700, 1100)))[k % 3]
        sizes = sorted((draw() for _ in range(2048)), reverse=True)
        bins, _, final, opened = p.pack(sizes)
        first = {}
        for b, s in zip(bins.tolist(), sizes, strict=True):
            first.setdefault(b, s)
        larger += sum(opened[b] > next(c for c in caps if c >= s) for b, s in first.items())
        smaller += int((final < opened).sum())
        fixed = [p.total_cost(p._pack_by(sizes, caps, f)[2], longest) for f in (lambda s, left: next(c for c in caps if c >= s), lambda s, left: longest)]
        assert p.total_cost(final, longest) <= min(fixed)
        won += p.total_cost(final, longest) < min(fixed)
    print("opened larger", larger, "downsized", smaller, "cheaper than either rule", won, "of 12")
    assert larger > 100 and smaller > 0 and won >= 6


def check(rows, docs, capacities):
    """Whole: each document's segments cover it, bins hold what they say, capacities are the least."""
    bins, by = defaultdict(list), defaultdict(list)
    for x in rows:
        bins[x.bin_id].append(x)
        by[x.doc_id].append(x)
    for b in bins.values():
        b.sort(key=lambda x: x.offset)
        assert [x.offset for x in b] == [sum(y.size for y in b[:i]) for i in range(len(b))]
        assert {x.capacity for x in b} == {min(c for c in capacities if c >= sum(x.size for x in b))}
    want = defaultdict(int)
    for i, t in docs:
        n, body = len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), max(capacities) - 1
        want[i] += n + max(1, -(-n // body))
    assert {i: sum(x.size for x in v) for i, v in by.items()} == dict(want)
    return sum(x.size for x in rows) / sum(b[0].capacity for b in bins.values())


def round_trip(got, docs, capacities):
    """Every id of every document is in one sequence, and the sequences hold what they say; gives the share that is filled."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(tf.TOKENIZER))
    found = defaultdict(list)
    for x in got:
        assert len(x.ids) == x.n_tokens <= x.capacity and x.capacity == min(c for c in capacities if c >= x.n_tokens)
        ends = [*x.offsets[1:], x.n_tokens]
        assert x.offsets[0] == 0 and list(x.offsets) == sorted(x.offsets) and len(x.offsets) == len(x.doc_ids) == len(x.starts)
        for d, start, a, b in zip(x.doc_ids, x.starts, x.offsets, ends, strict=True):
            found[d].append((start, tuple(x.ids[a:b])))
    want, longest = defaultdict(list), max(capacities)
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, tf.END_ID]
        want[i] += [(k, tuple(ids[k : k + longest])) for k in range(0, len(ids), longest)]
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted(x) for i, x in want.items()}
    assert len({x.bin_id for x in got}) == len(got)
    return sum(x.n_tokens for x in got) / max(1, sum(x.capacity for x in got))


def test_documents(spark, sf):
    docs = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert round_trip(p.op4_best_fit_packing(spark, sf).collect(), docs, p.CAPACITIES) > 0.97
    assert check(p.best_fit(spark.read.parquet(f"{sf}/documents.parquet")).collect(), docs, p.CAPACITIES) > 0.97  # by numbers of words


def test_tokens(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(p, "SHARD_SEGMENTS", 50)
    docs = odd_docs.unionByName(odd_docs.limit(3))
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    for caps in ((16, 64, 256), (1,)):
        round_trip(p.pack_documents(docs.where("length(text) < 1000 or text is null") if caps == (1,) else docs, caps).collect(), [x for x in rows if caps != (1,) or len(x[1] or "") < 1000], caps)
    assert p.pack_documents(no_docs).count() == 0


def test_odd(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(p, "SHARD_SEGMENTS", 5)
    docs = [(x.doc_id, x.text) for x in odd_docs.select("doc_id", "text").collect()]
    check(p.best_fit(odd_docs, (8, 64)).collect(), docs, (8, 64))
    assert p.best_fit(no_docs).count() == 0
