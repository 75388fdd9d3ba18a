"""The trie of conversations against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from folio.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        convs[c] = tuple([*own.get(base, [])[:h], *v[h:]])
    members = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        saved[p] = (len(members[p]) - 1) * len(p[-1][1].encode() if p else b"") + sum(saved[k] for k in kids.get(p, []))
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
    out = []
    for p, m in members.items():
        ends = sorted(c for c in m if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def got(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in pt.trie(spark.createDataFrame(rows, schema)).select(NAMES).collect()), key=str)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in pt.op12_prefix_trie(spark, sf).select(NAMES).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("split", [False, True])
def test_shared(spark, split):
    """Few different turns: deep sharing, many copies, turnless conversations, a conversation of most rows."""
    chance = random.Random(2)
    rows = [(c, t, chance.choice(["user", "assistant"]), chance.choice(["a", "bb", "é"])) for c in range(-10, 300) for t in range(chance.randrange(1, 7))]
    rows += [(7, t, "user", f"turn {t}") for t in range(10, 1500)] + [(c, t, "user", "same") for c in range(1000, 1200) for t in range(3)]
    chance.shuffle(rows)
    if split:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running(spark):
    """Running values go on from range to range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id") % 3).cast("long").alias("k"), F.col("id").alias("o"), (F.col("id") * 7919 % 1009).alias("v"), (F.col("id") * 104729).alias("x"))
        rows = pt.running(df, "k", ["o"], sums=["v"], xors=["x"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 5000
    state = {}
    for r in sorted(rows, key=lambda r: r.o):
        n, s, x = state.get(r.k, (0, 0, 0))
        state[r.k] = (n + 1, s + r.v, x ^ r.x)
        assert (r.n, r.run_v, r.run_x) == state[r.k]


def test_odd(spark):
    rows = [(1, None, None, None, 1), (1, 0, "user", "", 2), (1, 0, "user", "", 2), (1, 0, "", "user", 2), (None, 1, "user", "x", 3), (2, 3, "user", "y" * 200_000, 4), (3, 0, None, "z", 5), (3, 0, None, "z", 5), (10, None, "assistant", None, 6)]
    assert got(spark, rows, SCHEMA + ", n long") == brute([r[:4] for r in rows])
    assert got(spark, [], SCHEMA) == []
    alone = [(3, 0, "user", "x")]  # its base is not there, and more turns are taken than it has
    assert got(spark, alone) == brute(alone)
