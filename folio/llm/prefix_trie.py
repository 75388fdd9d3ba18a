"""A trie of conversations: how many share each beginning, and what is saved by computing it once.

Whole sequences come first: identical conversations collapse into one weighted sequence with a list of the ids that end there,
so a crowd of copies is worked on once. Sequences that are a proper prefix of another one are told from leaves by an anti-join,
and the weighted prefixes of what is left are aggregated to nodes.

A prefix is known by the exclusive or of hashes of (place, turn), in two columns of 64 bits: such sums run along a conversation, in
any number of tasks, and the parent's hash is the node's less its last turn. Subtree sums take no pairs of nodes: each node
is owned by one leaf below it, sums run from each leaf upwards over what it owns, and a node adds up those of its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from folio.llm.shared import cut, table

#: Conversations that share a base; the remainder that tells how many of its turns are taken.
STEP, HEADS = 5, 9
#: Ids in one piece of an end list.
PIECE_IDS = 1 << 12


def _running(key: str, sums: Sequence[str], xors: Sequence[str]):
    def run(batches):
        here, first, held, carry = TaskContext.get().partitionId(), None, None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            first = keys[0] if first is None else first
            head = np.concatenate(([True], keys[1:] != keys[:-1]))
            start = np.flatnonzero(head)[np.cumsum(head) - 1]  # of each row, where its key begins in this batch
            goes_on = (start == 0) & (keys[0] == held)
            out = {"n": np.arange(len(keys)) - start + 1}
            for c in sums:
                v = batch.column(c).to_numpy()
                upto = np.cumsum(v)
                out[c] = upto - (upto - v)[start]
            for c in xors:
                v = batch.column(c).to_numpy()
                upto = np.bitwise_xor.accumulate(v)
                out[c] = upto ^ (upto ^ v)[start]
            for c in out:
                if held is not None:
                    out[c] = np.where(goes_on, out[c] ^ carry[c] if c in xors else out[c] + carry[c], out[c])
                carry[c] = out[c][-1]
            held = keys[-1]
            new = [pa.array(np.full(len(keys), here), pa.int32()), pa.array(keys == first), *(pa.array(out[c]) for c in ("n", *sums, *xors))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "part", "edge", "n", *(f"run_{c}" for c in (*sums, *xors))])

    return run


def running(df: DataFrame, key: str, order: Sequence[Column | str], sums: Sequence[str] = (), xors: Sequence[str] = ()) -> DataFrame:
    """Adds to each row `n`, its place from 1 among the rows of its key (long, not null), and for each column of `sums` and `xors`
    (long, not null) what has run up to it and with it, as run_<column>.

    Rows are dealt by ranges of (key, order), so a key of very many rows is shared by tasks; what earlier ranges had of a key is then
    added from a table of at most one row a range. The result is a written table."""
    new = [StructField("part", IntegerType()), StructField("edge", BooleanType()), *(StructField(c, LongType()) for c in ("n", *(f"run_{c}" for c in (*sums, *xors))))]
    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    rows = cut(ranged.mapInArrow(_running(key, sums, xors), StructType([*df.schema.fields, *new])), "running")
    over = rows.where("edge").select(F.col(key).alias("_key"), "part").distinct()  # a row a range
    of = rows.join(F.broadcast(over.select("_key").distinct()), F.col(key) == F.col("_key"), "left_semi")
    totals = of.groupBy(F.col(key).alias("_key"), F.col("part").alias("_part")).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"run_{c}") for c in sums), *(F.bit_xor(c).alias(f"run_{c}") for c in xors))
    w = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # of a key: a row a range
    names = ["n", *(f"run_{c}" for c in sums)]
    before = totals.select("_key", "_part", *(F.sum(c).over(w).alias(f"_{c}") for c in names), *(F.bit_xor(f"run_{c}").over(w).alias(f"_run_{c}") for c in xors)).where("_n is not null")
    joined = rows.join(F.broadcast(before), (F.col(key) == F.col("_key")) & (F.col("part") == F.col("_part")), "left")
    more = [(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in names] + [F.col(f"run_{c}").bitwiseXOR(F.coalesce(F.col(f"_run_{c}"), F.lit(0))).alias(f"run_{c}") for c in xors]
    return joined.select(*df.columns, *more)


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation with the first turns of its base before its own later ones: (conv_id, pos, bytes, a, b) a turn, where a and b
    are hashes of place, role and text, and (conv_id, size) for every conversation, turnless ones too."""
    column = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.sha2(F.concat(F.length(column("role")).cast("string"), F.lit(":"), column("role"), column("text")), 256)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn.alias("sha"), F.octet_length(column("text")).cast("long").alias("bytes")).where("conv_id is not null")
    own = running(rows, "conv_id", [F.col("turn").asc_nulls_first(), "sha"]).select("conv_id", (F.col("n") - 1).alias("pos"), "sha", "bytes")
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("own"))
    taken = F.crc32(F.col("conv_id").cast("string")) % HEADS
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % STEP).alias("base"), taken.alias("h"))
    convs = cut(convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("heads")), "convs")
    later = own.join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("heads") + F.col("pos") - F.col("h")).alias("pos"), "sha", "bytes")
    first = own.where(F.col("pos") < HEADS - 1).withColumnRenamed("conv_id", "base").join(convs, "base").where("pos < h").select("conv_id", "pos", "sha", "bytes")
    hashed = [F.xxhash64(F.lit(k), "pos", "sha").alias(c) for k, c in ((1, "a"), (2, "b"))]
    turns = cut(later.union(first).select("conv_id", "pos", "bytes", *hashed), "turns")
    whole = turns.groupBy("conv_id").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count("*").alias("size"))
    every = convs.select("conv_id").join(whole, "conv_id", "left").select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("a", "b", "size")))
    return turns, cut(every, "whole")


def _pieces(batches):
    """Sorted (a, b, conv_id) in -> a, b, least id, and up to so many ids as text."""
    for batch in batches:
        a, b, ids = (batch.column(c).to_numpy() for c in ("a", "b", "conv_id"))
        if not len(ids):
            continue
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        cuts = [k for i, j in zip(new, [*new[1:], len(ids)], strict=True) for k in range(i, j, PIECE_IDS)]
        text = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(a[cuts]), pa.array(b[cuts]), pa.array(ids[cuts]), pa.array(text, pa.string())], ["a", "b", "least", "ids"])


def _sha(batches):
    """Sorted pieces in -> the digest of each list; pieces stream through it."""
    held, digest = None, None
    for batch in batches:
        out = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
            if held == (a, b):
                digest.update(b"," + ids.encode())
                continue
            if held is not None:
                out.append((*held, digest.hexdigest()))
            held, digest = (a, b), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["a", "b", "ends_sha256"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]]), pa.array([digest.hexdigest()])], ["a", "b", "ends_sha256"])


def ends(whole: DataFrame) -> DataFrame:
    """Of each sequence, the digest of the ascending ids that are it. A long list is sorted and written down in pieces by many tasks."""
    pieces = whole.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(_pieces, "a long, b long, least long, ids string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "least").mapInArrow(_sha, "a long, b long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations: one row a node, that is a distinct sequence of the first so many turns (role, text), from
    the root of depth 0 on: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (bytes of last texts that members after the first don't need again, over the subtree), ends_sha256.

    Null role or text: empty. Turns of one number (or none; null comes first) are ordered by a hash of role and text;
    repeated rows are turns each. Rows without conv_id belong to no conversation and are left out. Very long texts are hashed
    whole, and conversations of any length or number of copies are shared by tasks. A conversation without turns after rebuilding ends
    at the root. Empty table: empty result (not even a root, which would have no member). Other columns are not looked at.
    """
    turns, whole = rebuild(conversations)
    seqs = cut(whole.groupBy("a", "b").agg(F.count("*").alias("weight"), F.min("conv_id").alias("rep"), F.max("size").alias("size")), "sequences")
    own = turns.join(seqs.select(F.col("rep").alias("conv_id"), "weight", "size"), "conv_id")
    paths = running(own, "conv_id", ["pos"], xors=["a", "b"])
    up = [F.col(f"run_{c}").bitwiseXOR(F.col(c)).alias(f"up_{c}") for c in ("a", "b")]
    paths = cut(paths.select(F.col("conv_id").alias("rep"), "weight", "size", F.col("n").alias("depth"), "bytes", F.col("run_a").alias("a"), F.col("run_b").alias("b"), *up), "paths")
    proper = paths.where("depth < size").select("a", "b").distinct()
    leaves = cut(seqs.where("size > 0").join(proper, ["a", "b"], "left_anti").select("rep", F.lit(1).cast("long").alias("leaf")), "leaves")
    paths = paths.join(leaves, "rep", "left")
    found = paths.groupBy("a", "b").agg(
        *(F.max(c).alias(c) for c in ("depth", "up_a", "up_b", "bytes")),
        F.sum("weight").alias("n_convs"),
        F.min("rep").alias("conv_id"),
        F.sum("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf").isNotNull(), F.col("rep"))).alias("owner"),
    )
    nodes = cut(found.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")
    # from each leaf upwards, sums of what it owns
    owned = nodes.select(F.col("owner").alias("rep"), "depth", "saved")
    on_leaves = paths.where("leaf is not null").select("rep", "depth", "a", "b").join(owned, ["rep", "depth"], "left").withColumn("saved", F.coalesce("saved", F.lit(0)))
    below = running(on_leaves, "rep", [F.desc("depth")], sums=["saved"]).groupBy("a", "b").agg(F.sum("run_saved").alias("saved_tokens"))
    root = seqs.agg(F.sum("weight").alias("n_convs"), F.min("rep").alias("conv_id")).where("conv_id is not null")
    all_below = nodes.agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    all_leaves = leaves.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_leaves"))  # a root alone is a leaf
    zero = F.lit(0).cast("long")
    root = root.crossJoin(all_below).crossJoin(all_leaves)  # one row each
    names = ["a", "b", "depth", "up_a", "up_b", "conv_id", "n_convs", "n_leaves", "saved_tokens"]
    root = root.select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), F.lit(None).cast("long").alias("up_a"), F.lit(None).cast("long").alias("up_b"), "conv_id", "n_convs", "n_leaves", "saved_tokens")
    nodes = cut(nodes.join(below, ["a", "b"]).select(*names).union(root), "trie")
    children = nodes.where("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = nodes.join(children, ["a", "b"], "left").join(ends(whole), ["a", "b"], "left").join(parents, ["up_a", "up_b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: CRC-32 bit by bit: its polynomial is a fixed value.
SQL = f"""
WITH t AS (
  SELECT conv_id, octet_length(encode(coalesce(text, ''))) AS bytes, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % {STEP} AS base, n, xor(list_reduce([4294967295] || list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, CAST(i AS INTEGER), 1))),
    lambda h, d: list_reduce([xor(h, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % {HEADS} AS h
  FROM (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, count(*) AS n FROM t GROUP BY conv_id)
), r AS (
  SELECT c.conv_id, pos, k, bytes FROM c JOIN t ON t.conv_id = c.base AND pos < h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + pos - c.h, k, bytes FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h LEFT JOIN c b ON b.conv_id = c.base
), p AS (
  SELECT conv_id, pos + 1 AS depth, bytes, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path,
    coalesce(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS up
  FROM r
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c
), n AS (
  SELECT path, depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256
  FROM p JOIN (SELECT conv_id, max(depth) AS last FROM p GROUP BY conv_id) USING (conv_id) GROUP BY path, depth
), kids AS (
  SELECT up AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up
), below AS (
  SELECT a.path, sum(n.saved) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM n JOIN p a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN kids ON kids.path = n.path GROUP BY a.path
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN below USING (path) LEFT JOIN kids USING (path) LEFT JOIN n parent ON parent.path = n.up"""
