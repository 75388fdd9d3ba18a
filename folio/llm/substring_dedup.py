"""Substring dedup: passages of many words that already start in an earlier document are removed.

Documents are streamed through suffix automata of reference shards for matching statistics; every maximal span whose match
is at least as long as the threshold is removed. The reference is the corpus itself, so an automaton of it has no size
bound that would allow a broadcast of the whole. It is cut into shards by content instead, and each shard goes to the
task that needs it:

* A window is `min_words` consecutive words. Its anchor is the least hash among its word grams (a third as long as the
  window), so equal windows have equal anchors wherever they stand. Consecutive windows with one anchor form a piece.
* A shard holds the distinct pieces of an anchor. Anchors met in one document only are dropped, after a pre-aggregated
  count. An anchor whose pieces are all equal needs no automaton: its first document is the reference.
* Other shards stream their pieces by ascending document through a suffix automaton that grows as it goes: each piece is
  first matched with what earlier documents put there, then added.
* A shard of very many distinct pieces (one common passage in ever new surroundings) is split window by window, each
  window being its own shard, pre-aggregated to its first document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import cut, id_text, table
from folio.llm.words import chunks, runs, stretches, words

#: Distinct pieces of a shard beyond which it is split window by window.
SHARD_PIECES = 2048
#: Pieces to look up in the texts that may be broadcast (about 60 bytes each); more are joined by shuffle.
BROADCAST_PIECES = 400_000
#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; grows by one sequence at a time."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, p: int, word, q: int) -> int:
        c = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def add(self, sequence: list) -> None:
        last = 0
        for word in sequence:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
                continue
            new, p = len(self.next), last
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
            last = new

    def matches(self, sequence: list) -> Iterator[int]:
        """Matching statistics: for each position, the length of the longest match that ends there."""
        state = size = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                size += 1
            yield size


def _pieces_of(h: np.ndarray, first: np.ndarray, min_words: int):
    """All pieces of a chunk: anchor hash, content hash, row, first word (within the row), windows."""
    gram = max(1, min_words // 3)
    grams = runs(h, gram)
    n = len(h) - min_words + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    wide = min_words - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, wide)[:n]
    at = np.arange(n) + wide - 1 - np.argmin(view[:, ::-1], axis=1)  # the last of equal grams
    row = np.searchsorted(first, np.arange(n), "right") - 1
    whole = np.arange(n) + min_words <= first[row + 1]
    starts = np.flatnonzero(whole)
    if not len(starts):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    new = np.r_[True, (at[starts[1:]] != at[starts[:-1]]) | (row[starts[1:]] != row[starts[:-1]])]
    a = starts[new]
    count = np.diff(np.r_[np.flatnonzero(new), len(starts)])
    end = a + count - 1 + min_words
    return grams[at[a]], stretches(h, a, end), row[a], a - first[row[a]], count


def _pieces(min_words: int, full: bool):
    def run(batches):
        for batch in batches:
            ids, keys = batch.column("id").to_numpy(), batch.column("row_key").to_numpy()
            for chunk in chunks(batch.column("text")):
                w = words(chunk)
                h, c, row, a, n = _pieces_of(w.hashes(), w.first, min_words)
                row = row + chunk.first
                cols = [h.view(np.int64), c.view(np.int64), ids[row]]
                if full:
                    cols += [keys[row], a.astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "c", "id", "row_key", "a", "n"][: len(cols)])

    return run


_FULL = "h long, c long, id long, row_key long, a int, n int"


def _look_up(min_words: int):
    """Texts with their wanted pieces in -> each piece's words (shards to be streamed) or its windows' hashes (split shards)."""

    def run(batches):
        for batch in batches:
            ids, keys, wanted = batch.column("id").to_numpy(), batch.column("row_key").to_numpy(), batch.column("wanted")
            out = {x: [] for x in ("h", "c", "id", "row_key", "at", "words", "window")}
            for chunk in chunks(batch.column("text")):
                w = words(chunk)
                h = w.hashes()
                for i in range(len(chunk)):
                    first, r = int(w.first[i]), chunk.first + i
                    for p in wanted[r].as_py():
                        a, n = first + p["a"], p["n"]
                        got = runs(h[a : a + n + min_words - 1], min_words).view(np.int64) if p["split"] else [None]
                        text = None if p["split"] else chunk.buf[w.start[a] : w.end[a + n + min_words - 2]].tobytes()
                        for j, x in enumerate(got):
                            for k, v in zip(out, (p["h"], p["c"], ids[r], keys[r], p["a"] + j, text, x), strict=True):
                                out[k].append(v)
            kinds = {"at": pa.int32(), "words": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))

    return run


def _stream(min_words: int):
    """Pieces sorted by shard and document in -> for each, the windows that an earlier document holds, as a bitmap."""

    def run(batches):
        shard, automaton, doc, waiting = None, None, None, []
        for batch in batches:
            out_h, out_c, out_m = [], [], []
            for h, c, i, text in zip(*(batch.column(x).to_pylist() for x in ("h", "c", "id", "words")), strict=True):
                if h != shard:
                    shard, automaton, doc, waiting = h, SuffixAutomaton(), i, []
                if i != doc:  # pieces of a document do not count against each other
                    for x in waiting:
                        automaton.add(x)
                    doc, waiting = i, []
                sequence = text.split()
                flags = np.fromiter((m >= min_words for m in automaton.matches(sequence)), bool, len(sequence))[min_words - 1 :]
                waiting.append(sequence)
                if flags.any():
                    out_h.append(h)
                    out_c.append(c)
                    out_m.append(np.packbits(flags).tobytes())
            if out_h:
                yield pa.RecordBatch.from_arrays([pa.array(out_h, pa.int64()), pa.array(out_c, pa.int64()), pa.array(out_m, pa.binary())], ["h", "c", "mask"])

    return run


def _remove(min_words: int):
    """Texts with their marked pieces in -> the digest columns and the kept text's words, joined by one space."""

    def run(batches):
        for batch in batches:
            marked = batch.column("marked")
            n, gone, kept, spans = [], [], [], []
            for chunk in chunks(batch.column("text")):
                for i in range(len(chunk)):
                    w = chunk.text(i).split()
                    n.append(len(w))
                    marks = marked[chunk.first + i].as_py()
                    cover = np.zeros(len(w) + 1, np.int32)
                    for p in marks or ():
                        at = p["a"] + (np.arange(p["n"]) if p["mask"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(p["mask"], np.uint8), count=p["n"])))
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + min_words, -1)
                    drop = np.cumsum(cover[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.r_[False, drop, False]))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                    gone.append(int(drop.sum()))
                    kept.append(b" ".join([x for x, d in zip(w, drop, strict=True) if not d] if gone[-1] else w))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([x.decode() for x in kept])],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"],
            )

    return run


def substring_dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Removes each word (`[^\\x20\\x09-\\x0D]+`) that lies in `min_words` consecutive words which also start in a document
    with a smaller doc_id. Windows are judged on the input, not on what is left.

    Returns one row a row of `docs`: doc_id, n_words, n_removed, kept_sha256, spans (removed words, end exclusive), kept.

    Null or empty text, and texts of fewer words: nothing removed (no words: the digest of the empty text). Very long texts
    are compared whole. Null doc_id: counts as after all others, and such rows not against each other. Ties, repeated rows
    and rows of one doc_id: not against each other, each is returned. Empty table: empty result. Other columns, whatever
    their names, are not looked at.
    """
    base = id_text(docs).withColumn("row_key", F.xxhash64("doc_id", "text")).withColumn("id", F.coalesce("doc_id", F.lit(LAST)))
    texts = base.select("id", "row_key", "text")
    # anchors that stand in more than one document
    seen = texts.mapInArrow(_pieces(min_words, False), "h long, c long, id long")
    anchors = cut(seen.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("low < high").select("h", "low", (F.col("c0") < F.col("c1")).alias("many")), "anchors")
    pieces = cut(texts.mapInArrow(_pieces(min_words, True), _FULL).join(anchors, "h"), "pieces")

    # distinct pieces of the shards that have several, each with its first document
    first = cut(pieces.where("many").groupBy("h", "c").agg(F.min(F.struct("id", "row_key", "a", "n")).alias("at")).select("h", "c", "at.*"), "first")
    large = cut(first.groupBy("h").agg(F.count("*").alias("k")).where(f"k > {SHARD_PIECES}").select("h"), "large")
    streamed = first.join(large, "h", "left_anti").withColumn("split", F.lit(False))
    windows = pieces.where("many").join(large, "h", "left_semi").withColumn("split", F.lit(True))
    wanted = streamed.select("row_key", "h", "c", "a", "n", "split").union(windows.select("row_key", "h", "c", "a", "n", "split").distinct())
    wanted = cut(wanted.groupBy("row_key").agg(F.collect_list(F.struct("h", "c", "a", "n", "split")).alias("wanted")), "wanted")
    few = wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0] <= BROADCAST_PIECES
    found = texts.join(F.broadcast(wanted) if few else wanted, "row_key").mapInArrow(_look_up(min_words), "h long, c long, id long, row_key long, at int, words binary, window long")
    found = cut(found, "found")

    masks = found.where("words is not null").select("h", "c", "id", "words").distinct().repartition("h").sortWithinPartitions("h", "id").mapInArrow(_stream(min_words), "h long, c long, mask binary")
    masks = first.join(large, "h", "left_anti").select("h", "c", F.col("id").alias("first_id")).join(cut(masks, "masks"), ["h", "c"], "left")
    several = pieces.where("many").join(cut(masks, "masks"), ["h", "c"]).where("id > first_id or mask is not null").select("row_key", "a", "n", F.when(F.col("id") == F.col("first_id"), F.col("mask")).alias("mask"))
    single = pieces.where("not many and id > low").select("row_key", "a", "n", F.lit(None).cast("binary").alias("mask"))
    split = found.where("window is not null")
    earliest = cut(split.groupBy("window").agg(F.min("id").alias("low")), "earliest")
    split = split.join(earliest, "window").where("id > low").select("row_key", F.col("at").alias("a"), F.lit(1).alias("n"), F.lit(None).cast("binary").alias("mask"))
    marked = single.union(several).union(split).groupBy("row_key").agg(F.collect_set(F.struct("a", "n", "mask")).alias("marked"))
    return base.join(marked, "row_key", "left").select("doc_id", "text", "marked").mapInArrow(_remove(min_words), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i) WHERE len(w) >= 50),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low FROM x),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM m WHERE low < doc_id GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce((SELECT string_agg(v, ' ' ORDER BY k) FROM (SELECT unnest(w) AS v, unnest(range(1, len(w) + 1)) AS k) WHERE NOT list_contains(gone, k)), '') END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
