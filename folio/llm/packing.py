"""Variable-capacity best-fit packing of documents into training sequences of token ids.

Several sequence lengths are permitted, each with a cost. Documents longer than the longest are cut into segments, the last
of which is the remainder. Segments go, longest first, to the open bin that they leave with the least room. A segment that
fits nowhere opens a bin: for each permitted length the sizes still to come are tried in it, and the length wins whose
contents cost least a word. At the end every bin is downsized to the shortest permitted length that holds its contents. The
lengths are chosen jointly: the same is done with always the shortest fitting and always the longest length, and the packing
of least total cost, after downsizing, stays.

Shards are packed apart from each other, in parallel: rows are dealt by a hash of their ids and lengths, so a hot source
or a group of copies is spread evenly. A task holds one shard at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import cut, id_text, table
from folio.llm.token_file import END_ID, TOKENIZER, _encoder
from folio.llm.words import chunks

#: Permitted lengths in tokens, each document's end id included.
CAPACITIES = (256, 512, 1024, 2048)
#: Segments of a shard, about. A shard's packing loss is a part of a bin, so it may be small beside that.
SHARD_SEGMENTS = 2048
#: Shards that one task packs, one after another, where there are many more shards than cores.
TASK_SHARDS = 16
#: Pieces of texts that a worker keeps encoded.
PIECES = 1 << 19
#: Cost of a sequence of c tokens: c, plus this for each sequence, plus quadratic attention as a share of c at the longest. So
#: short sequences cost by their number, long ones by attention, and those between are cheapest a word if they are full.
PER_SEQUENCE, ATTENTION = 64.0, 0.25


def cost(capacity: int, longest: int) -> float:
    return capacity * (1 + ATTENTION * capacity / longest) + PER_SEQUENCE


class _Rooms:
    """Open bins by room left, with a bitmap of the amounts of room that have any: best fit in a few steps."""

    def __init__(self, longest: int):
        self.bins: list[list[int]] = [[] for _ in range(longest + 1)]
        self.some = 0

    def add(self, room: int, b: int) -> None:
        self.bins[room].append(b)
        self.some |= 1 << room

    def take(self, size: int):
        """The bin with the least room of at least `size`, of equals the one that came to it last, removed: (room, bin), or None."""
        rest = self.some >> size
        if not rest:
            return None
        room = size + (rest & -rest).bit_length() - 1
        b = self.bins[room].pop()
        if not self.bins[room]:
            self.some &= ~(1 << room)
        return room, b


class _Sizes:
    """How many segments of each size are still to come, with a bitmap of the sizes that are."""

    def __init__(self, sizes: Sequence[int], longest: int):
        self.count = np.bincount(np.asarray(sizes, np.int64), minlength=longest + 1).tolist()
        self.some = sum(1 << s for s, n in enumerate(self.count) if n)

    def remove(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.some &= ~(1 << size)

    def fill(self, room: int) -> int:
        """How much of a room they fill, the largest that fits first."""
        got, top = 0, room
        while rest := self.some & ((1 << top + 1) - 1):
            size = rest.bit_length() - 1
            n = min(self.count[size], room // size)
            got, room = got + n * size, room - n * size
            top = min(room, size - 1)
        return got


def _by_contents(caps: list[int]) -> Callable[[int, _Sizes], int]:
    """The length of least cost a word, with what the sizes to come put into it, downsized to that. Of equals the longest:
    until it is downsized it leaves room for more."""
    price = [cost(c, caps[-1]) for c in caps]

    def choose(size: int, left: _Sizes) -> int:
        best = None
        for c in caps:
            if c >= size:
                filled = size + left.fill(c - size)
                final = next(p for k, p in zip(caps, price, strict=True) if k >= filled)
                if best is None or final / filled <= best[0]:
                    best = final / filled, c
        return best[1]

    return choose


def _pack_by(sizes: Sequence[int], caps: list[int], choose) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rooms, left, used, opened = _Rooms(caps[-1]), _Sizes(sizes, caps[-1]), [], []
    bins, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes):
        left.remove(size)
        got = rooms.take(size)
        if got is None:
            got = (choose(size, left), len(used))
            opened.append(got[0])
            used.append(0)
        room, b = got
        bins[i], offset[i] = b, used[b]
        used[b] += size
        if room > size:
            rooms.add(room - size, b)
    used = np.array(used, np.int64)
    return bins, offset, np.array(caps, np.int64)[np.searchsorted(caps, used)] if len(used) else used, np.array(opened, np.int64)


def total_cost(capacities: np.ndarray, longest: int) -> float:
    return float(sum(cost(int(c), longest) for c in capacities))


def pack(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, in descending order -> for each its bin, its offset there; for each bin its final capacity, and that it was
    opened with."""
    caps = sorted(set(capacities))
    ways = [_by_contents(caps), lambda size, left: next(c for c in caps if c >= size), lambda size, left: caps[-1]]
    return min((_pack_by(sizes, caps, way) for way in ways), key=lambda got: total_cost(got[2], caps[-1]))


_PACKED = "doc_id long, segment long, start long, size long, bin_id long, offset long, capacity long"


def _places(rows: pa.Table, bins: np.ndarray, offset: np.ndarray, final: np.ndarray, first: int) -> pa.RecordBatch:
    """Segments and where they go -> one row a segment."""
    rows = rows.combine_chunks()
    columns = [*(rows[c].combine_chunks() for c in ("doc_id", "segment", "start", "size")), pa.array(first + bins), pa.array(offset), pa.array(final[bins])]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "segment", "start", "size", "bin_id", "offset", "capacity"])


def _pack_shards(capacities: Sequence[int], shards: int, give=_places):
    """Rows of a partition, sorted by shard and then descending by size, in; a shard is held at a time."""

    def packed(held: list[pa.RecordBatch], shard: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        bins, offset, final, _ = pack(rows["size"].to_pylist(), capacities)
        return give(rows, bins, offset, final, (TaskContext.get().partitionId() * shards + shard) << 32)

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held and shard[i] != last:
                    yield packed(held, last)
                    held = []
                last = int(shard[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield packed(held, last)

    return run


def word_count(text) -> F.Column:
    """`[^\\x20\\x09-\\x0D]+` in a text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _pack(rows: DataFrame, capacities: Sequence[int], mark: int) -> DataFrame:
    """`rows` (doc_id, length): each row's segments, with `mark` end marks of one word each, packed."""
    body = max(capacities) - mark
    if body < 1 or min(capacities) < 1:
        raise ValueError("capacities must leave room for a word and its end mark")
    rows = cut(rows.select("doc_id", F.coalesce(F.col("length").cast("long"), F.lit(0).cast("long")).alias("length")), "lengths")
    segments = rows.select("doc_id", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / body) - 1, F.lit(0).cast("long")))).alias("segment"))
    shards = max(1, -(-segments.count() // SHARD_SEGMENTS))
    tasks = min(shards, max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-shards // TASK_SHARDS)))
    segments = segments.select(
        F.col("doc_id"),
        F.xxhash64("doc_id", "length").alias("row_key"),
        "segment",
        (F.col("segment") * body).alias("start"),
        (F.least(F.lit(body), F.col("length") - F.col("segment") * body) + mark).alias("size"),
    ).where("size > 0")
    # equal rows are told apart by their turn, so that they are dealt evenly too
    same = segments.groupBy("doc_id", "row_key", "segment", "start", "size").agg(F.count("*").alias("n"))
    each = same.select("doc_id", "row_key", "segment", "start", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    key = ("doc_id", "row_key", "segment", "copy")
    per_task = -(-shards // tasks)
    dealt = each.repartition(tasks, *key).withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(per_task)).cast("int"))
    dealt = dealt.sortWithinPartitions("shard", F.col("size").desc(), *key)
    return dealt.mapInArrow(_pack_shards(tuple(capacities), per_task), _PACKED)


def best_fit(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, length: F.Column | None = None) -> DataFrame:
    """Packs the documents of `docs` by length (default: words of the text).

    Returns one row a segment: doc_id, segment (0, 1, ...), start (first word of the segment), size (words and an end mark),
    bin_id, offset (in the bin), capacity (of the bin). Segments of a bin don't overlap and fill at most its capacity.

    Null or empty text: one segment that is only an end mark. Very long texts are cut into segments of the longest length,
    none is left out. Null doc_id is kept. Ties of size are ordered by doc_id. Repeated rows are packed once each. Empty
    table: empty result. Other columns, whatever their names, are not looked at.
    """
    words = word_count(F.coalesce(F.col("text").cast("string"), F.lit(""))) if length is None else length
    return _pack(docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("length")), capacities, 1)


def _segments(path: str, longest: int):
    """Rows in -> the token ids of each, with its end id, cut into segments."""
    names = ["doc_id", "row", "segment", "start", "size", "ids"]

    def run(batches):
        encoder = _encoder(path, PIECES)
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                ids, first = encoder.encode(chunk)
                n = np.diff(first) + 1
                flat = np.full(len(ids) + len(n), END_ID, np.int32)
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids.view(np.int32)
                many = -(-n // longest)  # segments of each document
                doc = np.repeat(np.arange(len(n)), many)
                segment = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                size = np.minimum(longest, n[doc] - segment * longest)
                of = lambda c, chunk=chunk, doc=doc: batch.column(c).take(pa.array(chunk.first + doc))  # noqa: B023, E731
                off = np.concatenate(([0], np.cumsum(size))).astype(np.int32)  # segments lie one after another as they are
                yield pa.RecordBatch.from_arrays([of("doc_id"), of("row"), pa.array(segment), pa.array(segment * longest), pa.array(size), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names)

    return run


def _sequences(rows: pa.Table, bins: np.ndarray, offset: np.ndarray, final: np.ndarray, first: int) -> pa.RecordBatch:
    """Segments and where they go -> one row a sequence."""
    order = np.lexsort((offset, bins))
    rows = rows.take(pa.array(order)).combine_chunks()
    count = np.bincount(bins, minlength=len(final))
    parts = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
    size = rows["size"].to_numpy()
    total = np.concatenate(([0], np.cumsum(size)))[parts]
    column = lambda c: pa.concat_arrays(rows[c].chunks)
    listed = lambda x: pa.ListArray.from_arrays(pa.array(parts), x)
    columns = [pa.array(first + np.arange(len(final))), pa.array(final), pa.array(np.diff(total)), listed(column("doc_id")), listed(column("start")), listed(pa.array(offset[order])), pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), column("ids").flatten())]
    return pa.RecordBatch.from_arrays(columns, ["bin_id", "capacity", "n_tokens", "doc_ids", "starts", "offsets", "ids"])


_SEQUENCES = "bin_id long, capacity long, n_tokens long, doc_ids array<long>, starts array<long>, offsets array<long>, ids array<int>"


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, tokenizer: str | None = None) -> DataFrame:
    """Packs the token ids of the documents of `docs` into training sequences.

    Returns one row a sequence: bin_id, capacity, n_tokens, then for each segment in it doc_ids, starts (first id of the segment in
    its document) and offsets (in the sequence), and ids (those of the segments one after another, at most `capacity`). Each document
    ends with the end id; one of more ids than the longest length is cut into segments of that length and a rest.

    Null or empty text: one segment that is only the end id. Very long texts are encoded whole, none is left out. Null
    doc_id is kept. Ties of size are ordered by the place of a row in its table. Repeated rows are packed once each. Empty
    table: empty result. Other columns, whatever their names, are not looked at.
    """
    longest = max(capacities)
    if min(capacities) < 1:
        raise ValueError("capacities must be positive")
    rows = id_text(docs).withColumn("row", F.monotonically_increasing_id())
    # about how many segments there will be: a token has some three bytes
    guess = rows.agg(F.coalesce(F.sum(F.ceil((F.octet_length("text") + 1) / (3 * longest))), F.lit(0))).first()[0]
    shards = max(1, -(-guess // SHARD_SEGMENTS))
    tasks = min(shards, max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-shards // TASK_SHARDS)))
    per_task = -(-shards // tasks)
    segments = rows.mapInArrow(_segments(tokenizer or public_tokenizers.path(TOKENIZER), longest), "doc_id long, row long, segment long, start long, size long, ids array<int>")
    dealt = segments.repartition(tasks, "row", "segment").withColumn("shard", F.pmod(F.xxhash64("row", "segment"), F.lit(per_task)).cast("int"))
    return dealt.sortWithinPartitions("shard", F.col("size").desc(), "row", "segment").mapInArrow(_pack_shards(tuple(capacities), per_task, _sequences), _SEQUENCES)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
