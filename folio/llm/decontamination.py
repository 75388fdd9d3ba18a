"""Benchmark decontamination by FM-indexes of training shards.

Each task indexes the training text it holds, shard by shard, and searches all test phrases in it backwards: ranks in a
wavelet tree over the Burrows-Wheeler transform narrow a suffix interval word by word, a phrase at a time over all
phrases at once; occurrences are located through sampled suffix positions and merged into removal spans.

A word that no test phrase has can't lie in an occurrence. So a shard's text is the runs of words known to the phrases, at
least as long as the shortest phrase, with a terminator after each run: an exact reduction that makes the index small.

The phrases are the query set. Spark tasks cut, hash and dedupe them and write them as blocks of bounded size to the shared
folder; each searching task reads one block after the other from there, so neither the driver nor a broadcast ever holds them,
and a lost executor's task finds them again.
"""

from __future__ import annotations

import functools
import io
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import carry, cut, folder, id_text, table
from folio.llm.words import ALNUM, chunks, words

#: (phrase, item) pairs of a block, at most; a phrase of ten words takes 80 bytes.
BLOCK_PAIRS = 1 << 18
#: Words of a shard, at least one document.
SHARD_WORDS = 1 << 20
#: Every so many text positions have their suffix position stored.
SAMPLE = 8


class _Bits:
    """A bit vector packed into words of 64 bits, with the number of ones before each word."""

    def __init__(self, bit: np.ndarray):
        packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)  # a word past the end, so that every place has one
        some = np.packbits(bit, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = (np.cumsum(ones, dtype=np.int64) - ones).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)).astype(np.int64) & 1


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector a level, with counts before each 64 bits."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.zeros, self.bits = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.zeros.append(int(len(bit) - bit.sum()))
            self.bits.append(_Bits(bit))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))  # a wavelet matrix: zeros first

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low = np.zeros_like(at)
        for k in range(self.levels):
            bit = symbol >> (self.levels - 1 - k) & 1
            one_at, one_low = self.bits[k].rank(at), self.bits[k].rank(low)
            at = np.where(bit, self.zeros[k] + one_at, at - one_at)
            low = np.where(bit, self.zeros[k] + one_low, low - one_low)
        return at - low

    def get(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit, one = self.bits[k].get(at), self.bits[k].rank(at)
            at = np.where(bit, self.zeros[k] + one, at - one)
            out = out << 1 | bit
        return out


class FMIndex:
    """Of a text in which every run of symbols 1 to `alphabet` - 1 ends in 0. A 0 counts as less than all others and than
    every later 0, so comparing suffixes stops at the end of a run, and no search or step back passes it."""

    def __init__(self, text: np.ndarray, alphabet: int):
        n, ends = len(text), np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        size = 1
        while True:
            suffixes = np.argsort(rank, kind="stable")
            ranked = rank[suffixes]
            dense = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
            rank[suffixes] = dense
            if dense[-1] == n - 1:
                break
            rank = rank * n + np.concatenate((rank[size:], np.zeros(min(size, n), np.int64)))[:n]
            size *= 2
        before = np.concatenate((text[-1:], text[:-1]))[suffixes]
        self.n = n
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet))))
        self.tree = WaveletTree(before.astype(np.int64), max(1, int(alphabet - 1).bit_length()))
        self.sampled = (suffixes % SAMPLE == 0) | (before == 0)
        self.samples = suffixes[self.sampled]
        self.count = np.concatenate(([0], np.cumsum(self.sampled)))

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of phrases of equal length, one a row."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for column in phrases.T[::-1]:
            low = self.first[column] + self.tree.rank(column, low)
            high = self.first[column] + self.tree.rank(column, high)
            high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: stepped back to the next sampled one."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        at = rows.copy()
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.samples[self.count[at[done]]] + steps[todo[done]]
            todo, at = todo[~done], at[~done]
            symbol = self.tree.get(at)
            at = self.first[symbol] + self.tree.rank(symbol, at)
            steps[todo] += 1
        return out


def _windows(window: int):
    """Test texts in -> their distinct phrases, as bytes of word hashes, with the item."""

    def run(batches):
        for batch in batches:
            phrases, rows = [], []
            for chunk in chunks(batch.column("text")):
                w = words(chunk.lower(), ALNUM)
                h = w.hashes()
                for i in range(len(chunk)):
                    x = h[w.first[i] : w.first[i + 1]]
                    if len(x):
                        raw, size = x.tobytes(), 8 * min(window, len(x))
                        found = {raw[j : j + size] for j in range(0, len(raw) - size + 1, 8)}
                        phrases += found
                        rows += [chunk.first + i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.binary()), batch.column("item_id").take(pa.array(rows, pa.int64()))], ["phrase", "item_id"])

    return run


def _block(phrases: list[bytes], items: list[str | None]) -> bytes:
    """Pairs of phrase and item as a file: sorted hashes of all words; by length the distinct phrases, as places among these
    (from 1), with the items of each, one after another."""
    known = np.unique(np.frombuffer(b"".join(phrases), np.uint64))
    size, out = np.array([len(x) // 8 for x in phrases]), {"known": known}
    for k in np.unique(size).tolist():
        rows = np.flatnonzero(size == k)
        unique, owner = np.unique(np.frombuffer(b"".join(phrases[r] for r in rows), np.uint64).reshape(-1, k), axis=0, return_inverse=True)
        named = [(p, items[r]) for p, r in zip(owner.ravel().tolist(), rows.tolist(), strict=True) if items[r] is not None]
        named.sort()
        out[f"phrases_{k}"] = (np.searchsorted(known, unique) + 1).astype(np.int64)
        out[f"first_{k}"] = np.searchsorted([p for p, _ in named], np.arange(len(unique) + 1)) if named else np.zeros(len(unique) + 1, np.int64)
        out[f"items_{k}"] = np.array([x for _, x in named], np.str_)
    file = io.BytesIO()
    np.savez(file, **out)
    return file.getvalue()


def _write_blocks(path: str, limit: int):
    """Pairs in -> blocks of `limit` pairs at most in the shared folder, their names out. A repeated task writes new files."""

    def write(phrases, items):
        store, base = fs.FileSystem.from_uri(path)
        name = f"{uuid.uuid4().hex}.npz"
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(_block(phrases, items))
        return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    def run(batches):
        phrases, items = [], []
        for batch in batches:
            phrases += batch.column("phrase").to_pylist()
            items += batch.column("item_id").to_pylist()
            while len(phrases) >= limit:
                yield write(phrases[:limit], items[:limit])
                phrases, items = phrases[limit:], items[limit:]
        if phrases:
            yield write(phrases, items)

    return run


def phrase_blocks(benchmark: DataFrame, window: int = 10) -> tuple[str, list[str]]:
    """Writes the phrases of all test texts to the shared folder: where, and the names of the blocks, which are all that the
    driver gets to know."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = cut(rows.mapInArrow(_windows(window), "phrase binary, item_id string").distinct(), "phrases")
    spark = benchmark.sparkSession
    path = folder(spark, "blocks")
    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base)
    names = cut(pairs.coalesce(pairs.count() // BLOCK_PAIRS + 1).mapInArrow(_write_blocks(path, BLOCK_PAIRS), "name string"), "names")
    return path, sorted(r[0] for r in names.collect())


@functools.lru_cache(maxsize=2)
def _load(path: str, name: str) -> tuple[np.ndarray, dict]:
    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{base}/{name}") as file, np.load(io.BytesIO(file.read())) as got:
        lengths = sorted(int(x.removeprefix("phrases_")) for x in got.files if x.startswith("phrases_"))
        return got["known"], {k: (got[f"phrases_{k}"], got[f"first_{k}"], got[f"items_{k}"]) for k in lengths}


def _scan_shard(h: np.ndarray, first: np.ndarray, block: tuple[np.ndarray, dict], cover: np.ndarray, items: list[set]) -> None:
    """Word hashes of whole documents, words before each. Adds what a block finds: +1 in `cover` where an occurrence
    starts, -1 behind its end; and each document's items."""
    known, by = block
    if not len(known) or not len(h):
        return
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    symbol = np.where(known[at] == h, at + 1, 0)
    # runs of known words inside a document, long enough for the shortest phrase
    edge = np.zeros(len(h) + 1, bool)
    edge[first] = True
    inside = symbol > 0
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    keep = end - start >= min(by)
    start, end = start[keep], end[keep]
    if not len(start):
        return
    size = end - start + 1
    to = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(to, size) + np.repeat(start, size)  # of each position in the shard's words
    text = symbol[np.minimum(place, len(h) - 1)]
    text[to + size - 1] = 0
    index = FMIndex(text, len(known) + 1)
    for length, (phrases, owner, names) in by.items():
        low, high = index.search(phrases)
        found = np.flatnonzero(high > low)
        if not len(found):
            continue
        n = (high - low)[found]
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[found], n)
        where = place[index.locate(rows)]
        np.add.at(cover, where, 1)
        np.add.at(cover, where + length, -1)
        doc = np.searchsorted(first, where, "right") - 1
        for d, phrase in np.unique(np.stack((doc, np.repeat(found, n))), axis=1).T.tolist():
            items[d].update(names[owner[phrase] : owner[phrase + 1]].tolist())


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _cut_out(text: bytes, start: np.ndarray, end: np.ndarray, spans: list) -> bytes:
    """Text without the words of the spans, and without the characters between the words of a span."""
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : start[a]])
        last = end[b - 1]
    return b"".join(out) + text[last:]


def _scan(path: str, names: list[str]):
    """Rows with a text in -> each row with its hits. Documents are indexed a shard at a time, and every block is searched."""

    def shard(held, out):
        h = np.concatenate([x for _, _, x in held])
        first = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(w.first) for _, w, _ in held]))))
        cover, items = np.zeros(len(h) + 1, np.int32), [set() for _ in range(len(first) - 1)]
        for name in names:
            _scan_shard(h, first, _load(path, name), cover, items)
        hit, d = np.cumsum(cover[:-1]) > 0, 0
        for chunk, w, _ in held:
            for i in range(len(chunk)):
                a, b = first[d], first[d + 1]
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit[a:b], [False]))))
                spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
                f, o = int(w.first[i]), int(chunk.off[i])
                out["n_words"].append(int(b - a))
                out["spans"].append([{"start": x, "end": y} for x, y in spans])
                out["items"].append(sorted(items[d]))
                out["kept"].append(_cut_out(chunk.text(i), w.start[f : f + b - a] - o, w.end[f : f + b - a] - o, spans).decode() if spans else None)
                d += 1

    def run(batches):
        kinds = {"n_words": pa.int64(), "spans": _SPANS, "items": pa.list_(pa.string()), "kept": pa.string()}
        for batch in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            held, size = [], 0
            for chunk in chunks(batch.column("text")):
                w = words(chunk.lower(), ALNUM)
                h = w.hashes()
                held.append((chunk, w, h))
                size += len(h)
                if size >= SHARD_WORDS:
                    shard(held, out)
                    held, size = [], 0
            if held:
                shard(held, out)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(out[k], t) for k, t in kinds.items())], ["row", *kinds])

    return run


_FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>, kept string"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Finds every occurrence of `window` consecutive words of a test text (of a shorter one: of all its words) in `docs`.
    Words: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.

    Returns one row a row of `docs`: doc_id, row_key (hash of id and text), text, n_words, spans (hit words, merged, end
    exclusive), items (ids of the test texts as strings, ascending), kept (the text without the spans; null if none).

    Null texts, of either table, have no words. Very long texts are shards of their own, searched whole. Ties: a phrase of
    several items counts for each. A test text without item_id gives hits but no item. Null doc_id is kept. Repeated rows are
    each returned; test texts that share an id are one item. Empty documents: empty result; empty benchmark: no hits.
    Other columns, whatever their names, are not looked at.
    """
    base = id_text(docs)
    found = carry(base, _scan(*phrase_blocks(benchmark, window)), _FOUND)
    return found.select("row.doc_id", F.xxhash64("row.doc_id", "row.text").alias("row_key"), "row.text", "n_words", "spans", "items", "kept")


def _hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def report(found: DataFrame) -> DataFrame:
    """Counts and digest of what decontaminate() returns."""
    hit = _hit()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """`docs` without the words of test passages; a document of which no word is left goes. n_chars, if there, follows the text.

    Null texts stay null, empty ones stay. Very long texts are cleaned whole. Ties and repeated rows: each row by its own
    text. All columns are carried, whatever their names. Empty documents: empty result; empty benchmark: nothing changes.
    """
    names = docs.columns
    df = carry(docs, _scan(*phrase_blocks(benchmark, window)), _FOUND).where((_hit() == 0) | (_hit() < F.col("n_words")))
    out = {c: F.col(f"row.`{c}`") for c in names}
    out["text"] = F.coalesce("kept", out["text"])
    if "n_chars" in names:
        out["n_chars"] = F.when(F.col("kept").isNull(), out["n_chars"]).otherwise(F.length("kept").cast(docs.schema["n_chars"].dataType))
    return df.select(*(out[c].alias(c) for c in names))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return report(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_TOKENS = "regexp_extract_all(lower_az(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = """
WITH d AS (SELECT doc_id, TOKENS AS w FROM documents),
b AS (SELECT item_id, TOKENS AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM p),
o AS (SELECT d.doc_id, k.k, i, array_to_string(w[i : i + k.k - 1], ' ') AS phrase FROM d, k, LATERAL (SELECT unnest(range(1, len(w) - k.k + 2)) AS i) WHERE len(w) >= k.k),
m AS (SELECT o.doc_id, o.i, o.k, p.item_id FROM o JOIN p ON o.k = p.k AND o.phrase = p.phrase),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
""".replace("TOKENS", _TOKENS).replace("lower_az(coalesce(text, ''))", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
