"""Interpolated modified Kneser-Ney language model of words, of order 2 or more, counted in Spark.

Counts: tasks count in numpy, and hand on sorted keys packed by hash bucket; a bucket's task merges them into sorted arrays
and writes these as plain files in the shared folder. Word ids are places in the sorted array of word hashes, so a
word pair is one integer, `first * words + second`, and packs to a few bytes. Pairs go to buckets by a hash of both words:
a word before a third of all others is spread over all buckets, and its statistics are summed from these.

Scoring: workers map the files into memory and look batches of sorted keys up by binary search. The system pages in what is
asked for, and no worker holds a copy. Where the shared folder is not a local path, a worker copies each file when it first needs it.

Longer runs are built up in the same way: a run of k words has the key `id of the first k - 1 * words + last`, and its id is its
place among sorted keys. Texts begin with order - 1 starts. Lower orders count how many different words come before a run.

Most counts are small, so counts and sums take a byte each, and rows with a greater one stand in full in a file beside them.
A step's shuffle files go when it ends, since what it counted is written by then.
"""

from __future__ import annotations

import functools
import mmap
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import folder, id_text, partitions, table, tidy
from folio.llm.words import Chunk, chunks, mix, words

#: Stands for the end of a text; in the place of a word's hash.
END = np.uint64(0x5D1F00D5EED0E1D5)
#: Words of the longest run, where none is given: two words of context.
ORDER = 3
#: Tokens for each bucket of longer runs, so that what a task merges stays as it is when the corpus grows.
BUCKET_RUNS = 1 << 19
#: Keys that a task holds before it hands their counts on.
FLUSH = 1 << 20
CHUNK = 2 << 20
#: Rows of sums that meet in one group, about, as far as there are buckets to deal them to.
GROUP_SUMS = 1 << 20
#: Files that a worker keeps mapped; Linux lets a process have some 65,000 maps.
MAPS = 40_000


def trained(doc_id) -> F.Column:
    """Rows that the model learns from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 1


# ---- packed counts


def _by_bucket(bucket: np.ndarray) -> np.ndarray:
    """Stable order by bucket; numpy sorts 16 bits by radix."""
    small = len(bucket) and bucket.min() >= 0 and bucket.max() < 1 << 16
    return np.argsort(bucket.astype(np.uint16) if small else bucket, kind="stable")


def _pack(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """Distinct keys with counts (a row each) by bucket: keys as differences, both by byte place, which compresses well."""
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, counts, bucket = keys[order], counts[order], bucket[order]
    order = _by_bucket(bucket)
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    cuts = np.concatenate((np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]))
    planes = lambda x: np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()
    out = [(int(bucket[i]), planes(np.diff(keys[i:j], prepend=keys[:1] * 0)), planes(counts[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "keys", "counts"])


_PACKED = "bucket int, keys binary, counts binary"


def _merge(part: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Blobs of a bucket -> sorted distinct keys (uint64), sums of their `width` counts."""
    whole = lambda x, dtype, w: np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(dtype).itemsize * w, -1).T).view(dtype).reshape(-1, w)
    keys = np.concatenate([np.cumsum(whole(x, np.uint64, 1).ravel(), dtype=np.uint64) for x in part["keys"].to_pylist()])
    counts = np.concatenate([whole(x, np.uint32, width) for x in part["counts"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first, dtype=np.int64)


# ---- files


def _write(path: str, name: str, values: np.ndarray) -> None:
    """Under a name of its own, then renamed: a repeated or lost task leaves no half file."""
    store, base = fs.FileSystem.from_uri(path)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    store.move(part, f"{base}/{name}")


def _mapped(file, dtype: str) -> np.ndarray:
    """Without a file descriptor, where Python can: there are more files than a process may have open."""
    return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {})), dtype)


@functools.lru_cache(MAPS)
def _map(path: str, name: str, dtype: str) -> np.ndarray:
    """A file of the model, which has to be there: callers ask only for what the driver knows to be written. From another
    store it is copied when first asked for, into a nameless file that ends with the worker."""
    if urlparse(path).scheme in ("", "file"):
        with open(os.path.join(urlparse(path).path, name), "rb") as file:
            return _mapped(file, dtype) if os.fstat(file.fileno()).st_size else np.zeros(0, dtype)
    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{base}/{name}", compression=None) as source, tempfile.TemporaryFile() as to:
        shutil.copyfileobj(source, to, 1 << 20)
        to.flush()
        return _mapped(to, dtype) if to.tell() else np.zeros(0, dtype)


def _write_counts(path: str, name: str, values: np.ndarray) -> None:
    """Rows of counts, a byte each; rows with one of 255 or more stand in full in a second file, with their places."""
    big = np.flatnonzero((values >= 255).any(axis=1))
    _write(path, name, np.minimum(values, 255).astype(np.uint8))
    _write(path, f"{name}-more", np.column_stack((big, values[big])).astype(np.int64))


def _counts(path: str, name: str, width: int, rows: np.ndarray | None = None) -> np.ndarray:
    """All rows of counts of a file, or some."""
    small, more = _map(path, name, "u1").reshape(-1, width), _map(path, f"{name}-more", "i8").reshape(-1, width + 1)
    some = small if rows is None else small[rows]
    out, full = some.astype(np.int64), some == 255
    if full.any():
        big = np.flatnonzero(full.any(axis=1))
        out[big] = more[np.searchsorted(more[:, 0], big if rows is None else rows[big]), 1:]
    return out


def _bits(before: tuple[int, ...]) -> int:
    """log2 of the number of buckets."""
    return (len(before) - 1).bit_length() - 1


@dataclass(frozen=True)
class Model:
    """What the driver knows of a model: where its files are, and sums."""

    path: str
    before: tuple[int, ...]  # words in earlier buckets
    words: int
    tokens: int
    order: int = 3
    grams: tuple[tuple[int, ...], ...] = ()  # runs of 2, 3 and more words in earlier buckets
    discounts: tuple[tuple[float, ...], ...] = ()  # of runs of 2, 3 and more words: of values 1, 2, 3 and more; [0] is for none
    lower: tuple[float, ...] = (0.0,) * 4  # of words that follow 1, 2, 3 and more words
    pairs: int = 0  # different ones
    lower_rest: float = 1.0  # share of the lowest order that goes to all words alike

    @property
    def discount(self) -> tuple[float, ...]:
        return self.discounts[-1] if self.discounts else (0.0,) * 4

    def shift(self, k: int) -> int:
        """Sums of words are gathered for so many buckets (log2) at once, those of longer runs for one: they are many more.
        A pair of words gives two rows of sums at most."""
        bits = _bits(self.places(k))
        return max(0, min((bits - 1) // 2, bits - (2 * self.places(2)[-1] // GROUP_SUMS).bit_length())) if k == 1 else 0

    def places(self, k: int) -> tuple[int, ...]:
        """Runs of k words in earlier buckets. The last number is the id of k text starts, behind all runs."""
        return self.before if k == 1 else self.grams[k - 2]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words, -1 for unknown ones."""
        return self._find("words", self.before, hashes, lambda x: x)

    def find(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Ids of runs of k words, -1 for unknown ones."""
        return self._find(f"grams{k}", self.places(k), keys.astype(np.uint64), mix)

    def _find(self, name: str, before: tuple[int, ...], keys: np.ndarray, hashed) -> np.ndarray:
        found, back = self._find_once(name, before, keys, hashed)
        return found[back]

    def find_once(self, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the different ones among runs of k words, -1 for unknown ones, and which of them each run is."""
        if k == 1:
            return self._find_once("words", self.before, keys, lambda x: x)
        return self._find_once(f"grams{k}", self.places(k), keys.astype(np.uint64), mix)

    def _find_once(self, name: str, before: tuple[int, ...], keys: np.ndarray, hashed) -> tuple[np.ndarray, np.ndarray]:
        unique, back = np.unique(keys, return_inverse=True)
        bucket = hashed(unique) >> np.uint64(64 - _bits(before))
        order = _by_bucket(bucket)
        edges = np.searchsorted(bucket[order], np.arange(len(before)).astype(bucket.dtype))
        out = np.full(len(unique), -1, np.int64)
        for b in np.flatnonzero(np.diff(edges)):
            rows = order[edges[b] : edges[b + 1]]
            if before[b + 1] > before[b]:
                known = _map(self.path, f"{name}-{b:05d}", "u8")
                at = np.minimum(np.searchsorted(known, unique[rows]), len(known) - 1)
                out[rows] = np.where(known[at] == unique[rows], before[b] + at, -1)
        return out, back

    def by_id(self, k: int, name: str, ids: np.ndarray, width: int = 1) -> np.ndarray:
        """Rows of counts that are laid out by id of runs of k words, in files of their buckets."""
        return self._by_id(k, ids, width, lambda b, rows: _counts(self.path, f"{name}-{b:05d}", width, rows))

    def keys(self, k: int, ids: np.ndarray) -> np.ndarray:
        """Keys of runs of k words."""
        return self._by_id(k, ids, 1, lambda b, rows: _map(self.path, f"grams{k}-{b:05d}", "u8")[rows].astype(np.int64).reshape(-1, 1))[:, 0]

    def _by_id(self, k: int, ids: np.ndarray, width: int, read) -> np.ndarray:
        out = np.zeros((len(ids), width), np.int64)
        before = np.array(self.places(k))
        bucket = np.searchsorted(before, ids, "right") - 1
        order = _by_bucket(bucket)
        edges = np.searchsorted(bucket[order], np.arange(len(before) + 1))
        for b in np.flatnonzero(np.diff(edges)):
            rows = order[edges[b] : edges[b + 1]]
            out[rows] = read(b, ids[rows] - before[b])
        return out

    def after(self, k: int, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each token the id of the k words before it, from the ids of the k words that end at each."""
        out = np.concatenate(([self.places(k)[-1]], ids[:-1]))
        out[first[:-1]] = self.places(k)[-1]
        return out

    def without_first(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Ids of the last k - 1 words of runs of k."""
        before, last = keys // self.words, keys % self.words
        if k == 2:
            return last
        middle = np.full(len(keys), self.places(k - 2)[-1], np.int64)
        inner = before < self.places(k - 1)[-1]
        middle[inner] = self.without_first(k - 1, self.keys(k - 1, before[inner]))
        return self.find(k - 1, middle * self.words + last)


def _tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a chunk, an end after each text's words; where each text starts."""
    w = words(chunk.lower())
    n = np.diff(w.first)
    out = np.full(len(w.start) + len(n), END, np.uint64)
    out[np.arange(len(w.start)) + np.repeat(np.arange(len(n)), n)] = w.hashes()
    return out, w.first + np.arange(len(n) + 1)


def _count(model: Model | None, bits: int, k: int = 1):
    """Counts words (model: None), or runs of k: the id of all but the last word, and the last word's."""

    def pack(held):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return _pack(keys, n.astype(np.uint32).reshape(-1, 1), ((keys if model is None else mix(keys)) >> np.uint64(64 - bits)).astype(np.int64))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for chunk in chunks(batch.column("text"), CHUNK):
                keys, first = _tokens(chunk)
                if model is not None:
                    ids = runs = model.ids(keys)
                    for j in range(2, k + 1):
                        runs = runs if j == 2 else model.find(j - 1, keys)
                        keys = model.after(j - 1, runs, first) * model.words + ids
                    keys = keys.astype(np.uint64)
                held.append(keys)
                size += len(keys)
                if size >= FLUSH:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    return run


def _narrow(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows of sums of 64 bits -> keys and rows of 32 bits that add up to these: what a row can't hold stands in
    further rows of its key."""
    most = (1 << 32) - 1
    out, rest = [(keys, np.minimum(sums, most))], np.maximum(sums - most, 0)
    while (at := np.flatnonzero(rest.any(axis=1))).size:
        keys, rest = keys[at], rest[at]
        out.append((keys, np.minimum(rest, most)))
        rest = np.maximum(rest - most, 0)
    return np.concatenate([k for k, _ in out]), np.concatenate([n for _, n in out]).astype(np.uint32)


def _write_keys(path: str, name: str, counts: str | None):
    """Writes a bucket's sorted keys, and their counts if these have a name."""

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        b = key[0].as_py()
        keys, n = _merge(part, 1)
        _write(path, f"{name}-{b:05d}", keys)
        if counts:
            _write_counts(path, f"{counts}-{b:05d}", n)
        return pa.table({"bucket": pa.array([b], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(n.sum())], pa.int64())})

    return run


def _sums(model: Model, k: int):
    """Of buckets of runs of k words: counts of counts (bucket -1), and for each run of k - 1 words how many different runs of
    value 1, 2 and more it begins, how many it ends, and the sum of values of those it begins (by group of buckets: far
    fewer than buckets). The value is the count for the highest order; else how many different words come before."""

    def run(batches):
        before, held, size = np.array(model.places(k - 1)), [], 0
        times = np.zeros(5, np.uint64)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                many = model.places(k)[b + 1] - model.places(k)[b]
                if not many:
                    continue
                keys = np.array(_map(model.path, f"grams{k}-{b:05d}", "u8")).astype(np.int64)
                n = _counts(model.path, f"gram_counts-{b:05d}", 1)[:, 0] if k == model.order else _counts(model.path, f"sums{k}-{b:05d}", 5)[:, 3]
                ids = np.concatenate((keys // model.words, model.without_first(k, keys)))
                seen, back = np.unique(ids, return_inverse=True)
                sums = np.bincount(back * 5 + np.concatenate((np.minimum(n, 3) - 1, np.full(many, 3))), minlength=5 * len(seen)).reshape(-1, 5)
                sums[:, 4] = np.bincount(back[:many], n, len(seen))  # exact: fewer tokens than 2^53
                held.append(_narrow(seen.astype(np.uint64), sums))
                size += len(seen)
                times += np.array([*(int((n == x).sum()) for x in (1, 2, 3, 4)), many], np.uint64)
                if size >= FLUSH // 2:
                    yield pack(held, before)
                    held, size = [], 0
        if size:
            yield pack(held, before)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([times.tobytes()], pa.binary()), pa.array([b""], pa.binary())], ["bucket", "keys", "counts"])

    def pack(held, before):
        keys, sums = (np.concatenate(x) for x in zip(*held, strict=True))
        return _pack(keys, sums, np.searchsorted(before, keys, "right") - 1 >> model.shift(k - 1))

    return run


def _write_sums(model: Model, k: int):
    """Sums by id of runs of k words, laid out densely; gives out counts of counts of the runs that these end. Rows are added
    blob by blob: a group's words grow far slower than the rows of sums that tasks have for them."""
    before = np.array((*model.places(k), model.places(k)[-1] + 1))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, out = key[0].as_py(), np.zeros(5, np.int64)
        if g < 0:
            for batch in batches:
                out += np.sum([np.frombuffer(x, np.int64) for x in batch["keys"].to_pylist()], axis=0)
        else:
            buckets = range(g << model.shift(k), min((g + 1) << model.shift(k), len(before) - 1))
            start = before[buckets[0]]
            dense = np.zeros((before[buckets[-1] + 1] - start, 5), np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, sums = _merge(batch.slice(i, 1), 5)
                    dense[ids.astype(np.int64) - start] += sums
            for b in buckets:
                part = dense[before[b] - start : before[b + 1] - start]
                _write_counts(model.path, f"sums{k}-{b:05d}", part)
                out += [*(int((part[:, 3] == x).sum()) for x in (1, 2, 3, 4)), int(part[:, 3].sum())]
        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([[int(x) for x in out]], pa.list_(pa.int64()))], ["bucket", "times"])

    return run


def discounts(n: list[int]) -> tuple[float, float, float, float]:
    """From the numbers of keys seen 1, 2, 3 and 4 times; one half where these can't tell."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and y else 0.5 for k in (1, 2, 3)]
    return 0.0, *(float(min(max(x, 0.0), k)) for k, x in zip((1, 2, 3), d, strict=True))


def train(docs: DataFrame, path: str, order: int = ORDER) -> Model:
    """Counts all rows of `docs` and writes a model of runs of up to `order` (2 or more) words under `path`, which all machines
    reach. Each order takes one more pass over the texts. Only sums by bucket reach the driver.

    A run's key is a number of 63 bits: (different runs of order - 1 words + 1) * different words has to stay below 2^63
    (for order 3, say, 10^9 words with 9 * 10^9 pairs of them); a larger corpus raises ValueError before the order is counted.

    Null texts are the end alone. Very long texts are counted whole. Repeated rows count as often as they are there. Empty
    table: a model of nothing. Other columns, whatever their names, are not looked at."""
    with tidy(docs.sparkSession):
        return _train(docs, path, order)


def _train(docs: DataFrame, path: str, order: int) -> Model:
    if order < 2:
        raise ValueError("order: 2 or more")
    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base)
    spark = docs.sparkSession
    bits = min(16, max(1, (2 * partitions(spark) - 1).bit_length()))
    texts = id_text(docs).select("text")

    def count(model: Model | None, k: int, bits: int, *names) -> tuple[tuple[int, ...], int]:
        rows = {r["bucket"]: r for r in texts.mapInArrow(_count(model, bits, k), _PACKED).groupBy("bucket").applyInArrow(_write_keys(path, *names), "bucket int, n long, total long").collect()}
        size = [rows[b]["n"] if b in rows else 0 for b in range(1 << bits)]
        return tuple(int(x) for x in np.concatenate(([0], np.cumsum(size)))), sum(r["total"] for r in rows.values())

    before, tokens = count(None, 1, bits, "words", "counts")
    model = Model(path, before, before[-1], tokens, order)
    bits = max(1, (tokens // BUCKET_RUNS).bit_length())
    if not tokens:
        return model
    for k in range(2, order + 1):
        if (model.places(k - 1)[-1] + 1) * model.words >= 1 << 63:
            raise ValueError(f"runs of {k} words: ids do not fit 64 bits")
        model = replace(model, grams=(*model.grams, count(model, k, bits, f"grams{k}", "gram_counts" if k == order else None)[0]))
    for k in range(order, 1, -1):  # what a lower order counts are the runs of the next higher one
        sums = spark.range(0, 1 << bits, 1, min(1 << bits, max(partitions(spark), 1 << max(0, bits - 3)))).mapInArrow(_sums(model, k), _PACKED)
        times = {r["bucket"]: r["times"] for r in sums.groupBy("bucket").applyInArrow(_write_sums(model, k - 1), "bucket int, times array<long>").collect()}
        model = replace(model, discounts=(discounts(times.pop(-1)[:4]), *model.discounts))
    of_words = np.sum(list(times.values()), axis=0).tolist()
    lower = discounts(of_words[:4])
    n = [*of_words[:2], model.words - of_words[0] - of_words[1]]
    return replace(model, lower=lower, pairs=of_words[4], lower_rest=sum(x * y for x, y in zip(lower[1:], n, strict=True)) / of_words[4])


def log_probabilities(model: Model, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts (where each starts in `first`) -> log10 probabilities, and those of the base; which are known."""
    ids, back = model.find_once(1, hashes)
    flat = model.lower_rest / (model.words + 1)
    once = np.full(len(ids), flat)  # what a word has by itself is computed once a word
    count, met = np.zeros(len(ids), np.int64), ids >= 0
    share, total = np.zeros(len(ids)), np.zeros(len(ids), np.int64)  # of what follows a run: what goes to lower orders, and all

    def follows(k: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return sums[:, :3] @ np.array(model.discounts[k - 1])[1:] / np.maximum(sums[:, 4], 1), sums[:, 4]

    if model.tokens:
        sums = model.by_id(1, "sums1", ids[met], 5)
        ends = sums[:, 3]
        once[met] += (ends - np.array(model.lower)[np.minimum(ends, 3)]) / model.pairs
        count[met] = model.by_id(1, "counts", ids[met])[:, 0]
        share[met], total[met] = follows(1, sums)
    base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.words + 1)))[back]
    p, ids, known, share, total = once[back], ids[back], met[back], share[back], total[back]
    runs = ids
    for k in range(2, model.order + 1 if model.tokens and len(ids) else 0):
        lower, discount = p.copy(), np.array(model.discounts[k - 2])
        before = model.after(k - 1, runs, first)
        start = follows(k - 1, model.by_id(k - 1, f"sums{k - 1}", np.array([model.places(k - 1)[-1]]), 5))
        share, total = (np.concatenate((x[:1], x[:-1])) for x in (share, total))
        share[first[:-1]], total[first[:-1]] = start[0][0], start[1][0]
        at = np.flatnonzero(before >= 0)
        p[at] = share[at] * lower[at]
        both = at[known[at]]
        found, back = model.find_once(k, before[both] * model.words + ids[both])
        met = found >= 0
        n = np.zeros(len(found), np.int64)
        follow = np.zeros(len(found)), np.zeros(len(found), np.int64)
        if k == model.order:
            n[met] = model.by_id(k, "gram_counts", found[met])[:, 0]
        else:
            sums = model.by_id(k, f"sums{k}", found[met], 5)
            n[met] = sums[:, 3]
            follow[0][met], follow[1][met] = follows(k, sums)
        seen = met[back]
        p[both[seen]] += (n - discount[np.minimum(n, 3)])[back[seen]] / total[both[seen]]
        nothing = at[share[at] == 0]  # words never followed by another
        p[nothing] = np.where(p[nothing] > 0, p[nothing], lower[nothing])
        runs, share, total = np.full(len(ids), -1, np.int64), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        runs[both], share[both], total[both] = found[back], follow[0][back], follow[1][back]
    return np.log10(p), base, known


def _score(model: Model):
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text"), CHUNK):
                hashes, first = _tokens(chunk)
                score, base, known = log_probabilities(model, hashes, first)
                total = lambda x: np.add.reduceat(x, first[:-1])  # noqa: B023, E731  every text has a token
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, len(chunk)), pa.array(np.diff(first)), pa.array(total(known.astype(np.int64))), pa.array(total(base)), pa.array(total(score))],
                    names,
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores each row of `docs`: doc_id, n_tokens (words and an end), n_known (met in training), base_score (log10 of the
    add-a-half unigram probability), score (log10 probability), perplexity (by token).

    Null text: the end alone. Null doc_id is kept. Very long texts are scored whole. Ties: equal texts have equal scores.
    Repeated rows are each returned. Empty table: empty result. A model of nothing gives every token probability 1. Other
    columns, whatever their names, are not looked at.
    """
    got = id_text(docs).mapInArrow(_score(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return got.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op9_kneser_ney(spark, sf_dir: str, order: int = ORDER) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(trained(F.col("doc_id").cast("long"))), folder(spark, "model"), order)
    return score(docs, model).select("doc_id", (~trained(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
