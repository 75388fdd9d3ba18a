"""Vectorised words and hashes over Arrow string columns, used inside Spark tasks.

Texts of a batch are taken as one byte buffer and cut at ASCII bytes, so a multi-byte character is never
split. Hashes are polynomial prefix hashes modulo 2**64, finished by a mixing step: the hash of a run
of words depends only on the words, never on the batch, the process or the machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a single longer text is handled alone.
CHUNK_BYTES = 1 << 20

_BASE_BYTE = 0x9E3779B97F4A7C15
_BASE_WORD = 0xD6E8FEB86659FD93


def _lut(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = _lut(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing A-Z
ALNUM = _lut(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finisher of 64-bit hashes: every input bit reaches every output bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = (max(n, len(self.up) * 5 // 4) + 0xFFFF) >> 16 << 16
            self.up, self.down = (np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE_BYTE), _Powers(_BASE_WORD)


def _prefix(values: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * down[: len(values)], out=sums[1:])
    return sums, up


@dataclass
class Chunk:
    """Some whole texts of a batch: rows `first` to `first + len(off) - 1`, bytes `buf[off[i]:off[i+1]]`."""

    first: int
    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    def lower(self) -> Chunk:
        return Chunk(self.first, _LOWER[self.buf], self.off)

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column (null: empty text) into chunks of about `limit` bytes of whole texts."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield Chunk(i, buf[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


@dataclass
class Words:
    """Words of a chunk: `start`, `end` in bytes; text i has words `first[i]` to `first[i+1]`."""

    chunk: Chunk
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        sums, up = _prefix(self.chunk.buf.astype(np.uint64) + np.uint64(1), _BYTES)
        return mix((sums[self.end] - sums[self.start]) * up[self.start] + (self.end - self.start).astype(np.uint64))


def words(chunk: Chunk, lut: np.ndarray = NOT_SPACE) -> Words:
    inside = lut[chunk.buf]
    edge = np.empty(len(inside), bool)
    edge[1:] = inside[1:] & ~inside[:-1]
    edge[:1] = inside[:1]
    heads = chunk.off[:-1][np.diff(chunk.off) > 0]
    edge[heads] = inside[heads]
    start = np.flatnonzero(edge)
    last = np.empty(len(inside), bool)
    last[:-1] = inside[:-1] & ~inside[1:]
    last[-1:] = inside[-1:]
    tails = heads[1:] - 1
    last[tails] = inside[tails]
    end = np.flatnonzero(last) + 1
    return Words(chunk, start, end, np.searchsorted(start, chunk.off))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values; empty if there are fewer."""
    n = len(hashes) - k + 1
    return stretches(hashes, slice(0, n), slice(k, k + n), k) if n > 0 else np.zeros(0, np.uint64)


def stretches(hashes: np.ndarray, start, end, size=None) -> np.ndarray:
    """Hash of the values from each start to each end."""
    sums, up = _prefix(hashes, _WORDS)
    return mix((sums[end] - sums[start]) * up[start] + np.asarray(end - start if size is None else size).astype(np.uint64))


def whole(hashes: np.ndarray) -> np.uint64:
    """Hash of the whole sequence."""
    return runs(hashes, len(hashes))[0] if len(hashes) else np.uint64(0)


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text; of its whole sequence, if it has fewer words."""
    return np.unique(runs(hashes, min(k, max(1, len(hashes)))))


def piece_hashes(chunk: Chunk, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte stretches of a chunk."""
    return Words(chunk, start, end, chunk.off).hashes()
