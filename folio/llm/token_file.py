"""Token ids of documents in ORC files, written in document order and read back by stripe.

Documents are dealt by ranges of doc_id, encoded in tasks, and written as ORC: integers are run-length encoded, each stripe
has row indexes (least and greatest doc_id for each group of rows) and a Bloom filter on doc_id, so a reader takes stripes in
parallel and a look-up by doc_id skips all other row groups.

Encoding caches by piece. The tokenizer never joins characters across a single space between two visible characters, as
that space always begins a new token, nor across a letter and the punctuation after it; so a text is cut there, and each
different piece is encoded once a worker by the tokenizer itself.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm.shared import folder, id_text, table
from folio.llm.words import Chunk, chunks, piece_hashes

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Pieces that a worker keeps encoded; pieces encoded at once.
CACHE_PIECES, ENCODE_BATCH = 3 << 20, 4096
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20), "compression": "zstd"}

#: Bytes that can be a neighbour of a cut: visible ASCII, and lead bytes of characters that are never white space.
_VISIBLE = np.array([0x21 <= b <= 0x7E for b in range(256)])
_NEXT = np.array([0x21 <= b <= 0x7E or (b >= 0xC3 and b not in (0xE1, 0xE2, 0xE3)) for b in range(256)])


#: Punctuation that never joins a letter before it: no apostrophe, and nothing that stands in a special token.
_POINT = np.array([chr(b) in ".,;:!?)]}*#%&$=" for b in range(256)])
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])


def _cuts(chunk: Chunk) -> np.ndarray:
    """Where pieces start: at each text's start; at single spaces between characters that are surely not white space; at
    punctuation after a letter. A character before a space may be visible ASCII or take two bytes (lead C3 to DF), a letter
    before punctuation may be ASCII or one of U+00C0 to U+00FF; others just don't allow a cut."""
    b = chunk.buf
    ok = np.zeros(len(b) + 1, bool)
    if len(b) > 3:
        lead = (b >= 0xC3) & (b <= 0xDF)
        ends = _VISIBLE[b].copy()
        ends[1:] |= lead[:-1] & (b[1:] >= 0x80)
        ok[1 : len(b) - 1] = (b[1:-1] == 0x20) & ends[:-2] & _NEXT[b[2:]]
        letter = _LETTER[b].copy()
        letter[1:] |= (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] != 0x97) & (b[1:] != 0xB7)
        ok[1 : len(b)] |= _POINT[b[1:]] & letter[:-1]
    ok[chunk.off] = True
    return np.flatnonzero(ok)


class Encoder:
    """Encodes chunks of texts, remembering up to so many pieces in sorted arrays: some thirty bytes a piece."""

    def __init__(self, path: str, pieces: int | None = None):
        self.pieces = pieces
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes, and which piece each is
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)  # ids of the pieces

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        size, flat = [], array("I")
        for i in range(0, len(texts), ENCODE_BATCH):
            for got in self.tokenizer.encode_batch_fast(texts[i : i + ENCODE_BATCH], add_special_tokens=False):
                ids = got.ids
                size.append(len(ids))
                flat.extend(ids)
        at = np.searchsorted(self.known, hashes)
        self.place = np.insert(self.place, at, np.arange(len(hashes), dtype=np.int32) + len(self.known))
        self.known = np.insert(self.known, at, hashes)
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(size)))
        self.flat = np.concatenate((self.flat, np.array(flat, np.uint32)))

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids start (one more at the end)."""
        cut = _cuts(chunk)
        start, end = cut[:-1], cut[1:]
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(chunk) + 1, np.int64)
        if len(self.known) > (self.pieces or CACHE_PIECES):
            self._forget()
        hashes, at, back = np.unique(piece_hashes(chunk, start, end), return_index=True, return_inverse=True)
        found = np.searchsorted(self.known, hashes)
        new = np.flatnonzero(self.known[np.minimum(found, len(self.known) - 1)] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(new):
            raw = chunk.buf.tobytes()
            self._learn(hashes[new], [raw[i:j].decode() for i, j in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)])
            found = np.searchsorted(self.known, hashes)
        k = self.place[found][back]
        size = (self.first[1:] - self.first[:-1])[k]
        upto = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.arange(upto[-1]) + np.repeat(self.first[k] - upto[:-1], size)]
        return ids, upto[np.searchsorted(start, chunk.off)]


@functools.cache
def _encoder(path: str, pieces: int | None = None) -> Encoder:
    """One for each worker process, which serves many tasks."""
    return Encoder(path, pieces)


def _encode(path: str, end_id: int):
    def run(batches):
        position = 0
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                ids, first = _encoder(path).encode(chunk)
                n = np.diff(first)
                # room for the end id after each text
                out = np.full(len(ids) + len(n), end_id, np.int32)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids.view(np.int32)
                off = np.concatenate(([0], np.cumsum(n + 1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, len(chunk)), pa.array(position + off[:-1]), pa.array(n + 1), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(out))],
                    ["doc_id", "part_start", "n_tokens", "ids"],
                )
                position += int(off[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes one row a row of `docs` under `path`, ascending by doc_id (null first; of one id, by text): part (number of the
    range), doc_id, part_start (ids before it in its range), n_tokens, ids.

    Null text: encoded as the empty text, which gives the end id alone. Very long texts are encoded whole, piece by piece.
    Ties and repeated rows are each written, in the order of their texts. Empty table: no rows. Other columns, whatever
    their names, are not looked at.
    """
    rows = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    coded = rows.mapInArrow(_encode(tokenizer or public_tokenizers.path(TOKENIZER), end_id), "doc_id long, part_start long, n_tokens long, ids array<int>")
    coded.withColumn("part", F.spark_partition_id()).write.options(**ORC).orc(path)


def read_tokens(spark, path: str) -> DataFrame:
    """What write_tokens() wrote: doc_id, start (ids of all documents before it), n_tokens, ids."""
    files = spark.read.schema("doc_id long, part_start long, n_tokens long, ids array<int>, part int").orc(path)
    # one row a range: counts and places are read from small columns alone
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return files.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def find_tokens(spark, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents: the filter reaches the files, where indexes and Bloom filters skip what can't match."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").orc(path).where(F.col("doc_id").isin(doc_ids))


def _checksums(batches):
    for batch in batches:
        ids = batch.column("ids")
        flat, off = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        n = pa.array(np.diff(off).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), n, pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op7_token_file(spark, sf_dir: str) -> DataFrame:
    path = folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
