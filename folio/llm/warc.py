"""WARC archives compressed record by record with a shared Zstandard dictionary.

The dictionary is built from archived records and embedded in a leading skippable frame of each file, so a file explains
itself; each record is a frame of its own, so any record can be read by its offset. Payloads seen before are written as
revisit records that name the record they repeat.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import cut, folder, table

#: Fixed values of the format: the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: Records that the dictionary is built from, and characters of each, at most.
SAMPLE_RECORDS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 8192, 64 << 10
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 0
#: Rows and payload bytes of an archive file, about.
FILE_ROWS, FILE_BYTES = 10_000, 16 << 20
#: Bytes of an archive that are read at once; bytes that a reading task gets, where there are many more slices than cores.
SLICE_BYTES, TASK_BYTES = 1 << 20, 64 << 20
LEVEL = 6
#: One date for all records, so that writing again gives the same bytes.
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(row: dict, payload: bytes) -> bytes:
    """A response record, or a revisit record if refers_to is given, uncompressed."""
    revisit = row["refers_to"] is not None
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = status if revisit else status + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, row['record'])}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in row["url"]))
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {row['refers_to']}"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict, bytes]:
    """A record -> its fields (lower-case names) and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _store(path: str):
    return fs.FileSystem.from_uri(path)


def _write_file(path: str, name: str, dictionary: bytes, rows: Iterator[tuple[dict, bytes]]) -> list[tuple]:
    """Writes an archive under a name of its own and renames it: a repeated or lost task leaves no half file behind."""
    store, base = _store(path)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
    at, index = 0, []
    with store.open_output_stream(part, compression=None) as out:
        if dictionary:
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
            at = 8 + len(dictionary)
        for row, payload in rows:
            frame = compressor.compress(record(row, payload))
            out.write(frame)
            index.append((name, at, len(frame), row["page_id"]))
            at += len(frame)
    store.move(part, f"{base}/{name}")
    return index


_INDEX = {"file": pa.string(), "offset": pa.int64(), "length": pa.int64(), "page_id": pa.int64()}


def _archive(path: str, dictionary):
    def rows(batches):
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "record")}
            for x in zip(*columns.values(), strict=True):
                row = dict(zip(columns, x, strict=True))
                yield row, (row.pop("html") or "").encode()

    def run(batches):
        from pyspark import TaskContext

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name = f"part-{TaskContext.get().partitionId():06d}.warc.zst"
        index = _write_file(path, name, dictionary.value, rows(x for y in ([first], batches) for x in y))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), _INDEX.values(), strict=True)], list(_INDEX))

    return run


def _payloads(pages: DataFrame) -> DataFrame:
    """`pages` with the columns that are archived, and the payload's hash and size."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    return rows.withColumns({"sha": F.sha1("html"), "bytes": F.octet_length("html")})


def deduplicated(pages: DataFrame, least: int = LEAST_REVISIT, narrow: DataFrame | None = None) -> DataFrame:
    """`pages` (page_id, url, html) with sha, refers_to and record (a name for the record id). Of pages with equal payloads
    of at least `least` bytes, the others refer to that with the smallest page_id. `narrow`: page_id, sha and bytes of all
    pages, where a table of them is there."""
    rows = _payloads(pages)
    small = (rows if narrow is None else narrow).select("page_id", "sha", "bytes").where(F.col("bytes") >= least)
    # digests that repeat, pre-aggregated; joined to narrow rows, then to pages by id
    first = cut(small.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"), "first")
    later = cut(small.join(first, "sha").where("page_id > first").select("page_id", "sha", F.col("first").alias("refers_to")).distinct(), "later")
    rows = rows.join(later, ["page_id", "sha"], "left")
    return rows.select("page_id", "url", "html", F.col("sha"), "refers_to", F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "sha", "url").alias("record"))


def _base32(batches):
    for batch in batches:
        sha = pa.array([base64.b32encode(bytes.fromhex(x)).decode() for x in batch.column("sha").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "html")), sha, batch.column("refers_to"), batch.column("record")], ["page_id", "url", "html", "digest", "refers_to", "record"])


def build_dictionary(pages: DataFrame) -> bytes:
    """From a bounded sample of records, those of the least payload hashes. Too few or too short ones: no dictionary."""
    # hashes alone are ordered first, so that no more than one sample of payloads is moved
    hashed = pages.select(F.left(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(SAMPLE_CHARS)).alias("html"), F.xxhash64("page_id", "url").alias("h"))
    last = hashed.select("h").orderBy("h").limit(SAMPLE_RECORDS).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    sample = hashed.where(F.col("h") <= last).limit(SAMPLE_RECORDS).select("html").orderBy("html")
    samples = [record({"refers_to": None, "record": str(i), "digest": digest(x.encode()), "url": "http://example.com/", "page_id": i}, x.encode()) for i, x in enumerate(r["html"] for r in sample.collect())]
    if len(samples) < 8 or sum(map(len, samples)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:  # samples that have nothing in common
        return b""


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record for each row of `pages` under `path`, a folder that all machines reach, and returns the index:
    file, offset, length, page_id.

    Null html: an empty payload. Null url: a record without target. Null page_id: written as a response and never referred
    to. Very long html: one record, whole. Repeated rows and ties: each is written; equal payloads under one page_id are all
    responses. Empty table: no file. Other columns, whatever their names, are not looked at.
    """
    spark = pages.sparkSession
    store, base = _store(path)
    store.create_dir(base)
    dictionary = spark.sparkContext.broadcast(build_dictionary(pages))
    narrow = cut(_payloads(pages).select("page_id", "sha", "bytes"), "payloads")
    count, size = narrow.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    rows = deduplicated(pages, least, narrow)
    files = max(1, -(-count // FILE_ROWS), -(-size // FILE_BYTES))
    dealt = rows.repartition(files, F.xxhash64("page_id", "url")).sortWithinPartitions("page_id", "record")
    coded = dealt.mapInArrow(_base32, "page_id long, url string, html string, digest string, refers_to long, record string")
    return cut(coded.mapInArrow(_archive(path, dictionary), "file string, offset long, length long, page_id long"), "index")


def frames(store, name: str, size: int = 4 << 20, start: int = 0, end: int | None = None) -> Iterator[bytes]:
    """Records of an archive, one after another, read in pieces; or those of a slice, which begins and ends with a record."""
    with store.open_input_file(name) as file:
        head, data, body = file.read(8), None, 0
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
            body = struct.unpack("<I", head[4:])[0]
            data = zstandard.ZstdCompressionDict(file.read(body))
            body += 8
        at = max(start, body)
        file.seek(at)
        decompressor = zstandard.ZstdDecompressor(dict_data=data)
        one, out = decompressor.decompressobj(), []
        while left := file.read(size if end is None else min(size, end - at)):
            at += len(left)
            while left:
                out.append(one.decompress(left))
                left = b""
                if one.eof:
                    left = one.unused_data
                    yield b"".join(out)
                    one, out = decompressor.decompressobj(), []


def _read(path: str):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        store, base = _store(path)
        for slices in batches:
            for name, start, end in zip(*(slices.column(c).to_pylist() for c in ("file", "start", "end")), strict=True):
                rows, size = [], 0
                for raw in frames(store, f"{base}/{name}", start=start, end=end):
                    f, payload = parse(raw)
                    number = lambda k, f=f: int(f[k]) if k in f else None
                    if f["warc-type"] == "response":
                        n, d = len(payload), digest(payload)
                        if f"sha1:{d}" != f["warc-payload-digest"]:
                            raise ValueError(f"{name}: a payload differs from its digest")
                    else:
                        n, d = number("x-payload-length"), f["warc-payload-digest"].removeprefix("sha1:")
                    rows.append((number("x-page-id"), n, d, f["warc-type"], number("x-refers-to-page-id"), f.get("warc-target-uri"), payload))
                    size += len(payload)
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_archives(index: DataFrame, path: str) -> DataFrame:
    """All records of the archives of an index: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.
    Digest and length of a revisit are those of the full payload, as its record states them.

    Archives are read in slices that the index gives, so a large one is read by several tasks. Repeated rows of the index are
    read once; an empty index gives no rows."""
    each = index.groupBy("file", F.floor(F.col("offset") / SLICE_BYTES).alias("slice")).agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"))
    slices = cut(each, "slices")
    count, size = slices.agg(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()
    tasks = max(1, min(count, max(4 * index.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)))
    dealt = slices.repartitionByRange(tasks, "file", "start")
    return dealt.mapInArrow(_read(path), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = folder(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BITS = " + ".join(f"{16 >> k} * CAST(substr(b, CAST(5 * i + {k + 1} AS BIGINT), 1) AS INT)" for k in range(5))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS b, min(page_id) OVER (PARTITION BY h) AS low FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BITS}, 1)), '') AS payload_digest,
  CASE WHEN page_id > low THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > low THEN low END AS refers_to FROM q
"""
