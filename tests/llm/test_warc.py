import base64
import hashlib
import io

import zstandard
from pyarrow import fs

from folio.llm import warc


def brute(rows, least=0):
    first = {}
    for i, html in rows:
        b = (html or "").encode()
        if i is not None and len(b) >= least:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, html in rows:
        b = (html or "").encode()
        to = first[b] if i is not None and b in first and first[b] < i else None
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_pages(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    assert sorted(map(tuple, warc.op10_warc(spark, sf).collect()), key=str) == brute(rows)


def test_odd(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_ROWS", 5)
    page = "<html>" + "same page é 漢字 " * 200
    rows = [(i, f"http://x.org/{i}", page if i % 3 else f"<p>page {i}</p>" * 50, "extra") for i in range(40)]
    rows += [(50, None, None, None), (51, "http://x.org/a b\r\nc", "", None), (None, "u", page, None), (None, None, None, None), (60, "u", "x" * 300000, None), (1, "http://x.org/1", page, "extra"), (1, "other", page, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    for least in (0, 100):
        path = f"file://{tmp_path}/{least}"
        index = warc.write_archives(pages, path, least)
        got = warc.read_archives(index, path)
        assert sorted(map(tuple, got.drop("url", "payload").collect()), key=str) == brute([(r[0], r[2]) for r in rows], least)
        assert {x.payload.decode() for x in got.collect() if x.record_type == "response"} == {r[2] or "" for r in rows}
        # a record can be read alone, with the dictionary of the leading frame
        one = index.where("page_id = 60").first()
        raw = (tmp_path / str(least) / one.file).read_bytes()
        size = int.from_bytes(raw[4:8], "little")
        assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_MAGIC
        fields, payload = warc.parse(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).decompress(raw[one.offset : one.offset + one.length]))
        assert fields["x-page-id"] == "60" and payload == b"x" * 300000
    empty = warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(empty, f"file://{tmp_path}/none").count() == 0


def test_slices(spark, tmp_path, monkeypatch):
    """One archive is read by several tasks, and each record once."""
    monkeypatch.setattr(warc, "SLICE_BYTES", 1 << 12)
    rows = [(i, f"http://x.org/{i}", hashlib.sha512(str(i // 2).encode()).hexdigest() * (1 + i % 40)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/a"
    index = warc.write_archives(pages, path)
    assert index.select("file").distinct().count() == 1
    got = warc.read_archives(index, path)
    assert got.rdd.getNumPartitions() >= 8
    assert sorted(map(tuple, got.drop("url", "payload").collect()), key=str) == brute([(r[0], r[2]) for r in rows])


def test_no_dictionary(tmp_path):
    rows = [({"refers_to": None, "record": str(i), "digest": warc.digest(b"p"), "url": None, "page_id": i}, b"p") for i in range(3)]
    warc._write_file(f"file://{tmp_path}", "a", b"", iter(rows))
    assert [warc.parse(x)[1] for x in warc.frames(fs.LocalFileSystem(), f"{tmp_path}/a", 7)] == [b"p"] * 3
    assert io.BytesIO((tmp_path / "a").read_bytes()).read(4) == b"\x28\xb5\x2f\xfd"


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT * FROM (VALUES (1, 'u', 'é'), (2, 'u', 'x'), (3, NULL, 'é'), (4, 'u', NULL), (5, 'u', '')) t(page_id, url, html)")
    got = con.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.SQL})").fetchall()
    assert sorted(got, key=str) == brute([(1, "é"), (2, "x"), (3, "é"), (4, None), (5, "")])
