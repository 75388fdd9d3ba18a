"""The table function of spans, and the event parser of books."""

import re
import tracemalloc

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from folio.functions import spans
from folio.operators import narrative
from folio.plans import records
from folio.sources import books, shared, xml_books

TEXTS = ["— Да, — сказал он.\nИ ушёл.", "no speech", "", None, '"a" and «b» 🙂 "c"', "x: — так.\n"]


def brute(text, patterns):
    return [(i, k, g, m.start(g), m.end(g), m[g]) for i, p in enumerate(patterns) for k, m in enumerate(re.finditer(p, text or "")) for g in range(m.re.groups + 1) if m.start(g) >= 0]


def test_spans(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = spans.with_spans(df, narrative.SPEECH).collect()
    assert sorted((r.doc_id, *r[2:]) for r in got) == sorted((i, *x) for i, t in enumerate(TEXTS) for x in brute(t, narrative.SPEECH))
    assert spans.with_spans(df, ["zzz"]).collect() == [] and spans.with_spans(df.limit(0), ["a"]).collect() == []
    spans.register(spark)
    df.createOrReplaceTempView("span_texts")
    rows = spark.sql(r"SELECT doc_id, s.* FROM span_texts, LATERAL spans(text, '(?P<word>[a-z]+) (and|speech)', 'он') s").collect()
    assert {(r.doc_id, r.pattern, r.group, r.word) for r in rows} >= {(1, 0, 0, "no"), (1, 0, 1, None), (1, 0, 2, None), (0, 1, 0, None)}
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT * FROM span_texts, LATERAL spans(text, text)").collect()


def test_speech_spans(spark, sf="/root/testdata/sf0.001"):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {}
    for r in docs:
        for i, _, g, a, b, _ in brute((r.text or "").replace(", ", " — "), narrative.SPEECH):
            if g == 1:
                n, s, c = want.get((r.doc_id, i), (0, 0, 0))
                want[r.doc_id, i] = n + 1, s + a, c + b - a
    assert {(r.doc_id, r.pattern): (r.n, r.starts, r.chars) for r in records.speech_spans(spark, sf).collect()} == want


def test_parser():
    """Names spaces, CDATA, comments, entities, nesting; what is broken or empty."""
    x = xml_books.parse('<f:FictionBook xmlns:f="u"><f:description><f:title-info><f:genre> sf </f:genre><f:genre/><f:author><f:first-name>A<!-- x -->B</f:first-name></f:author><f:author><f:first-name>C</f:first-name></f:author><f:annotation><p>one</p><p>two</p></f:annotation><f:sequence number="7x"/><f:sequence name=" S " number="3"/></f:title-info><f:publish-info><f:year> 1999 </f:year></f:publish-info></f:description><f:body>a<b>b</b><![CDATA[<c>]]>&amp;d<image>hidden</image><f:body name="notes">inner</f:body></f:body><f:body name="notes">gone</f:body><f:body name="more">\n e\t</f:body></f:FictionBook>')
    assert (x["is_book"], x["genre"], x["first_name"], x["annotation"], x["series"], x["series_number"], x["year"]) == (True, [" sf "], "AB", "onetwo", "S", None, 1999)
    assert x["body"] == "a b <c>&d inner e"
    assert xml_books.parse(None) == xml_books.parse("") == xml_books.parse("<a><b></a>") == xml_books.parse("<a>&nope;</a>") == {"parse_error": True, "is_book": False}
    assert xml_books.parse('<?xml version="1.0" encoding="windows-1251"?><FictionBook><body>Привет</body></FictionBook>'.encode("cp1251"))["body"] == "Привет"
    assert xml_books.parse(' <?xml version="1.0" encoding="windows-1251"?><a><body>Привет</body></a>')["body"] == "Привет"  # text: as it is
    deep = "<a>" * 20_000 + "</a>" * 20_000
    assert xml_books.parse(deep)["body"] == "" and xml_books.parse(f"<a><body>{'x ' * 500_000}</body></a>")["body"].count("x") == 500_000


def test_read_books(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"b{i}.fb2").write_bytes((f'<?xml version="1.0" encoding="windows-1251"?><FictionBook><body>Книга {i}</body>' + ("</FictionBook>" if i else "")).encode("cp1251"))
    rows = xml_books.read_books(spark, f"file://{tmp_path}/*.fb2").orderBy("file_path").collect()
    assert [r.body for r in rows] == [None, *(f"Книга {i}" for i in range(1, 6))] and [r.parse_error for r in rows] == [True, *[False] * 5]
    odd = spark.createDataFrame([("<a/>", "mine", 1)], "content string, row string, title int").withColumn("x", F.lit(2))
    got = books.parse_books(odd).first()
    assert (got.row, got.x, got.content, got.title) == ("mine", 2, "<a/>", None)
    assert books.parse_books(odd.limit(0)).collect() == []


def test_batches_in_parts():
    """A batch of 100 MB of files needs the room of a few of them, and gives each its row."""
    book = f"<FictionBook><body>{'one two ' * 12_500}</body></FictionBook>"
    batch = pa.record_batch({"row": pa.array([{"i": i} for i in range(1000)]), "content": pa.array([None if i % 10 == 3 else book for i in range(1000)], pa.string())})
    seen = []
    tracemalloc.start()
    for part in xml_books.parse_batches([batch]):
        seen += zip((x["i"] for x in part.column("row").to_pylist()), part.column("parse_error").to_pylist(), pc.utf8_length(part.column("body")).to_pylist(), strict=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == [(i, True, None) if i % 10 == 3 else (i, False, 99_999) for i in range(1000)] and peak < 20e6
    whole = [x.num_rows for x in shared.slices(pa.record_batch({"c": pa.array(["abc", "", None, "abcdef", "a", "b"], pa.string())}), "c", 4)]
    assert whole == [3, 1, 2] and list(shared.slices(pa.record_batch({"c": pa.array([], pa.string())}), "c")) == []
