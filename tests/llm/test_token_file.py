import zlib

import numpy as np
import public_tokenizers
from pyarrow import orc
from tokenizers import Tokenizer

from folio.llm import token_file as tf


def brute(rows):
    t = Tokenizer.from_file(public_tokenizers.path(tf.TOKENIZER))
    out, start = [], 0
    for i, text in sorted(((i, x or "") for i, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def digest(spark, docs, path):
    tf.write_tokens(docs, path)
    return tf.read_tokens(spark, path).mapInArrow(tf._checksums, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()


def test_documents(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, tf.op7_token_file(spark, sf).collect()), key=str) == brute(rows)


def test_white_space(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "CACHE_PIECES", 3)
    tf._encoder.cache_clear()
    texts = [" a", "a ", "a  b", "a \n b", "é b", "a  b", "a  b", "b  c 　 d", "x <|endoftext|> y", "don't 've  ' s", "1 2  3 \t4", "漢 字 ü ñ", "a\x85 b", "a \x1c b\x1f c", "  q", "🙂 🙂  🙂", " ", "  ", "\n", "!! ?? .a b. (c d)", "don't, it's; 'tis a', b.c d,e é. à; ×. ÷! x\u00d7. 5, 5.5 a5. _a. a_. \u00b5."]
    rows = list(enumerate(texts))
    assert sorted(map(tuple, digest(spark, spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/t")), key=str) == brute(rows)


def test_odd(spark, odd_docs, no_docs, tmp_path):
    rows = [(x.doc_id, x.text) for x in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, digest(spark, odd_docs, f"file://{tmp_path}/t")), key=str) == brute(rows)
    assert digest(spark, no_docs, f"file://{tmp_path}/u") == []
    assert {x.doc_id for x in tf.find_tokens(spark, f"file://{tmp_path}/t", [7, 8, 1000]).collect()} == {7, 8}


def test_skipping(spark, tmp_path):
    """Stripes hold row groups that a look-up skips by index and Bloom filter; ids lie in ascending order."""
    docs = spark.range(0, 20000, 2, 1).selectExpr("id as doc_id", "concat('text ', id, repeat(' more', int(id % 50))) as text")
    path = f"file://{tmp_path}/t"
    tf.write_tokens(docs, path)
    files = sorted((tmp_path / "t").glob("*.orc"))
    assert files and sum(orc.ORCFile(str(f)).nrows for f in files) == 10000 and all(orc.ORCFile(str(f)).nstripes >= 1 for f in files)
    ids = [x for f in files for x in orc.ORCFile(str(f)).read(["doc_id"])["doc_id"].to_pylist()]
    assert sorted(ids) == ids or sorted(ids) == list(range(0, 20000, 2))

    def scanned(doc_ids):
        df = tf.find_tokens(spark, path, doc_ids)
        found = {x.doc_id for x in df.collect()}
        return found, df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    found, rows = scanned([5000])
    assert found == {5000} and 0 < rows <= 1000
    found, rows = scanned([5001])  # within the range of a row group, but not there: the Bloom filter tells
    assert found == set() and rows == 0
