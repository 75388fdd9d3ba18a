"""Chat formatting: round trips, the loss mask, marks inside texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from folio.llm import chat_format as cf
from folio.llm.token_file import TOKENIZER

PATH = public_tokenizers.path(TOKENIZER)
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    out = {}
    for c, _, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2], x[3])):
        out.setdefault(c, []).append((role, text))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    said = {c: "".join(x for r, x in t if r == "assistant") for c, t in out.items()}
    return {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(said[c]), sha(said[c])) for c, t in out.items()}


def shown(reader, ids):
    return reader.bytes(np.array(ids))[0].tobytes().decode()


def formatted(spark, rows, path, schema=SCHEMA, **options):
    cf.write_chats(spark.createDataFrame(rows, schema), path, **options)
    return cf.read_chats(spark, path)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = cf.op11_chat_format(spark, sf).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows) and len(got) == len({r[0] for r in rows})


def test_marks_in_texts(spark, tmp_path):
    """No text yields a reserved id, whatever it holds; the rendered text can be read in one way only; both give the texts back."""
    chance = random.Random(1)
    bits = [*cf.ESCAPED, *(c[:1] + "\\" + c[1:] for c in cf.ESCAPED), *(c[:1] + "\\\\" + c[1:] for c in cf.ESCAPED), "<", "[", "\\", "s>", "/s>", "INST]", "|", ">", "<<", "a", " ", "\n", "é", "漢", "🙂"]
    rows = [(i % 40, i, chance.choice(["user", "assistant", "system", "tool", "", "</s>", "<|text|>x", None]), "".join(chance.choices(bits, k=chance.randrange(9)))) for i in range(600)]
    chats = formatted(spark, rows, f"file://{tmp_path}/c")
    assert {r.conv_id: tuple(r)[1:5] for r in cf.digests(chats).collect()} == brute(rows)
    back = [(r.conv_id, r.role, r.text) for r in cf.turns(chats).orderBy("conv_id", "range", "part", "place").collect()]
    assert back == [(c, r or "", x) for c, _, r, x in sorted(rows, key=lambda x: x[:2])]
    reader = cf.Reader(PATH)
    for r in chats.collect():
        n_marks = sum(i >= reader.first for i in r.ids)
        text = shown(reader, r.ids)
        found = sum(text.count(c) for c in cf.CONTROL)  # a mark inside another doesn't occur
        assert found == n_marks and "<|endoftext|>" not in text


def test_mask(spark, tmp_path):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello there"), (1, 3, "assistant", ""), (1, 4, "assistant", "again"), (1, 5, "user", "bye")]
    row = formatted(spark, rows, f"file://{tmp_path}/c").first()
    reader = cf.Reader(PATH)
    assert shown(reader, row.ids) == "<<SYS>>be brief<</SYS>><s>[INST]hi[/INST]hello there</s></s>again</s><s>[INST]bye[/INST]"
    assert shown(reader, [i for i, on in zip(row.ids, row.loss, strict=True) if on]) == "hello thereagain"
    row = formatted(spark, rows, f"file://{tmp_path}/d", learn_end=True).first()
    assert shown(reader, [i for i, on in zip(row.ids, row.loss, strict=True) if on]) == "hello there</s></s>again</s>"
    assert cf.digests(cf.read_chats(spark, f"file://{tmp_path}/d")).first().loss_chars == 16


def test_parts(spark, tmp_path):
    """A conversation of most rows is worked on by several tasks and comes in several parts, whose order is that of its turns."""
    rows = [(5, i, "assistant" if i % 2 else "user", f"turn {i} " * (i % 7)) for i in range(3000)] + [(i, 0, "user", "x") for i in range(10)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chats = formatted(spark, rows, f"file://{tmp_path}/c", part_ids=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    mine = chats.where("conv_id = 5")
    assert mine.select("range").distinct().count() > 1
    assert mine.agg(F.sum("n_turns")).first()[0] == 3001
    assert {r.conv_id: tuple(r)[1:5] for r in cf.digests(chats).collect()} == brute(rows)


def test_odd(spark, tmp_path):
    long = "word " * 300_000
    rows = [(1, None, None, None, "x"), (1, 0, "user", "", "x"), (1, 0, "user", "", None), (1, 0, "assistant", "b", "x"), (None, 1, "user", "null id", "x"), (None, None, "tool", None, None), (2, 5, "assistant", long, "x"), (3, None, "assistant", None, None)]
    schema = SCHEMA + ", ids string"
    got = {r.conv_id: tuple(r)[1:5] for r in cf.digests(formatted(spark, rows, f"file://{tmp_path}/c", schema)).collect()}
    assert got == brute([r[:4] for r in rows])
    assert cf.digests(formatted(spark, [], f"file://{tmp_path}/d", schema)).collect() == []
