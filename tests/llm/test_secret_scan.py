import hashlib
import random
import re

import duckdb

from folio.llm.secret_scan import KINDS, SQL, op5_secret_scan, redact_secrets, secret_report

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = op5_secret_scan(spark, sf)
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = got.collect()
    assert len(rows) == len(texts) and sum(x.n_assign + x.n_access + x.n_hex for x in rows) > 0
    for x in rows:
        assert x.base_sha256 == hashlib.sha256(base(texts[x.doc_id]).encode()).hexdigest()
        assert set(filter(None, base(texts[x.doc_id]).split(","))) <= set(x.spans.split(","))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({SQL})").fetchall()) == sorted(map(tuple, rows))


def test_cases(spark):
    key = "aB3" * 12
    texts = [
        "secret=token:abcdefgh",
        "é 漢字 Password: 'hunter22' tail",
        "passwd=abc token=abcdefgh secret==\"zzzzzzz",
        "AKIA" * 6 + " x AKIA123 " + "0" * 23 + " " + "f" * 30,
        f"plain {key} alone",
        f"login: alice then {key} and https://db.example.com/x",
        f"https://db.example.com/x {'far ' * 100} {key}",
        "ſecret=abcdefgh Kelvin toKen=abcdefgh",
    ]
    rows = {x.doc_id: x for x in secret_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert rows[i].base_sha256 == hashlib.sha256(base(t).encode()).hexdigest(), t
    assert rows[4].spans == "" and rows[6].spans == ""
    assert [x.split(":")[0] for x in rows[5].spans.split(",")] == ["account", "key", "endpoint"]
    clean = dict(redact_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert clean[1] == "é 漢字 [SECRET]' tail" and clean[4] == texts[4]
    assert clean[3] == "[SECRET] x AKIA123 " + "0" * 23 + " [SECRET]"


def test_long_key(spark):
    key = "aB3/" * 50
    docs = spark.createDataFrame([(1, f"login: alice {key}"), (2, f"plain {key} alone")], "doc_id long, text string")
    rows = {x.doc_id: x.spans for x in secret_report(docs).collect()}
    assert rows == {1: f"account:0:12,key:13:{13 + len(key)}", 2: ""}


def linked(text, scope):
    """Each weak part against every other part of the text, one by one."""
    found = []
    for rank, (kind, role, strong, pattern, group, least) in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            ok = len(m[group]) >= least and (kind != "key" or all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]")))
            if ok:
                found.append((m.start(), rank, m.end(), kind, role, strong))
    out = []
    for a in found:
        others = [b for b in found if b is not a]
        near = [b for b in others if a[0] - b[2] <= scope and b[0] - a[2] <= scope]
        wanted = {"id", "endpoint"} if a[4] == "secret" else {"secret"}
        over = any(b[5] and b[0] < a[2] and a[0] < b[2] for b in others)
        if a[5] or (not over and any(b[4] in wanted for b in near)):
            out.append(a)
    return ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in sorted(out))


def test_linking(spark):
    """The sweep gives what a comparison of all pairs of parts gives."""
    r = random.Random(3)
    parts = ["login: alice", "user=bob7", "aB3" * 12, "zZ9/" * 40, "https://db.example.com/x", "token=abcdefgh", "AKIA" + "B" * 18, "f" * 30, "é漢 words " * 3, "filler " * 12, "x " * 60, "secret=abc"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(150)]
    for scope in (40, 200):
        rows = {x.doc_id: x.spans for x in secret_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scope).collect()}
        assert [rows[i] for i in range(len(texts))] == [linked(t, scope) for t in texts]


def test_many_matches(spark):
    text = "token=abcdefgh, " * 3000
    docs = spark.createDataFrame([(1, text), (2, "é漢 " * 300 + "x token=abcdefgh y " * 130 + "end"), (3, "token=abcdefgh " * 64), (4, "token=abcdefgh " * 65)], "doc_id long, text string")
    masked = dict(redact_secrets(docs).collect())
    assert all(masked[i] == re.sub("token=abcdefgh", "[SECRET]", t) for i, t in docs.collect())
    row = secret_report(docs.where("doc_id = 1")).first()
    assert row.n_assign == 3000 and row.base_sha256 == hashlib.sha256(base(text).encode()).hexdigest()


def test_odd(spark, odd_docs, no_docs):
    rows = secret_report(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    want = sorted(hashlib.sha256(base(x.text).encode()).hexdigest() for x in odd_docs.select("text").collect())
    assert sorted(x.base_sha256 for x in rows) == want
    assert redact_secrets(odd_docs).columns == odd_docs.columns and redact_secrets(odd_docs).count() == len(rows)
    assert secret_report(no_docs).count() == 0
