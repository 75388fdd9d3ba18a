"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong patterns (assignments, access identifiers, long hex) always count. Weak candidates (account names, mixed-case keys,
endpoints) count only when a complementary part lies in the same scope, `scope` characters to either side: the parts
of a document are joined on nearby intervals. That interval join asks for existence, so it runs as an ordered sweep: for
each part the nearest part of each role before and after it, which stays linear where a document holds thousands of parts.

Positions come from the texts between the matches of a pattern: their lengths and those of the matches add up to offsets
in code points. Only rows of matches are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm.shared import cut, id_text, table

#: Characters between two parts of one credential, at most.
SCOPE = 200

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")" + _VALUE + "([A-Za-z0-9+/_.=-]+)"
_ACCOUNT = "(" + "|".join(map(_either_case, ("client_?id", "username", "user", "login", "account"))) + ")" + _VALUE + "([A-Za-z0-9@_.-]+)"

#: kind, role, strong, pattern, group whose length counts, least length. The order breaks ties of position.
#: Runs of hex or key characters are maximal, so a least length in the pattern finds what a filter behind it would.
KINDS = [
    ("assign", "secret", True, _ASSIGN, 2, 6),
    ("access", "id", True, "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "secret", True, "[0-9a-f]{24,}", 0, 24),
    ("account", "id", False, _ACCOUNT, 2, 3),
    ("key", "secret", False, "[A-Za-z0-9+/_-]{32,}", 0, 32),
    ("endpoint", "endpoint", False, "https?://[^\\x00-\\x20\"'<>]+", 0, 12),
]


def _found(kind: str, pattern: str, group: int, least: int) -> Column:
    """All matches of one kind: position in order, code points since the last match, own code points, whether it counts."""
    text = F.col("text")
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), part.alias("part"))
    ok = lambda x: F.length(x["part"]) >= least
    if kind == "key":
        ok = lambda x: (F.length(x["part"]) >= least) & x["part"].rlike("[0-9]") & x["part"].rlike("[a-z]") & x["part"].rlike("[A-Z]")
    rows = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("size"), ok(x).alias("ok")))
    maybe = text.rlike(pattern)
    if kind in ("assign", "account"):
        maybe = (text.contains("=") | text.contains(":")) & maybe
    elif kind == "endpoint":
        maybe = text.contains("://") & maybe
    elif kind == "access":
        maybe = text.contains("AKIA") & maybe
    return F.when(maybe, rows)


def _rank() -> Column:
    return F.expr("CASE kind " + " ".join(f"WHEN '{k[0]}' THEN {i}" for i, k in enumerate(KINDS)) + " END")


def _kind(at: int, names: str) -> Column:
    values = {k[0]: k[at] for k in KINDS}
    return F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {str(v).lower() if isinstance(v, bool) else repr(v)}" for k, v in values.items()) + " END").alias(names)


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Spans found in the texts of `docs`: row_key (hash of doc_id and text), kind, start, end (code points, end exclusive),
    strong, rank. Equal rows give their spans once. Null text: none. Empty table: none."""
    base = id_text(docs).select(F.xxhash64("doc_id", "text").alias("row_key"), "text")
    found = base.select("row_key", F.explode(F.flatten(F.array_compact(F.array(*(_found(k[0], k[3], k[4], k[5]) for k in KINDS))))).alias("m")).select("row_key", "m.*").where("size is not null").distinct()
    order = Window.partitionBy("row_key", "kind").orderBy("i")
    parts = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order)).withColumn("start", F.col("end") - F.col("size")).where("ok")
    parts = parts.select("row_key", "kind", "start", "end", _kind(1, "role"), _kind(2, "strong"), _rank().alias("rank"))

    before = Window.partitionBy("row_key").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row_key").orderBy(F.col("start").desc(), F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = {}
    for role in ("secret", "id", "endpoint"):
        is_role = F.col("role") == role
        near[f"end_{role}"] = F.max(F.when(is_role, F.col("end"))).over(before)
        near[f"start_{role}"] = F.min(F.when(is_role, F.col("start"))).over(after)
    strong = F.col("strong")
    near["strong_end"] = F.max(F.when(strong, F.col("end"))).over(before)
    near["strong_start"] = F.min(F.when(strong, F.col("start"))).over(after)
    parts = parts.withColumns(near)
    close = lambda role: F.coalesce(F.col("start") - F.col(f"end_{role}") <= scope, F.lit(False)) | F.coalesce(F.col(f"start_{role}") - F.col("end") <= scope, F.lit(False))
    complementary = F.when(F.col("role") == "secret", close("id") | close("endpoint")).otherwise(close("secret"))
    covered = F.coalesce(F.col("strong_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("strong_start") < F.col("end"), F.lit(False))
    return parts.where(strong | (complementary & ~covered)).select("row_key", "kind", "start", "end", "strong", "rank")


def secret_report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row a row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256 (of the strong spans), spans, n_spans.

    Null or empty text, or nothing found: zero counts, the digest of the empty string, empty spans. Very long texts are
    scanned whole. Null doc_id is kept. Ties: of spans that start together, the kind listed first comes first. Repeated rows
    are each returned. Empty table: empty result. Other columns, whatever their names, are not looked at.
    """
    text = F.concat_ws(":", "kind", "start", "end")
    spans = secret_spans(docs, scope).withColumn("item", F.struct("start", "rank", text.alias("text")))
    joined = lambda name: F.array_join(F.transform(F.array_sort(name), lambda x: x["text"]), ",")
    each = spans.groupBy("row_key").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.collect_list(F.when(F.col("strong"), F.col("item"))).alias("base"),
        F.collect_list("item").alias("all"),
    )
    each = each.select("row_key", "n_assign", "n_access", "n_hex", joined("base").alias("base"), joined("all").alias("spans"), F.size("all").cast("long").alias("n_spans"))
    rows = id_text(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(each, "row_key", "left").select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_spans"))


#: Spans that are cut out of one piece of a text, so that a text of very many is not copied once for each.
PIECE_SPANS = 64


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each span (sorted, apart from each other) replaced. The text is first cut into pieces before every
    PIECE_SPANS-th span; within a piece the fold keeps what follows the last span, and the result so far."""
    n = F.size(spans)
    first = F.sequence(F.lit(0), F.ceil(n / PIECE_SPANS).cast("int") - 1)
    start = lambda k: F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get(spans, k * PIECE_SPANS)["start"].cast("long"))

    def cut_next(a, k):
        at, last = start(k), k == F.ceil(n / PIECE_SPANS).cast("int") - 1
        size = F.when(last, F.length(a["rest"])).otherwise(start(k + 1) - at).cast("int")
        piece = F.struct(F.left(a["rest"], size).alias("text"), at.alias("at"), k.alias("k"))
        return F.struct(F.concat(a["out"], F.array(piece)).alias("out"), F.substring(a["rest"], size + 1, F.length(a["rest"])).alias("rest"))

    empty = F.expr("cast(array() as array<struct<text:string,at:bigint,k:int>>)")
    pieces = F.aggregate(first, F.struct(empty.alias("out"), text.alias("rest")), cut_next, lambda a: a["out"])

    def mask_one(p):
        own = F.slice(spans, p["k"] * PIECE_SPANS + 1, PIECE_SPANS)

        def step(s, x):
            gone = (x["end"] - s["at"]).cast("int")
            return F.struct(F.concat(s["out"], F.left(s["rest"], (x["start"] - s["at"]).cast("int")), F.lit(mask)).alias("out"), x["end"].cast("long").alias("at"), F.substring(s["rest"], gone + 1, F.length(s["rest"])).alias("rest"))

        return F.aggregate(own, F.struct(F.lit("").alias("out"), p["at"].alias("at"), p["text"].alias("rest")), step, lambda s: F.concat(s["out"], s["rest"]))

    return F.array_join(F.transform(pieces, mask_one), "")


def redact_secrets(docs: DataFrame, scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """`docs` with every span found (overlapping ones taken together) replaced by `mask`; n_chars, if there, follows the text.

    Null texts stay null, empty ones empty. Very long texts are masked whole. Ties: spans that share a character are one.
    Repeated rows are each masked. All columns are carried, whatever their names. Empty table: empty result."""
    w = Window.partitionBy("row_key").orderBy("start", F.col("end").desc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    spans = secret_spans(docs, scope).withColumn("reach", F.max("end").over(w))
    upto = Window.partitionBy("row_key").orderBy("start", F.col("end").desc(), "rank")
    island = spans.withColumn("island", F.sum(F.when(F.col("reach") > F.col("start"), 0).otherwise(1)).over(upto))
    merged = island.groupBy("row_key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    each = cut(merged.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")), "redact")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(key.alias("row_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    rows = rows.join(each, "row_key", "left").withColumn("masked", F.when(F.col("spans").isNotNull(), _masked(F.col("text"), F.col("spans"), mask)).otherwise(F.col("text")))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length("masked").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(v.alias(c) for c, v in out.items()))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    unions = []
    for rank, (kind, role, strong, pattern, group, least) in enumerate(KINDS):
        ok = f"length(part) >= {least}"
        if kind == "key":
            ok += " AND regexp_matches(part, '[0-9]') AND regexp_matches(part, '[a-z]') AND regexp_matches(part, '[A-Z]')"
        unions.append(
            f"SELECT doc_id, '{kind}' AS kind, '{role}' AS role, {strong} AS strong, {rank} AS rnk, i, gap, size, ({ok}) AS ok FROM (SELECT doc_id, i, length(gaps[i]) AS gap, length(m[i]) AS size, g[i] AS part FROM ("
            f"SELECT doc_id, string_split_regex(text, {q(pattern)}) AS gaps, regexp_extract_all(text, {q(pattern)}) AS m, regexp_extract_all(text, {q(pattern)}, {group}) AS g FROM d WHERE regexp_matches(text, {q(pattern)})), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i))"
        )
    close = lambda r: f"(coalesce(start - end_{r} <= {SCOPE}, false) OR coalesce(start_{r} - stop <= {SCOPE}, false))"
    near = ", ".join(f"max(CASE WHEN role = '{r}' THEN stop END) OVER b AS end_{r}, min(CASE WHEN role = '{r}' THEN start END) OVER a AS start_{r}" for r in ("secret", "id", "endpoint"))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(unions)}),
p AS (SELECT * FROM (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop, sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY i) - size AS start FROM f) WHERE ok),
n AS (SELECT *, {near}, max(CASE WHEN strong THEN stop END) OVER b AS strong_end, min(CASE WHEN strong THEN start END) OVER a AS strong_start FROM p
  WINDOW b AS (PARTITION BY doc_id ORDER BY start, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY doc_id ORDER BY start DESC, rnk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS item FROM n WHERE strong OR ((CASE WHEN role = 'secret' THEN {close("id")} OR {close("endpoint")} ELSE {close("secret")} END)
  AND NOT (coalesce(strong_end > start, false) OR coalesce(strong_start < stop, false)))),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(item, ',' ORDER BY start, rnk) FILTER (strong) AS base, string_agg(item, ',' ORDER BY start, rnk) AS spans, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
