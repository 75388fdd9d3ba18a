"""Texts to chunks. Offsets count code points. Each text is cut in its own row, then exploded: no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE_END = r"[.!?]+\s+"
PARAGRAPH_END = r"\n\s*\n"


@dataclass(frozen=True)
class Strategy:
    """How to cut. `unit`: fixed, sentence or paragraph. `per_chunk`: so many sentences or paragraphs a chunk; 0: by size."""

    base: int = 2000
    least: int = 500
    most: int = 4000
    overlap: float = 0.1
    unit: str = "fixed"
    per_chunk: int = 0
    two_sided: bool = False

    def errors(self) -> list[str]:
        found = []
        if not 0 < self.least <= self.base <= self.most:
            found.append("sizes must be positive and ascending")
        if not 0 <= self.overlap <= 0.5:
            found.append("overlap must be between 0 and 0.5")
        if self.unit not in ("fixed", "sentence", "paragraph"):
            found.append("unknown unit")
        return found


DEFAULT = Strategy()
SMALL = Strategy(1000, 250, 2000, 0.15)
LARGE = Strategy(4000, 1000, 8000, 0.05)


def adaptive_size(length: Column, context: int = 8192, prompt: int = 1000, chars_per_token: int = 4, fill: float = 0.8, least: int = 500) -> Column:
    """Chunk size for a text of this length: whole, if the context holds it; else what the context holds."""
    room = max(least, int((context - prompt) * chars_per_token * fill))
    return F.least(F.greatest(length, F.lit(least)), F.lit(room))


def estimated_chunks(length: Column, size: Column | int, overlap: float = 0.1) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    step = F.greatest(size - F.floor(size * overlap), F.lit(1))
    return F.when(length <= size, 1).otherwise(F.ceil(length / step)).cast("long")


def _units(c: Column, end: str) -> Column:
    """Stretches of text up to and including each boundary, and the rest: they add up to the text."""
    return F.filter(F.regexp_extract_all(c, F.lit(f"(?sU)(.*?{end}|.+$)"), F.lit(1)), lambda x: x != "")


def _packed(lengths: Column, s: Strategy) -> Column:
    """Greedy packing of unit lengths: a chunk grows to the base size and never past the most, but below the least it takes one
    more. Returns end offsets. One fold a text."""
    start = F.expr("named_struct('ends', cast(array() as array<bigint>), 'at', 0L, 'size', 0L)")

    def step(a, n):
        n = n.cast("long")
        full = (a["size"] > 0) & ((a["size"] >= s.base) | ((a["size"] + n > s.most) & (a["size"] >= s.least)))
        return F.struct(
            F.when(full, F.concat(a["ends"], F.array(a["at"]))).otherwise(a["ends"]).alias("ends"),
            (a["at"] + n).alias("at"),
            F.when(full, n).otherwise(a["size"] + n).alias("size"),
        )

    return F.aggregate(lengths, start, step, lambda a: F.when(a["size"] > 0, F.concat(a["ends"], F.array(a["at"]))).otherwise(a["ends"]))


def _packed_paragraphs(units: Column, s: Strategy) -> Column:
    """Paragraphs fill a chunk up to the most. One that is longer alone ends the chunk before it and is cut by sentences, into
    chunks of its own. Returns end offsets."""
    each = F.transform(units, lambda u: F.struct(F.length(u).cast("long").alias("n"), F.when(F.length(u) > s.most, _packed(F.transform(_units(u, SENTENCE_END), F.length), s)).alias("cuts")))
    start = F.expr("named_struct('ends', cast(array() as array<bigint>), 'at', 0L, 'size', 0L)")

    def step(a, x):
        flush = F.when(a["size"] > 0, F.array(a["at"])).otherwise(F.expr("cast(array() as array<bigint>)"))
        own = F.struct(F.concat(a["ends"], flush, F.transform(x["cuts"], lambda e: a["at"] + e)).alias("ends"), (a["at"] + x["n"]).alias("at"), F.lit(0).cast("long").alias("size"))
        full = (a["size"] > 0) & (a["size"] + x["n"] > s.most)
        more = F.struct(F.when(full, F.concat(a["ends"], flush)).otherwise(a["ends"]).alias("ends"), (a["at"] + x["n"]).alias("at"), F.when(full, x["n"]).otherwise(a["size"] + x["n"]).alias("size"))
        return F.when(x["cuts"].isNotNull(), own).otherwise(more)

    return F.aggregate(each, start, step, lambda a: F.when(a["size"] > 0, F.concat(a["ends"], F.array(a["at"]))).otherwise(a["ends"]))


def requested(size: int, overlap: int, unit: str) -> Strategy:
    """The strategy that a request stands for: sentences of about 100 characters, paragraphs of 200, or fixed sizes."""
    if unit in ("sentence", "paragraph"):
        return Strategy(unit=unit, per_chunk=max(1, size // (100 if unit == "sentence" else 200)), overlap=0.0)
    return Strategy(size, min(size, 500), max(size, 4000), min(0.5, overlap / size))


def by_flags(paragraphs: bool, sentences: bool, per_chunk: int = 1, otherwise: Strategy = DEFAULT) -> Strategy:
    """The strategy that flags ask for: paragraphs before sentences, and fixed sizes if neither is set."""
    unit = "paragraph" if paragraphs else "sentence" if sentences else None
    return Strategy(unit=unit, per_chunk=per_chunk, overlap=0.0) if unit else otherwise


#: Characters of the blocks that a text is taken in when chunks are cut from it, so that no cut counts from the text's start.
BLOCK = 4096


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start to end of a text given in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(some, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def chunk(df: DataFrame, strategy: Strategy = DEFAULT, key: str = "doc_id", text: str = "text", size: Column | None = None) -> DataFrame:
    """Cuts every text: key, chunk_index, total_chunks, start_pos, end_pos, overlap_start, overlap_end, content.

    A text no longer than the size is one chunk without overlap. Null and empty texts give none; blank chunks of sentences and
    paragraphs are left out. `size`: a size for each row instead of the strategy's. Repeated rows give their chunks each.
    """
    if found := strategy.errors():
        raise ValueError("; ".join(found))
    base = F.lit(strategy.base) if size is None else size.cast("int")
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t"), base.alias("size")).where("length(t) > 0")
    rows = rows.withColumn("n", F.length("t").cast("long"))
    if strategy.unit == "fixed":
        ends = F.transform(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("n") / F.col("size"))), lambda i: F.least(i * F.col("size"), F.col("n")))
    else:
        rows = rows.withColumn("units", _units(F.col("t"), SENTENCE_END if strategy.unit == "sentence" else PARAGRAPH_END))
        if strategy.per_chunk:
            sums = F.aggregate(F.transform("units", F.length), F.expr("named_struct('out', cast(array() as array<bigint>), 'at', 0L)"), lambda a, x: F.struct(F.concat(a["out"], F.array(a["at"] + x)).alias("out"), (a["at"] + x).alias("at")), lambda a: a["out"])
            rows = rows.withColumn("sums", sums)
            ends = F.filter("sums", lambda x, i: ((i + 1) % strategy.per_chunk == 0) | (i == F.size("sums") - 1))
        elif strategy.unit == "paragraph":
            ends = _packed_paragraphs(F.col("units"), strategy)
        else:
            ends = _packed(F.transform("units", F.length), strategy)
    whole = (F.col("n") <= F.col("size")) & F.lit(not strategy.per_chunk)
    rows = rows.withColumn("ends", F.when(whole, F.array("n")).otherwise(ends)).withColumn("blocks", F.regexp_extract_all("t", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    spans = F.transform("ends", lambda e, i: F.struct(F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("ends", i - 1)).alias("start"), e.alias("end")))
    if strategy.unit != "fixed":
        spans = F.filter(spans, lambda x: _cut(F.col("blocks"), x["start"], x["end"]).rlike(r"\S"))
    rows = rows.select("key", "n", "size", "blocks", spans.alias("spans"))
    over, total = F.floor(F.col("size") * strategy.overlap), F.size("spans")

    def placed(x, i):
        tail = F.when(i == total - 1, 0).otherwise(F.least(over, F.col("n") - x["end"])).cast("long")
        # with two sides, a chunk also takes the end of the one before; with one, that end has been taken already
        head = F.when(i == 0, 0).otherwise(F.least(over, x["start"])).cast("long") if strategy.two_sided else F.lit(0).cast("long")
        start, end = x["start"] - head, x["end"] + tail
        return F.struct(i.alias("chunk_index"), total.alias("total_chunks"), start.alias("start_pos"), end.alias("end_pos"), head.alias("overlap_start"), tail.alias("overlap_end"), _cut(F.col("blocks"), start, end).alias("content"))

    # contents are cut in the text's row, so that the text is not copied into each of them
    return rows.select(F.col("key").alias(key), F.explode(F.transform("spans", placed)).alias("__c")).select(key, "__c.*")


def position_ratio(start: Column, length: Column) -> Column:
    """Where in its text a chunk starts, 0 to 1."""
    return F.when(length > 0, start / length).otherwise(0.0)


def unique_content(content: Column, overlap_start: Column, overlap_end: Column) -> Column:
    """A chunk without its overlaps."""
    return F.substring(content, (overlap_start + 1).cast("int"), (F.length(content) - overlap_start - overlap_end).cast("int"))


def chunk_stats(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    n = F.length("content")
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.sum(n).alias("total_length"), F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))
