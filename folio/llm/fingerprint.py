"""Document fingerprints: threshold-scaled sketches.

Of a text's shingle hashes every one below a fixed fraction of the hash range is kept. So a sketch grows with its text, the
sketch of a union is the union of sketches, and containment of a short text in a very long one is estimated as well as that
of equals.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import carry, cut, id_text, partitions, table
from folio.llm.words import chunks, runs, whole, words

FRACTION = 1 / 4
SHINGLE = 5
#: Documents of a range, where there are more ranges than shuffle partitions; at most so many ranges.
RANGE_ROWS, MOST_RANGES = 50_000, 10_000


def sketches(texts: pa.Array, fraction: float = FRACTION, k: int = SHINGLE) -> list[tuple[int, int, np.ndarray]]:
    """For each text (null: empty): hash of its word sequence, number of shingles, sorted kept hashes. Words as they are."""
    limit = np.uint64(min(fraction * 2.0**64, 2.0**64 - 2048))
    out = []
    for chunk in chunks(texts):
        w = words(chunk)
        h = w.hashes()
        for i in range(len(chunk)):
            x = h[w.first[i] : w.first[i + 1]]
            s = np.unique(runs(x, min(k, max(1, len(x)))))
            out.append((int(whole(x)), len(s), s[: np.searchsorted(s, limit)]))
    return out


def fingerprint(sketch) -> str:
    """Text form: sequence hash, number of shingles, kept hashes."""
    return f"{sketch[0]:016x}.{sketch[1]}.{base64.b64encode(sketch[2].astype('<u8').tobytes()).decode()}"


def parse(text: str) -> tuple[int, int, np.ndarray]:
    a, b, c = text.split(".")
    return int(a, 16), int(b), np.frombuffer(base64.b64decode(c), "<u8")


def merge(a, b) -> np.ndarray:
    """Kept hashes of the union of two texts' shingles."""
    return np.union1d(a[2], b[2])


def likeness(a, b) -> float:
    """Estimate of the Jaccard similarity; 1 for equal word sequences."""
    if a[0] == b[0] and a[1] == b[1]:
        return 1.0
    both = len(np.intersect1d(a[2], b[2], assume_unique=True))
    return both / max(1, len(a[2]) + len(b[2]) - both)


def containment(a, b) -> float:
    """Estimate of the share of a's shingles that b has; 1 for equal word sequences, 0 if nothing of a was kept."""
    if a[0] == b[0] and a[1] == b[1]:
        return 1.0
    return len(np.intersect1d(a[2], b[2], assume_unique=True)) / max(1, len(a[2]))


def _fingerprints(fraction: float):
    def run(batches):
        for batch in batches:
            got = sketches(batch.column("text"), fraction)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([fingerprint(x) for x in got], pa.string())], ["row", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """`docs` as a column `row`, with the fingerprint of each text."""
    return carry(docs, _fingerprints(fraction), "fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Documents in ascending doc_id order (null first; of one id, by text), dealt so that each meets the next one: bucket,
    copy, doc_id, text, sorted within partitions. Each bucket, a range of ids, ends with a copy of the row that follows it
    (the last one: of the first row of all). Only range bounds, a few numbers a partition, reach the driver."""
    base = id_text(docs).withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = min(max(partitions(docs.sparkSession), base.count() // RANGE_ROWS), MOST_RANGES)
    bounds = base.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    bounds = sorted(set(bounds or []))
    # how many bounds are not above an id: first among every so many, then within these
    width = max(1, math.isqrt(len(bounds)))
    below = lambda listed: F.size(F.filter(listed, lambda b: b <= F.col("id")))
    array = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    coarse = below(array(bounds[width - 1 :: width]))
    fine = F.array(*(array(bounds[i : i + width]) for i in range(0, len(bounds) + 1, width)))
    base = base.withColumn("coarse", coarse)
    bucket = F.col("coarse") * width + below(F.get(fine, F.col("coarse")))
    base = base.withColumn("bucket", bucket)
    least = base.groupBy("bucket").agg(F.min("id").alias("id")).orderBy("bucket").collect()
    if not least:
        return base.select("bucket", F.lit(0).alias("copy"), "doc_id", "text")
    to = {r["id"]: least[i - 1]["bucket"] for i, r in enumerate(least)}  # the first row of a bucket also goes to the one before
    target = F.create_map(*(F.lit(x) for pair in to.items() for x in pair))
    heads = base.where(F.col("id").isin(list(to))).groupBy("id").agg(F.min("text").alias("text"), F.min("doc_id").alias("doc_id"))
    copies = cut(heads.select(target[F.col("id")].alias("bucket"), F.lit(1).alias("copy"), "doc_id", "text"), "heads")
    rows = base.select("bucket", F.lit(0).alias("copy"), "doc_id", "text").union(copies)
    return rows.repartitionByRange(n, "bucket").sortWithinPartitions("bucket", "copy", "doc_id", "text")


def _compare(fraction: float):
    """Sorted rows of with_next() in -> a row a document out. A document is held until the next one is there."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]

    def run(batches):
        held = None  # bucket, copy, doc_id, text, sketch
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = list(zip(batch.column("bucket").to_pylist(), batch.column("copy").to_pylist(), batch.column("doc_id").to_pylist(), texts, sketches(batch.column("text"), fraction), strict=True))
            if held is not None:
                rows.insert(0, held)
            if not rows:
                continue
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
            held = rows[-1]
            edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
            out = []
            for (a, b), text, e in zip(pairs, edited, sketches(pa.array(edited, pa.large_string()), fraction), strict=True):
                s, t = a[4], b[4]
                out.append((a[2], len(a[3]), hashlib.sha256(text.encode()).hexdigest(), fingerprint(s), fingerprint(e), likeness(s, e), likeness(s, t), containment(s, e), containment(s, t)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def edited_fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last floor(n_chars / 2) code points are replaced by the first
    as many (or all) of the next document in ascending doc_id order (after the last: the first).

    Returns one row a row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    (Jaccard estimates), contained_edited, contained_next (containment of the text in the other).

    Null text: the empty text. Very long texts are sketched whole. Null doc_id comes before all others; ties and repeated
    rows, of one id, are ordered by text, and each is the next of the one before. A single row is its own next. Empty table:
    empty result. Other columns, whatever their names, are not looked at.
    """
    return with_next(docs).mapInArrow(_compare(fraction), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double")


def op3_fingerprint(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
