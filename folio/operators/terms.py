"""Words and pairs of neighbour words, counted where their text is.

Spark brings the texts of a key together, once and as texts: terms are many times as much, so none is exchanged. Each text is
counted by itself, and a key gives out its best terms when the next one comes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from heapq import nlargest, nsmallest
from itertools import chain, groupby
from math import sqrt
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from folio.functions import text as t


#: Rows of a batch that is given out.
ROWS = 5_000


def counted(texts: Iterable[list[str]]) -> Counter:
    """Words and pairs of neighbours; no pair goes from one text into the next."""
    counts = Counter()
    for words in texts:
        counts.update(words)
        counts.update(map(" ".join, zip(words, words[1:], strict=False)))
    return counts


def frequent(units: Iterable[Counter], features: int, top: int) -> list[tuple]:
    """TF-IDF of a one-text fit: term, score, rank, terms of the `top` best of the `features` most frequent. Ties by term."""
    counts = sum(units, Counter())
    kept = nsmallest(features, counts.items(), key=lambda x: (-x[1], x[0]))
    norm = sqrt(sum(c * c for _, c in kept))
    return [(term, c / norm, i + 1, len(counts)) for i, (term, c) in enumerate(kept[:top])]


def summed(units: Iterable[Counter], top: int) -> list[tuple]:
    """Normalised counts of each unit, summed: term, score, rank, terms of the `top` best. Ranks go by nine decimals, ties by term."""
    scores: dict[str, float] = {}
    for counts in units:
        norm = sqrt(sum(c * c for c in counts.values()))
        for term, c in counts.items():
            scores[term] = scores.get(term, 0.0) + c / norm
    least = min(nlargest(top, scores.values()), default=0.0) - 2e-9  # whatever can round to the last one's place
    nine = lambda s: Decimal(repr(s)).quantize(Decimal("1e-9"), ROUND_HALF_UP)
    best = sorted((-nine(s), term, s) for term, s in scores.items() if s >= least)[:top]
    return [(term, s, i + 1, len(scores)) for i, (_, term, s) in enumerate(best)]


def best_terms(df: DataFrame, key: str, order: str | None, text: str, word: str, stop_words, use: Callable[[Iterable[Counter]], list[tuple]]) -> DataFrame:
    """key, term, score, rank, terms, as use() gives them of the counts of a key's units, in order. Rows of one key and order are
    one unit; without `order` all rows of a key are. Null texts have no words; keys without words have no rows."""
    rows = df.select(F.col(key).alias("k"), (F.lit(0) if order is None else F.col(order)).alias("o"), F.col(text).alias("t")).where("t is not null")
    words = rows.repartition("k").sortWithinPartitions("k", "o").select("k", "o", F.filter(t.words(F.col("t"), word), lambda x: ~F.array_contains(t.word_list(list(stop_words)), x)).alias("w"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            w = batch.column("w")
            flat = w.flatten().dictionary_encode()  # each word of a batch becomes a string once
            ends, words, places = np.cumsum(w.value_lengths().to_numpy()), np.array(flat.dictionary.to_pylist(), object), flat.indices.to_numpy()
            for k, o, a, b in zip(batch.column("k").to_pylist(), batch.column("o").to_pylist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                yield k, o, words[places[a:b]].tolist()

    def made(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = (kind, pa.string(), pa.float64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), kinds, strict=True)], ["k", "term", "score", "rank", "terms"])

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        kind, out = first.schema.field("k").type, []
        for k, same in groupby(read(chain([first], batches)), itemgetter(0)):
            out += ((k, *x) for x in use(counted(r[2] for r in unit) for _, unit in groupby(same, itemgetter(1))))
            if len(out) >= ROWS:
                yield made(out, kind)
                out = []
        if out:
            yield made(out, kind)

    fields = [StructField("term", StringType()), StructField("score", DoubleType()), StructField("rank", IntegerType()), StructField("terms", LongType())]
    return words.mapInArrow(run, StructType([words.schema["k"], *fields])).withColumnRenamed("k", key)
