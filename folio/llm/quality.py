"""Quality classifier: histogram gradient-boosted trees over document statistics.

The model is fitted on a bounded sample of labelled rows, whose statistics Spark tasks compute; only they reach the driver.
The fitted trees are complete binary trees laid out in three arrays, so scoring walks all trees for all rows of a batch
level by level in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import carry, id_text, table
from folio.llm.words import chunks, words

#: Labelled rows that the model learns from, at most: those of the least hashes.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
#: Words of a block, of which a document's share of odd blocks is told.
BLOCK = 24

_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_LOWER = np.array([0x61 <= b <= 0x7A for b in range(256)])
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_HIGH = np.array([b >= 0x80 for b in range(256)])
_BLANK = np.array([b == 0x20 or 9 <= b <= 13 for b in range(256)])
_USUAL = np.array([chr(b) in ".,;:'\"!?()-" for b in range(256)])
_RARE = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _BLANK | _USUAL)

NAMES = (
    ["log_bytes", "log_words", "upper", "lower", "digit", "high", "blank", "usual", "rare", "newline", "bang", "bar", "stop"]
    + ["word_mean", "word_sd", "word_max", "short", "long", "capital", "shouted", "mixed", "no_letter", "tailed", "distinct", "distinct_pairs", "top", "again", "again_2"]
    + ["line_mean", "line_sd", "lines_again", "blocks_again", "blocks_shouted", "blocks_tailed", "blocks_bar", "blocks_few"]
)


def _one(b: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> list[float]:
    """Statistics of one text: its bytes, words and word hashes."""
    n, k = max(1, len(b)), len(start)
    count = np.bincount(b, minlength=256)
    share = [float(count[m].sum()) / n for m in (_UPPER, _LOWER, _DIGIT, _HIGH, _BLANK, _USUAL, _RARE)] + [float(count[c]) / n for c in (10, 33, 124, 46)]
    if not k:
        return [np.log1p(len(b)), 0.0, *share] + [0.0] * (len(NAMES) - 13)
    size = end - start
    sums = lambda mask: np.concatenate(([0], np.cumsum(mask[b])))
    upper, lower, high = sums(_UPPER), sums(_LOWER), sums(_HIGH)
    up, low, hi = upper[end] - upper[start], lower[end] - lower[start], high[end] - high[start]
    capital, shouted = _UPPER[b[start]], (up > 1) & (low == 0)
    mixed, no_letter = _LOWER[b[start]] & (up > 0), (up + low + hi) == 0
    last = b[end - 1]
    tailed = _RARE[last] | (last == 33)
    bar = (size == 1) & (b[start] == 124)
    again, again_2 = np.concatenate(([False], h[1:] == h[:-1])), np.concatenate(([False, False], h[2:] == h[:-2]))[:k]
    seen, times = np.unique(h, return_counts=True)
    pairs = len(np.unique(h[1:] * np.uint64(3) ^ h[:-1])) / (k - 1) if k > 1 else 1.0
    breaks = np.flatnonzero(b == 10)
    line = np.diff(np.concatenate(([0], breaks, [len(b)])))
    # lines by the words in them
    first = np.searchsorted(start, np.concatenate(([0], breaks)))
    line_sums = np.add.reduceat(np.concatenate((h, [np.uint64(0)])), np.minimum(first, k))
    line_again = 1 - len(np.unique(line_sums)) / len(line_sums)
    at = np.arange(0, k, BLOCK)
    per = lambda mask: np.add.reduceat(mask.astype(np.int64), at) / np.diff(np.append(at, k))
    whole = k // BLOCK * BLOCK
    kinds = 1 + (np.diff(np.sort(h[:whole].reshape(-1, BLOCK), axis=1), axis=1) != 0).sum(axis=1)
    few = np.append(kinds, len(np.unique(h[whole:])))[: len(at)] / np.diff(np.append(at, k))
    blocks = [float((per(again | again_2) > 0.3).mean()), float((per(shouted) > 0.5).mean()), float((per(tailed) > 0.3).mean()), float((per(bar) > 0.15).mean()), float((few < 0.5).mean())]
    return [
        np.log1p(len(b)), np.log1p(k), *share, float(size.mean()), float(size.std()), float(size.max()), float((size <= 2).mean()), float((size >= 14).mean()),
        float(capital.mean()), float(shouted.mean()), float(mixed.mean()), float(no_letter.mean()), float(tailed.mean()), len(seen) / k, pairs, float(times.max()) / k, float(again.mean()), float(again_2.mean()),
        float(line.mean()), float(line.std()), line_again, *blocks,
    ]


def statistics(column: pa.Array) -> np.ndarray:
    """A row of NAMES for each text of a column; null: the empty text."""
    out = np.zeros((len(column), len(NAMES)))
    for chunk in chunks(column):
        w = words(chunk)
        h = w.hashes()
        for i in range(len(chunk)):
            a, b, o = w.first[i], w.first[i + 1], chunk.off[i]
            out[chunk.first + i] = _one(chunk.buf[o : chunk.off[i + 1]], w.start[a:b] - o, w.end[a:b] - o, h[a:b])
    return out


@dataclass
class Trees:
    """Complete trees of one depth: node i has children 2i+1 and 2i+2; leaves come after the inner nodes."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), self.base)
        node, t, r = np.zeros((len(x), trees), np.int64), np.arange(trees), np.arange(len(x))[:, None]
        for _ in range(inner.bit_length()):
            node = 2 * node + 1 + (x[r, self.feature[t, node]] > self.threshold[t, node])
        return self.base + self.leaf[t, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 2.0, least: float = 3.0) -> Trees:
    """Boosting of the logistic loss on quantile histograms. One class only: its rate, and no trees; no rows: one half."""
    inner = (1 << depth) - 1
    p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Trees(float(np.log(p / (1 - p))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(np.unique(y)) < 2:
        return model
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(f)], axis=1)  # code > b: x > edges[b]
    code += np.arange(f) * bins
    raw = np.full(n, model.base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        node, feature, threshold = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            nodes, low = 1 << level, (1 << level) - 1
            at = ((node - low)[:, None] * (f * bins) + code).ravel()
            sums = [np.bincount(at, np.repeat(v, f), nodes * f * bins).reshape(nodes, f, bins).cumsum(axis=2) for v in (grad, hess)]
            (gl, hl), (g, h) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g**2 / (h + penalty)
            gain[(hl < least) | (h - hl < least)] = -1
            for j in range(f):
                gain[:, j, len(edges[j]) :] = -1
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k in range(nodes):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6:
                    feature[low + k], threshold[low + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        g, h = (np.bincount(node - inner, v, inner + 1) for v in (grad, hess))
        leaf = -rate * g / (h + penalty)
        raw += leaf[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(model.base, np.array(features), np.array(thresholds), np.array(leaves))


def held_out(doc_id) -> F.Column:
    """Rows that the model never learns from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _measure(batches):
    for batch in batches:
        x = statistics(batch.column("text"))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), lists], ["doc_id", "y", "x"])


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """What is learned from: doc_id, y, x (statistics) of at most `rows` labelled documents that are not held out, those with
    the least hash of doc_id. Rows without a label or an id are not learned from. A label given repeatedly for one id counts
    once, and each of two different ones once; of documents that share an id, that of least statistics counts. So the bound
    holds whatever repeats, and nothing depends on the order of rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out(F.col("doc_id"))).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    measured = id_text(docs).join(F.broadcast(known), "doc_id").select("doc_id", "y", "text").mapInArrow(_measure, "doc_id long, y double, x array<double>")
    return measured.groupBy("doc_id", "y").agg(F.min("x").alias("x"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, **options) -> Trees:
    """Fits on sample(): at most `rows` rows reach the driver."""
    got = sample(docs, labels, rows).toArrow()
    x, y = np.array(got["x"].to_pylist()).reshape(-1, len(NAMES)), got["y"].to_numpy()
    # rows arrive in an order that depends on the tasks; sums of floats should not
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order], **options)


def _score(model):
    def run(batches):
        for batch in batches:
            s = model.score(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(s)], ["row", "score"])

    return run


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """`docs` as a column `row`, with score: how likely quality is 1, between 0 and 1."""
    return carry(docs, _score(model), "score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Scores every text of `docs`, learning from `labels` (doc_id, quality 0 or 1).

    Returns one row a row of `docs`: doc_id, held_out, score, predicted (1 if score >= threshold, else 0).

    Null text: scored as the empty text. Null doc_id: held out if the empty text's checksum says so, scored like others.
    Very long texts are measured whole, in blocks. Ties: equal texts have equal scores. Repeated rows are each returned.
    No labels, or of one class: all texts get the same score. Empty table: empty result. Other columns, whatever their
    names, are not looked at.
    """
    found = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels, **options))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """`docs` without the rows that score below the threshold. Nulls, very long texts, ties and repeated rows as in
    quality_scores(): a row stays or goes by its own text, and each repeat with it. All columns are carried, whatever their
    names. Empty table: empty result."""
    found = score(docs, train(docs, labels, **options)).where(F.col("score") >= threshold)
    return found.select(*(F.col(f"row.`{c}`") for c in docs.columns))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
