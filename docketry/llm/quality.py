"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training: a bounded sample of labelled rows (``max_train_rows``) is reduced to statistics on the
executors; the driver receives that small matrix only, bins each statistic by quantiles and grows
depth-wise trees from gradient histograms. The trees are flattened into three arrays in heap order,
so scoring walks all rows and all trees one level at a time in numpy.

Scoring is one map over the documents: no shuffle, whole texts, nothing but the model is shipped.

Edge cases: a null or empty text has all-zero statistics and gets a score like any other; a null
id takes part and counts as crc 0; repeated rows are scored each; an empty table gives an empty result;
without usable labels every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, crc_mod, map_batches, read, sigmoid, texts_of

#: ASCII symbols that get a statistic of their own.
SYMBOLS = b"#$%&*|!?.,<>{}=_-"
STATISTICS = [
    "log_bytes", "log_words", "mean_word", "distinct_words", "log_lines", "log_mean_line", "repeated_lines",
    "upper", "digits", "punctuation", "space", "high_bytes", "entropy", "top_word", "adjacent_equal",
    "long_words", "short_words", "ended_lines", "symbol_words", *(f"share_{chr(c)}" for c in SYMBOLS),
]
_UPPER, _DIGIT = slice(65, 91), slice(48, 58)
_PUNCT = np.array([33 <= c <= 126 and not chr(c).isalnum() for c in range(256)])
_SYMBOLS = np.frombuffer(SYMBOLS, np.uint8)


def statistics(text: bytes | None) -> np.ndarray:
    """The statistics of one whole text, by position in ``STATISTICS``."""
    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts / n
    words, lines = text.split(), text.split(b"\n")
    m = max(1, len(words))
    freq = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen = share[share > 0]
    space = counts[32] + counts[9:14].sum()
    out[:19] = (
        np.log1p(n), np.log1p(len(words)), (n - space) / m, len(freq) / m, np.log1p(len(lines)),
        np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), share[_UPPER].sum(), share[_DIGIT].sum(),
        share[_PUNCT].sum(), space / n, share[128:].sum(), -(seen * np.log2(seen)).sum(),
        max(freq.values(), default=0) / m, sum(map(eq, words, words[1:])) / m, (lengths > 15).sum() / m,
        (lengths < 3).sum() / m, sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
        counts[_SYMBOLS[:7]].sum() / m,
    )
    out[19:] = share[_SYMBOLS]
    return out


@dataclass
class Trees:
    """Complete binary trees in heap order: ``feature`` and ``cut`` are (trees, inner nodes), ``leaf`` (trees, leaves)."""

    base: float
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.cut[trees, at])
        return self.base + self.leaf[trees, at - (2**self.depth - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0
) -> Trees:
    """Second-order boosting of the logistic loss from per-node histograms of gradients."""
    inner, leaves, k = 2**depth - 1, 2**depth, x.shape[1] if x.ndim == 2 else len(STATISTICS)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    feature, cuts, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if not len(y) or y.min() == y.max():
        return Trees(base, depth, feature[:1], cuts[:1], leaf[:1])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    margin = np.full(len(y), base)
    for t in range(trees):
        p = sigmoid(margin)
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)  # place within the level
        for level in range(depth):
            width = 2**level
            node_g, node_h = np.bincount(at, g, width), np.bincount(at, h, width)
            best = np.zeros(width) + 1e-9
            pick, where = np.zeros(width, np.int64), np.full(width, bins)
            for j in range(k):
                cell = at * bins + binned[j]
                left_g = np.bincount(cell, g, width * bins).reshape(width, bins).cumsum(1)
                left_h = np.bincount(cell, h, width * bins).reshape(width, bins).cumsum(1)
                right_g, right_h = node_g[:, None] - left_g, node_h[:, None] - left_h
                gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - (node_g**2 / (node_h + l2))[:, None]
                gain[(left_h < least) | (right_h < least)] = 0
                gain[:, len(edges[j]) :] = 0
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                better = top > best
                best[better], pick[better], where[better] = top[better], j, b[better]
            nodes = width - 1 + np.arange(width)
            feature[t, nodes] = pick
            cuts[t, nodes] = [edges[j][b] if b < bins else np.inf for j, b in zip(pick, where, strict=True)]
            at = 2 * at + (binned[pick[at], np.arange(len(y))] > where[at])
        leaf[t] = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        margin += leaf[t][at]
    return Trees(base, depth, feature, cuts, leaf)


def _matrix(batch: pa.RecordBatch, column: str = "text") -> np.ndarray:
    return np.stack([statistics(t) for t in texts_of(batch.column(column))])


def train(docs: DataFrame, labels: DataFrame, label: str, max_train_rows: int = 12_000, seed: int = 7) -> Trees:
    """Fit on at most ``max_train_rows`` rows of ``labels(doc_id, <label>)``; rows with null id or label are left out."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    picked = bounded_sample(rows.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id", max_train_rows, seed)

    def measure(batch: pa.RecordBatch):
        x = _matrix(batch)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # at most max_train_rows ids and bits: a proven bound for the broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    one = map_batches(joined, measure, "doc_id long, y int, x array<double>").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x"))  # of texts under one id the least
    got = one.toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist()) if len(got) else np.zeros((0, len(STATISTICS)))
    return fit_trees(x, got["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, score of every row of ``docs``."""

    def run(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)))], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; rows with crc32(doc_id) mod 3 = 1 are held out of training."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs, labels.filter(crc_mod("doc_id", 3) != 1), "quality")
    return score(docs, model).select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
