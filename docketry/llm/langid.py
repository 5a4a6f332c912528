"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (after lower-casing A-Z); a softmax over languages
reads it. Both are trained by stochastic gradient descent in numpy on a bounded sample of documents: at most ``max_per_lang`` of each language
and ``max_rows`` in all, which languages fill in turns, so with fewer languages than that none is left out. A document gives its whole text, or windows
spread evenly over all of it where it is long, and two short pieces, as n-gram counts made on the executors.

A tenth of the documents, with all their pieces, is held back for calibration: of a temperature; of a bar on the confidence, the least one
at which 99 % of what passes is right (if there is none, everything is rejected); and of bars on the familiarity of a text, which is the mean
log-probability of its n-grams in the training texts of the predicted language. These stand, for texts of three classes of length, at a share of the
held-back texts that may be rejected. The share is the least of ``SHARES`` at which nine in ten texts of unseen languages are rejected, judged by
leaving languages out of training in turn. A prediction under a bar is marked ``rejected``.

For scoring, embedding times softmax weights collapse into one row per bucket; a text's logits are the mean of
the rows of its n-grams, the same numbers. Whole texts, one map, no shuffle.

Edge cases: a null text and one without a letter is ``und`` with score 0; so is every text if no language was learned; null langs
are not learned; repeated rows are predicted each; null ids take part (crc counts as 0) and are told apart by their texts in sampling; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, cut, map_batches, read, slices, tag_of, texts_of

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
UND = "und"
LETTER = re.compile(r"[^\W\d_]")
PIECES = (3, 12)
#: A longer text is learned from ``WINDOWS`` parts of it that add up to so many bytes.
WHOLE, WINDOWS = 8_000, 8
#: Shares of held-back texts that may be rejected, languages left out in turn, n-grams from which on a class of length begins.
SHARES, LEFT_OUT, LENGTHS = (0.005, 0.01, 0.02, 0.05), 3, (60, 300)


#: Bytes of a text whose n-grams are hashed at a time.
STEP = 1_000_000


def grams(text: bytes) -> np.ndarray:
    """Buckets of all byte n-grams, one space before and after."""
    return np.concatenate(list(gram_parts(text)))


def gram_parts(text: bytes):
    """The same in parts: each has the n-grams that start in one stretch of ``STEP`` bytes."""
    padded = b" " + text.lower() + b" "
    for start in range(0, len(padded), STEP):
        x = np.frombuffer(padded[start : start + STEP + max(GRAMS) - 1], np.uint8).astype(np.uint32)
        for n in GRAMS:
            m = min(STEP, len(x) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for j in range(n):
                h = (h ^ x[j : m + j]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            yield (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 15)


@dataclass
class Languages:
    names: list[str]
    table: np.ndarray  # buckets x languages: embeddings times softmax weights, over the temperature
    bias: np.ndarray
    sure: float  # bar on the confidence
    familiar: np.ndarray | None = None  # buckets x languages: log-probabilities of n-grams
    bars: np.ndarray | None = None  # on the familiarity, by class of length

    def sums(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Mean rows of both tables side by side, and numbers of n-grams, of whole texts; short ones are gathered into slices of bounded size."""
        both = self.table if self.familiar is None else np.hstack([self.table, self.familiar])
        out, size = np.zeros((len(texts), both.shape[1])), np.ones(len(texts), np.int64)
        for lo, hi in slices([len(t) for t in texts], STEP):
            if hi - lo == 1:  # a long one is counted by parts, and summed a language at a time
                counts = np.zeros(len(both), np.float64)
                for part in gram_parts(texts[lo]):
                    counts += np.bincount(part, minlength=len(both))
                size[lo] = max(1, int(counts.sum()))
                out[lo] = [counts @ both[:, c].astype(np.float64) / size[lo] for c in range(both.shape[1])]
                continue
            part = [grams(t) for t in texts[lo:hi]]
            at = np.concatenate([[0], np.cumsum([len(p) for p in part])])
            flat = np.concatenate(part)
            size[lo:hi] = np.diff(at)
            for c in range(both.shape[1]):
                sums = np.add.reduceat(both[:, c].take(flat), at[:-1], dtype=np.float64)
                out[lo:hi, c] = sums / size[lo:hi]
        return out, size

    def judge(self, means: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the best language, its probability, and whether it is rejected."""
        k = len(self.names)
        p = softmax(means[:, :k] + self.bias)
        best = p.argmax(1)
        top = p[np.arange(len(best)), best]
        rejected = top < self.sure
        if self.familiar is not None:
            rejected |= means[np.arange(len(best)), k + best] < self.bars[length_class(size)]
        return best, top, rejected

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        best, top, rejected = self.judge(*self.sums(texts))
        return [self.names[i] for i in best], top, rejected


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def length_class(n_grams: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, n_grams, side="right")


#: (document, language, buckets, counts) of a text or a piece.
Row = tuple[int, int, np.ndarray, np.ndarray]


def learn(rows: list[Row], k: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Table and bias by stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    emb, w, bias = rng.normal(0, 0.1, (BUCKETS, dim)), rng.normal(0, 0.3, (k, dim)), np.zeros(k)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            _, y, at, n = rows[i]
            share = n / n.sum()
            x = share @ emb[at]
            z = w @ x + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ w
            w -= 0.1 * step * np.outer(p, x)
            bias -= 0.05 * step * p
            emb[at] -= step * np.outer(share * min(len(at), 50), back)
    return emb @ w.T, bias


def means_of(model: Languages, rows: list[Row]) -> tuple[np.ndarray, np.ndarray]:
    """What ``sums`` gives, from counts."""
    both = np.hstack([model.table, model.familiar])
    means = [(n / n.sum()) @ both[at] for _, _, at, n in rows]
    return np.array(means).reshape(-1, both.shape[1]), np.array([n.sum() for *_, n in rows], np.int64)


def fit_without_bars(rows: list[Row], held: list[Row], names: list[str], dim: int, epochs: int, rate: float, seed: int) -> Languages:
    k = len(names)
    table, bias = learn(rows, k, dim, epochs, rate, seed)
    counts = np.full((k, BUCKETS), 0.1)
    for _, y, at, n in rows:
        counts[y, at] += n
    familiar = np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32)
    raw = np.array([(n / n.sum()) @ table[at] + bias for _, _, at, n in held]).reshape(-1, k)
    truth = np.array([y for _, y, _, _ in held], int)
    heat, sure = 1.0, 0.0
    if len(held) and k > 1:
        heat = min(np.geomspace(0.25, 8, 41), key=lambda t: -np.log(softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).mean())
        p = softmax(raw / heat)
        right, top = p.argmax(1) == truth, p.max(1)
        good = [float(bar) for bar in [0.0, *np.unique(np.floor(top * 1000) / 1000)] if (top >= bar).any() and right[top >= bar].mean() >= 0.99]
        sure = min(good, default=2.0)
    return Languages(names, (table / heat).astype(np.float32), bias / heat, sure, familiar)


def bars_at(share: float, model: Languages, held: list[Row]) -> np.ndarray:
    """Familiarity under which ``share`` of the held-back texts are that are rightly predicted, by class of length."""
    means, size = means_of(model, held)
    truth, k = np.array([y for _, y, _, _ in held], int), len(model.names)
    right = (means[:, :k] + model.bias).argmax(1) == truth
    own, cls = means[np.arange(len(truth)), k + truth], length_class(size)
    every = own[right] if right.any() else np.zeros(1)  # over all that there is
    return np.array([np.quantile(own[right & (cls == c)] if (right & (cls == c)).sum() >= 20 else every, share) for c in range(len(LENGTHS) + 1)])


def fit(rows: list[Row], names: list[str], dim: int = 16, epochs: int = 8, rate: float = 2.0, seed: int = 5) -> Languages:
    """A tenth of the documents is held back for calibration; a document is never on both sides."""
    docs = np.random.default_rng(seed).permutation(np.unique([r[0] for r in rows]))
    aside = set(docs[: len(docs) // 10].tolist())
    used, held = [r for r in rows if r[0] not in aside], [r for r in rows if r[0] in aside]
    model = fit_without_bars(used, held, names, dim, epochs, rate, seed)
    if not held:
        model.familiar = None
        return model
    passed = dict.fromkeys(SHARES, 0)
    unseen = 0
    counts = np.bincount([r[1] for r in rows], minlength=len(names))
    for out in np.argsort(-counts, kind="stable")[:LEFT_OUT].tolist() if len(names) > 2 else []:
        rest = [i for i in range(len(names)) if i != out]
        new = {i: j for j, i in enumerate(rest)}
        known = [(d, new[y], at, n) for d, y, at, n in used if y != out]
        inside = [(d, new[y], at, n) for d, y, at, n in held if y != out]
        strange = [(d, 0, at, n) for d, y, at, n in held if y == out]
        if not inside or not strange:
            continue
        part = fit_without_bars(known, inside, [names[i] for i in rest], dim, max(1, epochs // 2), rate, seed)
        unseen += len(strange)
        for share in SHARES:
            part.bars = bars_at(share, part, inside)
            passed[share] += int((~part.judge(*means_of(part, strange))[2]).sum())
    share = next((x for x in SHARES if passed[x] <= 0.1 * unseen), SHARES[-1])
    model.bars = bars_at(share, model, held)
    return model


def spread(text: bytes) -> list[bytes]:
    """The text, or windows from its start to its end."""
    if len(text) <= WHOLE:
        return [text]
    size = WHOLE // WINDOWS
    return [text[s : s + size] for s in np.linspace(0, len(text) - size, WINDOWS).astype(int)]


def train(docs: DataFrame, max_per_lang: int = 600, max_rows: int = 3_000, seed: int = 3) -> Languages:
    """Learn from ``docs(doc_id, text, lang)``.

    The first documents of every language in the order of a hash of id and text, at most ``max_per_lang``; of these the first of all languages,
    then the second ones, until there are ``max_rows``. A hash filter thins frequent languages before they are ranked.
    """
    known = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    order = F.xxhash64("doc_id", "text", F.lit(seed))
    counts = cut(known.groupBy("lang").count().select(F.col("lang").alias("l"), "count"))
    if counts.count() <= 100_000:  # else a join that deals out both sides
        counts = F.broadcast(counts)
    few = known.withColumn("h", order).join(counts, F.col("lang") == F.col("l"))
    few = few.filter((F.col("count") <= 2 * max_per_lang) | (F.pmod("h", F.lit(1_000_003)) < F.lit(1_000_003 * 1.5 * max_per_lang) / F.col("count") + 1))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    few = few.withColumn("rank", rank).filter(F.col("rank") <= max_per_lang)
    picked = few.orderBy("rank", "h", "lang").limit(max_rows).select("doc_id", "lang", "text")

    def count(batch: pa.RecordBatch):
        out = []
        for doc, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), texts_of(batch.column("text")), strict=True):
            words, tag = text.split(), tag_of(text)
            rng = np.random.default_rng(abs(tag))
            pieces = [spread(text)] + [[b" ".join(words[(s := int(rng.integers(0, len(words)))) : s + k])] for k in PIECES if len(words) > k]
            for piece in pieces:
                b, c = np.unique(np.concatenate([grams(x) for x in piece]), return_counts=True)
                out.append((tag ^ (doc or 0), lang, b.astype(np.int32), c.astype(np.int32)))
        kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["doc", "lang", "at", "n"])

    # (1 + pieces) rows for each of max_rows documents, of at most 3 * (WHOLE + 2) counts each
    got = map_batches(picked, count, "doc long, lang string, at array<int>, n array<int>").toPandas()
    if not len(got):
        return Languages([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 0.0)
    names = sorted(got["lang"].unique())
    number = {x: i for i, x in enumerate(names)}
    columns = zip(got["doc"], got["lang"], got["at"], got["n"], strict=True)
    rows = [(int(d), number[x], np.asarray(a, np.int32), np.asarray(n, np.float32)) for d, x, a, n in columns]
    del got
    rows.sort(key=lambda r: (r[0], r[1], len(r[2]), crc32(r[2].tobytes()), crc32(r[3].tobytes())))  # as executors return them in any order
    return fit(rows, names)


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row of ``docs(doc_id, text)``."""

    def run(batch: pa.RecordBatch):
        texts = texts_of(batch.column("text"))
        some = [i for i, t in enumerate(texts) if t and model.names and LETTER.search(t.decode())]
        names, scores, rejected = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if some:
            found, scores[some], rejected[some] = model.predict([texts[i] for i in some])
            for i, name in zip(some, found, strict=True):
                names[i] = name
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)],
            ["doc_id", "lang_pred", "score", "rejected"],
        )

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with crc32(doc_id) mod 3 = 1 are held out of training."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs.filter(crc_mod("doc_id", 3) != 1))
    return predict(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
