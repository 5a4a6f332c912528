"""Toxicity: a linear-chain conditional random field tags toxic tokens; marginals make scores and offsets.

The corpus has document labels only, so token labels are derived first: a greedy cover of the toxic
training documents by word shapes (whole words and prefixes) that clean training documents
do not contain. Tokens that carry a chosen shape are labelled toxic, all other tokens of the sample
clean. On these labelled tokens a two-state chain is trained with padded, vectorised forward-backward in numpy.

Scoring: the emission of a token is the sum of the weights of its own shapes and of its neighbours';
it is looked up once per distinct word. Forward-backward runs as a recursion on odds, vectorised over
documents of like length. A document's score is a logistic function of its two largest and its summed
token odds; offsets are the runs of tokens whose marginal is at least ``span_at``.

Training reads whole texts of a bounded sample: at most ``max_train_rows`` documents, and of these, in the order of a hash, those that
add up to ``max_train_chars`` characters. Scoring reads whole texts in one map, without a shuffle.

Edge cases: null, empty and letterless texts have no tokens and get the score of the intercept; repeated rows
are scored each; null ids take part (crc counts as 0); without labels of both kinds the score is 0 for all; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, crc_mod, cut, map_batches, read, sigmoid, slices

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 18
PREFIXES = (4, 5, 6, 7, 8)
#: Padded cells of one forward-backward block.
CELLS = 750_000
#: Words whose emissions a worker remembers, and characters of texts that it tags at a time.
WORDS, TAGGED = 200_000, 2_000_000
REJECT_AT = 0.3


def matches(text: str) -> Iterator[re.Match]:
    """The words of a text, at their offsets in it; lower-cased before, unless a lower-cased character is longer and moves offsets."""
    low = text.lower()
    return WORD.finditer(low if len(low) == len(text) else text)


def tokens(text: str | None) -> list[str]:
    """The words of ``matches``, lower-cased."""
    if not text:
        return []
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def shapes(word: str) -> list[str]:
    """What can mark a token as toxic: the word and its prefixes."""
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


def _bucket(kind: str, value: str) -> int:
    return xxhash.xxh32_intdigest(f"{kind}{value}".encode()) % BUCKETS


def own_features(word: str) -> list[int]:
    return [_bucket("w", word), *(_bucket(f"p{k}", word[:k]) for k in PREFIXES if len(word) > k), _bucket("s", word[-3:]), _bucket("l", str(min(len(word), 20)))]


def near_features(word: str, side: str) -> list[int]:
    return [_bucket(side, word), _bucket(side + "p", word[:4])]


@dataclass
class Chain:
    """Weights are differences toxic minus clean, so one number per feature."""

    weight: np.ndarray
    move: np.ndarray  # 2 x 2 transition scores
    start: float
    doc: np.ndarray  # intercept, weights of the two largest token log-odds and of the log of summed marginals
    fitted: bool = True
    _words: "Emissions | None" = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_words": None}

    def emissions(self, words: list[str]) -> np.ndarray:
        if self._words is None or len(self._words) > WORDS:
            self._words = Emissions(self.weight)
        at = np.fromiter(map(self._words.__getitem__, words), np.int64, len(words))
        e = self._words.table[at]
        out = e[:, 0].copy()
        out[1:] += e[:-1, 1]
        out[:-1] += e[1:, 2]
        return out


class Emissions(dict):
    """Row of ``table`` by word: its emission for itself, for the token after it and for the token before it."""

    def __init__(self, weight: np.ndarray):
        super().__init__()
        self.weight, self.table = weight, np.zeros((4096, 3))

    def __missing__(self, w: str) -> int:
        at = self[w] = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        g = self.weight
        self.table[at] = [sum([g[i] for i in f]) for f in (own_features(w), near_features(w, "<"), near_features(w, ">"))]
        return at


def log_odds(chain: Chain, docs: list[np.ndarray]) -> list[np.ndarray]:
    """Per document, the log-odds of toxic against clean at every token, from forward-backward.

    With two states the forward message is one ratio: r_t = exp(e_t) * (a01 + a11 r) / (a00 + a10 r).
    """
    a = np.exp(chain.move)
    order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
    out: list[np.ndarray] = [np.zeros(0)] * len(docs)
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(docs[order[end]]) <= CELLS:
            end += 1
        block = order[at:end][::-1]  # longest first
        at = end
        lengths = np.array([len(docs[i]) for i in block])
        steps = int(lengths[0])
        if not steps:
            continue
        e = np.zeros((steps, len(block)))
        for j, i in enumerate(block):
            e[: lengths[j], j] = docs[i]
        x = np.exp(np.clip(e, -30, 30))
        live = (lengths[None, :] > np.arange(steps)[:, None]).sum(1)
        f = np.empty_like(x)
        r = np.full(len(block), np.exp(chain.start)) * x[0]
        f[0] = r
        for t in range(1, steps):
            n = live[t]
            r = r[:n]
            r = x[t, :n] * (a[0, 1] + a[1, 1] * r) / (a[0, 0] + a[1, 0] * r)
            f[t, :n] = r
        b = np.ones(len(block))
        for t in range(steps - 2, -1, -1):
            n = live[t + 1]
            m = x[t + 1, :n] * b[:n]
            b[:n] = (a[1, 0] + a[1, 1] * m) / (a[0, 0] + a[0, 1] * m)
            f[t, :n] *= b[:n]
        np.log(np.maximum(f, 1e-300), out=f)
        for j, i in enumerate(block):
            out[i] = f[: lengths[j], j].copy()
    return out


def summary(odds: np.ndarray) -> tuple[float, float, float]:
    """A document's two largest token log-odds and the log of its summed marginals."""
    if not len(odds):
        return -12.0, -12.0, -12.0
    top = np.sort(np.partition(odds, -2)[-2:]) if len(odds) > 1 else np.array([-12.0, odds[0]])
    return float(np.clip(top[1], -12, 12)), float(np.clip(top[0], -12, 12)), float(np.clip(np.log(sigmoid(odds).sum() + 1e-9), -12, 12))


def token_labels(docs: list[list[str]], toxic: np.ndarray, least_docs: int = 3, purity: float = 0.85) -> set[str]:
    """Greedy cover: shapes nearly absent from clean documents, taken by the toxic documents they newly explain."""
    of: dict[str, bytes] = {}  # hashes of a word's shapes: no strings are held but those of good shapes

    def marks(d: list[str]) -> np.ndarray:
        for w in d:
            if w not in of:
                of[w] = np.array([xxhash.xxh64_intdigest(s) for s in shapes(w)], np.uint64).tobytes()
        return np.unique(np.frombuffer(b"".join([of[w] for w in set(d)]), np.uint64))

    def counted(wanted: bool) -> tuple[np.ndarray, np.ndarray]:
        found = [marks(d) for d, y in zip(docs, toxic, strict=True) if bool(y) == wanted]
        return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    (kinds, n_dirty), (others, n) = counted(True), counted(False)
    at = np.minimum(np.searchsorted(others, kinds), max(0, len(others) - 1))
    n_clean = np.where(others[at] == kinds, n[at], 0) if len(others) else np.zeros(len(kinds), np.int64)
    scale = max(1, len(toxic) - toxic.sum()) / max(1, toxic.sum())
    some = kinds[(n_dirty >= least_docs) & (n_dirty / (n_dirty + n_clean / scale) >= purity)]
    wanted = set(some.tolist())
    dirty, clean, good = {}, {}, set()
    holders = defaultdict(set)
    for i, (d, y) in enumerate(zip(docs, toxic, strict=True)):
        for w in set(d) if y else ():
            if wanted.isdisjoint(np.frombuffer(of[w], np.uint64).tolist()):
                continue
            for s in shapes(w):
                h = xxhash.xxh64_intdigest(s)
                if h in wanted:
                    k = int(np.searchsorted(kinds, np.uint64(h)))
                    dirty[s], clean[s] = int(n_dirty[k]), int(n_clean[k])
                    good.add(s)
                    holders[s].add(i)
    chosen: set[str] = set()
    open_docs = {i for i, y in enumerate(toxic) if y}
    while holders and open_docs:
        best = max(sorted(holders), key=lambda s: (len(holders[s] & open_docs), -clean[s], s[0] == "=", len(s)))
        gain = holders.pop(best) & open_docs
        if len(gain) < least_docs:
            break
        chosen.add(best)
        open_docs -= gain
    # shapes as frequent as the chosen ones mark toxicity too, though other shapes explain their documents already
    bar = sorted((dirty[s] for s in chosen), reverse=True)[: max(1, len(chosen) // 2)]
    for s in sorted(good, key=lambda s: (-dirty[s], -len(s), s)):
        if bar and dirty[s] >= 0.5 * bar[-1] and not any(s[1:].startswith(c[1:]) or c[1:].startswith(s[1:]) for c in chosen):
            chosen.add(s)
    return chosen


def fit(texts: list[str], toxic: np.ndarray, epochs: int = 12, seed: int = 3) -> Chain:
    """Derive token labels, train the chain on windows around them, calibrate the document score."""
    rng = np.random.default_rng(seed)
    chain = Chain(np.zeros(BUCKETS), np.zeros((2, 2)), -4.0, np.array([-50.0, 0, 0, 0]), fitted=False)
    if not len(toxic) or toxic.min() == toxic.max():
        return chain
    same: dict[str, str] = {}  # one string object for each distinct word
    docs = [[same.setdefault(w, w) for w in tokens(t)] for t in texts]
    marked = token_labels(docs, toxic)
    is_toxic = {w: any(s in marked for s in shapes(w)) for d in docs for w in set(d)}
    windows: list[tuple[list[str], np.ndarray]] = []
    for d, y in zip(docs, toxic, strict=True):
        tags = np.fromiter((bool(y) and is_toxic[w] for w in d), np.float64, len(d))
        hits = np.flatnonzero(tags)
        spots = rng.choice(hits, min(8, len(hits)), replace=False) if len(hits) else rng.integers(0, max(1, len(d)), 3)
        if not y and d:  # keep what looks toxic in clean documents, it tells the two apart
            spots = np.concatenate([spots, [i for i, w in enumerate(d) if is_toxic[w]][:3]]).astype(int)
        for s in map(int, spots):
            lo = max(0, s - int(rng.integers(4, 20)))
            if d[lo : lo + 32]:
                windows.append((d[lo : lo + 32], tags[lo : lo + 32]))
    g = np.zeros(BUCKETS)
    move, g_move, start = np.zeros((2, 2)), np.zeros((2, 2)), -4.0
    move[0, 1] = -2.0
    packed = []
    for words, tags in windows:
        tok, idx = [], []
        for t, w in enumerate(words):
            own = own_features(w)
            own += near_features(words[t - 1], "<") if t else []
            own += near_features(words[t + 1], ">") if t + 1 < len(words) else []
            tok += [t] * len(own)
            idx += own
        packed.append((np.array(tok, np.int16), np.array(idx, np.int32), tags))
    del windows
    weight, model = np.zeros(BUCKETS), chain
    model.weight, model.move, model.start = weight, move, start
    for _ in range(epochs):
        order = rng.permutation(len(packed))
        for lo in range(0, len(order), 256):
            part = [packed[i] for i in order[lo : lo + 256]]
            e = [np.bincount(t, weight[i], len(y)) for t, i, y in part]
            odds = log_odds(model, e)
            grad = np.zeros(BUCKETS)
            move_grad = np.zeros((2, 2))
            for (t, i, y), o in zip(part, odds, strict=True):
                p = sigmoid(o)
                np.add.at(grad, i, (p - y)[t])
                # transition counts: labels against the product of neighbouring marginals
                q, z = np.stack([1 - p, p]), np.stack([1 - y, y])
                move_grad += q[:, :-1] @ q[:, 1:].T - z[:, :-1] @ z[:, 1:].T
            grad = grad / len(part) + 1e-5 * weight
            g += grad * grad
            weight -= 0.3 * grad / np.sqrt(g + 1e-8)
            move_grad = move_grad / len(part)
            g_move += move_grad**2
            move -= 0.1 * move_grad / np.sqrt(g_move + 1e-6)
            move -= move[0, 0]
    model.fitted, model._words = True, None
    odds = log_odds(model, [model.emissions(d) for d in docs])
    x = np.array([(1.0, *summary(o)) for o in odds])
    beta = np.zeros(4)
    for _ in range(25):  # damped Newton steps of a ridge logistic regression
        p = sigmoid(x @ beta)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(4)
        beta += np.clip(np.linalg.solve(h, x.T @ (toxic - p) - 0.5 * beta), -2, 2)
    model.doc = beta
    return model


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train_rows: int = 4_000, max_train_chars: int = 32_000_000, seed: int = 11
) -> Chain:
    """At most ``max_train_rows`` labelled rows, half of them toxic where there are as many, and ``max_train_chars`` in all.

    Texts are whole; one that is over the rest of the bound is left out. Of several texts under one id the least is taken.
    """
    rows = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = bounded_sample(rows.filter("y = 1"), "doc_id", max_train_rows // 2, seed).unionByName(
        bounded_sample(rows.filter("y = 0"), "doc_id", max_train_rows // 2, seed)
    )
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most max_train_rows ids and bits
    found = cut(found.filter(F.length(text) <= max_train_chars).groupBy("doc_id", "y").agg(F.min(text).alias("text")))
    order, total, taken = F.xxhash64("doc_id", F.lit(seed)), 0, []
    for r in found.select("doc_id", F.length("text").alias("n")).orderBy(order, "doc_id").collect():  # at most max_train_rows
        if total + r["n"] <= max_train_chars:
            total += r["n"]
            taken.append((r["doc_id"],))
    chosen = docs.sparkSession.createDataFrame(taken, "d long")
    return fitted(found.join(F.broadcast(chosen), F.col("doc_id") == F.col("d")).select("doc_id", "y", "text"))


MODEL = "weight binary, move binary, start double, doc binary, fitted boolean"


def fitted(sample: DataFrame) -> Chain:
    """``fit`` on ``sample(doc_id, y, text)`` in one task, which its bound allows: the driver gets the weights (2 MB), no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            rows = pa.Table.from_batches(held).sort_by("doc_id")
            c = fit(rows.column("text").to_pylist(), rows.column("y").to_numpy().astype(np.float64))
            parts = [c.weight.tobytes()], [c.move.tobytes()], [float(c.start)], [c.doc.tobytes()], [c.fitted]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], ["weight", "move", "start", "doc", "fitted"])

    found = sample.repartition(1).mapInArrow(run, MODEL).collect()  # one row, or none without a sample
    if not found:
        return fit([], np.zeros(0))
    weight, move, start, doc, done = found[0]
    numbers = lambda b: np.frombuffer(bytes(b), np.float64).copy()
    return Chain(numbers(weight), numbers(move).reshape(2, 2), start, numbers(doc), done)


SCORED = "doc_id long, score double, n_spans int, spans array<struct<start:int,end:int,probability:double>>"


def spans_of(text: str, odds: np.ndarray, span_at: float) -> list[dict]:
    """Runs of tokens at or over ``span_at`` as code point offsets."""
    bar = np.log(span_at / (1 - span_at))
    if not len(odds) or odds.max() < bar:
        return []
    out: list[dict] = []
    last = -2
    found = list(matches(text))
    for i in np.flatnonzero(odds >= bar):
        p = float(sigmoid(odds[i : i + 1])[0])
        if i == last + 1 and out:
            out[-1] |= {"end": found[i].end(), "probability": max(p, out[-1]["probability"])}
        else:
            out.append({"start": found[i].start(), "end": found[i].end(), "probability": p})
        last = i
    return out


def tagged(chain: Chain, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Start, scores and token log-odds of slices of bounded size."""
    for lo, hi in slices([len(t or "") for t in texts], TAGGED):
        odds = log_odds(chain, [chain.emissions(w) if (w := tokens(t)) else np.zeros(0) for t in texts[lo:hi]])
        x = np.array([(1.0, *summary(o)) for o in odds])
        yield lo, sigmoid(x @ chain.doc) if chain.fitted else np.zeros(hi - lo), odds


def score(docs: DataFrame, chain: Chain, span_at: float = 0.5) -> DataFrame:
    """doc_id, score, n_spans and spans (offsets in code points) of every row of ``docs``."""

    def run(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        scores, spans = [], []
        for lo, part, odds in tagged(chain, texts):
            scores.append(part)
            spans += [spans_of(t, o, span_at) if t and chain.fitted else [] for t, o in zip(texts[lo:], odds, strict=False)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.concatenate(scores)),
                pa.array(list(map(len, spans)), pa.int32()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))),
            ],
            ["doc_id", "score", "n_spans", "spans"],
        )

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, SCORED)


def drop_toxic(docs: DataFrame, chain: Chain, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of ``docs`` scored under ``reject_at``, with all their columns; one map, no join."""

    def run(batch: pa.RecordBatch):
        keep = [part < reject_at for _, part, _ in tagged(chain, batch.column(names.index("text")).to_pylist())]
        yield batch.filter(pa.array(np.concatenate(keep)))

    names = docs.columns
    return map_batches(docs, run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows with crc32(doc_id) mod 4 = 2 are held out of training."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    chain = train(docs, labels.filter(crc_mod("doc_id", 4) != 2))
    return score(docs, chain).select(
        "doc_id",
        (crc_mod("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= REJECT_AT).cast("int").alias("predicted"),
        "n_spans",
        "spans",
    )
