"""Document fingerprints by locally consistent parsing.

A text is parsed into a hierarchy of phrases. On each level runs of one symbol become one symbol; then
deterministic coin tossing labels every symbol from itself and its left neighbour (twice the lowest differing bit,
plus that bit), and repeats until labels are below 8; phrases start at local maxima of the labels. The name of a
phrase is a hash of the names in it and a symbol of the next level. A boundary depends on a few neighbours only, so equal
substrings get the same phrases in their interior wherever they stand.

A fingerprint keeps, for two levels, the ``KEEP`` smallest hashes of the bag of phrase names; likeness is the mean over levels of the
Jaccard estimate from these bottom samples. All numpy, over many documents at once.

``with_next`` pairs every document with the next one by ascending id without gathering texts: ids are cut into ranges at
quantiles, and only the first document of each range is sent to the range before it as well.

Edge cases: a null text counts as empty and has the empty fingerprint; two empty fingerprints are alike (1), an empty and another
one are not (0); ids that repeat are ordered by text; null ids come first; an empty table gives an empty result; the next of a single document is
itself; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices, splitmix

LEVELS, KEEP = (2, 3), 32
#: Code points parsed at a time (a longer text is parsed alone).
STEP = 400_000
#: Documents of one range of ids, about, and ranges at most (beyond, ranges grow; a task sorts and streams its range).
RANGE_ROWS, MAX_RANGES = 2_000, 65_536
_LOW = np.array([(i & -i).bit_length() - 1 if i else 0 for i in range(256)], np.uint8)
_MUL = np.uint64(0x03F79D71B4CB0A89)  # a de Bruijn sequence: the top six bits of its multiples tell powers of two apart
_BIT = np.zeros(64, np.uint8)
_BIT[[(int(_MUL) << i & (1 << 64) - 1) >> 58 for i in range(64)]] = np.arange(64)
_TOSS = np.array([[2 * _LOW[a ^ b] + (b >> _LOW[a ^ b] & 1) for b in range(128)] for a in range(128)], np.uint8).ravel()


def coin_tossing(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8; neighbours of unlike names get unlike labels. ``first`` marks the first symbol of each document."""
    x = names.copy()
    x[1:] ^= names[:-1]
    x[first] = names[first]
    bit = _BIT[((x & (~x + np.uint64(1))) * _MUL) >> np.uint64(58)]
    label = (bit << np.uint8(1)) | ((names >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    for _ in range(2):  # 128 labels, then 14, then 8
        at = label.astype(np.uint16)
        at[1:] |= label[:-1].astype(np.uint16) << 7
        at[first] = label[first]
        label = _TOSS[at]
    return label


def collapse(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one name within a document become one symbol, named by the name and the length."""
    new = np.ones(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    new[starts] = True
    if new.all():
        return names, starts
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(names)))
    out = names[at]
    many = length > 1
    out[many] = splitmix(out[many] ^ (length[many].astype(np.uint64) << np.uint64(32)))
    return out, np.searchsorted(at, starts)


def level_up(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parse one level: the names of the phrases, and where each document starts among them."""
    names, starts = collapse(names, starts)
    label = coin_tossing(names, starts)
    cut = np.zeros(len(names), bool)
    if len(names) > 2:
        cut[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    cut[starts[1:] - 1] = False  # the last symbol of a document has no right neighbour, whatever comes after it here
    cut[starts] = True
    at = np.flatnonzero(cut)
    place = np.arange(len(names), dtype=np.int64) - np.repeat(at, np.diff(np.append(at, len(names))))
    mixed = splitmix(names + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return splitmix(np.add.reduceat(mixed, at)), np.searchsorted(at, starts)


def smallest(names: np.ndarray, level: int) -> np.ndarray:
    """The ``KEEP`` smallest hashes of a bag of names: an n-th occurrence counts as a name of its own."""
    x = np.sort(names)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    if not new.all():
        at = np.flatnonzero(new)
        nth = np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
        x = x + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    short = (splitmix(x + np.uint64(level)) >> np.uint64(32)).astype(np.uint32)
    if len(short) > 8 * KEEP:
        short = np.partition(short, 2 * KEEP)[: 2 * KEEP]
    return np.unique(short)[:KEEP]


def sketches(texts: list[str]) -> list[tuple[np.ndarray, ...]]:
    """For each text and level, the smallest ``KEEP`` hashes (uint32, ascending) of its phrases."""
    out: list[tuple[np.ndarray, ...]] = [()] * len(texts)
    none = np.zeros(0, np.uint32)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= STEP):
            size += len(texts[hi])
            hi += 1
        some = [i for i in range(lo, hi) if texts[i]]
        for i in range(lo, hi):
            out[i] = (none,) * len(LEVELS)
        if some:
            names = np.frombuffer("".join(texts[i] for i in some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            starts = np.concatenate([[0], np.cumsum([len(texts[i]) for i in some])[:-1]])
            kept = []
            for level in range(1, max(LEVELS) + 1):
                names, starts = level_up(names, starts)
                if level in LEVELS:
                    ends = np.append(starts[1:], len(names))
                    kept.append([smallest(names[s:e], level) for s, e in zip(starts, ends, strict=True)])
            for i, *of in zip(some, *kept, strict=True):
                out[i] = tuple(of)
        lo = hi
    return out


def encode(sketch: tuple[np.ndarray, ...]) -> str:
    return ".".join(s.astype(">u4").tobytes().hex() for s in sketch)


def likeness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """Mean over levels of the share of common hashes among the smallest of both."""
    total = 0.0
    for x, y in zip(a, b, strict=True):
        if not len(x) and not len(y):
            total += 1
            continue
        both = np.union1d(x, y)
        if len(x) == KEEP or len(y) == KEEP:  # a full sample covers hashes up to its last only
            both = both[: max(KEEP, 1)]
        total += len(np.intersect1d(np.intersect1d(x, y, True), both, True)) / len(both)
    return total / len(a)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``docs(doc_id, text)`` in ranges of ids, sorted, each followed by the first row of the next range (``extra``)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    ranges = max(1, min(MAX_RANGES, n // range_rows))
    cuts = np.zeros(0, np.int64)
    if ranges > 1:
        found = rows.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges)).alias("q")).first()["q"]
        cuts = np.unique(np.array(found or [], np.int64))

    def place(ids: pa.Array) -> pa.Array:  # the ids alone go to Python; null ids to the first range
        return pa.array(np.searchsorted(cuts, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    rows = rows.withColumn("range", F.arrow_udf(place, "int")("doc_id"))
    # the first id of each range that has rows; the heads of ranges, at most MAX_RANGES rows, go to the range before
    firsts = rows.groupBy("range").agg(F.min(F.struct("doc_id")).alias("f")).select("range", "f.doc_id").orderBy("range").collect()
    if not firsts:
        return rows.withColumn("extra", F.lit(False)).limit(0)
    to = {r["range"]: firsts[i - 1]["range"] for i, r in enumerate(firsts)}
    heads = docs.sparkSession.createDataFrame([(r["range"], r["doc_id"], to[r["range"]]) for r in firsts], "r int, id long, to int")
    first_texts = (
        rows.join(F.broadcast(heads), (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("id")))
        .groupBy("r", "id", "to")
        .agg(F.min("text").alias("text"))
        .select(F.col("id").alias("doc_id"), "text", F.col("to").alias("range"), F.lit(True).alias("extra"))
    )
    both = rows.withColumn("extra", F.lit(False)).unionByName(first_texts)
    return both.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "extra", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint, that of the edited text, and likenesses, for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row waits for the one after it
        held: list[tuple] = []
        for batch in batches:
            for lo, hi in slices(pc.binary_length(batch.column("text")).to_pylist()):
                part = batch.slice(lo, hi - lo)
                rows = held + list(zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "extra")), strict=True))
                own = sketches([t for _, t, _ in rows])
                todo = [i for i in range(len(rows) - 1) if not rows[i][2]]
                new = [edited(rows[i][1], rows[i + 1][1]) for i in todo]
                after = sketches(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows[i][0] for i in todo], pa.int64()),
                        pa.array([len(rows[i][1]) for i in todo], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
                        pa.array([encode(own[i]) for i in todo], pa.string()),
                        pa.array([encode(s) for s in after], pa.string()),
                        pa.array([likeness(own[i], s) for i, s in zip(todo, after, strict=True)], pa.float64()),
                        pa.array([likeness(own[i], own[i + 1]) for i in todo], pa.float64()),
                    ],
                    names,
                )
                held = rows[-1:]
        # what is left is the first row of the next range, which that range reports

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return with_next(docs).mapInArrow(run, SCHEMA)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its edited text and its next document."""
    return fingerprints(read(spark, sf_dir, "documents"))
