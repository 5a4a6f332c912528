"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over token windows.

Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z lower-cased. Every run of
``window`` consecutive words of a benchmark item is a window; a shorter item is one window of its own
length. A window of a document is hashed from the ids that its words have in the benchmark's vocabulary
(words outside of it end a window at once), looked up in the sorted hash set, and each
hit is verified word by word before it counts.

Plan: a benchmark of up to ``block_windows`` windows is one hash set, broadcast, and one map over the documents without a shuffle. A larger
one is dealt into blocks of about that size by a hash of the window. Blocks are built, broadcast, scanned against all documents and
destroyed one after another, so neither the driver nor a worker ever holds more than one; the hits of each block are cut off as a table of
(row, spans, items) and merged by row.

Edge cases: null and wordless texts have no words and no hits; an item without words has no window; repeated rows
are reported each; a null item id takes part in windows but is not listed; an empty benchmark leaves all documents clean; extra columns, whatever
their names, are ignored or, by ``remove_hits``, carried along.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, map_batches, read, splitmix, tag_column, tag_of, texts_of

#: On lower-cased UTF-8 bytes: what is no ASCII separator, symbol or control.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10


def words_of(text: bytes | None) -> list[bytes]:
    """``bytes.lower`` folds A-Z only, and no byte of a longer UTF-8 sequence is below 0x80."""
    return WORD.findall(text.lower()) if text else []


def hash_windows(ids: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of ``length`` ids."""
    n = len(ids) - length + 1
    h = np.zeros(n, np.uint64)
    mixed = splitmix(ids.astype(np.uint64))
    for j in range(length):
        h = h * np.uint64(0x100000001B3) + mixed[j : j + n]
    return h


@dataclass
class NgramSet:
    """Windows by length: sorted distinct hashes, the words (as ids) behind each hash, and the items that hold them."""

    vocabulary: dict[bytes, int]
    hashes: dict[int, np.ndarray]
    grams: dict[int, list[list[tuple[tuple[int, ...], tuple[str, ...]]]]]

    @classmethod
    def build(cls, windows: list[tuple[tuple[bytes, ...], str | None]]) -> NgramSet:
        vocabulary: dict[bytes, int] = {}
        items: dict[tuple[int, ...], set] = defaultdict(set)
        for words, item in windows:
            items[tuple(vocabulary.setdefault(w, len(vocabulary)) for w in words)].add(item)
        by_length: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for gram in sorted(items):
            h = int(hash_windows(np.array(gram), len(gram))[0])
            by_length[len(gram)][h].append((gram, tuple(sorted(i for i in items[gram] if i is not None))))
        return cls(
            vocabulary,
            {n: np.array(sorted(x), np.uint64) for n, x in by_length.items()},
            {n: [x[h] for h in sorted(x)] for n, x in by_length.items()},
        )

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are inside an occurrence of a window, and whose windows they are."""
        hit, found = np.zeros(len(words), bool), set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for length, hashes in self.hashes.items():
            if len(words) < length:
                continue
            starts = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(starts):
                continue
            h = hash_windows(ids, length)[starts]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for k in np.flatnonzero(hashes[at] == h):
                s = int(starts[k])
                window = tuple(ids[s : s + length].tolist())
                for gram, of in self.grams[length][at[k]]:
                    if gram == window:  # verified
                        hit[s : s + length] = True
                        found.update(of)
        return hit, found


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct (words, item) of all windows, with a block-independent hash to deal them out by."""

    def run(batch: pa.RecordBatch):
        out = []
        for item, text in zip(batch.column("item").to_pylist(), texts_of(batch.column("text")), strict=True):
            words = words_of(text)
            n = min(window, len(words))
            out += [(b" ".join(words[i : i + n]), item) for i in range(len(words) - n + 1) if n]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.binary()), pa.array([i for _, i in out], pa.string())], ["words", "item"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return map_batches(rows, run, "words binary, item string").distinct()


#: Windows of one hash set.
BLOCK_WINDOWS = 200_000
SCAN = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
HITS = "doc_id long, tag long, spans array<struct<s:int,e:int>>, items array<string>"


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def runs_of(hit: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of True."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).reshape(-1, 2)


class Blocks:
    """The windows of a benchmark, dealt into hash sets of which one is live at a time."""

    def __init__(self, benchmark: DataFrame, window: int, block_windows: int):
        self.windows = cut(_windows(benchmark, window))
        self.count = max(1, -(-self.windows.count() // block_windows))

    def build(self, b: int) -> NgramSet:
        """Set ``b``; the driver receives its about ``block_windows`` windows only."""
        part = self.windows.filter(F.pmod(F.xxhash64("words"), F.lit(self.count)) == b)
        return NgramSet.build([(tuple(bytes(r.words).split(b" ")), r.item) for r in part.toLocalIterator()])

    def hits(self, docs: DataFrame) -> DataFrame:
        """``HITS`` of the rows of ``docs(doc_id, text)`` that have any, merged over all sets, one row for each id and text."""
        sc, parts = docs.sparkSession.sparkContext, None
        for b in range(self.count):
            block = sc.broadcast(self.build(b))

            def run(batch: pa.RecordBatch, block=block):
                out = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                    hit, found = block.value.find(words_of(text))
                    if hit.any():
                        out.append((doc, tag_of(text), [{"s": s, "e": e} for s, e in runs_of(hit).tolist()], sorted(found)))
                span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
                kinds = (pa.int64(), pa.int64(), span, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["doc_id", "tag", "spans", "items"])

            part = cut(map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, HITS))
            block.destroy()
            parts = part if parts is None else parts.unionByName(part)
        merged = parts.groupBy("doc_id", "tag").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        return cut(merged)


def _with_hits(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``docs`` and two last columns: spans and items, null for rows without hits."""
    key, tag, spans, items = fresh(docs.columns, "id", "tag", "spans", "items")
    found = hits.toDF(key, tag, spans, items)
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col(key)) & (tag_column(docs["text"]) == F.col(tag)), "left").drop(key, tag)


def _hit_of(spans: list[dict] | None, n: int) -> np.ndarray:
    hit = np.zeros(n, bool)
    for x in spans or []:
        hit[x["s"] : x["e"]] = True
    return hit


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per row of ``docs``: words, words inside windows, items with occurring windows."""
    blocks = Blocks(benchmark, window, block_windows)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    one = rows.sparkSession.sparkContext.broadcast(blocks.build(0)) if blocks.count == 1 else None

    def run(batch: pa.RecordBatch):
        out, texts = [], texts_of(batch.column("text"))
        spans, items = ([None] * len(texts),) * 2 if one else (batch.column(2).to_pylist(), batch.column(3).to_pylist())
        for text, where, whose in zip(texts, spans, items, strict=True):
            words = words_of(text)
            hit, found = one.value.find(words) if one else (_hit_of(where, len(words)), whose or [])
            out.append((len(words), int(hit.sum()), len(found), _digest(found), bool(hit.any())))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    names = [f.split()[0] for f in SCAN.split(", ")]
    return map_batches(rows if one else _with_hits(rows, blocks.hits(rows)), run, SCAN)


def without(text: bytes, words: list[re.Match], hit: np.ndarray) -> bytes:
    """The text without its hit words and what stands between them."""
    parts, last = [], 0
    for s, e in runs_of(hit).tolist():
        parts.append(text[last : words[s].start()])
        last = words[e - 1].end()
    return b"".join([*parts, text[last:]])


def remove_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_share: float = 0.5, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` without its contaminated spans, in the same columns.

    A maximal run of hit words goes with everything between its first and its last word; a document of which
    more than ``drop_share`` of the words are hit goes as a whole. Removal repeats until no window is left, since the words
    around a removed span may form a new one. Clean rows pass unchanged. With several blocks each repetition is a scan of its own, over what the one before changed.
    """
    blocks = Blocks(benchmark, window, block_windows)
    at, columns, schema = docs.columns.index("text"), docs.columns, docs.schema

    def replaced(batch: pa.RecordBatch, texts: list, new: list, drop: list, counts: tuple = ()):
        column = pa.array([None if n is None else n.decode() for n in new], pa.string()) if new is not texts else batch.column(at)
        keep = pa.array([not d for d in drop], pa.bool_())
        out = [column if i == at else batch.column(i) for i in range(len(columns))] + [pa.array(c, pa.int64()) for c in counts]
        return pa.RecordBatch.from_arrays(out, [*(f"c{i}" for i in range(len(columns))), "n0", "n1"] if counts else columns).filter(keep)

    if blocks.count == 1:
        block = docs.sparkSession.sparkContext.broadcast(blocks.build(0))

        def clean(text: bytes) -> bytes | None:
            """The text without its hits; None for one to drop."""
            total = gone = 0
            while True:
                found = list(WORD.finditer(text.lower()))
                total = total or len(found)
                hit, _ = block.value.find([m.group() for m in found])
                if not hit.any():
                    return text
                gone += int(hit.sum())
                if gone > drop_share * total:
                    return None
                text = without(text, found, hit)

        def run(batch: pa.RecordBatch):
            texts = texts_of(batch.column(at))
            new = [None if t is None else clean(t) for t in texts]
            yield replaced(batch, texts, new, [t is not None and n is None for t, n in zip(texts, new, strict=True)])

        return map_batches(docs, run, schema)

    def step(batch: pa.RecordBatch):
        # behind the columns: words at first, words gone so far, spans, items
        texts, new, drop = texts_of(batch.column(at)), [], []
        firsts, gones, spans = (batch.column(len(columns) + k).to_pylist() for k in range(3))
        for i, text in enumerate(texts):
            if spans[i]:
                found = list(WORD.finditer(text.lower()))
                hit = _hit_of(spans[i], len(found))
                firsts[i] = firsts[i] or len(found)
                gones[i] += int(hit.sum())
                text = without(text, found, hit)
            new.append(text)
            drop.append(bool(spans[i]) and gones[i] > drop_share * firsts[i])
        yield replaced(batch, texts, new, drop, (firsts, gones))

    more = "n0 long, n1 long"
    state = docs.withColumns({name: F.lit(0).cast("long") for name in fresh(columns, "n0", "n1")})
    hits, clean_rows = blocks.hits(docs), []
    full = ", ".join([*(f"`c{i}` {t}" for i, (_, t) in enumerate(docs.dtypes)), more])
    while hits.select(F.lit(1)).limit(1).count():
        both = _with_hits(state, hits)
        spans = both.columns[-2]
        clean_rows.append(both.filter(F.col(f"`{spans}`").isNull()).select([f"`{c}`" for c in columns]))
        state = cut(map_batches(both.filter(F.col(f"`{spans}`").isNotNull()), step, full).toDF(*state.columns))
        hits = blocks.hits(state)
    out = state.select([f"`{c}`" for c in columns])
    for rows in clean_rows:
        out = rows.unionByName(out)
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, windows of 10 words."""
    return scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram
      FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
lengths AS (SELECT DISTINCT n FROM b),
p AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
      FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
h AS (SELECT p.rid, p.n, p.i, g.item_id FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
pos AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT rid, n, i FROM h)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.joined, '')) AS items_sha256,
       coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN items USING (rid)
"""
