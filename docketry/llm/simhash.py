"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits over the XXH64 values of a text's word shingles. Two fingerprints link at ``radius`` or fewer differing bits. They are cut into
``segments``, and the radius is dealt out to the segments by the general pigeonhole principle: with segment radii that add up to
radius + 1 - segments, a pair within the radius is within its own radius in some segment. So every distinct fingerprint is filed under its segments, and
probes the Hamming ball around each of them; what probes and what is filed under a key is verified by the complete distance. A ball of radius 2 is met half-way:
all are filed and probe within radius 1.
The query takes 2 bits of fingerprints over three-word shingles: two segments of 32 bits with radii 1 and 0, 34 keys.

Equal fingerprints collapse before (with a map-side minimum of their ids), so a group of copies of any size is one row.
Under one key, filed and probing fingerprints are compared in numpy in blocks of bounded size. Where many meet, what is under the key is cut again by the bits in which it
differs: of radius + 1 parts of them, two fingerprints within the radius share one. A spanning forest of verified links is kept there, fewer links than there are
fingerprints in a part, not all pairs; memory is 16 bytes for each fingerprint and key.

``keep_one`` works by similarity: candidates are fingerprints over distinct words within 8 bits, in three segments. What candidates connect is a family; the full sets
of five-word shingles of its texts are brought together once, and candidates of different components are confirmed at a Jaccard similarity of 0.8 or more (``cells``). So
the forest only tells who may belong together; no candidate pair between components is passed over. Of what confirmed links connect the smallest id stays.

Edge cases: a null or wordless text has fingerprint zero and links like any other; repeated rows are reported each; a null id
is no candidate for a component's id; an empty table gives an empty result; extra columns, whatever their names, are ignored or, by
``keep_one``, carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import SET_CELL, Near, confirmed, refined
from .common import cut, fresh, map_batches, read, slices, tag_column, tag_of, texts_of
from .graph import components

RADIUS, SEGMENTS, SHINGLE = 2, 2, 3
SEED = 42
#: The stage's candidates: bits and segments of fingerprints over distinct words; and what it removes.
STAGE_RADIUS, STAGE_SEGMENTS = 8, 3
STAGE_SHINGLE, STAGE_SIMILARITY = 5, 0.8
#: Comparisons made at a time, fingerprints under a key up to which each is compared with each, and up to which a forest is not cut into parts.
CELLS, FEW, WHOLE = 2_000_000, 64, 256


def segments_of(radius: int, count: int) -> list[tuple[int, int, int]]:
    """(lowest bit, bits, radius) of each segment, the radii adding up to radius + 1 - count (-1: needs no look-up)."""
    widths = [64 // count + (i < 64 % count) for i in range(count)]
    radii = [(radius + 1) // count + (i < (radius + 1) % count) - 1 for i in range(count)]
    return [(sum(widths[:i]), w, r) for i, (w, r) in enumerate(zip(widths, radii, strict=True)) if r >= 0]


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of ``bits`` bits."""
    return [sum(1 << i for i in of) for n in range(radius + 1) for of in combinations(range(bits), n)]


def shingles(words: list[bytes], size: int) -> Iterator[bytes]:
    """Runs of ``size`` words, or all words if they are fewer."""
    return map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else iter([b" ".join(words)] if words else [])


def fingerprint(text: bytes | None, size: int = SHINGLE, distinct: bool = False) -> int:
    """Unsigned 64 bits; ``bytes`` lower-case and split by ASCII only, as the definition asks for. ``distinct``: a shingle counts once."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    found = shingles(words, size)
    h = np.fromiter(map(xxhash.xxh64_intdigest, set(found) if distinct else found, repeat(SEED)), np.uint64)
    count = np.zeros(64, np.int64)
    for lo in range(0, len(h), 4096):
        bits = np.unpackbits(h[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed long; one map."""

    def run(batch: pa.RecordBatch):
        fp = np.array([fingerprint(t) for t in texts_of(batch.column("text"))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def text_marks(docs: DataFrame) -> DataFrame:
    """doc_id, tag of the text, fingerprint over distinct words, and a hash of all words; one map."""

    def run(batch: pa.RecordBatch):
        texts = texts_of(batch.column("text"))
        fp = np.array([fingerprint(t, 1, distinct=True) for t in texts], np.uint64).view(np.int64)
        words = np.array([xxhash.xxh64_intdigest(b" ".join((t or b"").lower().split())) for t in texts], np.uint64).view(np.int64)
        tags = pa.array([tag_of(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), tags, pa.array(fp), pa.array(words)], ["doc_id", "tag", "fp", "words"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, tag long, fp long, words long")


def parts_of(bits: int, count: int) -> list[np.uint64]:
    """The set bits of a mask, dealt to ``count`` masks."""
    each = [i for i in range(64) if bits >> i & 1]
    return [np.uint64(sum(1 << i for i in each[k::count])) for k in range(count)]


def forest(filed: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """Links (n, 2) that connect what ``filed`` members of the sorted ``group`` are within ``radius`` of.

    A group of more than ``WHOLE`` is cut by parts of the bits in which its members differ; a pair within the radius is equal in one of radius + 1 parts.
    """
    if len(group) > WHOLE:
        bits = int(np.bitwise_or.reduce(group ^ group[0]))
        own, out = np.isin(group, filed), []
        for mask in parts_of(bits, radius + 1) if bits.bit_count() > radius + 1 else []:
            order = np.argsort(group & mask, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(group[order] & mask) != 0]))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
                run = np.sort(order[lo:hi])
                if hi - lo > 1 and own[run].any():
                    out.append(grown(group[run[own[run]]], group[run], radius) if hi - lo <= WHOLE or hi - lo == len(group) else forest(group[run[own[run]]], group[run], radius))
        if out:
            return spanning(np.concatenate(out))
    return grown(filed, group, radius)


def spanning(links: np.ndarray) -> np.ndarray:
    """Those of the links (n, 2), in their order, that join what is not joined yet."""
    ends, places = np.unique(links, return_inverse=True)
    root, kept = list(range(len(ends))), []
    for k, (a, b) in enumerate(places.reshape(links.shape).tolist()):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[a] = b
            kept.append(k)
    return links[kept]


def grown(filed: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """The same by comparing with all that is not linked yet, from the middle outwards."""
    out, rest, alive = [], np.arange(len(group)), np.ones(len(group), bool)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(filed), 100_000):
        ones += np.unpackbits(filed[lo : lo + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    middle = np.packbits(2 * ones > len(filed), bitorder="little").view(np.uint64)[0]
    order = np.argsort(np.bitwise_count(filed ^ middle), kind="stable")
    for start in np.searchsorted(group, filed[order]).tolist():
        if not alive[start]:
            continue
        queue, alive[start] = [start], False
        while queue:
            i = queue.pop()
            rest = rest[alive[rest]]
            near = rest[np.bitwise_count(group[rest] ^ group[i]) <= radius]
            if len(near):
                alive[near] = False
                out.append(np.stack([np.full(len(near), group[i]), group[near]], 1))
                queue += near.tolist()
    return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)


def close(key: np.ndarray, fp: np.ndarray, filed: np.ndarray, radius: int) -> np.ndarray:
    """Links (n, 2) of whole groups, sorted by key with the filed ones first and each part by fingerprint."""
    edge = np.flatnonzero(np.diff(key)) + 1
    starts = np.concatenate([[0], edge])
    sizes = np.diff(np.append(starts, len(key)))
    n_filed = np.add.reduceat(filed.astype(np.int64), starts)
    some = (n_filed > 0) & (sizes > 1)
    starts, sizes, n_filed = starts[some], sizes[some], n_filed[some]
    out = [np.zeros((0, 2), np.uint64)]
    small = sizes <= FEW
    for s, n, m in zip(starts[~small], sizes[~small], n_filed[~small], strict=True):
        out.append(forest(fp[s : s + m], np.unique(fp[s : s + n]), radius))
    starts, sizes, n_filed = starts[small], sizes[small], n_filed[small]
    for lo, hi in slices((sizes * n_filed).tolist(), CELLS):
        # every filed one against every one of its group
        cells = sizes[lo:hi] * n_filed[lo:hi]
        of = np.repeat(np.arange(lo, hi), cells)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
        a, b = fp[starts[of] + nth // sizes[of]], fp[starts[of] + nth % sizes[of]]
        near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
        out.append(np.stack([a[near], b[near]], 1))
    return np.concatenate(out)


def links(fps: DataFrame, radius: int = RADIUS, count: int = SEGMENTS) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fps(fp)``, enough of them to connect what is connected."""
    def around(number: int, low: int, bits: int, r: int) -> Column:
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))
        reach = (r + 1) // 2  # both sides go half of the way
        # the number of the segment stands above the bits
        key = lambda m: F.struct((part.bitwiseXOR(m) + F.lit(number << 60)).alias("key"), (F.bit_count(m) > r - reach).alias("probe"))
        return F.transform(F.array(*(F.lit(m).cast("long") for m in ball(bits, reach))), key)

    keys = [around(number, *segment) for number, segment in enumerate(segments_of(radius, count))]
    rows = fps.select(F.explode(F.concat(*keys)).alias("k"), "fp").select("k.key", "k.probe", "fp")
    dealt = rows.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list) -> Iterator[pa.RecordBatch]:
            key, fp, probe = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((fp, probe, key))
            out = spanning(close(key, fp[order], ~probe[order], radius)).view(np.int64)  # of all keys of the batch
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

        held: list = []  # the last group so far, in parts
        for batch in batches:
            key, probe = batch.column("key").to_numpy(), batch.column("probe").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy().view(np.uint64)
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if last == 0 and (not held or held[0][0][0] == key[0]):
                held.append((key, fp, probe))
                continue
            yield from found([*held, (key[:last], fp[:last], probe[:last])])
            held = [(key[last:], fp[last:], probe[last:])]
        if held:
            yield from found(held)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, count: int = SEGMENTS) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs``."""
    marked = cut(fingerprints(docs))
    firsts = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts.select("fp"), radius, count))
    rooted = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", "root")
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("first").alias("least")).withColumnRenamed("root", "r")
    named = rooted.join(least, F.col("root") == F.col("r"), "left").select(F.col("fp").alias("f"), F.coalesce("least", "first").alias("component_id"))
    return marked.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, words, set (distinct 32-bit hashes of shingles) of every row of ``docs(doc_id, text)``."""

    def run(batch: pa.RecordBatch):
        sets, words = [], []
        for t in texts_of(batch.column("text")):
            w = t.lower().split() if t else []
            words.append(xxhash.xxh64_intdigest(b" ".join(w)))
            sets.append(np.unique(np.fromiter(map(xxhash.xxh32_intdigest, shingles(w, size)), np.uint32)).view(np.int32))
        columns = [batch.column("doc_id"), pa.array(np.array(words, np.uint64).view(np.int64)), pa.array(sets, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "words", "set"])

    return map_batches(docs, run, "doc_id long, words long, set array<int>")


def within(radius: int) -> Callable[[pa.Table], Near]:
    """Candidates of a cell: fingerprints at ``radius`` or fewer differing bits."""

    def candidates(part: pa.Table) -> Near:
        fp = part.column("fp").to_numpy().view(np.uint64)
        return lambda i, some: np.bitwise_count(fp[some] ^ fp[i]) <= radius

    return candidates


def families(texts: DataFrame, radius: int, count: int) -> DataFrame:
    """family, class, fp, doc_id, company of the ``texts(fp, words, doc_id)`` that have candidates, by hashes of their words; candidates have the same family."""
    found = cut(links(texts.select("fp").distinct(), radius, count))
    roots = components(found)
    degrees = found.select(F.col("a").alias("node")).union(found.select("b")).groupBy("node").agg(F.count("*").alias("company"))
    of = texts.join(roots.join(degrees, "node"), F.col("fp") == F.col("node"), "left")
    # texts of one fingerprint are a family, linked or not
    of = cut(of.select(F.coalesce("root", "fp").alias("family"), F.col("words").alias("class"), "fp", "doc_id", F.coalesce("company", F.lit(0)).alias("company")))
    return of.join(of.groupBy("family").agg(F.count("*").alias("m")).filter("m > 1").select("family"), "family")


def duplicates(
    docs: DataFrame, radius: int = STAGE_RADIUS, count: int = STAGE_SEGMENTS, size: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY, limit: int = SET_CELL
) -> DataFrame:
    """(doc_id, tag, kept): rows that go, by id and tag, and the smaller id that stays for each."""
    marked = cut(text_marks(docs.filter("doc_id is not null")))
    texts = cut(marked.groupBy("fp", "words").agg(F.min("doc_id").alias("doc_id")))  # copies of a text are one
    found = cut(families(texts, radius, count))
    wanted = found.select(F.col("doc_id").alias("id")).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id") == F.col("id"), "left_semi")
    sets = shingle_sets(own, size).withColumnRenamed("words", "class").groupBy("class").agg(F.first("set").alias("set"))
    members = cut(found.drop("doc_id").join(sets, "class").withColumn("n", F.size("set").cast("long")))
    members = refined(members, round(100 * similarity), limit)
    roots = components(confirmed(members, round(100 * similarity), within(radius), limit))
    rooted = texts.join(roots, F.col("words") == F.col("node"), "left").select("words", "doc_id", F.coalesce("root", "words").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("kept")).withColumnRenamed("root", "r")
    named = rooted.join(least, F.col("root") == F.col("r")).select(F.col("words").alias("w"), "kept").groupBy("w").agg(F.min("kept").alias("kept"))
    return marked.join(named, F.col("words") == F.col("w")).filter("doc_id <> kept").select("doc_id", "tag", "kept").distinct()


def keep_one(docs: DataFrame, radius: int = STAGE_RADIUS, count: int = STAGE_SEGMENTS, size: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest id.

    Rows that share an id are each judged by their text; a row goes only for one with a smaller id. Rows with a null id stay.
    """
    key, tag = fresh(docs.columns, "id", "tag")
    gone = duplicates(docs, radius, count, size, similarity).select(F.col("doc_id").alias(key), F.col("tag").alias(tag))
    return docs.join(gone, (docs["doc_id"].cast("long") == F.col(key)) & (tag_column(docs["text"]) == F.col(tag)), "left_anti")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its component."""
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
