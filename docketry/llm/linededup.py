"""Line dedup: a deletion-neighbourhood join of lines, the earliest stays.

A line's form is its words (split at ASCII white space, A-Z lower-cased). A line goes if an earlier line, by (doc_id, row,
line number), has the same form, however short, or one at edit distance 1. The unit of edits is the word in lines of
``FUZZY_WORDS`` words and more, which covers every edit of one character within a word, and the character (code point) in lines of fewer words
and at least ``FUZZY_CHARS`` characters, so paragraphs of scripts without spaces take part as well. Blank lines always stay.

A form emits all its variants within the bound: itself and one for each deleted unit, as hashed keys. Two
forms of one length are a substitution apart if they share a variant with the deletion at one position; all that meet under
such a key are within the bound of each other, so each one's link to the earliest is enough, and no pairs are made. Forms of
lengths n and n + 1 are within the bound if the shorter one is a variant of the longer. Every link is verified on the units of
both lines.

Emission is restricted without loss: one edit leaves the first or the last quarter (or more) of a line as it is, so only forms that
share such a part with another form emit variants. The shared parts are told to the second scan by a Bloom filter of bounded size; what it passes in
excess only emits variants in vain.

Skew: forms are reduced to their earliest occurrence with map-side minima, variants of a batch to their
earliest before the shuffle, so a hot variant has one row for each batch in its window, which spills; joins to frequent forms are sort-merge
joins that adaptive execution splits.

Edge cases: a row is known by its id and a checksum of its text, and a line goes only if its form is as told, so rows that share an id, or have
none, never lose each other's lines; rows that share id and text are one document and lose the same lines; a null text has no lines and stays null;
an empty one has one line that stays; null ids come first; an empty table gives an empty result; extra columns, whatever their names, are
ignored or, by ``dedup``, carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bloom
from .common import cut, fresh, map_batches, read, slices, splitmix, tag_column, tag_of, texts_of

FUZZY_WORDS, FUZZY_CHARS = 8, 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
MAX_FILTER_BYTES = 64 << 20
#: Units of the lines whose variants are made at a time.
UNITS = 200_000
#: Of a text's tag; a line goes only if its form is as told, so few bits do.
SHORT = 0x7FFFFFFF
#: What an occurrence is known by, in the order of lines: ``at`` has the tag of the text above the number of the line, as one number to deal out.
SPOT = ("doc_id", "at")
LINE_BITS = 32


def forms(text: bytes | None) -> Iterator[tuple[int, list[bytes]]]:
    """(line number, words) of the lines that can go; blank ones never do."""
    if text:
        for i, line in enumerate(text.lower().split(b"\n")):
            words = line.split()
            if words:
                yield i, words


def units(words: list[bytes]) -> list[bytes] | str | None:
    """What edits count: the words, or the characters of a line of few words; None for a line without an edit bound."""
    if len(words) >= FUZZY_WORDS:
        return words
    size = sum(map(len, words)) + len(words) - 1
    if size < FUZZY_CHARS:
        return None
    line = b" ".join(words).decode(errors="replace")
    return line if len(line) >= FUZZY_CHARS else None


def parts(line: list[bytes] | str) -> list[int]:
    """Hashes of the first and the last units, of which one edit leaves one alone: 2^(k-1) units for 2^k to 2^(k+1)-1.

    A line of just 2^k units also has the parts of the class below, to meet lines with a unit less.
    """
    n, by_word = len(line), isinstance(line, list)
    k = 1 << (n.bit_length() - 2)
    out = []
    for size in (k, k // 2) if n == 2 * k and n > (FUZZY_WORDS if by_word else FUZZY_CHARS) else (k,):
        for end, of in enumerate((line[:size], line[-size:])):
            out.append(xxhash.xxh64_intdigest(b" ".join(of) if by_word else of.encode(errors="replace"), 4 * size + 2 * end + by_word))
    return out


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, at, form (k1, k2: 128 bits), the hashes of its parts (null without an edit bound), and ``again``.

    ``again``: an earlier line of the same slice of rows has the form, so the line goes and need not be compared further. A
    very frequent line thus counts once for each slice.
    """

    def run(batch: pa.RecordBatch):
        ids, row, spots, keys, own = batch.column("doc_id"), [], [], bytearray(), []
        for r, text in enumerate(texts_of(batch.column("text"))):
            tag = (tag_of(text) & SHORT) << LINE_BITS
            for i, words in forms(text):
                row.append(r), spots.append(tag | i)
                keys += xxhash.xxh3_128_digest(b" ".join(words))
                own.append(parts(u) if (u := units(words)) else ())
        if not row:
            return
        k = np.frombuffer(bytes(keys), "<i8").reshape(-1, 2)
        p = np.array([(*x, 0, 0, 0, 0)[:4] for x in own], np.uint64).reshape(-1, 4).view(np.int64)
        n = np.array(list(map(len, own)))
        at, spot = np.array(row, np.int64), np.array(spots, np.int64)
        known = ids.is_valid().to_numpy(zero_copy_only=False)[at]
        doc = ids.fill_null(0).to_numpy()[at]
        order = np.lexsort((spot, doc, known, k[:, 1], k[:, 0]))  # by form, then as lines come, null ids first
        new = np.ones(len(order), bool)
        new[1:] = (k[order][1:] != k[order][:-1]).any(axis=1)
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        again = np.zeros(len(order), bool)
        again[order] = (spot[order] != spot[head]) | (doc[order] != doc[head]) | (known[order] != known[head])
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(at)), pa.array(spot), pa.array(k[:, 0]), pa.array(k[:, 1]),
                *(pa.array(p[:, j], mask=n <= j) for j in range(4)), pa.array(again),
            ],
            names,
        )

    names = [*SPOT, "k1", "k2", "p0", "p1", "p2", "p3", "again"]
    schema = "doc_id long, at long, k1 long, k2 long, p0 long, p1 long, p2 long, p3 long, again boolean"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def shared_parts(found: DataFrame) -> DataFrame:
    """Hashes of the parts that unlike forms have in common."""
    each = found.filter(~F.col("again")).select("k1", F.explode(F.array("p0", "p1", "p2", "p3")).alias("h")).filter("h is not null")
    return each.groupBy("h").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).filter("a <> b").select("h")


def candidates(docs: DataFrame, shared: bloom.BlockedBloom) -> DataFrame:
    """k1, spot, side, form of the first line of every form that may share its start (side 1), its end (2), or both (3) with another."""
    known = docs.sparkSession.sparkContext.broadcast(shared)

    def run(batch: pa.RecordBatch):
        ids, row, spots, own, text_of = batch.column("doc_id"), [], [], [], []
        for r, text in enumerate(texts_of(batch.column("text"))):
            tag = (tag_of(text) & SHORT) << LINE_BITS
            for i, words in forms(text):
                if u := units(words):
                    row.append(r), spots.append(tag | i), own.append(parts(u)), text_of.append(words)
        if not row:
            return
        n = np.array(list(map(len, own)))
        hit = known.value.might_contain(np.array([h for x in own for h in x], np.uint64)).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        ends = np.add.reduceat(hit * (1 + (np.arange(len(hit)) - np.repeat(at, n)) % 2 * 15), at)  # starts count 1, ends 16
        keep = np.flatnonzero(ends)
        joined = [b" ".join(text_of[i]) for i in keep]
        side = pa.array(((ends[keep] % 16 > 0) + 2 * (ends[keep] >= 16)).astype(np.int32))
        k = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, joined)), "<i8").reshape(-1, 2)
        spot = [ids.take(pa.array([row[i] for i in keep], pa.int64())), pa.array([spots[i] for i in keep], pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), *spot, side, pa.array(joined, pa.binary())], names)

    names = ["k1", "k2", *SPOT, "side", "form"]
    schema = "k1 long, k2 long, doc_id long, at long, side int, form binary"
    rows = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
    return rows.groupBy("k1", "k2").agg(F.min(F.struct(*SPOT, "side", "form")).alias("first")).select("k1", "first.*")


def variant_keys(line: list[bytes] | str) -> np.ndarray:
    """The key of the form itself, then of the form without each of its units: polynomial hashes from prefix sums."""
    n = len(line)
    if isinstance(line, str):
        w, kind = splitmix(np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)), np.uint64(1 << 32)
    else:
        w, kind = splitmix(np.fromiter(map(xxhash.xxh64_intdigest, line), np.uint64, n)), np.uint64(0)
    power = np.ones(n, np.uint64)
    np.multiply.accumulate(np.full(n - 1, _BASE, np.uint64), out=power[1:])
    p = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * power, dtype=np.uint64)])
    without = p[:-1] + (p[-1] - p[1:]) * np.uint64(_INVERSE)
    return splitmix(np.concatenate([p[-1:] ^ np.uint64(n) ^ kind, without ^ np.uint64(n - 1) ^ kind]))


def variants(firsts: DataFrame, decided: bool) -> DataFrame:
    """Variants (v, pos, spot) of ``firsts``, the earliest of a batch for each v and pos.

    ``decided``: instead, the later ones as links (spot, spot of the earlier one). A line that shares its start only is
    cut behind that start only, and so with its end: an edit that leaves the part alone is there.
    """

    def run(batch: pa.RecordBatch):
        spots = [batch.column(c) for c in SPOT]
        ids = spots[0]
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        # the order of the batch's lines, null ids first
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((spots[1].to_numpy(), ids.fill_null(0).to_numpy(), known))] = np.arange(len(ids))
        back = np.argsort(rank)
        todo, sides = [units(f.split(b" ")) for f in batch.column("form").to_pylist()], batch.column("side").to_numpy()
        for lo, hi in slices(list(map(len, todo)), UNITS):
            keys = [variant_keys(u) for u in todo[lo:hi]]
            size = np.array(list(map(len, keys)))
            v = np.concatenate(keys)
            pos = np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size) - 1
            at = np.repeat(rank[lo:hi], size)
            # the least part that a line of so many units is known by
            part = np.array([1 << ((n - 1).bit_length() - 2) - (n - 1 == 1 << ((n - 1).bit_length() - 1)) for n in size.tolist()])
            part, side = np.repeat(part, size), np.repeat(sides[lo:hi], size)
            use = (pos < 0) | (side == 3) | ((side == 1) & (pos >= part)) | ((side == 2) & (pos < np.repeat(size - 1, size) - part))
            v, pos, at = v[use], pos[use], at[use]
            order = np.lexsort((at, pos, v))
            v, pos, at = v[order], pos[order], at[order]
            first = np.ones(len(v), bool)
            first[1:] = (v[1:] != v[:-1]) | (pos[1:] != pos[:-1])
            head = np.flatnonzero(first)[np.cumsum(first) - 1]
            pick = np.flatnonzero(~first & (at != at[head])) if decided else np.flatnonzero(first)
            own = pa.array(back[at[pick]])
            columns = [c.take(own) for c in spots]
            if decided:
                by = pa.array(back[at[head[pick]]])
                columns += [c.take(by) for c in spots]
            else:
                columns = [pa.array(v[pick].view(np.int64)), pa.array(pos[pick].astype(np.int32)), *columns]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    spot = "doc_id long, at long"
    schema = f"{spot}, by_doc long, by_at long" if decided else f"v long, pos int, {spot}"
    return map_batches(firsts.select(*SPOT, "side", "form"), run, schema)


def near_links(firsts: DataFrame) -> DataFrame:
    """(spot, by_doc, by_at): lines with an earlier one under a common variant, and that one."""
    own = F.struct(*SPOT)
    spot, key = Window.partitionBy("v", "pos"), Window.partitionBy("v")
    # by the key first: what is dealt out by the key is dealt out for key and position as well
    rows = variants(firsts, decided=False)
    rows = rows.withColumn("whole", F.min(F.when(F.col("pos") < 0, own)).over(key)).withColumn("cut", F.min(F.when(F.col("pos") >= 0, own)).over(key))
    rows = rows.withColumn("same", F.min(own).over(spot)).withColumn("own", own)
    by = F.when(F.col("pos") < 0, F.col("cut")).otherwise(F.when(F.col("same") < F.col("own"), F.col("same")).otherwise(F.col("whole")))
    names = [F.col(f"by.{a}").alias(b) for a, b in zip(SPOT, ("by_doc", "by_at"), strict=True)]
    met = rows.withColumn("by", by).filter("by < own").select("own.*", *names)
    both = met.unionByName(variants(firsts, decided=True))
    return both.groupBy(*SPOT).agg(F.min(F.struct("by_doc", "by_at")).alias("by")).select(*SPOT, "by.*")


def within_one(a: list[bytes] | str, b: list[bytes] | str) -> bool:
    """Edit distance at most 1 in units of one kind: a common start and a common end cover all but one."""
    n, m = len(a), len(b)
    if abs(n - m) > 1 or type(a) is not type(b):
        return False
    least = min(n, m)
    i = next((k for k in range(least) if a[k] != b[k]), least)
    j = next((k for k in range(least) if a[n - 1 - k] != b[m - 1 - k]), least)
    return i + j >= max(n, m) - 1


def verified(met: DataFrame, firsts: DataFrame) -> DataFrame:
    """(spot, k1) of the rows of ``met`` whose two lines are within the bound, unit by unit."""
    left = firsts.select(F.col("doc_id").alias("d1"), F.col("at").alias("l1"), "k1", F.col("form").alias("a"))
    right = firsts.select(F.col("doc_id").alias("d2"), F.col("at").alias("l2"), F.col("form").alias("b"))
    pairs = met.join(left, F.col("doc_id").eqNullSafe(F.col("d1")) & (F.col("at") == F.col("l1")))
    pairs = pairs.join(right, F.col("by_doc").eqNullSafe(F.col("d2")) & (F.col("by_at") == F.col("l2")))

    def run(batch: pa.RecordBatch):
        both = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
        ok = [within_one(units(a.split(b" ")), units(b.split(b" "))) for a, b in both]
        yield batch.select([*SPOT, "k1"]).filter(pa.array(ok))

    return map_batches(pairs.select(*SPOT, "k1", "a", "b"), run, "doc_id long, at long, k1 long")


def dropped_lines(docs: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(doc_id, tag, gone: array of (line_no, k1)) for every row, known by its id and tag, that loses lines."""
    found = cut(occurrences(docs))
    shared = shared_parts(found)
    blocks, _ = bloom.blocks_for(shared.count(), max_filter_bytes)
    firsts = cut(candidates(docs, bloom.build(shared, blocks)))
    near = verified(near_links(firsts), firsts)
    again = found.filter("again").select(*SPOT, "k1")
    lines = found.filter(~F.col("again")).select(*SPOT, "k1", "k2")
    earliest = lines.groupBy("k1", "k2").agg(F.min(F.struct(*SPOT)).alias("first")).select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), "first")
    repeats = (
        lines.join(earliest, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))).filter(~F.struct(*SPOT).eqNullSafe(F.col("first"))).select(*SPOT, "k1")
    )
    gone = again.unionByName(repeats).unionByName(near)
    tag, line = F.shiftright("at", LINE_BITS).cast("int").alias("tag"), F.col("at").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int").alias("line_no")
    return gone.select("doc_id", tag, F.struct(line, "k1").alias("x")).groupBy("doc_id", "tag").agg(F.collect_list("x").alias("gone"))


def _kept(text: bytes, gone: list[dict]) -> tuple[bytes, list[int]]:
    """The text without the lines of ``gone`` whose form is as told, and their numbers."""
    lines = text.split(b"\n")
    out = set()
    for x in gone:
        i, k = x["line_no"], x["k1"]
        if i < len(lines) and int.from_bytes(xxhash.xxh3_128_digest(b" ".join(lines[i].lower().split()))[:8], "little", signed=True) == k:
            out.add(i)
    return b"\n".join(x for i, x in enumerate(lines) if i not in out), sorted(out)


def _with_gone(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a last column of the lines that go, under a name that is not among its columns."""
    key, tag, name = fresh(docs.columns, "id", "tag", "gone")
    # the hashed side has line numbers only, and the texts need no sort
    gone = dropped_lines(docs).toDF(key, tag, name).hint("shuffle_hash")
    both = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(key)) & (tag_column(docs["text"]).bitwiseAND(F.lit(SHORT)).cast("int") == F.col(tag)), "left")
    return both.drop(key, tag), name


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with its repeated lines removed, in the same columns; every document stays, if with an empty text."""

    def run(batch: pa.RecordBatch):
        texts = batch.column(at)
        gone = batch.column(len(names)).to_pylist()
        if any(gone):
            new = [t if t is None or not g else _kept(t, g)[0] for t, g in zip(texts_of(texts), gone, strict=True)]
            texts = pa.array([t if t is None else t.decode() for t in new], pa.string())
        columns = [texts if i == at else batch.column(i) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays(columns, names)

    names, at = docs.columns, docs.columns.index("text")
    return map_batches(_with_gone(docs)[0], run, docs.schema)


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines that go and their numbers, and the SHA-256 of the text that stays (null: empty)."""

    def run(batch: pa.RecordBatch):
        rows = []
        for text, gone in zip(texts_of(batch.column("text")), batch.column(name).to_pylist(), strict=True):
            kept, out = _kept(text or b"", gone or [])
            rows.append((0 if text is None else text.count(b"\n") + 1, len(out), ",".join(map(str, out)), hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    names = ["doc_id", "n_lines", "n_dropped", "dropped", "text_sha256"]
    docs, name = _with_gone(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    return map_batches(docs, run, "doc_id long, n_lines long, n_dropped long, dropped string, text_sha256 string")
