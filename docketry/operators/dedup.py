"""Exact and near duplicates of messages.

Input columns: doc_id, subject_norm, body_norm, date_utc (and attachment_names for threads).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import half_even
from ..functions.text import body_hash, dedup_key, words
from ..session import cut
from .graph import components
from .windows import spread_rank


def age_order() -> list[Column]:
    """Earliest first, undated last, then by id."""
    return [F.col("date_utc").asc_nulls_last(), F.col("doc_id").asc()]


def _age() -> Column:
    """The same order as one sortable value."""
    return F.struct(F.col("date_utc").isNull().alias("undated"), F.col("date_utc"), F.col("doc_id"))


def exact_clusters(messages: DataFrame) -> DataFrame:
    """dedup_key, canonical_doc_id, doc_id, dup_rank for every message.

    The canonical of a key comes from a map-side minimum; ranks are two-level, so a body that a third of all messages share
    fills no task alone.
    """
    # texts are read and hashed once; what follows takes the keys three times
    rows = cut(messages.select("doc_id", "date_utc", dedup_key("subject_norm", "body_norm").alias("dedup_key")))
    ranked = spread_rank(rows, "dedup_key", F.unix_micros("date_utc"), age_order())
    first = rows.groupBy("dedup_key").agg(F.min(_age()).alias("a")).select(F.col("dedup_key").alias("__k"), F.col("a.doc_id").alias("canonical_doc_id"))
    return ranked.join(first, F.col("dedup_key") == F.col("__k")).select("dedup_key", "canonical_doc_id", "doc_id", F.col("rank").alias("dup_rank"))


def canonical(messages: DataFrame, exact: DataFrame) -> DataFrame:
    """Messages that are first of their cluster."""
    firsts = exact.filter("dup_rank = 0").select(F.col("doc_id").alias("__id"))
    return messages.join(firsts, F.col("doc_id") == F.col("__id"), "left_semi")


def body_counts(messages: DataFrame) -> DataFrame:
    """Messages for each body, by its hash: the shuffle moves hashes only."""
    return messages.groupBy(body_hash("body_norm").alias("hash")).agg(F.count("*").alias("n"))


def boilerplate_bodies(messages: DataFrame, least: int = 50) -> DataFrame:
    return body_counts(messages).filter(F.col("n") >= least)


def eligible(canonicals: DataFrame, messages: DataFrame, min_words: int = 30, boilerplate: int = 50) -> DataFrame:
    """Canonical messages long enough, of a body that no other canonical and few messages have."""
    rows = canonicals.withColumn("w", words("body_norm")).filter(F.size("w") >= min_words).withColumn("hash", body_hash("body_norm"))
    # one pass over all bodies: a message's row and, where it is canonical, a mark
    kept = canonicals.select(body_hash("body_norm").alias("hash"), F.lit(0).alias("all"), F.lit(1).alias("own"))
    every = messages.select(body_hash("body_norm").alias("hash"), F.lit(1).alias("all"), F.lit(0).alias("own"))
    counts = every.unionByName(kept).groupBy("hash").agg(F.sum("all").alias("n"), F.sum("own").alias("own"))
    return rows.join(counts.filter((F.col("n") >= boilerplate) | (F.col("own") > 1)).select("hash"), "hash", "left_anti")


def signatures(rows: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, age, sh: the distinct hashes of word shingles. Words are hashed first, so no shingle is built as text."""
    h = F.transform("w", lambda x: F.xxhash64(x))
    rows = rows.select("doc_id", _age().alias("age"), h.alias("h"), F.greatest(F.size("w") - (size - 1), F.lit(0)).alias("many"))
    runs = F.slice("h", F.lit(1), F.col("many"))
    for k in range(1, size):
        runs = F.zip_with(runs, F.slice("h", F.lit(k + 1), F.col("many")), lambda a, b: F.xxhash64(a, b))
    short = F.array(F.xxhash64("h"))
    return rows.select("doc_id", "age", F.array_distinct(F.when(F.col("many") > 0, runs).otherwise(short)).alias("sh"))


def twins(sig: DataFrame) -> DataFrame:
    """doc_id, first: documents with the same set as an earlier one, and the earliest of each such set. Keys alone are shuffled."""
    key = F.array_sort("sh")
    keyed = cut(sig.select("doc_id", "age", F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2")))
    firsts = keyed.groupBy("k1", "k2").agg(F.min("age").alias("m"), F.count("*").alias("n")).filter("n > 1").select("k1", "k2", F.col("m.doc_id").alias("first"))
    return keyed.join(firsts, ["k1", "k2"]).filter("doc_id <> first").select("doc_id", "first")


def jaccard_edges(sig: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) with a before b, for all pairs at the threshold or over: exact, by prefix, length and position filters.

    Shingles are taken rarest first. Two sets that are alike enough share one of their first n - ceil(t n) + 1; only those
    are joined. Rare shingles keep the groups small. At the first shingle that two sets share, what comes behind it in either must still
    suffice for the overlap that the threshold asks for.
    """
    # texts are read and cut into shingles once; rows go by numbers, which the checkpoint fixes
    sig = cut(sig.withColumn("v", F.monotonically_increasing_id()))
    each = sig.select("v", F.size("sh").alias("n"), F.explode("sh").alias("s"))
    rare = each.groupBy("s").agg(F.count("*").cast("int").alias("df"))
    ordered = each.join(rare.filter("df > 1"), "s").groupBy("v", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("by"))
    # shingles of one document only come first in the order and never meet; what is left of the prefix is joined
    alone = F.col("n") - F.size("by")
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)) + 1 - alone
    prefix = ordered.select("v", "n", alone.alias("alone"), F.posexplode(F.slice("by", F.lit(1), F.greatest(keep, F.lit(0)).cast("int"))).alias("at", "p"))
    prefix = prefix.select("v", "n", "p.s", (F.col("n") - F.col("alone") - F.col("at")).alias("left"))
    other = prefix.select(F.col("v").alias("v2"), F.col("n").alias("n2"), "s", F.col("left").alias("left2"))
    long_enough = (F.least("n", "n2") >= F.lit(threshold) * F.greatest("n", "n2") - F.lit(1e-9)) & (F.col("v") < F.col("v2"))
    suffices = F.least("left", "left2") >= F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n2")) - F.lit(1e-6)
    pairs = prefix.join(other, "s").filter(long_enough & suffices).select("v", "v2").distinct()
    common = F.size(F.array_intersect("s1", "s2"))
    return _edges(sig, pairs, "sh", common / (F.size("s1") + F.size("s2") - common), threshold)


def _edges(sig: DataFrame, pairs: DataFrame, what: str, similarity: Column, threshold: float) -> DataFrame:
    """(a, b, ages, jaccard) of ``pairs(v, v2)`` at the threshold or over; a is the earlier one. ``similarity`` is of s1 and s2."""
    left, right = (sig.select(F.col("v").alias(f"x{k}"), F.col("doc_id").alias(f"d{k}"), F.col("age").alias(f"g{k}"), F.col(what).alias(f"s{k}")) for k in (1, 2))
    both = pairs.join(left, F.col("v") == F.col("x1")).join(right, F.col("v2") == F.col("x2"))
    both = both.withColumn("jaccard", similarity).filter(F.col("jaccard") >= threshold)
    first = F.col("g1") < F.col("g2")
    a, b = F.when(first, F.col("d1")).otherwise(F.col("d2")), F.when(first, F.col("d2")).otherwise(F.col("d1"))
    return both.select(a.alias("a"), b.alias("b"), F.least("g1", "g2").alias("age_a"), F.greatest("g1", "g2").alias("age_b"), "jaccard")


def bands_for(threshold: float, perms: int = 128) -> tuple[int, int]:
    """(bands, rows of a band) with the least sum of missed and false shares over all similarities."""
    s = np.linspace(0, 1, 2001)

    def lost(bands: int) -> float:
        found = 1 - (1 - s ** (perms // bands)) ** bands
        return float(np.where(s < threshold, found, 1 - found).mean())

    bands = min((b for b in range(1, perms + 1) if perms % b == 0), key=lost)
    return bands, perms // bands


def rows_for(threshold: float, perms: int = 128, missed: float = 1e-4) -> int:
    """Rows of a band, as many as miss a pair at the threshold with a probability of at most ``missed``."""
    return max((r for r in range(1, perms + 1) if perms % r == 0 and (1 - threshold**r) ** (perms // r) <= missed), default=1)


def minhash_edges(sig: DataFrame, threshold: float, perms: int = 128, seed: int = 8191) -> DataFrame:
    """The same from ``perms`` minima in bands: candidates share a band, and are confirmed on their whole sets.

    Bands are narrow enough to miss next to none at the threshold; that they meet more candidates costs comparisons, not results.
    """
    rows = rows_for(threshold, perms)
    bands = perms // rows
    sig = cut(sig)  # or each of the minima would make the shingles anew
    mins = F.transform(F.sequence(F.lit(1), F.lit(perms)), lambda i: F.array_min(F.transform("sh", lambda h: F.xxhash64(h, i, F.lit(seed)))))
    m = cut(sig.select(F.monotonically_increasing_id().alias("v"), "doc_id", "age", "sh", mins.alias("m")))
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("m", b * rows + 1, rows)))
    keyed = m.select("v", F.size("sh").alias("n"), F.explode(band).alias("key"))
    other = keyed.select(F.col("v").alias("v2"), F.col("n").alias("n2"), "key")
    long_enough = F.least("n", "n2") >= F.lit(threshold) * F.greatest("n", "n2") - F.lit(1e-9)
    pairs = keyed.join(other, "key").filter((F.col("v") < F.col("v2")) & long_enough).select("v", "v2").distinct()
    common = F.size(F.array_intersect("s1", "s2"))
    return _edges(m, pairs, "sh", common / (F.size("s1") + F.size("s2") - common), threshold)


#: Rounds before what is open is solved by components, and links of a component up to which one task solves it (it holds the names).
ROUNDS, SOLVED = 4, 5_000_000


def _round(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Open documents whose earlier neighbours are all absorbed become centers; neighbours after centers are absorbed."""
    earlier = edges.join(state.select(F.col("v").alias("a"), F.col("is").alias("is_a")), "a")
    seen = earlier.groupBy(F.col("b").alias("v")).agg(F.count_if(F.col("is_a") == "center").alias("centers"), F.count_if(F.col("is_a") == "open").alias("opens"))
    joined = state.join(seen, "v", "left")
    now = F.when(F.col("is") != "open", F.col("is")).when(F.coalesce("centers", F.lit(0)) > 0, "absorbed").when(F.coalesce("opens", F.lit(0)) == 0, "center").otherwise("open")
    return cut(joined.select("v", now.alias("is")))


def _solved(edges: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """v, is of the open documents in components of up to ``most`` links: a pass in order of age over each component, streamed."""
    is_open = state.filter(F.col("is") == "open")
    left = edges.join(is_open.select(F.col("v").alias("a")), "a", "left_semi").join(is_open.select(F.col("v").alias("b")), "b", "left_semi").select("a", "b", "age_a")
    left = cut(left)
    rooted = left.join(components(left.select("a", "b")), F.col("b") == F.col("node")).select("root", "a", "b", "age_a")
    small = rooted.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("root")
    dealt = rooted.join(small, "root").repartition("root").sortWithinPartitions("root", "age_a", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, seen, absorbed = None, set(), set()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*seen], pa.string()), pa.array(["absorbed" if v in absorbed else "center" for v in seen], pa.string())], ["v", "is"])

        for batch in batches:
            for r, a, b in zip(*(batch.column(c).to_pylist() for c in ("root", "a", "b")), strict=True):
                if r != root:
                    if seen:
                        yield told()
                    root, seen, absorbed = r, set(), set()
                seen |= {a, b}
                if a not in absorbed:  # all that could absorb it came before
                    absorbed.add(b)
        if seen:
            yield told()

    return dealt.mapInArrow(run, "v string, is string")


def stars(edges: DataFrame, rounds: int = ROUNDS, solved: int = SOLVED) -> DataFrame:
    """(doc_id, center, jaccard): the star clusters that a pass in order of age would make.

    A document is a center unless an earlier center is its neighbour; an absorbed one belongs to the earliest such center. A few rounds decide most: undecided
    documents whose earlier neighbours are all absorbed become centers, then neighbours after them are absorbed. What then is open, as along
    chains of versions, falls into components, and each of up to ``solved`` links is solved by the pass itself in one task; only of larger ones the rounds go on, each of
    which decides at least the earliest open document. Rounds are cut by reliable checkpoints.
    """
    edges = cut(edges.select("a", "b", "age_a", "jaccard"))
    nodes = edges.select(F.col("a").alias("v")).unionByName(edges.select(F.col("b").alias("v"))).distinct()
    state = cut(nodes.withColumn("is", F.lit("open")))
    n = 0
    while state.filter(F.col("is") == "open").limit(1).count():
        if n == rounds:
            found = cut(_solved(edges, state, solved)).withColumnRenamed("is", "now")
            state = cut(state.join(found, "v", "left").select("v", F.coalesce("now", "is").alias("is")))
        else:
            state = _round(edges, state)
        n += 1
    centers = state.filter(F.col("is") == "center").select(F.col("v").alias("a"))
    absorbed = state.filter(F.col("is") == "absorbed").select(F.col("v").alias("b"))
    of = edges.join(centers, "a", "left_semi").join(absorbed, "b", "left_semi").groupBy("b").agg(F.min(F.struct("age_a", "a", "jaccard")).alias("m"))
    members = of.select(F.col("b").alias("doc_id"), F.col("m.a").alias("center"), F.col("m.jaccard").alias("jaccard"))
    hubs = members.select(F.col("center").alias("doc_id"), "center", F.lit(1.0).alias("jaccard")).distinct()
    return members.unionByName(hubs)


def with_twins(clusters: DataFrame, same: DataFrame) -> DataFrame:
    """Star clusters of the earliest documents of each set, and the other documents of these sets, ``same(doc_id, first)``.

    A twin has the neighbours of its first and comes after it: it belongs where that one does, or to it.
    """
    of = clusters.select(F.col("doc_id").alias("first"), "center", "jaccard")
    joined = same.join(of, "first", "left")
    own = F.coalesce("center", "first")
    rows = joined.select("doc_id", own.alias("center"), F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"))
    new = joined.filter("center is null").select(F.col("first").alias("doc_id"), F.col("first").alias("center"), F.lit(1.0).alias("jaccard")).distinct()
    return clusters.unionByName(rows).unionByName(new)


def near_clusters(
    canonicals: DataFrame, messages: DataFrame, threshold: float = 0.85, size: int = 3, min_words: int = 30, boilerplate: int = 50,
    mode: str = "exact", perms: int = 128, seed: int = 8191,
) -> DataFrame:
    """``dedup_near`` rows: members of star clusters of two and more. Documents of equal sets are one until the clusters are known."""
    sig = cut(signatures(eligible(canonicals, messages, min_words, boilerplate), size))
    same = cut(twins(sig))
    any_twins = bool(same.limit(1).count())
    if any_twins:
        sig = sig.join(same.select("doc_id"), "doc_id", "left_anti")
    clusters = stars(jaccard_edges(sig, threshold) if mode == "exact" else minhash_edges(sig, threshold, perms, seed=seed))
    version = f"seed{seed}-p{perms}-w{size}-t{threshold}-mw{min_words}-b{boilerplate}" + ("" if mode == "minhash" else "-exact")
    return (with_twins(clusters, same) if any_twins else clusters).select(
        "doc_id", F.concat(F.lit("near-"), F.col("center")).alias("cluster_id"), F.col("center").alias("canonical_doc_id"),
        half_even(F.col("jaccard"), 6).alias("jaccard_to_canonical"), F.lit(version).alias("minhash_seed_version"),
    )
