"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's set has its distinct word shingles; documents link at a Jaccard similarity of ``SIMILARITY`` percent or more. A signature has ``COORDINATES``
minima over the set. Documents are posted under each pair of coordinate and value. At the bound, coordinates agree with probability 0.8 each, so
a linked pair has fewer than ``MATCHES`` of them in common in less than one of a million cases; pairs with that many are candidates, and links are
confirmed on the full sets.

Lists are counted first. Prefix: in order of list length, a document's rarest ``COORDINATES - MATCHES + 1`` postings suffice, as two documents with
``MATCHES`` common postings share one of these; lists of one document take their places in the prefix without being posted, so that most documents of
their own drop out. Skip: the longer lists are never merged; a pair met in a prefix has its common coordinates counted on the two signatures.

No list emits all its pairs. Equal sets collapse into one class before. Candidates make families first: in each list all classes meet its hub, the one with
the most company over all its postings, likely the original of copies; in lists that this leaves apart, classes outside the largest part meet the rest. Every
candidate pair then lies within one family. Each family's full sets are brought together once, in cells of bounded size (a family of more
than one cell meets its hub before, and then only what that leaves apart meets the rest), where candidates of different components are confirmed. Cells give the links that
join components, at most one for each class; links that would only join what is joined already are not looked for, and none between components is lost.

Edge cases: a null, empty or wordless text has an empty set and links with nothing, not even its like; a text with fewer words than a shingle has one
shingle; repeated rows are reported each; a null id is no candidate for a component's id, and a component of null ids only has a null one; ``kept`` compares null ids as
equal; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import SET_CELL, blocks, by_cell, confirmed, fits, joining
from .common import cut, map_batches, read, splitmix, texts_of
from .graph import components
from .simhash import shingles

SIMILARITY, SHINGLE = 80, 2
COORDINATES, MATCHES = 48, 24
SEED = 42
#: Elements of signatures on either side of a cell, about, and elements compared at a time.
SIGNATURE_CELL, STEP = 100_000, 4_000_000
#: Ids up to which they are sent to the texts; beyond, texts are joined.
MAX_SENT = 2_000_000
_FACTORS = splitmix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 values of a text's shingles, ascending; ``bytes`` lower-case and split by ASCII only, as the definition asks for."""
    words = text.lower().split() if text else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, set(shingles(words, size)), repeat(SEED)), np.uint64))


def signature(found: np.ndarray) -> np.ndarray:
    """Of a set that is not empty: for each coordinate the least of the set's hashes in its order, 32 bits of it."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(found), 2048):
        np.minimum(least, (found[lo : lo + 2048, None] * _FACTORS).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def name_of(found: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64).tolist())


def marks(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, name (k1, k2) and signature of every row; one map over whole texts."""

    def run(batch: pa.RecordBatch):
        n, names, signatures = [], [], []
        for t in texts_of(batch.column("text")):
            found = hashes(t, size)
            n.append(len(found))
            names.append(name_of(found))
            signatures.append(signature(found) if len(found) else None)
        k1, k2 = zip(*names, strict=True) if names else ((), ())
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(signatures, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "k1", "k2", "signature"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, k1 long, k2 long, signature array<int>")


def sets(docs: DataFrame, size: int) -> DataFrame:
    """name (k1, k2) and set of every row."""

    def run(batch: pa.RecordBatch):
        found = [hashes(t, size) for t in texts_of(batch.column("text"))]
        k1, k2 = zip(*map(name_of, found), strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], ["k1", "k2", "set"])

    return map_batches(docs.select("text"), run, "k1 long, k2 long, set array<long>")


def postings(classes: DataFrame, least: int) -> DataFrame:
    """class, token, company of the rarest postings of every class of ``classes(class, n, signature)`` that may link.

    A token is a coordinate (upper half) and a value. ``least``: smaller sets link with no other set. A class that shares fewer than ``MATCHES`` postings with
    anything is left out.
    """
    tokens = classes.filter(F.col("n") >= least).select("class", F.posexplode("signature").alias("place", "value"))
    tokens = tokens.select("class", (F.shiftleft(F.col("place").cast("long"), 32) + F.col("value")).alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1")
    shared = tokens.join(counts, "token").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("m", "token"))).alias("found"), F.sum("m").alias("company"))
    rarest = F.slice("found", F.lit(1), F.size("found") - (MATCHES - 1))
    return shared.filter(F.size("found") >= MATCHES).select("class", "company", F.explode(rarest).alias("p")).select("class", "company", "p.token")


def candidates(pairs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """Those of the distinct ``pairs(a, b)`` of classes whose sizes allow a link and whose signatures have ``MATCHES`` coordinates in common."""
    of_a, of_b = (classes.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("signature").alias(f"s{c}")) for c in "ab")
    both = pairs.join(of_a, "a").join(of_b, "b").filter(fits(F.col("na"), F.col("nb"), similarity)).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (batch.column(c).flatten().to_numpy().reshape(-1, COORDINATES) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((sa == sb).sum(1) >= MATCHES))

    return both.mapInArrow(run, "a long, b long")


def alike(part: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which of some rows of a cell have ``MATCHES`` coordinates in common with a row."""
    signatures = part.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)

    def near(i: int, some: np.ndarray) -> np.ndarray:
        parts = [some[lo : lo + STEP // COORDINATES] for lo in range(0, len(some), STEP // COORDINATES)]
        return np.concatenate([(signatures[at] == signatures[i]).sum(1) >= MATCHES for at in parts]) if parts else np.zeros(0, bool)

    return near


def families(classes: DataFrame, least: int, similarity: int, limit: int = SIGNATURE_CELL) -> DataFrame:
    """class, family, company of every class that is a candidate with another; candidates have the same family."""
    posted = cut(postings(classes, least))
    hubs = posted.groupBy("token").agg(F.max(F.struct("company", "class")).alias("hub"), F.count("*").alias("m")).filter("m > 1").select("token", F.col("hub.class").alias("hub"))
    listed = cut(posted.join(hubs, "token").filter("class <> hub").select("token", "class", "hub", "company"))
    pairs = listed.select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct()
    met = cut(candidates(pairs, classes, similarity))
    # in a list, what is a candidate with the hub is one component, and each class beside it its own; the hub needs no further look
    linked = met.select(F.col("a").alias("class"), F.col("b").alias("hub"), F.lit(True).alias("linked"))
    members = listed.join(linked, ["class", "hub"], "left").select("token", "class", "company", F.when(F.col("linked"), F.col("hub")).otherwise(F.col("class")).alias("component"))
    apart = members.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
    members = members.join(apart, "token").join(classes.select("class", "n", "signature"), "class").select("token", "class", "component", "company", "n", "signature")
    roots = components(met.unionByName(cut(by_cell(blocks(members, "token", F.lit(COORDINATES), limit), "token", lambda part: joining(part, similarity, alike(part))))))
    company = posted.groupBy("class").agg(F.first("company").alias("company"))
    return roots.select(F.col("node").alias("class"), F.col("root").alias("family")).join(company, "class")


def with_sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """``members(class, k1, k2, doc_id, ...)`` with the full ``set`` of each class; only texts of their ids are read again."""
    ids = members.select(F.col("doc_id").alias("id")).distinct()
    sent = F.broadcast(ids) if ids.count() <= MAX_SENT else ids
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sent, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    # rows of one id may have different texts, and several rows the same
    return members.join(sets(own, size), ["k1", "k2"]).groupBy(*members.columns).agg(F.first("set").alias("set"))


def links(docs: DataFrame, classes: DataFrame, size: int, similarity: int, limit: int = SET_CELL, signature_limit: int = SIGNATURE_CELL) -> DataFrame:
    """Confirmed links (a, b) among ``classes(class, k1, k2, doc_id, n, signature)``, enough of them to connect what is connected."""
    # unlike sets link from similarity / (100 - similarity) shingles on: one shingle more in the larger one must not weigh too much
    least = -(-similarity // (100 - similarity)) if similarity < 100 else 1 << 62
    found = cut(families(classes, least, similarity, signature_limit))
    members = cut(with_sets(docs, classes.join(found, "class"), size).drop("k1", "k2", "doc_id"))
    return confirmed(members, similarity, alike, limit)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, limit: int = SET_CELL, signature_limit: int = SIGNATURE_CELL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs(doc_id, text)``."""
    marked = cut(marks(docs, size))
    classes = marked.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("signature").alias("signature"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))
    roots = components(links(docs, classes, size, similarity, limit, signature_limit))
    rooted = classes.join(roots, F.col("class") == F.col("node"), "left").select("k1", "k2", "doc_id", F.coalesce("root", "class").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "root").select("k1", "k2", "component_id")
    out = marked.join(named, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set, the smallest id that links lead to, and whether it is the one that stays."""
    return near_duplicates(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE len(words) WHEN 0 THEN [] WHEN 1 THEN words ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END)) AS shingles
  FROM w),
c AS (  -- equal sets are one class
  SELECT shingles, min(doc_id) AS class, len(shingles) AS n FROM s WHERE len(shingles) > 0 GROUP BY shingles),
e AS (SELECT class, n, unnest(shingles) AS shingle FROM c),
pairs AS (
  SELECT a.class AS a, b.class AS b, count(*) AS n_common, a.n + b.n - count(*) AS union_size
  FROM e a JOIN e b ON a.shingle = b.shingle AND a.class < b.class AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.class, b.class, a.n, b.n),
links AS (SELECT a, b FROM pairs WHERE 100 * n_common >= 80 * union_size),
reach(node, root) AS (
  SELECT class, class FROM c
  UNION
  SELECT l.v, r.root FROM reach r JOIN (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links) l ON l.u = r.node),
least_of AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(l.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.shingles = s.shingles LEFT JOIN least_of l ON l.node = c.class
"""
