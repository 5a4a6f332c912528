"""Merkle manifest of a dataset: a digest for every row, one tree for each language, a root over the trees, and a proof for each row.

A leaf is the SHA-256 of a row's fields, each with its length before it. The leaves of a language ascend by id; level by level, rows are numbered,
the number divided by the fanout groups them, and the sorted child array is hashed into the parent, until one node is left: the subroot. The
subroots, in order of the language, make the top tree the same way, and its last node is the root. A run of one node is hashed as well.

Proofs go the other way: from the root down, the groups of each level are joined to the paths of their parents (one row of either side for each
key), and every child adds its siblings in front. So a path is handed on to eight children at a time, and only the last join has a row for each
run of leaves. ``folded`` recomputes a root from a leaf and its path.

Texts are read once and hashed where they are read; what is shuffled is narrow. Numbers are two-level (``common.numbered``), so a language of
any size is dealt out to many tasks. Groups hold ``fanout`` rows at most. Every level is cut by a reliable checkpoint.

Edge cases: a null field is hashed as ``-``, unlike an empty one (``0:``); a null language is a language of its own, before all others; null ids come
first; rows of one id are ordered by their leaf, and equal rows are interchangeable; a row with a null id is never tampered with; an empty table
gives an empty result; extra columns are ignored and not hashed.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbered, read

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(fields: list[Column]) -> Column:
    """The digest of a row: byte count, colon and value of each field, or a dash."""
    texts = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def levels(nodes: DataFrame, fanout: int, load: tuple[str, ...] = ()) -> list[DataFrame]:
    """Groups (tree, parent, n, children) of every level, from ``nodes(tree, number, n, digest, *load)`` up; a tree ends where n is 1.

    A child is a struct of number and digest, and on the first level ``load``.
    """
    most, out = nodes.agg(F.max("n")).first()[0] or 0, []
    while most:
        child = F.struct("number", "digest", *load)
        parent = F.expr(f"number div {fanout}").alias("parent")
        out.append(cut(nodes.groupBy("tree", parent, "n").agg(F.sort_array(F.collect_list(child)).alias("children"))))
        joined = F.array_join(F.transform("children", lambda c: c["digest"]), "")
        nodes = out[-1].filter("n > 1").select("tree", F.col("parent").alias("number"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), digest(joined).alias("digest"))
        most, load = 0 if most == 1 else -(-most // fanout), ()
    return out


def tops(groups: list[DataFrame]) -> DataFrame:
    """tree, level and digest of the last node of every tree."""
    found = [g.filter("n = 1").select("tree", F.lit(i).alias("level"), F.col("children")[0]["digest"].alias("digest")) for i, g in enumerate(groups)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def paths(groups: list[DataFrame], start: DataFrame, fanout: int, load: tuple[str, ...] = ()) -> DataFrame:
    """tree, number, digest, *load, path and what else ``start(tree, level, path, ...)`` has, for every node of the first level.

    ``start`` has a row for each tree: the level of its last node and the path from there on. A path starts next to the node and ends at the root.
    """
    more = [c for c in start.columns if c not in ("tree", "level", "path")]
    below = None
    for i, group in reversed(list(enumerate(groups))):
        above = start.filter(F.col("level") == i).select("tree", F.lit(0).cast("long").alias("parent"), "path", *more)
        if below is not None:
            above = above.unionByName(below.select("tree", F.col("number").alias("parent"), "path", *more))
        row = group.join(above, ["tree", "parent"]).select("*", F.transform("children", lambda c: c["digest"]).alias("digests"))
        row = row.select("*", F.posexplode("children").alias("nth", "child"))
        before = F.array_join(F.slice("digests", F.lit(1), F.col("nth")), "")
        after = F.array_join(F.slice("digests", F.col("nth") + 2, F.lit(fanout)), "")
        longer = F.concat(F.array(F.struct(before.alias("before"), after.alias("after"))), "path")
        own = load if i == 0 else ()
        below = row.select("tree", "child.number", "child.digest", *(f"child.{c}" for c in own), F.when(F.col("n") > 1, longer).otherwise(F.col("path")).alias("path"), *more)
    return below


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings along its path make."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["before"], acc, s["after"]))


def siblings(path: Column) -> Column:
    """All siblings along a path, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, fanout: int = FANOUT, **carried: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, path of every row of ``docs``, and ``carried`` columns, which are computed where the text is read."""
    rows = docs.select(
        F.col("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"), leaf_of([F.col(c) for c in FIELDS]).alias("digest"),
        *(c.alias(name) for name, c in carried.items()),
    )
    # equal rows are told apart by where they were read, so that they can be ranged
    rows = cut(rows.withColumn("tie", F.monotonically_increasing_id()))
    load = ("doc_id", *carried)
    trees = levels(numbered(rows, "tree", "doc_id", "digest", "tie"), fanout, load)
    if not trees:
        return rows.select("doc_id", F.col("digest").alias("leaf"), F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.lit(None).cast(PATH).alias("path"), *carried)
    subroots = cut(tops(trees))
    top = levels(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("level").alias("ended"), "digest"), "tree", "of"), fanout, ("of", "ended"))
    end = tops(top).first()
    above = docs.sparkSession.createDataFrame([("", end["level"], [])], f"tree string, level int, path {PATH}")
    start = paths(top, above, fanout, ("of", "ended")).select(F.col("of").alias("tree"), F.col("ended").alias("level"), "path", F.col("digest").alias("subroot"))
    found = paths(trees, cut(start), fanout, load)
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(end["digest"]).alias("root"), "path", *carried)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and what its proof says of a text that may have been tampered with."""
    docs = read(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    text = F.when(tampered, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    rows = manifest(docs, seen=leaf_of([*(F.col(c) for c in FIELDS[:-1]), text]))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.col("seen"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_CRC = """list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: [CAST(ord(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
         lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1)))"""
#: Unsigned CRC-32 of a number's digits, bit by bit.
CRC32 = f"xor(4294967295, {_CRC})"
SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, lang, CASE WHEN {CRC32.format("doc_id")} % 3 = 0 THEN translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') ELSE text END AS seen_text,
         {" || ".join(_FIELD.format(c) for c in FIELDS[:-1])} AS head, text
  FROM documents),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || {_FIELD.format("text")}) AS digest, sha256(head || {_FIELD.format("seen_text")}) AS seen,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(head || {_FIELD.format("text")})) - 1 AS number, count(*) OVER (PARTITION BY lang) AS n
  FROM l),
nodes(level, tree, number, n, digest) AS (
  SELECT 0, tree, number, n, digest FROM leaves
  UNION ALL
  SELECT level + 1, tree, number // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY number)) FROM nodes WHERE n > 1 GROUP BY level, tree, number // 8, n),
subroots AS (SELECT tree, level, digest, row_number() OVER (ORDER BY tree) - 1 AS number, count(*) OVER () AS n FROM nodes WHERE n = 1),
high(level, tree, number, n, digest) AS (
  SELECT 0, '', number, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, '', number // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY number)) FROM high WHERE n > 1 GROUP BY level, number // 8, n),
runs AS (
  SELECT FALSE AS top, level, tree, number // 8 AS run, list(digest ORDER BY number) AS digests FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT TRUE, level, tree, number // 8, list(digest ORDER BY number) FROM high WHERE n > 1 GROUP BY ALL),
walk(doc_id, nth, top, level, tree, number, now, proof) AS (
  SELECT doc_id, row_number() OVER (), FALSE, 0, tree, number, seen, '' FROM leaves
  UNION ALL
  SELECT * FROM (
    SELECT w.doc_id, w.nth, w.top, w.level + 1, w.tree, w.number // 8,
           sha256(array_to_string(r.digests[1:w.number % 8], '') || w.now || array_to_string(r.digests[w.number % 8 + 2:], '')),
           w.proof || array_to_string(r.digests[1:w.number % 8], '') || array_to_string(r.digests[w.number % 8 + 2:], '')
    FROM walk w JOIN runs r ON r.top = w.top AND r.level = w.level AND r.tree = w.tree AND r.run = w.number // 8
    UNION ALL
    SELECT w.doc_id, w.nth, TRUE, 0, '', s.number, w.now, w.proof FROM walk w JOIN subroots s ON NOT w.top AND s.tree = w.tree AND s.level = w.level) step),
ends AS (SELECT nth, now, proof FROM walk WHERE top QUALIFY row_number() OVER (PARTITION BY nth ORDER BY level DESC) = 1)
SELECT f.doc_id, l.digest AS leaf, s.digest AS subroot, h.digest AS root, sha256(e.proof) AS proof_sha256, e.now AS folded_root, e.now = h.digest AS verified
FROM walk f JOIN ends e ON e.nth = f.nth JOIN leaves l ON l.tree = f.tree AND l.number = f.number JOIN subroots s ON s.tree = f.tree JOIN high h ON h.n = 1
WHERE NOT f.top AND f.level = 0
"""
