"""Prefix trie of conversations: what they share from the first turn on, and what a cache of prefixes would save.

A node is a distinct sequence of the first d turns; the root is the empty one. A node's name is a digest of its sequence: the XOR of 128-bit
hashes of (place, turn), a turn being the SHA-256 of role and text; XOR runs in a window, so every prefix of a conversation is named in one
pass, and the name of the parent is the name without the last turn. (The XOR withstands chance, not somebody who makes up colliding conversations.)

Totals of subtrees go up by pointer jumping: in round r every node has the sums over what is less than 2^r levels below it and a pointer 2^r
levels up; sums are grouped by pointer and added, and pointers are followed by a join. So rounds grow with the logarithm of the depth. Each is cut
by a reliable checkpoint.

A conversation of any length is dealt out to many tasks: places and running digests are two-level, within slices and offset by the slices
before. Nodes with very many members, children or ends are pre-aggregated; joins to them are sort-merge joins that adaptive execution splits. Ids
that end at a node are ordered and joined within slices; the last step streams these pieces through one SHA-256 for each node, in
constant memory, as a hash of one long text asks for.

Edge cases: null roles and texts count as empty; null turns come first; turns of one number are ordered by the SHA-256 of role and text, and equal ones are
interchangeable; rows with a null ``conv_id`` belong to no conversation; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, numbered, read, sliced
from .merkle import CRC32

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations are rebuilt from the first of each ``GROUP`` ids, by up to ``HEADS`` - 1 turns.
GROUP, HEADS = 20, 4
NOTHING = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1 on), a and b (120 bits of the turn's SHA-256), words, slice, of every turn; texts are read once."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda lo: F.conv(F.substring("sha", lo, 15), 16, 10).cast("long")
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.regexp_count(text, F.lit(WORD)).alias("words"), sha.alias("sha"))
    rows = cut(rows.select("conv_id", "turn", "words", part(1).alias("a"), part(16).alias("b"), F.monotonically_increasing_id().alias("tie")))
    rows = numbered(rows, "conv_id", "turn", "a", "b", "tie")
    return rows.select("conv_id", (F.col("number") + 1).alias("place"), "a", "b", "words", "slice")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and (conv_id, length) of conversations that start with the first turns of their group's first one.

    Conversation c gets the first h turns of c - c % 20 (all, if there are fewer) in place of its own first h; h is crc32(c) % 4.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    convs = sizes.select("*", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("base_size", F.lit(0))))
    convs = cut(convs.withColumn("length", F.col("k") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "k", "length"))
    own = turns.join(convs.select("conv_id", "h", "k"), "conv_id").filter("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("k"))
    heads = turns.filter(f"conv_id % {GROUP} = 0 and place < {HEADS}").drop("slice").withColumnRenamed("conv_id", "base")
    heads = heads.join(convs, "base").filter("place <= h").withColumn("slice", F.lit(-1))
    columns = ["conv_id", "slice", "place", "a", "b", "words"]
    return cut(own.select(columns).unionByName(heads.select(columns))), convs.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place, words, and names (x, y) and (px, py) of the prefix that ends with each turn and of the one before it.

    ``turns(conv_id, slice, place, a, b, words)``: slices of a conversation ascend with its places.
    """
    rows = turns.select("*", F.xxhash64("place", "a", "b").alias("u"), F.xxhash64("b", "a", "place").alias("v"))
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv_id", "slice").agg(F.bit_xor("u").alias("su"), F.bit_xor("v").alias("sv"))
    parts = parts.select("conv_id", "slice", *(F.coalesce(F.bit_xor(s).over(before), F.lit(0)).alias(o) for s, o in (("su", "ou"), ("sv", "ov"))))
    within = Window.partitionBy("conv_id", "slice").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.join(parts, ["conv_id", "slice"])
    found = found.select("*", *(F.bit_xor(s).over(within).bitwiseXOR(F.col(o)).alias(name) for s, o, name in (("u", "ou", "x"), ("v", "ov", "y"))))
    return found.select("conv_id", "place", "words", "x", "y", F.col("x").bitwiseXOR(F.col("u")).alias("px"), F.col("y").bitwiseXOR(F.col("v")).alias("py"))


def roll_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """x, y and ``values`` summed over the subtree of every node of ``nodes(x, y, px, py, depth, *values)``, by pointer jumping."""
    state = cut(nodes.select("x", "y", "px", "py", "depth", *values))
    deepest, reach = state.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deepest:
        up = state.filter(F.col("depth") >= reach)
        sums = up.groupBy("px", "py").agg(*(F.sum(v).alias(f"sum_{v}") for v in values)).withColumnsRenamed({"px": "x", "py": "y"})
        state = state.join(sums, ["x", "y"], "left").select("x", "y", "px", "py", "depth", *((F.col(v) + F.coalesce(f"sum_{v}", F.lit(0))).alias(v) for v in values))
        if 2 * reach <= deepest:
            # pointers twice as far: that of the node pointed at, where it has one
            hop = up.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("px").alias("qx"), F.col("py").alias("qy"))
            far = up.filter(F.col("depth") >= 2 * reach).select("x", "y", "px", "py").join(hop, ["px", "py"]).select("x", "y", "qx", "qy")
            state = state.drop("px", "py").join(far, ["x", "y"], "left").withColumnsRenamed({"qx": "px", "qy": "py"})
        state = cut(state)
        reach *= 2
    return state.select("x", "y", *values)


def digest_of_ends(ends: DataFrame) -> DataFrame:
    """x, y, ends_sha256: the SHA-256 of the ascending ``conv_id``s of ``ends(x, y, conv_id)`` under each name, comma-joined."""
    pieces = sliced(ends, "x", "y", "conv_id").groupBy("x", "y", "slice").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("x", "y", "slice", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sha = None, None  # the node that is open
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for x, y, ids in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "ids")), strict=True):
                if name == (x, y):
                    sha.update(f",{ids}".encode())
                    continue
                if name:
                    out.append((*name, sha.hexdigest()))
                name, sha = (x, y), hashlib.sha256(ids.encode())
            yield from told(out)
        if name:
            yield from told([(*name, sha.hexdigest())])

    def told(out: list) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["x", "y", "ends_sha256"])

    return pieces.repartition("x", "y").sortWithinPartitions("x", "y", "slice").mapInArrow(run, "x long, y long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes over ``turns(conv_id, slice, place, a, b, words)`` and ``convs(conv_id, length)``; see ``op12_prefixes`` for the columns.

    ``x`` and ``y`` name a node; (0, 0) is the root, which all conversations are members of.
    """
    zero = F.lit(0).cast("long")
    steps = cut(prefixes(turns))
    inner = steps.groupBy("x", "y").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("place").cast("long").alias("depth"),
        F.min("px").alias("px"), F.min("py").alias("py"), F.min("words").cast("long").alias("words"),
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("x"), zero.alias("y"), "conv_id", "n_convs", zero.alias("depth"), F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), zero.alias("words"))
    nodes = cut(inner.unionByName(root))
    children = nodes.filter("depth > 0").groupBy("px", "py").agg(F.count("*").alias("n_children")).withColumnsRenamed({"px": "x", "py": "y"})
    nodes = cut(nodes.join(children, ["x", "y"], "left").withColumn("n_children", F.coalesce("n_children", zero)))
    own = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    sums = roll_up(own, ["n_leaves", "saved_tokens"])
    last = steps.select("x", "y", "conv_id", "place").join(convs, "conv_id").filter("place = length").select("x", "y", "conv_id")
    last = last.unionByName(convs.filter("length = 0").select(zero.alias("x"), zero.alias("y"), "conv_id"))
    parents = nodes.filter("depth > 1").select("x", "y", "px", "py").join(nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent")), ["px", "py"]).select("x", "y", "parent")
    first = nodes.filter("depth = 0").agg(F.min("conv_id")).first()[0]  # the root is the parent of all nodes of depth 1
    out = reduce(lambda d, other: d.join(other, ["x", "y"], "left"), (sums, digest_of_ends(last), parents), nodes)
    parent: Column = F.when(F.col("depth") == 1, F.lit(first).cast("long")).otherwise(F.col("parent"))
    return out.select(
        "x", "y", "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")
    )


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per node of the trie of rebuilt conversations: its smallest member, depth, parent's smallest member, members, children, leaves and savings below, ends."""
    return trie(*rebuilt(cut(turns_of(read(spark, sf_dir, "conversations"))))).drop("x", "y")


SQL = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32.format("conv_id")} % 4 AS h, count(*) AS size FROM t GROUP BY conv_id),
k AS (SELECT c.*, least(h, coalesce(b.base_size, 0)) AS k FROM c LEFT JOIN (SELECT conv_id AS base, size AS base_size FROM c) b USING (base)),
r AS (
  SELECT t.conv_id, place - h + k AS place, role, text FROM t JOIN k USING (conv_id) WHERE place > h
  UNION ALL
  SELECT k.conv_id, place, role, text FROM k JOIN t ON t.conv_id = k.base WHERE place <= h),
p AS (
  SELECT conv_id, place AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '|') OVER (PARTITION BY conv_id ORDER BY place)) AS name,
         place = count(*) OVER (PARTITION BY conv_id) AS is_last
  FROM r
  UNION ALL
  SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM r) FROM c),
n AS (
  SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_last), '')) AS ends_sha256
  FROM p GROUP BY name, depth),
e AS (  -- every node with the node before it on the way of its smallest member
  SELECT n.name, p.name AS parent FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT parent AS name, count(*) AS n_children FROM e GROUP BY parent),
s AS (  -- every node counts for all prefixes of its smallest member up to itself
  SELECT p.name, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (k.name IS NULL) AS n_leaves
  FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN kids k ON k.name = n.name GROUP BY p.name)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.name = n.name LEFT JOIN kids ON kids.name = n.name LEFT JOIN e ON e.name = n.name LEFT JOIN n q ON q.name = e.parent
"""
