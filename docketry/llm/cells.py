"""Groups that are compared in cells of bounded size, by many tasks, for the links that join their components.

A group may hold any share of all rows. What one component of it has already joined is not compared within itself, no pairs are emitted, and a cell gives at most one link
for each of its rows and component it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components

#: Elements of sets on either side of a cell, about.
SET_CELL = 1_000_000
#: Which of some rows of a cell are candidates of a row.
Near = Callable[[int, np.ndarray], np.ndarray]


def fits(a, b, similarity: int):
    """Whether sets of these sizes can be alike to this percentage; of columns or of numpy arrays."""
    return (100 * a >= similarity * b) & (100 * b >= similarity * a)


def blocks(members: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """``members(key, class, component, ...)`` of groups of several components, dealt to cells: with row, column, and role.

    A group's largest component stays together; the classes outside it (rows, role 1) meet all of the group (columns, role 2). Either is cut into blocks of
    about ``limit`` in ``size``, and each (row block, column block) is a cell; where one cell holds all, a class comes once (role 3, or 2 in the largest component).
    """
    parts = members.groupBy(key, "component").agg(F.sum(size).alias("m"))
    groups = parts.groupBy(key).agg(F.sum("m").alias("all"), F.max(F.struct("m", "component")).alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    groups = groups.select(key, F.ceil(F.col("all") / limit).cast("int").alias("columns"), F.ceil((F.col("all") - F.col("most.m")) / limit).cast("int").alias("rows"), F.col("most.component").alias("largest"))
    of = members.join(groups, key).withColumn("outside", F.col("component") != F.col("largest"))
    block = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda role, row, column: F.struct(F.lit(role).alias("role"), row.alias("row"), column.alias("column"))
    whole = F.array(F.when(F.col("outside"), cell(3, F.lit(0), F.lit(0))).otherwise(cell(2, F.lit(0), F.lit(0))))
    as_column = F.transform(each("rows"), lambda r: cell(2, r, block("columns")))
    as_row = F.when(F.col("outside"), F.transform(each("columns"), lambda c: cell(1, block("rows"), c))).otherwise(F.array().cast("array<struct<role:int,row:int,column:int>>"))
    dealt = F.explode(F.when(F.col("columns") == 1, whole).otherwise(F.concat(as_column, as_row))).alias("cell")
    kept = [c for c in members.columns if c != key]
    return of.select(key, dealt, *kept).select(key, "cell.*", *kept).repartition(key, "row", "column").sortWithinPartitions(key, "row", "column")


def by_cell(dealt: DataFrame, key: str, links: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """(a, b) that ``links`` gives for the rows of each cell of ``blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[pa.RecordBatch]:
            if out := links(pa.Table.from_batches(held).combine_chunks()):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

        held: list[pa.RecordBatch] = []  # the cell that is open, in parts
        last = None
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (key, "row", "column")], 1)
            edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), len(names)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi > lo:
                    if held and names[lo].tolist() != last:
                        yield from found()
                        held = []
                    held.append(batch.slice(lo, hi - lo))
                    last = names[lo].tolist()
        if held:
            yield from found()

    return dealt.mapInArrow(run, "a long, b long")


def joining(part: pa.Table, similarity: int, near: Near) -> list[tuple[int, int]]:
    """Links of a cell's rows to its columns that join components, as few as it takes; candidates by ``near``, confirmed where the cell has a column ``set``."""
    names, component, n, role, company = (part.column(c).to_numpy() for c in ("class", "component", "n", "role", "company"))
    sets = "set" in part.column_names
    _, root = np.unique(component, return_inverse=True)  # components by number; those that are joined get one number
    if sets:
        arrays = part.column("set").combine_chunks()
        starts = np.concatenate([[0], np.cumsum(n)])
        _, words = np.unique(arrays.flatten().to_numpy(), return_inverse=True)
        seen = np.zeros(words.max(initial=0) + 1, bool)
    columns, out = np.flatnonzero(role >= 2), []
    for i in sorted(np.flatnonzero(role != 2).tolist(), key=lambda i: (-company[i], names[i])):
        some = columns[(root[columns] != root[i]) & fits(n[columns], n[i], similarity)]
        some = some[near(i, some)]
        if sets and len(some):
            seen[words[starts[i] : starts[i + 1]]] = True
            common = np.array([np.count_nonzero(seen[words[starts[j] : starts[j + 1]]]) for j in some.tolist()])
            seen[words[starts[i] : starts[i + 1]]] = False
            some = some[100 * common >= similarity * (n[some] + n[i] - common)]
        # one link for each component that is met
        for j in some[np.unique(root[some], return_index=True)[1]].tolist():
            out.append((int(names[i]), int(names[j])))
            root[root == root[j]] = root[i]
    return out


def refined(members: DataFrame, similarity: int, limit: int = SET_CELL) -> DataFrame:
    """``members(family, class, n, set, ...)`` with families of more than ``limit`` elements cut into what can be alike at all, and without what can not.

    Shingles of a family are ordered, rarest first. Two sets that are alike enough share one of the first n - ceil(similarity n / 100) + 1 of either, so what such shingles
    connect is a family of its own, and no link is lost. Shingles of one text only never meet; a text whose first ones are all such has no partner. So
    unlike texts, which long ones of one language with close fingerprints mostly are, are not compared, however many there are. The rows made are as many as shingles.
    """
    large = cut(members.groupBy("family").agg(F.sum("n").alias("all")).filter(F.col("all") > limit).select(F.col("family").alias("f")))
    if not large.limit(1).count():
        return members
    is_large = F.col("family") == F.col("f")
    each = members.join(large, is_large, "left_semi").select("family", "class", "n", F.explode("set").alias("s"))
    shared = each.groupBy("family", "s").agg(F.count("*").cast("int").alias("df")).filter("df > 1")
    ordered = each.join(shared, ["family", "s"]).groupBy("family", "class", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("by"))
    first = F.col("n") - F.floor((similarity * F.col("n") + 99) / 100) + 1 - (F.col("n") - F.size("by"))
    prefix = cut(ordered.filter(first > 0).select("family", "class", F.explode(F.slice("by", F.lit(1), first.cast("int"))).alias("p")).select("family", "p.s", "class"))
    least = prefix.groupBy("family", "s").agg(F.min("class").alias("least"), F.count("*").alias("m")).filter("m > 1").drop("m")
    roots = components(prefix.join(least, ["family", "s"]).filter("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b")).distinct())
    parts = members.join(large, is_large, "left_semi").join(roots, F.col("class") == F.col("node")).withColumn("family", F.col("root")).select(members.columns)
    return cut(members.join(large, is_large, "left_anti").unionByName(parts))


def confirmed(members: DataFrame, similarity: int, candidates: Callable[[pa.Table], Near], limit: int = SET_CELL) -> DataFrame:
    """Links (a, b) of candidates whose sets have a Jaccard similarity of ``similarity`` percent or more, enough of them to connect what is connected.

    ``members(family, class, company, n, set, ...)``: a candidate pair lies within one family, ``n`` is the size of ``set``, ``company`` is greatest for the likely original.
    """
    # families of more than one cell meet their hub first
    large = members.groupBy("family").agg(F.sum("n").alias("all"), F.max(F.struct("company", "class")).alias("hub")).filter(F.col("all") > limit).select(F.col("family").alias("f"), F.col("hub.class").alias("hub"))
    hubs = members.join(large, (F.col("family") == F.col("f")) & (F.col("class") == F.col("hub"))).select("f", "hub", F.col("n").alias("nh"), F.col("set").alias("sh"))
    common = F.size(F.array_intersect("set", "sh"))
    met = members.join(hubs, F.col("family") == F.col("f")).filter((F.col("class") != F.col("hub")) & fits(F.col("n"), F.col("nh"), similarity)).select("class", "hub", "n", "nh", common.alias("common"))
    met = cut(met.filter(100 * F.col("common") >= similarity * (F.col("n") + F.col("nh") - F.col("common"))).select(F.col("class").alias("a"), F.col("hub").alias("b")))
    joined = members.join(met.select(F.col("a").alias("class"), F.col("b").alias("__hub")), "class", "left").withColumn("component", F.coalesce("__hub", "class")).drop("__hub")
    return cut(by_cell(blocks(joined, "family", F.col("n"), limit), "family", lambda part: joining(part, similarity, candidates(part))).unionByName(met))


