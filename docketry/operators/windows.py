"""Ranks that hold up when one group has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def ranged(df: DataFrame, *keys: Column | str) -> DataFrame:
    """``df`` in ranges of ``keys``, with the number of the range as ``__slice``; cut, so that a row keeps it."""
    return cut(df.repartitionByRange(*keys).withColumn("__slice", F.spark_partition_id()))


def bisect(c: Column, cuts: list) -> Column:
    """How many of the ascending ``cuts`` are at or below ``c``, by nested comparisons."""

    def at(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c >= F.lit(cuts[mid]), at(mid + 1, hi)).otherwise(at(lo, mid))

    return at(0, len(cuts))


#: Rows of a slice from which on ranges of the whole order are used instead.
HOT = 1_000_000


def numbered(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``__number`` (0, 1, ... within ``group`` by ``order``) and ``__size`` of the group, by ranges of the order, so that no value and no tie holds a task.

    As many ranges as the session has shuffle partitions, or as adaptive execution makes of them; the order should tell most rows apart.
    """
    keys = [F.col(g) for g in group]
    rows = ranged(df, *keys, *order)
    counts = rows.groupBy("__slice", *group).agg(F.count("*").alias("__n"))
    same = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = same.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("__slice").alias("__s"), *(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(same).alias("__size")
    )
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__slice", *group).orderBy(*order)))
    on = F.col("__slice") == F.col("__s")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = rows.join(counts, on).withColumn("__number", F.col("__before") + F.col("__r") - 1)
    return out.drop("__slice", "__s", "__r", "__before", *(f"__g{i}" for i in range(len(group))))


def spread_rank(df: DataFrame, group: str, lead: Column, order: list[Column], slices: int = 64, hot: int = HOT) -> DataFrame:
    """``df`` with ``rank`` (0, 1, ... within ``group`` by ``order``) and no task that holds a whole large group.

    ``lead`` is a long that never decreases along ``order`` (nulls last). Groups are cut at quantiles of it; rows are ranked within (group,
    slice), and slices are offset by the rows before them. Rows that agree in ``lead`` share a slice; where one of more than ``hot`` rows comes of that, as of
    undated messages of one key, ranges of the whole order are used instead.
    """
    found = df.select(F.percentile_approx(lead, [i / slices for i in range(1, slices)], 100 * slices).alias("q")).first()["q"]
    cuts = sorted(set(found or []))
    sliced = df.withColumn("__slice", F.when(lead.isNull(), F.lit(len(cuts) + 1)).otherwise(bisect(lead, cuts)))
    counts = cut(sliced.groupBy(group, "__slice").agg(F.count("*").alias("__n")))
    if counts.filter(F.col("__n") > hot).limit(1).count():
        return numbered(df, [group], order).withColumn("rank", F.col("__number").cast("int")).drop("__number", "__size")
    before = Window.partitionBy(group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(group).alias("__g"), F.col("__slice").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(group, "__slice").orderBy(*order)
    ranked = sliced.withColumn("__r", F.row_number().over(within))
    joined = ranked.join(counts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__slice") == F.col("__s")))
    return joined.withColumn("rank", (F.col("__before") + F.col("__r") - 1).cast("int")).drop("__slice", "__r", "__g", "__s", "__before")


def running_total(df: DataFrame, value: str, order: list[str], lead: str, slices: int = 256, hot: int = HOT) -> DataFrame:
    """``df`` with ``running``: the sum of ``value`` up to each row in a global order that starts with column ``lead``.

    The same two levels as ``spread_rank``, with the whole table as its one group; ``lead`` has no nulls. Where a slice has more than ``hot`` rows, slices are ranges
    of the whole order, as many as there are shuffle partitions.
    """
    number = F.unix_micros(F.col(lead).cast("timestamp")) if dict(df.dtypes)[lead].startswith("timestamp") else F.col(lead).cast("long")
    found = df.select(F.percentile_approx(number, [i / slices for i in range(1, slices)], 100 * slices).alias("q")).first()["q"]
    sliced = df.withColumn("__slice", bisect(number, sorted(set(found or []))))
    sums = cut(sliced.groupBy("__slice").agg(F.sum(value).alias("__v"), F.count("*").alias("__n")))
    if sums.filter(F.col("__n") > hot).limit(1).count():
        sliced = ranged(df, *order)
        sums = sliced.groupBy("__slice").agg(F.sum(value).alias("__v"))
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    sums = sums.select(F.col("__slice").alias("__s"), F.coalesce(F.sum("__v").over(before), F.lit(0.0)).alias("__before"))
    within = Window.partitionBy("__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = sliced.withColumn("__own", F.sum(value).over(within)).join(F.broadcast(sums), F.col("__slice") == F.col("__s"))  # a row for each slice
    return joined.withColumn("running", F.col("__before") + F.col("__own")).drop("__slice", "__own", "__s", "__before")


def top_n(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
