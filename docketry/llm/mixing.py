"""Mixing sources to target weights by capped water-filling and seeded repetition.

The mix is ``share`` times as large as the corpus. Sources in code point order (null last) weigh ``weights``,
repeated. A source is clamped at ``max_epochs`` times its size, the excess goes to the others by weight until none is above: all
targets are min(cap, weight * level), and the level is the largest over sources in order of cap by weight of (mix -
caps before) / (weights from here on).

Within a source every document is taken floor(target / size) times whole; what is missing is taken from the documents in
a seeded pseudo-random order until it is reached, the last one in part. So a source's taken words are its rounded target.
The order's running sum is two-level: documents are dealt to (source, slice of the hash range), slices are summed first and
offset by the sums of the slices before; no task holds a whole source. Only tables of one row per source, or per slice of a source, meet in one task.
Everything is DataFrame operations.

Edge cases: a null or wordless text has size 0 and is taken 0 words; a source of size 0 gets target 0; null sources are one
source; null ids are ordered as an empty id; rows that agree in id and size are interchangeable; an empty table gives
an empty result; extra columns are ignored or, by ``expand``, carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, read

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2, 17
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that name a slice of a source; a task sorts about a 16,384th of its documents.
_SLICE_BITS, _KEY_BITS = 14, 60


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target for ``sources(source, source_size)``: one row per source, so its windows are small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*map(F.lit, weights))
    s = sources.select("*", F.element_at(w, (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double").alias("w"))
    s = s.withColumn("cap", (max_epochs * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(F.lit(1))
    level = (share * F.sum("source_size").over(everything) - (F.sum("cap").over(order) - F.col("cap"))) / (
        F.sum("w").over(everything) - (F.sum("w").over(order) - F.col("w"))
    )
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return s.select("source", "source_size", F.least("cap", F.col("w") * F.col("level")).alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """doc_id, size, source, source_size, target, taken of every row of ``docs(doc_id, source, text)``."""
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, _KEY_BITS // 4), 16, 10)
    sized = cut(
        docs.select(
            "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.cast("long").alias("key")
        ).withColumn("slice", F.shiftright("key", _KEY_BITS - _SLICE_BITS))
    )
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    plan = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, max_epochs)
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("source", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("offset"))
    slices = slices.join(plan.withColumnRenamed("source", "s0"), F.col("source").eqNullSafe(F.col("s0"))).drop("s0")
    slices = slices.withColumnsRenamed({"source": "s1", "slice": "slice1"})
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    runs = sized.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = runs.join(slices, F.col("source").eqNullSafe(F.col("s1")) & (F.col("slice") == F.col("slice1")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    missing = F.floor(F.col("target") + 0.5) - whole * F.col("source_size")
    part = F.least(F.greatest(missing - F.col("offset") - F.col("ahead"), F.lit(0)), F.col("size"))
    return out.select("doc_id", "size", "source", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"))


def expand(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself: rows of ``docs`` with ``repetition`` (0, 1, ...); the text of a part is cut after its words.

    Needs unique ids. The column is called repetition_ where ``docs`` has one named repetition.
    """
    own, size, taken, number, left = fresh(docs.columns, "id", "size", "taken", "repetition", "left")
    m = mixed.select(F.col("doc_id").alias(own), F.col("size").alias(size), F.col("taken").alias(taken)).filter(F.col(taken) > 0)
    j = docs.join(m, docs["doc_id"].eqNullSafe(F.col(own)))
    j = j.withColumn(number, F.explode(F.sequence(F.lit(0), F.ceil(F.col(taken) / F.col(size)).cast("int") - 1)))
    j = j.withColumn(left, (F.col(taken) - F.col(number) * F.col(size)).cast("int"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut_text = F.array_join(F.slice(words, F.lit(1), F.col(left)), " ")
    return j.withColumn("text", F.when(F.col(left) >= F.col(size), F.col("text")).otherwise(cut_text)).drop(own, size, taken, left)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - (sum(cap) OVER o - cap)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level FROM w
      WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + least(greatest(CAST(floor(target + 0.5) AS BIGINT) - whole * source_size - ahead, 0), size) AS BIGINT) AS taken
FROM r
"""
