"""Helpers shared by the training-data operators.

Texts travel as Arrow batches of UTF-8 bytes; an operator sees plain ``bytes`` (or ``None``) and
numpy, never one Python call per Spark row. Work inside a batch is cut into slices of bounded size,
so the memory of a task follows neither the length of its longest text nor its row count.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one slice of a batch holds at most (a longer single text makes a slice of its own).
SLICE_BYTES = 4_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; where it is unset, make a local one in local mode only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docketry-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sliced(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` ranged by ``keys``, with the number of the range as ``slice``; cut, so that a row keeps its slice.

    Ranges are about equal in rows as long as the keys tell most rows apart.
    """
    return cut(rows.repartitionByRange(*keys).withColumn("slice", F.spark_partition_id()))


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with ``slice``, ``number`` (from 0 on, within ``key``, by ``order``, nulls first) and ``n``, the rows of the key.

    Two levels: rows are numbered within (slice, key), and offset by the rows of the key in the slices before. So a key with very
    many rows is dealt out to many tasks; one row for each (slice, key) is all that meets by key.
    """
    ranged = sliced(rows, key, *order)
    parts = ranged.groupBy("slice", key).agg(F.count("*").alias("m"))
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("slice", key, F.coalesce(F.sum("m").over(before), F.lit(0)).alias("ahead"), F.sum("m").over(Window.partitionBy(key)).alias("n"))
    within = Window.partitionBy("slice", key).orderBy(*order)
    return ranged.join(parts, ["slice", key]).withColumn("number", F.row_number().over(within) - 1 + F.col("ahead")).drop("ahead")


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with a function from one batch to some batches.

    A batch with a column ``text`` is handed over in slices of about ``SLICE_BYTES`` of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            sizes = pc.binary_length(batch.column(at)).fill_null(0).to_pylist() if at >= 0 and sliced else [0] * batch.num_rows
            for lo, hi in slices(sizes):
                yield from fn(batch.slice(lo, hi - lo))

    sliced = dict(df.dtypes).get("text") == "string"

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes add up to about ``limit``."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def crc_mod(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % mod, F.lit(0))


def bounded_sample(rows: DataFrame, id_col: str, bound: int, seed: int) -> DataFrame:
    """At most ``bound`` rows, chosen by a hash of the id: the same for any partitioning.

    A hash filter thins the rows on every executor first, so that the final top-``bound`` merge
    reads a small multiple of ``bound`` rows whatever the table holds.
    """
    order = F.xxhash64(F.col(id_col), F.lit(seed))
    n = rows.count()
    if n > 2 * bound:
        rows = rows.filter(F.pmod(order, F.lit(1_000_003)) < F.lit(int(1_000_003 * 1.5 * bound / n) + 1))
    return rows.orderBy(order, F.col(id_col)).limit(bound)


def tag_of(text: bytes | None) -> int:
    """64 bits that tell rows of one id apart, as a signed number: XXH64 with seed 42, as ``tag_column`` has it."""
    return 42 if text is None else (xxhash.xxh64_intdigest(text, 42) ^ 1 << 63) - (1 << 63)


def tag_column(text: Column) -> Column:
    return F.xxhash64(text)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names`` with as many underscores behind as it takes to clash with no column of ``taken``, in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64, vectorised."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
