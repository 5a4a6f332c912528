"""Archives as DataFrames: one task reads one archive as a stream and emits members in bounded batches.

Archives do not split, so the tasks are the archives; ``spread`` deals the members out before any parsing. Spark lists the paths; where
pyarrow knows the store, tasks open them as streams and hold one batch of members, of any size of archive, and of a zip they read the wanted
members only. Elsewhere Spark's ``binaryFile`` hands over contents, which bounds an archive at 2 GB.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import member_parts

MEMBERS = "archive string, member string, content binary"
#: Bytes of members in one batch.
BATCH_BYTES = 16_000_000


def _batches(rows: Iterable[tuple[str, str, bytes | None]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.binary())])
    for row in rows:
        held.append(row)
        size += len(row[2] or b"") + 100
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def opens(path: str) -> bool:
    """Whether pyarrow knows the store of a path."""
    try:
        FileSystem.from_uri(path)[0].get_file_info(FileSystem.from_uri(path)[1])
    except (OSError, ValueError, ImportError, NotImplementedError):
        return False
    return True


def opener(row: dict) -> Callable:
    """A function that opens an archive's bytes, of ``row`` with path or content."""

    def opened():
        if row["path"] is None:
            return io.BytesIO(row["content"])
        store, at = FileSystem.from_uri(row["path"])
        return store.open_input_file(at)

    return opened


def found(spark: SparkSession, path: str | None = None, files: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """archive, path, content, members of the files under ``path``, or of ``files(archive, content)`` as given.

    Either path or content is null. ``wanted(archive, member)`` restricts archives to those named in it, and ``members`` to theirs.
    """
    if files is not None:
        rows = files.select("archive", F.lit(None).cast("string").alias("path"), "content")
    else:
        listed = spark.read.format("binaryFile").load(path)  # columns that are not asked for are not read
        some = listed.select("path").first()
        name = F.substring_index("path", "/", -1).alias("archive")
        if some is None or opens(some["path"]):
            rows = listed.select(name, "path", F.lit(None).cast("binary").alias("content"))
        else:
            rows = listed.select(name, F.lit(None).cast("string").alias("path"), "content")
    if wanted is None:
        return rows.withColumn("members", F.lit(None).cast("array<string>"))
    own = wanted.groupBy(F.col("archive").alias("__a")).agg(F.collect_set("member").alias("members"))  # at most what the archive lists
    return rows.join(own, F.col("archive") == F.col("__a")).drop("__a")


def _read(rows: DataFrame, members_of: Callable[[Callable, frozenset[str] | None], Iterable[tuple[str, bytes | None]]]) -> DataFrame:
    """``MEMBERS`` by a function from an opener and the wanted members, if restricted, to members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                wanted = None if r["members"] is None else frozenset(r["members"])
                yield from _batches((r["archive"], m, c) for m, c in members_of(opener(r), wanted))

    return rows.select("archive", "path", "content", "members").mapInArrow(run, MEMBERS)


def tar(spark: SparkSession, path: str | None = None, wanted: DataFrame | None = None, with_content: bool = True, files: DataFrame | None = None) -> DataFrame:
    """archive, member, content of all regular members (gz, bz2 or plain).

    ``wanted(archive, member)``: what to extract, of any number; other members are passed over. To restrict by other columns, list with
    ``with_content=False``, join, and come again with what is left.
    """

    def members_of(opened, only) -> Iterator[tuple[str, bytes | None]]:
        with opened() as raw, tarfile.open(fileobj=raw, mode="r|*") as t:
            for info in t:
                if info.isdir() or (only is not None and info.name not in only):
                    continue
                if not info.isfile():
                    raise ValueError(f"{info.name} is not a regular file")
                yield info.name, t.extractfile(info).read() if with_content else None

    return _read(found(spark, path, files, wanted), members_of)


def zip_members(
    spark: SparkSession, path: str | None = None, suffixes: tuple[str, ...] = (), root_only: bool = False, files: DataFrame | None = None
) -> DataFrame:
    """archive, member, content of a zip's members with one of the suffixes; ``root_only``: not those in folders."""

    def members_of(opened, only) -> Iterator[tuple[str, bytes]]:
        with opened() as raw, zipfile.ZipFile(raw) as z:
            for name in sorted(z.namelist()):
                if not name.endswith("/") and (not suffixes or name.endswith(suffixes)) and not (root_only and "/" in name):
                    yield name, z.read(name)

    return _read(found(spark, path, files), members_of)


def spread(members: DataFrame, partitions: int) -> DataFrame:
    """Deal the members of few archives out to many tasks."""
    return members.repartition(partitions, "archive", "member")


def custodian_map(spark: SparkSession, path: str | None = None, files: DataFrame | None = None, index: str | None = None) -> DataFrame:
    """trec_doc_id, custodian, path of every text member, contents unread; with an ``index`` from the listing that is kept there."""
    if index is not None:
        from .listing import listing  # which reads archives by this module

        members = listing(spark, path, index)
    else:
        members = tar(spark, path, with_content=False, files=files)
    names = members.select(member_parts("member").alias("m")).filter("m is not null")
    return names.select(F.col("m.docid").alias("trec_doc_id"), F.col("m.custodian").alias("custodian"), F.col("m.path").alias("path"))
