"""Lists of archives' members that are kept: an archive is opened again only when it has changed.

The index is a Parquet folder with a row for each member, by the archive's path, size and time of change. ``listing`` opens only archives that the index does not
have as they are now, adds what they hold, and answers from the index. Of plain tars and of zips it keeps where a member's bytes lie, so that ``contents`` reads
wanted members by seeking, dealt out in ranges to many tasks; compressed tars are streamed, one task each, up to their last wanted member.

Rows of archives as they were before stay in the index and are not read; each scan adds a folder of its own, so scans side by side do
no harm: of an archive that two of them listed, one listing counts.
"""

from __future__ import annotations

import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives
from .tables import _exists

LISTING = "path string, size long, modified long, archive string, member string, length long, at long, packed long, method int"
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in LISTING.split(", "))])
KEY = ["path", "size", "modified"]
#: The first bytes of compressed streams, and of zips.
PACKED, ZIP = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ"), b"PK"
#: Bytes of an archive whose members one task reads, about.
RANGE = 64_000_000


def members_of(raw) -> Iterator[dict]:
    """member, length and, where its bytes can be read by themselves, at (of a zip: the local header), packed, method, in order of the archive."""
    head = raw.read(6)
    raw.seek(0)
    if head.startswith(ZIP):
        with zipfile.ZipFile(raw) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield {"member": i.filename, "length": i.file_size, "at": i.header_offset, "packed": i.compress_size, "method": i.compress_type}
        return
    packed = head.startswith(PACKED)
    with tarfile.open(fileobj=raw, mode="r|*" if packed else "r:") as t:
        for i in t:
            if i.isfile():
                yield {"member": i.name, "length": i.size} | ({} if packed else {"at": i.offset_data, "packed": i.size, "method": None})
            elif not i.isdir():
                raise ValueError(f"{i.name} is not a regular file")


def _listed(fresh: DataFrame) -> DataFrame:
    """``LISTING`` of archives (path, size, modified); an archive without members has one row with a null one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = r | {"archive": r["path"].rpartition("/")[2]}
                held, some = [], False
                with archives.opener(r | {"content": None})() as raw:
                    for m in members_of(raw):
                        held.append(own | m)
                        some = True
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_pylist(held, schema=SCHEMA)
                            held = []
                if held or not some:
                    yield pa.RecordBatch.from_pylist(held or [own], schema=SCHEMA)

    return fresh.repartition("path").mapInArrow(run, LISTING)


def listing(spark: SparkSession, path: str, index: str) -> DataFrame:
    """``LISTING`` of the archives under ``path`` as they are now, from the ``index``, which is brought up to date before."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))

    def have() -> DataFrame:
        if not _exists(spark, index):
            return spark.createDataFrame([], f"{LISTING}, scan string")
        return spark.read.schema(f"{LISTING}, scan string").parquet(index)

    fresh = files.join(have().select(KEY).distinct(), KEY, "left_anti")
    if fresh.limit(1).count():
        _listed(fresh).write.parquet(f"{index}/scan={uuid.uuid4().hex}")
    found = have()
    first = found.groupBy(KEY).agg(F.min("scan").alias("scan"))
    return found.join(files.join(first, KEY), [*KEY, "scan"], "left_semi").filter("member is not null").drop("scan")


def contents(rows: DataFrame, bytes_a_task: int = RANGE) -> DataFrame:
    """archive, member, content of some rows of a ``listing``."""
    seek = rows.filter("at is not null").withColumn("range", F.floor(F.col("at") / bytes_a_task))
    seek = seek.repartition("path", "range").sortWithinPartitions("path", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple[str, str, bytes]]:
            raw, last = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["path"] != last:
                        if raw:
                            raw.close()
                        raw, last = archives.opener(r | {"content": None})(), r["path"]
                    at = r["at"]
                    if r["method"] is not None:  # the name and the extra field stand behind the local header of 30 bytes
                        raw.seek(at + 26)
                        sizes = raw.read(4)
                        at += 30 + int.from_bytes(sizes[:2], "little") + int.from_bytes(sizes[2:], "little")
                    raw.seek(at)
                    data = raw.read(r["packed"])
                    if r["method"] not in (None, zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                        raise ValueError(f"{r['member']}: compression {r['method']} is not known")
                    yield r["archive"], r["member"], zlib.decompress(data, -15) if r["method"] == zipfile.ZIP_DEFLATED else data
            if raw:
                raw.close()

        yield from archives._batches(read())

    def stream(opened, only) -> Iterator[tuple[str, bytes]]:
        left = set(only)
        with opened() as raw, tarfile.open(fileobj=raw, mode="r|*") as t:
            for i in t:
                if i.name in left:
                    yield i.name, t.extractfile(i).read()
                    left.discard(i.name)
                    if not left:
                        return

    packed = rows.filter("at is null").groupBy("archive", "path").agg(F.collect_set("member").alias("members"))  # at most what the archive lists
    streamed = archives._read(packed.withColumn("content", F.lit(None).cast("binary")), stream)
    return seek.select("archive", "path", "member", "at", "packed", "method").mapInArrow(run, archives.MEMBERS).unionByName(streamed)
