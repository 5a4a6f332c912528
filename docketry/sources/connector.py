"""Archives as a data source of Spark: ``spark.read.format("archive").load(path)`` gives archive, member, content.

Conditions on ``archive`` and ``member`` (=, IN, LIKE with a fixed start, end or part) are pushed into the source: archives are chosen by name before they are
opened, and of members only the wanted ones are read. Zips are read by parts of their directory, so a large one makes several partitions; a tar is one.
With the option ``content`` set to false only names are read. Files are listed where the query is planned and opened in the tasks, by stores that pyarrow knows;
elsewhere ``archives.tar`` and ``archives.zip_members`` take contents through Spark.
"""

from __future__ import annotations

import fnmatch
import tarfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith

from . import archives, listing

#: Bytes of a zip that one partition reads, about.
PART = 64_000_000
_CHECKS: dict[type, Callable[[str, object], bool]] = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    StringStartsWith: str.startswith,
    StringEndsWith: str.endswith,
    StringContains: str.__contains__,
}


@dataclass
class Part(InputPartition):
    """Members ``nth``, ``nth + of``, ... of the archive at ``path``."""

    path: str
    nth: int
    of: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.content = options.get("content", "true").lower() == "true"
        self.part = int(options.get("partBytes", PART))
        self.wanted: dict[str, list[tuple[type, object]]] = {"archive": [], "member": []}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute in (("archive",), ("member",)):
                continue  # names are never null
            if type(f) in _CHECKS and f.attribute in (("archive",), ("member",)) and f.value is not None:
                self.wanted[f.attribute[0]].append((type(f), frozenset(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def passes(self, column: str, name: str) -> bool:
        return all(_CHECKS[kind](name, value) for kind, value in self.wanted[column])

    def partitions(self) -> list[Part]:
        folder, _, pattern = self.path.rpartition("/")
        glob = any(c in pattern for c in "*?[")
        store, at = FileSystem.from_uri(folder if glob else self.path)
        info = store.get_file_info(at)
        files = [info] if info.type == FileType.File else store.get_file_info(FileSelector(at))
        files = [f for f in files if f.type == FileType.File and not f.base_name.startswith((".", "_")) and (not glob or fnmatch.fnmatchcase(f.base_name, pattern))]
        scheme = self.path.partition(":")[0] + "://" + (self.path.partition("://")[2].partition("/")[0] if "://" in self.path else "") if ":" in self.path.split("/")[0] else ""
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if self.passes("archive", f.base_name):
                of = max(1, -(-f.size // self.part)) if f.base_name.endswith(".zip") else 1
                out += [Part(f"{scheme}{f.path}", nth, of) for nth in range(of)]
        return out

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # of no partitions
            return
        name = partition.path.rpartition("/")[2]
        with archives.opener({"path": partition.path})() as raw:
            zipped = raw.read(2) == listing.ZIP
            raw.seek(0)
            members = self._zip(raw, partition) if zipped else self._tar(raw)
            yield from archives._batches((name, m, c) for m, c in members)

    def _zip(self, raw, partition: Part) -> Iterator[tuple[str, bytes | None]]:
        with zipfile.ZipFile(raw) as z:
            names = sorted(n for n in z.namelist() if not n.endswith("/") and self.passes("member", n))
            for n in names[partition.nth :: partition.of]:
                yield n, z.read(n) if self.content else None

    def _tar(self, raw) -> Iterator[tuple[str, bytes | None]]:
        with tarfile.open(fileobj=raw, mode="r|*") as t:
            for i in t:
                if i.isdir() or not self.passes("member", i.name):
                    continue
                if not i.isfile():
                    raise ValueError(f"{i.name} is not a regular file")
                yield i.name, t.extractfile(i).read() if self.content else None


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return archives.MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session, and its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    return spark
