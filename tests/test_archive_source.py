"""The archive format, with filters that are pushed, and kept listings."""

import gzip
import io
import os
import shutil
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from docketry.sources import archives, connector, listing


def text(k):
    return f"text {k} ".encode() * (k % 7 + 1)


def write_tar(path, members, mode):
    with tarfile.open(path, mode) as t:
        d = tarfile.TarInfo("dir")
        d.type = tarfile.DIRTYPE
        t.addfile(d)
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def write_zip(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        z.writestr("dir/", b"")
        for name, data in members:
            z.writestr(name, data)


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    write_tar(at / "a.tgz", [(f"x/{k}.txt", text(k)) for k in range(20)], "w:gz")
    write_tar(at / "b.tar", [(f"x/{k}.txt", text(k)) for k in range(20, 40)], "w")
    write_tar(at / "c.tar.bz2", [(f"y/{k}.txt", text(k)) for k in range(40, 60)], "w:bz2")
    write_zip(at / "d.zip", [(f"z/{k}.txt", text(k)) for k in range(60, 90)])
    write_zip(at / "e.zip", [(f"z/ü{k}.txt", text(k)) for k in range(90, 99)], zipfile.ZIP_STORED)
    write_zip(at / "none.zip", [])
    return at


def rows(df):
    return {(r["archive"], r["member"], bytes(r["content"]) if r["content"] is not None else None) for r in df.collect()}


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_format_with_pushed_filters(spark, folder):
    connector.register(spark)
    every = spark.read.format("archive").load(str(folder))
    assert every.columns == ["archive", "member", "content"] and every.count() == 99
    # an archive that cannot be read is no harm to a query that does not want it
    (folder / "ruined.zip").write_bytes(b"PK nothing")
    got = every.filter((F.col("archive") != "x") & F.col("archive").isin("a.tgz", "d.zip") & F.col("member").endswith("7.txt"))
    assert rows(got) == {("a.tgz", "x/7.txt", text(7)), ("a.tgz", "x/17.txt", text(17)), ("d.zip", "z/67.txt", text(67)), ("d.zip", "z/77.txt", text(77)), ("d.zip", "z/87.txt", text(87))}
    names = [f"x/{k}.txt" for k in range(0, 40, 3)] + ["missing"]
    assert {r["member"] for r in every.filter(F.col("archive").startswith("b") & F.col("member").isin(names)).collect()} == {f"x/{k}.txt" for k in range(21, 40, 3)}
    assert rows(every.filter("archive = 'c.tar.bz2' and member like '%/4_.txt'")) == {("c.tar.bz2", f"y/{k}.txt", text(k)) for k in range(40, 50)}
    plan = plan_of(every.filter("archive = 'a.tgz' and member = 'x/7.txt'"))
    assert "PushedFilters: [" in plan and "EqualTo(archive,a.tgz)" in plan and "EqualTo(member,x/7.txt)" in plan and "Filter (" not in plan
    left = every.filter("archive = 'a.tgz' and length(member) = 7")  # what cannot be pushed is done by Spark
    assert rows(left) == {("a.tgz", f"x/{k}.txt", text(k)) for k in range(10)}


def test_format_parts_globs_names(spark, folder):
    connector.register(spark)
    read = spark.read.format("archive")
    parts = read.option("partBytes", "500").load(f"{folder}/d.zip")
    assert parts.rdd.getNumPartitions() > 3 and rows(parts) == {("d.zip", f"z/{k}.txt", text(k)) for k in range(60, 90)}
    names = spark.read.format("archive").option("content", "false").load(f"{folder}/*.zip")
    assert names.filter("content is null").count() == 39 and rows(spark.read.format("archive").load(f"file://{folder}/e.zip")) == {("e.zip", f"z/ü{k}.txt", text(k)) for k in range(90, 99)}
    assert spark.read.format("archive").load(f"{folder}/*.nothing").count() == 0


def scans(index):
    return sorted(os.listdir(index))


def test_listing_is_kept(spark, folder, tmp_path):
    """A second run opens nothing, as archives of the same size and time but of garbage show; a changed, a new and a removed archive are seen."""
    index = str(tmp_path / "index")
    first = listing.listing(spark, str(folder), index)
    names = {(r["archive"], r["member"], r["length"]) for r in first.collect()}
    assert len(names) == 99 == first.count() and len(scans(index)) == 1
    assert {r["archive"] for r in first.filter("at is null").collect()} == {"a.tgz", "c.tar.bz2"}
    for name in os.listdir(folder):
        at = folder / name
        stat = at.stat()
        shutil.copy(at, tmp_path / name)
        at.write_bytes(b"?" * stat.st_size)
        os.utime(at, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert {(r["archive"], r["member"], r["length"]) for r in listing.listing(spark, str(folder), index).collect()} == names and len(scans(index)) == 1
    for name in ("a.tgz", "b.tar", "c.tar.bz2", "d.zip", "e.zip", "none.zip"):
        shutil.copy(tmp_path / name, folder / name)
    (folder / "c.tar.bz2").unlink()
    write_tar(folder / "b.tar", [("x/new.txt", b"new")], "w")
    write_zip(folder / "f.zip", [("z/more.txt", b"more")])
    now = {(r["archive"], r["member"]) for r in listing.listing(spark, str(folder), index).collect()}
    assert now == {(a, m) for a, m, _ in names if a not in ("b.tar", "c.tar.bz2")} | {("b.tar", "x/new.txt"), ("f.zip", "z/more.txt")}
    assert len(scans(index)) == 2


def test_contents_by_seeking(spark, folder, tmp_path):
    found = listing.listing(spark, str(folder), str(tmp_path / "index"))
    wanted = found.filter(F.regexp_extract("member", r"(\d+)\.txt", 1).cast("int") % 2 == 0)
    want = {(a, m, c) for a, m, c in rows(archives.tar(spark, f"{folder}/*.t*")) | rows(archives.zip_members(spark, f"{folder}/*.zip")) if int(m.rpartition(".")[0].lstrip("xyz/ü")) % 2 == 0}
    for size in (listing.RANGE, 300):
        assert rows(listing.contents(wanted, size)) == want and len(want) == 50
    with gzip.open(folder / "g.tgz", "wb") as f:
        f.write((folder / "b.tar").read_bytes() + b"junk that is never reached" * 100_000)
    one = listing.listing(spark, f"{folder}/[be]*", str(tmp_path / "index2")).filter("member = 'x/20.txt' or archive = 'e.zip'")
    assert len(rows(listing.contents(one))) == 10


def test_two_scans_side_by_side(spark, folder, tmp_path):
    index = tmp_path / "index"
    listing.listing(spark, str(folder), str(index))
    shutil.copytree(index / scans(index)[0], index / "scan=0")
    assert listing.listing(spark, str(folder), str(index)).count() == 99
    assert listing.listing(spark, f"{folder}/none.zip", str(index)).count() == 0
