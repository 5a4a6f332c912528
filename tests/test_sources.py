import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from docketry import schemas
from docketry.operators import checks
from docketry.plans import ingest
from docketry.sources import archives, messages, tables


def make_tar(path, members, mode):
    with tarfile.open(path, mode) as t:
        d = tarfile.TarInfo("dir")
        d.type = tarfile.DIRTYPE
        t.addfile(d)
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return str(path)


DOC = b"From:\tAnn B <a@b.c>\nSent:\tMonday, July 08, 2002 9:05 AM\nTo:\tx; y\nSubject:\tRE: Plan\nAttachments:\ta.doc; b.xls\n\nHello  \n\n"


def test_tab_text_archive(spark, tmp_path):
    path = make_tar(tmp_path / "s.tgz", [("dir/000002", b"just text"), ("dir/000001", DOC)], "w:gz")
    assert ingest.tab_texts(spark, str(tmp_path / "store"), path, "bush", tmp_path / "r.json", expected=2) == 0
    rows = {r["source_file"]: r for r in tables.read_table(spark, str(tmp_path / "store"), "bush", "messages").collect()}
    a, b = rows["s.tgz/dir/000001"], rows["s.tgz/dir/000002"]
    assert (a["from_name"], a["from_addr"], a["to"], a["subject_norm"], a["attachment_names"], a["attachment_count"]) == ("Ann B", "a@b.c", ["x", "y"], "plan", ["a.doc", "b.xls"], 2)
    assert str(a["date_utc"]) == "2002-07-08 13:05:00" and a["body_text"] == "Hello  \n\n" and a["body_norm"] == "Hello" and a["token_estimate"] == len(DOC) // 4
    assert b["parse_warnings"] == ["no_header_block"] and b["date_utc"] is None and b["to"] == []
    assert tables.read_table(spark, str(tmp_path / "store"), "bush", "doc_id_map").filter("trec_doc_id = '000001'").count() == 1
    with pytest.raises(checks.CheckError):
        ingest.tab_texts(spark, str(tmp_path / "store"), path, "bush", tmp_path / "r.json", expected=3)
    odd = make_tar(tmp_path / "o.tgz", [("dir/abc", b"x")], "w:gz")
    with pytest.raises(checks.CheckError):
        ingest.tab_texts(spark, str(tmp_path / "store"), odd, "bush", tmp_path / "r.json")
    twice = make_tar(tmp_path / "t.tgz", [("a/1", b"x"), ("b/1", b"y")], "w:gz")
    with pytest.raises(checks.CheckError):
        ingest.tab_texts(spark, str(tmp_path / "store"), twice, "bush", tmp_path / "r.json")


def test_judged_texts(spark, tmp_path):
    top = "./edrm-enron-v2_jones-p_xml/text_000"
    members = [(f"{top}/3.1.A.txt", b"From: a\nTo: x, y; z\nSubject: s\n\nbody"), (f"{top}/3.1.A.1.txt", b"part " * 20), (f"{top}/3.9.Z.txt", b"unjudged"), ("x/y/z.xml", b"")]
    path = make_tar(tmp_path / "t.tar.bz2", members, "w:bz2")
    judged = spark.createDataFrame([("201", "3.1.A"), ("201", "3.1.A.1"), ("202", "3.1.A")], "topic string, trec_doc_id string")
    store, report = str(tmp_path / "store"), tmp_path / "r.json"
    assert ingest.judged_texts(spark, store, path, "enron", judged, report, max_body_chars=30) == 0
    rows = {json.loads(r["headers_json"])["trec_doc_id"]: r for r in tables.read_table(spark, store, "enron", "judged_messages").collect()}
    assert set(rows) == {"3.1.A", "3.1.A.1"} and rows["3.1.A"]["to"] == ["x", "y", "z"] and rows["3.1.A"]["custodian"] == "jones-p"
    assert rows["3.1.A.1"]["parse_warnings"] == ["no_header_block", "truncated_body"] and len(rows["3.1.A.1"]["body_text"]) == 30
    assert rows["3.1.A"]["token_estimate"] == len("jones-p a x; y; z s\nbody") // 4
    got = json.loads(report.read_text())
    assert got["topics"]["201"] == {"judged": 2, "found": 2, "parts": 1} and got["truncated"] == 1
    more = judged.union(spark.createDataFrame([("201", "3.7.Q")], judged.schema))
    assert ingest.judged_texts(spark, store, path, "enron", more, report) == 1
    assert archives.custodian_map(spark, path).filter("custodian = 'jones-p'").count() == 3


def manifest(docs):
    body = "".join(
        f"<Document DocType='{kind}'{f' DocID={chr(39)}{i}{chr(39)}' if i else ''}><Tags>{''.join(f'<Tag TagName={chr(39)}{k}{chr(39)} TagValue={chr(39)}{v}{chr(39)}/>' for k, v in tags)}</Tags>"
        f"<Files><File FileType='Text'><ExternalFile FilePath='t' FileName='{i}.txt'/></File><File FileType='Native'><ExternalFile FilePath='n' FileName='{i}.eml'/></File></Files>"
        "<Locations><Location><Custodian>Someone</Custodian></Location></Locations></Document>"
        for kind, i, tags in docs
    )
    return f"<Root><Batch><Documents>{body}</Documents></Batch></Root>".encode()


def test_load_zips(spark, tmp_path):
    docs = [
        ("Message", "3.1.A", [("#AttachmentCount", "2"), ("#AttachmentNames", "a.doc;b.doc"), ("#HasAttachments", "true")]),
        ("Message", "3.2.B", []), ("Message", "", []), ("Message", "3.3.C", [("#AttachmentCount", "many")]), ("File", "3.1.A.1", []),
    ]
    with zipfile.ZipFile(tmp_path / "edrm-enron-v2_jones-p_xml.zip", "w") as z:
        z.writestr("load.xml", manifest(docs))
        z.writestr("n/3.1.A.eml", b"From: Ann <a@b.c>\r\nTo: d@e.f\r\nDate: Mon, 8 Jul 2002 09:05:00 +0000\r\nSubject: Fwd: x\r\n\r\nhello\r\n")
    got = messages.load_zips(spark, str(tmp_path / "*.zip"), partitions=2)
    row = got.messages.collect()
    assert len(row) == 1 and row[0]["attachment_names"] == ["a.doc", "b.doc"] and row[0]["custodian"] == "jones-p" and row[0]["subject_norm"] == "x"
    assert row[0]["source_file"] == "edrm-enron-v2_jones-p_xml.zip/n/3.1.A.eml" and row[0]["has_attachments"]
    assert {(r["docid"] or "", r["error"]) for r in got.failures.collect()} == {("3.2.B", "KeyError"), ("", "manifest_missing_docid"), ("3.3.C", "manifest_bad_attachment_count")}
    assert ingest.load_zips(spark, str(tmp_path / "store"), str(tmp_path / "*.zip"), "enron", tmp_path / "r.json") == 1  # 3 of 4 failed


def test_load_zips_writes_all_failures(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "edrm-enron-v2_jones-p_xml.zip", "w") as z:
        z.writestr("load.xml", manifest([("Message", f"3.{k}.A", []) for k in range(1_003)]))
    store = str(tmp_path / "store")
    assert ingest.load_zips(spark, store, str(tmp_path / "*.zip"), "enron", tmp_path / "r.json") == 1
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["failed"] == 1_003 and len(report["first_failures"]) == 1_000
    rows = {tuple(r) for r in spark.read.parquet(report["failures"]).select("docid", "zip", "error").collect()}
    assert rows == {(f"3.{k}.A", "edrm-enron-v2_jones-p_xml.zip", "KeyError") for k in range(1_003)}


def test_judgments_files(spark, tmp_path):
    g = tmp_path / "g.txt"
    g.write_text("401 0 a 1\n401 0 a 2\n402 0 b -1\n403 0 c 1\n")
    topics = spark.createDataFrame([("401",), ("402",)], "topic string")
    assert {tuple(r) for r in tables.graded_judgments(spark, str(g), "bush", topics).select("topic", "trec_doc_id", "relevance").collect()} == {("401", "a", 2), ("402", "b", 0)}
    s = tmp_path / "s.gz"
    s.write_bytes(gzip.compress(b"201:3.1.A 100 1\n201:3.2.B.1 1000 -1\n"))
    assert {tuple(r) for r in tables.stratified_lines(spark, str(s)).collect()} == {("201", "3.1.A", "100", 1), ("201", "3.2.B.1", "1000", -1)}
    for bad in (b"201:a 100\n", b"201:a 7 1\n", b"201:a 100 5\n", b"201 100 1\n"):
        s.write_bytes(gzip.compress(bad))
        with pytest.raises(Exception, match="bad judgment line"):
            tables.stratified_lines(spark, str(s)).collect()
    t = tmp_path / "t.txt"
    t.write_text("401 5  Some title -- the request -- with more\n")
    assert tuple(tables.topics(spark, str(t)).first()) == ("401", "Some title", "the request -- with more")


def test_schemas(spark, tmp_path):
    df = spark.createDataFrame([("a", "t", "x")], "corpus string, topic string, trec_doc_id string")
    with pytest.raises(ValueError, match="missing"):
        schemas.conform(df, schemas.QRELS_RAW)
    with pytest.raises(KeyError):
        tables.table_path("r", "c", "nothing")
    full = df.withColumns({"relevance": F.lit("no"), "stratum": F.lit("s"), "sampling_weight": F.lit(1.0)})
    with pytest.raises(Exception):
        schemas.conform(full, schemas.QRELS_RAW).collect()
    assert tables.read_log(spark, str(tmp_path / "missing")).count() == 0
    tables.write_report({"b": 1, "a": 2}, tmp_path / "x.json")
    assert (tmp_path / "x.json").read_text().index('"a"') < (tmp_path / "x.json").read_text().index('"b"')
    assert len(tables.directory_digest(spark, str(tmp_path))) == 64


def test_statements(spark, tmp_path):
    """Mappings of topics, each a file; a file that is none raises."""
    (tmp_path / "a.json").write_text(json.dumps({"7": {"title": "seven", "request": "all\n of  it "}, "8": {"title": "eight", "request": "the rest"}}))
    (tmp_path / "b.json").write_text('{\n  "9": {"title": "nine", "request": "x"}\n}\n')
    want = {("7", "seven", "all of it"), ("8", "eight", "the rest"), ("9", "nine", "x")}
    assert {tuple(r) for r in tables.statements(spark, str(tmp_path / "*.json")).collect()} == want
    (tmp_path / "c.json").write_text("[1, 2")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        tables.statements(spark, str(tmp_path / "*.json")).collect()


def test_run_log_and_log_path(spark, tmp_path):
    runs = tmp_path / "runs.jsonl"
    for code in (0, 2):
        tables.append_run(runs, {"ts": "t", "command": "query", "argv": ["a", str(code)], "exit_code": code})
    got = spark.read.schema(schemas.RUNS).json(str(runs)).orderBy("exit_code").collect()
    assert [(r["exit_code"], r["argv"]) for r in got] == [(0, ["a", "0"]), (2, ["a", "2"])]
    assert tables.log_path("/r", "bush") == "/r/bush_decisions.jsonl"


def test_directory_digest_is_of_sorted_lines(spark, tmp_path):
    import hashlib

    files = {"b/x.txt": b"1", "a/y.txt": b"2", "a/b.txt": b"3"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    lines = sorted(f"{n} {hashlib.sha256(c).hexdigest()}" for n, c in files.items())
    assert tables.directory_digest(spark, str(tmp_path)) == hashlib.sha256("\n".join(lines).encode()).hexdigest()
