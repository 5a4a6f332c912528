"""Queries that write small archives from the driver's tables and read them back through the sources.

An archive holds the documents of 200 ids, so no task packs more than that.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from email.message import EmailMessage
from xml.sax.saxutils import quoteattr

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas, views
from ..operators import dedup, judgments, review, windows
from ..sources import archives, connector, listing, loadfile, messages, tables
from . import ingest
from .catalogue import query, scratch

PER_ARCHIVE = 200


def _write(spark: SparkSession, df: DataFrame, pack, name: str) -> str:
    """A table of (archive, content), one row for each group of ids; the sources take such rows as well as paths."""
    path = scratch(spark)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"archive": [name.format(key[0])], "content": [pack(pdf.sort_values("n"))]})

    rows = df.withColumn("bucket", F.floor(F.col("n") / PER_ARCHIVE))
    rows.groupBy("bucket").applyInPandas(run, "archive string, content binary").write.parquet(path)
    return path


def _tar(mode: str, row_of):
    def pack(pdf: pd.DataFrame) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode=mode) as t:
            for r in pdf.itertuples():
                name, text = row_of(r)
                info = tarfile.TarInfo(name)
                info.size = len(data := text.encode())
                t.addfile(info, io.BytesIO(data))
        return out.getvalue()

    return pack


def _store(spark: SparkSession, packed: str) -> str:
    """The archives of a table as files, which tasks write; in a store that pyarrow knows."""
    folder = scratch(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = FileSystem.from_uri(folder)
        store.create_dir(at)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_output_stream(f"{at}/{r['archive']}") as out:
                    out.write(r["content"])
            yield batch.select(["archive"])

    spark.read.parquet(packed).select("archive", "content").mapInArrow(run, "archive string").count()
    return folder


@query(
    "src_tgz",
    "SELECT 'part' || (n // 200) || '.tgz/dir/' || lpad(CAST(n AS VARCHAR), 9, '0') AS source_file, custodian AS from_name, subject, subject_norm, body_hash, len(string_split(lang || ';x', ';')) AS n_to FROM mk",
)
def _(s, d):
    path = _write(s, views.messages(s, d), _tar("w:gz", lambda r: (f"dir/{r.n:09d}", f"From:\t{r.custodian} <a@b.c>\nTo:\t{r.lang}; x\nSubject:\t{r.subject}\n\n{r.body_text}")), "part{}.tgz")
    got = messages.tab_texts(archives.tar(s, files=s.read.parquet(path)))
    return got.select("source_file", "from_name", "subject", "subject_norm", "body_hash", F.size("to").cast("long").alias("n_to"))


@query("src_tarbz2", "SELECT '3.' || n || '.' || lang AS trec_doc_id, custodian, subject_norm, substr(body_text, 1, 60000) AS body_text FROM mk WHERE n IN (SELECT doc_id FROM labels)")
def _(s, d):
    """Of all members the judged ones: listed, joined, and only these extracted."""
    row_of = lambda r: (f"./edrm-enron-v2_{r.custodian}_xml/text_000/3.{r.n}.{r.lang}.txt", f"From: a\nSubject: {r.subject}\n\n{r.body_text}")
    files = s.read.parquet(_write(s, views.messages(s, d), _tar("w:bz2", row_of), "part{}.tar.bz2"))
    judged = views.messages(s, d).join(views.table(s, d, "labels").select(F.col("doc_id").alias("l")), F.col("n") == F.col("l"), "left_semi")
    wanted = judged.select(F.concat_ws(".", F.lit("3"), F.col("n").cast("string"), "lang").alias("w"))
    listed = archives.tar(s, files=files, with_content=False).select("archive", "member", F.regexp_replace(F.substring_index("member", "/", -1), r"\.txt\z", "").alias("stem"))
    got = messages.judged_texts(archives.tar(s, files=files, wanted=listed.join(wanted, F.col("stem") == F.col("w"), "left_semi")))
    return got.select(F.get_json_object("headers_json", "$.trec_doc_id").alias("trec_doc_id"), "custodian", "subject_norm", "body_text")


@query("src_tarlist", "SELECT '3.' || n || '.' || lang AS trec_doc_id, custodian FROM m")
def _(s, d):
    row_of = lambda r: (f"./edrm-enron-v2_{r.custodian}_xml/text_000/3.{r.n}.{r.lang}.txt", "x")
    path = _write(s, views.messages(s, d), _tar("w:bz2", row_of), "part{}.tar.bz2")
    return archives.custodian_map(s, files=s.read.parquet(path)).select("trec_doc_id", "custodian")


def _pack_zip(pdf: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        rows = []
        for r in pdf.itertuples():
            tags = f"<Tag TagName='#AttachmentCount' TagValue='{r.n % 3}'/><Tag TagName='#AttachmentNames' TagValue={quoteattr(';'.join(f'f{k}' for k in range(r.n % 3)))}/>"
            native = f"<Files><File FileType='Native'><ExternalFile FilePath='native' FileName='{r.n}.eml'/></File></Files>"
            rows.append(f"<Document DocID='3.{r.n}' DocType='Message'><Tags>{tags}</Tags>{native}</Document>")
            if r.n % 10:  # a tenth of the natives is missing
                m = EmailMessage()
                m["From"], m["To"], m["Subject"], m["Date"] = "A <a@b.c>", "d@e.f", f"Re: {r.n}", "Mon, 8 Jul 2002 09:05:00 -0400"
                m.set_content(f"body of {r.n}\n")
                z.writestr(f"native/{r.n}.eml", m.as_bytes())
        z.writestr("load.xml", f"<Root><Batch><Documents>{''.join(rows)}</Documents></Batch></Root>")
    return out.getvalue()


def _zips(s: SparkSession, d: str) -> messages.Ingested:
    path = _write(s, views.messages(s, d).select("n"), _pack_zip, "edrm-enron-v2_c{}_xml.zip")
    return messages.load_zips(s, files=s.read.parquet(path), partitions=8)


@query("src_zip_eml", "SELECT 'c' || (n // 200) AS custodian, CAST(n AS VARCHAR) AS subject_norm, 'body of ' || n || chr(10) AS body_text, CAST(n % 3 AS INTEGER) AS attachment_count, '2002-07-08 13:05:00' AS sent FROM m WHERE n % 10 <> 0")
def _(s, d):
    got = _zips(s, d).messages
    return got.select("custodian", "subject_norm", "body_text", "attachment_count", F.date_format("date_utc", "yyyy-MM-dd HH:mm:ss").alias("sent"))


@query("src_zip_xml", "SELECT '3.' || n AS docid, 'edrm-enron-v2_c' || (n // 200) || '_xml.zip' AS zip, 'KeyError' AS error FROM m WHERE n % 10 = 0")
def _(s, d):
    return _zips(s, d).failures


_TAB = "'From:' || chr(9) || custodian || ' <a@b.c>' || chr(10) || 'To:' || chr(9) || lang || '; x' || chr(10) || 'Subject:' || chr(9) || subject || chr(10) || chr(10) || body_text"


def _tab_rows(s: SparkSession, d: str) -> DataFrame:
    row_of = lambda r: (f"dir/{r.n:09d}", f"From:\t{r.custodian} <a@b.c>\nTo:\t{r.lang}; x\nSubject:\t{r.subject}\n\n{r.body_text}")
    path = _write(s, views.messages(s, d), _tar("w:gz", row_of), "part{}.tgz")
    return messages.tab_texts(archives.tar(s, files=s.read.parquet(path)))


def _judged_rows(s: SparkSession, d: str, max_body_chars: int | None = messages.MAX_BODY_CHARS) -> DataFrame:
    row_of = lambda r: (f"./edrm-enron-v2_{r.custodian}_xml/text_000/3.{r.n}.{r.lang}.txt", f"From: {r.lang}@x\nTo: a, b; c\nSubject: {r.subject}\n\n{r.body_text}")
    path = _write(s, views.messages(s, d), _tar("w:bz2", row_of), "part{}.tar.bz2")
    return messages.judged_texts(archives.tar(s, files=s.read.parquet(path)), max_body_chars=max_body_chars)


@query(
    "src_format",
    "SELECT 'part' || (n // 200) || '.tgz/dir/' || lpad(CAST(n AS VARCHAR), 9, '0') AS source_file, custodian AS from_name, subject_norm, body_hash FROM mk",
)
def _(s, d):
    """Archives as files, through the data source; conditions that all members meet are pushed into it."""
    row_of = lambda r: (f"dir/{r.n:09d}", f"From:\t{r.custodian} <a@b.c>\nTo:\t{r.lang}; x\nSubject:\t{r.subject}\n\n{r.body_text}")
    folder = _store(s, _write(s, views.messages(s, d), _tar("w:gz", row_of), "part{}.tgz"))
    members = connector.register(s).read.format("archive").load(folder).filter(F.col("archive").endswith(".tgz") & F.col("member").startswith("dir/"))
    return messages.tab_texts(members).select("source_file", "from_name", "subject_norm", "body_hash")


@query("src_listing", "SELECT '3.' || n || '.' || lang AS trec_doc_id, custodian, sha256(body_text) AS body FROM m")
def _(s, d):
    """Plain tars listed into an index and again from it, and all members read by seeking to where it says."""
    row_of = lambda r: (f"./edrm-enron-v2_{r.custodian}_xml/text_000/3.{r.n}.{r.lang}.txt", r.body_text)
    folder, index = _store(s, _write(s, views.messages(s, d), _tar("w", row_of), "part{}.tar")), scratch(s)
    listing.listing(s, folder, index)
    owners = archives.custodian_map(s, folder, index=index)
    texts = listing.contents(listing.listing(s, folder, index)).select(F.regexp_extract("member", r"([^/]*)\.txt\z", 1).alias("id"), F.sha2("content", 256).alias("body"))
    return owners.join(texts, F.col("trec_doc_id") == F.col("id")).select("trec_doc_id", "custodian", "body")


def _pack_broken(pdf: pd.DataFrame) -> bytes:
    """A load file whose entries are broken in three ways for ids that 13 divides."""
    broken = ("<Document DocID='3.{}' DocType='Message'><Tags></Document>", "<Document DocID='3.{}' DocType='Message'><Tags>", "<Document DocID='3.{}' DocType='Message'>&no;</Document>")
    whole = "<Document DocID='3.{0}' DocType='Message'><Tags><Tag TagName='#AttachmentNames' TagValue='f{0}'/></Tags><!-- </Document> --></Document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("load.xml", "<?xml version='1.0'?><Root>" + "\n".join((whole if n % 13 else broken[n // 13 % 3]).format(n) for n in pdf["n"]) + "</Root>")
    return out.getvalue()


@query("src_zip_pull", "SELECT '3.' || n AS docid, CASE WHEN n % 13 = 0 THEN 'ParseError' END AS error, CASE WHEN n % 13 <> 0 THEN 'f' || n END AS names FROM m")
def _(s, d):
    """Entries of load files, each for itself."""
    path = _write(s, views.messages(s, d).select("n"), _pack_broken, "edrm-enron-v2_c{}_xml.zip")
    return loadfile.load_files(s, files=s.read.parquet(path)).select("docid", "error", "names")


@query("hdr_tab", "SELECT custodian AS from_name, 'a@b.c' AS from_addr, lang || '|x' AS recipients, subject, len(body_text) AS n FROM m")
def _(s, d):
    return _tab_rows(s, d).select("from_name", "from_addr", F.array_join("to", "|").alias("recipients"), "subject", F.length("body_text").cast("long").alias("n"))


@query("row_athome", f"SELECT 'bush-' || substr(sha256('part' || (n // 200) || '.tgz/dir/' || lpad(CAST(n AS VARCHAR), 9, '0') || ':0'), 1, 16) AS doc_id, CAST(len({_TAB}) // 4 AS INTEGER) AS token_estimate, body_hash, false AS has_attachments FROM mk")
def _(s, d):
    return _tab_rows(s, d).select("doc_id", "token_estimate", "body_hash", "has_attachments")


@query("hdr_rfc", "SELECT lang || '@x' AS from_addr, 'a|b|c' AS recipients, subject, len(body_text) AS n FROM m")
def _(s, d):
    """Headers, and the length of what follows them: bodies are whole."""
    return _judged_rows(s, d, None).select("from_addr", F.array_join("to", "|").alias("recipients"), "subject", F.length("body_text").cast("long").alias("n"))


@query(
    "row_judged",
    "SELECT 'enron-' || substr(sha256('edrm-enron-v2_' || custodian || '_xml/text_000/3.' || n || '.' || lang || '.txt:0'), 1, 16) AS doc_id, "
    "CAST(len(array_to_string(list_filter([custodian, lang || '@x', 'a; b; c', trim(subject)], lambda x: x <> ''), ' ') || chr(10) || substr(body_text, 1, 60000)) // 4 AS INTEGER) AS token_estimate, "
    "subject_norm, len(body_text) > 60000 AS truncated FROM mn",
)
def _(s, d):
    return _judged_rows(s, d).select("doc_id", "token_estimate", "subject_norm", F.array_contains("parse_warnings", "truncated_body").alias("truncated"))


def _texts(s: SparkSession, d: str, content) -> DataFrame:
    """Members as an archive would give them, one for each document."""
    m = views.messages(s, d)
    return m.select(F.lit("a").alias("archive"), F.concat(F.lit("./edrm-enron-v2_x_xml/text_000/3."), F.col("n").cast("string"), F.lit(".A.txt")).alias("member"), content.alias("content"))


def _number():
    return F.regexp_extract("source_file", r"3\.(\d+)\.A", 1).cast("long").alias("n")


@query("txt_trunc", "SELECT n, sha256(substr(replace(replace(body_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), 1, 500)) AS body, length(replace(body_text, chr(13) || chr(10), chr(10))) > 500 AS cut FROM m")
def _(s, d):
    got = messages.judged_texts(_texts(s, d, F.encode(F.concat(F.lit("From: a\n\n"), "body_text"), "UTF-8")), max_body_chars=500)
    return got.select(_number(), F.sha2("body_text", 256).alias("body"), F.array_contains("parse_warnings", "truncated_body").alias("cut"))


@query(
    "txt_decode",
    """SELECT n, sha256(CASE n % 3 WHEN 0 THEN body_text WHEN 1 THEN chr(8220) || 'q' || n || chr(8221) ELSE chr(143) || n END) AS body,
    CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN 'decode_fallback_cp1252,' ELSE 'decode_fallback_latin1,' END || 'no_header_block' AS warnings FROM m""",
)
def _(s, d):
    """UTF-8, bytes that are cp1252 only, and bytes that only latin-1 knows."""
    number = F.encode(F.col("n").cast("string"), "UTF-8")
    windows_only = F.concat(F.unhex(F.lit("9371")), number, F.unhex(F.lit("94")))
    content = F.when(F.col("n") % 3 == 0, F.encode("body_text", "UTF-8")).when(F.col("n") % 3 == 1, windows_only).otherwise(F.concat(F.unhex(F.lit("8F")), number))
    return messages.tab_texts(_texts(s, d, content)).select(_number(), F.sha2("body_text", 256).alias("body"), F.array_join("parse_warnings", ",").alias("warnings"))


def _judged_report(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The report of judged texts of which every eleventh is missing, cut at 5,000 characters; every third has no header."""
    lines = judgments.weighted(views.judgment_lines(s, d)).select("topic", "trec_doc_id")
    m = views.messages(s, d).filter("n % 11 <> 0")
    name = F.concat(F.lit("./edrm-enron-v2_"), "custodian", F.lit("_xml/text_000/3."), F.col("n").cast("string"), F.lit("."), "lang", F.when(F.col("n") % 5 == 0, ".1").otherwise(""), F.lit(".txt"))
    body = F.concat(F.when(F.col("n") % 3 == 0, "").otherwise("From: a\n\n"), F.lit("="), F.regexp_replace("body_text", "\r", " "))
    rows = m.select(F.lit("a").alias("archive"), name.alias("member"), F.encode(body, "UTF-8").alias("content"))
    return ingest.judged_report(lines.distinct(), messages.judged_texts(rows, max_body_chars=5000))


@query(
    "agg_judgedtext",
    "SELECT topic, count(DISTINCT trec_doc_id) AS judged, count(DISTINCT trec_doc_id) FILTER (n % 11 <> 0) AS found, count(DISTINCT trec_doc_id) FILTER (n % 5 = 0) AS parts FROM w GROUP BY topic",
)
def _(s, d):
    return _judged_report(s, d)[0]


@query(
    "agg_warn",
    """SELECT count(*) FILTER (length(body_text) + 1 > 5000) AS truncated, count(*) FILTER (n % 3 = 0) AS no_header,
    CAST(sum(length(custodian || CASE WHEN n % 3 = 0 THEN '' ELSE ' a' END || chr(10) || substr('=' || body_text, 1, 5000)) // 4) AS BIGINT) AS tokens FROM m WHERE n % 11 <> 0""",
)
def _(s, d):
    return _judged_report(s, d)[1]


@query("agg_anywarn", "SELECT count(*) FILTER (n % 3 = 0 OR n % 5 = 0) AS with_warnings, count(*) AS messages FROM m")
def _(s, d):
    """Messages with any warning: every third has no header, every fifth a date that cannot be read."""
    sent = F.concat(F.lit("Sent:\t"), F.when(F.col("n") % 5 == 0, "some day").otherwise("Monday, July 08, 2002 9:05 AM"), F.lit("\n\n"))
    plain = F.concat(F.lit("="), F.regexp_replace("body_text", "\t", " "))
    got = messages.tab_texts(_texts(s, d, F.encode(F.when((F.col("n") % 3 == 0), plain).otherwise(F.concat(sent, plain)), "UTF-8")))
    return got.agg(F.count_if(F.size("parse_warnings") > 0).alias("with_warnings"), F.count("*").alias("messages"))


@query(
    "join_manifest",
    "SELECT 'edrm-enron-v2_c' || (n // 200) || '_xml.zip/native/' || n || '.eml' AS source_file, CAST(n % 3 AS INTEGER) AS attachment_count, CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN 'f0' ELSE 'f0;f1' END AS names FROM m WHERE n % 10 <> 0",
)
def _(s, d):
    """Load-file entries joined to their native messages."""
    return _zips(s, d).messages.select("source_file", "attachment_count", F.array_join("attachment_names", ";").alias("names"))


@query("eml_parse", "SELECT 'A' AS from_name, 'a@b.c' AS from_addr, 'd@e.f' AS recipients, 'Re: ' || n AS subject, 'body of ' || n || chr(10) AS body_text FROM m WHERE n % 10 <> 0")
def _(s, d):
    return _zips(s, d).messages.select("from_name", "from_addr", F.array_join("to", "|").alias("recipients"), "subject", "body_text")


@query("dt_rfc2822", "SELECT CAST(n AS VARCHAR) AS subject_norm, '2002-07-08 13:05:00' AS sent FROM m WHERE n % 10 <> 0")
def _(s, d):
    return _zips(s, d).messages.select("subject_norm", F.date_format("date_utc", "yyyy-MM-dd HH:mm:ss").alias("sent"))


@query("err_item", "SELECT 'edrm-enron-v2_c' || (n // 200) || '_xml.zip' AS zip, 'KeyError' AS error, count(*) AS n FROM m WHERE n % 10 = 0 GROUP BY ALL")
def _(s, d):
    return _zips(s, d).failures.groupBy("zip", "error").agg(F.count("*").alias("n"))


@query("snk_ledger", "SELECT event_type AS phase, count(*) AS n_requests, round(sum(value), 2) AS cost_usd FROM events GROUP BY event_type", plain=True)
def _(s, d):
    path = scratch(s)
    rows = views.ledger(s, d).groupBy("phase").agg(F.count("*").alias("n_requests"), F.sum("cost_usd").alias("cost_usd"))
    for f in schemas.SPEND:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    tables.append_log(rows.select([f.name for f in schemas.SPEND]), path, schemas.SPEND)
    return tables.read_log(s, path, schemas.SPEND).select("phase", "n_requests", F.round("cost_usd", 2).alias("cost_usd"))


@query("ord_chain", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY custodian ORDER BY date_utc NULLS LAST, doc_id) - 1 AS INTEGER) AS rank FROM m")
def _(s, d):
    m = views.messages(s, d)
    return windows.spread_rank(m, "custodian", F.unix_micros("date_utc"), dedup.age_order()).select("doc_id", "rank")


@query("proto_stem", "SELECT doc_id, CASE WHEN n % 2 = 0 THEN 'athome' ELSE 'topic' END || n AS v FROM m")
def _(s, d):
    corpus = F.when(F.col("n") % 2 == 0, "bush").otherwise("docs")
    return views.messages(s, d).select("doc_id", review.protocol_stems(corpus, F.col("n").cast("string")).alias("v"))
