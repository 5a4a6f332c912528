"""Sources of ``messages`` rows: tab-header text exports, judged texts, and load-file zips with native messages.

Python parses the formats in Arrow batches; normalisation, hashes, ids and token estimates are built-in expressions on
what it returns. Records that fail become rows of ``failures`` with a static code, never with text of the record.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, mail, text
from ..schemas import MESSAGES, conform
from ..session import cut
from . import archives, loadfile

MAX_BODY_CHARS = 60_000


def _python(members: DataFrame, parse: Callable[[dict], dict], columns: dict[str, pa.DataType], ddl: str) -> DataFrame:
    """``parse`` over each row of an Arrow batch."""
    schema = pa.schema(list(columns.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([parse(r) for r in batch.to_pylist()], schema=schema)

    return members.mapInArrow(run, ddl)


_STRINGS = pa.list_(pa.string())


def _finish(df: DataFrame, corpus: str, basis: Column) -> DataFrame:
    """Add what built-ins derive, and conform to the table."""
    df = df.withColumn("corpus", F.lit(corpus)).withColumn("source_index", F.lit(0))
    df = df.withColumn("doc_id", text.doc_id("corpus", "source_file", "source_index"))
    df = df.withColumn("subject_norm", text.subject_norm("subject")).withColumn("body_norm", text.body_norm("body_text"))
    df = df.withColumn("body_hash", text.body_hash("body_norm")).withColumn("token_estimate", text.token_estimate(basis))
    for f in MESSAGES:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType) if f.dataType.typeName() != "array" else F.array().cast(f.dataType))
    return conform(df.select([f.name for f in MESSAGES]), MESSAGES)


def _rendered(*parts: Column, body: Column) -> Column:
    """The filled metadata fields in one line, then the body: what a request carries."""
    filled = F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: x != "")
    return F.concat(F.array_join(filled, " "), F.lit("\n"), body)


def tab_texts(members: DataFrame, corpus: str = "bush") -> DataFrame:
    """``messages`` of text exports in archives: ``members(archive, member, content)``."""

    def parse(row: dict) -> dict:
        whole, charset = mail.decode(row["content"])
        headers, body, warn = mail.tab_headers(whole)
        warn = ([f"decode_fallback_{charset.replace('-', '')}"] if charset else []) + warn
        return {
            "source_file": f"{row['archive']}/{row['member']}", "whole": whole, "body_text": body, "from_raw": headers.get("From"),
            "to_raw": headers.get("To"), "cc_raw": headers.get("Cc"), "bcc_raw": headers.get("Bcc"), "subject": headers.get("Subject"),
            "date_raw": headers.get("Sent") or headers.get("Date"), "att_raw": headers.get("Attachments"),
            "headers_json": json.dumps(headers, sort_keys=True), "warn": warn,
        }

    names = ["source_file", "whole", "body_text", "from_raw", "to_raw", "cc_raw", "bcc_raw", "subject", "date_raw", "att_raw", "headers_json"]
    ddl = ", ".join(f"{n} string" for n in names) + ", warn array<string>"
    df = _python(members, parse, {n: pa.string() for n in names} | {"warn": _STRINGS}, ddl)
    df = df.withColumn("date_utc", dates.sent_utc("date_raw"))
    lost = F.col("date_raw").isNotNull() & (F.col("date_raw") != "") & F.col("date_utc").isNull()
    df = df.withColumn("sender", F.when(F.col("from_raw").isNotNull(), text.sender("from_raw")))
    df = df.select(
        "*", F.col("sender.name").alias("from_name"), F.col("sender.addr").alias("from_addr"),
        *(text.split_list(f"{c}_raw").alias(c) for c in ("to", "cc", "bcc")), text.split_list("att_raw").alias("attachment_names"),
        F.when(lost, F.array_append("warn", F.lit("date_unparsed"))).otherwise(F.col("warn")).alias("parse_warnings"),
    )
    df = df.withColumn("attachment_count", F.size("attachment_names")).withColumn("has_attachments", F.size("attachment_names") > 0)
    return _finish(df, corpus, F.col("whole"))


def judged_texts(members: DataFrame, corpus: str = "enron", max_body_chars: int | None = MAX_BODY_CHARS) -> DataFrame:
    """``messages`` of judged texts: paths of depth three, colon headers, bodies cut at ``max_body_chars`` with a warning (None: whole)."""

    def parse(row: dict) -> dict:
        whole, charset = mail.decode(row["content"], ("utf-8", "latin-1"))
        headers, body = mail.colon_headers(whole)
        warn = ["latin1_fallback"] * bool(charset) + ["no_header_block"] * (not headers)
        cut = max_body_chars is not None and len(body) > max_body_chars
        return {
            "body_text": body[:max_body_chars], "from_addr": headers.get("from"), "to_raw": headers.get("to"), "cc_raw": headers.get("cc"),
            "bcc_raw": headers.get("bcc"), "subject": headers.get("subject"), "date_raw": headers.get("date") or headers.get("sent"),
            "path": row["path"], "custodian": row["custodian"], "docid": row["docid"], "parse_warnings": warn + ["truncated_body"] * cut,
        }

    names = ["body_text", "from_addr", "to_raw", "cc_raw", "bcc_raw", "subject", "date_raw", "path", "custodian", "docid"]
    ddl = ", ".join(f"{n} string" for n in names) + ", parse_warnings array<string>"
    named = members.select(text.member_parts("member").alias("m"), "content").filter("m is not null").select("m.*", "content")
    df = _python(named, parse, {n: pa.string() for n in names} | {"parse_warnings": _STRINGS}, ddl)
    df = df.select("*", F.col("path").alias("source_file"), *(text.split_list(f"{c}_raw", ";,").alias(c) for c in ("to", "cc", "bcc")))
    part = text.is_part("docid")
    about = F.create_map(F.lit("trec_doc_id"), F.col("docid"), F.lit("is_part"), part.cast("string"), F.lit("parent_trec_doc_id"), F.when(part, text.parent_doc("docid")))
    df = df.withColumn("headers_json", text.headers_json(about)).withColumns({"has_attachments": F.lit(False), "attachment_count": F.lit(0)})
    joined = [F.array_join(c, "; ") for c in ("to", "cc")]
    basis = _rendered(F.col("custodian"), F.col("from_addr"), *joined, F.col("date_raw"), F.col("subject"), body=F.col("body_text"))
    return _finish(df, corpus, basis)


@dataclass
class Ingested:
    messages: DataFrame
    failures: DataFrame  # docid, zip, error


def load_zips(spark: SparkSession, path: str | None = None, corpus: str = "enron", partitions: int = 64, files: DataFrame | None = None) -> Ingested:
    """``messages`` of zips that hold XML load files at their root and native messages; bad entries are itemised."""
    listed = cut(loadfile.load_files(spark, path, files))  # parsed once
    number = F.expr("try_cast(coalesce(nullif(trim(count), ''), '0') as int)")
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce("docid", F.lit("")) == "", "manifest_missing_docid").when(number.isNull(), "manifest_bad_attachment_count")
    listed = listed.withColumn("attachment_count", number).withColumn("error", error)
    good = listed.filter("error is null").drop("error")
    natives = archives.spread(archives.zip_members(spark, path, (".eml",), files=files), partitions)
    joined = good.join(natives, (F.col("zip") == F.col("archive")) & (F.col("native") == F.col("member")), "left")
    lost = joined.filter("content is null").select("docid", "zip", F.lit("KeyError").alias("error"))
    bad = listed.filter("error is not null").select("docid", "zip", "error")
    kinds = {
        "message_id_hdr": pa.string(), "in_reply_to": pa.string(), "references": _STRINGS, "from_addr": pa.string(), "from_name": pa.string(),
        "to": _STRINGS, "cc": _STRINGS, "bcc": _STRINGS, "subject": pa.string(), "date_utc": pa.timestamp("us", "UTC"), "date_raw": pa.string(),
        "body_text": pa.string(), "headers_json": pa.string(), "parse_warnings": _STRINGS, "docid": pa.string(), "zip": pa.string(), "native": pa.string(),
        "attachment_count": pa.int32(), "attachment_names": _STRINGS, "has_attachments": pa.bool_(), "error": pa.string(),
    }
    words = {pa.string(): "string", _STRINGS: "array<string>", pa.timestamp("us", "UTC"): "timestamp", pa.int32(): "int", pa.bool_(): "boolean"}

    def parse(row: dict) -> dict:
        own = {k: row[k] for k in ("docid", "zip", "native", "attachment_count", "has_attachments")}
        own["attachment_names"] = [n for n in (row["names"] or "").split(";") if n]
        try:
            return mail.parse_eml(row["content"]) | own
        except Exception as e:  # noqa: BLE001  one bad message must not end the run; its class is its code
            return own | {"error": type(e).__name__}

    sent = joined.filter("content is not null").select("docid", "zip", "native", "attachment_count", "has_attachments", "names", "content")
    df = cut(_python(sent, parse, kinds, ", ".join(f"`{k}` {words[v]}" for k, v in kinds.items())))  # parsed once, for rows and failures
    broken = df.filter("error is not null").select("docid", "zip", "error")
    df = df.filter("error is null").withColumn("custodian", text.zip_custodian("zip")).withColumn("source_file", F.concat_ws("/", "zip", "native"))
    joined_lists = [F.array_join(c, "; ") for c in ("to", "cc")]
    basis = _rendered(
        F.col("custodian"), F.col("from_addr"), *joined_lists, F.col("date_raw"), F.col("subject"), F.array_join("attachment_names", "; "), body=F.col("body_text")
    )
    return Ingested(_finish(df, corpus, basis), reduce(DataFrame.unionByName, [bad, lost, broken]))


def id_map(messages: DataFrame, trec_doc_id: Column, corpus: str) -> DataFrame:
    """``doc_id_map`` by file name, confidence 1, unambiguous."""
    return messages.select(
        F.lit(corpus).alias("corpus"), "doc_id", trec_doc_id.alias("trec_doc_id"), F.lit("filename").alias("match_method"),
        F.lit(1.0).alias("confidence"), F.lit(False).alias("ambiguous"),
    )
