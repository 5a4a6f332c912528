"""Ingest runs: archives to ``messages`` and ``doc_id_map``, with reports and gates."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import checks
from ..operators.judgments import coverage
from ..session import cut
from ..sources import archives, tables
from ..sources import messages as src

FAILURE_GATE = 0.01
#: Items that the report repeats of the table ``failures``, which has all.
FIRST_FAILURES = 1000


def tab_texts(spark: SparkSession, root: str, archive: str, corpus: str, report_path: str | Path, expected: int | None = None, qrels: DataFrame | None = None, partitions: int = 64) -> int:
    """A tar of numbered text exports. Member names must be unique and end in digits; the count must be as expected."""
    # the archive is read and parsed once; checks and the table take what came of it
    rows = cut(src.tab_texts(archives.spread(archives.tar(spark, archive), partitions), corpus))
    named = rows.select(F.regexp_extract(F.substring_index("source_file", "/", -1), r"^(\d+)(?:\.txt)?\z", 1).alias("docno"))
    if named.filter("docno = ''").limit(1).count():
        raise checks.CheckError("a member's name is no number")
    checks.unique(named, "docno")
    n = checks.expected_count(named, expected)
    tables.write_table(rows, root, corpus, "messages", ["doc_id"])
    kept = tables.read_table(spark, root, corpus, "messages")
    idmap = src.id_map(kept, F.regexp_extract("source_file", r"(\d+)(?:\.txt)?\z", 1), corpus)
    tables.write_table(idmap, root, corpus, "doc_id_map", ["trec_doc_id"])
    report = {"messages": n, "with_warnings": kept.filter(F.size("parse_warnings") > 0).count()}
    ok = True
    if qrels is not None:
        got = coverage(qrels, tables.read_table(spark, root, corpus, "doc_id_map")).collect()
        report["coverage"] = {r["topic"] or "all": r["coverage"] for r in got}
        ok = report["coverage"]["all"] == 1.0
    tables.write_report(report, report_path)
    return checks.gate(ok, json.dumps(report))


def load_zips(spark: SparkSession, root: str, path: str, corpus: str, report_path: str | Path, partitions: int = 64) -> int:
    """Zips of load files with native messages; all failures become the table ``failures``, of which the report names the first; fails its gate at a failure rate of ``FAILURE_GATE`` and more."""
    got = src.load_zips(spark, path, corpus, partitions)
    tables.write_table(got.messages, root, corpus, "messages", ["doc_id"])
    kept = tables.read_table(spark, root, corpus, "messages")
    checks.unique(kept.select("doc_id"), "doc_id")
    docid = F.regexp_replace(F.substring_index("source_file", "/", -1), r"\.eml\z", "")
    tables.write_table(src.id_map(kept, docid, corpus), root, corpus, "doc_id_map", ["trec_doc_id"])
    tables.write_table(got.failures, root, corpus, "failures", ["zip", "docid"])
    lost = tables.read_table(spark, root, corpus, "failures")
    rate = checks.failure_rate(kept, lost).first()
    by = {r["custodian"]: r["count"] for r in kept.groupBy("custodian").count().collect()}
    items = [r.asDict() for r in lost.orderBy("zip", "docid").limit(FIRST_FAILURES).collect()]
    report = {"parsed": rate["parsed"], "failed": rate["failed"], "failure_rate": rate["rate"], "per_custodian": by, "first_failures": items, "failures": tables.table_path(root, corpus, "failures")}
    tables.write_report(report, report_path)
    return checks.gate(rate["rate"] < FAILURE_GATE, json.dumps(report))


def judged_texts(spark: SparkSession, root: str, archive: str, corpus: str, judged: DataFrame, report_path: str | Path, max_body_chars: int = src.MAX_BODY_CHARS) -> int:
    """Texts of judged documents from a tar: paths are listed and joined, then the wanted members are extracted; missing ones fail the gate."""
    wanted = judged.select("topic", "trec_doc_id").distinct()
    listed = archives.tar(spark, archive, with_content=False).select("archive", "member", text.member_parts("member").alias("m")).filter("m is not null")
    chosen = cut(listed.join(wanted.select(F.col("trec_doc_id").alias("__w")).distinct(), F.col("m.docid") == F.col("__w"), "left_semi"))
    checks.unique(chosen.select(F.col("m.docid").alias("docid")), "docid")
    members = archives.tar(spark, archive, chosen.select("archive", "member"))
    tables.write_table(src.judged_texts(members, corpus, max_body_chars), root, corpus, "judged_messages", ["doc_id"])
    kept = tables.read_table(spark, root, corpus, "judged_messages")
    tables.write_table(src.id_map(kept, F.get_json_object("headers_json", "$.trec_doc_id"), corpus), root, corpus, "judged_doc_id_map", ["trec_doc_id"])
    per, sums = judged_report(wanted, kept)
    topics = {r["topic"]: {k: r[k] for k in ("judged", "found", "parts")} for r in per.collect()}
    report = {"topics": topics, **sums.first().asDict()}
    tables.write_report(report, report_path)
    return checks.gate(all(t["judged"] == t["found"] for t in topics.values()), json.dumps(report))


def judged_report(wanted: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topic, judged, found, parts) of ``wanted(topic, trec_doc_id)``, and (truncated, no_header, tokens) of the messages."""
    have = kept.select(F.get_json_object("headers_json", "$.trec_doc_id").alias("__f")).distinct()
    found = wanted.join(have, F.col("trec_doc_id") == F.col("__f"), "left")
    per = found.groupBy("topic").agg(F.count("*").alias("judged"), F.count("__f").alias("found"), F.count_if(text.is_part("trec_doc_id")).alias("parts"))
    has = lambda w: F.count_if(F.array_contains("parse_warnings", w))
    return per, kept.agg(has("truncated_body").alias("truncated"), has("no_header_block").alias("no_header"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("tokens"))
