"""Readers and writers of tables, judgment files, topics, logs and reports."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text

STRATA = (100, 1000, 10000, 1000000)

#: Bytes of a row group, about. A task that writes holds one, and one that reads holds its columns and a batch of no more rows than it has: long texts cost a task
#: no more memory than short ones.
ROW_GROUP = 4 << 20


def table_path(root: str, corpus: str, table: str) -> str:
    schemas.schema_of(table)
    return f"{root}/{table}/corpus={corpus}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, root: str, corpus: str, table: str) -> DataFrame:
    """A registered table; columns and rows are pruned by the scan."""
    return spark.read.schema(schemas.schema_of(table)).parquet(table_path(root, corpus, table))


def write_table(df: DataFrame, root: str, corpus: str, table: str, order: list[str] | None = None) -> None:
    """Overwrite with conforming rows; ``order`` sorts within files for readable, prunable statistics."""
    out = schemas.conform(df, schemas.schema_of(table))
    rows = out.sortWithinPartitions(*order) if order else out
    rows.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).option("parquet.block.size.row.check.min", 10).parquet(table_path(root, corpus, table))


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table, from its footers: no column is read."""
    return spark.read.parquet(path).select().count()


def graded_judgments(spark: SparkSession, path: str, corpus: str, topics: DataFrame | None = None) -> DataFrame:
    """``topic 0 docno rel`` lines: wanted topics, the largest grade of a repeated document, 0 at least."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(p[0].alias("topic"), p[2].alias("trec_doc_id"), p[3].cast("int").alias("rel"))
    if topics is not None:
        rows = rows.join(topics.select("topic"), "topic", "left_semi")
    best = rows.groupBy("topic", "trec_doc_id").agg(F.greatest(F.lit(0), F.max("rel")).alias("relevance"))
    out = best.select(F.lit(corpus).alias("corpus"), "topic", "trec_doc_id", "relevance", F.lit(None).cast("string").alias("stratum"), F.lit(None).cast("double").alias("sampling_weight"))
    return out


def stratified_lines(spark: SparkSession, path: str) -> DataFrame:
    """topic, trec_doc_id, stratum, rel of ``topic:docid stratum rel`` lines (gz or plain); a bad line raises."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    head = F.split(p[0], ":", 2)
    good = (F.size(p) == 3) & (F.size(head) == 2) & p[1].isin(*map(str, STRATA)) & p[2].isin("-1", "0", "1")
    row = F.struct(head[0].alias("topic"), head[1].alias("trec_doc_id"), p[1].alias("stratum"), p[2].cast("int").alias("rel"))
    bad = F.raise_error(F.concat(F.lit("bad judgment line "), "value")).cast("struct<topic:string,trec_doc_id:string,stratum:string,rel:int>")
    return lines.select(F.when(good, row).otherwise(bad).alias("r")).select("r.*")


def topics(spark: SparkSession, path: str) -> DataFrame:
    """topic, title, request of ``<topic> <n> <title> -- <request>`` lines; the first " -- " splits, a line without raises."""
    line = r"^\s*(\S+)\s+\S+\s+(.*?) -- (.*)\z"
    rows = spark.read.text(path).filter(F.trim("value") != "")
    ok = F.when(F.col("value").rlike(line), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no separator in "), "value")))
    pick = lambda k: F.trim(F.regexp_extract(ok, line, k))
    return rows.select(pick(1).alias("topic"), pick(2).alias("title"), pick(3).alias("request"))


def topics_of_mapping(spark: SparkSession, statements: dict) -> DataFrame:
    """The same from a configuration's mapping of topic to title and request."""
    if not statements:
        raise ValueError("no topic statements")
    rows = [(str(t), s["title"], text_of(s["request"])) for t, s in statements.items()]
    return spark.createDataFrame(rows, "topic string, title string, request string")


def statements(spark: SparkSession, path: str) -> DataFrame:
    """The same from files that each hold such a mapping as JSON, which is YAML too; of any number, read where they lie."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<title:string, request:string>>", {"mode": "FAILFAST"}).alias("m"))
    each = whole.select(F.explode("m").alias("topic", "s"))
    return each.select("topic", F.col("s.title").alias("title"), F.trim(F.regexp_replace("s.request", r"\s+", " ")).alias("request"))


def text_of(value: str) -> str:
    return " ".join(value.split())


def log_path(root: str, corpus: str) -> str:
    """Where a corpus's decisions are logged."""
    return f"{root}/{corpus}_decisions.jsonl"


def read_log(spark: SparkSession, path: str, schema=schemas.DECISIONS) -> DataFrame:
    """JSON lines with a fixed schema, so topics stay strings; a missing path is an empty log."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def append_log(df: DataFrame, path: str, schema=schemas.DECISIONS) -> None:
    schemas.conform(df, schema).write.mode("append").json(path)


def write_audit(df: DataFrame, path: str) -> None:
    """Requests or results, a folder for each batch."""
    df.write.mode("append").partitionBy("batch_id").json(path)


def devset_ids(spark: SparkSession, path: str) -> DataFrame:
    """trec_doc_id of all grades of a sample artifact, distinct."""
    data = spark.read.option("multiLine", True).schema("doc_ids map<string, array<string>>").json(path)
    return data.select(F.explode(F.flatten(F.map_values("doc_ids"))).alias("trec_doc_id")).distinct()


def write_report(report: dict, path: str | Path) -> None:
    """A small artifact of the driver: sorted keys, no timestamps."""
    Path(path).write_text(json.dumps(report, indent=2, sort_keys=True) + "\n")


def append_run(path: str | Path, record: dict) -> None:
    """One line of the run log; of the driver."""
    with open(path, "a") as f:
        f.write(json.dumps(record, sort_keys=True) + "\n")


def directory_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the sorted (path, SHA-256) of a folder's files: contents are hashed where they lie. Empty files are left out, as Spark reads none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = str(path).rstrip("/").rpartition("/")[2]
    lines = files.select(F.concat(F.substring_index("path", f"/{root}/", -1), F.lit(" "), F.sha2("content", 256)).alias("l"))
    digest = hashlib.sha256()
    for i, r in enumerate(lines.orderBy("l").toLocalIterator()):  # one short line a file, a partition at a time
        digest.update((("\n" if i else "") + r["l"]).encode())
    return digest.hexdigest()


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "text")]
