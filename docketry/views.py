"""Message-shaped views over the driver's tables, for queries; ``SQL`` states the same views independently for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .session import spread

TOPICS = ("quality", "toxic")
VERSION = "topic.v1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("n"),
        F.concat(F.lit("docs-"), F.substring(F.sha2(F.concat_ws(":", "source", F.col("doc_id").cast("string")), 256), 1, 16)).alias("doc_id"),
        F.col("source").alias("custodian"),
        "lang",
        F.concat(F.when(F.col("doc_id") % 2 == 1, "Re: ").otherwise(""), F.substring_index("text", "\n", 1)).alias("subject"),
        F.col("text").alias("body_text"),
        F.when(F.col("doc_id") % 17 != 0, F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("doc_id") * 7919, F.lit(720)) * 3600)).alias("date_utc"),
        "n_chars",
    )


def normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(messages(spark, sf_dir)).withColumns({"subject_norm": tx.subject_norm("subject"), "body_norm": tx.body_norm("body_text")})


def thread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("prev", F.lag("text").over(w))
    name = F.concat(F.lit("c-"), F.lpad(F.col("conv_id").cast("string"), 7, "0"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 3, "0"))
    quoted = F.concat("text", F.lit("\n> "), F.regexp_replace("prev", "\n", "\n> "))
    has = (F.col("turn") % 4 == 1) | ((F.col("turn") == 0) & (F.col("conv_id") % 2 == 1))
    return c.select(
        name.alias("doc_id"),
        F.when(F.col("conv_id") % 20 == 0, "").otherwise(F.concat(F.lit("conv "), F.col("conv_id").cast("string"))).alias("subject_norm"),
        F.when((F.col("turn") % 3 == 1) & F.col("prev").isNotNull(), quoted).otherwise(F.col("text")).alias("body_norm"),
        F.when(F.col("conv_id") % 17 != 3, F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * F.col("turn") * 864000)).alias("date_utc"),
        F.when(has, F.array(F.concat(F.lit("f"), F.col("turn").cast("string")))).otherwise(F.array().cast("array<string>")).alias("attachment_names"),
    )


def _trec() -> Column:
    return F.concat(F.lit("3."), F.col("n").cast("string"), F.lit("."), F.col("lang"))


def judgment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, trec_doc_id, stratum, rel; -1 where a document has no label. A fifth of the ids are parts."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), "lang")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"), *TOPICS)
    j = d.join(lab, F.col("n") == F.col("l"), "left")
    stratum = F.element_at(F.create_map(*[F.lit(x) for kv in (("en", "100"), ("de", "1000"), ("fr", "10000"), ("es", "1000000")) for x in kv]), F.col("lang"))
    doc = F.when(F.col("n") % 5 == 0, F.concat(_trec(), F.lit(".1"))).otherwise(_trec())
    both = F.explode(F.array(*[F.struct(F.lit(t).alias("topic"), F.coalesce(t, F.lit(-1)).cast("int").alias("rel")) for t in TOPICS])).alias("x")
    return j.select("n", doc.alias("trec_doc_id"), stratum.alias("stratum"), both).select("x.topic", "trec_doc_id", "stratum", "x.rel", "n")


def id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    rows = m.filter("n % 11 <> 0").select("doc_id", F.col("n"), F.explode(F.when(F.col("n") % 10 == 0, F.array(_trec(), F.concat(_trec(), F.lit(".1")))).otherwise(F.array(_trec()))).alias("trec_doc_id"))
    return rows.select(F.lit("docs").alias("corpus"), "doc_id", "trec_doc_id", F.lit("filename").alias("match_method"), F.lit(1.0).alias("confidence"), (F.col("n") % 50 == 0).alias("ambiguous"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier 1 for every document and topic; tier 2 replaces the borderlines of even documents."""
    m = messages(spark, sf_dir).select("n", "doc_id", "n_chars", F.explode(F.array(*map(F.lit, TOPICS))).alias("topic"))
    line = (F.col("n_chars") % 7 == 0) & (F.col("n") % 2 == 0)
    one = F.when(F.col("n_chars") % 7 == 0, "borderline").when(F.col("n_chars") % 3 == 0, "not_responsive").otherwise("responsive")
    two = F.when(F.col("n_chars") % 2 == 0, "responsive").otherwise("not_responsive")
    first_id, second_id = (F.concat(F.lit(f"d{k}-"), F.col("topic"), F.lit("-"), F.col("n").cast("string")) for k in (1, 2))
    kind = "struct<tier:int,decision:string,decision_id:string,supersedes:string>"
    first = F.struct(F.lit(1).alias("tier"), one.alias("decision"), first_id.alias("decision_id"), F.lit(None).alias("supersedes")).cast(kind)
    second = F.struct(F.lit(2).alias("tier"), two.alias("decision"), second_id.alias("decision_id"), first_id.alias("supersedes")).cast(kind)
    rows = m.select("n", "doc_id", "topic", F.explode(F.when(line, F.array(first, second)).otherwise(F.array(first))).alias("x"))
    return rows.select("n", "doc_id", "topic", "x.*", F.lit("responsiveness").alias("phase"), F.lit(VERSION).alias("prompt_version"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("phase"), F.col("value").alias("cost_usd"))


SQL = r"""
WITH m AS (
  SELECT doc_id AS n, 'docs-' || substr(sha256(source || ':' || CAST(doc_id AS VARCHAR)), 1, 16) AS doc_id, source AS custodian, lang,
         CASE WHEN doc_id % 2 = 1 THEN 'Re: ' ELSE '' END || split_part(text, chr(10), 1) AS subject, text AS body_text,
         CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST((doc_id * 7919) % 720 AS INTEGER)) END AS date_utc, n_chars
  FROM documents),
mn AS (
  SELECT *, lower(trim(regexp_replace(regexp_replace(subject, '^(?i:(\s*(re|fwd|fw)\s*:\s*)+)', ''), '\s+', ' ', 'g'))) AS subject_norm,
         trim(regexp_replace(replace(replace(body_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+(\n|$)', '\1', 'g'), chr(10)) AS body_norm
  FROM m),
mk AS (SELECT *, sha256(body_norm) AS body_hash, sha256(coalesce(subject_norm, '') || chr(0) || body_norm) AS dedup_key FROM mn),
tm AS (
  SELECT 'c-' || lpad(CAST(conv_id AS VARCHAR), 7, '0') || '-' || lpad(CAST(turn AS VARCHAR), 3, '0') AS doc_id,
         CASE WHEN conv_id % 20 = 0 THEN '' ELSE 'conv ' || conv_id END AS subject_norm,
         CASE WHEN turn % 3 = 1 AND prev IS NOT NULL THEN text || chr(10) || '> ' || replace(prev, chr(10), chr(10) || '> ') ELSE text END AS body_norm,
         CASE WHEN conv_id % 17 <> 3 THEN TIMESTAMP '2024-01-01' + to_days(CAST(10 * turn * turn AS INTEGER)) END AS date_utc,
         CASE WHEN turn % 4 = 1 OR (turn = 0 AND conv_id % 2 = 1) THEN ['f' || turn] ELSE CAST([] AS VARCHAR[]) END AS attachment_names
  FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)),
t2 AS (SELECT unnest(['quality', 'toxic']) AS topic),
q AS (
  SELECT topic, '3.' || d.doc_id || '.' || lang || CASE WHEN d.doc_id % 5 = 0 THEN '.1' ELSE '' END AS trec_doc_id,
         CASE lang WHEN 'en' THEN '100' WHEN 'de' THEN '1000' WHEN 'fr' THEN '10000' WHEN 'es' THEN '1000000' END AS stratum,
         coalesce(CASE topic WHEN 'quality' THEN quality ELSE toxic END, -1) AS rel, d.doc_id AS n
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id CROSS JOIN t2),
im AS (
  SELECT doc_id, n, unnest(CASE WHEN n % 10 = 0 THEN ['3.' || n || '.' || lang, '3.' || n || '.' || lang || '.1'] ELSE ['3.' || n || '.' || lang] END) AS trec_doc_id,
         n % 50 = 0 AS ambiguous
  FROM m WHERE n % 11 <> 0),
dec AS (
  SELECT n, doc_id, topic, 1 AS tier, CASE WHEN n_chars % 7 = 0 THEN 'borderline' WHEN n_chars % 3 = 0 THEN 'not_responsive' ELSE 'responsive' END AS decision,
         'd1-' || topic || '-' || n AS decision_id, NULL AS supersedes FROM m CROSS JOIN t2
  UNION ALL
  SELECT n, doc_id, topic, 2, CASE WHEN n_chars % 2 = 0 THEN 'responsive' ELSE 'not_responsive' END, 'd2-' || topic || '-' || n, 'd1-' || topic || '-' || n
  FROM m CROSS JOIN t2 WHERE n_chars % 7 = 0 AND n % 2 = 0),
cur AS (SELECT * FROM dec WHERE decision_id NOT IN (SELECT supersedes FROM dec WHERE supersedes IS NOT NULL)),
cells AS (SELECT topic, stratum, count(*) AS n, count(*) FILTER (rel >= 0) AS judged, count(*) FILTER (rel = 1) AS rel FROM q GROUP BY ALL),
w AS (SELECT q.topic, q.trec_doc_id, q.n, q.rel AS relevance, q.stratum, round_even(cells.n / cells.judged, 6) AS sampling_weight
      FROM q JOIN cells ON q.topic = cells.topic AND q.stratum = cells.stratum WHERE q.rel >= 0)
"""
