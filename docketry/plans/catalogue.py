"""One query per operator over the driver's tables, and its SQL for the oracle.

Keys are operator ids. Each query goes through the library; the SQL states the result independently.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyarrow.fs import FileSystem

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas, views
from ..functions import dates, maths
from ..functions import text as tx
from ..functions.verdicts import parse_verdict
from ..operators import checks, dedup, evaluate, judgments, review, sampling, spend, threads, windows
from ..operators import decisions as dec
from ..session import cut, shared_folder
from ..sources import tables
from . import coverage, preprocess, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BUDGET = spend.Budget({"small": {"input": 0.5, "output": 2.5}, "large": {"input": 5.0, "output": 25.0}}, {"click": 1e9, "view": 1.0, "locked": 0.0}, 1e12)
PROTOCOL = review.Protocol("topic", "topic.v1", "Decide whether the document answers the request. Reply with one JSON object.")
RUN = review.Run("docs", "7", "responsiveness", 1, "small", "click", 512, 400)


def query(name: str, sql: str | None, plain: bool = False):
    """Register a query; ``plain`` SQL stands alone, other SQL follows the views."""

    def add(f):
        QUERIES[name] = f
        if sql is not None and sql.startswith("RECURSIVE"):
            ORACLE[name] = views.SQL.replace("WITH ", "WITH RECURSIVE ", 1) + sql.removeprefix("RECURSIVE")
        elif sql is not None:
            ORACLE[name] = sql if plain else views.SQL + sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------------------------------------------------


@query("snk_parquet", "SELECT 'docs' AS corpus, topic, trec_doc_id, relevance, stratum, sampling_weight FROM w")
def _(s, d):
    root = scratch(s)
    rows = judgments.weighted(views.judgment_lines(s, d)).withColumn("corpus", F.lit("docs"))
    tables.write_table(rows.select([f.name for f in schemas.QRELS_RAW]), root, "docs", "qrels_raw", ["topic", "trec_doc_id"])
    return tables.read_table(s, root, "docs", "qrels_raw")


@query("src_parquet", "SELECT doc_id, lang, source FROM documents", plain=True)
def _(s, d):
    return views.table(s, d, "documents").select("doc_id", "lang", "source")


@query("src_pqmeta", "SELECT count(*) AS n FROM documents", plain=True)
def _(s, d):
    return s.range(1).select(F.lit(tables.row_count(s, f"{d}/documents.parquet")).cast("long").alias("n"))


@query("src_qrel_graded", "SELECT topic, trec_doc_id, greatest(0, max(rel)) AS relevance FROM q WHERE topic = 'toxic' GROUP BY ALL")
def _(s, d):
    path = scratch(s)
    q = views.judgment_lines(s, d)
    q.select(F.concat_ws(" ", "topic", F.lit("0"), "trec_doc_id", F.col("rel").cast("string"))).write.text(path)
    topics = s.createDataFrame([("toxic",)], "topic string")
    return tables.graded_judgments(s, path, "docs", topics).select("topic", "trec_doc_id", "relevance")


@query("src_qrel_strat", "SELECT topic, trec_doc_id, stratum, rel FROM q")
def _(s, d):
    path = scratch(s)
    q = views.judgment_lines(s, d)
    q.select(F.concat(F.concat_ws(":", "topic", "trec_doc_id"), F.lit(" "), "stratum", F.lit(" "), F.col("rel").cast("string"))).write.option("compression", "gzip").text(path)
    return tables.stratified_lines(s, path)


@query("src_topics", "SELECT CAST(item_id AS VARCHAR) AS topic, 'item ' || item_id AS title, trim(replace(text, chr(10), ' ')) AS request FROM benchmark", plain=True)
def _(s, d):
    path = scratch(s)
    b = views.table(s, d, "benchmark")
    b.select(F.concat(F.col("item_id").cast("string"), F.lit(" 1  item "), F.col("item_id").cast("string"), F.lit(" -- "), F.regexp_replace("text", "\n", " "))).write.text(path)
    return tables.topics(s, path)


@query(
    "src_topics_yaml",
    r"SELECT CAST(item_id AS VARCHAR) AS topic, 'item ' || item_id AS title, trim(regexp_replace(text, '\s+', ' ', 'g')) AS request FROM benchmark",
    plain=True,
)
def _(s, d):
    """Mappings of topic to title and request, some fifty items to a file."""
    path = scratch(s)
    b = views.table(s, d, "benchmark").withColumn("file", F.floor(F.col("item_id") / 50))
    pair = F.struct(F.col("item_id").cast("string").alias("k"), F.struct(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("title"), F.col("text").alias("request")).alias("v"))
    files = b.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(pair))).alias("value"))
    files.repartition("file").select("value", "file").write.partitionBy("file").text(path)
    return tables.statements(s, f"{path}/file=*")


@query("log_path", "SELECT custodian AS corpus, decision, count(*) AS n FROM dec JOIN m USING (doc_id) GROUP BY ALL")
def _(s, d):
    """A log for each corpus, by its name; custodians stand for corpora."""
    root = scratch(s)
    m = views.messages(s, d).select("doc_id", "custodian")
    rows = cut(_log(s, d).drop("corpus").join(m, "doc_id").withColumnRenamed("custodian", "corpus"))
    corpora = [r[0] for r in rows.select("corpus").distinct().collect()]  # a log each
    for c in corpora:
        tables.append_log(rows.filter(F.col("corpus") == c).select([f.name for f in schemas.DECISIONS]), tables.log_path(root, c))
    found = reduce(DataFrame.unionByName, [tables.read_log(s, tables.log_path(root, c)) for c in corpora])
    return found.groupBy("corpus", "decision").agg(F.count("*").alias("n"))


def _log(s, d) -> DataFrame:
    x = views.decisions(s, d)
    for f in schemas.DECISIONS:
        if f.name not in x.columns:
            x = x.withColumn(f.name, F.lit(None).cast(f.dataType))
    return x.select([f.name for f in schemas.DECISIONS])


@query("src_jsonl", "SELECT decision_id, doc_id, topic, tier, decision, supersedes FROM dec")
def _(s, d):
    path = scratch(s)
    tables.append_log(_log(s, d), path)
    return tables.read_log(s, path).select("decision_id", "doc_id", "topic", "tier", "decision", "supersedes")


@query("snk_jsonl", "SELECT topic, count(*) * 2 AS n FROM dec GROUP BY topic")
def _(s, d):
    path = scratch(s)
    for _ in range(2):
        tables.append_log(_log(s, d), path)
    return tables.read_log(s, path).groupBy("topic").agg(F.count("*").alias("n"))


@query("snk_audit", "SELECT lang AS batch_id, count(*) AS n FROM m GROUP BY lang")
def _(s, d):
    path = scratch(s)
    tables.write_audit(views.messages(s, d).select(F.col("lang").alias("batch_id"), "doc_id"), path)
    return s.read.json(path).groupBy("batch_id").agg(F.count("*").alias("n"))


@query("src_devset", "SELECT DISTINCT trec_doc_id FROM q WHERE rel >= 0")
def _(s, d):
    path = scratch(s)
    q = views.judgment_lines(s, d).filter("rel >= 0")
    g = q.groupBy(F.concat(F.lit("rel"), F.col("rel").cast("string")).alias("g")).agg(F.collect_list("trec_doc_id").alias("ids"))
    g.agg(F.map_from_entries(F.collect_list(F.struct("g", "ids"))).alias("doc_ids")).coalesce(1).write.json(path)
    return tables.devset_ids(s, path)


@query("src_spend", "SELECT event_type AS phase, round_even(sum(value), 4) AS spent FROM events GROUP BY ROLLUP(event_type)", plain=True)
def _(s, d):
    return spend.totals(views.ledger(s, d)).select("phase", F.bround("spent", 4).alias("spent"))


# --- filters and checks ------------------------------------------------------------------------------------------------


@query("prj_cols", "SELECT doc_id, subject_norm, date_utc IS NULL AS undated FROM mn")
def _(s, d):
    return views.normed(s, d).select("doc_id", "subject_norm", F.col("date_utc").isNull().alias("undated"))


@query("flt_topic", "SELECT doc_id, decision FROM dec WHERE topic = 'toxic' AND tier = 1")
def _(s, d):
    return views.decisions(s, d).filter("topic = 'toxic' and tier = 1").select("doc_id", "decision")


@query("flt_ambig", "SELECT doc_id, trec_doc_id FROM im WHERE NOT ambiguous")
def _(s, d):
    return views.id_map(s, d).filter(~F.col("ambiguous")).select("doc_id", "trec_doc_id")


_CANON = """, ex AS (SELECT dedup_key, doc_id, n, first_value(doc_id) OVER o AS canonical_doc_id, CAST(row_number() OVER o - 1 AS INTEGER) AS dup_rank
  FROM mk WINDOW o AS (PARTITION BY dedup_key ORDER BY date_utc NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ca AS (SELECT mk.* FROM mk JOIN ex USING (doc_id) WHERE dup_rank = 0),
el AS (SELECT doc_id, date_utc, list_filter(regexp_split_to_array(body_norm, '\\s+'), lambda x: x <> '') AS ws FROM ca
  WHERE body_hash NOT IN (SELECT body_hash FROM mk GROUP BY 1 HAVING count(*) >= 50) AND body_hash NOT IN (SELECT body_hash FROM ca GROUP BY 1 HAVING count(*) > 1))
"""


def _canonicals(s, d) -> tuple[DataFrame, DataFrame]:
    # a stored table of messages has its normal forms; here they are made once
    m = cut(views.normed(s, d).select("doc_id", "subject_norm", "body_norm", "date_utc"))
    return dedup.canonical(m, dedup.exact_clusters(m)), m


@query("flt_eligible", _CANON + "SELECT doc_id, len(ws) AS n_words FROM el WHERE len(ws) >= 30")
def _(s, d):
    return dedup.eligible(*_canonicals(s, d)).select("doc_id", F.size("w").cast("long").alias("n_words"))


@query("flt_judged", "SELECT topic, count(*) AS judged FROM q WHERE rel >= 0 GROUP BY topic")
def _(s, d):
    return views.judgment_lines(s, d).filter("rel >= 0").groupBy("topic").agg(F.count("*").alias("judged"))


@query("chk_unique", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1", plain=True)
def _(s, d):
    return checks.repeated(views.table(s, d, "documents"), "text")


@query("chk_count", "SELECT count(*) AS n, unnest(['as expected', 'other than expected']) AS verdict FROM documents", plain=True)
def _(s, d):
    expected = tables.row_count(s, f"{d}/documents.parquet")  # of the footers, against rows counted by a column
    t = views.table(s, d, "documents").filter("doc_id is null or doc_id is not null")
    lost = []
    for n in (expected, expected + 1):
        try:
            lost.append((checks.expected_count(t, n), "as expected"))
        except checks.CheckError:
            lost.append((expected, "other than expected"))
    return s.createDataFrame(lost, "n long, verdict string")


@query(
    "chk_gate",
    """SELECT g.gate, count(*) FILTER (lang <> 'en') / count(*) AS rate, CAST(CASE WHEN count(*) FILTER (lang <> 'en') / count(*) < g.gate THEN 0 ELSE 1 END AS INTEGER) AS code
    FROM documents CROSS JOIN (SELECT unnest([0.01, 1.0])::DOUBLE AS gate) g GROUP BY g.gate""",
    plain=True,
)
def _(s, d):
    t = views.table(s, d, "documents")
    rate = checks.failure_rate(t.filter("lang = 'en'"), t.filter("lang <> 'en'")).first()["rate"]
    return s.createDataFrame([(g, rate, checks.gate(rate < g, "lang")) for g in (0.01, 1.0)], "gate double, rate double, code int")


@query("chk_m1", "SELECT trec_doc_id, doc_id FROM im WHERE NOT ambiguous")
def _(s, d):
    return checks.many_to_one(views.id_map(s, d).filter(~F.col("ambiguous")), "trec_doc_id").select("trec_doc_id", "doc_id")


@query("chk_weight", "SELECT topic, trec_doc_id, sampling_weight FROM w")
def _(s, d):
    return checks.positive_weights(judgments.weighted(views.judgment_lines(s, d))).select("topic", "trec_doc_id", "sampling_weight")


# --- joins and sets ----------------------------------------------------------------------------------------------------


@query("join_qrels_idmap", "SELECT w.topic, w.trec_doc_id, im.doc_id, w.sampling_weight FROM w LEFT JOIN im ON w.trec_doc_id = im.trec_doc_id AND NOT im.ambiguous")
def _(s, d):
    q = judgments.weighted(views.judgment_lines(s, d))
    return evaluate.map_judgments(q, views.id_map(s, d)).select("topic", "trec_doc_id", "doc_id", "sampling_weight")


_MAPPED = """, mj AS (SELECT w.*, im.doc_id FROM w LEFT JOIN im ON w.trec_doc_id = im.trec_doc_id AND NOT im.ambiguous)
"""


def _mapped(s, d) -> DataFrame:
    return evaluate.map_judgments(judgments.weighted(views.judgment_lines(s, d)), views.id_map(s, d))


@query("join_qrels_dec", _MAPPED + "SELECT mj.trec_doc_id, mj.relevance, c.decision FROM mj LEFT JOIN cur c ON c.doc_id = mj.doc_id AND c.topic = 'toxic' WHERE mj.topic = 'toxic'")
def _(s, d):
    now = dec.current(views.decisions(s, d)).filter("topic = 'toxic'")
    return evaluate.judged_decisions(_mapped(s, d).filter("topic = 'toxic'"), now).select("trec_doc_id", "relevance", "decision")


@query("join_supersedes", "SELECT doc_id, decision_id, supersedes FROM dec WHERE tier = 2 AND topic = 'toxic'")
def _(s, d):
    log = views.decisions(s, d).filter("topic = 'toxic'")
    new = log.filter("tier = 2").drop("supersedes")
    return dec.wire_supersedes(new, log.filter("tier = 1"), "toxic", views.VERSION).select("doc_id", "decision_id", "supersedes")


@query("join_trec2doc", "SELECT trec_doc_id, doc_id FROM im")
def _(s, d):
    m = views.id_map(s, d)
    return dec.trec_to_doc(m.select("trec_doc_id"), m)


@query("join_docrows", "SELECT doc_id, custodian, subject FROM m WHERE doc_id IN (SELECT doc_id FROM cur WHERE decision = 'responsive')")
def _(s, d):
    m = views.messages(s, d)
    return dec.fetch(m, dec.current(views.decisions(s, d)).filter("decision = 'responsive'").select("doc_id").distinct()).select("doc_id", "custodian", "subject")


@query("join_custodian", "SELECT w.topic, w.trec_doc_id, m.custodian FROM w JOIN im ON w.trec_doc_id = im.trec_doc_id JOIN m ON m.doc_id = im.doc_id")
def _(s, d):
    q = judgments.weighted(views.judgment_lines(s, d))
    return judgments.with_custodian(q, views.id_map(s, d), views.messages(s, d), fold=False).select("topic", "trec_doc_id", "custodian")


_FOLD = """, fo AS (SELECT w.topic, w.trec_doc_id, w.relevance, m.custodian FROM w JOIN im ON array_to_string(string_split(w.trec_doc_id, '.')[1:3], '.') = im.trec_doc_id JOIN m ON m.doc_id = im.doc_id)
"""


def _folded(s, d) -> DataFrame:
    return judgments.with_custodian(judgments.weighted(views.judgment_lines(s, d)), views.id_map(s, d), views.messages(s, d))


@query("join_parent", _FOLD + "SELECT topic, trec_doc_id, custodian FROM fo")
def _(s, d):
    return _folded(s, d).select("topic", "trec_doc_id", "custodian")


_OWN = ", own AS (SELECT im.trec_doc_id, m.custodian FROM im JOIN m USING (doc_id))\n"


def _owners(s, d) -> DataFrame:
    return views.id_map(s, d).join(views.messages(s, d).select("doc_id", "custodian"), "doc_id").select("trec_doc_id", "custodian")


_RELCUST = _OWN + """, hit AS (SELECT w.topic, own.custodian, count(*) AS n FROM w LEFT JOIN own USING (trec_doc_id) WHERE w.relevance = 1 GROUP BY ALL),
about AS (SELECT topic, count(custodian) AS custodians, CAST(coalesce(sum(n) FILTER (custodian IS NULL), 0) AS BIGINT) AS unmapped FROM hit GROUP BY topic),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY n DESC, custodian) AS INTEGER) AS rank FROM hit WHERE custodian IS NOT NULL)
SELECT topic, custodian, n, rank, custodians, unmapped FROM ranked JOIN about USING (topic) WHERE rank <= 15
"""


def _relcust(s, d, top=15):
    return judgments.relevant_custodians(judgments.weighted(views.judgment_lines(s, d)), _owners(s, d), top)


query("agg_reltop", _RELCUST)(_relcust)
query("win_topn", _RELCUST.replace("rank <= 15", "rank <= 3"))(lambda s, d: _relcust(s, d, 3))


@query("join_relcust", _OWN + "SELECT w.topic, w.trec_doc_id, own.custodian FROM w LEFT JOIN own USING (trec_doc_id) WHERE w.relevance = 1")
def _(s, d):
    return judgments.relevant_with_custodian(judgments.weighted(views.judgment_lines(s, d)), _owners(s, d)).select("topic", "trec_doc_id", "custodian")


@query("join_weight", "SELECT topic, trec_doc_id, stratum, sampling_weight FROM w")
def _(s, d):
    return judgments.window_weights(views.judgment_lines(s, d))


@query("semi_wanted", "SELECT doc_id FROM m WHERE doc_id IN (SELECT doc_id FROM im)")
def _(s, d):
    return views.messages(s, d).join(views.id_map(s, d).select("doc_id"), "doc_id", "left_semi").select("doc_id")


@query("semi_dev", "SELECT topic, trec_doc_id FROM w WHERE trec_doc_id IN (SELECT trec_doc_id FROM im WHERE ambiguous)")
def _(s, d):
    dev = views.id_map(s, d).filter("ambiguous").select("trec_doc_id")
    return judgments.weighted(views.judgment_lines(s, d)).join(dev, "trec_doc_id", "left_semi").select("topic", "trec_doc_id")


@query("semi_canon", _CANON + "SELECT doc_id FROM ca")
def _(s, d):
    return _canonicals(s, d)[0].select("doc_id")


@query("anti_superseded", "SELECT decision_id, doc_id, topic, tier, decision FROM cur")
def _(s, d):
    return dec.current(views.decisions(s, d)).select("decision_id", "doc_id", "topic", "tier", "decision")


@query("anti_scored", "SELECT doc_id FROM m WHERE doc_id NOT IN (SELECT doc_id FROM cur WHERE topic = 'toxic' AND tier = 2)")
def _(s, d):
    done = dec.scored(views.decisions(s, d), "toxic", views.VERSION, "responsiveness", 2)
    return dec.candidates(views.messages(s, d), done)


@query("anti_missing", "SELECT DISTINCT trec_doc_id FROM w WHERE trec_doc_id NOT IN (SELECT trec_doc_id FROM im)")
def _(s, d):
    return judgments.weighted(views.judgment_lines(s, d)).select("trec_doc_id").subtract(views.id_map(s, d).select("trec_doc_id"))


@query("set_union_all", "SELECT topic, trec_doc_id FROM w UNION ALL SELECT topic, trec_doc_id FROM q")
def _(s, d):
    q = views.judgment_lines(s, d)
    return judgments.weighted(q).select("topic", "trec_doc_id").unionByName(q.select("topic", "trec_doc_id"))


@query("set_union", "SELECT trec_doc_id FROM w UNION SELECT trec_doc_id FROM im")
def _(s, d):
    return judgments.weighted(views.judgment_lines(s, d)).select("trec_doc_id").union(views.id_map(s, d).select("trec_doc_id")).distinct()


@query("set_intersect", "SELECT trec_doc_id FROM w INTERSECT SELECT trec_doc_id FROM im")
def _(s, d):
    return judgments.weighted(views.judgment_lines(s, d)).select("trec_doc_id").intersect(views.id_map(s, d).select("trec_doc_id"))


# --- aggregates --------------------------------------------------------------------------------------------------------


@query("agg_exactkey", "SELECT dedup_key, count(*) AS n, min(doc_id) AS least FROM mk GROUP BY dedup_key")
def _(s, d):
    m = views.normed(s, d)
    return m.groupBy(tx.dedup_key("subject_norm", "body_norm").alias("dedup_key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


@query("agg_bodyfreq", "SELECT body_hash AS hash, count(*) AS n FROM mk GROUP BY body_hash")
def _(s, d):
    return dedup.body_counts(views.normed(s, d))


@query("agg_boiler", "SELECT count(*) AS bodies FROM (SELECT body_hash FROM mk GROUP BY 1 HAVING count(*) >= 2)")
def _(s, d):
    return dedup.boilerplate_bodies(views.normed(s, d), 2).agg(F.count("*").alias("bodies"))


@query("agg_cells", "SELECT topic, stratum, n, judged, rel FROM cells")
def _(s, d):
    return judgments.cells(views.judgment_lines(s, d))


@query("agg_htweight", "SELECT topic, trec_doc_id, relevance, stratum, sampling_weight FROM w")
def _(s, d):
    return judgments.weighted(views.judgment_lines(s, d))


@query("agg_estr", "SELECT topic, round_even(sum(CASE WHEN judged > 0 THEN rel / judged * n ELSE 0 END), 2) AS estimated_r FROM cells GROUP BY topic")
def _(s, d):
    return judgments.estimated_relevant(views.judgment_lines(s, d))


@query("agg_coverage", """, dq AS (SELECT DISTINCT topic, trec_doc_id FROM w), e AS (SELECT topic, count(*) AS judged, count(k.trec_doc_id) AS mapped
  FROM dq LEFT JOIN (SELECT DISTINCT trec_doc_id FROM im) k USING (trec_doc_id) GROUP BY topic)
SELECT topic, CAST(sum(judged) AS BIGINT) AS judged, CAST(sum(mapped) AS BIGINT) AS mapped, round_even(sum(mapped) / sum(judged), 6) AS coverage FROM e GROUP BY ROLLUP(topic)""")
def _(s, d):
    return judgments.coverage(judgments.weighted(views.judgment_lines(s, d)), views.id_map(s, d))


@query("agg_policy", """, x AS (
  SELECT topic, relevance, 'raw' AS policy, trec_doc_id AS look FROM w
  UNION ALL SELECT topic, relevance, 'fold_to_parent', array_to_string(string_split(trec_doc_id, '.')[1:3], '.') FROM w
  UNION ALL SELECT topic, relevance, 'exclude_parts', trec_doc_id FROM w WHERE len(string_split(trec_doc_id, '.')) = 3),
y AS (SELECT x.*, k.trec_doc_id IS NOT NULL AS cov FROM x LEFT JOIN (SELECT DISTINCT trec_doc_id FROM im) k ON x.look = k.trec_doc_id),
z AS (SELECT topic, policy, count(*) AS judged, count(*) FILTER (cov) AS covered, count(*) FILTER (relevance = 1) AS relevant, count(*) FILTER (cov AND relevance = 1) AS covered_rel FROM y GROUP BY ALL)
SELECT *, CASE WHEN judged > 0 THEN round_even(covered / judged, 6) ELSE 0.0 END AS coverage, CASE WHEN relevant > 0 THEN round_even(covered_rel / relevant, 6) ELSE 0.0 END AS coverage_rel FROM z""")
def _(s, d):
    return judgments.policies(judgments.weighted(views.judgment_lines(s, d)), views.id_map(s, d))


@query("agg_custfold", _FOLD + "SELECT topic, custodian, count(*) AS judged, CAST(sum(relevance) AS BIGINT) AS relevant FROM fo GROUP BY ALL")
def _(s, d):
    return judgments.by_custodian(_folded(s, d))


@query("agg_grades", "SELECT topic, relevance, count(*) AS n FROM w GROUP BY ALL")
def _(s, d):
    return judgments.grades(judgments.weighted(views.judgment_lines(s, d)))


@query("agg_percust", "SELECT custodian, count(*) AS n FROM m GROUP BY custodian")
def _(s, d):
    return views.messages(s, d).groupBy("custodian").agg(F.count("*").alias("n"))


@query("agg_failrate", "SELECT count(*) FILTER (event_type <> 'error') AS parsed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error') / count(*) AS rate FROM events", plain=True)
def _(s, d):
    e = views.table(s, d, "events")
    return checks.failure_rate(e.filter("event_type <> 'error'"), e.filter("event_type = 'error'"))


_CONF = _MAPPED + """, r AS (SELECT mj.topic, mj.relevance, mj.sampling_weight AS sw, c.decision FROM mj LEFT JOIN cur c ON c.doc_id = mj.doc_id AND c.topic = mj.topic WHERE mj.doc_id IS NOT NULL),
cf AS (SELECT topic, coalesce(sum(sw) FILTER (decision = 'responsive' AND relevance > 0), 0) AS tp, coalesce(sum(sw) FILTER (decision = 'responsive' AND relevance <= 0), 0) AS fp,
  coalesce(sum(sw) FILTER (decision <> 'responsive' AND relevance > 0), 0) AS fn, coalesce(sum(sw) FILTER (decision <> 'responsive' AND relevance <= 0), 0) AS tn,
  count(*) AS n_judged, count(decision) AS n_evaluated, count(*) FILTER (decision = 'borderline') AS borderline_in_eval FROM r GROUP BY topic)
"""


def _cells(s, d) -> DataFrame:
    """The flagship: current decisions against weighted, mapped judgments of all topics in one plan."""
    judged = _mapped(s, d).filter("doc_id is not null")
    now = dec.current(views.decisions(s, d)).select(F.col("doc_id").alias("__d"), F.col("topic").alias("__t"), "decision")
    rows = judged.join(now, (F.col("doc_id") == F.col("__d")) & (F.col("topic") == F.col("__t")), "left")
    return evaluate.confusion(rows, "topic")


@query("agg_confusion", _CONF + "SELECT topic, round_even(tp, 4) AS tp, round_even(fp, 4) AS fp, round_even(fn, 4) AS fn, round_even(tn, 4) AS tn, n_judged, n_evaluated, borderline_in_eval FROM cf")
def _(s, d):
    c = _cells(s, d).drop("judged_without_decision")
    return c.withColumns({k: F.bround(k, 4) for k in ("tp", "fp", "fn", "tn")})


_PRF = _CONF + """, pr AS (SELECT topic, n_evaluated, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p FROM cf)
SELECT topic, n_evaluated, round_even(r, 4) AS recall, round_even(p, 4) AS precision, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1 FROM pr"""


@query("val_eval", _PRF)
def _prf(s, d):
    return evaluate.scores(_cells(s, d)).select("topic", "n_evaluated", "recall", "precision", "f1")


@query("agg_prf", _PRF.replace("SELECT topic, n_evaluated, round_even(r, 4)", "SELECT topic, round_even(tp, 4) AS tp, round_even(fp, 4) AS fp, round_even(fn, 4) AS fn, round_even(tn, 4) AS tn, round_even(r, 4)").replace("(SELECT topic, n_evaluated, CASE", "(SELECT *, CASE"))
def _(s, d):
    return evaluate.scores(_cells(s, d)).select("topic", "tp", "fp", "fn", "tn", "recall", "precision", "f1")


_RUNS = """, r AS (SELECT mj.relevance, mj.sampling_weight AS sw, c.decision FROM mj LEFT JOIN cur c ON c.doc_id = mj.doc_id AND c.topic = 'toxic' WHERE mj.doc_id IS NOT NULL AND mj.topic = 'toxic')
, k AS (SELECT est, sum(x) FILTER (decision = 'responsive' AND relevance > 0) AS tp, sum(x) FILTER (decision = 'responsive' AND relevance = 0) AS fp, sum(x) FILTER (decision <> 'responsive' AND relevance > 0) AS fn
  FROM (SELECT 'unweighted' AS est, 1.0 AS x, * FROM r UNION ALL SELECT 'weighted_horvitz_thompson', sw, * FROM r) GROUP BY est)
SELECT CASE est WHEN 'unweighted' THEN 'plain' ELSE 'weighted' END AS run, CAST(0 AS INTEGER) AS code, est AS estimator, round_even(tp / (tp + fn), 4) AS recall, round_even(tp / (tp + fp), 4) AS precision,
  CASE est WHEN 'unweighted' THEN (SELECT count(*) FROM mj WHERE topic = 'toxic' AND doc_id IS NULL) ELSE 0 END AS unmapped FROM k
UNION ALL SELECT 'unmapped', CAST(CASE WHEN count(*) > 0 THEN 2 ELSE 0 END AS INTEGER), 'none', -1.0, -1.0, -1 FROM mj WHERE topic = 'toxic' AND doc_id IS NULL"""


@query("val_run", _MAPPED + _RUNS)
def _(s, d):
    """The run itself: plain, weighted over what is mapped, and weighted with unmapped judgments, which it refuses."""
    log, qrels, idmap = _log(s, d), judgments.weighted(views.judgment_lines(s, d)), views.id_map(s, d)
    log = log.withColumns({"phase": F.lit("responsiveness"), "prompt_version": F.lit(views.VERSION)})
    mapped = qrels.join(idmap.filter("not ambiguous").select("trec_doc_id"), "trec_doc_id", "left_semi")
    rows = []
    for name, judged, stratified in (("plain", qrels, False), ("weighted", mapped, True), ("unmapped", qrels, True)):
        with tempfile.TemporaryDirectory() as folder:  # the driver's artifacts
            code = validate.run(log, judged, idmap, "docs", "toxic", views.VERSION, folder, stratified=stratified)
            got = [json.loads(p.read_text()) for p in Path(folder).glob("*.json")] or [{}]
        none = {"estimator": "none", "recall": -1.0, "precision": -1.0, "unmapped": -1}
        rows.append((name, code, *((none | got[0])[k] for k in none)))
    return s.createDataFrame(rows, "run string, code int, estimator string, recall double, precision double, unmapped long")


@query("val_current", "SELECT doc_id, decision FROM cur WHERE topic = 'toxic'")
def _(s, d):
    log = views.decisions(s, d)
    return dec.current(log).filter((F.col("topic") == "toxic") & (F.col("prompt_version") == views.VERSION) & (F.col("phase") == "responsiveness")).select("doc_id", "decision")


@query("agg_spend", "WITH c(phase, cap) AS (VALUES ('click', 1e9), ('view', 1.0), ('locked', 0.0)), e AS (SELECT event_type AS phase, sum(value) AS spent FROM events GROUP BY 1) SELECT phase, round_even(coalesce(spent, 0), 4) AS spent, CAST(cap AS DOUBLE) AS cap FROM c FULL JOIN e USING (phase)", plain=True)
def _(s, d):
    return spend.status(views.ledger(s, d), BUDGET).withColumn("spent", F.bround("spent", 4))


@query("agg_cumsum", "SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS cumulative FROM events", plain=True)
def _(s, d):
    return windows.running_total(views.ledger(s, d), "cost_usd", ["ts", "event_id"], "ts").select("event_id", F.round("running", 2).alias("cumulative"))


@query("agg_tokens", "SELECT lang, CAST(sum(length(body_text) // 4) AS BIGINT) AS tokens FROM m GROUP BY lang")
def _(s, d):
    return views.messages(s, d).groupBy("lang").agg(F.sum(F.coalesce(tx.token_estimate("body_text"), F.lit(0))).alias("tokens"))


# --- windows -----------------------------------------------------------------------------------------------------------


@query("win_duprank", _CANON + "SELECT doc_id, dup_rank FROM ex")
def _(s, d):
    return dedup.exact_clusters(views.normed(s, d)).select("doc_id", "dup_rank")


@query("ded_exact", _CANON + "SELECT dedup_key, canonical_doc_id, doc_id, dup_rank FROM ex")
def _(s, d):
    return dedup.exact_clusters(views.normed(s, d))


@query("win_canon", _CANON + "SELECT doc_id, canonical_doc_id FROM ex")
def _(s, d):
    return dedup.exact_clusters(views.normed(s, d)).select("doc_id", "canonical_doc_id")


_THREAD = r""", c0 AS (SELECT *, CASE WHEN subject_norm = '' THEN chr(1) || doc_id ELSE subject_norm END AS sk,
   trim(regexp_replace(regexp_replace(body_norm, '(^|\n)[> \t]+', '\1', 'g'), '\s+', ' ', 'g')) AS tx FROM tm),
c1 AS (SELECT *, CASE WHEN date_utc - lag(date_utc) OVER (PARTITION BY sk ORDER BY date_utc NULLS LAST, doc_id) > INTERVAL 60 DAY THEN 1 ELSE 0 END AS gap FROM c0),
c2 AS (SELECT *, sum(gap) OVER (PARTITION BY sk ORDER BY date_utc NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS seg FROM c1),
th AS (SELECT *, 't-' || first_value(doc_id) OVER o AS thread_id, lag(doc_id) OVER o AS parent_doc_id, CAST(row_number() OVER o - 1 AS INTEGER) AS depth, count(*) OVER (PARTITION BY sk, seg) AS size
   FROM c2 WINDOW o AS (PARTITION BY sk, seg ORDER BY date_utc NULLS LAST, doc_id)),
ct AS (SELECT b.doc_id, bool_or(a.depth < b.depth AND a.tx <> '' AND contains(b.tx, a.tx)) AS has_earlier, bool_or(a.depth > b.depth AND b.tx <> '' AND contains(a.tx, b.tx)) AS in_later
   FROM th a JOIN th b USING (thread_id) GROUP BY b.doc_id),
la AS (SELECT b.doc_id, flatten(list(a.attachment_names) FILTER (a.depth > b.depth)) AS later FROM th a JOIN th b USING (thread_id) GROUP BY b.doc_id),
rs AS (SELECT th.doc_id, thread_id, parent_doc_id, depth,
   CASE WHEN size = 1 THEN 'singleton' WHEN has_earlier THEN 'containment' ELSE 'subject_fallback' END AS method,
   CASE WHEN depth = size - 1 THEN 'terminal_node' WHEN NOT in_later THEN 'unique_content'
        WHEN len(list_filter(attachment_names, lambda x: NOT coalesce(list_contains(later, x), false))) > 0 THEN 'attachment_unique' END AS inclusive_reason
   FROM th JOIN ct USING (doc_id) JOIN la USING (doc_id))
"""


def _threads(s, d) -> DataFrame:
    return threads.threads(views.thread_messages(s, d))


@query("thr_build", _THREAD + "SELECT doc_id, thread_id, parent_doc_id, depth, method FROM rs")
def _(s, d):
    return _threads(s, d).select("doc_id", "thread_id", "parent_doc_id", "depth", "method")


@query("thr_inclusive", _THREAD + "SELECT doc_id, inclusive_reason IS NOT NULL AS is_inclusive, inclusive_reason FROM rs")
def _(s, d):
    return _threads(s, d).select("doc_id", "is_inclusive", "inclusive_reason")


for _name, _col in (("win_gap", "thread_id"), ("win_parent", "parent_doc_id"), ("win_depth", "depth"), ("win_threadid", "thread_id")):
    query(_name, _THREAD + f"SELECT doc_id, {_col} FROM th")(lambda s, d, c=_col: threads.segments(views.thread_messages(s, d)).select("doc_id", c))

for _name, _col in (("win_anyprev", "has_earlier"), ("win_anynext", "in_later"), ("theta_contain", "has_earlier")):

    def _contain(s, d, c=_col):
        rows = threads.segments(views.thread_messages(s, d)).withColumn("__text", tx.collapse("body_norm"))
        hits = threads._containments(rows)
        return rows.select("doc_id").join(hits, "doc_id", "left").select("doc_id", F.coalesce(c, F.lit(False)).alias(c))

    query(_name, _THREAD + f"SELECT doc_id, coalesce({_col}, false) AS {_col} FROM ct")(_contain)


@query("win_nextatt", _THREAD + "SELECT doc_id, len(list_filter(attachment_names, lambda x: NOT coalesce(list_contains(later, x), false))) > 0 AS own FROM th JOIN la USING (doc_id)")
def _(s, d):
    rows = cut(threads.segments(views.thread_messages(s, d)).select("doc_id", "thread_id", "depth", "attachment_names"))
    own = threads.own_attachments(rows, "attachment_names").withColumn("own", F.lit(True))
    return rows.join(own, ["thread_id", "depth"], "left").select("doc_id", F.coalesce("own", F.lit(False)).alias("own"))


@query("win_cellw", "SELECT topic, trec_doc_id, stratum, sampling_weight FROM w")
def _(s, d):
    return judgments.window_weights(views.judgment_lines(s, d))


_QUOTA = """, po AS (SELECT topic, relevance, count(*) AS n FROM w GROUP BY ALL),
qu AS (SELECT topic, coalesce(max(n) FILTER (relevance = 1), 0) AS p1, coalesce(max(n) FILTER (relevance = 0), 0) AS p0 FROM po GROUP BY topic),
k AS (SELECT topic, 1 AS relevance, least(20, p1) AS k FROM qu UNION ALL SELECT topic, 0, least(p0, 60 - least(20, p1)) FROM qu),
rn AS (SELECT w.topic, w.relevance, w.trec_doc_id, k, row_number() OVER (PARTITION BY w.topic, w.relevance ORDER BY sha256('42:docs:' || w.topic || ':' || w.relevance || ':' || w.trec_doc_id), w.trec_doc_id) AS r FROM w JOIN k ON w.topic = k.topic AND w.relevance = k.relevance)
SELECT topic, relevance, trec_doc_id FROM rn WHERE r <= k"""


def _devset(s, d):
    q = judgments.weighted(views.judgment_lines(s, d)).withColumn("corpus", F.lit("docs"))
    return sampling.devset(q, "docs", 60, 20)


query("smp_devset", _QUOTA)(_devset)


@query("smp_rng", ", po AS (SELECT topic, relevance, count(*) AS n FROM w GROUP BY ALL) SELECT topic, relevance, n, least(n, CASE WHEN relevance = 1 THEN 20 ELSE 40 END) AS taken, true AS as_drawn FROM po")
def _(s, d):
    """Samples by drawn places of all judgments: of each stratum its size, what was taken, and whether the ids' places are those that the generator draws."""
    q = judgments.weighted(views.judgment_lines(s, d)).select("topic", "relevance", "trec_doc_id")
    sizes = q.select("topic", "relevance").distinct().withColumn("k", F.when(F.col("relevance") == 1, 20).otherwise(40))
    took = sampling.take(q, ["topic", "relevance"], sizes, "trec_doc_id", 42, parity=True)
    ranked = windows.numbered(q, ["topic", "relevance"], [F.col("trec_doc_id").asc()])
    places = ranked.join(took, ["topic", "relevance", "trec_doc_id"], "left_semi").groupBy("topic", "relevance").agg(F.first("__size").alias("n"), F.count("*").alias("taken"), F.array_sort(F.collect_list("__number")).alias("at"))
    pools = places.select("topic", "relevance", "n").join(sizes, ["topic", "relevance"])
    drawn = sampling.positions(pools, ["topic", "relevance"], 42).groupBy("topic", "relevance").agg(F.array_sort(F.collect_list("__number")).alias("want"))
    return places.join(drawn, ["topic", "relevance"]).select("topic", "relevance", "n", "taken", (F.col("at") == F.col("want")).alias("as_drawn"))


@query("win_quota", _QUOTA.replace("SELECT topic, relevance, trec_doc_id FROM rn WHERE r <= k", "SELECT topic, relevance, CAST(k AS INTEGER) AS k FROM k"))
def _(s, d):
    q = judgments.weighted(views.judgment_lines(s, d)).withColumn("corpus", F.lit("docs"))
    return sampling.devset_sizes(q, "docs", 60, 20).select("topic", "relevance", "k")


@query("smp_qc", """, cc AS (SELECT decision, doc_id, count(*) OVER (PARTITION BY decision) AS n, row_number() OVER (PARTITION BY decision ORDER BY sha256('1337:' || decision || ':' || doc_id), doc_id) AS r
  FROM cur WHERE topic = 'toxic' AND tier = 1 AND decision IN ('responsive', 'not_responsive')) SELECT decision, doc_id FROM cc WHERE r <= round_even(n * 0.05, 0)""")
def _(s, d):
    return sampling.qc_sample(dec.current(views.decisions(s, d)), "toxic", views.VERSION, 0.05).select("decision", "doc_id")


@query("smp_ht", "SELECT topic, round_even(sum(sampling_weight), 2) AS universe FROM w GROUP BY topic")
def _(s, d):
    return judgments.weighted(views.judgment_lines(s, d)).groupBy("topic").agg(F.bround(F.sum("sampling_weight"), 2).alias("universe"))


@query("srt_topk", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20", plain=True)
def _(s, d):
    return views.table(s, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


# --- scalar functions --------------------------------------------------------------------------------------------------


def scalar(name: str, sql: str, make, view=views.normed, source: str = "mn"):
    """A function of one row: columns doc_id and v."""
    query(name, f"SELECT doc_id, {sql} AS v FROM {source}")(lambda s, d: view(s, d).select("doc_id", make().alias("v")))


scalar("str_subjnorm", "subject_norm", lambda: tx.subject_norm("subject"))
scalar("str_bodynorm", "sha256(body_norm)", lambda: F.sha2(tx.body_norm("body_text"), 256))
scalar("str_bodyhash", "body_hash", lambda: tx.body_hash("body_norm"), source="mk")
scalar("str_tokens", "CAST(length(body_text) // 4 AS INTEGER)", lambda: tx.token_estimate("body_text"))
scalar("str_docid", "'bush-' || substr(sha256('a/' || n || ':0'), 1, 16)", lambda: tx.doc_id(F.lit("bush"), F.concat(F.lit("a/"), F.col("n").cast("string")), F.lit(0)))
scalar("str_dedupkey", "dedup_key", lambda: tx.dedup_key("subject_norm", "body_norm"), source="mk")
scalar("str_words", r"len(list_filter(regexp_split_to_array(body_norm, '\s+'), lambda x: x <> ''))", lambda: F.size(tx.words("body_norm")).cast("long"))
scalar("str_collapse", r"sha256(trim(regexp_replace(regexp_replace(body_norm, '(^|\n)[> \t]+', '\1', 'g'), '\s+', ' ', 'g')))", lambda: F.sha2(tx.collapse("body_norm"), 256))
scalar("str_contains", "contains(body_norm, subject_norm) AND subject_norm <> ''", lambda: tx.contained("subject_norm", "body_norm"))
scalar("str_parentdoc", "'3.' || n || '.' || lang", lambda: tx.parent_doc(F.concat_ws(".", F.lit("3"), F.col("n").cast("string"), "lang", F.lit("9"))))
scalar("str_ispart", "n % 2 = 0", lambda: tx.is_part(F.concat(F.lit("3.1.a"), F.when(F.col("n") % 2 == 0, ".1").otherwise(""))))
scalar("str_custodian", "custodian", lambda: tx.zip_custodian(F.concat(F.lit("edrm-enron-v2_"), "custodian", F.lit("_xml_1of2.zip"))))
scalar("str_member", "custodian || '|3.' || n", lambda: F.concat_ws("|", *[tx.member_parts(F.concat(F.lit("./edrm-enron-v2_"), "custodian", F.lit("_xml//text/3."), F.col("n").cast("string"), F.lit(".txt")))[k] for k in ("custodian", "docid")]))
scalar("str_semi", "custodian || '|' || lang", lambda: F.array_join(tx.split_list(F.concat(F.lit(" ;"), "custodian", F.lit("; "), "lang", F.lit(" ;;"))), "|"))
scalar("str_semicomma", "custodian || '|' || lang || '|x'", lambda: F.array_join(tx.split_list(F.concat("custodian", F.lit(", "), "lang", F.lit(";x,")), ";,"), "|"))
scalar("str_from", "custodian || '|' || lang || '@x.org'", lambda: F.concat_ws("|", *[tx.sender(F.concat(F.lit('"'), "custodian", F.lit('" <'), "lang", F.lit("@x.org>")))[k] for k in ("name", "addr")]))
scalar("str_wsjoin", r"sha256(trim(regexp_replace(body_text, '\s+', ' ', 'g')))", lambda: F.sha2(tx.squeeze("body_text"), 256))
scalar("str_customid", "doc_id || '__7__resp__t1__topic-v1'", lambda: tx.custom_id("doc_id", F.lit("7"), F.lit("responsiveness"), F.lit(1), F.lit("topic.v1")))
scalar("str_customid_parse", "doc_id || '|7|qc|2|a-v.v12'", lambda: F.concat_ws("|", *[tx.custom_id_fields(F.concat("doc_id", F.lit("__7__qc__t2__a-v-v12")))[k].cast("string") for k in ("doc_id", "topic", "phase", "tier", "prompt_version")]))
scalar("str_version", "CAST(n AS INTEGER)", lambda: tx.version_number(F.concat(F.lit("a.v1.v"), F.col("n").cast("string"))))
scalar("str_hash12", "substr(sha256(body_text), 1, 12)", lambda: tx.hash12("body_text"))
scalar("math_prf", "CASE WHEN n % 3 > 0 THEN n_chars / CAST(n % 3 AS DOUBLE) ELSE 0.0 END", lambda: maths.ratio(F.col("n_chars"), F.col("n") % 3))
scalar("math_round", "round_even(n_chars / 8, 2)", lambda: maths.half_even(F.col("n_chars") / 8, 2))
scalar("math_cost", "(n_chars * 0.5 + n * 2.5) / 1000000.0::DOUBLE", lambda: maths.cost_usd(F.col("n_chars"), F.col("n"), F.lit(0.5), F.lit(2.5)))
scalar("math_floordiv", "(n_chars * n) // 7", lambda: maths.pro_rata(F.col("n_chars"), F.col("n"), F.lit(7)))
#: Local wall time, a month of the year by id, and the offset of the zone in it.
_LOCAL = "(coalesce(date_utc, TIMESTAMP '2024-02-01') + to_months(CAST(n % 12 AS INTEGER)))"
_OFFSET = f"CASE WHEN {_LOCAL} >= TIMESTAMP '2024-03-10 03:00:00' AND {_LOCAL} < TIMESTAMP '2024-11-03 02:00:00' THEN 4 ELSE 5 END"


def _sent():
    local = F.expr("coalesce(date_utc, timestamp '2024-02-01') + make_ym_interval(0, cast(n % 12 as int))")
    formats = ("EEEE, MMMM d, yyyy h:mm a", "EEEE, MMMM d, yyyy h:mm:ss a", "MMMM d, yyyy h:mm a", "M/d/yyyy h:mm a", "M/d/yy h:mm a")
    raw = F.lit(None).cast("string")
    for k, f in enumerate(formats):
        raw = F.when(F.col("n") % 5 == k, F.date_format(local, f)).otherwise(raw)
    return stamp_of(dates.sent_utc(F.when(F.col("n") % 7 == 0, F.lit("some day")).otherwise(raw)))


scalar("dt_sent", f"CASE WHEN n % 7 <> 0 THEN strftime({_LOCAL} + to_hours({_OFFSET}), '%Y-%m-%d %H:%M:%S') END", _sent)
scalar("json_verdict", "CASE WHEN n % 4 = 0 THEN NULL ELSE 'responsive' END", lambda: parse_verdict(F.when(F.col("n") % 4 == 0, F.lit("no answer {")).when(F.col("n") % 4 == 1, F.lit('{"decision":"responsive","confidence":0.5,"rationale":"r"}')).otherwise(F.lit('first {"decision":"x","confidence":1,"rationale":"{}"} then ```{"decision":"responsive","confidence":0.9,"rationale":"{a}"}```')))["decision"])
scalar("json_headers", "'{\"a\":\"' || lang || '\",\"b\":\"' || custodian || '\"}'", lambda: tx.headers_json(F.create_map(F.lit("b"), F.col("custodian"), F.lit("a"), F.col("lang"))))
scalar("json_tags", "lang", lambda: F.element_at(tx.tags_map(F.array(F.struct(F.lit("k").alias("name"), F.col("custodian").alias("value")), F.struct(F.lit("k").alias("name"), F.col("lang").alias("value")))), "k"))
scalar("dt_gap", "coalesce(n % 61 * 2 > 60, false)", lambda: dates.gap_over(F.timestamp_seconds(F.pmod(F.col("n"), F.lit(61)) * 2 * 86400), F.timestamp_seconds(F.lit(0)), 60))


def stamp_of(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("str_shingles", r", ws AS (SELECT doc_id, list_filter(regexp_split_to_array(body_norm, '\s+'), lambda x: x <> '') AS w FROM mn) SELECT doc_id, CAST(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS BIGINT) AS v FROM ws")
def _(s, d):
    return views.normed(s, d).select("doc_id", F.size(tx.shingles_of(tx.words("body_norm"), 3)).cast("long").alias("v"))


_DOC = "'<document>' || chr(10) || '<metadata>' || chr(10) || 'custodian: ' || custodian || chr(10) || 'from: None' || chr(10) || 'to: a; b' || chr(10) || 'cc: ' || chr(10) || 'date: None' || chr(10) || 'subject: ' || subject || chr(10) || 'attachments: ' || chr(10) || '</metadata>' || chr(10) || '<body>' || chr(10) || body_text || chr(10) || '</body>' || chr(10) || '</document>'"


def _rendering(s, d) -> DataFrame:
    none, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    m = views.messages(s, d)
    return m.withColumns({"from_addr": none, "to": F.array(F.lit("a"), F.lit("b")), "cc": no_list, "date_raw": none, "attachment_names": no_list})


@query("str_render", f"SELECT doc_id, sha256({_DOC}) AS v FROM m")
def _(s, d):
    return _rendering(s, d).select("doc_id", F.sha2(tx.render_document(), 256).alias("v"))


@query("msg_render", f"SELECT doc_id, sha256('{PROTOCOL.content}' || chr(10) || chr(10) || {_DOC}) AS v FROM m")
def _(s, d):
    return _rendering(s, d).select("doc_id", F.sha2(tx.message(F.lit(PROTOCOL.content), tx.render_document()), 256).alias("v"))


# --- near duplicates and the preprocessing report -----------------------------------------------------------------------

_EDGES = _CANON + """, e3 AS (SELECT doc_id, date_utc, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS sh FROM el WHERE len(ws) >= 30),
ex2 AS (SELECT doc_id, len(sh) AS n, hash(unnest(sh)) AS s FROM e3),
pr2 AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM ex2 a JOIN ex2 b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
ed AS (SELECT a, b, i / (na + nb - i) AS j FROM pr2 WHERE i / (na + nb - i) >= 0.85)
"""
_STARS = _EDGES + """, ag AS (SELECT doc_id, row_number() OVER (ORDER BY date_utc NULLS LAST, doc_id) AS age FROM e3),
nb AS (SELECT x.age AS v, y.age AS u, j FROM ed JOIN ag x ON x.doc_id = a JOIN ag y ON y.doc_id = b UNION ALL SELECT y.age, x.age, j FROM ed JOIN ag x ON x.doc_id = a JOIN ag y ON y.doc_id = b),
od AS (SELECT v, list(u) FILTER (u < v) AS earlier, row_number() OVER (ORDER BY v) AS k FROM nb GROUP BY v),
st AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS centers
  UNION ALL SELECT od.k, CASE WHEN list_has_any(st.centers, coalesce(od.earlier, [])) THEN st.centers ELSE list_append(st.centers, od.v) END FROM st JOIN od ON od.k = st.k + 1),
ce AS (SELECT unnest(centers) AS c FROM st WHERE k = (SELECT max(k) FROM st)),
ab AS (SELECT v, min(u) AS c FROM nb WHERE u < v AND u IN (SELECT c FROM ce) AND v NOT IN (SELECT c FROM ce) GROUP BY v),
mb AS (SELECT ab.v, ab.c, nb.j FROM ab JOIN nb ON nb.v = ab.v AND nb.u = ab.c UNION ALL SELECT DISTINCT c, c, 1.0 FROM ab),
ne AS (SELECT m.doc_id, 'near-' || c.doc_id AS cluster_id, c.doc_id AS canonical_doc_id, round_even(mb.j, 6) AS jaccard_to_canonical FROM mb JOIN ag m ON m.age = mb.v JOIN ag c ON c.age = mb.c)
"""
_NEAR = _EDGES + "SELECT a, b, round_even(j, 6) AS jaccard FROM ed"


@query("sim_jaccard", _NEAR)
def _(s, d):
    e = dedup.jaccard_edges(dedup.signatures(dedup.eligible(*_canonicals(s, d))), 0.85)
    return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.bround("jaccard", 6).alias("jaccard"))


@query("ded_near", "RECURSIVE" + _STARS + "SELECT doc_id, cluster_id, canonical_doc_id, jaccard_to_canonical FROM ne")
def _(s, d):
    return dedup.near_clusters(*_canonicals(s, d)).drop("minhash_seed_version")


@query("ded_near_minhash", "RECURSIVE" + _STARS + "SELECT doc_id, cluster_id, canonical_doc_id, jaccard_to_canonical FROM ne")
def _(s, d):
    """By bands of minima: candidates are confirmed exactly, and a pair at the threshold is missed once in more than 10,000 times."""
    return dedup.near_clusters(*_canonicals(s, d), mode="minhash").drop("minhash_seed_version")


_REPORT = "RECURSIVE" + _STARS + ", tc AS (SELECT *, CAST([] AS VARCHAR[]) AS attachment_names FROM ca)" + _THREAD.replace("FROM tm)", "FROM tc)") + """
SELECT (SELECT count(*) FROM ex) AS messages, (SELECT count(*) FROM ca) AS canonical_docs, (SELECT count(*) FROM ex WHERE dup_rank > 0) AS exact_dup_docs,
  (SELECT count(*) FROM ne) AS near_dup_docs, (SELECT count(DISTINCT cluster_id) FROM ne) AS near_clusters, (SELECT count(DISTINCT thread_id) FROM rs) AS threads,
  (SELECT count(*) FROM (SELECT thread_id FROM rs GROUP BY 1 HAVING count(*) = 1)) AS singleton_threads,
  (SELECT count(*) FROM rs WHERE inclusive_reason = 'terminal_node') AS terminal_node, (SELECT count(*) FROM rs WHERE inclusive_reason = 'unique_content') AS unique_content,
  (SELECT count(*) FROM rs WHERE inclusive_reason IS NOT NULL) AS inclusive_docs"""
_REPORTED = ("messages", "canonical_docs", "exact_dup_docs", "near_dup_docs", "near_clusters", "threads", "singleton_threads", "terminal_node", "unique_content", "inclusive_docs")


def _reported(s, report: dict) -> DataFrame:
    flat = report | {k: report["inclusive"].get(k, 0) for k in ("terminal_node", "unique_content")}
    return s.createDataFrame([tuple(int(flat[k]) for k in _REPORTED)], ", ".join(f"{k} long" for k in _REPORTED))


@query("agg_preproc", _REPORT)
def _(s, d):
    m = cut(views.normed(s, d).select("doc_id", "subject_norm", "body_norm", "date_utc").withColumn("attachment_names", F.array().cast("array<string>")))
    exact = cut(dedup.exact_clusters(m))
    canonicals = dedup.canonical(m, exact)
    return _reported(s, preprocess.report(exact, cut(dedup.near_clusters(canonicals, m)), cut(threads.threads(canonicals)), m, preprocess.Params()))


@query("pre_run", _REPORT)
def _(s, d):
    """The run itself over a stored table, twice: the second one finds the report and resumes."""
    root = scratch(s)
    m = views.normed(s, d)
    for f in schemas.MESSAGES:
        if f.name not in m.columns:
            m = m.withColumn(f.name, (F.array() if f.dataType.typeName() == "array" else F.lit(None)).cast(f.dataType))
    tables.write_table(m.select([f.name for f in schemas.MESSAGES]), root, "docs", "messages", ["doc_id"])
    with tempfile.TemporaryDirectory() as folder:  # the driver's report
        path = Path(folder) / "report.json"
        if [preprocess.run(s, root, "docs", path) for _ in range(2)] != [0, 0]:
            raise checks.CheckError("the run did not finish")
        return _reported(s, json.loads(path.read_text()))


# --- review ------------------------------------------------------------------------------------------------------------


@query("idm_build", "SELECT doc_id, '3.' || n AS trec_doc_id, 'filename' AS match_method, 1.0::DOUBLE AS confidence, false AS ambiguous FROM m")
def _(s, d):
    from ..sources.messages import id_map

    return id_map(views.messages(s, d), F.concat(F.lit("3."), F.col("n").cast("string")), "docs").drop("corpus")


@query("rev_scope1", _MAPPED + "SELECT DISTINCT doc_id FROM mj WHERE topic = 'toxic' AND doc_id IS NOT NULL")
def _(s, d):
    return dec.tier1_scope(views.messages(s, d), _mapped(s, d), "toxic")


@query("rev_scope2", "SELECT DISTINCT doc_id FROM cur WHERE topic = 'toxic' AND tier = 1 AND decision = 'borderline'")
def _(s, d):
    return dec.tier2_scope(views.decisions(s, d), "toxic", views.VERSION)


@query("rev_scored", "SELECT DISTINCT doc_id FROM cur WHERE topic = 'toxic'")
def _(s, d):
    return dec.scored(views.decisions(s, d), "toxic", views.VERSION, "responsiveness", None)


def _requests(s, d) -> DataFrame:
    m = _rendering(s, d).withColumn("token_estimate", tx.token_estimate("body_text"))
    return review.requests(m, PROTOCOL, RUN)


@query("rev_requests", f"SELECT doc_id || '__7__resp__t1__topic-v1' AS custom_id, 'small' AS model, 512 AS max_tokens, sha256('{PROTOCOL.content}' || chr(10) || chr(10) || {_DOC}) AS content_hash FROM m")
def _(s, d):
    return _requests(s, d).select("custom_id", "model", "max_tokens", F.sha2("content", 256).alias("content_hash"))


@query("rev_chunk", "SELECT CAST(floor((row_number() OVER (ORDER BY n) - 1) / 400) AS INTEGER) AS k, count(*) OVER () AS total FROM m QUALIFY (row_number() OVER (ORDER BY n) - 1) % 400 = 0")
def _(s, d):
    c = review.chunked(_requests(s, d), RUN.chunk_rows)
    return c.groupBy(F.col("chunk").alias("k")).agg(F.count("*").alias("own")).withColumn("total", F.sum("own").over(Window.partitionBy(F.lit(1)))).select("k", "total")


@query("rev_estimate", f""", c AS (SELECT count(*) AS n, sum(length(body_text) // 4) AS t FROM m), k AS (SELECT unnest(range(0, CAST(ceil(n / 400) AS BIGINT))) AS chunk, n, t FROM c),
z AS (SELECT CAST(chunk AS INTEGER) AS chunk, least(400, n - chunk * 400) AS n_requests, t, n FROM k)
SELECT chunk, n_requests, CAST(t * n_requests // n AS BIGINT) AS doc_tokens, round_even(((t * n_requests // n + n_requests * {PROTOCOL.tokens}) * 0.5 + n_requests * 512 * 2.5) / 1000000.0::DOUBLE, 4) AS usd FROM z""")
def _(s, d):
    return review.chunk_estimates(review.chunked(_requests(s, d), RUN.chunk_rows), PROTOCOL, RUN, BUDGET)


@query("rev_decision", "SELECT doc_id, 'responsive' AS decision, 0.9::DOUBLE AS confidence, round_even((100 * 0.5 + 20 * 2.5) / 1000000.0::DOUBLE, 6) AS cost_usd FROM m WHERE n % 3 <> 0")
def _(s, d):
    r = _requests(s, d).join(views.messages(s, d).select("doc_id", "n"), "doc_id")
    answer = F.when(F.col("n") % 3 == 0, "no verdict").otherwise('{"decision": "responsive", "confidence": 0.9, "rationale": "r"}')
    results = r.select("custom_id", F.lit("succeeded").alias("type"), answer.alias("text"), F.lit(100).alias("input_tokens"), F.lit(20).alias("output_tokens"))
    return review.decisions_of(results, PROTOCOL, RUN, "b1", BUDGET)[0].select("doc_id", "decision", "confidence", "cost_usd")


@query("rev_capcheck", "SELECT event_type AS phase, sum(value) > 1.0 AS over FROM events WHERE event_type = 'view' GROUP BY 1", plain=True)
def _(s, d):
    ledger = views.ledger(s, d)
    try:
        spend.check("view", 0.0, ledger, BUDGET)
        over = False
    except spend.BudgetExceeded:
        over = True
    return s.createDataFrame([("view", over)], "phase string, over boolean")


_POLICIES = ORACLE["agg_policy"].removeprefix(views.SQL).rpartition("SELECT *, CASE")[0]


@query(
    "qrl_run",
    _POLICIES + _FOLD + _RELCUST.rpartition("SELECT topic, custodian")[0] + """
SELECT topic, 'judged' AS part, '' AS name, CAST(sum(judged) AS DOUBLE) AS v FROM cells GROUP BY topic
UNION ALL SELECT topic, 'relevant', '', CAST(sum(rel) AS DOUBLE) FROM cells GROUP BY topic
UNION ALL SELECT topic, 'estimated_r', '', round_even(sum(CASE WHEN judged > 0 THEN rel / judged * n ELSE 0 END), 2) FROM cells GROUP BY topic
UNION ALL SELECT topic, policy || '.' || k, '', v FROM (UNPIVOT (SELECT topic, policy, judged, covered, relevant, covered_rel FROM z) ON judged, covered, relevant, covered_rel INTO NAME k VALUE v)
UNION ALL SELECT topic, 'fold.judged', custodian, count(*) FROM fo GROUP BY topic, custodian
UNION ALL SELECT topic, 'fold.relevant', custodian, CAST(sum(relevance) AS DOUBLE) FROM fo GROUP BY topic, custodian
UNION ALL SELECT topic, 'top', custodian, n FROM ranked WHERE rank <= 15
UNION ALL SELECT topic, 'custodians', '', custodians FROM about UNION ALL SELECT topic, 'unmapped', '', unmapped FROM about""",
)
def _(s, d):
    """The whole coverage report, in rows."""
    report = coverage.report(views.judgment_lines(s, d), views.id_map(s, d), views.messages(s, d), _owners(s, d))
    rows = []
    for topic, r in report["topics"].items():
        rows += [(topic, k, "", r[k]) for k in ("judged", "relevant", "estimated_r")]
        rows += [(topic, f"{p}.{k}", "", n[k]) for p, n in r["policies"].items() for k in ("judged", "covered", "relevant", "covered_rel")]
        rows += [(topic, f"fold.{k}", c, n[k]) for c, n in r["per_custodian_fold"].items() for k in ("judged", "relevant")]
        full = r["relevant_by_custodian_full"]
        rows += [(topic, "top", c, n) for c, n in full["top"].items()] + [(topic, k, "", full[k]) for k in ("custodians", "unmapped")]
    return s.createDataFrame([(t, p, n, float(v)) for t, p, n, v in rows], "topic string, part string, name string, v double")


@query(
    "acq_verify",
    """WITH f AS (SELECT source AS folder, source || '/' || lang || '.txt ' || sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id) || chr(10)) AS line FROM documents GROUP BY source, lang)
    SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM f""",
    plain=True,
)
def _(s, d):
    """A folder of one file for each source and language, written by tasks and read back."""
    path = scratch(s)
    rows = views.table(s, d, "documents").groupBy("source", "lang").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), "\n").alias("t"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = FileSystem.from_uri(path)
        for batch in batches:
            for r in batch.to_pylist():
                store.create_dir(f"{at}/{r['source']}")
                with store.open_output_stream(f"{at}/{r['source']}/{r['lang']}.txt") as out:
                    out.write(f"{r['t']}\n".encode())
            yield batch.select(["source"])

    rows.mapInArrow(write, "source string").count()
    return s.createDataFrame([(tables.directory_digest(s, path),)], "digest string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prf(spark, sf_dir)


from . import archives, streams  # noqa: E402, F401  register their queries here
