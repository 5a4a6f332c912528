"""Queries over logs that are written from the driver's tables and then followed as streams, or appended to with failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas, views
from ..operators import chunks, review
from ..session import cut
from ..sources import tables
from ..streaming import logs, state
from .catalogue import BUDGET, PROTOCOL, _requests, query, scratch


def _log(s: SparkSession, d: str) -> DataFrame:
    """All decisions as log rows; one in seven comes twice."""
    rows = views.decisions(s, d)
    rows = rows.withColumn("copy", F.explode(F.when(F.crc32("decision_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    for f in schemas.DECISIONS:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    return rows


@query("stream_current", "SELECT doc_id, topic, tier, decision, decision_id FROM cur")
def _(s, d):
    """The state of a stream that meets most replacements before what they replace: the log is dealt to files at random."""
    path, at = scratch(s), scratch(s)
    tables.append_log(_log(s, d).repartition(6, F.xxhash64("decision_id", "copy")).select([f.name for f in schemas.DECISIONS]), path)
    state.follow(logs.decision_stream(s, path, 3), f"{at}/checkpoint", f"{at}/changes")
    return state.current(s, f"{at}/checkpoint").select("doc_id", "topic", "tier", "decision", "decision_id")


@query("stream_changes", "SELECT doc_id, topic, tier, decision, decision_id FROM cur")
def _(s, d):
    """The same from the changes, with the log delivered in two parts to two runs of the stream."""
    path, at = scratch(s), scratch(s)
    rows = cut(_log(s, d))
    for part in (0, 1):
        tables.append_log(rows.filter(F.crc32("decision_id") % 2 == part).select([f.name for f in schemas.DECISIONS]), path)
        state.follow(logs.decision_stream(s, path), f"{at}/checkpoint", f"{at}/changes")
    return state.current_by_changes(s, f"{at}/changes").select("doc_id", "topic", "tier", "decision", "decision_id")


class Broken(RuntimeError):
    """A failure that is put in on purpose."""


def _reviewed(s: SparkSession, d: str) -> tuple[chunks.Store, chunks.Chunks]:
    """A review of all documents by chunks, of which some fail after their rows are written and before they are committed; run until nothing is left to do."""
    store = chunks.Store(scratch(s))
    m = views.messages(s, d).select("doc_id", "n")

    def reviewer(requests: DataFrame) -> DataFrame:
        answer = F.when(F.col("n") % 3 == 0, "no verdict").otherwise('{"decision": "responsive", "confidence": 0.9, "rationale": "r"}')
        own = requests.join(m, "doc_id")
        return own.select("custom_id", F.lit("succeeded").alias("type"), answer.alias("text"), F.lit(100).alias("input_tokens"), F.lit(20).alias("output_tokens"))

    tries: dict[str, int] = {}

    def breaks(batch_id: str) -> None:
        tries[batch_id] = tries.get(batch_id, 0) + 1
        if tries[batch_id] < (3 if len(tries) % 2 else 1):  # every other chunk, twice
            raise Broken(batch_id)

    n = m.count()
    run = review.Run("docs", "7", "responsiveness", 1, "small", "click", 512, max(200, n // 8))
    plan = chunks.plan(_requests(s, d), PROTOCOL, run, BUDGET)
    for _ in range(100):
        try:
            chunks.review_all(plan, reviewer, store, before_commit=breaks)
            break
        except Broken:
            continue
    return store, plan


@query(
    "rev_once",
    """SELECT doc_id, 1 AS n, round_even((100 * 0.5 + 20 * 2.5) / 1000000.0::DOUBLE, 6) AS cost_usd FROM m WHERE n % 3 <> 0""",
)
def _(s, d):
    """Decisions after failures between writing and committing: one for each request that has a verdict."""
    store, _ = _reviewed(s, d)
    return store.read(s, "decisions", schemas.DECISIONS).groupBy("doc_id").agg(F.count("*").cast("int").alias("n"), F.sum("cost_usd").alias("cost_usd"))


@query("led_once", "SELECT count(*) AS requests, 100 * count(*) AS input_tokens, 20 * count(*) AS output_tokens, true AS one_row_a_chunk FROM m")
def _(s, d):
    """The ledger of the same: every request is paid once."""
    store, plan = _reviewed(s, d)
    rows = store.read(s, "ledger", schemas.SPEND)
    sums = rows.agg(*(F.sum(c).alias(a) for c, a in (("n_requests", "requests"), ("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"))), (F.count("*") == len(plan.chunks)).alias("one_row_a_chunk"))
    return sums.select(*(F.col(c).cast("long").alias(c) for c in ("requests", "input_tokens", "output_tokens")), "one_row_a_chunk")
