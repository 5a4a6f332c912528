"""Streams over the append-only logs, and reviews driven by them.

Batch remains authoritative: undated messages have no place in an event-time session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import decisions, spend


def decision_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The decision log as a stream, with its fixed schema."""
    return spark.readStream.schema(schemas.DECISIONS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def ledger_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.SPEND).option("maxFilesPerTrigger", files_per_trigger).json(path)


def deduplicated(log: DataFrame, delay: str = "7 days") -> DataFrame:
    """Decisions once each, however often a file is delivered again within the delay."""
    return log.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["decision_id"])


def decision_counts(log: DataFrame, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Decisions by day, topic and kind; late ones count until the watermark passes."""
    kept = log.withWatermark("created_at", delay)
    return kept.groupBy(F.window("created_at", window), "topic", "decision").agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost_usd"))


def sessions(messages: DataFrame, gap_days: int = 60, delay: str = "1 day") -> DataFrame:
    """Conversations of dated messages: a gap over ``gap_days`` starts a new one, as in the batch operator."""
    kept = messages.filter("date_utc is not null and coalesce(subject_norm, '') <> ''").withWatermark("date_utc", delay)
    return kept.groupBy("subject_norm", F.session_window("date_utc", f"{gap_days} days")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def decision_state(state_path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink of new decisions as Parquet, a version for each batch; nothing written before is read or rewritten.

    A batch that is run again after a failure rewrites its own version only, so the outcome is the same.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        schemas.conform(batch, schemas.DECISIONS).write.mode("overwrite").parquet(f"{state_path}/v={batch_id}")

    return write


def latest_decisions(spark: SparkSession, state_path: str) -> DataFrame:
    """The current decisions of all versions, as the batch operator has them: what any version supersedes is gone, in whatever order they came."""
    every = spark.read.schema(schemas.DECISIONS).parquet(f"{state_path}/v=*")
    return decisions.current(every.dropDuplicates(["decision_id"]))


def budget_guard(budget: spend.Budget, phase: str, projected_usd: float, ledger: Callable[[], DataFrame], submit: Callable[[DataFrame, int], None]):
    """A ``foreachBatch`` sink that submits a micro-batch only while the ledger leaves room; else it stops the query."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spend.check(phase, projected_usd, ledger(), budget)
        submit(batch, batch_id)

    return run
