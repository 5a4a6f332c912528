"""The decision log: current rows, what was scored, scopes, candidates, supersedes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import CheckError, many_to_one
from .sampling import qc_sample


def current(log: DataFrame) -> DataFrame:
    """Rows that no row supersedes; one level, by id. Null references match nothing."""
    gone = log.select(F.col("supersedes").alias("__gone")).filter("__gone is not null").distinct()
    return log.join(gone, F.col("decision_id") == F.col("__gone"), "left_anti")


def _of(topic: str, version: str, tier: int | None = None, phase: str | None = None) -> Column:
    c = (F.col("topic") == topic) & (F.col("prompt_version") == version)
    c = c & (F.col("tier") == tier) if tier is not None else c
    return c & (F.col("phase") == phase) if phase is not None else c


def scored(log: DataFrame, topic: str, version: str, phase: str, tier: int | None) -> DataFrame:
    """doc_id of current decisions of a topic, phase and version; of any tier where ``tier`` is None."""
    return current(log.filter(F.col("topic") == topic)).filter(_of(topic, version, tier, phase)).select("doc_id").distinct()


def borderlines(log: DataFrame, topic: str, version: str) -> DataFrame:
    return current(log).filter(_of(topic, version, 1)).filter(F.col("decision") == "borderline").select("doc_id").distinct()


def tier1_scope(messages: DataFrame, mapped: DataFrame, topic: str, dev: DataFrame | None = None, all_docs: bool = False) -> DataFrame:
    """doc_id to review in tier 1: the sample, all documents, or all judged ones. ``mapped``: judgments with doc_id."""
    if dev is not None:
        return trec_to_doc(dev, mapped).select("doc_id").distinct()
    if all_docs:
        return messages.select("doc_id").distinct()
    return mapped.filter((F.col("topic") == topic) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def tier2_scope(log: DataFrame, topic: str, version: str, qc_fraction: float | None = None, seed: int = 1337) -> DataFrame:
    """Borderlines, or the quality-control sample of confident decisions."""
    if qc_fraction is None:
        return borderlines(log, topic, version)
    return qc_sample(current(log), topic, version, qc_fraction, seed).select("doc_id")


def trec_to_doc(ids: DataFrame, idmap: DataFrame) -> DataFrame:
    """``ids(trec_doc_id)`` with doc_id; repeated mappings and missing ids raise."""
    right = many_to_one(idmap.select("trec_doc_id", "doc_id"), "trec_doc_id")
    out = ids.join(right, "trec_doc_id", "left")
    lost = out.filter("doc_id is null").select("trec_doc_id").orderBy("trec_doc_id").limit(3).collect()
    if lost:
        raise CheckError(f"unmapped: {[r[0] for r in lost]}")
    return out


def candidates(scope: DataFrame, done: DataFrame) -> DataFrame:
    return scope.select("doc_id").distinct().join(done.select("doc_id"), "doc_id", "left_anti")


def fetch(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``messages`` for the ids, by id; a missing one raises."""
    lost = ids.join(messages.select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(3).collect()
    if lost:
        raise CheckError(f"not in messages: {[r[0] for r in lost]}")
    return messages.join(ids.select("doc_id"), "doc_id", "left_semi").orderBy("doc_id")


def wire_supersedes(new: DataFrame, log: DataFrame, topic: str, version: str) -> DataFrame:
    """Tier-2 decisions with the tier-1 decision that they replace."""
    old = current(log).filter(_of(topic, version, 1, "responsiveness")).select(F.col("doc_id").alias("__d"), F.col("decision_id").alias("__old"))
    old = many_to_one(old, "__d")
    takes = (F.col("tier") == 2) & (F.col("phase") == "responsiveness")
    return new.join(old, F.col("doc_id") == F.col("__d"), "left").withColumn("supersedes", F.when(takes, F.col("__old"))).drop("__d", "__old")
