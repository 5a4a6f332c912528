"""Judgments: cells and weights of stratified samples, coverage, policies for parts, custodians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import half_even
from ..functions.text import is_part, parent_doc
from .windows import top_n


def _judged() -> Column:
    return F.col("rel") >= 0


def cells(lines: DataFrame) -> DataFrame:
    """n, judged, rel for each (topic, stratum) of ``lines(topic, trec_doc_id, stratum, rel)``; rel -1 is sampled but not judged."""
    return lines.groupBy("topic", "stratum").agg(
        F.count("*").alias("n"), F.count_if(_judged()).alias("judged"), F.count_if(F.col("rel") == 1).alias("rel")
    )


def weighted(lines: DataFrame) -> DataFrame:
    """Judged rows with their cell's weight n / judged to six places: few cells, so the aggregate is joined back, not windowed."""
    cell = cells(lines).filter("judged > 0").select("topic", "stratum", half_even(F.col("n") / F.col("judged"), 6).alias("sampling_weight"))
    return lines.filter(_judged()).join(cell, ["topic", "stratum"]).select("topic", "trec_doc_id", F.col("rel").alias("relevance"), "stratum", "sampling_weight")


def estimated_relevant(lines: DataFrame) -> DataFrame:
    """Sum over strata of rel / judged * n, to two places, for each topic."""
    share = F.when(F.col("judged") > 0, F.col("rel") / F.col("judged") * F.col("n")).otherwise(F.lit(0.0))
    return cells(lines).groupBy("topic").agg(half_even(F.sum(share), 2).alias("estimated_r"))


def coverage(qrels: DataFrame, idmap: DataFrame) -> DataFrame:
    """judged, mapped, coverage for each topic and, as topic null, for the sum of topics: a document in two counts twice."""
    docs = qrels.select("topic", "trec_doc_id").distinct()
    known = idmap.select(F.col("trec_doc_id").alias("__t")).distinct()
    each = docs.join(known, F.col("trec_doc_id") == F.col("__t"), "left").groupBy("topic").agg(F.count("*").alias("judged"), F.count("__t").alias("mapped"))
    both = each.rollup("topic").agg(F.sum("judged").alias("judged"), F.sum("mapped").alias("mapped"))
    return both.select("topic", "judged", "mapped", half_even(F.col("mapped") / F.col("judged"), 6).alias("coverage"))


def policies(judged: DataFrame, idmap: DataFrame) -> DataFrame:
    """Coverage for each topic under three policies for parts of documents, in one pass.

    raw: a part is a document of its own; fold_to_parent: its parent is looked up; exclude_parts: parts are left out.
    """
    known = idmap.select(F.col("trec_doc_id").alias("__k")).distinct()
    part, doc = is_part("trec_doc_id"), F.col("trec_doc_id")
    cases = F.array(
        F.struct(F.lit("raw").alias("policy"), doc.alias("look")),
        F.struct(F.lit("fold_to_parent").alias("policy"), F.when(part, parent_doc(doc)).otherwise(doc).alias("look")),
        F.when(~part, F.struct(F.lit("exclude_parts").alias("policy"), doc.alias("look"))),
    )
    rows = judged.select("topic", "trec_doc_id", "relevance", F.explode(cases).alias("c")).filter("c is not null").select("topic", "relevance", "c.*")
    hit = rows.join(known, F.col("look") == F.col("__k"), "left")
    covered, relevant = F.col("__k").isNotNull(), F.col("relevance") == 1
    agg = hit.groupBy("topic", "policy").agg(
        F.count("*").alias("judged"), F.count_if(covered).alias("covered"), F.count_if(relevant).alias("relevant"), F.count_if(covered & relevant).alias("covered_rel")
    )
    share = lambda a, b: F.when(F.col(b) > 0, half_even(F.col(a) / F.col(b), 6)).otherwise(F.lit(0.0))
    return agg.withColumns({"coverage": share("covered", "judged"), "coverage_rel": share("covered_rel", "relevant")})


def with_custodian(judged: DataFrame, idmap: DataFrame, messages: DataFrame, fold: bool = True) -> DataFrame:
    """Judged rows with the custodian of their (parent's) message, two joins; rows without one are left out."""
    look = F.when(is_part("trec_doc_id"), parent_doc("trec_doc_id")).otherwise(F.col("trec_doc_id")) if fold else F.col("trec_doc_id")
    ids = idmap.select(F.col("trec_doc_id").alias("__t"), F.col("doc_id").alias("__d"))
    owners = messages.select(F.col("doc_id").alias("__m"), "custodian")
    return judged.withColumn("__look", look).join(ids, F.col("__look") == F.col("__t")).join(owners, F.col("__d") == F.col("__m")).drop("__look", "__t", "__d", "__m")


def by_custodian(judged: DataFrame) -> DataFrame:
    """judged and relevant rows for each (topic, custodian)."""
    return judged.groupBy("topic", "custodian").agg(F.count("*").alias("judged"), F.sum("relevance").alias("relevant"))


def relevant_with_custodian(judged: DataFrame, owners: DataFrame) -> DataFrame:
    """topic, trec_doc_id, custodian (null: unmapped) of relevant documents; ``owners(trec_doc_id, custodian)``."""
    own = owners.select(F.col("trec_doc_id").alias("__t"), "custodian")
    return judged.filter("relevance = 1").select("topic", "trec_doc_id").join(own, F.col("trec_doc_id") == F.col("__t"), "left").drop("__t")


def relevant_custodians(judged: DataFrame, owners: DataFrame, top: int = 15) -> DataFrame:
    """Per topic the ``top`` custodians by relevant documents, with the number of custodians and of unmapped documents; ties go by name."""
    hit = relevant_with_custodian(judged, owners)
    n = hit.groupBy("topic", "custodian").agg(F.count("*").alias("n"))
    about = n.groupBy("topic").agg(F.count("custodian").alias("custodians"), F.coalesce(F.sum(F.when(F.col("custodian").isNull(), F.col("n"))), F.lit(0)).alias("unmapped"))
    best = top_n(n.filter("custodian is not null"), "topic", [F.col("n").desc(), F.col("custodian")], top)
    return best.join(about, "topic")


def grades(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy("topic", "relevance").agg(F.count("*").alias("n"))


def window_weights(lines: DataFrame) -> DataFrame:
    """The same weights by a window over (topic, stratum): for small strata, saves the join."""
    w = Window.partitionBy("topic", "stratum")
    ratio = F.count("*").over(w) / F.count_if(_judged()).over(w)
    return lines.withColumn("w", F.when(_judged(), ratio)).filter(_judged()).select("topic", "trec_doc_id", "stratum", half_even(F.col("w"), 6).alias("sampling_weight"))
