"""Table schemas, fixed once, and the cast-checked conformance that sinks enforce."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(*_field(f)) for f in spec.split()])


def _field(text: str) -> tuple[str, T.DataType]:
    name, _, kind = text.partition(":")
    kinds = {
        "": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(),
        "bool": T.BooleanType(), "ts": T.TimestampType(), "list": T.ArrayType(T.StringType()),
    }
    return name, kinds[kind]


MESSAGES = _schema(
    "doc_id corpus custodian source_file source_index:int message_id_hdr in_reply_to references:list from_addr from_name "
    "to:list cc:list bcc:list subject subject_norm date_utc:ts date_raw body_text body_norm body_hash has_attachments:bool "
    "attachment_count:int attachment_names:list headers_json parse_warnings:list token_estimate:int"
)
DEDUP_EXACT = _schema("dedup_key canonical_doc_id doc_id dup_rank:int")
DEDUP_NEAR = _schema("doc_id cluster_id canonical_doc_id jaccard_to_canonical:double minhash_seed_version")
THREADS = _schema("doc_id thread_id parent_doc_id depth:int method is_inclusive:bool inclusive_reason")
QRELS_RAW = _schema("corpus topic trec_doc_id relevance:int stratum sampling_weight:double")
DOC_ID_MAP = _schema("corpus doc_id trec_doc_id match_method confidence:double ambiguous:bool")
DECISIONS = _schema(
    "decision_id doc_id corpus topic phase tier:int model prompt_version prompt_hash batch_id custom_id decision "
    "confidence:double rationale input_tokens:long output_tokens:long cost_usd:double created_at:ts supersedes"
)
OVERRIDES = _schema("doc_id topic original_decision_id override_decision note override_at:ts")
SPEND = _schema(
    "ts batch_id phase corpus topic model n_requests:long input_tokens:long output_tokens:long cost_usd:double cumulative_usd:double"
)
FAILURES = _schema("docid zip error")
RUNS = T.StructType([*_schema("ts command argv:list exit_code:int").fields])

REGISTRY: dict[str, T.StructType] = {
    "messages": MESSAGES,
    "dedup_exact": DEDUP_EXACT,
    "dedup_near": DEDUP_NEAR,
    "threads": THREADS,
    "qrels_raw": QRELS_RAW,
    "doc_id_map": DOC_ID_MAP,
    "decisions": DECISIONS,
    "overrides": OVERRIDES,
    "judged_messages": MESSAGES,
    "judged_doc_id_map": DOC_ID_MAP,
    "failures": FAILURES,
}


def schema_of(table: str) -> T.StructType:
    """KeyError for a table that is not registered."""
    return REGISTRY[table]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order, cast; missing or extra columns raise, and so does a bad value (ANSI casts)."""
    wanted, got = [f.name for f in schema], df.columns
    if set(wanted) != set(got) or len(got) != len(wanted):
        raise ValueError(f"columns do not conform: missing {sorted(set(wanted) - set(got))}, extra {sorted(set(got) - set(wanted))}")
    return df.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(table))
