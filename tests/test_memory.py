"""What a task holds of long texts: row groups of stored tables, and chains of messages made without texts."""

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F
from test_operators import DAY, brute_threads, msgs

from docketry import schemas
from docketry.operators import threads
from docketry.sources import tables


def test_row_groups_of_long_texts_are_small(spark, tmp_path):
    """2,000 texts of 16 KB that do not compress well, in one file: 32 MB, and no row group near that."""
    long = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(256)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256)))
    df = spark.range(2000).coalesce(1).select(F.col("id").cast("string").alias("doc_id"), long.alias("body_norm"))
    for f in schemas.MESSAGES:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    tables.write_table(df.select([f.name for f in schemas.MESSAGES]), str(tmp_path), "docs", "messages", ["doc_id"])
    (file,) = (tmp_path / "messages/corpus=docs").glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
    assert sum(g.num_rows for g in groups) == meta.num_rows == 2000
    assert max(g.total_byte_size for g in groups) < 10_000_000 < sum(g.total_byte_size for g in groups)
    assert tables.read_table(spark, str(tmp_path), "docs", "messages").agg(F.sum(F.length("body_norm"))).first()[0] == 2000 * 256 * 64


def test_threads_chain_without_texts(spark, monkeypatch):
    """Chains see neither texts nor names, and texts are compared only where a thread has several messages."""
    rng, seen, compared = random.Random(5), [], []
    rows = [(f"d{k:03d}", rng.choice(["a", "b", "", None, f"own {k}"]), f"note {k % 6} ok", DAY, [f"f{k % 3}"] * (k % 2)) for k in range(90)]
    segments, containments = threads.segments, threads._containments
    monkeypatch.setattr(threads, "segments", lambda m, *a: seen.extend(m.columns) or segments(m, *a))
    monkeypatch.setattr(threads, "_containments", lambda m: compared.extend(r["thread_id"] for r in m.select("thread_id").collect()) or containments(m))
    got = {r["doc_id"]: tuple(r)[1:] for r in threads.threads(msgs(spark, rows)).collect()}
    assert got == brute_threads(rows)
    assert seen == ["doc_id", "subject_norm", "date_utc"]
    assert len(set(compared)) == 2 and all(compared.count(t) > 1 for t in compared)
