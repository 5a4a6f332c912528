"""Guards: they run one aggregate and raise on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckError(ValueError):
    pass


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts; null keys count too."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """The frame, if its keys are unique."""
    some = repeated(df, *keys).orderBy(*keys).limit(3).collect()
    if some:
        raise CheckError(f"repeated {keys}: {[tuple(r[k] for k in keys) for r in some]}")
    return df


def many_to_one(right: DataFrame, *keys: str) -> DataFrame:
    """The right side of a many-to-one join: null keys off, since they match nothing; repeated keys raise."""
    right = right.filter(" and ".join(f"`{k}` is not null" for k in keys))
    return unique(right, *keys)


def expected_count(df: DataFrame, n: int | None) -> int:
    got = df.count()
    if n is not None and got != n:
        raise CheckError(f"{got} rows, expected {n}")
    return got


def failure_rate(parsed: DataFrame, failures: DataFrame) -> DataFrame:
    """parsed, failed, rate; the rate of nothing at all is 1."""
    both = parsed.select(F.lit(0).alias("bad")).unionByName(failures.select(F.lit(1).alias("bad")))
    sums = both.agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("failed"))
    return sums.select((F.col("n") - F.col("failed")).alias("parsed"), "failed", F.when(F.col("n") > 0, F.col("failed") / F.col("n")).otherwise(F.lit(1.0)).alias("rate"))


def gate(ok: bool, report: str) -> int:
    """Exit code of a finished stage: 0 or 1 (2 is for what a stage needs and lacks)."""
    if not ok:
        print(f"gate not met: {report}")
    return 0 if ok else 1


def positive_weights(qrels: DataFrame) -> DataFrame:
    bad = qrels.filter("sampling_weight <= 0").limit(1).count()
    if bad:
        raise CheckError("a sampling weight is not positive")
    return qrels
