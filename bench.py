"""Headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line of median warm seconds.

``rates`` has documents a second of the ingest of archives that are packed before the clock starts, and of the preprocessing chain (exact and
near duplicates, threads) over stored messages; ``mb_rates`` the same in MB of bodies.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

ROUNDS = int(os.environ.get("BENCH_ROUNDS", "3"))
HEADLINE = ["val_eval", "agg_policy", "agg_coverage", "join_relcust", "smp_devset", "ded_exact", "thr_build", "ded_near", "agg_cumsum", "str_bodynorm", "str_shingles", "rev_requests", "rev_estimate"]


def chains(spark, sf_dir: str) -> dict:
    """Documents, MB of their bodies, and a function for each chain."""
    from docketry import views
    from docketry.operators import dedup, threads
    from docketry.plans import archives as packed
    from docketry.plans.catalogue import scratch
    from docketry.sources import archives, messages

    from pyspark.sql import functions as F

    m = views.messages(spark, sf_dir)
    n, size = m.agg(F.count("*"), F.sum(F.octet_length("body_text")) / 1e6).first()
    row_of = lambda r: (f"dir/{r.n:09d}", f"From:\t{r.custodian} <a@b.c>\nTo:\t{r.lang}; x\nSubject:\t{r.subject}\n\n{r.body_text}")
    tgz = packed._write(spark, m, packed._tar("w:gz", row_of), "part{}.tgz")
    zips = packed._write(spark, m.select("n"), packed._pack_zip, "edrm-enron-v2_c{}_xml.zip")
    stored = scratch(spark)
    views.normed(spark, sf_dir).select("doc_id", "subject_norm", "body_norm", "date_utc").selectExpr("*", "cast(array() as array<string>) as attachment_names").write.parquet(stored)

    def noop(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def preprocess() -> None:
        rows = spark.read.parquet(stored)
        exact = dedup.exact_clusters(rows).cache()
        noop(exact)
        canonicals = dedup.canonical(rows, exact)
        noop(dedup.near_clusters(canonicals, rows))
        noop(threads.threads(canonicals))
        exact.unpersist()

    return {
        "ingest_tgz": (n, size, lambda: noop(messages.tab_texts(archives.tar(spark, files=spark.read.parquet(tgz))))),
        "ingest_zip": (n, 0.0, lambda: noop(messages.load_zips(spark, files=spark.read.parquet(zips), partitions=8).messages)),
        "preprocess": (n, size, preprocess),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from docketry.plans.catalogue import QUERIES
    from docketry.session import session

    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(ROUNDS)), 3)
    rates, mb_rates = {}, {}
    for name, (documents, mb, run) in chains(spark, sf_dir).items():
        run()
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 3)
        rates[name] = round(documents / seconds[name])
        if mb:
            mb_rates[name] = round(mb / seconds[name], 1)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rates": rates, "mb_rates": mb_rates, "sf": float(scale[1]) if scale else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
