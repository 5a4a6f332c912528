"""Reviews by chunks that leave each decision and each ledger row once, however often a chunk is run again.

A chunk's rows (requests, results, decisions, spend) are written under its batch id and the name of the attempt; then one row in the commit log
names the attempt that counts. Readers join rows to commits, so what an attempt left behind that failed anywhere before is never seen, and a
chunk that has a commit is not submitted again. The batch id is a hash of the run and of the chunk's first request, so a run that starts anew finds its commits.

Chunks are in flight side by side, each with its own Spark jobs. Before one is submitted, the budget must hold what is spent, what is in flight at its
worst case, and the chunk itself. After a stop, by budget or by failure, what was submitted is drained: it ends, is committed and paid.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas
from ..session import cut, shared_folder
from ..sources.tables import read_log
from . import spend
from .review import Outcome, Protocol, Reviewer, Run, chunk_estimates, chunked, decisions_of

COMMITS = "committed_at timestamp, batch_id string, attempt string"


@dataclass(frozen=True)
class Store:
    """Folders of a review: one for each kind of rows, and the commit log."""

    root: str

    def write(self, rows: DataFrame, kind: str, batch_id: str, attempt: str) -> None:
        rows.write.mode("overwrite").json(f"{self.root}/{kind}/batch={batch_id}/attempt={attempt}")

    def commit(self, spark: SparkSession, batch_id: str, attempt: str) -> None:
        """A folder of its own, as writers that share one take away each other's temporary files."""
        row = spark.range(1).select(F.current_timestamp().alias("committed_at")).coalesce(1)
        row.write.mode("overwrite").json(f"{self.root}/commits/batch_id={batch_id}/attempt={attempt}")

    def commits(self, spark: SparkSession) -> DataFrame:
        """batch_id, attempt: of attempts that were committed side by side, the first counts."""
        found = read_log(spark, f"{self.root}/commits", StructType.fromDDL(COMMITS))
        return found.groupBy("batch_id").agg(F.min_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))

    def has(self, spark: SparkSession, batch_id: str) -> bool:
        return bool(self.commits(spark).filter(F.col("batch_id") == batch_id).limit(1).count())

    def read(self, spark: SparkSession, kind: str, schema: StructType) -> DataFrame:
        """Committed rows of a kind; the folders of other attempts are pruned by the join's keys."""
        own = [f.name for f in schema]
        rows = read_log(spark, f"{self.root}/{kind}", StructType([*schema.fields, StructField("batch", StringType()), StructField("attempt", StringType())]))
        won = self.commits(spark).select(F.col("batch_id").alias("__b"), F.col("attempt").alias("__a"))
        return rows.join(won, (F.col("batch") == F.col("__b")) & (F.col("attempt") == F.col("__a")), "left_semi").select(own)


@dataclass(frozen=True)
class Chunks:
    """A run cut into chunks: where its requests are stored, and (chunk, n_requests, usd, batch_id) of each."""

    requests: DataFrame
    chunks: list[Row]
    protocol: Protocol
    run: Run
    budget: spend.Budget


def plan(requests: DataFrame, protocol: Protocol, run: Run, budget: spend.Budget) -> Chunks:
    """Cut requests into chunks of ``run.chunk_rows`` and store them by chunk, so that each is read once; a row a chunk comes to the driver."""
    spark = requests.sparkSession
    folder = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    cut_up = chunked(requests, run.chunk_rows)
    cut_up.repartition("chunk").write.partitionBy("chunk").parquet(folder)
    rows = spark.read.schema(cut_up.schema).parquet(folder)
    firsts = rows.groupBy("chunk").agg(F.min("custom_id").alias("first"))
    batch_id = F.substring(F.sha2(F.concat_ws("|", F.lit(f"{run}|{protocol.version}"), F.col("chunk").cast("string"), "first"), 256), 1, 16)
    found = chunk_estimates(rows, protocol, run, budget).join(firsts, "chunk").select("chunk", "n_requests", "usd", batch_id.alias("batch_id"))
    return Chunks(rows, found.orderBy("chunk").collect(), protocol, run, budget)


def review_batch(
    requests: DataFrame, batch_id: str, n_requests: int, of: Chunks, reviewer: Reviewer, store: Store, wire: Callable[[DataFrame], DataFrame] = lambda d: d,
    before_commit: Callable[[str], None] = lambda batch_id: None,
) -> float:
    """Submit one batch, write what comes of it, and commit; its cost. Does nothing for a batch that has a commit."""
    spark, run = requests.sparkSession, of.run
    if store.has(spark, batch_id):
        return 0.0
    attempt = uuid.uuid4().hex
    store.write(requests, "requests", batch_id, attempt)
    results = cut(reviewer(requests))
    store.write(results, "results", batch_id, attempt)
    found, failures = decisions_of(results, of.protocol, run, batch_id, of.budget)
    store.write(schemas.conform(wire(cut(found)), schemas.DECISIONS), "decisions", batch_id, attempt)
    store.write(failures, "failures", batch_id, attempt)
    used = results.filter(F.col("type") == "succeeded").agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("i"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("o")).first()
    price = of.budget.prices[run.model]
    cost = (used["i"] * price["input"] + used["o"] * price["output"]) / 1_000_000
    # the running sum is made when the ledger is read (spend.cumulative): chunks end in any order
    row = spark.range(1).select(
        F.current_timestamp().cast("string").alias("ts"), F.lit(batch_id).alias("batch_id"), F.lit(run.budget_phase).alias("phase"), F.lit(run.corpus).alias("corpus"),
        F.lit(run.topic).alias("topic"), F.lit(run.model).alias("model"), F.lit(n_requests).alias("n_requests"), F.lit(used["i"]).alias("input_tokens"),
        F.lit(used["o"]).alias("output_tokens"), F.lit(round(cost, 6)).alias("cost_usd"), F.lit(None).cast("double").alias("cumulative_usd"),
    )
    store.write(schemas.conform(row, schemas.SPEND), "ledger", batch_id, attempt)
    before_commit(batch_id)
    store.commit(spark, batch_id, attempt)
    return cost


def review_all(
    of: Chunks, reviewer: Reviewer, store: Store, in_flight: int = 4, wire: Callable[[DataFrame], DataFrame] = lambda d: d, before_commit: Callable[[str], None] = lambda batch_id: None
) -> Outcome:
    """Review all chunks that have no commit yet, at most ``in_flight`` at a time; a stop or failure drains what was submitted.

    Where the budget does not hold the next chunk beside the worst case of those in flight, they are waited for, as they mostly cost less; only if it does not hold
    then does the run stop. A failed chunk leaves the others to end, and then raises.
    """
    spark = of.requests.sparkSession
    spent = spend.spent(store.read(spark, "ledger", schemas.SPEND))
    have = {r["batch_id"] for r in store.commits(spark).join(spark.createDataFrame([(c["batch_id"],) for c in of.chunks], "batch_id string"), "batch_id", "left_semi").collect()} if of.chunks else set()
    done, running, broken = Outcome([], None), dict[Future, Row](), list[BaseException]()

    def ended(futures) -> None:
        for f in futures:
            c = running.pop(f)
            if f.exception():
                broken.append(f.exception())
                continue
            done.batches.append(c["batch_id"])
            for k in (of.run.budget_phase, None):
                spent[k] = spent.get(k, 0.0) + f.result()

    def fits(usd: float) -> None:
        spend.check(of.run.budget_phase, usd + sum(c["usd"] for c in running.values()), spent, of.budget)

    with ThreadPoolExecutor(in_flight) as pool:
        for c in of.chunks:
            if c["batch_id"] in have:
                continue
            while len(running) >= in_flight:
                ended(wait(running, return_when=FIRST_COMPLETED).done)
            try:
                fits(c["usd"])
            except spend.BudgetExceeded:
                ended(wait(running).done)
                try:
                    fits(c["usd"])
                except spend.BudgetExceeded as e:
                    done.stopped = str(e)
                    break
            if broken:
                break
            part = of.requests.filter(F.col("chunk") == c["chunk"]).drop("chunk")  # one folder
            work = inheritable_thread_target(spark)(lambda part=part, c=c: review_batch(part, c["batch_id"], c["n_requests"], of, reviewer, store, wire, before_commit))
            running[pool.submit(work)] = c
        ended(wait(running).done)
    if broken:
        raise broken[0]
    done.batches.sort()
    return done


def stream_sink(of: Chunks, reviewer: Reviewer, store: Store, name: str, wire: Callable[[DataFrame], DataFrame] = lambda d: d) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink of requests: a micro-batch that runs again after its commit adds nothing, before it replaces what is left of it.

    The budget is checked against committed spend at the batch's worst case; over it, the query ends with an error and the batch stays for the next start.
    ``of`` gives protocol, run and budget; its own requests are not read.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, f"{name}-{batch_id}"
        if store.has(spark, own):
            return
        rows = cut(batch.withColumn("chunk", F.lit(batch_id)))
        for c in chunk_estimates(rows, of.protocol, of.run, of.budget).collect():  # none for an empty batch
            spend.check(of.run.budget_phase, c["usd"], store.read(spark, "ledger", schemas.SPEND), of.budget)
            review_batch(rows.drop("chunk"), own, c["n_requests"], of, reviewer, store, wire)

    return run
