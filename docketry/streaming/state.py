"""Current decisions as keyed state: a stream over the log that holds, for each document, what is live and what was superseded.

The state of a document has two maps by decision id: ``live`` with the rows that nothing supersedes, and ``gone`` with the ids that some row named, by which
a decision that comes after its successor is known as superseded when it arrives. So any order of arrival ends in the same state,
and a file that is delivered again changes nothing. A batch costs what is new in it; the log before is not read again.

The state lives in RocksDB stores with their durable copies in the query's checkpoint. ``current`` reads the live rows from there, and
``changes`` is the stream of what became live or stopped being so. Decision ids are unique and a decision supersedes one of its own document, as the log has it; a null
document is one document.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .. import schemas

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "doc_id string, decision_id string, change int, row string"


class CurrentDecisions(StatefulProcessor):
    """Rows (doc_id, decision_id, supersedes, row) of one document, in any order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "decision_id string", "row string")
        self.gone = handle.getMapState("gone", "decision_id string", "by string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        changes: dict[str, tuple[int, str]] = {}  # what came and went within the batch cancels out
        for r in rows:
            own, old = (r.decision_id,), (r.supersedes,)
            if not self.gone.containsKey(own) and not self.live.containsKey(own):
                self.live.updateValue(own, (r.row,))
                changes[r.decision_id] = (1, r.row)
            if r.supersedes is None or self.gone.containsKey(old):
                continue
            self.gone.updateValue(old, (r.decision_id,))
            if self.live.containsKey(old):
                row = self.live.getValue(old)[0]
                self.live.removeKey(old)
                if changes.pop(r.supersedes, None) is None:
                    changes[r.supersedes] = (-1, row)
        for decision_id, (change, row) in changes.items():
            yield Row(doc_id=key[0], decision_id=decision_id, change=change, row=row)

    def close(self) -> None:
        pass


def changes(log: DataFrame) -> DataFrame:
    """``CHANGES`` of a stream of decisions: 1 for a row that is live now, -1 for one that no longer is. Output mode update."""
    rows = log.select("doc_id", "decision_id", "supersedes", F.to_json(F.struct(*log.columns)).alias("row"))
    return rows.groupBy("doc_id").transformWithState(statefulProcessor=CurrentDecisions(), outputStructType=CHANGES, outputMode="Update", timeMode="None")


def follow(log: DataFrame, checkpoint: str, changes_path: str, timeout: int | None = None) -> None:
    """Bring the state in ``checkpoint`` up to date with a stream of decisions, and end.

    Changes are written as Parquet, a folder for each batch; a batch that is run again rewrites its own.
    """
    spark = log.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes_path}/batch={batch_id}")

    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, PROVIDER)
    try:
        query = changes(log).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream did not end in {timeout} seconds")


def current(spark: SparkSession, checkpoint: str, schema: StructType = schemas.DECISIONS) -> DataFrame:
    """The live decisions, from the state as the last batch left it."""
    live = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "live").load()
    return live.select(F.from_json(F.col("user_map_value.row"), schema).alias("r")).select("r.*")


def current_by_changes(spark: SparkSession, changes_path: str, schema: StructType = schemas.DECISIONS) -> DataFrame:
    """The same from what ``follow`` wrote, for readers without the checkpoint."""
    every = spark.read.schema(f"{CHANGES}, batch long").parquet(changes_path)
    net = every.groupBy("decision_id").agg(F.sum("change").alias("n"), F.first("row").alias("row")).filter("n > 0")
    return net.select(F.from_json("row", schema).alias("r")).select("r.*")
