"""Keyed state of current decisions, and chunks that leave each row once."""

import time

import pytest
from pyspark.sql import functions as F
from test_plans import BUDGET, answering, candidates, decision

from docketry import schemas
from docketry.operators import chunks, decisions, review, spend
from docketry.sources import tables
from docketry.streaming import logs, state

PROTOCOL = review.Protocol("topic7", "topic7.v1", "Judge the document.")
RUN = review.Run("docs", "7", "responsiveness", 1, "m", "dev", 64, 10)


def ids(df):
    return sorted(r["decision_id"] for r in df.collect())


def test_state_in_any_order_and_after_a_restart(spark, tmp_path):
    """Successors before predecessors, chains, rows that come again, a null document: after each start the state is what the batch operator makes of the log so far."""
    path, at = str(tmp_path / "log"), str(tmp_path)
    parts = [
        [("b", "d1", None, "a"), ("x", "d2", None, None)],
        [("c", "d1", None, "b"), ("x", "d2", None, None), ("n", None, None, None)],
        [("a", "d1", None, None), ("y", "d2", None, "x"), ("z", "d2", None, "y"), ("k", "d3", None, "never"), ("k", "d3", None, "never")],
        [("b", "d1", None, "a"), ("m", None, None, "n"), ("q", "d9", None, None)],
    ]
    for rows in parts:
        tables.append_log(decision(spark, rows).coalesce(1), path)
        state.follow(logs.decision_stream(spark, path, 1), f"{at}/ck", f"{at}/changes", 120)
        want = ids(decisions.current(tables.read_log(spark, path).dropDuplicates(["decision_id"])))
        assert ids(state.current(spark, f"{at}/ck")) == want == ids(state.current_by_changes(spark, f"{at}/changes"))
    assert want == ["c", "k", "m", "q", "z"]
    row = state.current(spark, f"{at}/ck").filter("decision_id = 'c'").first()
    assert row["doc_id"] == "d1" and row["supersedes"] == "b" and state.current(spark, f"{at}/ck").schema == schemas.DECISIONS


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    """The last batch's commit is lost: it runs again from the state before it."""
    path, at = str(tmp_path / "log"), str(tmp_path)
    for rows in ([("a", "d1", None, None)], [("b", "d1", None, "a"), ("c", "d2", None, None)]):
        tables.append_log(decision(spark, rows).coalesce(1), path)
        state.follow(logs.decision_stream(spark, path), f"{at}/ck", f"{at}/changes", 120)
    for name in ("1", ".1.crc"):
        (tmp_path / "ck" / "commits" / name).unlink(missing_ok=True)
    state.follow(logs.decision_stream(spark, path), f"{at}/ck", f"{at}/changes", 120)
    assert ids(state.current(spark, f"{at}/ck")) == ["b", "c"] == ids(state.current_by_changes(spark, f"{at}/changes"))


def plan(spark, run=RUN, n=25):
    return chunks.plan(review.requests(candidates(spark, n), PROTOCOL, run), PROTOCOL, run, BUDGET)


def counts(spark, store):
    rows = {r["doc_id"]: r["n"] for r in store.read(spark, "decisions", schemas.DECISIONS).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    return rows, store.read(spark, "ledger", schemas.SPEND)


def test_failures_before_the_commit(spark, tmp_path):
    """Twice everything is written and nothing committed: nothing is read, and the third time leaves each row once. A fourth run does nothing."""
    store, of, seen = chunks.Store(str(tmp_path / "s")), plan(spark), []

    def fails(batch_id):
        seen.append(batch_id)
        raise OSError("lost")

    for n in (1, 2):
        with pytest.raises(OSError, match="lost"):
            chunks.review_all(of, answering, store, in_flight=1, before_commit=fails)
        assert len(seen) == n and counts(spark, store)[0] == {} and counts(spark, store)[1].count() == 0
    assert len(list((tmp_path / "s" / "decisions").glob("*/attempt=*"))) == 2
    out = chunks.review_all(of, answering, store)
    assert out.batches == sorted(c["batch_id"] for c in of.chunks) and out.stopped is None
    for _ in range(2):
        rows, ledger = counts(spark, store)
        assert rows == {f"d{i:02d}": 1 for i in range(25) if i not in (1, 2, 3)}
        assert ledger.count() == 3 and ledger.agg(F.sum("n_requests"), F.sum("input_tokens")).first()[:] == (25, 2400)
        assert chunks.review_all(plan(spark), answering, store).batches == []  # a run that starts anew


def test_a_failure_drains_what_is_in_flight(spark, tmp_path):
    """One chunk's reviewer fails while others run: these end, are committed and paid; the next run does the failed one only."""
    store, of = chunks.Store(str(tmp_path / "s")), plan(spark)
    bad = of.chunks[0]["batch_id"]
    together, most = [0], [0]

    def slow(requests):
        together[0] += 1
        most[0] = max(most[0], together[0])
        time.sleep(1)
        together[0] -= 1
        return answering(requests)

    def fails(batch_id):
        if batch_id == bad:
            raise OSError("lost")

    with pytest.raises(OSError):
        chunks.review_all(of, slow, store, in_flight=3, before_commit=fails)
    assert most[0] > 1 and {r["batch_id"] for r in store.commits(spark).collect()} == {c["batch_id"] for c in of.chunks} - {bad}
    assert chunks.review_all(of, slow, store).batches == [bad] and len(counts(spark, store)[0]) == 22


def test_a_budget_stop_drains(spark, tmp_path):
    """The cap holds one chunk at its worst case beside the cost of another: the first is waited for, the second still goes, the third does not."""
    store, of = chunks.Store(str(tmp_path / "s")), plan(spark, n=30)
    usd = of.chunks[0]["usd"]
    cost = 10 * (100 * 0.5 + 10 * 2.5) / 1e6
    assert cost < usd
    held = spend.Budget(BUDGET.prices, {"dev": usd + 1.5 * cost}, 100.0)
    out = chunks.review_all(chunks.Chunks(of.requests, of.chunks, PROTOCOL, RUN, held), answering, store)
    assert out.stopped and "dev" in out.stopped and len(out.batches) == 2
    rows, ledger = counts(spark, store)
    assert ledger.count() == 2 and len(rows) > 10 and spend.spent(ledger)["dev"] <= held.caps["dev"]
    running = spend.cumulative(ledger.withColumn("ts", F.col("ts").cast("timestamp")), ["ts", "batch_id"], "ts")
    assert running.agg(F.max("cumulative_usd")).first()[0] == pytest.approx(spend.spent(ledger)["dev"])


def test_two_commits_of_one_batch(spark, tmp_path):
    """Two drivers that commit the same batch: the first commit counts for all readers."""
    store = chunks.Store(str(tmp_path / "s"))
    row = spark.createDataFrame([("d1",)], "doc_id string")
    schema = row.schema
    for attempt in ("later", "earlier"):
        store.write(row.withColumn("doc_id", F.lit(attempt)), "decisions", "b", attempt)
    assert store.read(spark, "decisions", schema).count() == 0 and not store.has(spark, "b")
    store.commit(spark, "b", "earlier")
    time.sleep(0.01)
    store.commit(spark, "b", "later")
    assert [r[0] for r in store.read(spark, "decisions", schema).collect()] == ["earlier"] and store.has(spark, "b")


def test_stream_sink(spark, tmp_path):
    """A micro-batch fails after writing, runs again and again: one commit; over the budget it raises and leaves nothing."""
    store, of = chunks.Store(str(tmp_path / "s")), plan(spark)
    batch = of.requests.drop("chunk")
    sink = chunks.stream_sink(of, answering, store, "q")
    kept, chunks.Store.commit = chunks.Store.commit, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    try:
        with pytest.raises(OSError):
            sink(batch, 0)
    finally:
        chunks.Store.commit = kept
    for _ in range(2):
        sink(batch, 0)
        rows, ledger = counts(spark, store)
        assert len(rows) == 22 and set(rows.values()) == {1} and ledger.count() == 1
    sink(batch.limit(0), 1)
    tight = chunks.Chunks(of.requests, [], PROTOCOL, RUN, spend.Budget(BUDGET.prices, {"dev": 1e-9}, 100.0))
    with pytest.raises(spend.BudgetExceeded):
        chunks.stream_sink(tight, answering, store, "q")(batch, 2)
    assert counts(spark, store)[1].count() == 1
