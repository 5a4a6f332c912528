import json
import time

import pytest
from pyspark.sql import functions as F

from docketry import schemas
from docketry.operators import review, spend
from docketry.plans import preprocess, validate
from docketry.sources import tables
from docketry.streaming import logs
from test_operators import DAY, near_rows

BUDGET = spend.Budget({"m": {"input": 0.5, "output": 2.5}}, {"dev": 10.0, "tiny": 0.0001}, 100.0)


@pytest.fixture
def protocol(tmp_path):
    (tmp_path / "topic7.v1.md").write_text("Judge the document.")
    return review.load_protocol(tmp_path / "topic7.v1.md")


def test_protocols(tmp_path, protocol):
    assert protocol.version == "topic7.v1" and len(protocol.hash12) == 12 and protocol.tokens == 4
    for v in (9, 10):
        (tmp_path / f"topic7.v{v}.md").write_text("x")
    assert review.resolve_protocol(tmp_path, "topic7").name == "topic7.v10.md"
    assert review.resolve_protocol(tmp_path, "topic7", 1).name == "topic7.v1.md"
    with pytest.raises(FileNotFoundError):
        review.resolve_protocol(tmp_path, "topic7", 3)
    (tmp_path / "bad.md").write_text("x")
    with pytest.raises(ValueError):
        review.load_protocol(tmp_path / "bad.md")
    new = review.write_protocol(tmp_path / "p", "topic8", "Request: {request}", {"request": " all\n of it "})
    assert new.read_text() == "Request: all of it"
    assert review.write_protocol(tmp_path / "p", "topic8", "x {request}", {"request": "r"}) is None
    assert review.write_protocol(tmp_path / "p", "topic8", "x {request}", {"request": "r"}, 2).name == "topic8.v2.md"
    assert review.write_protocol(tmp_path / "p", "topic8", "x {request}", {"request": "r"}, 3) is None
    with pytest.raises(ValueError):
        review.write_protocol(tmp_path / "p", "topic9", "x {request}", {"request": " "})


def candidates(spark, n=25):
    rows = [(f"d{i:02d}", None, "a@b", ["x"], [], None, f"s{i}", ["f"], "text " * 40, 50) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, custodian string, from_addr string, to array<string>, cc array<string>, date_raw string, subject string, attachment_names array<string>, body_text string, token_estimate int")


def answering(requests):
    """Errs on d01, gives nonsense on d02, an invalid decision on d03."""
    doc = F.split("custom_id", "__")[0]
    good = F.lit('{"decision": "responsive", "confidence": 0.7, "rationale": "r"}')
    text = F.when(doc == "d02", "?").when(doc == "d03", F.regexp_replace(good, "responsive", "maybe")).otherwise(good)
    return requests.select("custom_id", F.when(doc == "d01", "errored").otherwise("succeeded").alias("type"), text.alias("text"), F.lit(100).alias("input_tokens"), F.lit(10).alias("output_tokens"))


def test_review_lifecycle(spark, tmp_path, protocol):
    run = review.Run("docs", "7", "responsiveness", 1, "m", "dev", 64, 10)
    chunks = review.chunked(review.requests(candidates(spark), protocol, run), 10)
    assert sorted(r["count"] for r in chunks.groupBy("chunk").count().collect()) == [5, 10, 10]
    content = chunks.filter("doc_id = 'd00'").first()["content"]
    assert content.startswith("Judge the document.\n\n<document>\n<metadata>\ncustodian: None\nfrom: a@b\nto: x\ncc: \ndate: None\nsubject: s0\nattachments: f\n</metadata>")
    paths = [str(tmp_path / p) for p in ("ledger", "log", "audit")]
    out = review.run_chunks(candidates(spark), protocol, run, answering, BUDGET, *paths)
    assert len(out.batches) == 3 and out.stopped is None
    log = tables.read_log(spark, paths[1])
    assert {r["doc_id"] for r in log.collect()} == {f"d{i:02d}" for i in range(25)} - {"d01", "d02", "d03"}
    assert log.filter("created_at is null or decision_id is null").count() == 0
    ledger = tables.read_log(spark, paths[0], schemas.SPEND).orderBy("cumulative_usd").collect()
    assert [r["cumulative_usd"] for r in ledger][-1] == pytest.approx(sum(r["cost_usd"] for r in ledger))
    assert sum(r["input_tokens"] for r in ledger) == 24 * 100  # what cannot be parsed is paid for, what erred is not
    assert spark.read.json(f"{paths[2]}/requests").count() == 25
    tiny = review.Run("docs", "7", "responsiveness", 1, "m", "tiny", 64, 10)
    none = review.run_chunks(candidates(spark).limit(0), protocol, run, answering, BUDGET, *[p + "0" for p in paths])
    assert none == review.Outcome([], None)
    stopped = review.run_chunks(candidates(spark), protocol, tiny, answering, BUDGET, *[p + "2" for p in paths])
    assert stopped.batches == [] and "tiny" in stopped.stopped


def test_preprocess_run(spark, tmp_path):
    rows = [(i, s, b, d, a) for i, s, b, d, a in near_rows()]
    df = spark.createDataFrame(rows, "doc_id string, subject_norm string, body_norm string, date_utc timestamp, attachment_names array<string>")
    for f in schemas.MESSAGES:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    root, report = str(tmp_path / "store"), tmp_path / "report.json"
    assert preprocess.run(spark, root, "docs", report) == 2
    tables.write_table(df.select([f.name for f in schemas.MESSAGES]), root, "docs", "messages")
    params = preprocess.Params(near_dup_threshold=0.6, boilerplate_body_min_repeats=5)
    assert preprocess.run(spark, root, "docs", report, params) == 0
    got = json.loads(report.read_text())
    assert got["messages"] == len(rows) and got["canonical_docs"] + got["exact_dup_docs"] == len(rows) and got["boilerplate_bodies"] == 1
    assert got["near_clusters"] > 0 and got["inclusive_docs"] == got["threads"] and report.read_text().count('"ts"') == 0
    stamp = report.stat().st_mtime_ns
    assert preprocess.run(spark, root, "docs", report, params) == 0 and report.stat().st_mtime_ns == stamp  # resumed
    assert preprocess.run(spark, root, "docs", report) == 0 and report.stat().st_mtime_ns != stamp  # other parameters


def test_validate_run(spark, tmp_path):
    log = spark.createDataFrame([("1", "d1", "7", 1, "responsiveness", "p.v1", "responsive", None)], "decision_id string, doc_id string, topic string, tier int, phase string, prompt_version string, decision string, supersedes string")
    q = spark.createDataFrame([("7", "t1", 1, 2.0), ("7", "t2", 1, 1.0)], "topic string, trec_doc_id string, relevance int, sampling_weight double")
    m = spark.createDataFrame([("t1", "d1", False)], "trec_doc_id string, doc_id string, ambiguous boolean")
    assert validate.run(log, q, m, "c", "7", "p.v2", tmp_path) == 2
    assert validate.run(log, q, m, "c", "7", "p.v1", tmp_path, stratified=True) == 2  # t2 is unmapped
    dev = spark.createDataFrame([("t1",)], "trec_doc_id string")
    assert validate.run(log, q, m, "c", "7", "p.v1", tmp_path, dev=dev, stratified=True) == 0
    got = json.loads((tmp_path / "metrics_c_7_dev_v1.json").read_text())
    assert got["recall"] == 1.0 and got["estimator"] == "unweighted"
    assert validate.run(log, q.filter("trec_doc_id = 't1'"), m, "c", "7", "p.v1", tmp_path, stratified=True) == 0
    assert json.loads((tmp_path / "metrics_c_7_v1.json").read_text())["tp"] == 2.0


def decision(spark, rows):
    df = spark.createDataFrame(rows, "decision_id string, doc_id string, created_at timestamp, supersedes string")
    for f in schemas.DECISIONS:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select([f.name for f in schemas.DECISIONS])


def test_decision_stream(spark, tmp_path):
    path, state = str(tmp_path / "log"), str(tmp_path / "state")
    for rows in ([("1", "a", DAY, None), ("2", "b", DAY, None)], [("3", "a", DAY, "1"), ("2", "b", DAY, None)]):
        tables.append_log(decision(spark, rows), path)
        time.sleep(1.1)  # files are taken in order of their time
    stream = logs.decision_stream(spark, path, 1)
    q = stream.writeStream.foreachBatch(logs.decision_state(state)).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r["decision_id"] for r in logs.latest_decisions(spark, state).collect()} == {"2", "3"}
    q = logs.deduplicated(logs.decision_stream(spark, path)).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and spark.table("once").count() == 3
    q = logs.decision_counts(logs.decision_stream(spark, path)).writeStream.format("memory").outputMode("complete").queryName("counts").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and spark.table("counts").agg(F.sum("n")).first()[0] == 4


def test_budget_guard(spark, tmp_path):
    ledger = spark.createDataFrame([("dev", 9.5)], "phase string, cost_usd double")
    seen = []
    logs.budget_guard(BUDGET, "dev", 0.4, lambda: ledger, lambda b, i: seen.append(i))(ledger, 3)
    assert seen == [3]
    with pytest.raises(spend.BudgetExceeded):
        logs.budget_guard(BUDGET, "dev", 0.6, lambda: ledger, lambda b, i: seen.append(i))(ledger, 4)


def test_current_decisions_whatever_the_order(spark, tmp_path):
    """B replaces A and C replaces B, arriving as B, C, A: only C is current, in the stream as in batch; a batch run again changes nothing."""
    from docketry.operators import decisions as dec

    state = str(tmp_path / "state")
    sink = logs.decision_state(state)
    log = [[("b", "d1", "x", "a")], [("c", "d1", "y", "b")], [("a", "d1", "z", None)]]
    frames = []
    for k, rows in enumerate(log):
        frame = spark.createDataFrame(rows, "decision_id string, doc_id string, decision string, supersedes string")
        for f in schemas.DECISIONS:
            if f.name not in frame.columns:
                frame = frame.withColumn(f.name, F.lit(None).cast(f.dataType))
        frames.append(frame.select([f.name for f in schemas.DECISIONS]))
        sink(frames[-1], k)
    sink(frames[1], 1)
    got = [r["decision_id"] for r in logs.latest_decisions(spark, state).collect()]
    assert got == ["c"] == [r["decision_id"] for r in dec.current(frames[0].union(frames[1]).union(frames[2])).collect()]
