"""The pipeline's stages, one after another, against brute force on odd and planted documents."""

import random
from collections import Counter

import corpus_pipeline as p
from edge import SCHEMA, frame, odd
from test_dedup_ops import brute_lines, brute_scan, kept_text, reached, similarity
from test_models import toxic_rows
from test_other_ops import water

from docketry.llm import toxicity

ITEMS = [(1, "an item of the benchmark that has more than ten words so it makes several windows in all")]


def tables(spark, path, rows, labels, items=ITEMS):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(1)
    made = toxic_rows(300)
    rows = [(r[0], f"{r[1]}\nunique line number {r[0]} of this document {rng.random()} stays as it is", *r[2:5]) for r in made]
    rows += odd()
    rows += [(400 + k, rows[k][1] + "\none more line that nobody else has in this corpus at all", "en", "s0", 1) for k in range(5)]
    rows += [(500, f"{rows[7][1]} {ITEMS[0][1]}", "en", "s1", 1)]
    sf = tables(spark, tmp_path, rows, [(r[0], 1, r[5]) for r in made])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {}
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/out{k}")
            out = spark.read.parquet(f"{tmp_path}/out{k}")
        held[name] = [tuple(r) for r in out.collect()]
        docs = out
    first = held["toxicity"]
    chain = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    scores = [(r["doc_id"], r["score"]) for r in toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), chain).collect()]
    assert Counter(r[0] for r in first) == Counter(i for i, s in scores if s < 0.3)
    toxic = {r[0] for r in made if r[5]}
    left = {r[0] for r in first}
    assert len(toxic & left) <= 0.05 * len(toxic) and len(left - toxic) >= 0.95 * len({r[0] for r in rows} - toxic)
    gone = brute_lines(first)
    want = Counter((r[0], kept_text(r, gone)) for r in first)
    assert Counter((r[0], r[1]) for r in held["line_dedup"]) == want
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in held["line_dedup"])
    lines = held["line_dedup"]
    stay = Counter((r[0], r[1]) for r in held["simhash"])
    for r in lines:  # what goes has a smaller id in its group, which stays; what is alone stays
        near = [x for x in lines if similarity(x[1], r[1]) >= 0.8]
        if r[0] is None or all(x[1] == r[1] and x[0] == r[0] for x in near):
            assert stay[r[0], r[1]]
        elif not stay[r[0], r[1]]:
            group = reached(lines, r[1])
            assert any(x[0] is not None and x[0] < r[0] and stay[x[0], x[1]] and x[1] in group for x in lines)
    texts = Counter(" ".join((r[1] or "").lower().split()) for r in held["simhash"] if r[0] is not None)
    assert max(n for t, n in texts.items()) <= 2  # rows that repeat id and text stay together
    hits = {r[0]: brute_scan(r[1], ITEMS) for r in held["simhash"]}
    assert hits[500][4] or 500 not in hits
    after = {r[0]: r[1] for r in held["decontamination"]}
    for r in held["simhash"]:
        if r[0] is not None and not hits[r[0]][4]:
            assert after[r[0]] == r[1]
    assert not any(brute_scan(t, ITEMS)[4] for t in after.values())
    sizes = {}
    for r in held["decontamination"]:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    target = water(sizes)
    for r in held["mixing"]:
        assert abs(r[4] - target[r[1]]) < 1e-6
    assert sorted(map(repr, (tuple(r) for r in p.run(spark, sf).collect()))) == sorted(map(repr, held["mixing"]))


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    sf = tables(spark, tmp_path, [], [], [])
    assert p.run(spark, sf).count() == 0
    docs = frame(spark, odd())
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert "clash" in {r["score"] for r in docs.select("score").collect()}, name
    assert p.mix_sources(spark, docs, sf).count() == docs.count()
