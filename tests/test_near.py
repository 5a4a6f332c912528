"""Star clusters on chains, of equal sets, and the filters of the exact join."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_operators import DAY, msgs

from docketry.operators import dedup, graph


def greedy(n, edges):
    near = {}
    for a, b in edges:
        near.setdefault(max(a, b), set()).add(min(a, b))
    center, of = set(), {}
    for v in range(n):
        hit = sorted(near.get(v, set()) & center)
        if hit:
            of[v] = hit[0]
        else:
            center.add(v)
    return of | {c: c for c in of.values()}


def frame(spark, edges):
    return spark.createDataFrame([(f"{min(e):06d}", f"{max(e):06d}", min(e), 0.9) for e in edges], "a string, b string, age_a int, jaccard double")


def rounds_of(monkeypatch):
    seen, of = [], dedup._round
    monkeypatch.setattr(dedup, "_round", lambda *a: seen.append(1) or of(*a))
    return seen


def test_a_chain_of_ten_thousand(spark, monkeypatch):
    """Each version is near the next one only: every other one is a center, in a few rounds, as in a pass."""
    n, seen = 10_000, rounds_of(monkeypatch)
    edges = [(k, k + 1) for k in range(n - 1)]
    got = {int(r["doc_id"]): int(r["center"]) for r in dedup.stars(frame(spark, edges)).collect()}
    assert got == greedy(n, edges) and len(seen) < 20


@pytest.mark.parametrize("solved", [1_000_000, 3])
def test_graphs_with_chains(spark, monkeypatch, solved):
    """Chains, trees and tangles in one graph; components that are too large for one task go on by rounds, without an end to them."""
    rng, edges, n = random.Random(solved), set(), 0
    for size in (2, 3, 7, 12, 25, 30):
        edges |= {(n + k, n + k + 1) for k in range(size - 1)} if size < 25 else {tuple(sorted(rng.sample(range(n, n + size), 2))) for _ in range(size + 10)}
        n += size
    got = {int(r["doc_id"]): int(r["center"]) for r in dedup.stars(frame(spark, sorted(edges)), rounds=2, solved=solved).collect()}
    assert got == greedy(n, edges)


def test_components_of_strings(spark):
    links = [("b", "a"), ("c", "b"), ("x", "y"), ("z", "z"), ("d", "c")]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_equal_sets_are_one(spark):
    """Bodies that differ in the number of repeats have equal sets of shingles; the clusters are those of a pass over all documents."""
    rng = random.Random(3)
    rows = []
    for k in range(6):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(300)}" for _ in range(40)]
        near = list(base)
        near[5] = "changed"
        for v in range(5):
            w = (base if v % 2 or k % 3 == 0 else near) * 2
            rows.append((f"m{k}{v}", f"s{k}{v}", " ".join(w * (v + 1) + w[:2]), DAY + timedelta(days=rng.randrange(9)), []))
    m = msgs(spark, rows)
    got = {r["doc_id"]: (r["canonical_doc_id"], r["jaccard_to_canonical"]) for r in dedup.near_clusters(m, m, 0.85).collect()}
    sets = {r[0]: {tuple(w[i : i + 3]) for w in [r[2].split()] for i in range(len(w) - 2)} for r in rows}
    assert len({frozenset(s) for s in sets.values()}) < len(rows) - 10
    centers, want = [], {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        s = sets[r[0]]
        hit = next((c for c in centers if len(s & sets[c]) / len(s | sets[c]) >= 0.85), None)
        if hit is None:
            centers.append(r[0])
        else:
            want[r[0]] = (hit, round(len(s & sets[hit]) / len(s | sets[hit]), 6))
            want[hit] = (hit, 1.0)
    assert got == want and len(got) > 20


def test_exact_join_at_many_thresholds(spark):
    """Sets of every size and likeness, against all pairs."""
    rng = random.Random(8)
    sets = []
    for _ in range(25):
        base = [rng.randrange(400) for _ in range(rng.choice([1, 2, 3, 5, 10, 40]))]
        for _ in range(4):
            sets.append(sorted({x if rng.random() > 0.12 else rng.randrange(400) for x in base}))
    df = spark.createDataFrame([(f"d{k:03d}", k, s) for k, s in enumerate(sets)], "doc_id string, k int, sh array<long>").select("doc_id", F.struct("k").alias("age"), "sh")
    for t in (0.3, 0.5, 0.8, 0.85, 1.0):
        got = {(r["a"], r["b"]): r["jaccard"] for r in dedup.jaccard_edges(df, t).collect()}
        want = {}
        for i, a in enumerate(sets):
            for j in range(i):
                s, x = set(a), set(sets[j])
                if len(s & x) / len(s | x) >= t:
                    want[(f"d{j:03d}", f"d{i:03d}")] = len(s & x) / len(s | x)
        assert got == pytest.approx(want) and want
