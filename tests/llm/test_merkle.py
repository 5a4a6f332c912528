"""Merkle manifest against a plain tree, tampering, and odd cases."""

import hashlib
import zlib
from collections import Counter

import pytest
from edge import corpus, frame, odd

from pyspark.sql import functions as F

from docketry.llm import common, merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row, text):
    doc, _, lang, source, n = row
    return h(*map(field, (doc, source, lang, n, text)))


def lowered(t):
    return t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def tree(nodes, fanout):
    """Root, and for every node its siblings level by level as (before, after)."""
    steps = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        new, new_under = [], []
        for lo in range(0, len(nodes), fanout):
            run = nodes[lo : lo + fanout]
            for k in range(len(run)):
                for i in under[lo + k]:
                    steps[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            new.append(h(*run))
            new_under.append([i for u in under[lo : lo + fanout] for i in u])
        nodes, under = new, new_under
    return nodes[0], steps


def brute(rows, fanout=8):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for x in langs}
    trees = {x: tree([leaf(r, r[1]) for r in parts[x]], fanout) for x in langs}
    root, top = tree([trees[x][0] for x in langs], fanout)
    out = []
    for x, high in zip(langs, top, strict=True):
        for r, steps in zip(parts[x], trees[x][1], strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf(r, lowered(r[1]) if hit else r[1])
            for a, b in steps + high:
                now = h(a, now, b)
            out.append((r[0], leaf(r, r[1]), trees[x][0], root, h("".join(a + b for a, b in steps + high)), now, now == root))
    return out


def save(df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def rows_of(df):
    return Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect())


@pytest.mark.parametrize("n", [1, 65])
def test_merkle_equals_plain_trees(spark, tmp_path, n):
    rows = corpus(n, seed=n)
    assert rows_of(merkle.op11_merkle(spark, save(frame(spark, rows), tmp_path))) == Counter(brute(rows))


def test_merkle_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, many languages, long texts, clashing names."""
    rows = odd() + corpus(30) + [(i, f"Text {i}", f"l{i % 70}", "s", i) for i in range(-5, 140)] + [(7, "Twice", "en", "s", 1)] * 40 + [(7, "", "", "", 0)]
    docs = frame(spark, rows)
    for c in ("tree", "number", "n", "digest", "path", "tie", "level", "children", "seen"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = rows_of(merkle.op11_merkle(spark, save(docs, tmp_path)))
    assert got == Counter(brute(rows))
    assert {k[-1] for k in got} == {True, False}


def test_merkle_of_nothing(spark, tmp_path):
    got = merkle.op11_merkle(spark, save(frame(spark, []), tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_any_change_is_seen(spark):
    """With another fanout; a change of any field of a row breaks its proof, and only its."""
    rows = corpus(50)
    docs = frame(spark, rows, extra=False)
    for c, changed in (("text", F.concat("text", F.lit("."))), ("lang", F.lit("xx")), ("n_chars", F.lit(None).cast("long")), ("source", F.lit(None).cast("string"))):
        seen = merkle.leaf_of([F.when(F.col("doc_id") == 17, changed).otherwise(F.col(c)) if c == f else F.col(f) for f in merkle.FIELDS])
        got = merkle.manifest(docs, fanout=3, seen=seen).filter(merkle.folded(F.col("seen"), F.col("path")) != F.col("root")).collect()
        assert [r["doc_id"] for r in got] == [17], c
    assert {r["root"] for r in merkle.manifest(docs, fanout=3).collect()} == {brute(rows, 3)[0][3]}


def test_numbers_of_one_key_in_many_slices(spark):
    """One key with nearly all rows, one id with a third of them: numbers go through, no slice holds the key."""
    rows = spark.range(3000).select(F.when(F.col("id") % 50 == 0, F.lit("b")).otherwise(F.lit("a")).alias("k"), F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") * 7 % 3001).alias("v"), F.col("id").alias("tie"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # too few rows for more than one range otherwise
    try:
        got = common.numbered(rows, "k", "v", "tie").toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for _, part in got.groupby("k"):
        part = part.sort_values("number")
        assert list(part["number"]) == list(range(len(part))) and (part["n"] == len(part)).all()
        assert part[["v", "tie"]].apply(tuple, axis=1).is_monotonic_increasing
    assert got[got.k == "a"].groupby("slice").size().max() < 1500
