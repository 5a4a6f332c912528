"""MinHash near-duplicates against brute force, families of copies, cells of lists, and odd rows."""

import random

import numpy as np
import pytest
from edge import WORDS, corpus, frame, odd

from pyspark.sql import functions as F

from docketry.llm import cells, minhash


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def set_of(text):
    w = words_of(text)
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset(map(tuple, [w] if w else []))


def brute(rows):
    """doc_id, n_shingles, component_id, kept of every row, by comparing all pairs of sets."""
    found = [set_of(r[1]) for r in rows]
    distinct = sorted({s for s in found if s}, key=sorted)
    root = list(range(len(distinct)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(distinct):
        for j, b in enumerate(distinct[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                root[top(i)] = top(j)
    at = {s: top(i) for i, s in enumerate(distinct)}
    least = {}
    for r, s in zip(rows, found, strict=True):
        if s and r[0] is not None:
            least[at[s]] = min(r[0], least.get(at[s], r[0]))
    out = []
    for r, s in zip(rows, found, strict=True):
        component = least.get(at[s]) if s else r[0]
        out.append((r[0], len(s), component, r[0] == component))
    return sorted(out, key=repr)


def rows_of(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def family(rng, n, length, share, first=0):
    """Copies of one text with up to ``share`` of the words changed, the original somewhere among them."""
    base = [f"{rng.choice(WORDS)}{rng.randrange(50)}" for _ in range(length)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(int(length * share) + 1) if i != n // 2 else 0):
            w[rng.randrange(length)] = f"q{rng.randrange(10**6)}"
        rows.append((first + i, " ".join(w), "en", "s", 1))
    return rows


@pytest.mark.parametrize("limits", [(minhash.SET_CELL, minhash.SIGNATURE_CELL), (700, 200)])
def test_components_equal_brute_force(spark, limits):
    """Families around the bound, of short and of long texts, in which most copies do not link with each other but through some."""
    rng = random.Random(limits[0])
    rows = corpus(60, seed=5) + odd()
    for k, (n, length, share) in enumerate([(40, 60, 0.1), (40, 60, 0.16), (30, 12, 0.2), (25, 200, 0.13), (15, 6, 0.2)]):
        rows += family(rng, n, length, share, 2000 + 100 * k)
    rng.shuffle(rows)
    want = brute(rows)
    assert rows_of(minhash.near_duplicates(frame(spark, rows), limit=limits[0], signature_limit=limits[1])) == want
    assert 20 < sum(not r[3] for r in want) < len(want) - 60


def test_chain_of_versions(spark):
    """Each version links with the next one only; all are one component."""
    base = [f"w{i}" for i in range(400)]
    rows = [(500 - k, " ".join(base[k * 15 : k * 15 + 150]), "en", "s", 1) for k in range(16)]
    want = brute(rows)
    assert rows_of(minhash.near_duplicates(frame(spark, rows))) == want
    assert {r[2] for r in want} == {485}


@pytest.mark.parametrize("limit", [minhash.SET_CELL, 2_000])
def test_many_copies_make_few_links(spark, limit):
    """n near copies and n exact ones, in one cell and in many: links stay below the number of texts, and all copies go."""
    rows = family(random.Random(4), 300, 80, 0.05) + [(1000 + i, "just the same words again and again " * 3, "en", "s", 1) for i in range(300)]
    docs = frame(spark, rows)
    seen = []
    of = minhash.links
    minhash.links = lambda *a: seen.append(of(*a).count()) or of(*a)
    try:
        got = rows_of(minhash.near_duplicates(docs, limit=limit))
    finally:
        minhash.links = of
    distinct = len({set_of(r[1]) for r in rows})
    assert sorted(r[0] for r in got if r[3]) == [0, 1000] and distinct - 2 <= sum(seen) <= (distinct - 2 if limit > 2_000 else 4 * distinct)


def test_cells_connect_what_pairs_connect(spark):
    """Links of cells join just the components that all candidate pairs between components would join, whatever the size of a cell."""
    rng = np.random.default_rng(1)
    k = minhash.COORDINATES
    base = rng.integers(0, 2**31, (4, k))
    rows = []
    for i in range(80):
        s = np.where(rng.random(k) < rng.choice([0.2, 0.35]), rng.integers(0, 2**31, k), base[i % 4])
        rows.append((i, int(rng.integers(80, 120)), [int(x) for x in s], i % 2 if i < 40 else i))
    known = [(r[0], r[3]) for r in rows]
    pairs = [
        (a[0], b[0]) for a in rows for b in rows
        if a[0] < b[0] and cells.fits(a[1], b[1], 80) and sum(x == y for x, y in zip(a[2], b[2], strict=True)) >= minhash.MATCHES
    ]

    def parts(links):
        root = {x: x for x in range(80)}

        def top(x):
            return x if root[x] == x else top(root[x])

        for a, b in [*known, *links]:
            root[top(a)] = top(b)
        return {x: min(y for y in root if top(y) == top(x)) for x in root}

    members = spark.createDataFrame([(7, r[0], r[3], 1, r[1], r[2]) for r in rows], "token long, class long, component long, company long, n long, signature array<int>")
    for limit in (k, 7 * k, 1000 * k):
        dealt = cells.blocks(members, "token", F.lit(k), limit)
        got = [tuple(r) for r in cells.by_cell(dealt, "token", lambda part: cells.joining(part, 80, minhash.alike(part))).collect()]
        assert {tuple(sorted(x)) for x in got} <= set(pairs) and parts(got) == parts(pairs)
    assert len(got) < 80 < len(pairs)
    one = members.withColumn("component", F.lit(0).cast("long"))
    assert cells.blocks(one, "token", F.lit(k), k).count() == 0


def test_nothing_and_nobody(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f g h", None, None, None), (None, "a b c d e f g h", "en", "s", 1), (3, None, "en", "s", 1), (4, "", "en", "s", 1), (3, "x", "en", "s", 1), (2, "X", "en", "s", 1)]
    assert rows_of(minhash.near_duplicates(frame(spark, rows))) == brute(rows)


def test_agreement_of_coordinates(spark):
    """The share of equal coordinates estimates similarity: without bias, and at the bound far above ``MATCHES``."""
    rng = np.random.default_rng(0)
    seen = []
    for _ in range(400):
        x = rng.integers(0, 2**63, 110, dtype=np.uint64)
        a, b = np.sort(x[:100]), np.sort(np.concatenate([x[:89], x[100:111]]))  # 89 of 110 or so
        seen.append((minhash.signature(a) == minhash.signature(b)).sum())
    assert abs(np.mean(seen) / minhash.COORDINATES - 89 / 110) < 0.01 and min(seen) >= minhash.MATCHES + 4


