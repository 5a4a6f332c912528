"""The SimHash stage where many unlike texts have close fingerprints, as long texts of one language have."""

import random

from pyspark.sql import functions as F

from docketry.llm import cells, simhash


def test_unlike_texts_of_one_family_are_not_dealt_to_cells(spark, monkeypatch):
    """The same words in other orders: one fingerprint, no shingles in common. Copies with a changed end are found among them."""
    rng, rows = random.Random(5), []
    words = [f"w{i}" for i in range(100)]
    for i in range(200):
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 1))
    rows += [(1000 + i, " ".join([*rows[i][1].split()[:-3], *rows[i][1].split()[-1:-4:-1]]), "en", "s", 1) for i in range(0, 200, 10)]
    dealt, blocks = [], cells.blocks

    def counted(*args):
        out = blocks(*args)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(cells, "blocks", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    gone = simhash.duplicates(docs, limit=2_000)
    assert sorted((r["doc_id"], r["kept"]) for r in gone.collect()) == [(1000 + i, i) for i in range(0, 200, 10)]
    assert sum(dealt) <= len(rows)


def test_refined_families_lose_no_link(spark):
    """Sets of all likenesses, also of one element: every pair at the similarity stays in one family, under each order of rarity."""
    rng, sets = random.Random(6), []
    for _ in range(12):
        base = rng.sample(range(400), rng.choice([1, 2, 5, 20, 40]))
        sets.append(base)
        for _ in range(6):
            x = set(base)
            for _ in range(rng.randrange(6)):
                x ^= {rng.randrange(400)}
            sets.append(sorted(x))
    rows = [(k % 2, k, 1, len(set(x)), sorted(set(x))) for k, x in enumerate(sets) if x]
    members = spark.createDataFrame(rows, "family long, class long, company long, n long, set array<int>")
    for similarity in (50, 80, 100):
        got = {r["class"]: r["family"] for r in cells.refined(members, similarity, 10).select(F.col("class"), "family").collect()}
        linked = 0
        for f, a, _, _, x in rows:
            for g, b, _, _, y in rows:
                if a < b and f == g and 100 * len(set(x) & set(y)) >= similarity * len(set(x) | set(y)):
                    linked += 1
                    assert a in got and got[a] == got[b]
        assert linked
