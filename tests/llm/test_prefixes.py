"""Prefix trie against a plain one, odd rows and long conversations."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from docketry.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def words(t):
    return len([w for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w])


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), sha(f"{len(role.encode())}:{role}{text}"), (role, text)))
    own = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].add(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = Counter(), Counter()
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(of) - 1) * words(node[-1][1]) if node else 0
    return Counter(
        (min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children[node]), leaves[node], saved[node], sha(",".join(map(str, sorted(ends[node])))))
        for node, of in members.items()
    )


def chats(n, seed=1, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["hi", "Hi there", "a b c", "", "tab\tand\nline", "ß é 😀"])))
    rng.shuffle(rows)
    return rows


def run(spark, tmp_path, rows, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for c in ("place", "slice", "a", "x", "words", "n", "number", "tie", "h", "length"):
            df = df.withColumn(c, F.lit("clash"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = prefixes.op12_prefixes(spark, str(tmp_path))
    assert tuple(got.columns) == COLUMNS and all(t == "bigint" for _, t in got.dtypes[:-1])
    return Counter(tuple(r) for r in got.collect())


def test_trie_equals_brute_force(spark, tmp_path):
    rows = chats(150)
    got = run(spark, tmp_path, rows)
    assert got == brute(rows) and len(got) > 100


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated turns, negative ids, an absent base, a turnless conversation, clashing names."""
    rows = chats(45, seed=2)
    rows += [(None, 0, "user", "nobody's"), (61, None, None, None), (61, None, "user", "first"), (61, 3, "user", None), (61, 3, "user", None), (62, 1, None, "x y"), (-3, 0, "user", "hi"), (-3, 1, "user", "ho"), (0, 50, "user", "end")]
    rows += [(c, 0, "user", "only one") for c in range(200, 240)]  # those with h > 0 and an absent base are left without turns
    rows = [r for r in rows if r[0] != 200]
    want = brute(rows)
    assert run(spark, tmp_path, rows, clash=True) == want
    assert [] in rebuilt(rows).values()


def test_one_long_conversation_and_many_copies(spark, tmp_path):
    """Most turns in one conversation, most conversations alike: slices and rounds, and names that go through."""
    rows = [(20, t, "user", f"turn {t % 5}") for t in range(300)] + [(c, t, "user", f"same {t}") for c in range(400, 700) for t in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = run(spark, tmp_path, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows) and max(k[1] for k in got) >= 297


def test_nothing(spark, tmp_path):
    assert not run(spark, tmp_path, [])


@pytest.mark.parametrize("depth", [0, 2, 7])
def test_roll_up_of_a_chain_and_a_star(spark, depth):
    """A chain of any depth with leaves along it; each node gets what hangs under it."""
    rows = [(d, 0, d - 1 if d else None, 0 if d else None, d, 1) for d in range(depth + 1)]
    rows += [(100 + d, 1, d, 0, d + 1, 10) for d in range(depth + 1)]
    nodes = spark.createDataFrame(rows, "x long, y long, px long, py long, depth long, v long")
    got = {r["x"]: r["v"] for r in prefixes.roll_up(nodes, ["v"]).collect()}
    assert got == {**{d: (depth + 1 - d) * 11 for d in range(depth + 1)}, **{100 + d: 10 for d in range(depth + 1)}}
