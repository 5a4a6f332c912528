"""Mixing, fingerprints, licenses, URLs: brute force, exact results and odd cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from edge import corpus, frame, odd, sentence

from docketry.llm import bloom, fingerprint, licenses, mixing, urls


def water(sizes):
    """Targets by repeated clamping and resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix_equals_water_filling(spark):
    rows = corpus(90, 9) + odd() + [(2000 + i, "w " * 400, "en", "big", 1) for i in range(20)]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(repr((r["doc_id"], r["size"])) for r in got) == sorted(repr((r[0], size(r[1]))) for r in rows)
    sizes, taken = {}, {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    want = water(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: repr((r["doc_id"], r["size"], r["source"], r["taken"]))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_of_nothing_but_empty_texts(spark):
    docs = frame(spark, [(1, "", "en", "a", 0), (2, None, "en", None, 0)])
    assert {(r["target"], r["taken"]) for r in mixing.mix(docs).collect()} == {(0.0, 0)}


def test_expand_makes_the_taken_words(spark):
    docs = frame(spark, corpus(30, 2)).selectExpr("*", "'clash' as id", "'clash' as repetition", "'clash' as __taken")
    mixed = mixing.mix(docs)
    out = mixing.expand(docs, mixed)
    assert out.columns == [*docs.columns, "repetition_"] and {r["repetition"] for r in out.select("repetition").distinct().collect()} == {"clash"}
    words = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {r["doc_id"]: r["taken"] for r in mixed.collect() if r["taken"]}


def plain_level(names):
    """One level of locally consistent parsing of a single document, symbol by symbol."""
    mix = lambda v: int(fingerprint.splitmix(np.array([v % 2**64], np.uint64))[0])
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    s = [x if n == 1 else mix(x ^ (n << 32)) for x, n in runs]

    def toss(a, b):
        low = (a ^ b) & -(a ^ b)
        k = low.bit_length() - 1 if a != b else 0
        return 2 * k + (b >> k & 1)

    label = [toss(s[i - 1] if i else 0, s[i]) for i in range(len(s))]
    for _ in range(2):
        label = [toss(label[i - 1] if i else 0, label[i]) for i in range(len(label))]
    starts = [0] + [i for i in range(1, len(s) - 1) if label[i] > label[i - 1] and label[i] >= label[i + 1]]
    out = []
    for a, b in zip(starts, starts[1:] + [len(s)], strict=True):
        out.append(mix(sum(mix(x + k * 0xD6E8FEB86659FD93) for k, x in enumerate(s[a:b]))))
    return out


def test_parsing_equals_symbol_by_symbol():
    rng = random.Random(4)
    texts = ["", "a", "aaaa", "ab", "hello hello hello", sentence(rng, 80), "é😀ß" * 30, "x" * 500 + "y"]
    names = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    some = [t for t in texts if t]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in some])[:-1]])
    plain = [[ord(c) for c in t] for t in some]
    for _ in range(4):
        names, starts = fingerprint.level_up(names, starts)
        plain = [plain_level(p) for p in plain]
        ends = np.append(starts[1:], len(names))
        assert [names[s:e].tolist() for s, e in zip(starts, ends, strict=True)] == plain


def test_equal_substrings_share_interior_phrases():
    rng = random.Random(6)
    shared = " ".join(sentence(rng, 30) for _ in range(4))
    for shift in (1, 2, 3, 7):
        a = np.frombuffer((sentence(rng, 9)[:shift] + shared).encode("utf-32-le"), np.uint32).astype(np.uint64)
        b = np.frombuffer((sentence(rng, 20) + shared).encode("utf-32-le"), np.uint32).astype(np.uint64)
        zero = np.zeros(1, np.int64)
        for _ in range(2):
            a, b = fingerprint.level_up(a, zero)[0], fingerprint.level_up(b, zero)[0]
        assert len(set(a.tolist()) & set(b.tolist())) > 0.8 * len(set(a.tolist()))


def test_fingerprints_equal_brute_force(spark):
    rows = corpus(70, 8) + odd()
    docs = frame(spark, rows)
    texts = sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    sk = [fingerprint.sketches([t])[0] for _, t in texts]
    want = []
    for i, (d, t) in enumerate(texts):
        j = (i + 1) % len(texts)
        e = fingerprint.edited(t, texts[j][1])
        s = fingerprint.sketches([e])[0]
        want.append(repr((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.encode(sk[i]), fingerprint.encode(s), fingerprint.likeness(sk[i], s), fingerprint.likeness(sk[i], sk[j]))))
    small, fingerprint.RANGE_ROWS = fingerprint.RANGE_ROWS, 9
    for size in (9, 10_000):
        df = fingerprint.with_next(docs, size)
        assert df.filter("extra").count() >= 1
    fingerprint.RANGE_ROWS = small
    assert sorted(repr(tuple(r)) for r in fingerprint.fingerprints(docs).collect()) == sorted(want)
    one = frame(spark, rows[:1])
    assert fingerprint.fingerprints(one).first()["near_next"] == 1.0
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0


def test_ranges_give_the_same_pairs(spark, monkeypatch):
    docs = frame(spark, corpus(120, 3), extra=False)
    key = lambda r: repr(tuple(r))
    whole = sorted(map(key, fingerprint.fingerprints(docs).collect()))
    plain = fingerprint.with_next
    monkeypatch.setattr(fingerprint, "with_next", lambda d: plain(d, 7))
    assert sorted(map(key, fingerprint.fingerprints(docs).collect())) == whole


def test_slices_of_any_size_give_the_same(spark, monkeypatch):
    docs = frame(spark, corpus(50, 4) + odd(), extra=False)
    key = lambda r: repr(tuple(r))
    whole = sorted(map(key, fingerprint.fingerprints(docs).collect()))
    monkeypatch.setattr(fingerprint, "slices", lambda sizes: ((i, i + 1) for i in range(len(sizes))))
    assert sorted(map(key, fingerprint.fingerprints(docs).collect())) == whole


def test_edited_text_is_near():
    rng = random.Random(1)
    texts = [" ".join(sentence(rng, 20) for _ in range(8)) for _ in range(20)]
    near, far = [], []
    for a, b in zip(texts, texts[1:], strict=False):
        x, y, e = fingerprint.sketches([a, b, fingerprint.edited(a, b)])
        near.append(fingerprint.likeness(x, e))
        far.append(fingerprint.likeness(x, y))
    assert min(near) > 0.3 > max(far) and fingerprint.likeness(x, x) == 1.0


def license_rows():
    rng = random.Random(2)
    rows, want = [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES * 2):
        lead, tail = (sentence(rng, rng.randrange(0, 60)) for _ in range(2))
        body = text if i % 2 else re.sub(" ", "\n  ", text, count=3).upper()
        rows.append((i, f"{lead}\n{body}.\n{tail}", "en", "s", 1))
        want[i] = name
    return rows, want


def test_licenses_are_found(spark):
    rows, want = license_rows()
    clean = [(500 + i, f"{sentence(random.Random(i), 30)} the license of copyright was granted {sentence(random.Random(i), 9)}", "en", "s", 1) for i in range(20)]
    docs = frame(spark, rows + clean + odd())
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect() if r["doc_id"] is not None}
    text = {r[0]: r[1] for r in rows}
    for i, name in want.items():
        assert name in got[i]["licenses"].split(","), (i, name, got[i])
        f = next(x for x in got[i]["found"] if x["license"] == name)
        assert f["differences"] == [] and 0 < f["gain"] <= 1.5 and f["start"] < f["end"] <= len(text[i].encode())
    assert all(got[500 + i]["licenses"] == "" for i in range(20))
    assert got[1000]["n_blocks"] == 0 and licenses.scan(docs.limit(0)).count() == 0


def brute_confirm(text):
    """Every template aligned with the whole text, without compression."""
    s = licenses.Scanner()
    words = licenses.words_of(text.encode())
    return {n for n, t in s.templates if (w := licenses.words_of(t.encode())) and licenses.wording_differences(w, words)[0] <= s.tolerance * len(w)}


def test_scan_equals_alignment_with_every_template():
    rows, _ = license_rows()
    s = licenses.Scanner()
    for _, text, *_ in rows:
        assert {x["license"] for x in s(text.encode())[1]} == brute_confirm(text)


def changed(words, edits, rng):
    """``edits`` words replaced, taken out or put in, none that tells licenses apart."""
    words = list(words)
    for _ in range(edits):
        k = rng.choice([i for i, w in enumerate(words) if not re.search(r"\d", w) and not w.startswith("zz")])
        what = rng.randrange(3)
        words[k : k + (what != 1)] = [] if what == 2 else [f"zz{chr(97 + rng.randrange(26))}"]
    return words


@pytest.mark.parametrize("share", [0.01, 0.05, 0.1])
def test_changed_wordings_are_found(share):
    """All templates with up to a tenth of their words changed, cue words among them, each twice in one text: recall 1."""
    rng, s, found, wanted = random.Random(int(share * 100)), licenses.Scanner(), 0, 0
    for name, text in licenses.TEMPLATES:
        words = text.split()
        n = len(licenses.words_of(text.encode()))
        for _ in range(5):
            both = [" ".join(changed(words, int(share * n), rng)) for _ in range(2)]
            body = f"{sentence(rng, 30)}\n{both[0]}.\n{sentence(rng, 200)}\n{both[1]}.\n{sentence(rng, 9)}"
            got = [x for x in s(body.encode())[1] if x["license"] == name]
            wanted += 2
            found += sum(any(x["start"] < body.index(b) + len(b) and body.index(b) < x["end"] for x in got) for b in both)
    assert found == wanted


def test_every_occurrence_is_reported():
    notice = "Released under the MIT License"
    text = "\n".join([notice, "something else in between", notice, notice.upper(), "x " * 500, notice]).encode()
    got = licenses.Scanner()(text)[1]
    assert [text[x["start"] : x["end"]].decode().lower() for x in sorted(got, key=lambda x: x["start"])] == [notice.lower()] * 4
    assert [x["license"] for x in licenses.Scanner()(b"Distribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met")[1]] == ["bsd"]


GIVEN = [  # the first five as they stand in the documents given
    ("All rights reserved.", {"all-rights-reserved"}), ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}), ("Released under the MIT License.", {"mit"}), ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
    ("This work is licensed under the GNU General Public License, version 2.", {"gpl-2.0"}),
    ("you can redistribute it under the terms of the GNU Affero General Public License", {"agpl"}),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", {"lgpl"}),
    ("subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2.0"}), ("under the Eclipse Public License v2.0", {"epl-2.0"}), ("CC0 1.0 Universal", {"cc0-1.0"}),
    ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
    ("// SPDX-License-Identifier: BSL-1.0", {"bsl-1.0"}), ("# SPDX-License-Identifier: (MIT OR Apache-2.0) see notes", {"mit", "apache-2.0"}),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0.", {"gpl-2.0-only"}), ("SPDX-License-Identifier: NONE", set()), ("SPDX-License-Identifier: GPL-2.0+ */", {"gpl-2.0+"}),
]


@pytest.mark.parametrize(("line", "names"), GIVEN)
def test_bare_notices_and_identifiers(line, names):
    lead, tail = sentence(random.Random(4), 40), sentence(random.Random(5), 40)
    text = f"{lead}\n{line}\n{tail}".encode()
    got = licenses.Scanner()(text)[1]
    assert {x["license"] for x in got} == names
    assert all(text[x["start"] : x["end"]] in line.encode() for x in got)


def test_verbatim_notices_in_any_words():
    """Every template 40 times between words of several kinds: none is missed."""
    rng, s, missed = random.Random(9), licenses.Scanner(), []
    kinds = [lambda: sentence(rng, 80), lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80)), lambda: "the of " * 40, lambda: "license licensed under the gnu public " * 12]
    for name, text in licenses.TEMPLATES:
        for k in range(40):
            body = f"{kinds[k % 4]()}\n{text}\n{kinds[k % 4]()}"
            at = body.index(text)
            if not any(x["license"] == name and x["start"] < at + len(text) and at < x["end"] for x in s(body.encode())[1]):
                missed.append((name, text[:40], k))
    assert missed == []


NAMED = [
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa-4.0"}),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", {"cc-by-nc-4.0"}),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", {"cc-by-nc-nd-4.0"}),
    ("This work is licensed under a Creative Commons Attribution Share Alike 4.0 International License", set()),
    ("This work is licensed under a Creative Commons Attribution Non-Commercial 4.0 International License", set()),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", {"cc-by-4.0"}),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License", {"cc-by-3.0"}),
    ("The MIT License (MIT)", {"mit"}), ("MIT License", {"mit"}), ("CC BY-SA 3.0", {"cc-by-sa-3.0"}), ("CC-BY-4.0", {"cc-by-4.0"}), ("see CC BY-NC-ND 2.5 for terms", {"cc-by-nc-nd-2.5"}),
    ("GNU General Public License v3.0", {"gpl-3.0"}), ("distributed under the GPLv3 by its authors", {"gpl-3.0"}), ("BSD 3-Clause License", {"bsd-3-clause"}),
    ("Distributed under the Boost Software License, Version 1.0.", {"bsl-1.0"}), ("under the terms of the GNU Free Documentation License", {"gfdl"}),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        {"lgpl"},
    ),
    (
        "This document is free: you can redistribute it and/or modify it under the terms of the GNU Free Documentation License as published by the Free Software Foundation",
        {"gfdl"},
    ),
]


@pytest.mark.parametrize(("line", "names"), NAMED)
def test_names_of_licenses_are_kept_apart(line, names):
    text = f"{sentence(random.Random(6), 40)}\n{line}\n{sentence(random.Random(7), 40)}".encode()
    assert {x["license"] for x in licenses.Scanner()(text)[1]} == names


def test_wording_differences():
    d = licenses.wording_differences
    assert d([b"a", b"b", b"c"], [b"x", b"a", b"b", b"c", b"y"]) == (0, 1, 4, [])
    assert d([b"a", b"b", b"c"], [b"x", b"a", b"q", b"c"])[0::3] == (1, ["-b +q"])
    assert d([b"a", b"b", b"c"], [b"a", b"c"])[0::3] == (1, ["-b"]) and d([b"a"], [])[0] == 1


URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/de/", "http://b.example.com/de/x?q=/fr/", "http://x.org/fr/", "http://x.org/en/fr/", "http://net", "http://net/", "http://notnet.example.org",
    "no scheme", "", None, "http://", "://h/p#f", "http://spam-farm.example.org/x", "https://www.spam-farm.example.org?x", "http://myspam-farm.example.org/", "http://user@spam-farm.example.org:80/a//b/",
    "http://h/p?x=http://net/", "http://example.com/de", "http://listed.test/a/b/c.html", "http://listed.test/a/bc", "http://sub.listed.test/a/b/", "http://listed.test/a",
]


def brute_judge(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max((r for r in urls.RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith(r[0][r[0].index("/") :])), key=lambda r: len(r[0]), default=None)
    if best:
        return host, path, best[0], best[1]
    bare = host.rpartition("@")[2].partition(":")[0]
    parts = [p for p in path.split("/") if p]
    for entry in listed:
        h, _, p = entry.partition("/")
        want = [x for x in p.split("/") if x]
        if (bare == h or bare.endswith("." + h)) and bare and parts[: len(want)] == want:
            return host, path, None, "block"
    return host, path, None, "allow"


@pytest.mark.parametrize("most", [64 << 20, 256])  # one filter, and many after one another
def test_urls_equal_brute_force(spark, most):
    listed = ["spam-farm.example.org/", "listed.test/a/b", *(f"filler{i}.test/" for i in range(50))]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(None, URLS[13], "c"), (3, URLS[3], "c")], "page_id long, url string, verdict string")
    entries = spark.createDataFrame([(x,) for x in listed] + [(None,), ("",), ("http://spam-farm.example.org",)], "url string")
    got = urls.judge(pages, entries, max_filter_bytes=most).collect()
    want = [(i, *brute_judge(u, listed)) for i, u in [*enumerate(URLS), (None, URLS[13]), (3, URLS[3])]]
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
    none = urls.judge(pages, entries.limit(0), max_filter_bytes=most)
    assert {r["verdict"] for r in none.filter("rule is null").collect()} == {"allow"}
    assert urls.judge(pages.limit(0), entries).count() == 0


def test_very_long_urls(spark):
    """Hosts and paths of 100,000 parts: work follows the length of the URL and what depths are listed."""
    deep = "d/" * 50_000
    rows = [
        (1, f"http://listed.test/a/b/{deep}"), (2, f"http://{'x.' * 100_000}listed.test/a/b"), (3, f"http://{'x.' * 50_000}test/{deep}"), (4, f"http://deep.test/{deep}e"),
        (5, f"http://listed.test/a/{deep}"), (6, "http://" + "a" * 500_000), (7, "http://h.test/" + "/" * 300_000 + "a//b"),
    ]
    listed = ["listed.test/a/b", f"deep.test/{deep}", "h.test/a/b"]
    entries = spark.createDataFrame([(x,) for x in listed], "url string")
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), entries).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "block"}
    key = urls.canonical(*urls.split_url(rows[2][1]))
    assert len(list(urls.lookups(key, {2: [0, 2], 3: [0]}))) == 3


def test_bloom_has_no_false_negatives(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63, 5000)
    blocks, fits = bloom.blocks_for(len(keys), 1 << 20)
    assert fits
    b = bloom.build(spark.createDataFrame([(int(k),) for k in keys], "h long"), blocks)
    assert b.might_contain(keys.view(np.uint64)).all()
    assert b.might_contain(rng.integers(-(2**63), 2**63, 20_000).view(np.uint64)).mean() < 0.04
