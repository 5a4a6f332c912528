"""Quality, toxicity, language: held-out accuracy and odd cases."""

import os
import random
import zlib

import numpy as np
import pytest
from edge import SCHEMA, corpus, frame, odd

from docketry.llm import langid, quality, toxicity
from docketry.llm.common import crc_mod


def auc(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_crc(spark):
    df = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long")
    got = {r[0]: r[1] for r in df.select("doc_id", crc_mod("doc_id", 3)).collect()}
    assert all(got[i] == zlib.crc32(str(i).encode()) % 3 for i in range(200)) and got[None] == 0


def test_trees_walk_equals_node_by_node():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    t = quality.fit_trees(x, y, trees=20, depth=3)

    def walk(row):
        total = t.base
        for f, c, leaf in zip(t.feature, t.cut, t.leaf, strict=True):
            at = 0
            for _ in range(t.depth):
                at = 2 * at + 1 + int(row[f[at]] > c[at])
            total += leaf[at - (2**t.depth - 1)]
        return total

    assert np.allclose(t.margin(x), [walk(r) for r in x])
    assert ((t.score(x) >= 0.5) == y).mean() > 0.95
    assert (quality.fit_trees(x, np.ones(500)).score(x) > 0.9).all() and (quality.fit_trees(x[:0], y[:0]).score(x) == 0.5).all()


def quality_rows(n=400):
    rng = random.Random(3)
    rows = []
    for i, (_, text, lang, source, k) in enumerate(corpus(n, 5)):
        y = rng.randrange(2)
        rows.append((i, text if y else " ".join(w + "$$$" for w in text.split()), lang, source, k, y))
    return rows


def test_quality_held_out_and_odd(spark):
    rows = quality_rows()
    docs = frame(spark, [r[:5] for r in rows] + odd())
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows] + [(None, 1), (5, None), (0, rows[0][5])], "doc_id long, quality int")
    model = quality.train(docs, labels.filter(crc_mod("doc_id", 3) != 1), "quality", 300)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert quality.score(docs, model).count() == len(rows) + len(odd())
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert auc(np.array([r[5] for r in held]), np.array([got[r[0]] for r in held])) > 0.98
    assert all(0 <= v <= 1 for v in got.values()) and got[1000] == got[1001]
    assert quality.score(docs.limit(0), model).count() == 0
    empty = quality.train(docs, labels.limit(0), "quality")
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5}


def brute_marginals(e, chain):
    """Over all labelings of a short chain."""
    n = len(e)
    p, total = np.zeros(n), 0.0
    for bits in range(2**n):
        y = [(bits >> t) & 1 for t in range(n)]
        s = sum(e[t] for t in range(n) if y[t]) + (chain.start if y[0] else 0) + sum(chain.move[y[t - 1], y[t]] for t in range(1, n))
        w = np.exp(s)
        total += w
        p += w * np.array(y)
    return p / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    chain = toxicity.Chain(np.zeros(4), np.array([[0, -2.0], [0.5, 1.0]]), -1.0, np.zeros(4))
    docs = [rng.normal(0, 2, n) for n in (1, 5, 9, 3, 7, 0)]
    for d, odds in zip(docs, toxicity.log_odds(chain, docs), strict=True):
        if len(d):
            assert np.allclose(1 / (1 + np.exp(-odds)), brute_marginals(d, chain))


def toxic_rows(n=500):
    rng = random.Random(8)
    bad = ["idiotish", "scumbag"] + [f"vilest{x}" for x in ("en", "er", "a", "o", "un", "ig")]
    rows = []
    for i, (_, text, lang, source, k) in enumerate(corpus(n, 6)):
        y = int(rng.random() < 0.3)
        words = text.split(" ")
        for _ in range(3 if y else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad))
        rows.append((i, " ".join(words), lang, source, k, y))
    return rows


def test_toxicity_held_out_spans_and_odd(spark):
    rows = toxic_rows()
    docs = frame(spark, [r[:5] for r in rows] + odd())
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels.filter(crc_mod("doc_id", 4) != 2))
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    y, p = np.array([r[5] for r in held]), np.array([got[r[0]]["score"] for r in held])
    assert auc(y, p) > 0.98 and ((p >= 0.3) == y).mean() > 0.95
    text = {r[0]: r[1] for r in rows}
    found = [text[r["doc_id"]][s["start"] : s["end"]].lower() for r in got.values() if r["doc_id"] in text for s in r["spans"]]
    assert found and sum(any(b in f for b in ("idiotish", "scumbag", "vilest")) for f in found) > 0.9 * len(found)
    assert got[1000]["score"] < 0.3 and got[1001]["n_spans"] == 0
    kept = toxicity.drop_toxic(docs, chain)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["score"] < 0.3}
    none = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0} and toxicity.drop_toxic(docs, none).count() == docs.count()
    assert toxicity.score(docs.limit(0), chain).count() == 0


def test_spans_end_to_end_with_growing_lower_case(spark):
    """The same spans, further on, whatever stands before them; toxic words after 50,000 characters are learned from."""
    rows = [(i, ("pad " * 13_000 if r[5] else "") + r[1], *r[2:]) if i % 25 == 0 else (i, *r[1:]) for i, r in enumerate(toxic_rows(300))]
    docs = frame(spark, [r[:5] for r in rows], extra=False)
    chain = toxicity.train(docs, spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id long, toxic int"))
    texts = [t + "you scumbag and idiotish vilesten one" for t in ("", "Diyarbakır İstanbul ", "İİ ")]
    got = toxicity.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), chain).orderBy("doc_id").collect()
    words = [[texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] for r in got]
    assert words[0] and words[0] == words[1] == words[2] and all(r["score"] > 0.3 for r in got)
    few = toxicity.train(docs, spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id long, toxic int"), max_train_chars=2_000)
    assert isinstance(few.fitted, bool)


def test_repeated_ids_train_alike(spark):
    """Texts under one id: the model does not depend on partitions."""
    rows = [(i // 2, *r[1:]) for i, r in enumerate(toxic_rows(200))]
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id long, toxic int")
    docs = frame(spark, [r[:5] for r in rows], extra=False)
    a, b = (toxicity.train(d, labels) for d in (docs, docs.repartition(7)))
    assert np.array_equal(a.weight, b.weight) and np.array_equal(a.doc, b.doc)
    labels = labels.withColumnRenamed("toxic", "quality")
    a, b = (quality.train(d, labels, "quality") for d in (docs, docs.repartition(7)))
    assert np.array_equal(a.leaf, b.leaf)


def test_span_offsets_with_growing_lower_case():
    odds = np.array([-5.0, 5.0, 5.0, -5.0])
    got = toxicity.spans_of("Aİa bad Bad x", odds, 0.5)
    assert got and ["Aİa bad Bad x"[s["start"] : s["end"]] for s in got] == ["bad Bad"]


def test_spans_have_the_tokens_of_the_score():
    for text in ("Aİa bad Bad x", "İstanbul bad İİ Bad", "bad ΑΣ Bad", "Bad bad"):
        words = toxicity.tokens(text)
        got = toxicity.spans_of(text, np.array([5.0 if w == "bad" else -5.0 for w in words]), 0.5)
        assert " ".join(text[s["start"] : s["end"]] for s in got).lower().split() == ["bad", "bad"], text


LANGS = {"aa": "alo mira tosa neku", "bb": "brung stock wilfen daz", "cc": "xyti qoru vezz pixo"}


def lang_rows(n=300):
    rng = random.Random(2)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(LANGS))
        words = LANGS[lang].split()
        out.append((i, " ".join(rng.choice(words) + rng.choice(words)[:2] for _ in range(rng.randrange(1, 60))), lang if i % 17 else None, "s", 1))
    return out, [next(k for k, v in LANGS.items() if any(r[1].startswith(w) for w in v.split())) for r in out]


def test_language_held_out_and_odd(spark):
    rows, truth = lang_rows()
    docs = frame(spark, rows + odd())
    model = langid.train(docs.filter("lang <> 'en' and lang <> 'de'").filter(crc_mod("doc_id", 3) != 1))
    assert model.names == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.98
    for i in (1000, 1001, 1002, 1008, 1009):  # no letter
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"]
    assert got[1007]["lang_pred"] in model.names and 0 < got[1007]["score"] <= 1
    none = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"} and langid.predict(docs.limit(0), model).count() == 0


def test_unseen_languages_are_rejected(spark):
    """Texts of a language that was not learned, and of random letters, are rejected; few of those learned are."""
    rows, truth = lang_rows()
    docs = frame(spark, rows)
    model = langid.train(docs.filter(crc_mod("doc_id", 3) != 1))
    rng = random.Random(3)
    other = [" ".join(rng.choice(["saippua", "kauppias", "talossa", "vuori", "järvi", "yö", "metsän"]) for _ in range(20)) for _ in range(40)]
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(20)) for _ in range(40)]
    got = langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate(other + noise)], "doc_id long, text string"), model).collect()
    assert np.mean([r["rejected"] for r in got]) > 0.95
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    own = {r["doc_id"]: r["rejected"] for r in langid.predict(docs, model).collect()}
    assert np.mean([own[i] for i in held]) < 0.15


def test_a_bad_model_rejects_everything():
    """Labels at random: no bar makes 99 % right."""
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 3)), *np.unique(langid.grams(b"same words over and over"), return_counts=True)) for i in range(300)]
    model = langid.fit([(d, y, at, n.astype(np.float32)) for d, y, at, n in rows], ["a", "b", "c"])
    assert model.predict([b"same words over and over"])[2].all()


def test_sample_is_bounded_and_leaves_no_language_out(spark):
    """Rows without an id, or of one id, do not slip through; languages take turns; windows cover long texts to their end."""
    rows = [(None if i % 2 else 7, f"text number {i} of this language", f"l{i % 9}", "s", 1) for i in range(400)] + [(9, "rare words here", "zz", "s", 1)]
    model = langid.train(frame(spark, rows), max_per_lang=4, max_rows=25)
    assert model.names == [*(f"l{i}" for i in range(9)), "zz"]
    parts = langid.spread(b"a" * 50_000 + b"end")
    assert len(parts) == langid.WINDOWS and parts[-1].endswith(b"end") and sum(map(len, parts)) == langid.WHOLE


def test_logits_of_long_texts_add_up():
    rng = np.random.default_rng(0)
    m = langid.Languages(["a", "b"], rng.normal(size=(langid.BUCKETS, 2)).astype(np.float32), np.zeros(2), 0.0, rng.normal(size=(langid.BUCKETS, 2)).astype(np.float32))
    text = ("abc déf ghi " * 300).encode()
    whole = np.hstack([m.table, m.familiar])[langid.grams(text)].mean(0)
    step, langid.STEP = langid.STEP, 997
    try:
        assert sorted(langid.grams(text)) and np.allclose(m.sums([text])[0][0], whole, atol=1e-5)
        means, size = m.sums([text, b"x", text])
        assert np.allclose(means[[0, 2]], [whole, whole], atol=1e-5) and size.tolist() == [len(langid.grams(text)), len(langid.grams(b"x")), len(langid.grams(text))]
    finally:
        langid.STEP = step


def test_toxicity_is_fitted_by_a_task(spark, monkeypatch):
    """The driver gets the weights, the same as a local fit has, and none of the training texts."""
    rows = [(i, f"plain words{i % 7} here " + ("badword again" if i % 3 == 0 else "fine again"), int(i % 3 == 0)) for i in range(60)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    wanted = toxicity.fit([r[1] for r in rows], np.array([r[2] for r in rows], float))
    driver, real = os.getpid(), toxicity.fit

    def fit(texts, toxic):
        assert os.getpid() != driver, "fitted on the driver"
        return real(texts, toxic)

    monkeypatch.setattr(toxicity, "fit", fit)
    got = toxicity.train(docs, labels)
    assert got.fitted and got.start == wanted.start
    assert all(np.array_equal(getattr(got, k), getattr(wanted, k)) for k in ("weight", "move", "doc"))


@pytest.mark.parametrize("f", [quality.op1_quality, toxicity.op2_toxicity, langid.op7_langid])
def test_queries_on_empty_tables(spark, tmp_path, f):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert f(spark, str(tmp_path)).count() == 0


def test_long_texts_in_many_languages_take_little_memory():
    """A text of 1,000,000 bytes against 300 languages: sums as of its n-grams one by one, without a copy of their rows."""
    import tracemalloc

    rng = np.random.default_rng(3)
    table = rng.normal(size=(1 << 15, 300)).astype(np.float32)
    model = langid.Languages([f"l{k}" for k in range(300)], table, np.zeros(300), 0.0)
    text = bytes(rng.integers(97, 123, 1_000_000, dtype=np.uint8))
    tracemalloc.start()
    got, size = model.sums([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    parts = list(langid.gram_parts(text))
    want = sum(table[:, 7].take(p).sum(dtype=np.float64) for p in parts) / size[0]
    assert size[0] == sum(map(len, parts)) > 2_900_000 and abs(got[0, 7] - want) < 1e-9 and most < 200_000_000
