"""Documents with every odd case, and a seeded corpus."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is was for that on with as by at from it an be this which or are not have had one all".split()


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ing", "er", "s"]) for _ in range(n)).capitalize() + "."


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "\n".join(sentence(rng, rng.randrange(3, 25)) for _ in range(rng.randrange(1, 6)))
        rows.append((i, text, rng.choice(["en", "de"]), f"s{rng.randrange(3)}", len(text)))
    return rows


def odd():
    """Null in every column, empty, white space, one long text, ties, repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    same = "exactly the same text of a document that comes again and again"
    return [
        (1000, None, "en", "s0", None), (1001, "", "en", None, 0), (1002, " \n\t ", None, "s1", 4), (None, "a document without any id at all", "en", "s1", 1),
        (None, None, None, None, None), (1003, long, "en", "s2", len(long)), (1004, same, "en", "s0", 1), (1005, same, "en", "s0", 1), (1005, same, "en", "s0", 1),
        (1006, same + "x", "de", "s0", 1), (1007, "é😀ß" * 9, "de", "s9", 27), (1008, "12 34 .. !!", "en", "s1", 1), (1009, "\n" * 50, "en", "s1", 50),
    ]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # names that operators use themselves
        from pyspark.sql import functions as F

        for c in ("score", "size", "taken", "fp", "gone", "line_no", "range", "extra", "y", "key", "slice", "k1"):
            df = df.withColumn(c, F.lit("clash"))
    return df
