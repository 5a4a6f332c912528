import random
import re
import zoneinfo
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from docketry.functions import dates, mail, maths
from docketry.functions import text as tx
from docketry.functions.verdicts import last_verdict, parse_verdict


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def strange_texts(n=600, seed=1):
    rng = random.Random(seed)
    pieces = ["a", "Re: ", "fw :", "FWD:", " ", "\t", "\n", "\r\n", "\r", "\x0b", "\x1c", "\x85", " ", " ", " ", "> ", "é", "😀", "x y", ":"]
    return ["", "\n\n", "  "] + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def py_subject(s):
    while m := re.match(r"\s*(?:re|fwd|fw)\s*:\s*", s, re.I):
        s = s[m.end() :]
    return re.sub(r"\s+", " ", s).strip().lower()


def py_body(s):
    s = s.replace("\r\n", "\n").replace("\r", "\n")
    return "\n".join(x.rstrip() for x in s.split("\n")).strip("\n")


def py_collapse(s):
    return re.sub(r"\s+", " ", "\n".join(x.lstrip("> \t") for x in s.split("\n"))).strip()


@pytest.mark.parametrize(
    "make,plain",
    [
        (tx.subject_norm, py_subject),
        (tx.body_norm, py_body),
        (tx.collapse, py_collapse),
        (lambda c: F.array_join(tx.words(c), "|"), lambda s: "|".join(s.split())),
        (tx.token_estimate, lambda s: len(s) // 4),
    ],
)
def test_text_functions_equal_python(spark, make, plain):
    values = strange_texts()
    assert column(spark, values, make) == [plain(v) for v in values]


def test_nulls_stay_null(spark):
    assert column(spark, [None], tx.subject_norm) == [None]
    assert column(spark, [None], lambda c: tx.split_list(c)) == [[]]


def test_ids_and_hashes(spark):
    row = spark.range(1).select(
        tx.doc_id(F.lit("bush"), F.lit("athome1/123.txt"), F.lit(0)).alias("a"), tx.dedup_key(F.lit(None), F.lit("b")).alias("n"), tx.dedup_key(F.lit(""), F.lit("b")).alias("e")
    ).first()
    assert row["a"] == "bush-d4643464a6aa6375"
    assert row["n"] == row["e"]
    with pytest.raises(Exception, match="unknown corpus"):
        spark.range(1).select(tx.doc_id(F.lit("other"), F.lit("f"), F.lit(0))).collect()


def test_shingles(spark):
    make = lambda c: tx.shingles_of(tx.words(c), 3)
    assert column(spark, ["a b c d a b c", "a b", "", " a  b c"], make) == [["a b c", "b c d", "c d a", "d a b"], ["a b"], [], ["a b c"]]


def test_lists_and_senders(spark):
    assert column(spark, [" a; ;b c;", None, "x,y; z"], tx.split_list) == [["a", "b c"], [], ["x,y", "z"]]
    assert column(spark, ["x,y; z"], lambda c: tx.split_list(c, ";,")) == [["x", "y", "z"]]
    got = column(spark, ['"Ann B" <a@b.c>', "<a@b.c>", "a@b.c", " Ann B ", "a@b c", ""], tx.sender)
    assert [tuple(r) for r in got] == [("Ann B", "a@b.c"), (None, "a@b.c"), (None, "a@b.c"), ("Ann B", None), ("a@b c", None), (None, None)]


def test_request_ids(spark):
    df = spark.createDataFrame([("enron-1", "201", "qc", 2, "topic201.v12")], "d string, t string, p string, k int, v string")
    row = df.select(tx.custom_id("d", "t", "p", "k", "v").alias("c")).select("c", tx.custom_id_fields("c").alias("f")).first()
    assert row["c"] == "enron-1__201__qc__t2__topic201-v12"
    assert tuple(row["f"]) == ("enron-1", "201", "qc", 2, "topic201.v12")
    for bad in (("a__b", "1", "qc", 1, "t.v1"), ("a", "1", "no", 1, "t.v1"), ("a", "1", "qc", 1, "t1"), ("é", "1", "qc", 1, "t.v1"), ("a" * 60, "1", "qc", 1, "t.v1")):
        with pytest.raises(Exception, match="bad request id"):
            spark.createDataFrame([bad], df.schema).select(tx.custom_id("d", "t", "p", "k", "v")).collect()


def test_members_and_custodians(spark):
    rows = column(spark, ["./edrm-enron-v2_jones-p_xml/text_000/3.1.X.txt", "a/b.zip"], tx.member_parts)
    assert tuple(rows[0]) == ("edrm-enron-v2_jones-p_xml/text_000/3.1.X.txt", "jones-p", "3.1.X") and rows[1] is None
    assert column(spark, ["edrm-enron-v2_jones-p_xml_1of2.zip"], tx.zip_custodian) == ["jones-p"]
    for make, bad in ((tx.member_parts, "edrm-enron-v2_a_xml/b.txt"), (tx.zip_custodian, "other.zip")):
        with pytest.raises(Exception):
            column(spark, [bad], make)
    assert column(spark, ["3.1.X.2", "3.1.X"], tx.parent_doc) == ["3.1.X", "3.1.X"]
    assert column(spark, ["3.1.X.2", "3.1.X"], tx.is_part) == [True, False]


def py_sent(v):
    v = re.sub(r"\s+", " ", v).strip()
    for f in ("%A, %B %d, %Y %I:%M %p", "%A, %B %d, %Y %I:%M:%S %p", "%B %d, %Y %I:%M %p", "%m/%d/%Y %I:%M %p", "%m/%d/%y %I:%M %p"):
        try:
            return datetime.strptime(v, f).replace(tzinfo=zoneinfo.ZoneInfo("America/New_York")).astimezone(UTC).replace(tzinfo=None)
        except ValueError:
            pass
    return None


def test_dates(spark):
    values = [
        "Monday, July 08, 2002 9:05 AM", "Sunday, July 8, 2002 9:05:07 PM", "July 8, 2002 12:00 AM", "7/8/2002 9:05 PM", "07/08/99 1:00 AM", "7/8/68 1:00 AM",
        "Monday, July 8, 2002\xa09:05  AM", "2002-07-08", "", "Monday, 7/8/2002 9:05 PM", "January 15, 2003 11:59 PM", "13/40/2002 9:05 PM",
    ]
    got = column(spark, values, lambda c: F.date_format(dates.sent_utc(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == [None if (w := py_sent(v)) is None else w.strftime("%Y-%m-%d %H:%M:%S") for v in values]


def test_verdicts(spark):
    flat = '{"decision": "responsive", "confidence": 0.5, "rationale": "r"}'
    values = [flat, f"x {flat} then " + flat.replace("responsive", "borderline"), '{"a": {"b": 1}} ' + flat, "none", '{"decision": "x"}', "{{{", None, f"```json\n{flat}\n```"]
    got = column(spark, values, parse_verdict)
    assert [r["decision"] for r in got] == ["responsive", "borderline", "responsive", None, None, None, None, "responsive"]
    assert got[3]["error"] == "no JSON object" and "no object with" in got[4]["error"]
    assert last_verdict('{"decision":"a","confidence":"no","rationale":"r"}')["error"]


def test_rounding_and_ratios(spark):
    row = spark.range(1).select(
        maths.half_even(F.lit(2.5), 0).alias("a"), maths.half_even(F.lit(1 / 128), 6).alias("b"), maths.ratio(F.lit(1), F.lit(0)).alias("c"),
        maths.pro_rata(F.lit(10), F.lit(1), F.lit(3)).alias("d"), maths.cost_usd(F.lit(100_000), F.lit(2_000), F.lit(0.5), F.lit(2.5)).alias("e"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (2.0, 0.007812, 0.0, 3) and row["e"] == pytest.approx(0.055)


def test_tab_headers():
    block = "From:\tAnn <a@b.c>\nTo:\tx;\n  y\nTo:\tz\nEmpty:\n\nbody\n"
    headers, body, warn = mail.tab_headers(block)
    assert headers == {"From": "Ann <a@b.c>", "To": "x; y; z", "Empty": ""} and body == "body\n" and warn == []
    assert mail.tab_headers("Comment: I think\nmore") == ({}, "Comment: I think\nmore", ["no_header_block"])
    assert mail.tab_headers("From:\ta\nprose\nx")[1:] == ("prose\nx", ["header_block_unterminated"])
    assert mail.tab_headers("\n\nx")[0] == {}
    assert mail.tab_headers("From:\ta") == ({"From": "a"}, "", [])


def test_colon_headers():
    assert mail.colon_headers("From: a\nSubject: b\n c\nFrom: d\n e\n\nbody\r\nx") == ({"from": "a e", "subject": "b c"}, "body\nx")
    for text in ("Note: a\n\nbody", "From: a\nno header\n\nb", "From: a", ""):
        assert mail.colon_headers(text) == ({}, text)


def test_eml():
    raw = b"Message-ID: <1@x>\r\nFrom: Ann B <a@b.c>\r\nTo: c@d.e, Foo <f@g.h>\r\nDate: Mon, 8 Jul 2002 09:05:00 -0400\r\nSubject: hi\r\nReferences: <a> <b>\r\nX-Folder: in\r\n\r\nbody\r\n"
    m = mail.parse_eml(raw)
    assert m["from_addr"] == "a@b.c" and m["to"] == ["c@d.e", "Foo <f@g.h>"] and m["references"] == ["<a>", "<b>"]
    assert m["date_utc"] == datetime(2002, 7, 8, 13, 5, tzinfo=UTC) and m["headers_json"] == '{"X-Folder": "in"}' and m["parse_warnings"] == []
    assert mail.parse_eml(b"Date: Mon, 8 Jul 2002 09:05:00 -0000\r\n\r\nx")["parse_warnings"] == ["date_no_tz_assumed_utc"]
    assert mail.parse_eml(b"Date: garbage\r\n\r\nx")["parse_warnings"] == ["date_unparsed"]
    assert mail.parse_eml(b"Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/html\r\n\r\n<p>\r\n--b--\r\n")["parse_warnings"] == ["no_text_body_part"]


def test_eml_bodies():
    html = b"--i\r\nContent-Type: text/html\r\n\r\n<p>\r\n"
    plain = b"--i\r\nContent-Type: text/plain; charset=iso-8859-1\r\n\r\n\xe9t\xe9\r\n--i--\r\n"
    nested = b"Content-Type: multipart/alternative; boundary=i\r\n\r\n" + html + plain
    attached = b"--o\r\nContent-Type: text/plain\r\nContent-Disposition: attachment\r\n\r\nno\r\n--o\r\n" + nested + b"--o--\r\n"
    assert mail.parse_eml(b"Content-Type: multipart/mixed; boundary=o\r\n\r\n" + attached)["body_text"].strip() == "été"
    m = mail.parse_eml(b"Content-Type: text/plain; charset=nonsense\r\n\r\n\xe9")
    assert (m["body_text"], m["parse_warnings"]) == ("é", ["body_decode_fallback_latin1"])
    assert mail.parse_eml(b"Content-Type: text/html\r\n\r\n<b>x</b>")["body_text"] == "<b>x</b>"
    m = mail.parse_eml(b"Date: Mon, 8 Jul 2002 09:05:00 +9900\r\nTo: Only Name, a@b.c\r\n\r\n")
    assert m["date_utc"] is None and m["parse_warnings"] == ["date_unparsed"] and "a@b.c" in m["to"]


def test_crlf_in_tab_headers():
    """An empty value with a carriage return is no header: the block ends there."""
    assert mail.tab_headers("From:\ta\r\nSubject:\r\nx")[1:] == ("Subject:\r\nx", ["header_block_unterminated"])
    assert mail.tab_headers("  fold first\nFrom:\ta")[2] == ["no_header_block"]


def test_decode():
    assert mail.decode("é".encode()) == ("é", None)
    assert mail.decode(b"\x93q\x94") == ("“q”", "cp1252")
    assert mail.decode(b"\x8f") == ("\x8f", "latin-1")
