"""Load files read entry by entry: cuts anywhere, broken entries, encodings, and memory."""

import io
import random
import tracemalloc
import zipfile
from xml.etree import ElementTree

import pytest

from docketry.sources import loadfile, messages


def doc(i, kind="Message", extra=""):
    return (
        f"<Document DocID='3.{i}' DocType='{kind}'><Tags><Tag TagName='#AttachmentCount' TagValue='{i % 3}'/><Tag TagName=\"#AttachmentNames\" TagValue='a&amp;b;&lt;c>'/></Tags>"
        f"<Files><File FileType='Native'><ExternalFile FilePath='n' FileName='{i}.eml'/></File></Files>{extra}<Locations><Location><Custodian>Ann ß</Custodian></Location></Locations></Document>"
    )


def pieces(text, size):
    return [text[i : i + size] for i in range(0, len(text), size)]


ODD = (
    "<?xml version='1.0'?><!-- <Document DocID='no'> --><Root><Batch><Documents>"
    + doc(1)
    + "<!-- </Document> <Document> -->"
    + doc(2, extra="<!-- </Document> --><Note><![CDATA[</Document> <Document DocID='x'>]]></Note>")
    + "<Document DocID='e' DocType='Message'/>"
    + "<Document\n DocType = \"File\"\tDocID='f' ></Document >"
    + doc(3, kind="File")
    + "</Documents></Batch></Root>"
)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 10_000])
def test_entries_whatever_the_pieces(size):
    """The same elements as a parser of the whole file finds, wherever a piece ends."""
    got = list(loadfile.entries(pieces(ODD, size)))
    want = [ElementTree.tostring(e) for e in ElementTree.fromstring(ODD).iter("Document")]
    assert [ElementTree.tostring(ElementTree.fromstring(t)) for t, complete in got if complete] == [w.split(b"</Document>")[0] + b"</Document>" if b"</Document>" in w else w for w in want]
    assert all(c for _, c in got) and len(got) == 5
    rows = [r for t, c in got if (r := loadfile.entry(t, c))]
    assert [r["docid"] for r in rows] == ["3.1", "3.2", "e"]
    assert rows[0] | {"error": None} == {"docid": "3.1", "doc_type": "Message", "native": "n/1.eml", "custodian": "Ann ß", "count": "1", "names": "a&b;<c>", "has_attachments": False, "error": None}


BROKEN = {
    "<Document DocID='b1' DocType='Message'><Tags></Document>": ("b1", "ParseError"),
    "<Document DocID='b2' DocType='Message'><Tags>": ("b2", "ParseError"),  # never ends
    "<Document DocID=\"b3 DocType='Message'><Tag/></Document>": (None, "ParseError"),  # an open quote
    "<Document DocType='Message' DocID='b4'>&nothing;</Document>": ("b4", "ParseError"),
    "<Document DocID='b5' DocType='File'><Tags></Document>": None,  # no message
    "<Document DocID='b6' DocType='Message'>\x01</Document>": ("b6", "ParseError"),
    "<Document DocType='Message'></Document>": (None, None),
}


@pytest.mark.parametrize("size", [1, 5, 64, 100_000])
def test_a_broken_entry_costs_itself(size):
    rng, parts, want = random.Random(size), [], []
    for k in range(60):
        if k % 2:
            text = rng.choice(list(BROKEN))
            parts.append(text)
            want += [BROKEN[text]] if BROKEN[text] else []
        else:
            parts.append(doc(k))
            want.append((f"3.{k}", None))
    got = [r for t, c in loadfile.entries(pieces("<Root><Documents>" + "\n".join(parts) + "</Documents></Root>", size)) if (r := loadfile.entry(t, c))]
    assert [(r["docid"], r.get("error")) for r in got] == want


def test_too_long_an_entry():
    text = doc(1) + "<Document DocID='long' DocType='Message'>" + "<x/>" * 50_000 + "</Document>" + doc(2) + "<Document DocID='open' DocType='Message'>" + "y" * 200_000
    got = [loadfile.entry(t, c) for t, c in loadfile.entries(pieces(text, 1_000), longest=20_000)]
    assert [(r["docid"], r.get("error")) for r in got] == [("3.1", None), ("long", "ParseError"), ("3.2", None), ("open", "ParseError")]


@pytest.mark.parametrize("code", ["utf-8", "utf-8-sig", "utf-16", "latin-1", "cp1252"])
def test_encodings(code):
    text = f"<?xml version='1.0' encoding='{code.removesuffix('-sig')}'?><Root>{doc(7)}</Root>"
    got = list(loadfile.entries(loadfile.decoded(io.BytesIO(text.encode(code)), 13 if code.startswith("utf-8") else 400)))
    assert loadfile.entry(*got[0])["custodian"] == "Ann ß"
    bad = b"<Root>" + doc(7).encode().replace("ß".encode(), b"\xff") + b"</Root>"
    assert loadfile.entry(*next(loadfile.entries(loadfile.decoded(io.BytesIO(bad)))))["custodian"] == "Ann �"


def test_memory_does_not_grow_with_the_file():
    """100,000 entries, 40 MB of text: what is held is a piece, not the file."""

    def stream():
        held = []
        for i in range(100_000):
            held.append(doc(i))
            if len(held) == 2_000:
                yield "".join(held)
                held = []

    tracemalloc.start()
    n = sum(1 for _ in loadfile.entries(stream()))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100_000 and most < 8_000_000


def test_zips_with_broken_entries(spark, tmp_path):
    """Through Spark: entries of several load files; folders are passed over; failures itemised beside the good rows."""
    with zipfile.ZipFile(tmp_path / "edrm-enron-v2_jones-p_xml.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xml", "<Root>" + doc(1) + "<Document DocID='3.9' DocType='Message'><Tags></Document>" + doc(2) + "</Root>")
        z.writestr("b.xml", "<Root>" + doc(4) + "<Document DocID='3.8' DocType='Message'><Tags>")
        z.writestr("folder/c.xml", "<Root>" + doc(5) + "</Root>")
        for i in (1, 2, 4):
            z.writestr(f"n/{i}.eml", b"From: Ann <a@b.c>\r\nSubject: x\r\n\r\nhello\r\n")
    got = messages.load_zips(spark, str(tmp_path / "*.zip"), partitions=2)
    assert {r["source_file"].rpartition("/")[2] for r in got.messages.collect()} == {"1.eml", "2.eml", "4.eml"}
    assert {(r["docid"], r["error"]) for r in got.failures.collect()} == {("3.9", "ParseError"), ("3.8", "ParseError")}
    assert {r["attachment_names"][0] for r in got.messages.collect()} == {"a&b"}
