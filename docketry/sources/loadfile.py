"""Load files of zips, read entry by entry: what is held is one piece of a file and one batch of entries, whatever the file's length.

A load file is cut into its ``Document`` elements while it is decompressed, and each is parsed for itself. So an entry that is not well-formed, or
never ends, costs itself and no other, and becomes a row with an error. Comments, processing instructions and character data are passed over, whatever stands in them.
"""

from __future__ import annotations

import codecs
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import archives

ENTRIES = "zip string, docid string, doc_type string, native string, custodian string, count string, names string, has_attachments boolean, error string"
_KINDS = {"boolean": pa.bool_(), "string": pa.string()}
SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (f.split() for f in ENTRIES.split(", "))])
#: Characters read at a time, entries in a batch, and characters from which on an entry is given up (its text is not kept).
PIECE, BATCH, LONGEST = 1 << 20, 2_000, 1 << 26
_MARK = re.compile(r"<!--|<!\[CDATA\[|<\?|<Document(?=[\s/>])|</Document\s*>")
_ENDS = {"<!--": "-->", "<![CDATA[": "]]>", "<?": "?>"}
_TAG = re.compile(r"""(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>""")
_ATTRIBUTE = r"""<Document(?:\s[^<>]*?)?\s{}\s*=\s*(?:"([^"<]*)"|'([^'<]*)')"""
_DOCID, _TYPE = (re.compile(_ATTRIBUTE.format(name)) for name in ("DocID", "DocType"))


def entries(pieces: Iterable[str], longest: int = LONGEST) -> Iterator[tuple[str, bool]]:
    """(text, complete) of each ``Document`` element, in order; of one longer than ``longest`` the start only, as not complete."""
    text, at, start, lost = "", 0, None, False  # ``start``: of the open entry; ``lost``: it was given up
    for piece in pieces:
        text += piece
        while m := _MARK.search(text, at):
            if end := _ENDS.get(m[0]):
                to = text.find(end, m.end())
                if to < 0:
                    at = m.start()
                    break
                at = to + len(end)
            elif m[0] == "<Document":
                tag = _TAG.match(text, m.end())
                if not tag and text.find("<", m.end()) < 0:  # the tag may go on in the next piece
                    at = m.start()
                    break
                if start is not None and not lost:
                    yield text[start : m.start()], False
                start, lost, at = m.start(), False, tag.end() if tag else m.end()
                if tag and tag[0].endswith("/>"):
                    yield text[start:at], True
                    start = None
            else:
                if start is not None and not lost:
                    yield text[start : m.end()], True
                start, lost, at = None, False, m.end()
        else:
            at = max(at, text.rfind("<"))  # the last mark may be cut in two
        if start is not None and len(text) - start > longest:
            if not lost:
                yield text[start : start + 10_000], False
            start, lost = at, True
        keep = at if start is None or lost else start
        text, at = text[keep:], at - keep
        start = None if start is None else 0
    if start is not None and not lost:
        yield text[start:], False


def decoded(stream, size: int = PIECE) -> Iterator[str]:
    """The characters of an XML file's bytes, by its byte order mark or declaration, UTF-8 otherwise; bytes that do not decode are replaced."""
    head = stream.read(size)
    marks = [(codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
    named = re.match(rb"""\s*<\?xml[^>]*encoding\s*=\s*["']([\w.-]+)""", head)
    name = next((n for mark, n in marks if head.startswith(mark)), named[1].decode() if named else "utf-8")
    try:
        decoder = codecs.getincrementaldecoder(name)("replace")
    except LookupError:
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
    while head:
        yield decoder.decode(head)
        head = stream.read(size)
    yield decoder.decode(b"", True)


def _said(pattern: re.Pattern, text: str) -> str | None:
    m = pattern.match(text)
    return m and (m[1] if m[1] is not None else m[2])


def entry(text: str, complete: bool) -> dict | None:
    """The row of an entry, without its zip: of messages, and of what cannot be read and may be one. None for other types."""
    try:
        if not complete:
            raise ElementTree.ParseError
        e = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        kind = _said(_TYPE, text)
        return {"docid": _said(_DOCID, text), "doc_type": kind, "error": "ParseError"} if kind in (None, "Message") else None
    if e.get("DocType") != "Message":
        return None
    tags = {t.get("TagName"): t.get("TagValue") for t in e.iter("Tag")}
    natives = [x for f in e.iter("File") if f.get("FileType") == "Native" and (x := f.find("ExternalFile")) is not None]
    owner = e.find(".//Custodian")
    return {
        "docid": e.get("DocID"), "doc_type": "Message", "native": "/".join(x for x in (natives[-1].get("FilePath"), natives[-1].get("FileName")) if x is not None) if natives else None,
        "custodian": None if owner is None else owner.text, "count": tags.get("#AttachmentCount"), "names": tags.get("#AttachmentNames"),
        "has_attachments": tags.get("#HasAttachments") == "true",
    }


def load_files(spark: SparkSession, path: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """``ENTRIES`` of the XML files at the root of zips: one row for each message entry, and for each that cannot be read."""

    def of(opened: Callable, name: str) -> Iterator[dict]:
        with opened() as raw, zipfile.ZipFile(raw) as z:
            for member in sorted(n for n in z.namelist() if n.endswith(".xml") and "/" not in n):
                with z.open(member) as stream:
                    for text, complete in entries(decoded(stream)):
                        if row := entry(text, complete):
                            yield row | {"zip": name}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                held = []
                for row in of(archives.opener(r), r["archive"]):
                    held.append(row)
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_pylist(held, schema=SCHEMA)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=SCHEMA)

    return archives.found(spark, path, files).select("archive", "path", "content").mapInArrow(run, ENTRIES)
