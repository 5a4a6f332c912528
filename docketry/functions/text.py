"""Text functions as built-in expressions: normalisation, hashes, ids, lists, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space.
SPACES = r"\x09-\x0D\x1C-\x1F\x20\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WS = f"[{SPACES}]"
_REPLY = rf"^(?i:(?:{WS}*(?:re|fwd|fw){WS}*:{WS}*)+)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(c), rf"^{WS}+|{WS}+\z", "")


def squeeze(c: Column | str) -> Column:
    """White space runs to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(col(c), rf"{WS}+", " "))


def subject_norm(c: Column | str) -> Column:
    """Reply and forward marks off, white space squeezed, lower case; null stays null."""
    return F.lower(squeeze(F.regexp_replace(col(c), _REPLY, "")))


def body_norm(c: Column | str) -> Column:
    """Line ends to LF, no white space before a line end, no empty lines at both ends."""
    inner = SPACES.replace(r"\x09-\x0D", r"\x09\x0B-\x0D")
    lines = F.regexp_replace(col(c), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, rf"[{inner}]+(?=\n|\z)", ""), r"^\n+|\n+\z", "")


def body_hash(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def token_estimate(c: Column | str) -> Column:
    """A quarter of the code points, rounded down."""
    return F.floor(F.length(col(c)) / 4).cast("int")


def doc_id(corpus: Column | str, source_file: Column | str, source_index: Column | str) -> Column:
    """The one way to mint an id: corpus, dash, 16 hex digits of SHA-256 of ``file:index``."""
    name = F.concat(col(source_file), F.lit(":"), col(source_index).cast("string"))
    known = F.assert_true(col(corpus).isin("enron", "bush"), F.lit("unknown corpus"))
    return F.when(known.isNull(), F.concat(col(corpus), F.lit("-"), F.substring(F.sha2(name, 256), 1, 16)))


def dedup_key(subject: Column | str, body: Column | str) -> Column:
    """SHA-256 over normalised subject (null as empty), NUL, normalised body."""
    return F.sha2(F.concat(F.coalesce(col(subject), F.lit("")), F.lit("\0"), col(body)), 256)


def words(c: Column | str) -> Column:
    return F.filter(F.split(col(c), rf"{WS}+"), lambda w: w != "")


def shingles_of(w: Column, size: int) -> Column:
    """Distinct runs of ``size`` words; of fewer words the whole, of none nothing."""

    def build(w: Column) -> Column:
        n = F.size(w)
        many = F.greatest(n - (size - 1), F.lit(0))
        # whole arrays are zipped: a lambda that looked words up in ``w`` would split the text anew for each
        runs = F.slice(w, F.lit(1), many)
        for k in range(1, size):
            runs = F.zip_with(runs, F.slice(w, F.lit(k + 1), many), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs))

    return F.transform(F.array(w), build)[0]  # bound to a variable, so the words are made once


def collapse(c: Column | str) -> Column:
    """Quote marks off each line's start, then white space squeezed: for containment."""
    return squeeze(F.regexp_replace(col(c), r"(^|\n)[> \t]+", "$1"))


def contained(needle: Column | str, hay: Column | str) -> Column:
    """A needle that is not empty and occurs."""
    return (F.length(col(needle)) > 0) & F.contains(col(hay), col(needle))


def parent_doc(c: Column | str) -> Column:
    """The first three dotted parts."""
    return F.substring_index(col(c), ".", 3)


def is_part(c: Column | str) -> Column:
    return F.size(F.split(col(c), r"\.")) > 3


#: How archive and folder names carry the custodian.
ZIP_NAME, FOLDER_NAME = r"edrm-enron-v2_(.+?)_xml(?:_\d+of\d+)?\.zip\z", r"edrm-enron-v2_(.+?)_xml"


def zip_custodian(c: Column | str) -> Column:
    """Custodian from an archive's name; raises on a name of another form."""
    found = F.regexp_extract(col(c), ZIP_NAME, 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no custodian in "), col(c))))


def member_parts(c: Column | str) -> Column:
    """struct(path, custodian, docid) of a text member's path, null for another kind; a depth other than 3 raises."""
    c = col(c)
    parts = F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    custodian = F.regexp_extract(parts[0], FOLDER_NAME, 1)
    good = F.struct(F.array_join(parts, "/").alias("path"), custodian.alias("custodian"), F.regexp_replace(parts[2], r"\.txt\z", "").alias("docid"))
    bad = F.raise_error(F.concat(F.lit("unexpected member path "), c)).cast("struct<path:string,custodian:string,docid:string>")
    return F.when(~F.endswith(c, F.lit(".txt")), F.lit(None)).when((F.size(parts) == 3) & (custodian != ""), good).otherwise(bad)


def split_list(c: Column | str, separators: str = ";") -> Column:
    """Items between separators, stripped, without empty ones; null as none."""
    items = F.transform(F.split(F.coalesce(col(c), F.lit("")), f"[{separators}]"), strip)
    return F.filter(items, lambda x: x != "")


def sender(c: Column | str) -> Column:
    """struct(name, addr) of ``Name <addr>``, a bare address, or a bare name."""
    c = col(c)
    inside = F.regexp_extract(c, r"<([^<>]+)>", 1)
    name = strip(F.regexp_replace(strip(F.regexp_replace(c, r"<([^<>]+)>", "")), r'^"+|"+\z', ""))
    bare = strip(c)
    some = lambda x: F.when(x != "", x)
    is_addr = F.contains(bare, F.lit("@")) & ~F.contains(bare, F.lit(" "))
    kind = "struct<name:string,addr:string>"
    return (
        F.when(inside != "", F.struct(some(name).alias("name"), strip(inside).alias("addr")).cast(kind))
        .when(is_addr, F.struct(F.lit(None).alias("name"), bare.alias("addr")).cast(kind))
        .otherwise(F.struct(some(bare).alias("name"), F.lit(None).alias("addr")).cast(kind))
    )


#: Phase codes in request ids.
PHASE_CODES = {"responsiveness": "resp", "privilege": "priv", "qc": "qc"}


def custom_id(doc: Column | str, topic: Column | str, phase: Column | str, tier: Column | str, version: Column | str) -> Column:
    """Request id of five fields; raises on a field with the separator, a bad character, over 64 characters, or an unknown phase."""
    code = F.element_at(F.create_map(*[F.lit(x) for kv in PHASE_CODES.items() for x in kv]), col(phase))
    token = F.regexp_replace(col(version), r"^(.+)\.v(\d+)\z", "$1-v$2")
    fields = [col(doc), col(topic).cast("string"), code, F.concat(F.lit("t"), col(tier).cast("string")), token]
    out = F.concat_ws("__", *fields)
    good = code.isNotNull() & col(version).rlike(r"^.+\.v\d+\z") & out.rlike(r"^[a-zA-Z0-9_-]{1,64}\z")
    for f in fields:
        good = good & ~F.contains(f, F.lit("__"))
    return F.when(F.coalesce(good, F.lit(False)), out).otherwise(F.raise_error(F.concat(F.lit("bad request id "), out)))


def custom_id_fields(c: Column | str) -> Column:
    """struct(doc_id, topic, phase, tier, prompt_version): the inverse."""
    p = F.split(col(c), "__")
    phase = F.element_at(F.create_map(*[F.lit(x) for k, v in PHASE_CODES.items() for x in (v, k)]), p[2])
    version = F.regexp_replace(p[4], r"^(.*)-v([^-]*)\z", "$1.v$2")
    return F.struct(
        p[0].alias("doc_id"), p[1].alias("topic"), phase.alias("phase"), F.regexp_replace(p[3], "^t", "").cast("int").alias("tier"), version.alias("prompt_version")
    )


def hash12(c: Column | str) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, 12)


def version_number(c: Column | str) -> Column:
    """The number of ``<stem>.v<N>``, null for another form."""
    n = F.regexp_extract(col(c), r"^(.+)\.v(\d+)\z", 2)
    return F.when(n != "", n.cast("int"))


def render_document(body: str = "body_text") -> Column:
    """The document part of a request from the columns of ``messages``; a null scalar shows as None."""
    one = lambda c: F.coalesce(F.col(c), F.lit("None"))
    many = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "; ")
    rows = [
        ("custodian", one("custodian")), ("from", one("from_addr")), ("to", many("to")), ("cc", many("cc")),
        ("date", one("date_raw")), ("subject", one("subject")), ("attachments", many("attachment_names")),
    ]
    head = [x for k, v in rows for x in (F.lit(f"{k}: "), v, F.lit("\n"))]
    return F.concat(F.lit("<document>\n<metadata>\n"), *head, F.lit("</metadata>\n<body>\n"), one(body), F.lit("\n</body>\n</document>"))


def message(protocol: Column, document: Column) -> Column:
    return F.concat(protocol, F.lit("\n\n"), document)


def headers_json(m: Column | str) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(m)))))


def tags_map(tags: Column | str) -> Column:
    """Map of an array of struct(name, value); of a repeated name the last value holds."""
    tags = col(tags)
    last = F.filter(tags, lambda t, i: ~F.exists(F.slice(tags, i + 2, F.greatest(F.size(tags) - i - 1, F.lit(0))), lambda u: u["name"] == t["name"]))
    return F.map_from_entries(last)
