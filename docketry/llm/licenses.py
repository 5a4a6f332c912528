"""License scans by conditional compression.

Candidate blocks need no cue words: a run of words within the tolerance of a template of m words, d of which may differ, shares at least m - 1 - 2d
of its pairs of neighbouring words, within m + d words. Where so many pairs of a template stand so close, there is a block; so no occurrence within
the tolerance is lost. A block is compressed alone and with each of its templates as raw zstandard dictionary; templates are ranked by the
size reduction as a share of the template's own compressed size. In this order each is confirmed by
the exact wording, whatever its gain: the template's words are aligned with the block's, and a template holds if at most ``tolerance`` of its
words differ; the differing words are reported. A word with a part in ``TELLING`` put in, for another word or beside it, or a version number
changed, makes it another license and refuses the template. Every occurrence is reported: what stands before and after one is aligned again. Of
occurrences of one license that overlap, the one with the most words of its template stays.

Of a line ``SPDX-License-Identifier:`` every identifier of the expression is reported in lower case, known to ``TEMPLATES`` or not, with gain 1.

Blocks reach as many words as a template and its tolerance to both sides of the pairs, and overlap by so many, so an
occurrence lies whole in one block wherever it stands. One map over whole texts, no shuffle.

Edge cases: null and empty texts have no blocks; repeated rows are scanned each; null ids take part; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read, texts_of

#: Wording of common license notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("public-domain", "This work is dedicated to the public domain"),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced without prior written permission"),
    ("all-rights-reserved", "All rights reserved"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("lgpl", "GNU Lesser General Public License"),
    ("lgpl", "GNU Library General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl-2.0", "Mozilla Public License, v. 2.0"),
    ("mpl-2.0", "Mozilla Public License, Version 2.0"),
    ("mpl-2.0", "Mozilla Public License 2.0"),
    ("epl-1.0", "Eclipse Public License v1.0"),
    ("epl-1.0", "Eclipse Public License, Version 1.0"),
    ("epl-2.0", "Eclipse Public License v2.0"),
    ("epl-2.0", "Eclipse Public License, Version 2.0"),
    ("epl-2.0", "Eclipse Public License 2.0"),
    ("cc0-1.0", "CC0 1.0 Universal"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("mit", "MIT License"),
    (  # what follows the permission
        "mit",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or "
        "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to "
        "the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        "under copyright law.",
    ),
    ("apache-2.0", "Apache License, Version 2.0"),
    ("apache-2.0", "Apache License 2.0"),
    ("gpl-2.0", "GNU General Public License v2.0"),
    ("gpl-2.0", "GNU General Public License v2"),
    ("gpl-2.0", "GNU GPLv2"),
    ("gpl-2.0", "GNU GPL v2"),
    ("gpl-2.0", "GPL version 2"),
    ("gpl-2.0", "the GPLv2"),
    ("gpl-2.0", "under GPLv2"),
    ("gpl-2.0", "GPLv2 license"),
    ("gpl-3.0", "GNU General Public License v3.0"),
    ("gpl-3.0", "GNU General Public License v3"),
    ("gpl-3.0", "GNU GPLv3"),
    ("gpl-3.0", "GNU GPL v3"),
    ("gpl-3.0", "GPL version 3"),
    ("gpl-3.0", "the GPLv3"),
    ("gpl-3.0", "under GPLv3"),
    ("gpl-3.0", "GPLv3 license"),
    ("gfdl", "GNU Free Documentation License"),
    ("bsd-2-clause", "BSD 2-Clause License"),
    ("bsd-2-clause", "2-Clause BSD License"),
    ("bsd-3-clause", "BSD 3-Clause License"),
    ("bsd-3-clause", "3-Clause BSD License"),
    ("bsl-1.0", "Boost Software License, Version 1.0"),
    ("bsl-1.0", "Boost Software License 1.0"),
    # Creative Commons: each kind and version, in three spellings
    *(
        (f"cc-{kind}-{version}", text)
        for kind, long in (
            ("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"),
            ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
        )
        for version in ("2.0", "2.5", "3.0", "4.0")
        for text in (f"CC {kind.upper()} {version}", f"CC-{kind.upper()}-{version}", f"Creative Commons {long} {version}")
    ),
)
#: Bytes that a dictionary has at least, by repeating a short template: zstandard finds nothing in shorter ones.
LEAST_DICTIONARY = 16
#: Words, or parts of words, that make one license of another.
TELLING = frozenset("lesser library affero documentation sharealike share alike noncommercial commercial noderivatives noderivs derivatives sa nc nd".split())
_ID = rb"[0-9a-z](?:[0-9a-z.+\-]*[0-9a-z+])?"
_SPDX = re.compile(rb"spdx-license-identifier:[ \t(]*" + _ID + rb"(?:[ \t)]+(?:and|or|with)[ \t(]+" + _ID + rb")*")
#: An edit that takes a version number away.
_NUMBER = re.compile(r"-v?[0-9][0-9.]*")
_OPERAND = re.compile(rb"(?:\bwith[ \t(]+)?" + _ID)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+(?:[.\-'+][0-9a-z\x80-\xff]+)*")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def tells_apart(edits: list[str]) -> bool:
    """Whether the edits make another license of a template: a telling word is put in, or a version taken away."""
    words = [x for edit in edits for x in edit.split(" ")]
    return any(_NUMBER.fullmatch(x) or x[0] == "+" and TELLING & set(re.split(r"[^a-z]+", x[1:])) for x in words)


def spdx(low: bytes) -> list[tuple[bytes, int, int]]:
    """Identifier, start and end of every license in the SPDX lines of a lower-cased text; exceptions after ``with`` are none."""
    out = []
    for m in _SPDX.finditer(low):
        for x in _OPERAND.finditer(low, low.index(b":", m.start()) + 1, m.end()):
            if not x.group().startswith((b"with ", b"with\t", b"with(")) and x.group() not in (b"and", b"or", b"none", b"noassertion"):
                out.append((x.group(), x.start(), x.end()))
    return out


def wording_differences(template: list[bytes], block: list[bytes]) -> tuple[int, int, int, list[str]]:
    """Least word edits that turn a run of ``block`` into ``template``: count, start and end of the run, the edits."""
    m, n = len(template), len(block)
    cost = np.zeros((m + 1, n + 1), np.int32)
    cost[:, 0] = np.arange(m + 1)
    idx = np.arange(n + 1)
    codes: dict[bytes, int] = {}
    t = [codes.setdefault(w, len(codes)) for w in template]
    b = np.array([codes.get(w, -1) for w in block], np.int64)
    for i in range(1, m + 1):
        step = np.empty(n + 1, np.int32)
        step[0] = i
        step[1:] = np.minimum(cost[i - 1, :-1] + (b != t[i - 1]), cost[i - 1, 1:] + 1)
        cost[i] = np.minimum.accumulate(step - idx) + idx  # words of the block left over
    end = int(cost[m].argmin())
    i, j, edits = m, end, []
    while i > 0:
        if j > 0 and cost[i, j] == cost[i - 1, j - 1] + (b[j - 1] != t[i - 1]):
            if b[j - 1] != t[i - 1]:
                edits.append(f"-{template[i - 1].decode(errors='replace')} +{block[j - 1].decode(errors='replace')}")
            i, j = i - 1, j - 1
        elif cost[i, j] == cost[i - 1, j] + 1:
            edits.append(f"-{template[i - 1].decode(errors='replace')}")
            i -= 1
        else:
            edits.append(f"+{block[j - 1].decode(errors='replace')}")
            j -= 1
    return int(cost[m, end]), j, end, edits[::-1]


@dataclass
class Template:
    name: str
    words: list[bytes]
    own: int  # compressed size
    given: zstandard.ZstdCompressor
    slack: int  # words that may differ
    pairs: np.ndarray  # sorted codes of neighbouring words


@dataclass
class Scanner:
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    tolerance: float = 0.1
    _ready: list | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"templates": self.templates, "tolerance": self.tolerance, "_ready": None}

    def classes(self) -> list[tuple[int, list[Template]]]:
        """Templates by their number of words."""
        if self._ready is None:
            by_size: dict[int, list] = {}
            self._code: dict[bytes, int] = {}
            options = {"level": 9, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self._plain = zstandard.ZstdCompressor(**options)
            split = [(name, words_of(text.encode())) for name, text in self.templates]
            for _, words in split:
                for w in words:
                    self._code.setdefault(w, len(self._code))
            for name, words in split:
                raw = b" ".join(words)  # layout and punctuation take no part in the sizes
                content = b" ".join([raw] * -(-LEAST_DICTIONARY // len(raw))) if raw else raw
                given = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options)
                codes = np.array([self._code[w] for w in words], np.int64)
                t = Template(name, words, len(self._plain.compress(raw)), given, int(self.tolerance * len(words)), np.unique(codes[:-1] * len(self._code) + codes[1:]))
                by_size.setdefault(len(words), []).append(t)
            self._ready = sorted(by_size.items())
            each = [t for _, x in self._ready for t in x]
            self._pairs = np.unique(np.concatenate([t.pairs for t in each] or [np.zeros(0, np.int64)]))
            self._holds = np.stack([np.isin(self._pairs, t.pairs) for t in each], 1) if each else np.zeros((0, 0), bool)  # pairs x templates
            self._need = np.array([max(1, len(t.words) - 1 - 2 * t.slack) for t in each], np.int64)
            self._single = [(k, self._code[t.words[0]]) for k, t in enumerate(each) if len(t.words) == 1]
        return self._ready

    def spots(self, words: list[bytes]) -> dict[int, list[int]]:
        """Words that stand in pairs of a template as close as an occurrence has them, by number of the template."""
        classes, get = self.classes(), self._code.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
        pair = codes[at] * len(self._code) + codes[at + 1]
        where = np.minimum(np.searchsorted(self._pairs, pair), max(0, len(self._pairs) - 1))
        known = self._pairs[where] == pair if len(self._pairs) else np.zeros(len(pair), bool)
        at, holds = at[known], self._holds[where[known]]
        enough = np.flatnonzero(holds.sum(0) >= self._need) if len(at) else ()
        out: dict[int, list[int]] = {k: np.flatnonzero(codes == code).tolist() for k, code in self._single}
        each = [t for _, x in classes for t in x]
        for k in enough:
            t, own = each[k], at[holds[:, k]]
            size, need = len(t.words), int(self._need[k])
            first = np.flatnonzero(own[need - 1 :] - own[: len(own) - need + 1] <= size + t.slack - 2)
            if len(first):
                out[int(k)] = np.unique(own[(first[:, None] + np.arange(need)).ravel()]).tolist()
        return {k: x for k, x in out.items() if x}

    def occurrences(self, t: Template, words: list[bytes], lo: int = 0) -> list[tuple[int, int, list[str]]]:
        """(start, end, edits) of the template in ``words``, which start at word ``lo``: the best one, and those before and after it."""
        if len(words) < len(t.words) - t.slack:
            return []
        differ, s, e, edits = wording_differences(t.words, words)
        if differ > t.slack:
            return []
        found = [] if tells_apart(edits) else [(lo + s, lo + e, edits)]
        return found + self.occurrences(t, words[:s], lo) + self.occurrences(t, words[max(e, s + 1) :], lo + max(e, s + 1))

    def __call__(self, text: bytes | None) -> tuple[int, list[dict]]:
        """Number of blocks, and all confirmed licenses, best first."""
        if not text:
            return 0, []
        low = text.lower()
        words = _WORD.findall(low)
        classes, spots = self.classes(), self.spots(words)
        found: list[tuple[int, dict]] = [
            (1, {"license": name.decode(), "gain": 1.0, "start": s, "end": e, "differences": []}) for name, s, e in (spdx(low) if b"spdx" in low else [])
        ]
        place = [m.span() for m in _WORD.finditer(low)] if spots else []
        each = [t for _, x in classes for t in x]
        of_block: dict[tuple[int, int], list[int]] = {}  # blocks of templates of one size are often the same
        for k, at in spots.items():
            for block in pieces(at, len(each[k].words) + each[k].slack, len(words)):
                of_block.setdefault(block, []).append(k)
        blocks = len(of_block)
        for (lo, hi), numbers in of_block.items():
            raw = b" ".join(words[lo:hi])
            alone = len(self._plain.compress(raw))
            ranked = sorted((((alone - len(each[k].given.compress(raw))) / each[k].own, -k) for k in numbers), reverse=True)
            for gain, k in ranked:
                t = each[-k]
                for s, e, edits in self.occurrences(t, words[lo:hi], lo):
                    found.append((len(t.words) - len(edits), {"license": t.name, "gain": float(gain), "start": place[s][0], "end": place[e - 1][1], "differences": edits}))
        kept: dict[str, list[dict]] = {}
        for _, x in sorted(found, key=lambda f: (-f[0], len(f[1]["differences"]), f[1]["start"])):
            same = kept.setdefault(x["license"], [])
            if all(x["end"] <= y["start"] or y["end"] <= x["start"] for y in same):
                same.append(x)
        return blocks, sorted((x for same in kept.values() for x in same), key=lambda x: (-x["gain"], x["license"], x["start"]))


def pieces(spots: list[int], size: int, n: int) -> list[tuple[int, int]]:
    """Ranges of words around spots: ``size`` to each side, merged, then cut to 3 sizes with an overlap of one."""
    out: list[tuple[int, int]] = []
    merged: list[list[int]] = []
    for c in spots:
        lo, hi = max(0, c - size), min(n, c + size + 1)
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = hi
        else:
            merged.append([lo, hi])
    for lo, hi in merged:
        while hi - lo > 3 * size:
            out.append((lo, lo + 3 * size))
            lo += 2 * size
        out.append((lo, hi))
    return out


SCHEMA = (
    "doc_id long, n_blocks long, n_licenses long, n_found long, licenses string, best_gain double, "
    "found array<struct<license:string,gain:double,start:int,end:int,differences:array<string>>>"
)


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Licenses of every row of ``docs(doc_id, text)``; offsets are bytes of the UTF-8 text."""
    scanner = scanner or Scanner()
    item = pa.struct(
        [("license", pa.string()), ("gain", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("differences", pa.list_(pa.string()))]
    )

    def run(batch: pa.RecordBatch):
        got = [scanner(t) for t in texts_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([n for n, _ in got], pa.int64()),
                pa.array([len({y["license"] for y in x}) for _, x in got], pa.int64()),
                pa.array([len(x) for _, x in got], pa.int64()),
                pa.array([",".join(sorted({y["license"] for y in x})) for _, x in got], pa.string()),
                pa.array([max((y["gain"] for y in x), default=0.0) for _, x in got], pa.float64()),
                pa.array([x for _, x in got], pa.list_(item)),
            ],
            ["doc_id", "n_blocks", "n_licenses", "n_found", "licenses", "best_gain", "found"],
        )

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document."""
    return scan(read(spark, sf_dir, "documents"))
