"""Verdicts in free text: the last complete JSON object with the wanted keys."""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

WANTED = frozenset(("decision", "confidence", "rationale"))
VERDICT = "struct<decision:string,confidence:double,rationale:string,error:string>"
_DECODER = json.JSONDecoder()


def values_in(text: str) -> Iterator[dict]:
    """The JSON objects of a text from left to right, without those inside of others."""
    behind = 0
    for brace in re.finditer(r"\{", text):
        if brace.start() >= behind:
            with contextlib.suppress(json.JSONDecodeError):
                value, behind = _DECODER.raw_decode(text, brace.start())
                yield value


def last_verdict(text: str | None) -> dict:
    """decision, confidence and rationale, or the reason why there is none in ``error``."""
    text = text or ""
    answers = [x for x in values_in(text) if WANTED.issubset(x)]
    if not answers:
        return {"error": "no object with decision, confidence and rationale" if "{" in text else "no JSON object"}
    answer = answers[-1]
    try:
        return {"decision": str(answer["decision"]), "confidence": float(answer["confidence"]), "rationale": str(answer["rationale"]), "error": None}
    except (TypeError, ValueError):
        return {"error": "confidence is no number"}


def _parse(texts: pa.Array) -> pa.Array:
    kind = pa.struct([("decision", pa.string()), ("confidence", pa.float64()), ("rationale", pa.string()), ("error", pa.string())])
    return pa.array([last_verdict(t) for t in texts.to_pylist()], kind)


def parse_verdict(c: Column | str) -> Column:
    """struct(decision, confidence, rationale, error).

    A text that is one flat object is read by ``from_json`` on the JVM; nested braces need a scan and go to Arrow batches.
    """
    c = col(c)
    flat = c.rlike(r'^\s*\{[^{}]*\}\s*\z') & c.contains('"decision"') & c.contains('"rationale"')
    quick = F.from_json(c, "decision string, confidence double, rationale string")
    sure = flat & quick["decision"].isNotNull() & quick["confidence"].isNotNull() & quick["rationale"].isNotNull()
    slow = F.arrow_udf(_parse, VERDICT)(F.when(~F.coalesce(sure, F.lit(False)), c))
    return F.when(sure, F.struct(quick["decision"].alias("decision"), quick["confidence"].alias("confidence"), quick["rationale"].alias("rationale"), F.lit(None).cast("string").alias("error"))).otherwise(slow)
