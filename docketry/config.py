"""Configuration: YAML mappings to frozen dataclasses, by one table of fields for each file.

A field says where its value stands (dots lead into mappings), of which type it must be, and how it is converted. All faults of a file are
reported at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from pathlib import Path
from typing import Any

from .operators.spend import Budget

MISSING = object()


@dataclass(frozen=True)
class Pipeline:
    paths: dict[str, str]
    models: dict[str, str]
    batch: dict
    seeds: dict[str, int]
    sampling: dict
    normalization_version: str
    preprocess: dict
    ingest: dict


@dataclass(frozen=True)
class Corpus:
    corpus: str
    format: str
    files: tuple[dict, ...]
    chosen_topics: tuple[str, ...]
    custodians: tuple[dict, ...]
    expected_message_count: int | None


@dataclass(frozen=True)
class Field:
    kind: type | tuple[type, ...]
    at: str | None = None  # the field's own name
    default: Any = MISSING
    convert: Callable[[Any], Any] = lambda x: x
    fault: Callable[[Any], str | None] = lambda x: None


def _price_fault(prices: dict) -> str | None:
    odd = sorted(m for m, p in prices.items() if not isinstance(p, dict) or p.keys() ^ {"input", "output"})
    return f"prices of {odd} need input and output" if odd else None


FIELDS: dict[type, dict[str, Field]] = {
    Pipeline: {
        **{name: Field(dict) for name in ("paths", "models", "batch", "seeds", "sampling")},
        "normalization_version": Field((str, int, float), "normalization.version", convert=str),
        "preprocess": Field(dict, default={}),
        "ingest": Field(dict, default={}),
    },
    Budget: {
        "prices": Field(dict, fault=_price_fault),
        "caps": Field(dict, convert=lambda caps: {phase: float(cap["usd"]) for phase, cap in caps.items()}),
        "total_stop_usd": Field((int, float, str), convert=float),
    },
    Corpus: {
        "corpus": Field(str),
        "format": Field(str),
        "files": Field(list, convert=tuple),
        "chosen_topics": Field(list, default=[], convert=lambda topics: tuple(map(str, topics))),
        "custodians": Field(list, default=[], convert=tuple),
        "expected_message_count": Field((int, type(None)), default=None),
    },
}


def load(path: str | Path) -> dict:
    import yaml

    data = yaml.safe_load(Path(path).read_text())
    if not isinstance(data, dict):
        raise ValueError(f"{path} is no mapping")
    return data


def checked(kind: type, path: str | Path) -> Any:
    """The ``kind`` that a file holds."""
    raw, values, faults = load(path), {}, []
    for name, field in FIELDS[kind].items():
        way = (field.at or name).split(".")
        value = reduce(lambda x, key: x.get(key, field.default) if isinstance(x, dict) else field.default, way, raw)
        if value is MISSING:
            faults.append(f"{'.'.join(way)} is missing")
        elif not isinstance(value, field.kind):
            faults.append(f"{'.'.join(way)} is of type {type(value).__name__}")
        elif said := field.fault(value):
            faults.append(said)
        else:
            values[name] = field.convert(value)
    if faults:
        raise ValueError(f"{Path(path).name}: {'; '.join(faults)}")
    return kind(**values)


def pipeline(path: str | Path) -> Pipeline:
    return checked(Pipeline, path)


def budget(path: str | Path) -> Budget:
    """Prices need exactly an input and an output for each model."""
    return checked(Budget, path)


def corpus(path: str | Path) -> Corpus:
    """The corpus must be the file's name; topics are strings."""
    got = checked(Corpus, path)
    if got.corpus != Path(path).stem:
        raise ValueError(f"corpus {got.corpus} in a file named {Path(path).stem}")
    return got
