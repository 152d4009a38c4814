"""JSON objects with the exact text of their members.

Spark's JSON functions re-serialise what they extract; the text of a tool's input and output must
stay as it was written, so objects are cut here by the positions at which the decoder stops.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _no_constant(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_constant=_no_constant)
_BLANK = " \t\n\r"


@dataclass(frozen=True)
class Member:
    """A value and its text."""

    value: Any
    raw: str


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in _BLANK:
        at += 1
    return at


def value(text: str) -> Any:
    """The one JSON value that ``text`` is; anything else is an error."""
    at = _skip(text, 0)
    out, end = _DECODER.raw_decode(text, at)
    if _skip(text, end) != len(text):
        raise ValueError(f"text after the value at {end}")
    return out


def _items(text: str, opening: str, closing: str) -> Any:
    at = _skip(text, 0)
    if text[at : at + 1] != opening:
        raise ValueError(f"{opening} expected")
    at = _skip(text, at + 1)
    while text[at : at + 1] != closing:
        name = None
        if opening == "{":
            name, at = _DECODER.raw_decode(text, at)
            at = _skip(text, _skip(text, at) + 1)
        found, end = _DECODER.raw_decode(text, at)
        yield name, Member(found, text[at:end])
        at = _skip(text, end)
        if text[at : at + 1] == ",":
            at = _skip(text, at + 1)


def members(text: str) -> dict[str, Member]:
    """The members of an object whose value is not null; of equal names the last counts."""
    value(text)
    return {k: m for k, m in dict(_items(text, "{", "}")).items() if m.value is not None}


def elements(text: str) -> list[Member]:
    """The elements of an array."""
    value(text)
    return [m for _, m in _items(text, "[", "]")]


def string(found: dict[str, Member], name: str) -> str | None:
    """A member that must be a string if it is there."""
    if name not in found:
        return None
    if not isinstance(found[name].value, str):
        raise ValueError(f"{name} must be a string")
    return found[name].value


def integer(found: dict[str, Member], name: str) -> int | None:
    """A member that must be a whole number of 64 bits if it is there."""
    if name not in found:
        return None
    out = found[name].value
    if not isinstance(out, int) or isinstance(out, bool) or not -(1 << 63) <= out < 1 << 63:
        raise ValueError(f"{name} must be an integer")
    return out


def boolean(found: dict[str, Member], name: str) -> bool | None:
    if name in found and not isinstance(found[name].value, bool):
        raise ValueError(f"{name} must be a boolean")
    return found[name].value if name in found else None


def object_(found: dict[str, Member], name: str) -> dict[str, Member]:
    """The members of a member that must be an object if it is there."""
    return members(found[name].raw) if name in found else {}


def member_texts(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """``rows`` with a string column for each of ``names``: the exact text of that member of the object in ``column``, or null."""
    columns = rows.columns
    at = columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [members(t) if t is not None else {} for t in batch.column(at).to_pylist()]
            made = [pa.array([f[n].raw if n in f else None for f in found], pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*columns, *names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(n, T.StringType()) for n in names)]))
