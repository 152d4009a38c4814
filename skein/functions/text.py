"""Text functions of the projection and of the search."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes of one passage part.
MAX_BODY_BYTES = 65_536


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\0"), F.lit(""))


def removed_nul(text: Column) -> Column:
    """How many bytes ``without_nul`` drops."""
    return (F.octet_length(text) - F.octet_length(without_nul(text))).cast("long")


def join_non_empty(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n")


def display(body: Column, limit: int) -> Column:
    """White space collapsed; cut to ``limit`` code points, with ``...`` if anything was cut."""
    flat = F.trim(F.regexp_replace(body, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat) if limit > 0 else flat


def passage_kind(event: Column, role: Column) -> Column:
    """The class of an event's passage; every role but assistant, system and developer counts as user."""
    message = F.when(role == "assistant", "assistant").when(role.isin("system", "developer"), "system").otherwise("user")
    return F.when(event.isin("reasoning", "tool_call", "tool_result"), event).when(event == "message", message).otherwise("system")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, repeats included."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _windows(data: bytes, most: int) -> Iterator[bytes]:
    """Pieces of at most ``most`` bytes that split no code point."""
    at = 0
    while at < len(data):
        end = min(len(data), at + most)
        while end < len(data) and end > at and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def parts_of(body: str, most: int = MAX_BODY_BYTES) -> list[str]:
    """``body`` in parts of at most ``most`` bytes, cut at line ends, or inside a longer line between code points.

    The parts concatenate to ``body``. ``most`` must hold any one code point (4 bytes).
    """
    data = body.encode()
    if len(data) <= most:
        return [body]
    out: list[bytes] = []
    held = b""
    for line in _lines(data):
        if held and len(held) + len(line) > most:
            out.append(held)
            held = b""
        if len(line) <= most:
            held += line
            continue
        pieces = list(_windows(line, most))
        if held:
            out.append(held)
        out += pieces[:-1]
        held = pieces[-1]
        if len(held) == most:
            out.append(held)
            held = b""
    return [x.decode() for x in ([*out, held] if held else out)]


def _lines(data: bytes) -> list[bytes]:
    lines = data.split(b"\n")
    return [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])


def split_bodies(rows: DataFrame, most: int = MAX_BODY_BYTES) -> DataFrame:
    """``rows`` (with a string column ``body``) with a row for each part: part, parts and the part as ``body``.

    Only bodies over the limit leave the JVM.
    """
    whole = rows.where((F.octet_length("body") <= most) | F.col("body").isNull()).withColumns({"part": F.lit(0), "parts": F.lit(1)})
    names = rows.columns
    at = names.index("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [parts_of(x, most) for x in batch.column(at).to_pylist()]
            take = pa.array([k for k, c in enumerate(cut) for _ in c], pa.int64())
            columns = [c.take(take) for c in batch.columns]
            columns[at] = pa.array([x for c in cut for x in c], pa.string())
            part = pa.array([k for c in cut for k in range(len(c))], pa.int32())
            parts = pa.array([len(c) for c in cut for _ in c], pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, part, parts], [*names, "part", "parts"])

    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("parts", T.IntegerType())])
    return whole.unionByName(rows.where(F.octet_length("body") > most).mapInArrow(run, schema))
