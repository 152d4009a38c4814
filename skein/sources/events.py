"""The typed model that every harness's records are normalised to: one row per event.

A record that cannot be normalised has one row with ``error``. ``segments`` are the searchable texts
of the event in order; ``content`` holds all blocks, those of a reasoning summary marked as such.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.functions.identity import ID_VERSION

BLOCK = "struct<id:string,kind:string,availability:string,text:string,media_type:string,reference:string,data:binary,native_type:string,summary:boolean>"
USAGE = ("input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens")
SCHEMA = (
    "session string, record long, observation string, native_kind string, native_key string, parent_key string, fork_key string, timestamp_raw string, "
    "event_index int, event string, kind string, role string, content array<" + BLOCK + ">, segments array<struct<kind:string,text:string>>, "
    "call_id string, name string, status string, payload binary, payload_type string, facts array<struct<kind:string,value:string>>, "
    "usage struct<" + ",".join(f"{u}:long" for u in USAGE) + ">, marker string, state string, native_type string, "
    "external array<string>, diagnostics array<string>, error string"
)
TEXT, JSON = "text/plain; charset=utf-8", "application/json"


def derived_id(kind: str, *values: str) -> str:
    """The identity of ``skein.functions.identity``, for use inside a worker."""
    digest = hashlib.sha256()
    for value in (ID_VERSION, kind, *values):
        data = value.encode()
        digest.update(struct.pack(">I", len(data)) + data)
    return f"{kind}:sha256:{digest.hexdigest()}"


class Event(dict):
    """One event row under construction."""

    def __init__(self, observation: str, index: int, kind: str) -> None:
        super().__init__(event_index=index, kind=kind, event=derived_id("event", observation, str(index), kind), content=[])

    def block(self, kind: str, at: int | None = None, summary: bool = False, availability: str = "available", **fields: Any) -> None:
        """Add a content block; ``at`` is its number if it is not the next."""
        number = len(self["content"]) if at is None else at
        self["content"].append({"id": derived_id("content", self["event"], str(number), kind), "kind": kind, "availability": availability, "summary": summary, **fields})

    def text(self, text: str, **more: Any) -> None:
        self.block("text", text=text, **more)

    def opaque(self, native_type: str, data: bytes, media_type: str = JSON, **more: Any) -> None:
        self.block("opaque", native_type=native_type, data=data, media_type=media_type, **more)

    def media(self, media_type: str, reference: str | None, data: bytes | None, **more: Any) -> None:
        where = "external" if data is None else "available"
        self.block("media", availability=where, media_type=media_type, reference=None if data is not None else reference, data=data, **more)

    def put_payload(self, data: bytes, media_type: str) -> None:
        self.update(payload=data, payload_type=media_type)

    def texts(self, summary: bool) -> str:
        """The available text blocks that are not empty, by lines."""
        return "\n".join(b["text"] for b in self["content"] if b.get("text") and b["availability"] == "available" and b["summary"] == summary)

    def segments(self) -> list[dict]:
        kind = self["kind"]
        if kind == "reasoning":
            return [{"kind": "reasoning", "text": self.texts(False)}, {"kind": "reasoning_summary", "text": self.texts(True)}]
        if kind == "message":
            role = self["role"]
            return [{"kind": role if role in ("assistant", "system") else "system" if role == "developer" else "user", "text": self.texts(False)}]
        if kind not in ("tool_call", "tool_result"):
            return []
        try:
            payload = self["payload"].decode()
        except UnicodeDecodeError:
            payload = ""
        return [{"kind": kind, "text": "\n".join(x for x in (self.get("name") or "", payload) if x)}]


def data_uri(reference: str, fallback: str) -> tuple[str, bytes | None]:
    """Media type and bytes of a ``data:`` URI; no bytes for any other reference."""
    if not reference.startswith("data:"):
        return fallback, None
    head, comma, body = reference[5:].partition(",")
    if not comma:
        raise ValueError("data URI has no payload separator")
    parts = head.split(";")
    if parts[-1] == "base64":
        return parts[0] or fallback, base64.b64decode(body, validate=True)
    if re.search(r"%(?![0-9A-Fa-f]{2})", body):
        raise ValueError("data URI has an incomplete escape")
    return parts[0] or fallback, unquote_to_bytes(body)


#: (session, record, data, framing digest) to the shared columns and the events of a record.
Normalise = Callable[[str, int, bytes, str], tuple[dict, list[Event]]]


def normalised(records: DataFrame, normalise: Normalise) -> DataFrame:
    """Events, by ``SCHEMA``, of ``records`` (session, record, data, sha256)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for session, record, data, digest in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    shared, events = normalise(session, record, data, digest)
                except ValueError as error:
                    rows.append({"session": session, "record": record, "error": str(error)})
                    continue
                for number, event in enumerate(events):
                    event["segments"] = event.segments()
                    # What concerns the record as a whole stands on its first event.
                    whole = {} if number else {k: shared[k] for k in ("diagnostics", "external") if k in shared}
                    rows.append({"session": session, "record": record, **{k: v for k, v in shared.items() if k not in ("diagnostics", "external")}, **event, **whole})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return records.select("session", "record", "data", "sha256").mapInArrow(run, SCHEMA)
