"""Deterministic identities as column expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The version strings that enter the digests.
ID_VERSION = "sessionio/id/v1"
REVISION_VERSION = "sessionio.session-revision/v1"


def _bytes(value: Column | str) -> Column:
    return (F.lit(value) if isinstance(value, str) else value).cast("binary")


def framed(*values: Column | str) -> Column:
    """Each value after its length in bytes, as a 4-byte big-endian number."""
    out = []
    for value in values:
        data = _bytes(value)
        out += [F.unhex(F.lpad(F.hex(F.octet_length(data)), 8, "0")), data]
    return F.concat(*out)


def derived_id(kind: str, *values: Column | str) -> Column:
    """``kind:sha256:hex`` over the framed version, kind and values."""
    return F.concat(F.lit(f"{kind}:sha256:"), F.sha2(framed(ID_VERSION, kind, *values), 256))


def revision_hash(occurrence: Column, session: Column, native: Column, discovery: Column, source: Column, title: Column, snapshot: Column) -> Column:
    """Hex digest over NUL-terminated strings and the raw snapshot hash."""
    strings = [F.concat(_bytes(x), F.unhex(F.lit("00"))) for x in (REVISION_VERSION, occurrence, session, native, discovery, source, title)]
    return F.sha2(F.concat(*strings, snapshot), 256)


def content_hash(version: Column | str, kind: Column | str, part: Column, body: Column) -> Column:
    """Hex digest of a projection; it holds no session id, so equal text has equal hashes."""
    zero = F.unhex(F.lit("00"))
    return F.sha2(F.concat(_bytes(version), zero, _bytes(kind), zero, _bytes(part.cast("string")), zero, _bytes(body)), 256)


def builder_key(versions: Column) -> Column:
    """``name=version`` pairs of a map, sorted by name and joined by ``;``."""
    pairs = F.array_sort(F.map_entries(versions))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";")
