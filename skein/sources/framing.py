"""Byte-exact framing of JSONL containers.

A container is read whole, by one task, so that its digest, its records and their running digests
come from one immutable buffer. Containers are independent: a scan is as parallel as it has files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources import rawjson

#: Most bytes of a record; a negative limit is none.
RECORD_LIMIT = 64 << 20
GROWING, FINAL = "growing", "final"


@dataclass(frozen=True)
class Frame:
    """One record: 1-based record and line, the byte range of its data, and its digests."""

    record: int
    start: int
    end: int
    data: bytes
    framing: bytes
    sha256: str
    prefix_sha256: str


class FramingError(ValueError):
    """A container that cannot be framed, and where."""

    def __init__(self, message: str, record: int, start: int) -> None:
        super().__init__(f"record {record} at byte {start}: {message}")
        self.record, self.start = record, start


def frames(content: bytes, tail: str = GROWING, limit: int = RECORD_LIMIT) -> Iterator[Frame]:
    """The records of ``content``, split at line feeds; a carriage return before one belongs to the framing.

    An unterminated tail is a record of its own only if the container is final.
    """
    prefix, at, record = hashlib.sha256(), 0, 1
    while at < len(content):
        stop = content.find(b"\n", at)
        if stop < 0 and tail != FINAL:
            if 0 <= limit < len(content) - at:
                raise FramingError(f"more than {limit} bytes", record, at)
            return
        end = len(content) if stop < 0 else stop
        framing = b"" if stop < 0 else b"\n"
        if framing and end > at and content[end - 1] == 13:
            end, framing = end - 1, b"\r\n"
        data = content[at:end]
        if 0 <= limit < len(data):
            raise FramingError(f"more than {limit} bytes", record, at)
        try:
            rawjson.value(data.decode("utf-8", "replace"))
        except ValueError as error:
            raise FramingError(f"not one JSON value: {error}", record, at) from error
        prefix.update(data + framing)
        yield Frame(record, at, end, data, framing, hashlib.sha256(data + framing).hexdigest(), prefix.copy().hexdigest())
        at, record = end + len(framing), record + 1


def containers(spark: SparkSession, *paths: str) -> DataFrame:
    """path, length, modificationTime and content of the files below ``paths`` that are not empty; unread columns cost nothing."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))


SCHEMA = (
    "path string, revision string, size long, tail string, confirmed_end long, record long, byte_start long, byte_end long, "
    "data binary, framing binary, sha256 string, prefix_sha256 string, error string"
)


def records(files: DataFrame, tail: str = GROWING, limit: int = RECORD_LIMIT) -> DataFrame:
    """The records of ``files`` (path, content), by ``SCHEMA``.

    Every row has its container's revision (digest of the physical bytes), size, tail (clean or
    pending) and confirmed end. A container without a record has one row with a null record, and so
    has one that cannot be framed, with ``error``. Records of a ``.zst`` file have no byte range.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]

    def one(path: str, content: bytes) -> Iterator[list[tuple]]:
        revision, packed = "sha256:" + hashlib.sha256(content).hexdigest(), path.endswith(".zst")
        size = len(content)
        try:
            if packed:
                content = pa.CompressedInputStream(pa.BufferReader(content), "zstd").read()
            found = list(frames(content, tail, limit))
        except (FramingError, OSError) as error:
            yield [(path, revision, size, None, None, None, None, None, None, None, None, None, str(error))]
            return
        end = found[-1].end + len(found[-1].framing) if found else 0
        head = (path, revision, size, "clean" if end == len(content) else "pending", end)
        for at in range(0, len(found), 256):
            yield [
                (*head, f.record, None if packed else f.start, None if packed else f.end, f.data, f.framing, f.sha256, f.prefix_sha256, None)
                for f in found[at : at + 256]
            ]
        if not found:
            yield [(*head, None, None, None, None, None, None, None, None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                for rows in one(path.as_py(), content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.select("path", F.coalesce("content", F.lit(b"")).alias("content")).mapInArrow(run, SCHEMA)


def resume(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, action) for each container of ``now``: continue behind the confirmed end, or replay.

    ``before`` has path, confirmed_end and the digest of the confirmed prefix; ``now`` has path and content.
    """
    both = now.join(before.select("path", F.col("confirmed_end").alias("end"), F.col("prefix_sha256").alias("prefix")), "path", "left")
    grown = (F.octet_length("content") >= F.col("end")) & (F.sha2(F.substring("content", F.lit(1), F.col("end").cast("int")), 256) == F.col("prefix"))
    return both.select("path", F.when(F.col("end").isNull(), "initial").when(grown, "continue").otherwise("replay").alias("action"))
