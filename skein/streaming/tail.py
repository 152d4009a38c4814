"""A stream of the complete records of growing JSONL containers.

The offset is, for each file, the end of its last complete record, the number of that record and the
digest of all bytes before. A file is continued while those bytes are unchanged, and replayed from
its start otherwise; a file whose size and time are as before is not opened at all. The tail behind the
last line feed waits. Files must be where every executor can open them.
"""

from __future__ import annotations

import glob
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from skein.sources.framing import frames

#: Bytes that are read at a time.
CHUNK = 1 << 20
SCHEMA = "path string, replay long, record long, byte_start long, byte_end long, data binary"


@dataclass
class _Range(InputPartition):
    """Complete records of one file: the bytes from ``start`` to ``end``, after ``record`` records."""

    path: str
    replay: int
    start: int
    end: int
    record: int


def _state(path: str, before: dict | None) -> dict:
    """The offset of one file now, given what it was; a file whose size and time are as before is not opened."""
    stat = os.stat(path)
    stamp = [stat.st_size, stat.st_mtime_ns]
    if before and before["stamp"] == stamp:
        return before
    end, record, replay = (before["end"], before["record"], before["replay"]) if before else (0, 0, 0)
    with open(path, "rb") as file:
        digest = hashlib.sha256()
        for data in _chunks(file, end):
            digest.update(data)
        if before and (file.tell() < end or digest.hexdigest() != before["prefix"]):
            file.seek(0)
            end, record, replay, digest = 0, 0, replay + 1, hashlib.sha256()
        prefix, at = digest.copy(), end
        for data in _chunks(file, None):
            stop = data.rfind(b"\n") + 1
            if stop:
                prefix = digest.copy()
                prefix.update(data[:stop])
                end, record = at + stop, record + data.count(b"\n")
            digest.update(data)
            at += len(data)
    return {"end": end, "record": record, "replay": replay, "prefix": prefix.hexdigest(), "stamp": stamp}


def _chunks(file: BinaryIO, most: int | None) -> Iterator[bytes]:
    """The next ``most`` bytes of a file (all if none), a part at a time."""
    left = most
    while left is None or left > 0:
        data = file.read(CHUNK if left is None else min(CHUNK, left))
        if not data:
            return
        if left is not None:
            left -= len(data)
        yield data


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str) -> None:
        self.pattern, self.seen = pattern, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.seen = {p: _state(p, self.seen.get(p)) for p in sorted(glob.glob(self.pattern, recursive=True)) if os.path.isfile(p)}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        self.seen = {**start, **self.seen}
        out = []
        for path, now in end.items():
            old = start.get(path)
            fresh = old is None or old["replay"] != now["replay"]
            at, record = (0, 0) if fresh else (old["end"], old["record"])
            if now["end"] > at:
                out.append(_Range(path, now["replay"], at, now["end"], record))
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as file:
            file.seek(partition.start)
            content = file.read(partition.end - partition.start)
        for f in frames(content):
            yield partition.path, partition.replay, partition.record + f.record, partition.start + f.start, partition.start + f.end, f.data


class TailSource(DataSource):
    """``spark.readStream.format("skein_tail").option("pattern", glob).load()``."""

    @classmethod
    def name(cls) -> str:
        return "skein_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options["pattern"])
