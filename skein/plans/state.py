"""Retained evidence: compressed snapshots, and the verified state stream.

A state stream is one JSON record per line: a manifest, then the tables in order, each sorted by its
key. The manifest has a count per table and the digest of all lines behind it, so an import takes all
or nothing. Rows pass the driver one at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators import catalog

SCHEMA = "skein.state/v1"
#: Tables of the stream: key and columns.
TABLES = {
    "snapshot": ("content_hash", "content_hash string, codec string, size long, stored_size long, checksum string, data binary"),
    "checkpoint": ("occurrence", "occurrence string, discovery string, builder string, session string, revision string, snapshot_hash string, change_kind string"),
}
CODEC = "gzip"
#: Characters of a key, behind those that all share, by which rows are dealt in ranges.
RANGE = 2


@F.pandas_udf(T.BinaryType())
def _packed(content: pd.Series) -> pd.Series:
    return content.map(lambda c: gzip.compress(c, 9, mtime=0))


@F.pandas_udf(T.BinaryType())
def _unpacked(data: pd.Series, content_hash: pd.Series, checksum: pd.Series) -> pd.Series:
    def one(packed: bytes, want: str, stored: str) -> bytes:
        if hashlib.sha256(packed).hexdigest() != stored:
            raise ValueError(f"snapshot {want}: the stored bytes are damaged")
        content = gzip.decompress(packed)
        if hashlib.sha256(content).hexdigest() != want:
            raise ValueError(f"snapshot {want}: the content is not what was retained")
        return content

    return pd.Series([one(*x) for x in zip(data, content_hash, checksum)], dtype=object)


def snapshots(contents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Snapshots of the distinct ``contents`` (content) that ``known`` does not hold; equal bytes are stored once."""
    rows = contents.select(F.sha2("content", 256).alias("content_hash"), "content")
    if known is not None:
        rows = catalog.missing(rows, known, ["content_hash"])
    rows = rows.groupBy("content_hash").agg(F.first("content").alias("content"))
    packed = rows.select("content_hash", F.lit(CODEC).alias("codec"), F.octet_length("content").cast("long").alias("size"), _packed("content").alias("data"))
    return packed.select("content_hash", "codec", "size", F.octet_length("data").cast("long").alias("stored_size"), F.sha2("data", 256).alias("checksum"), "data")


def contents(snapshot: DataFrame) -> DataFrame:
    """(content_hash, content); damaged or altered snapshots are an error."""
    return snapshot.select("content_hash", _unpacked("data", "content_hash", "checksum").alias("content"))


def changes(before: DataFrame, snapshot: DataFrame, now: DataFrame) -> DataFrame:
    """(occurrence, snapshot_hash, change_kind) of ``now`` (occurrence, content) against the retained bytes."""
    held = before.select("occurrence", F.col("snapshot_hash").alias("content_hash")).join(contents(snapshot), "content_hash").select("occurrence", F.col("content").alias("_old"))
    both = now.select("occurrence", "content").join(held, "occurrence", "left")
    return both.select("occurrence", F.sha2("content", 256).alias("snapshot_hash"), catalog.change_kind(F.col("_old"), F.col("content")).alias("change_kind"))


def _line(schema: str, columns: list[Column]) -> Column:
    return F.to_json(F.struct(F.lit(schema).alias("schema"), F.struct(*columns).alias("record")))


def stream(tables: dict[str, DataFrame]) -> DataFrame:
    """(position, name, key, line): the records of a state stream, numbered from 1 in its order: by table, then by key.

    Rows are sorted in ranges of the characters in which a table's keys first differ; a number is the rows of
    the ranges before and the place in its own. So no task sorts them all, and only ranges are added up.
    """
    parts = []
    for number, (name, (key, ddl)) in enumerate(TABLES.items()):
        columns = [F.base64(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in T.StructType.fromDDL(ddl)]
        least, most = tables[name].agg(F.min(key), F.max(key)).first()
        cut = F.substring(key, 1, len(os.path.commonprefix([least or "", most or ""])) + RANGE)
        parts.append(tables[name].select(F.lit(number).alias("number"), F.lit(name).alias("name"), F.col(key).alias("key"), cut.alias("cut"), _line(f"{SCHEMA}/{name}", columns).alias("line")))
    rows = reduce(DataFrame.unionByName, parts)
    before = Window.orderBy("number", "cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("number", "cut").agg(F.count("*").alias("n")).select("number", "cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("number", "cut").orderBy("key")
    return rows.join(starts, ["number", "cut"]).select((F.col("start") + F.row_number().over(own)).alias("position"), "name", "key", "line")


def _lines(tables: dict[str, DataFrame]) -> Iterator[tuple[str, str]]:
    for row in stream(tables).orderBy("position").select("name", "line").toLocalIterator(prefetchPartitions=True):
        yield row[0], row[1]


def export(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Write the stream to a new local file; an existing one is an error."""
    counts, digest = dict.fromkeys(TABLES, 0), hashlib.sha256()
    width = 512  # room for the manifest, which is known last
    with open(path, "x+b") as file:
        file.write(b" " * (width - 1) + b"\n")
        for name, line in _lines(tables):
            data = line.encode() + b"\n"
            counts[name] += 1
            digest.update(data)
            file.write(data)
        manifest = json.dumps({"schema": SCHEMA, "counts": counts, "checksum": "sha256:" + digest.hexdigest()}).encode()
        file.seek(0)
        file.write(manifest.ljust(width - 1) + b"\n")
    return counts


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a stream, after every check: digest, counts, unique keys, closed schemas, references."""
    digest, counts = hashlib.sha256(), dict.fromkeys(TABLES, 0)
    with open(path, "rb") as file:
        manifest = json.loads(file.readline())
        if manifest.get("schema") != SCHEMA:
            raise ValueError("not a state stream of this version")
        for line in file:
            digest.update(line)
            kind = json.loads(line)["schema"].removeprefix(f"{SCHEMA}/")
            if kind not in counts:
                raise ValueError(f"unknown record {kind}")
            counts[kind] += 1
    if manifest["checksum"] != "sha256:" + digest.hexdigest() or manifest["counts"] != counts:
        raise ValueError("the stream does not match its manifest")
    lines = spark.read.option("lineSep", "\n").text(f"file://{path}")
    out = {}
    for name, (key, ddl) in TABLES.items():
        fields = T.StructType.fromDDL(ddl).fields
        plain = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.BinaryType) else f.dataType) for f in fields])
        record = T.StructType([T.StructField("schema", T.StringType()), T.StructField("record", plain)])
        rows = lines.select(F.from_json("value", record, {"mode": "FAILFAST"}).alias("r")).where(F.col("r.schema") == f"{SCHEMA}/{name}")
        out[name] = rows.select(*[F.unbase64(f"r.record.{f.name}").alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f"r.record.{f.name}") for f in fields])
        if out[name].groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{name}: a key occurs twice")
    held = out["snapshot"].select(F.col("content_hash").alias("snapshot_hash"))
    if catalog.missing(out["checkpoint"], held, ["snapshot_hash"]).limit(1).count():
        raise ValueError("a checkpoint names a snapshot that is not in the stream")
    return out
