"""Where repeated windows may be, and what is left to compare.

``repeats`` finds the segments whose minimizer occurs more than once. Equal segments are one class, told
by two 64-bit hashes; copies are thus counted before any text moves. ``compared`` sends one member of
each class whose minimizer also stands in other surroundings, with its tokens, to the task that holds the
key, where the operator's own index decides window by window. Rows come key by key, so a task holds
one key's index at a time.

A key with more than ``classes`` classes is dealt in parts. Each part is decided on its own and yields
its distinct windows; these meet by their content, one row for each part, however many classes share
a window. So neither a frequent key nor a frequent passage brings an unbounded group into one task.

A row is known by its id and a 64-bit hash of its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.storage import Workspace, tidy
from skein.llm.windows import Spec, covered, scan

#: A null doc_id stands after every other.
NO_ID = (1 << 63) - 1

#: Gets batches of (key, part, parts, dig, copies, doc, mark, start, n, content), sorted by key, part and place.
Resolve = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: What it returns: the windows to remove of a class (``mask``), or a distinct window of a part of a key.
JUDGED = "key long, dig long, mask long, doc long, mark long, start int, offset int, content binary"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def judged_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in JUDGED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], names)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def plain(docs: DataFrame) -> DataFrame:
    """(doc, mark, doc_id, text): what the substring operators read of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("mark"), doc_id.alias("doc_id"), text.alias("text"))


def _segments(texts: DataFrame, spec: Spec) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d, m, t.as_buffer().to_pybytes()) for b in batches for d, m, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
        for found in scan(rows, spec):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["key", "dig", "doc", "mark", "start", "n"])

    return texts.select("doc", "mark", "text").mapInArrow(tidy(run), "key long, dig long, doc long, mark long, start int, n int")


def repeats(texts: DataFrame, spec: Spec, work: Workspace) -> DataFrame:
    """Segments of repeated keys: key, dig, doc, mark, start, n."""
    found = _segments(texts, spec)
    keys = work.put(found.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"), "keys")
    work.release()
    hits = work.put(found.join(keys.hint("merge"), "key"), "hits")
    work.drop("keys")
    work.release()
    return hits


def compared(texts: DataFrame, hits: DataFrame, spec: Spec, work: Workspace, resolve: Resolve, classes: int, earliest: bool) -> DataFrame:
    """All classes: key, dig, copies, lead (place of the first member), mask (the windows of the lead to remove)."""
    place = F.struct("doc", "mark", "start")
    known = hits.groupBy("key", "dig").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "mark", "start", "n")).alias("at"))
    known = work.put(known.select("key", "dig", "copies", "at.*"), "classes")
    work.release()
    sizes = known.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / classes).cast("int").alias("parts"))
    sizes = work.put(sizes, "sizes")
    wanted = (
        known.join(sizes.hint("merge"), "key")
        .groupBy("doc", "mark")
        .agg(F.collect_list(F.struct("start", "n", "key", "dig", "copies", "parts")).alias("wanted"))
    )
    # Staged, so that the shuffles behind it are gone before the texts move.
    wanted = work.put(wanted, "wanted")
    work.release()
    names = ["key", "part", "parts", "dig", "copies", "doc", "mark", "start", "n", "content"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for doc, mark, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                made += ((key, dig % parts, parts, dig, copies, doc, mark, start, n, content) for key, dig, copies, parts, start, n, content in _contents(text, asked, spec))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], kind) for k, kind in enumerate(kinds)], names)

    sent = texts.select("doc", "mark", "text").join(wanted.hint("merge"), ["doc", "mark"]).select("doc", "mark", "text", "wanted")
    sent = sent.mapInArrow(tidy(run), "key long, part int, parts int, dig long, copies long, doc long, mark long, start int, n int, content binary")
    dealt = sent.repartition("key", "part").sortWithinPartitions("key", "part", "doc", "mark", "start")
    judged = work.put(dealt.mapInArrow(tidy(resolve), JUDGED), "judged")
    work.release()
    masks = judged.where("content is null").select("key", "dig", "mask")
    if not sizes.where("parts > 1").isEmpty():
        # Distinct windows of the parts of large keys, one for each part.
        windows = judged.where("content is not null").drop("mask")
        first = windows.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
        again = windows.join(first.hint("merge"), ["key", "content"])
        again = again.where(place != F.col("first")) if earliest else again
        masks = masks.union(again.select("key", "dig", F.expr("shiftleft(1L, offset)").alias("mask")))
    masks = masks.groupBy("key", "dig").agg(F.bit_or("mask").alias("mask"))
    out = known.join(masks.hint("merge"), ["key", "dig"], "left").select("key", "dig", "copies", place.alias("lead"), F.coalesce("mask", F.lit(0)).alias("mask"))
    out = work.put(out, "decided")
    work.drop("classes", "sizes", "wanted", "judged")
    work.release()
    return out


def _contents(text: pa.Scalar, asked: pa.Scalar, spec: Spec) -> Iterator[tuple]:
    data = text.as_buffer().to_pybytes()
    words = data.split() if spec.words else None
    for x in asked.as_py():
        a, end = x["start"], x["start"] + x["n"] + spec.width - 1
        yield x["key"], x["dig"], x["copies"], x["parts"], a, x["n"], b" ".join(words[a:end]) if words is not None else data[a:end]


def removal(hits: DataFrame, decided: DataFrame, earliest: bool) -> DataFrame:
    """(doc, mark, removed): for each row with something to remove, its segments and window masks."""
    full = F.expr("shiftrightunsigned(-1L, 64 - n)")
    keeps = F.struct("doc", "mark", "start") == F.col("lead") if earliest else F.col("copies") == 1
    rows = hits.join(decided.hint("merge"), ["key", "dig"]).select("doc", "mark", "start", F.when(keeps, F.col("mask")).otherwise(full).alias("gone"))
    return rows.where("gone <> 0").groupBy("doc", "mark").agg(F.collect_list(F.struct("start", F.col("gone").alias("mask"))).alias("removed"))


def removed_tokens(n_tokens: int, removed: pa.Scalar, width: int) -> np.ndarray:
    """Which tokens of one document go; ``removed`` as ``removal`` gives it, or null."""
    if not removed.is_valid:
        return np.zeros(n_tokens, bool)
    rows = removed.values
    return covered(n_tokens, rows.field("start").to_numpy(), rows.field("mask").to_numpy(), width)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool]]:
    """The rows that ``Resolve`` gets, each with whether it begins a new (key, part); repeated rows of the input give one."""
    at, last = None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            begins = row[:2] != at
            at = row[:2]
            # A repeated row of the input sends its segments again.
            if begins or (row[3], row[5:8]) != last:
                yield row, begins
            last = (row[3], row[5:8])
