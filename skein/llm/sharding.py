"""Equal-bytes shards by histogram sort.

Documents are ordered by (hash of the text, doc_id), so that equal texts lie side by side. The
driver holds, for each of the 15 boundaries between 16 shards, an interval of keys that contains it;
each round probes all open intervals at several keys, one aggregation counts the exact bytes and rows
below every probe, and the intervals shrink until every boundary meets the tolerance. What reaches
the driver is one row per probe, whatever the input. Only then do the documents move, once, in parts:
ranges of hashes within a shard, as many as the rows ask for, and where one range holds far more than
its share (a frequent text), pieces of it by a hash of the id. A part is sorted and numbered by itself;
the rows of the parts before it in the shard are counted beforehand, so slots are gapless.

A boundary falls between two groups of equal texts wherever the tolerance allows; a group is cut
(by doc_id) only if keeping it whole would break the tolerance: shards of near equal sizes can't hold
a text that makes up more of the input than a shard does.

Defined results
    null text        no bytes, size 1
    null doc_id      sorts before every other id
    repeated rows    rows with equal text and id stay in one shard; each has its own slot
    ties             rows of equal hash and id are numbered in any order
    very long texts  a text is one row; a shard with a text longer than its share holds that text
    empty table      empty result
    extra columns    kept; input columns named as a result column are replaced
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.storage import Workspace

#: Probes of each open boundary in a round.
PROBES = 8
#: Rows of a range of hashes (about), and the least and greatest number of ranges: a power of two.
ROWS, RANGES = 1 << 18, (1 << 10, 1 << 16)
#: Ranges with more than so many times their share are cut in pieces.
HEAVY = 4
_BIAS = 1 << 63
_HASH, _ID = "_skein_hash", "_skein_id"


def _key(hash_: int, id_: int) -> int:
    return (hash_ + _BIAS) << 64 | (id_ + _BIAS)


def _below(key: int) -> str:
    """SQL for whether a row's key is less than ``key``."""
    h, i = (key >> 64) - _BIAS, (key & ((1 << 64) - 1)) - _BIAS
    if h >= _BIAS:
        return "true"
    return f"({_HASH} < {_long(h)} OR ({_HASH} = {_long(h)} AND {_ID} < {_long(i)}))"


def _long(x: int) -> str:
    return f"{x}L" if x > -_BIAS else f"({x + 1}L - 1L)"


def _search(keys: list[int], at: int = 0) -> str:
    if not keys:
        return str(at)
    mid = len(keys) // 2
    return f"CASE WHEN {_below(keys[mid])} THEN {_search(keys[:mid], at)} ELSE {_search(keys[mid + 1 :], at + mid + 1)} END"


def _bin(keys: list[int]) -> Column:
    """The number of ``keys`` (sorted) that are not above a row's key, by binary search."""
    return F.expr(_search(keys))


def _histogram(keys: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int]]:
    """For each bin between probes: bytes, rows, least and greatest key (0 and -1 if it is empty)."""
    found = (
        keys.groupBy(_bin(probes).alias("bin"))
        .agg(F.sum("size"), F.count("*"), F.min(F.struct(_HASH, _ID)), F.max(F.struct(_HASH, _ID)))
        .collect()
    )
    by = {r[0]: (r[1], r[2], _key(*r[3]), _key(*r[4])) for r in found}
    return [by.get(k, (0, 0, 0, -1)) for k in range(len(probes) + 1)]


@dataclass
class Boundary:
    """A boundary that ought to have ``target`` bytes below it; ``low`` and ``high`` are keys around it."""

    target: float
    low: int
    high: int
    key: int | None = None

    def probes(self) -> list[int]:
        """Keys inside the interval, between groups while it holds more than one hash, and those that close it."""
        step = max(1, (self.high - self.low) // (PROBES + 1))
        keys = [self.low + step * (k + 1) for k in range(PROBES)]
        if self.low >> 64 != self.high >> 64:
            keys = [*(k >> 64 << 64 for k in keys), self.high >> 64 << 64]
        else:
            keys.append(self.high)
        return [k for k in {*keys, self.low, self.high + 1} if self.low <= k <= self.high + 1]


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[int]:
    """Keys between shards; ``keys`` has a row's hash, id and size."""
    ((total, rows, least, most),) = _histogram(keys, [])
    if not rows:
        return []
    slack = tolerance * total / shards
    open_ = [Boundary(total * k / shards, least, most) for k in range(1, shards)]
    todo = open_
    while todo:
        probes = sorted({p for b in todo for p in b.probes()})
        bins = _histogram(keys, probes)
        below = [0]
        for size, *_ in bins:
            below.append(below[-1] + size)
        for b in todo:
            at = next(k for k in range(len(bins)) if below[k + 1] >= b.target and bins[k][1])
            _, _, first, last = bins[at]
            # A cut before the first key of this bin or after its last one.
            edges = [(abs(below[at] - b.target), first), (abs(below[at + 1] - b.target), last + 1)]
            miss, key = min(edges)
            if miss <= slack or first == last:
                b.key = key
            else:
                b.low, b.high = first, last
        todo = [b for b in open_ if b.key is None]
    return [b.key for b in open_]


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.002) -> DataFrame:
    """``docs`` with size (UTF-8 bytes plus 1), shard (0 to ``shards`` - 1) and slot (0 on, without gaps)."""
    work = Workspace(docs.sparkSession, "shards")
    text = F.col("text").cast("string")
    keyed = docs.drop("size", "shard", "slot").withColumns(
        {
            "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
            _HASH: F.xxhash64(F.coalesce(text, F.lit(""))),
            _ID: F.coalesce(F.col("doc_id").cast("long"), F.lit(-_BIAS)),
        }
    )
    keys = work.put(keyed.select(_HASH, _ID, "size"), "keys")
    cuts = sorted(splitters(keys, shards, tolerance))
    rows = keys.count()
    ranges = min(RANGES[1], max(RANGES[0], 1 << (rows // ROWS).bit_length()))
    at = {"shard": _bin(cuts), "_skein_range": F.shiftright(_HASH, 65 - ranges.bit_length())}
    # At most ``ranges`` and one more for each cut, however large the input: small enough to send to all.
    pieces = F.ceil(F.count("*") * F.lit(ranges / (HEAVY * max(1, rows)))).cast("int")
    heavy = work.put(keys.withColumns(at).groupBy(*at).agg(pieces.alias("_skein_pieces")).where("_skein_pieces > 1"), "heavy")
    part = [*at, "_skein_piece"]

    def dealt(df: DataFrame) -> DataFrame:
        piece = F.pmod(F.xxhash64(_ID), F.coalesce("_skein_pieces", F.lit(1))).cast("int")
        return df.withColumns(at).join(F.broadcast(heavy), list(at), "left").withColumn("_skein_piece", piece).drop("_skein_pieces")

    counts = dealt(keys).groupBy(*part).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_skein_range", "_skein_piece").rowsBetween(Window.unboundedPreceding, -1)
    # At most ``HEAVY + 1`` times as many rows as ``heavy`` may have.
    starts = work.put(counts.select(*part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_skein_start")), "starts")
    order = Window.partitionBy(*part).orderBy(_HASH, _ID)
    return (
        dealt(keyed)
        .withColumn("_skein_row", F.row_number().over(order))
        .join(F.broadcast(starts), part)
        .withColumn("slot", F.col("_skein_start") + F.col("_skein_row") - 1)
        .select(*docs.drop("size", "shard", "slot").columns, "size", "shard", "slot")
    )
