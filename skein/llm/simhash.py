"""Near-duplicate documents by 64-bit SimHash and BK-trees.

Two fingerprints that differ in at most ``RADIUS`` bits agree in at least ``BLOCKS - RADIUS`` of
``BLOCKS`` blocks, so each pair of linked fingerprints meets in some shard keyed by the bits of that
many blocks. A shard's distinct fingerprints form a BK-tree: a node's children are keyed by their
Hamming distance to it, and a search follows only the edges within the radius. A shard of more than
``SHARD`` fingerprints is cut into several trees of bounded size, and each tree is sent to each
chunk of the shard's queries. A tree reports a spanning forest of its links, never all pairs;
components are then joined up as tables.

Defined results
    null or blank text   fingerprint zero, linked like any other
    fewer words than a shingle   the whole sequence is the one shingle
    null doc_id          kept; its fingerprint takes part, a group of only null ids has a null id
    repeated rows        each is returned
    empty table          empty result
    extra columns        ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.components import components
from skein.llm.storage import Workspace

RADIUS = 3
BLOCKS = 5
#: Most fingerprints of one tree.
SHARD = 4096
SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of the word shingles of ``text``, repeats included; A-Z count as a-z."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined, width = b" ".join(tokens), min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = len(tokens) - width + 1, xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        cut = slice(at, min(n, at + (1 << 14)))
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[cut].tolist(), ends[width - 1 :][cut].tolist())])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        at, new = 0, len(self.value)
        self.value.append(x)
        self.children.append({})
        while new:
            distance = (self.value[at] ^ x).bit_count()
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = new
                return
            at = below

    def within(self, x: int, radius: int) -> list[int]:
        """All values at most ``radius`` from ``x``."""
        found, todo = [], [0] if self.value else []
        while todo:
            at = todo.pop()
            distance = (self.value[at] ^ x).bit_count()
            if distance <= radius:
                found.append(self.value[at])
            todo += [child for d, child in self.children[at].items() if -radius <= d - distance <= radius]
        return found


def forest(tree_values: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links between ``queries`` and ``tree_values`` at most ``radius`` apart that connect all that are linked."""
    tree, parent, links = BKTree(), {}, []
    for x in tree_values:
        tree.add(x)

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up] if up in parent else up
            x = up
        return x

    for x in queries:
        for y in tree.within(x, radius):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((x, y))
    return links


def _shards(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(shard, fp): a row for each choice of blocks that may be free of differences."""
    size, rest = divmod(64, blocks)
    widths = [size + (i < rest) for i in range(blocks)]
    low = [sum(widths[:i]) for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(number).cast("long")
        for i in chosen:
            part = F.shiftrightunsigned("fp", low[i]).bitwiseAND((1 << widths[i]) - 1)
            key = F.shiftleft(key, widths[i]).bitwiseOR(part)
        keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("shard"), "fp")


def links(fps: DataFrame, work: Workspace, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """(u, v): links that connect the distinct fingerprints ``fps`` (fp) at most ``radius`` bits apart."""
    rows = _shards(fps, radius, blocks)
    large = work.put(
        rows.groupBy("shard").count().where(F.col("count") > 1).select("shard", F.ceil(F.col("count") / shard).cast("int").alias("trees")),
        "shards",
    )
    met = rows.join(large.hint("merge"), "shard")
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    # Tree i meets queries j for i <= j; a fingerprint of part p is in tree p and among queries p.
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("trees") - 1),
        lambda q: F.struct(F.least(q, F.col("own")).alias("i"), F.greatest(q, F.col("own")).alias("j"), F.when(q == F.col("own"), 0).when(q > F.col("own"), 1).otherwise(2).alias("role")),
    )
    dealt = (
        met.withColumn("own", own)
        .select("shard", "fp", F.explode(pairs).alias("p"))
        .select("shard", "p.i", "p.j", "p.role", "fp")
        .repartition("shard", "i", "j")
        .sortWithinPartitions("shard", "i", "j", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []

        def close() -> pa.RecordBatch:
            tree, asked = [f for f, r in members if r != 2], [f for f, r in members if r != 1]
            found = [(min(x), max(x)) for x in forest(tree, asked, radius)]
            made = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["u", "v"])

        for batch in batches:
            shards, i, j, role, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for row in zip(shards.tolist(), i.tolist(), j.tolist(), role.tolist(), fp.view(np.uint64).tolist()):
                if row[:3] != key:
                    if len(members) > 1:
                        yield close()
                    key, members = row[:3], []
                members.append((row[4], row[3]))
        if len(members) > 1:
            yield close()

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id linked)."""
    work = Workspace(docs.sparkSession, "simhash")
    marked = work.put(fingerprints(docs, words), "fps")
    nodes = work.put(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(work.put(links(nodes.select("fp"), work, radius, blocks), "links"), work)
    named = nodes.join(found.select(F.col("u").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = work.put(named.groupBy("root").agg(F.min("least").alias("component_id")), "groups")
    classes = work.put(named.join(groups, "root").select("fp", "component_id"), "classes")
    return marked.join(classes.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
