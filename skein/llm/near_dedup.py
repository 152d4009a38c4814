"""Near duplicates at a stated similarity: SimHash BK-trees within shards of shared shingles.

At a Jaccard similarity of 0.8 two 64-bit SimHashes differ in about ten bits, too many for shards
cut from the fingerprint itself. Here a shard is keyed by two min-hashed word shingles, so that a
pair of that similarity misses all ``SHARDS`` shards once in some thousand times, and pairs of
unrelated texts hardly meet. In a shard the BK-tree of ``simhash`` finds what is within ``RADIUS``
bits, and a 512-bit SimHash drops what is far below the similarity. Both only choose candidates: the
shingle sets of all documents with a candidate are then dealt to the shard, and a link is made where
the Jaccard similarity of the two sets reaches the bound. Linked documents form groups.

Sets are of distinct shingles, each taken for its 64-bit hash.

Defined results
    null or blank text   the empty set; all such rows form one group
    fewer words than a shingle   the whole sequence is the one shingle
    null doc_id          takes part; its row stays only if its group has no row with an id
    equal ids            rows of one id and different texts are documents of their own
    repeated rows        rows with equal id and text are one document: all of them stay, or none
    ties                 the row of least id stays, of rows without one that of least hash
    very long texts      hashed whole; a tree holds a bounded number of shingles, or one such text
    empty table          empty result
    extra columns        kept by ``keep_one``, ignored by ``groups``
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.components import components
from skein.llm.simhash import BKTree
from skein.llm.storage import Workspace, tidy
from skein.llm.windows import mix, run_hashes, word_tokens

WORDS, SIMILARITY = 5, 0.8
SHARDS, RADIUS, WIDE = 8, 26, 8
#: How far below the bound an estimate may lie: over six standard errors, or four and the bias of the shortest texts.
MARGIN = 0.3
#: Most documents of one tree, and most shingles of them (about).
TREE, SHINGLES = 4096, 4 << 20
_U = np.uint64
_SALTS = mix(np.arange(1, 2 * SHARDS + WIDE + 1, dtype=_U))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The 64-bit hashes of the distinct word shingles of ``text``, in order; A-Z count as a-z."""
    tokens = word_tokens((text or "").encode().lower())
    if not len(tokens):
        return np.empty(0, _U)
    (made,) = run_hashes(tokens, (min(words, len(tokens)),))
    return np.unique(made)


def node_of(found: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def sketch(found: np.ndarray) -> tuple[bytes, int, list[int]]:
    """The wide SimHash (its first 8 bytes are the fingerprint), the number of shingles, and the shard keys."""
    n = len(found)
    ones, least = np.zeros(64 * WIDE, np.int64), np.full(2 * SHARDS, (1 << 64) - 1, _U)
    for at in range(0, n, 1 << 12):
        h = found[at : at + (1 << 12)]
        for k in range(2 * SHARDS):
            least[k] = min(least[k], mix(h ^ _SALTS[k]).min())
        wide = np.stack([mix(h ^ s) for s in _SALTS[2 * SHARDS :]], axis=1)
        ones += np.add.reduce(np.unpackbits(wide.view(np.uint8), axis=1), axis=0, dtype=np.uint32)
    keys = mix(mix(least[::2] + _U(1)) ^ least[1::2])
    return np.packbits(ones * 2 > n).tobytes(), n, keys.view(np.int64).tolist()


def similarity(a: bytes, b: bytes, n: int, m: int) -> float:
    """The Jaccard similarity of two shingle sets, estimated from their wide SimHashes and sizes."""
    if not n or not m:
        return float(n == m)
    apart = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / (64 * WIDE)
    shared = max(0.0, float(np.cos(np.pi * apart))) * (n * m) ** 0.5
    return shared / (n + m - shared)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets given in order; that of two empty sets is 1."""
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def _candidates(rows: list[tuple], least: float) -> Iterator[tuple[tuple, tuple]]:
    """Pairs of ``rows`` (node, wide, n, role, number, keys, ...) that may be similar and share no earlier shard.

    A row of role 0 is in the tree and asks, one of 1 is in the tree, one of 2 asks.
    """
    tree, held = BKTree(), {}
    for row in rows:
        value = int.from_bytes(row[1][:8], "big")
        if row[3] != 2:
            if value not in held:
                tree.add(value)
            held.setdefault(value, []).append(row)
    for row in rows:
        if row[3] == 1:
            continue
        for value in tree.within(int.from_bytes(row[1][:8], "big"), RADIUS):
            for other in held[value]:
                if row[0] == other[0] or min(row[2], other[2]) < least * max(row[2], other[2]):
                    continue
                if row[3] == other[3] == 0 and row[0] < other[0]:
                    continue
                if all(row[5][k] != other[5][k] for k in range(row[4])):
                    yield row, other


def _marked(rows: list[tuple], least: float) -> list[tuple]:
    """The ``rows`` with a candidate."""
    seen: set[int] = set()
    for row, other in _candidates(rows, least):
        if not (row[0] in seen and other[0] in seen) and similarity(row[1], other[1], row[2], other[2]) >= least - MARGIN:
            seen |= {row[0], other[0]}
    return [row for row in rows if row[0] in seen]


def _forest(rows: list[tuple], least: float) -> list[tuple[int, int]]:
    """Links that connect all similar ``rows``, whose last field is the shingle set."""
    parent, links = {}, []

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    sets = {row[0]: np.frombuffer(row[-1], _U) for row in rows}
    for row, other in _candidates(rows, least):
        a, b = root(row[0]), root(other[0])
        if a != b and similarity(row[1], other[1], row[2], other[2]) >= least - MARGIN and jaccard(sets[row[0]], sets[other[0]]) >= least:
            parent[max(a, b)] = min(a, b)
            links.append((row[0], other[0]))
    return links


def _by_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each (shard, i, j), without it; those of one stand together."""
    key, members = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != key:
                if len(members) > 1:
                    yield key, members
                key, members = row[:3], []
            members.append(row[3:])
    if len(members) > 1:
        yield key, members


_ROW = "shard long, i int, j int, node long, wide binary, n long, role int, number int, keys array<long>"


def _row(docs: DataFrame) -> Column:
    """What tells a row of ``docs`` from rows of another id or text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def groups(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, group): the least doc_id among the documents linked to this one."""
    return _groups(docs, words, least).select("doc_id", F.col("first.doc_id").alias("group"))


def _groups(docs: DataFrame, words: int, least: float) -> DataFrame:
    """(doc_id, of, first) of every row: its row hash, and the id and row hash of the first row linked to it."""
    work = Workspace(docs.sparkSession, "near")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column(2)]
            wide, n, keys = zip(*map(sketch, sets)) if sets else ((), (), ())
            arrays = [batch.column(0), batch.column(1), pa.array(map(node_of, sets), pa.int64()), pa.array(wide, pa.binary()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "of", "node", "wide", "n", "keys"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row(docs).alias("of"), F.col("text").cast("string").alias("text"))
    marked = work.put(cols.mapInArrow(tidy(sketches), "doc_id long, of long, node long, wide binary, n long, keys array<long>"), "sketches")
    # Equal sets are one node: a group of copies counts once however large it is.
    first = [F.first(c).alias(c) for c in ("wide", "n", "keys")]
    nodes = work.put(marked.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "of")).alias("least"), F.min("of").alias("of"), *first), "nodes")
    rows = nodes.select("node", "wide", "n", "keys", F.posexplode("keys").alias("number", "key")).withColumn("shard", F.xxhash64("number", "key"))
    trees = F.ceil(F.greatest(F.col("count") / TREE, F.col("shingles") / SHINGLES)).cast("int")
    sizes = rows.groupBy("shard").agg(F.count("*").alias("count"), F.sum("n").alias("shingles")).where(F.col("count") > 1)
    sizes = sizes.select("shard", F.greatest(trees, F.lit(1)).alias("trees"))
    met = rows.join(work.put(sizes, "shards").hint("merge"), "shard").withColumn("own", F.pmod(F.xxhash64("node"), F.col("trees")).cast("int"))
    own = F.col("own")
    # Tree i meets queries j for i <= j; a document of part p is in tree p and among queries p.
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("trees") - 1),
        lambda q: F.struct(F.least(q, own).alias("i"), F.greatest(q, own).alias("j"), F.when(q == own, 0).when(q > own, 1).otherwise(2).alias("role")),
    )

    def deal(df: DataFrame) -> DataFrame:
        return df.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "node")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, members in _by_tree(batches):
            made = [(*key, *row) for row in _marked(members, least)]
            if made:
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                names = [field.split()[0] for field in _ROW.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(node, shingles(t.as_py(), words)) for node, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            made = [(node, found.tobytes()) for node, found in made if node_of(found) == node]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.binary())], ["node", "set"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in _by_tree(batches):
            found = _forest(members, least)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    dealt = met.select("shard", "node", "wide", "n", "number", "keys", F.explode(pairs).alias("p"))
    dealt = deal(dealt.select("shard", "p.i", "p.j", "node", "wide", "n", "p.role", "number", "keys"))
    asked = work.put(dealt.mapInArrow(tidy(mark), _ROW), "candidates")
    needed = nodes.join(asked.select("node").distinct().hint("merge"), "node", "left_semi").select("of", "node")
    # A row that is repeated with its id gives its set more than once.
    texts = cols.select("of", "text").join(work.put(needed, "needed").hint("merge"), "of").select("node", "text")
    sets = work.put(texts.mapInArrow(tidy(gather), "node long, set binary").dropDuplicates(["node"]), "sets")
    work.release()
    full = deal(asked.join(sets.hint("merge"), "node").select("shard", "i", "j", "node", "wide", "n", "role", "number", "keys", "set"))
    found = components(work.put(full.mapInArrow(tidy(link), "u long, v long"), "links"), work)
    work.drop("candidates", "sets", "needed")
    named = nodes.select("node", "least").join(found.withColumnRenamed("u", "node").hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = work.put(named, "named")
    group = named.groupBy("root").agg(F.min("least").alias("first"))
    named = work.put(named.join(group.hint("merge"), "root").select("node", "first"), "classes")
    return marked.select("doc_id", "of", "node").join(named.hint("merge"), "node").select("doc_id", "of", "first")


def keep_one(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group, that of least doc_id. All columns."""
    work = Workspace(docs.sparkSession, "kept")
    gone = work.put(_groups(docs, words, least).where(F.col("of") != F.col("first.of")).select(F.col("of").alias("_skein_of")).distinct(), "gone")
    rows = docs.withColumn("_skein_row", _row(docs))
    return rows.join(gone.hint("shuffle_hash"), F.col("_skein_row") == F.col("_skein_of"), "left_anti").select(*docs.columns)
