"""Byte-level BPE in DuckDB, one database per partition.

``encode`` splits a text by the vocabulary's pattern and encodes each distinct piece once: a
recursive query holds the pieces as token-position rows, joins neighbours to the merge table and
contracts each piece's leftmost pair of least rank, until no pair is left. A worker remembers the
ids of words, so that what texts repeat is neither split nor contracted again. ``decode`` joins a
document's ids to the vocabulary and aggregates the bytes in order.

The vocabulary file is a parameter: a path that every machine can open, never a copy in this
repository.

Defined results
    null text       counts as empty: no ids
    null doc_id     kept
    repeated rows   each is returned
    empty table     empty result
    extra columns   ignored
    very long texts taken whole; one text is held in memory at a time
    very long pieces  a piece of more than ``LONG`` bytes would cost rows in the square of its length;
                    such pieces are contracted in a heap, by the same rule
    ties            of pairs of equal rank the leftmost goes first
    unknown id      decoding fails with an error
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.storage import tidy

#: A space that whitespace or the end follows and whitespace precedes: only here may a cut before a space part a piece.
_RUN = re.compile(r"(?:^|\s) (?!\S)")
_WIDE = [" " + c for c in map(chr, range(0x3001)) if c.isspace()]
#: No token: the successor of a word's last one.
_NONE = (1 << 31) - 1
#: Bytes of a piece beyond which it is contracted in a heap: a recursive query costs rows in the square of its length.
LONG = 1024
#: Rows of one recursive query (about), over all its rounds; tokens and documents decoded in one query.
ROWS, TOKENS, DOCS = 500_000, 200_000, 1_000
#: Distinct words that a worker remembers in either generation of its memory.
WORDS = 200_000
#: Patterns whose pieces hold whitespace only as their first character, or hold nothing else. Fixed value.
SPACED = frozenset([r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"])

# A row is a token of a word: its place, its successor, and what the two merge to. The pair of least
# (id, place) goes: its right token takes in the left one, the token before it gets a new successor.
_ENCODE = """
WITH RECURSIVE step AS (
    SELECT 0 AS n, p.word, p.pos, p.tok, p.after, m.id
    FROM pieces p LEFT JOIN merges m ON m.pair = p.tok << 32 | p.after
  UNION ALL
    SELECT s.n, s.word, s.pos, s.tok, s.after, CASE WHEN s.pair IS NULL THEN s.id ELSE m.id END
    FROM (
        SELECT n + 1 AS n, word, id,
               CASE WHEN pos > spot THEN pos - 1 ELSE pos END AS pos,
               CASE WHEN pos = spot + 1 THEN made ELSE tok END AS tok,
               CASE WHEN pos = spot - 1 THEN made ELSE after END AS after,
               CASE WHEN pos = spot + 1 THEN made << 32 | after WHEN pos = spot - 1 THEN tok << 32 | made END AS pair
        FROM (SELECT s.*, least & 4294967295 AS spot, least >> 32 AS made
              FROM step s JOIN (SELECT word, min(id << 32 | pos) AS least FROM step WHERE id IS NOT NULL GROUP BY word) b
              ON b.word = s.word)
        WHERE pos <> spot) s
    LEFT JOIN merges m ON m.pair = s.pair)
SELECT word, list(tok ORDER BY pos) AS ids
FROM step WHERE (word, n) IN (SELECT word, max(n) FROM step GROUP BY word)
GROUP BY word
"""

# One thread aggregates the rows of the ordered subquery in their order. A byte is the code point of its number.
_DECODE = """
SELECT doc, string_agg(content, '') AS content, count(*) AS known
FROM (SELECT t.doc, v.content FROM tokens t JOIN vocabulary v ON v.id = t.id ORDER BY t.pos)
GROUP BY doc
"""


def _database() -> duckdb.DuckDBPyConnection:
    """A database in memory that never spills to a folder of the machine."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "150MB", "temp_directory": ""})


def _fill(db: duckdb.DuckDBPyConnection, name: str, columns: dict) -> None:
    db.register("arriving", pa.table(columns))
    db.execute(f"CREATE TABLE {name} AS SELECT * FROM arriving")
    db.unregister("arriving")


class Encoder:
    """Encodes by the ranks of one vocabulary file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern, self.spaced = ranks, regex.compile(pattern), pattern in SPACED
        self.fresh, self.older = {}, {}
        pairs = [(ranks[x[:k]], ranks[x[k:]], r) for x, r in ranks.items() for k in range(1, len(x)) if x[:k] in ranks and x[k:] in ranks]
        columns = np.array(pairs, np.int64).reshape(-1, 3)
        self.db = _database()
        _fill(self.db, "merges", {"pair": columns[:, 0] << 32 | columns[:, 1], "id": columns[:, 2]})
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def words(self, text: str) -> list[str]:
        """``text`` in parts that pieces never cross: words with the space before them, if the pattern allows."""
        if not self.spaced or ((text.endswith(" ") or any(x in text for x in _WIDE)) and _RUN.search(text)):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def _recall(self, wanted: set[str]) -> set[str]:
        """What of ``wanted`` is not known; what only the older generation knows is taken over."""
        wanted = wanted.difference(self.fresh)
        if self.older:
            again = wanted & self.older.keys()
            self.fresh.update((w, self.older[w]) for w in again)
            wanted -= again
        return wanted

    def _learn(self, words: list[str]) -> None:
        """Encode ``words``, which are distinct and not known yet."""
        split = [self.pattern.findall(w) for w in words] if self.spaced else [[w] for w in words]
        self.fresh.update(self._encode(list(self._recall({p for pieces in split for p in pieces}))))
        get = self.fresh.__getitem__
        self.fresh.update((word, b"".join(map(get, pieces))) for word, pieces in zip(words, split) if len(pieces) > 1)

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece."""
        made, short = {}, []
        for piece in pieces:
            data = piece.encode()
            if data in self.ranks:
                made[piece] = np.uint32(self.ranks[data]).tobytes()
            elif len(data) > LONG:
                made[piece] = np.array(self._contract(data), "<u4").tobytes()
            else:
                short.append((piece, data))
        short.sort(key=lambda x: len(x[1]))
        part, rows = [], 0
        for row in short:
            part.append(row)
            rows += len(row[1]) ** 2 // 2
            if rows >= ROWS:
                made.update(self._recursive(part))
                part, rows = [], 0
        if part:
            made.update(self._recursive(part))
        return made

    def _recursive(self, part: list[tuple[str, bytes]]) -> list[tuple[str, bytes]]:
        lens = np.fromiter((len(d) for _, d in part), np.int64, len(part))
        word, ends = np.repeat(np.arange(len(part)), lens), np.cumsum(lens)
        pos = np.arange(len(word)) - np.repeat(ends - lens, lens)
        tok = self.single[np.frombuffer(b"".join(d for _, d in part), np.uint8)]
        after = np.append(tok[1:], 0)
        # A merge of nothing: the last token has no successor.
        after[ends - 1] = _NONE
        self.db.register("pieces", pa.table({"word": word.astype(np.int32), "pos": pos, "tok": tok, "after": after}))
        found = self.db.sql(_ENCODE).to_arrow_table().combine_chunks()
        self.db.unregister("pieces")
        ids, at = found["ids"].chunk(0), 4 * found["ids"].chunk(0).offsets.to_numpy()
        data = ids.values.to_numpy().astype("<u4").tobytes()
        rows = zip(found["word"].to_pylist(), at[:-1].tolist(), at[1:].tolist())
        return [(part[row][0], data[a:b]) for row, a, b in rows]

    def _contract(self, data: bytes) -> list[int]:
        token, after = [data[k : k + 1] for k in range(len(data))], list(range(1, len(data) + 1))
        before = list(range(-1, len(data) - 1))
        live = [True] * len(data)
        heap = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < len(data):
                rank = self.ranks.get(token[k] + token[after[k]])
                if rank is not None:
                    heapq.heappush(heap, (rank, k, len(token[k]), len(token[after[k]])))

        for k in range(len(data)):
            offer(k)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            if not live[k] or len(token[k]) != left or after[k] >= len(data) or len(token[after[k]]) != right:
                continue
            gone = after[k]
            token[k] += token[gone]
            live[gone], after[k] = False, after[gone]
            if after[k] < len(data):
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [self.ranks[t] for t, on in zip(token, live) if on]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.words(t) for t in texts]
        wanted = {w for words in split for w in words}
        # Two generations: what no text has asked for since the older one was closed is forgotten.
        if len(self.fresh) > WORDS:
            self.fresh, self.older = {}, self.fresh
        self._learn(list(self._recall(wanted)))
        get = self.fresh.__getitem__
        return [b"".join(map(get, words)) for words in split]


class Decoder:
    """Decodes by the ranks of one vocabulary file."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.db = _database()
        _fill(self.db, "vocabulary", {"id": pa.array(ranks.values(), pa.int32()), "content": pa.array([x.decode("latin-1") for x in ranks])})

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids."""
        out: list[bytes] = []
        for at in range(0, len(encoded), DOCS):
            out += self._decode(encoded[at : at + DOCS])
        return out

    def _decode(self, encoded: list[bytes]) -> list[bytes]:
        lens = np.fromiter((len(x) // 4 for x in encoded), np.int64, len(encoded))
        doc = np.repeat(np.arange(len(encoded)), lens)
        tokens = {"doc": doc.astype(np.int32), "pos": np.arange(len(doc), dtype=np.int32), "id": np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)}
        self.db.register("tokens", pa.table(tokens))
        out, found = [b""] * len(encoded), 0
        for row, text, known in self.db.execute(_DECODE).fetchall():
            out[row] = text.encode("latin-1")
            found += known
        self.db.unregister("tokens")
        if found != len(doc):
            raise ValueError("an id is not in the vocabulary")
        return out


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


@functools.cache
def _encoder(path: str, pattern: str) -> Encoder:
    with open(path, "rb") as file:
        return Encoder(read_ranks(file.read()), pattern)


@functools.cache
def _decoder(path: str) -> Decoder:
    with open(path, "rb") as file:
        return Decoder(read_ranks(file.read()))


def _chunks(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``limit`` bytes in column 1."""
    start = held = 0
    for row, value in enumerate(batch.column(1)):
        held += len(value.as_buffer()) if value.is_valid else 0
        if held >= limit:
            yield start, row + 1
            start, held = row + 1, 0
    if start < batch.num_rows:
        yield start, batch.num_rows


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers. ``path`` is the vocabulary's on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _encoder(path, pattern)
        for batch in batches:
            for a, b in _chunks(batch, 4 * TOKENS):
                part = batch.slice(a, b - a)
                ids = codec.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(tidy(run), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that ``ids`` stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _decoder(path)
        for batch in batches:
            for a, b in _chunks(batch, 4 * TOKENS):
                part = batch.slice(a, b - a)
                made = pa.array(codec.decode(part.column(1).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), made], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, ids binary, decoded binary")
