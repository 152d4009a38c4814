"""Removal of repeated byte strings by a logarithmic family of suffix arrays.

A 100-byte string that also starts earlier (smaller doc_id, or the same document further up) goes;
its first place stays. Documents are cut into segments (``windows``) and routed by minimizer
(``routing``), so that the texts in which one string may stand meet, in order. There they come in
batches: each batch gets a suffix array (the places of its 100-byte strings, sorted by their bytes),
which is merge-scanned against every existing level for matches of full length; what is new becomes a
level, and levels of about equal size merge, so that n strings lie in log n levels. Bytes are compared
as such; equal segments are counted (by 128 bits of hash) before, and the first of them stands for all.

Defined results
    null text       no bytes
    null doc_id     after every other, in order of a hash of the text; returned as null
    repeated rows   rows with equal id and text are one document; each is returned, with the same result
    equal ids       rows of one id and different texts stand in order of a hash of the text
    short texts     fewer bytes than a string: nothing is removed
    very long texts cut into slices that overlap by a string, so no string is lost
    empty table     empty result
    extra columns   ignored
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm import routing
from skein.llm.storage import Workspace, tidy
from skein.llm.windows import Spec

SPEC = Spec(width=100, seed=37, words=False)
#: Texts of one batch, and most classes of a key that are compared in one place.
BATCH, CLASSES = 512, 1024


class Level:
    """A suffix array: a text and the places of its distinct strings, sorted by ``width`` bytes from there."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, width: int) -> None:
        self.text, self.starts, self.width = text, starts, width

    def __len__(self) -> int:
        return len(self.starts)

    def strings(self) -> np.ndarray:
        """The bytes at each place, in the array's order."""
        if not len(self.starts):
            return np.empty(0, f"S{self.width}")
        view = np.lib.stride_tricks.sliding_window_view(self.text, self.width)
        return np.ascontiguousarray(view[self.starts]).view(f"S{self.width}").ravel()

    @staticmethod
    def _merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of two sorted arrays laid end to end (a stable sort merges the two runs), and which place equals the one before."""
        both = np.concatenate((a, b))
        order = np.argsort(both, kind="stable")
        both = both[order]
        return order, np.concatenate(([False], both[1:] == both[:-1]))

    def scan(self, strings: np.ndarray) -> np.ndarray:
        """Which of ``strings`` (sorted, distinct) this level holds, by one pass over both."""
        mine = self.strings()
        order, same = self._merge(mine, strings)
        return np.isin(np.arange(len(strings)), order[same] - len(mine))

    def merged(self, other: Level) -> Level:
        order, _ = self._merge(self.strings(), other.strings())
        starts = np.concatenate((self.starts, other.starts + len(self.text)))
        return Level(np.concatenate((self.text, other.text)), starts[order], self.width)


class IndexFamily:
    """Levels without common strings, each more than twice as long as the next."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.levels: list[Level] = []

    def scan_and_add(self, text: bytes, starts: np.ndarray) -> np.ndarray:
        """Which of the strings that begin at ``starts`` (in document order) stood earlier; then take them in."""
        batch = Level(np.frombuffer(text, np.uint8), starts, self.width)
        strings = batch.strings()
        order = np.argsort(strings, kind="stable")
        strings = strings[order]
        again = np.concatenate(([False], strings[1:] == strings[:-1]))[: len(starts)]
        new, known = strings[~again], np.zeros(int((~again).sum()), bool)
        for level in self.levels:
            known |= level.scan(new)
        found = np.empty(len(starts), bool)
        found[order] = again
        found[order[~again]] = known
        self._append(Level(batch.text, starts[order[~again][~known]], self.width))
        return found

    def _append(self, level: Level) -> None:
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            level = self.levels.pop().merged(level)
        if len(level):
            self.levels.append(level)


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of each text that an earlier text of its key holds; and of parts of a key, their distinct strings."""
    family, held, width = IndexFamily(SPEC.width), [], SPEC.width

    def close() -> pa.RecordBatch:
        lens = np.fromiter((len(x[9]) for x in held), np.int64, len(held))
        n = lens - width + 1
        row = np.repeat(np.arange(len(held)), n)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        found = family.scan_and_add(b"".join(x[9] for x in held), (np.cumsum(lens) - lens)[row] + offset)
        masks = np.zeros(len(held), np.uint64)
        np.bitwise_or.at(masks, row[found], np.uint64(1) << offset[found].astype(np.uint64))
        out = [(x[0], x[3], m, None, None, None, None, None) for x, m in zip(held, masks.view(np.int64).tolist()) if m]
        cut = np.array([x[2] > 1 for x in held], bool)
        if cut.any():
            for r, k in zip(row[~found & cut[row]].tolist(), offset[~found & cut[row]].tolist()):
                x = held[r]
                out.append((x[0], x[3], None, *x[5:8], k, x[9][k : k + width]))
        held.clear()
        return routing.judged_batch(out)

    for row, begins in routing.groups(batches):
        # Other keys have none of these strings; other parts of the key may have earlier ones, and meet later.
        apart = begins and held and (row[2] > 1 or held[-1][2] > 1)
        if len(held) >= BATCH or apart:
            yield close()
            if begins:
                family.levels.clear()
        held.append(row)
    if held:
        yield close()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, gone, spans, texts = [], [], [], []
        for text, removed in zip(batch.column(1), batch.column(2)):
            data = text.as_buffer().to_pybytes()
            cut = routing.removed_tokens(len(data), removed, SPEC.width)
            counts.append(len(data))
            gone.append(int(cut.sum()))
            spans.append(int((np.diff(cut.astype(np.int8), prepend=0) == 1).sum()))
            texts.append(np.frombuffer(data, np.uint8)[~cut].tobytes() if gone[-1] else data)
        arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (counts, gone, spans)), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_strings(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes)."""
    work = Workspace(docs.sparkSession, "strings")
    texts = routing.plain(docs)
    hits = routing.repeats(texts, SPEC, work)
    decided = routing.compared(texts, hits, SPEC, work, resolve, CLASSES, earliest=True)
    cuts = work.put(routing.removal(hits, decided, earliest=True), "cuts")
    work.drop("hits", "decided")
    work.release()
    joined = texts.join(cuts.hint("merge"), ["doc", "mark"], "left").select("doc_id", "text", "removed")
    return joined.mapInArrow(tidy(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def reference(rows: list[tuple[int, str | None]], width: int = SPEC.width) -> dict[int, tuple[int, int, int, str]]:
    """The same by brute force: doc_id to (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        cut = bytearray(len(data))
        for k in range(len(data) - width + 1):
            if data[k : k + width] in seen:
                cut[k : k + width] = b"\1" * width
            seen.add(data[k : k + width])
        spans = sum(cut[k] and not (k and cut[k - 1]) for k in range(len(cut)))
        kept = bytes(b for b, c in zip(data, cut) if not c)
        out[doc] = (len(data), sum(cut), spans, hashlib.sha256(kept).hexdigest())
    return out
