"""Removal of repeated word passages by relative Lempel-Ziv parsing.

A passage of 35 words that occurs anywhere else goes, at all its places. Documents are cut into
segments (``windows``) and routed to the reference blocks that can match them (``routing``). A block
holds the texts of one or more keys as numbers of their words, indexed by a suffix array. Each text is
factored greedily against the block: at a place the longest match of any other place is taken, if it
has 35 words; the windows across its end are looked up anew, and one that matches begins the next
factor. Factors are the duplicate spans. Words are compared as such, not by hashes; equal segments
are counted (by 128 bits of hash) before, and one of them stands for all.

Defined results
    null text       no words
    null doc_id     kept, returned as null
    repeated rows   two rows with equal id and text are two occurrences
    equal ids       rows of one id and different texts are documents of their own
    short texts     fewer words than a window: nothing is removed
    very long texts cut into slices that overlap by a window, so no window is lost
    ties            of equally long matches any one is taken; the spans are the same
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

SPEC = Spec(width=35, seed=8, words=True)
#: Words of one reference block (about), and most classes of a key that are compared in one place.
BLOCK, CLASSES = 1 << 16, 512


class Block:
    """A part of the reference: texts as numbers of their words, and the suffix array over all of them."""

    def __init__(self, texts: list[list[bytes]]) -> None:
        numbers: dict[bytes, int] = {}
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for text in texts for w in text), np.int64, int(lens.sum()))
        self.start = np.cumsum(lens + 1) - lens - 1
        size = int((lens + 1).sum())
        within = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        #: Words left in its text at each place; none between texts.
        self.left = np.zeros(size, np.int64)
        place = np.repeat(self.start, lens) + within
        self.left[place] = np.repeat(lens, lens) - within
        word = np.zeros(size, np.int64)
        word[place] = flat
        self.ranks = [word]
        while 1 << (len(self.ranks) - 1) < max(2, int(lens.max(initial=0))):
            self.ranks.append(self._pairs(self.ranks[-1], 1 << (len(self.ranks) - 1)))
        self.order = np.argsort(self.ranks[-1], kind="stable")

    @staticmethod
    def _after(rank: np.ndarray, span: int) -> np.ndarray:
        return np.concatenate((rank[span:], np.zeros(min(span, len(rank)), np.int64)))

    def _pairs(self, rank: np.ndarray, span: int) -> np.ndarray:
        """The order of runs twice as long, from that of runs of ``span`` words."""
        both = rank * (int(rank.max(initial=0)) + 1) + self._after(rank, span)
        return np.unique(both, return_inverse=True)[1].astype(np.int64) + 1

    def longest(self) -> np.ndarray:
        """At each place, the words of the longest match that begins at any other place: that of a neighbour in the suffix array."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        size, shared = len(self.left), np.zeros(max(0, len(self.order) - 1), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            inside = (a < size) & (b < size)
            rank = self.ranks[level]
            same = inside & (rank[np.minimum(a, size - 1)] == rank[np.minimum(b, size - 1)])
            step = same.astype(np.int64) << level
            shared, a, b = shared + step, a + step, b + step
        out = np.zeros(size, np.int64)
        out[self.order[1:]] = shared
        out[self.order[:-1]] = np.maximum(out[self.order[:-1]], shared)
        # A match ends with the text, whatever stands behind it.
        return np.minimum(out, self.left)

    def windows(self, width: int) -> np.ndarray:
        """A number for the ``width`` words at each place: equal where the words are."""
        level = width.bit_length() - 1
        rank = self.ranks[level]
        return rank * (int(rank.max(initial=0)) + 1) + self._after(rank, width - (1 << level))


def factors(longest: list[int], width: int) -> list[tuple[int, int]]:
    """The greedy factors (first word, words) of one text, given the longest match at each of its places.

    Windows inside a factor match with it. The first window across its end is looked up next.
    """
    out, at = [], 0
    while at + width <= len(longest):
        if longest[at] >= width:
            out.append((at, longest[at]))
            at += longest[at] - width + 1
        else:
            at += 1
    return out


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each text that lie in a factor; and of parts of a key, their distinct windows."""
    width = SPEC.width

    def close(rows: list[tuple], texts: list[list[bytes]]) -> pa.RecordBatch:
        block, out = Block(texts), []
        longest = block.longest()
        for row, text, first in zip(rows, texts, block.start.tolist()):
            # What has copies is matched as a whole.
            found = longest[first : first + len(text)].tolist() if row[4] == 1 else list(range(len(text), 0, -1))
            mask = 0
            for start, size in factors(found, width):
                mask |= ((1 << (size - width + 1)) - 1) << start
            if mask:
                out.append((row[0], row[3], routing.signed(mask), None, None, None, None, None))
        if any(row[2] > 1 for row in rows):
            seen, number = set(), block.windows(width)
            for row, text, first in zip(rows, texts, block.start.tolist()):
                for k, x in enumerate(number[first : first + row[8]].tolist() if row[2] > 1 else ()):
                    if (row[:2], x) not in seen:
                        seen.add((row[:2], x))
                        out.append((row[0], row[3], None, *row[5:8], k, b" ".join(text[k : k + width])))
        return routing.judged_batch(out)

    rows, texts, held = [], [], 0
    for row, begins in routing.groups(batches):
        if begins and held >= BLOCK:
            yield close(rows, texts)
            rows, texts, held = [], [], 0
        rows.append(row)
        texts.append(row[9].split())
        held += len(texts[-1])
    if rows:
        yield close(rows, texts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, gone, texts = [], [], []
        for text, removed in zip(batch.column(1), batch.column(2)):
            data = text.as_buffer().to_pybytes()
            words = data.split()
            cut = routing.removed_tokens(len(words), removed, SPEC.width)
            counts.append(len(words))
            gone.append(int(cut.sum()))
            if gone[-1]:
                words = [words[k] for k in np.flatnonzero(~cut).tolist()]
            texts.append(b" ".join(words))
        arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept"])


def remove_passages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the kept words in UTF-8, joined by one space)."""
    work = Workspace(docs.sparkSession, "passages")
    texts = routing.plain(docs)
    hits = routing.repeats(texts, SPEC, work)
    decided = routing.compared(texts, hits, SPEC, work, resolve, CLASSES, earliest=False)
    cuts = work.put(routing.removal(hits, decided, earliest=False), "cuts")
    work.drop("hits", "decided")
    work.release()
    joined = texts.join(cuts.hint("merge"), ["doc", "mark"], "left").select("doc_id", "text", "removed")
    return joined.mapInArrow(tidy(_cut), "doc_id long, n_words long, n_removed long, kept binary")


def reference(texts: list[str | None], width: int = SPEC.width) -> list[tuple[int, int, str]]:
    """The same by brute force: (n_words, n_removed, kept_sha256) of each text."""
    words = [(t or "").encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for w in words:
        for k in range(len(w) - width + 1):
            seen[tuple(w[k : k + width])] = seen.get(tuple(w[k : k + width]), 0) + 1
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
