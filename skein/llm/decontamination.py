"""Benchmark decontamination: BM25 over the test items with block-max WAND.

The inverted index is over the test items, its terms are pairs of consecutive words. Items stand on
shelves by their number of words, rounded up to a power of two. For each shelf a training document is
cut in passages of three such lengths, one length apart, and each passage is a query: what is found of
an item depends on its own length, never on that of other items. An item's score is divided by the
score of its own text, so one threshold serves items of all lengths. WAND skips items that no bound can
lift to the threshold: a term's greatest impact, then the greatest impacts of the blocks of postings at
the pivot. A hit counts if somewhere in the passage, within ``SPAN`` times the item's words, enough of
its question and of its answer stands.

Items are indexed in blocks of at most ``BLOCK_BYTES`` of text, one block at a time, each sent to all
executors; document frequencies and lengths are those of all items. With several blocks the documents
are read once a block, and what a block finds is staged, so the driver never holds two indexes.

Defined results
    null or blank item      never matches
    item of one word        its term is the word itself
    null text               no passages
    null doc_id             returned as null
    repeated rows           each is returned; repeated item ids are items of their own
    ties                    of passages with equal scores the first; of windows in it the first
    very long texts         cut in passages over their whole length
    empty tables            empty result
    extra columns           ignored by ``find``, kept by ``clean``
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.storage import Workspace, tidy

#: Okapi parameters.
K1, B = 1.2, 0.75
#: Least share of an item's own score at which it is retrieved.
THRESHOLD = 0.5
#: Least share of the terms of an item's question, and of the words of its answer, that must stand within ``SPAN`` times its words.
QUESTION, ANSWER, SPAN = 0.6, 0.5, 1.5
#: Text of the items that are indexed and sent at a time.
BLOCK_BYTES = 4 << 20
#: Postings of a block of the index.
POSTINGS = 64
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms(tokens: list[str]) -> list[tuple[str, ...]]:
    return list(zip(tokens, tokens[1:])) or [(x,) for x in tokens]


def parts(text: str) -> tuple[str, str]:
    """Question and answer: up to the last question mark, or else up to the last sentence; and the rest."""
    for end in (r"\?", r"[.!]"):
        cuts = [m.end() for m in re.finditer(end + r"(?=\s)", text)]
        if cuts and words(text[cuts[-1] :]):
            return text[: cuts[-1]], text[cuts[-1] :]
    return text, ""


class Shelf:
    """The postings of items of at most ``step`` words: for each term its items in order, their impacts, and the greatest of each block."""

    def __init__(self, step: int, impacts: dict[int, list[tuple[int, float]]]) -> None:
        self.step = step
        self.codes = np.array(sorted(impacts), np.int64)
        self.start, self.first_block = [0], [0]
        self.items, self.impacts, self.blocks = array("q"), array("d"), array("d")
        most = []
        for code in self.codes.tolist():
            rows = impacts[code]
            self.items.extend(item for item, _ in rows)
            self.impacts.extend(x for _, x in rows)
            self.blocks.extend(max(x for _, x in rows[k : k + POSTINGS]) for k in range(0, len(rows), POSTINGS))
            self.start.append(len(self.items))
            self.first_block.append(len(self.blocks))
            most.append(max(x for _, x in rows))
        self.most, self.end = np.array(most), max(self.items) + 1

    def retrieve(self, terms_: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) with score at least ``threshold`` for a query of these terms, by block-max WAND."""
        threshold -= 1e-9
        items, impacts, start, blocks = self.items, self.impacts, self.start, self.blocks
        # A cursor: the item it stands at, its place, its term and that term's bound.
        cursors = [[items[start[t]], start[t], t, float(self.most[t])] for t in terms_]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += c[3]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block_bound, until = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else self.end
            for c in cursors[: pivot + 1]:
                first, last = start[c[2]], start[c[2] + 1]
                at = c[1] = bisect_left(items, item, c[1], last)
                if at < last:
                    number = (at - first) // POSTINGS
                    block_bound += blocks[self.first_block[c[2]] + number]
                    after = first + (number + 1) * POSTINGS
                    until = min(until, items[after] if after < last else self.end)
            if block_bound >= threshold:
                score = sum(impacts[c[1]] for c in cursors[: pivot + 1] if c[1] < start[c[2] + 1] and items[c[1]] == item)
                if score >= threshold:
                    found.append((item, score))
                until = item + 1
            until = max(until, item + 1)
            for c in cursors[: pivot + 1]:
                last = start[c[2] + 1]
                c[1] = bisect_left(items, until, c[1], last)
                c[0] = items[c[1]] if c[1] < last else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found


class Index:
    """Shelves of some test items; ``frequency`` and ``mean`` are those of all items."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[tuple[str, ...], int], total: int, mean: float) -> None:
        self.ids, self.size, self.question, self.answer = [], [], [], []
        tokens = [words(text) for _, text in sorted(items)]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for t in tokens for w in t}))}
        #: Codes of a pair of words are below; the last two stand for an unknown word and for no word.
        self.width = len(self.vocabulary) + 2
        shelves: dict[int, dict[int, list[tuple[int, float]]]] = {}
        self.single = False
        for number, ((item_id, text), found) in enumerate(zip(sorted(items), tokens)):
            count: dict[tuple[str, ...], int] = {}
            for t in terms(found):
                count[t] = count.get(t, 0) + 1
            size = sum(count.values())
            raw = {t: self._weight(frequency[t], total) * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean)) for t, n in count.items()}
            own = sum(raw.values())
            self.ids.append(item_id)
            self.size.append(len(found))
            asked, answered = (words(x) for x in parts(text))
            self.question.append(frozenset(map(self._code, zip(asked, asked[1:]))) or frozenset(map(self._code, terms(found))))
            self.answer.append(frozenset(self.vocabulary[w] for w in answered))
            self.single |= len(found) == 1
            shelf = shelves.setdefault(1 << (len(found) - 1).bit_length(), {})
            for t, score in raw.items():
                shelf.setdefault(self._code(t), []).append((number, score / own))
        self.shelves = [Shelf(step, shelf) for step, shelf in sorted(shelves.items())]
        #: The terms of all shelves; and for each shelf its own number of each of them, or -1, and that term's greatest impact, or 0.
        self.codes = np.unique(np.concatenate([np.empty(0, np.int64), *[s.codes for s in self.shelves]]))
        self.terms, self.bounds = [], []
        for shelf in self.shelves:
            at, own = np.searchsorted(self.codes, shelf.codes), np.full(len(self.codes), -1)
            own[at] = np.arange(len(at))
            self.terms.append(own)
            self.bounds.append(np.where(own >= 0, shelf.most[own], 0.0))

    def _code(self, term: tuple[str, ...]) -> int:
        return self.vocabulary[term[0]] * self.width + (self.vocabulary[term[1]] if len(term) > 1 else self.width - 1)

    @staticmethod
    def _weight(frequency: int, total: int) -> float:
        return math.log(1 + (total - frequency + 0.5) / (frequency + 0.5))

    def hits(self, text: str) -> list[tuple[int, float, int, float, float]]:
        """(item_id, score, first word of the best passage, question overlap, answer overlap) of verified items."""
        tokens = words(text)
        get, unknown = self.vocabulary.get, self.width - 2
        ids = np.fromiter((get(w, unknown) for w in tokens), np.int64, len(tokens))
        if not len(ids) or not len(self.codes):
            return []
        pairs = np.append(ids[:-1] * self.width + ids[1:], -1)
        alone = ids * self.width + self.width - 1
        place, term = self._known(pairs)
        if self.single:
            # A word by itself ends where it begins, a pair one word later.
            more, other = self._known(alone)
            place, term = np.concatenate((place, more)), np.concatenate((term, other))
            order = np.argsort(place, kind="stable")
            place, term = place[order], term[order]
        best: dict[int, tuple[int, float, int, float, float]] = {}
        for shelf, own, bounds in zip(self.shelves, self.terms, self.bounds) if len(place) else ():
            bound = bounds[term]
            here = bound > 0
            if not here.any():
                continue
            step, at, slot = shelf.step, place[here], own[term[here]]
            total = np.concatenate(([0.0], np.cumsum(bound[here])))
            begin = np.arange(0, max(1, len(tokens) - 2 * step), step)
            # The pair of a passage's last word is cut by its end; a word by itself is not.
            ends = np.minimum(begin + 3 * step, len(tokens)) - (step > 1)
            low, high = np.searchsorted(at, begin), np.searchsorted(at, ends)
            # A passage whose terms' bounds do not add up to the threshold has no pivot: WAND ends at once.
            for k in np.flatnonzero(total[high] - total[low] >= THRESHOLD - 1e-6).tolist():
                first, end = int(begin[k]), int(ends[k]) + (step > 1)
                for item, score in shelf.retrieve(np.unique(slot[low[k] : high[k]]).tolist(), THRESHOLD):
                    if score > best.get(item, (0, -1.0))[1] and (overlap := self._overlap(item, pairs[first : end - 1], alone[first:end], ids[first:end])):
                        best[item] = (self.ids[item], score, first, *overlap)
        return [best[k] for k in sorted(best)]

    def _known(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``codes`` that are terms of the index, and which."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        place = np.flatnonzero(self.codes[at] == codes)
        return place, at[place]

    def _overlap(self, item: int, pairs: np.ndarray, alone: np.ndarray, ids: np.ndarray) -> tuple[float, float] | None:
        """The best shares of question and answer that stand together within the item's span, if they suffice."""
        asked, answered = self.question[item], self.answer[item]
        events = [(p, 0, x) for p, x in enumerate(pairs.tolist()) if x in asked]
        if self.size[item] == 1:
            events += [(p, 0, x) for p, x in enumerate(alone.tolist()) if x in asked]
        events += [(p, 1, x) for p, x in enumerate(ids.tolist()) if x in answered]
        events.sort()
        span, left, best = math.ceil(SPAN * self.size[item]), 0, None
        held: tuple[dict[int, int], dict[int, int]] = ({}, {})
        for p, kind, x in events:
            held[kind][x] = held[kind].get(x, 0) + 1
            while p - events[left][0] >= span:
                _, old, y = events[left]
                held[old][y] -= 1
                if not held[old][y]:
                    del held[old][y]
                left += 1
            q, a = len(held[0]) / len(asked), len(held[1]) / len(answered) if answered else 1.0
            if q >= QUESTION and a >= ANSWER and (best is None or q + a > sum(best)):
                best = (q, a)
        return best


def indexes(items: DataFrame, block_bytes: int | None = None) -> Iterator[tuple[int, Index]]:
    """The number of blocks and the index of each, block by block, of all ``items`` (item_id, text)."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("item_id is not null and text rlike '\\\\w'")
    size, total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    if not total:
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [terms(words(t)) for t in batch.column(1).to_pylist()]
            found = [sorted({" ".join(t) for t in x}) for x in made]
            arrays = [batch.column(0), pa.array(found, pa.list_(pa.string())), pa.array(list(map(len, made)), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["item_id", "terms", "size"])

    listed = rows.mapInArrow(tidy(run), "item_id long, terms array<string>, size long")
    mean = listed.agg(F.avg("size")).first()[0]
    blocks = -(-size // (block_bytes or BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    pairs = listed.select("item_id", F.explode("terms").alias("term"))
    frequency = pairs.groupBy("term").agg(F.count("*").alias("n"))
    for k in range(blocks):
        mine = rows.where(block == k)
        if blocks == 1:
            counted = frequency
        else:
            wanted = mine.mapInArrow(tidy(run), listed.schema).select(F.explode("terms").alias("term")).distinct()
            counted = frequency.join(wanted, "term")
        found = counted.toArrow()
        counts = {tuple(t.split(" ")): n for t, n in zip(found["term"].to_pylist(), found["n"].to_pylist())}
        yield blocks, Index([tuple(r) for r in mine.collect()], counts, total, mean)


_FOUND = "doc_id long, item_id long, score double, passage long, question_overlap double, answer_overlap double"


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and test item that it holds: doc_id, item_id, score, passage, question_overlap, answer_overlap."""
    work = Workspace(docs.sparkSession, "hits")
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], _FOUND)
    for number, (blocks, index) in enumerate(indexes(items)):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [(d, *hit) for d, t in zip(*(c.to_pylist() for c in batch.columns)) for hit in index.hits(t or "")]
                names, kinds = [x.split()[0] for x in _FOUND.split(", ")], [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], kind) for k, kind in enumerate(kinds)], names)

        found = cols.mapInArrow(tidy(run), _FOUND)
        out = found if blocks == 1 else out.union(work.put(found, f"block{number}"))
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold a test item; all columns, nothing is shuffled."""
    work = Workspace(docs.sparkSession, "clean")
    at, last = docs.columns.index("text"), None
    for number, (blocks, index) in enumerate(indexes(items)):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.hits(t or "") for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
        if blocks > 1:
            docs = work.put(docs, f"block{number}")
            if last is not None:
                work.drop(last)
            last = f"block{number}"
    return docs
