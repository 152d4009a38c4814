"""Windows of a token sequence, cut into segments that share a minimizer.

Both substring operators ask which windows of ``width`` consecutive tokens occur more than once. A
window's minimizer is its leftmost ``seed``-token run of least hash, so equal windows have equal
minimizers, wherever they stand. Consecutive windows with the minimizer at the same place form a
segment; segments are what is shuffled: about two per ``width - seed + 2`` tokens, instead of one
row per token. A window that repeats lies in segments of equal ``key`` (the minimizer's hash).
Segments of equal ``key`` and ``dig`` have equal tokens. Offsets of windows in a segment fit a
64-bit mask, as a segment has at most ``width - seed + 1`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_U = np.uint64
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
#: Tokens hashed at a time; a longer document is taken in overlapping slices.
SLICE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers without visible structure (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def run_hashes(tokens: np.ndarray, lengths: tuple[int, ...], base: int = 0) -> list[np.ndarray]:
    """For each length, a hash of every run of so many tokens, by doubling."""
    out: list[np.ndarray | None] = [None] * len(lengths)
    done = [0] * len(lengths)
    level, span = tokens, 1
    while span <= max(lengths):
        for k, length in enumerate(lengths):
            if length & span and len(tokens) >= length:
                n = len(tokens) - length + 1
                part = level[done[k] : done[k] + n]
                out[k] = part.copy() if out[k] is None else out[k] + part * _U(pow(_BASE[base], done[k], 1 << 64))
                done[k] += span
        if len(level) <= span:
            break
        level, span = level[:-span] + level[span:] * _U(pow(_BASE[base], span, 1 << 64)), span * 2
    return [mix(x) if x is not None and d == n else np.empty(0, _U) for x, d, n in zip(out, done, lengths)]


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE[0]))
_SEPARATOR = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])


def byte_tokens(data: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(data, np.uint8)]


def word_tokens(data: bytes) -> np.ndarray:
    """A hash of every word, a maximal run without U+0020 and U+0009 to U+000D."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SEPARATOR[raw]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, _U)
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    powers = np.multiply.accumulate(np.full(int(length.max()), _BASE[1], _U))
    return mix(np.add.reduceat(_BYTES[raw[at]] * powers[place], first) + length.astype(_U))


@dataclass(frozen=True)
class Spec:
    """Windows of ``width`` tokens with minimizers of ``seed`` tokens."""

    width: int
    seed: int
    words: bool

    def tokens(self, data: bytes) -> np.ndarray:
        return word_tokens(data) if self.words else byte_tokens(data)

    @property
    def span(self) -> int:
        """The most windows of a segment."""
        return self.width - self.seed + 1


def segments(pieces: list[np.ndarray], spec: Spec) -> tuple[np.ndarray, ...]:
    """For the windows of each piece: (piece, start, windows, key, dig) of each segment, as arrays."""
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    tokens = np.concatenate(pieces) if pieces else np.empty(0, _U)
    if len(tokens) < spec.width:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    owner = np.repeat(np.arange(len(pieces)), lens)
    seeds, windows = run_hashes(tokens, (spec.seed, spec.width))
    least = (seeds & _U(0xFFFFFFFF00000000)) | np.arange(len(seeds), dtype=_U)
    reach = 1
    while reach * 2 <= spec.span:
        least, reach = np.minimum(least[:-reach], least[reach:]), reach * 2
    if reach < spec.span:
        least = np.minimum(least[: len(least) - (spec.span - reach)], least[spec.span - reach :])
    whole = np.flatnonzero(owner[: len(windows)] == owner[spec.width - 1 :])
    if not len(whole):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    place = (least[whole] & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(whole, prepend=-2) != 1))
    count = np.diff(np.append(first, len(whole)))
    rank = np.arange(len(whole)) - np.repeat(first, count)
    powers = np.multiply.accumulate(np.full(spec.span, _BASE[1], _U))
    dig = mix(np.add.reduceat(windows[whole] * powers[rank], first))
    base = np.concatenate(([0], np.cumsum(lens)[:-1]))
    piece = owner[whole[first]]
    return piece, whole[first] - base[piece], count, seeds[place[first]].view(np.int64), dig.view(np.int64)


def scan(docs: Iterator[tuple[int, int, bytes]], spec: Spec) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of many documents (doc, mark, text): arrays of (key, dig, doc, mark, start, n)."""
    pieces: list[np.ndarray] = []
    labels: list[tuple[int, int, int]] = []

    def flush() -> tuple[np.ndarray, ...]:
        piece, start, n, key, dig = segments(pieces, spec)
        doc, mark, base = (np.array([x[i] for x in labels], np.int64)[piece] for i in range(3))
        pieces.clear()
        labels.clear()
        return key, dig, doc, mark, (start + base).astype(np.int32), n.astype(np.int32)

    held = 0
    for doc, mark, data in docs:
        tokens = spec.tokens(data)
        for base in range(0, len(tokens) - spec.width + 1, SLICE):
            cut = tokens[base : base + SLICE + spec.width - 1]
            pieces.append(cut)
            labels.append((doc, mark, base))
            held += len(cut)
            if held >= SLICE:
                yield flush()
                held = 0
    if pieces:
        yield flush()


def covered(n_tokens: int, starts: np.ndarray, masks: np.ndarray, width: int) -> np.ndarray:
    """Which tokens lie in a window whose bit is set, as booleans."""
    segment, offset = np.nonzero((masks.view(_U)[:, None] >> np.arange(64, dtype=_U)) & _U(1))
    at = starts[segment] + offset
    edge = np.bincount(at, minlength=n_tokens + 1)[: n_tokens + 1] - np.bincount(at + width, minlength=n_tokens + 1)[: n_tokens + 1]
    return np.cumsum(edge)[:n_tokens] > 0
