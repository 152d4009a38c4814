"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier over hashed byte n-grams predicts each bit.
Decoding compares the predicted bits with every codeword, weighs each bit's logistic loss by how well
its classifier separates the training texts, and takes the codeword of least loss. A text whose two
best codewords are about equally far is flagged as ambiguous.

The classifiers are fitted on the driver, on a sample of about ``PER_LANGUAGE`` labelled texts of every
language, picked by a hash of the id; with many languages of fewer texts each, so that they come to
``SAMPLE`` in all, but of ``LEAST`` at least. Features are counted on the executors, over whole texts;
what reaches the driver is the features that a text has, about as large as its distinct n-grams.

Defined results
    null text, or no letter   ``und``, score 0
    null lang                 not learned from
    null doc_id               its remainder counts as that of the empty string
    ties                      the language that sorts first
    very long texts           counted whole, one at a time
    many languages            all are learned, the codewords grow with their logarithm
    no labelled text          every text is ``und``
    repeated rows             each is returned
    empty table               empty result
    extra columns             ignored
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.storage import tidy

#: Labelled texts of each language that are learned from (about; chosen by hash).
PER_LANGUAGE = 300
#: Labelled texts in all (about), and the fewest of a language; no language that occurs is left out.
SAMPLE, LEAST = 12_000, 20
#: Texts whose features are laid out at a time.
CHUNK = 512
#: Buckets of hashed n-grams for each n, and the n.
BUCKETS, ORDERS = 4096, (1, 2, 3)
#: Score below which a prediction is flagged as ambiguous.
AMBIGUOUS = 0.6
#: A text fits no language if its loss is so many times that of the worst text of the sample.
FAR = 3.0
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_SPACE = regex.compile(r"[\P{L}]+")


def features(text: str) -> np.ndarray:
    """Shares of the hashed n-grams of the letters of ``text``; words are set off by single spaces."""
    data = np.frombuffer(f" {_SPACE.sub(' ', text.lower()).strip()} ".encode(), np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS * len(ORDERS), np.float32)
    for k, n in enumerate(ORDERS):
        if len(data) >= n:
            code = np.zeros(len(data) - n + 1, np.uint32)
            for j in range(n):
                code = (code << np.uint32(8)) | data[j : len(data) - n + 1 + j]
            slot = (code * np.uint32(2654435761)) >> np.uint32(20)
            out[k * BUCKETS : (k + 1) * BUCKETS] = np.bincount(slot, minlength=BUCKETS) / len(code)
    return np.sqrt(out)


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each of ``n`` languages.

    Up to five, all ways to part the languages in two; beyond, random columns, chosen to be far apart.
    """
    if n <= 5:
        columns = [c for c in product((-1, 1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, np.float64).reshape(-1, n).T
    draw = np.random.default_rng(1)
    bits, best, width = max(15, int(np.ceil(10 * np.log2(n)))), None, -1.0
    for _ in range(50 if n < 100 else 5):
        code = draw.choice([-1.0, 1.0], (n, bits)).astype(np.float32)
        # The product of two rows is what they share less what they differ in.
        alike = code @ code.T
        np.fill_diagonal(alike, -bits)
        apart = (bits - alike.max()) / 2
        if apart > width and (abs(code.sum(0)) < n).all():
            best, width = code.astype(np.float64), apart
    return best


class Rows:
    """Feature vectors of many texts, of which only what is not zero is held."""

    def __init__(self, packed: list[tuple[bytes, bytes]]) -> None:
        self.slots = [np.frombuffer(s, np.uint16) for s, _ in packed]
        self.values = [np.frombuffer(v, np.float16) for _, v in packed]

    @staticmethod
    def pack(x: np.ndarray) -> tuple[bytes, bytes]:
        slots = np.flatnonzero(x)
        return slots.astype(np.uint16).tobytes(), x[slots].astype(np.float16).tobytes()

    def chunks(self) -> Iterator[tuple[slice, np.ndarray]]:
        """The rows as a full matrix, ``CHUNK`` at a time."""
        for at in range(0, len(self.slots), CHUNK):
            part = slice(at, min(len(self.slots), at + CHUNK))
            out = np.zeros((part.stop - at, BUCKETS * len(ORDERS)), np.float32)
            for k in range(at, part.stop):
                out[k - at, self.slots[k]] = self.values[k]
            yield part, out


@dataclass
class Model:
    """Languages, their codewords, the classifiers of the bits and the weight of each bit's loss."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    #: The greatest loss of a codeword at which a text still counts as its language.
    limit: float = math.inf

    def losses(self, x: np.ndarray) -> np.ndarray:
        """The weighted loss of each codeword for each row of features."""
        bits = x @ self.weights + self.bias
        return np.logaddexp(0, -bits[:, None, :] * self.code[None]) @ self.trust

    def decode(self, texts: list[str | None]) -> list[tuple[str, float, bool, float]]:
        """(language, score, ambiguous, loss of its codeword) of each whole text."""
        out = [(UNKNOWN, 0.0, False, 0.0)] * len(texts)
        rows = [k for k, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        for at in range(0, len(rows), 64):
            part = rows[at : at + 64]
            loss = self.losses(np.stack([features(texts[k]) for k in part]))
            near = np.exp(loss.min(1, keepdims=True) - loss)
            share = near / near.sum(1, keepdims=True)
            for k, row, lost in zip(part, share, loss):
                best = int(row.argmax())
                out[k] = (self.languages[best], float(row[best]), bool(row[best] < AMBIGUOUS), float(lost[best]))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each whole text."""
        return [x[:3] for x in self.decode(texts)]


def fit(rows: Rows, labels: list[str], rounds: int = 80, rate: float = 20.0, decay: float = 1e-5) -> Model:
    """Fit all bits at once by gradient descent with momentum on the logistic loss."""
    languages = sorted(set(labels))
    number = {x: k for k, x in enumerate(languages)}
    code = codewords(len(languages)) if len(languages) > 1 else np.ones((len(languages), 1))
    of = np.array([number[x] for x in labels], np.int64)
    target = code[of].astype(np.float32) if labels else np.zeros((0, 1), np.float32)
    share = (1 / np.bincount(of)[of] / len(languages)).astype(np.float32)[:, None] if labels else np.zeros((0, 1), np.float32)
    weights, bias = np.zeros((BUCKETS * len(ORDERS), code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    speed, lift = np.zeros_like(weights), np.zeros_like(bias)
    # A sample of few chunks stays laid out.
    kept = list(rows.chunks()) if len(labels) <= 4 * CHUNK else None
    for _ in range(rounds if labels else 0):
        down, level = decay * weights, np.zeros_like(bias)
        for part, x in kept or rows.chunks():
            slope = -target[part] * share[part] / (1 + np.exp(np.clip(target[part] * (x @ weights + bias), -50, 50)))
            down += x.T @ slope
            level += slope.sum(0)
        speed, lift = 0.9 * speed - rate * down, 0.9 * lift - rate / 10 * level
        weights, bias = weights + speed, bias + lift
    right = np.zeros(code.shape[1])
    for part, x in kept or rows.chunks():
        right += (share[part] * ((x @ weights + bias) * target[part] > 0)).sum(0)
    trust = np.clip(np.log(np.clip(right, 0.5, 0.999) / np.clip(1 - right, 0.001, 0.5)), 0.1, None)
    model = Model(languages, code, weights, bias, trust / trust.mean() if labels else trust)
    worst = [model.losses(x)[np.arange(len(x)), of[part]].max() for part, x in kept or rows.chunks()]
    model.limit = FAR * float(max(worst, default=math.inf))
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` labelled rows of each language that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return fit(Rows([]), [])
    wanted = min(per_language, max(LEAST, SAMPLE // len(sizes)))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], wanted / r["count"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, values = zip(*[Rows.pack(features(t)) for t in batch.column(0).to_pylist()]) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], ["lang", "slots", "values"])

    picked = rows.where(chance < F.element_at(shares, F.col("lang"))).select("text", "lang")
    found = picked.mapInArrow(tidy(run), "lang string, slots binary, values binary").toArrow().to_pylist()
    found.sort(key=lambda r: (r["lang"], r["slots"], r["values"]))
    return fit(Rows([(r["slots"], r["values"]) for r in found]), [r["lang"] for r in found])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, unsure = zip(*model.predict(batch.column(2).to_pylist())) if batch.num_rows else ((), (), ())
            arrays = [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose language cannot be told; all columns, nothing is shuffled.

    These are ``und``, and those whose nearest codeword is ``FAR`` times as far as that of any text of the sample.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.decode(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and loss <= model.limit for lang, _, _, loss in found], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
