"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its hashed words, weighted by their counts, and one feature for the bin of each
structure statistic (length, capitals, signs, digits, repetition, lines and so on) and of what the
table says of its length. Every pair of features interacts through low-rank factors, and a score takes
time linear in the features: the square of the factors' sum less the sum of their squares, halved.
Language, source, id and labels are never features.

Defined results: null text counts as empty and is scored like any other; a null n_chars is a bin of
its own; texts are read whole; repeated rows give repeated scores; without usable labels of both
classes every score is the share of label 1 among them, or 0.5 if there are none; an empty table gives
an empty result; ids keep their type, and other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import column, fold, keyed_schema, labelled_sample, text_slices

#: Bounds of the sample that the model is fitted on.
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 50_000
#: Rows with this remainder of crc32(doc_id) are held out from all fitting.
FOLDS, HELD_OUT = 3, 1

WORD_BITS = 15
FACTORS = 8
BINS = 24
EPOCHS, BATCH, RATE, DECAY = 12, 250, 0.03, 1e-4
#: A text's words together weigh as much as this many statistics.
WORD_WEIGHT = 1.0
STATISTICS = ("words", "bytes", "word_length", "capitals", "digits", "signs", "odd_signs", "marks", "high_bytes", "distinct_share", "repeat_share", "lines", "line_words", "top_share", "declared", "declared_gap")


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all words: the hash of its lower-case bytes, its length, the number of its text."""
    split = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    total = int(counts.sum())
    hashes = np.fromiter((h for w in split for h in map(zlib.crc32, w)), np.int64, total)
    sizes = np.fromiter((h for w in split for h in map(len, w)), np.int64, total)
    return hashes, sizes, np.repeat(np.arange(len(texts)), counts)


class Features:
    """Sparse rows of a batch of texts: words as (row, column, weight), and the statistics' values."""

    def __init__(self, texts: list[bytes], declared: np.ndarray):
        """declared: n_chars of each text, NaN if it is null."""
        n = len(texts)
        hashes, sizes, doc = _words(texts)
        column = hashes & ((1 << WORD_BITS) - 1)
        pair, count = np.unique(doc << 32 | hashes, return_counts=True)
        pair_doc = pair >> 32
        counted, times = np.unique(doc << WORD_BITS | column, return_counts=True)
        self.row, self.column = counted >> WORD_BITS, counted & ((1 << WORD_BITS) - 1)
        weight = np.log1p(times)
        norm = np.sqrt(np.bincount(self.row, weight**2, n))
        self.weight = WORD_WEIGHT * weight / norm[self.row]
        per = lambda x, m=None: np.bincount(doc, x, n)
        words = np.bincount(doc, minlength=n).astype(float)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        bound = np.r_[0, np.cumsum(size)]
        total = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][bound])
        some, any_words = np.maximum(size, 1), np.maximum(words, 1)
        capital, small = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
        digit, high = (raw >= 48) & (raw <= 57), raw >= 128
        odd = np.isin(raw, np.frombuffer(b"#$%&*|<>=~^{}[]\\_/", np.uint8))
        mark = np.isin(raw, np.frombuffer(b"!?", np.uint8))
        sign = (raw > 32) & ~capital & ~small & ~digit & ~high
        chars = size - total(high & (raw < 192))
        distinct = np.bincount(pair_doc, minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, pair_doc, count)
        follows = np.r_[False, (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])][: len(hashes)]
        lines = total(raw == 10) + 1.0
        gap = np.abs(declared - chars) / np.maximum(chars, 1)
        self.statistics = np.stack(
            [
                np.log1p(words), np.log1p(size), per(sizes) / any_words, total(capital) / some, total(digit) / some, total(sign) / some, total(odd) / some, total(mark) / some,
                total(high) / some, distinct / any_words, per(follows) / any_words, np.log1p(lines), np.log1p(words / lines), top / any_words, np.log1p(np.maximum(declared, 0)), gap,
            ],
            axis=1,
        )
        self.n = n

    @staticmethod
    def gathered(texts: list[bytes], declared: np.ndarray, part: int = 250) -> Features:
        """The features of many texts, worked out part by part, since the words' arrays are large."""
        parts = [Features(texts[at : at + part], declared[at : at + part]) for at in range(0, max(1, len(texts)), part)]
        out = object.__new__(Features)
        shift = np.cumsum([0, *(p.n for p in parts)])
        out.row = np.concatenate([p.row + s for p, s in zip(parts, shift, strict=False)]).astype(np.int32)
        out.column = np.concatenate([p.column for p in parts]).astype(np.int32)
        out.weight = np.concatenate([p.weight for p in parts]).astype(np.float32)
        out.statistics, out.n = np.concatenate([p.statistics for p in parts]), len(texts)
        return out

    def take(self, rows: np.ndarray) -> Features:
        out = object.__new__(Features)
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        kept = place[self.row] >= 0
        by = np.argsort(place[self.row[kept]], kind="stable")
        out.row, out.column, out.weight = place[self.row[kept]][by], self.column[kept][by], self.weight[kept][by]
        out.statistics, out.n = self.statistics[rows], len(rows)
        return out


class FactorisationMachine:
    """w0 + sum w x + sum over pairs of <v, v'> x x'; the last columns are the statistics' bins."""

    def __init__(self, features: Features, label: np.ndarray, seed: int = 1):
        self.constant = float(label.mean()) if len(label) else 0.5
        self.w = None
        if not 0 < label.sum() < len(label):
            return
        values = features.statistics
        inside = [values[~np.isnan(values[:, j]), j] for j in range(values.shape[1])]
        self.edges = [np.unique(np.quantile(v, np.linspace(0, 1, BINS)[1:-1])) if len(v) else np.zeros(0) for v in inside]
        size = (1 << WORD_BITS) + values.shape[1] * (BINS + 1)
        rng = np.random.default_rng(seed)
        self.w0 = float(np.log(self.constant / (1 - self.constant)))
        self.w = np.zeros(size)
        self.v = rng.normal(0, 0.02, (size, FACTORS))
        state = [np.zeros_like(x) for x in (self.w, self.v) * 2]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(features.n)
            for at in range(0, features.n, BATCH):
                rows = order[at : at + BATCH]
                step += 1
                self._step(features.take(rows), label[rows], state, step)

    def bins(self, statistics: np.ndarray) -> np.ndarray:
        """Columns of the statistics' bins; a missing value has the last bin of its statistic."""
        out = np.empty(statistics.shape, np.int64)
        for j, edges in enumerate(self.edges):
            v = statistics[:, j]
            out[:, j] = (1 << WORD_BITS) + j * (BINS + 1) + np.where(np.isnan(v), BINS, np.searchsorted(edges, np.nan_to_num(v), "right"))
        return out

    def _sums(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row: the margin, the factors' sums, and the columns of its bins."""
        bins = self.bins(f.statistics)
        linear = self.w0 + np.bincount(f.row, self.w[f.column] * f.weight, f.n) + self.w[bins].sum(1)
        total = self.v[bins].sum(1)
        squares = (self.v[bins] ** 2).sum((1, 2))
        for k in range(FACTORS):
            vx = self.v[f.column, k] * f.weight
            total[:, k] += np.bincount(f.row, vx, f.n)
            squares += np.bincount(f.row, vx * vx, f.n)
        return linear + 0.5 * ((total**2).sum(1) - squares), total, bins

    def _step(self, f: Features, y: np.ndarray, state: list[np.ndarray], step: int) -> None:
        margin, total, bins = self._sums(f)
        error = (1 / (1 + np.exp(-margin)) - y) / f.n
        self.w0 -= RATE * float(error.sum())
        columns = np.concatenate([f.column, bins.ravel()])
        rows = np.concatenate([f.row, np.repeat(np.arange(f.n), bins.shape[1])])
        x = np.concatenate([f.weight, np.ones(bins.size)])
        g = error[rows] * x
        size = len(self.w)
        grads = [np.bincount(columns, g, size) + DECAY * self.w, DECAY * self.v]
        for k in range(FACTORS):
            grads[1][:, k] += np.bincount(columns, g * (total[rows, k] - self.v[columns, k] * x), size)
        for i, (weight, grad) in enumerate(zip((self.w, self.v), grads, strict=True)):
            state[i] = 0.9 * state[i] + 0.1 * grad
            state[i + 2] = 0.99 * state[i + 2] + 0.01 * grad * grad
            weight -= RATE * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 2] / (1 - 0.99**step)) + 1e-8)

    def score(self, texts: list[bytes], declared: np.ndarray) -> np.ndarray:
        if self.w is None or not texts:
            return np.full(len(texts), self.constant)
        margin, _, _ = self._sums(Features(texts, declared))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> FactorisationMachine:
    sample = labelled_sample(docs, labels, "quality", fold("doc_id", FOLDS) != HELD_OUT, rows, chars, ("n_chars",))
    declared = np.array([np.nan if r.n_chars is None else r.n_chars for r in sample], float)
    label = np.array([int(r.label > 0) for r in sample], float)
    return FactorisationMachine(Features.gathered([r.text.encode() for r in sample], declared), label)


def scored(docs: DataFrame, model: FactorisationMachine, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """(key, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            declared = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            score = model.score(list(text_slices(batch.column(1))), declared)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["key", "score"])

    narrow = docs.select(column(key).alias("key"), column(text).alias("text"), column(n_chars).cast("double").alias("declared"))
    return narrow.mapInArrow(run, keyed_schema(narrow, "score double"))


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    found = scored(docs, fit(docs, labels)).withColumnRenamed("key", "doc_id")
    held = (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return found.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
