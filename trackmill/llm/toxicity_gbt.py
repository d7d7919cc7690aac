"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: density of lexicon words, their nearness to the second person, capitals,
punctuation and obfuscation rates. The lexicon is learned from a bounded sample of labelled rows: words,
and beginnings of words, that toxic texts hold far more often than others, besides a short fixed list.
Features for training come from lexicons that have not seen their rows, and so do the predictions that
the calibration is fitted on; of a class with two rows there are two such folds, of one with a single row
none, and the model is fitted and calibrated on rows that it has seen.

Defined results: null text counts as empty and is scored like any other; texts are read whole; repeated
rows give repeated scores; without usable labels of both classes every score is the share of label 1
among them, or 0 if there are none; an empty table gives an empty result; ids keep their type; other
columns, whatever their names, are not read, or are handed on unchanged.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import fold, keyed_schema, labelled_sample, text_input, text_slices, unpacked, whole_rows

#: Bounds of the sample that the model is fitted on.
SAMPLE_ROWS = 8000
SAMPLE_CHARS = 50_000
#: Rows with this remainder of crc32(doc_id) are held out from all fitting.
FOLDS, HELD_OUT = 5, 0

TREES, DEPTH, RATE, BINS = 60, 2, 0.2, 32
#: Rows of a leaf: as many, or as the rarer class has.
LEAF = 8
#: Rows that each step of the calibration counts besides its own, by the number n of labels, and the toxic
#: share of them: without evidence a text is clean, whatever the share of toxic ones among a few labels.
PRIOR_ROWS, PRIOR_SHARE = lambda n: 1 + 60 / n, 0.05
TERMS = 500
#: A lexicon term is in at least so many toxic texts, with at least this log-odds ratio.
TERM_TEXTS, TERM_ODDS = 4, 2.5
#: The beginning of several words of a text is a term from two toxic texts on if they hold at least so many
#: words with it, of which each text counts up to MOST_WORDS, and the words have that log-odds ratio.
TERM_WORDS, MOST_WORDS = 6, 4
PREFIXES = (4, 5, 6, 7)
NEAR_WORDS = 5
MEMORY_WORDS = 400_000

INSULTS = "idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown dumb fool imbecile dummkopf trottel abschaum crétin imbécile connard estúpido imbécil basura".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split()
#: Signs that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None, "+": "t"})
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
FEATURES = ("hit_rate", "hits", "odds_rate", "near_rate", "second_rate", "capital_share", "shout_rate", "mark_rate", "sign_share", "mangled_rate", "mangled_hits", "words")
#: Features of which more never tells against toxicity: splits that say so are not taken.
RISING = frozenset(FEATURES.index(f) for f in ("hit_rate", "hits", "odds_rate", "near_rate", "mangled_hits"))


def plain(word: str) -> str:
    """Lower case, composed, without signs and digits at its ends."""
    return _EDGE.sub("", unicodedata.normalize("NFC", word).lower())


def revealed(word: str) -> str:
    """A word with letters for the signs and digits that stand for them, and long repeats cut to one."""
    word = _EDGE.sub("", word.lower().translate(DISGUISE))
    return re.sub(r"(.)\1{2,}", r"\1", word)


def words_in(raw: bytes) -> list[bytes]:
    return raw.split()


def terms_of(raw: bytes) -> Counter[str]:
    """The distinct plain words of a text, and the beginnings of longer ones marked by a last *, with the
    number of words that have them."""
    words = {plain(w.decode()) for w in set(words_in(raw))}
    return Counter([w for w in words if len(w) > 1] + [w[:n] + "*" for w in words for n in PREFIXES if len(w) > n])


def _number(term: str) -> int:
    return zlib.crc32(term.encode())


class Terms:
    """The terms of the sample's texts as 32-bit hashes; names are kept for those of several toxic texts."""

    def __init__(self, texts: list[bytes], label: np.ndarray):
        self.of: list[np.ndarray] = []
        self.words: list[np.ndarray] = []  # how many words have each, up to MOST_WORDS
        self.names: dict[int, str] = {}
        once = np.zeros(1 << 24, bool)
        for raw, toxic in zip(texts, label, strict=True):
            counted = terms_of(raw)
            terms = list(counted)
            numbers = np.fromiter(map(_number, terms), np.uint32, len(terms))
            own, first = np.unique(numbers, return_index=True)
            self.of.append(own)
            self.words.append(np.minimum(np.fromiter(counted.values(), np.int64, len(terms))[first], MOST_WORDS).astype(np.uint8))
            if toxic:
                place = numbers & np.uint32((1 << 24) - 1)
                self.names.update((int(numbers[i]), terms[i]) for i in np.flatnonzero(once[place]))
                once[place] = True

    def texts_with(self, rows: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the given texts that hold each of the terms, which are sorted, and of their words."""
        texts, words = np.zeros((2, len(numbers)), np.int64)
        for i in rows:
            own = self.of[i]
            at = np.minimum(np.searchsorted(numbers, own), len(numbers) - 1)
            same = numbers[at] == own
            texts[at[same]] += 1
            words[at[same]] += self.words[i][same]
        return texts, words


def learn_lexicon(terms: Terms, label: np.ndarray, rows: np.ndarray) -> dict[str, float]:
    """Log-odds of the terms that tell toxic texts among ``rows`` apart, besides the fixed list."""
    bad, good = rows[label[rows] > 0], rows[label[rows] == 0]
    seen, count = np.unique(np.concatenate([terms.of[i] for i in bad]), return_counts=True)
    numbers = np.union1d(seen[count >= 2], np.array([_number(w) for w in INSULTS], np.uint32))
    (toxic, words), (other, other_words) = terms.texts_with(bad, numbers), terms.texts_with(good, numbers)
    odds = np.log((toxic + 0.5) / (len(bad) + 1)) - np.log((other + 0.5) / (len(good) + 1))
    several = (toxic >= 2) & (words >= TERM_WORDS) & (words >= 2 * toxic)
    odds_of_words = np.log((words + 0.5) / (len(bad) + 1)) - np.log((other_words + 0.5) / (len(good) + 1))
    odds = np.where(several, np.maximum(odds, odds_of_words), odds)
    name = {i: terms.names.get(int(n)) for i, n in enumerate(numbers)}
    often = (toxic >= TERM_TEXTS) | several
    telling = [i for i in np.flatnonzero(often & (odds >= TERM_ODDS)).tolist() if name[i]]
    best = sorted(telling, key=lambda i: (-odds[i] * math.sqrt(words[i]), name[i]))[:TERMS]
    common = set(numbers[(toxic + other >= TERM_TEXTS) & (odds <= 0)].tolist())
    return {w: TERM_ODDS for w in INSULTS if _number(w) not in common} | {name[i]: float(min(odds[i], 6.0)) for i in best}


class Featurizer:
    """Dense features of texts, by batches; what is known of a word is remembered."""

    #: Columns of what is known of a word.
    ODDS, SECOND, SHOUT, MANGLED, MANGLED_HIT = range(5)

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.second = set(SECOND_PERSON)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows: list[tuple[float, ...]] = []
        self.row_of: dict[tuple[float, ...], int] = {}

    def _odds(self, word: str) -> float:
        best = self.lexicon.get(word, 0.0)
        for n in PREFIXES:
            if len(word) > n:
                best = max(best, self.lexicon.get(word[:n] + "*", 0.0))
        return best

    def _look(self, raw: bytes) -> tuple[float, ...]:
        word = raw.decode()
        core = plain(word)
        odds = self._odds(core)
        inner = word.strip(".,;:!?\"'()[]|#$%&*")
        mangled = hidden = 0.0
        if inner and not inner.isalpha() and any(c.isalpha() for c in inner):
            mangled = 1.0
        if not odds:
            hidden = self.lexicon.get(revealed(word), 0.0) if (mangled or re.search(r"(.)\1\1", core)) else 0.0
        shout = float(len(core) > 1 and inner.isupper())
        return (odds or hidden, float(core in self.second), shout, mangled, float(hidden > 0))

    def batch(self, texts: list[bytes]) -> np.ndarray:
        split = [words_in(t) for t in texts]
        if len(self.known) > MEMORY_WORDS:
            self._forget()
        known = self.known
        new = {w for words in split for w in words if w not in known}
        for w in new:
            row = self._look(w)
            if row not in self.row_of:
                self.row_of[row] = len(self.rows)
                self.rows.append(row)
            known[w] = self.row_of[row]
        counts = np.array([len(w) for w in split], np.int64)
        total = int(counts.sum())
        out = np.zeros((len(texts), len(FEATURES)))
        code = np.fromiter((known[w] for words in split for w in words), np.int64, total)
        for w in new:
            if len(w) > 100:
                del known[w]
        doc = np.repeat(np.arange(len(texts)), counts)
        table = np.array(self.rows).reshape(-1, 5)[code] if total else np.zeros((0, 5))
        odds, second = table[:, self.ODDS], table[:, self.SECOND]
        add = lambda x: np.bincount(doc, x, len(texts))
        hits, n = add(odds > 0), np.maximum(counts, 1)
        ends = np.cumsum(counts)
        at = np.flatnonzero(odds > 0)
        seen = np.r_[0, np.cumsum(second)]
        low = np.maximum(at - NEAR_WORDS, (ends - counts)[doc[at]])
        high = np.minimum(at + NEAR_WORDS + 1, ends[doc[at]])
        near = np.bincount(doc[at], seen[high] > seen[low], len(texts))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        bound = np.r_[0, np.cumsum(size)]
        share = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][bound]) / np.maximum(size, 1)
        capital = (raw >= 65) & (raw <= 90)
        mark = (raw == 33) | (raw == 63)
        sign = (raw > 32) & (raw < 128) & ~capital & ~((raw >= 97) & (raw <= 122)) & ~((raw >= 48) & (raw <= 57)) & ~mark
        out[:, 0], out[:, 1], out[:, 2], out[:, 3] = hits / n, np.log1p(hits), add(odds) / n, near / n
        out[:, 4], out[:, 5], out[:, 6] = add(second) / n, share(capital), add(table[:, self.SHOUT]) / n
        out[:, 7], out[:, 8], out[:, 9] = share(mark), share(sign), add(table[:, self.MANGLED]) / n
        out[:, 10], out[:, 11] = np.log1p(add(table[:, self.MANGLED_HIT])), np.log1p(counts)
        return out


class Trees:
    """Boosted regression trees for log-loss, split on histogram bins, with Newton leaves."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
        b = np.stack([np.searchsorted(self.edges[j], x[:, j], "left") for j in range(d)], axis=1)
        self.leaf = max(1, min(LEAF, int(y.sum()), int(n - y.sum())))
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(rate / (1 - rate))
        f = np.full(n, self.base)
        self.trees = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            tree, node = self._grow(b, g, h)
            self.trees.append(tree)
            f += tree["value"][node]
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        n, d = b.shape
        m = 2 ** (DEPTH + 1) - 1
        feature, cut, value = np.full(m, -1), np.zeros(m, int), np.zeros(m)
        node = np.zeros(n, int)
        for parent in range(2**DEPTH - 1):
            rows = np.flatnonzero(node == parent)
            if len(rows) < 2 * self.leaf:
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            best, where = 1e-6, None
            for j in range(d):
                count = np.cumsum(np.bincount(b[rows, j], minlength=BINS))
                gl, hl = np.cumsum(np.bincount(b[rows, j], g[rows], BINS)), np.cumsum(np.bincount(b[rows, j], h[rows], BINS))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(count < self.leaf) | (len(rows) - count < self.leaf)] = 0
                if j in RISING:
                    gain[gl / (hl + 1) > (gs - gl) / (hs - hl + 1)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, where = gain[k], (j, k)
            if where:
                feature[parent], cut[parent] = where
                right = b[rows, where[0]] > where[1]
                node[rows] = 2 * parent + 1 + right
        gsum, hsum = np.bincount(node, g, m), np.bincount(node, h, m)
        value = RATE * gsum / (hsum + 1)
        return {"feature": feature, "cut": cut, "value": value}, node

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(self.edges[j], x[:, j], "left") for j in range(x.shape[1])], axis=1)
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for tree in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                j = tree["feature"][node]
                node = np.where(j >= 0, 2 * node + 1 + (b[rows, j] > tree["cut"][node]), node)
            f += tree["value"][node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray, prior: float = 0.0, share: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the rising step fit, by pooling adjacent violators; each step counts
    ``prior`` further rows, of which ``share`` are toxic."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of scores
    for s, t in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([t, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    likely = [(b[0] + prior * share) / (b[1] + prior) for b in blocks]
    return np.array([b[2] / b[1] for b in blocks]), np.maximum.accumulate(likely)


class ToxicityModel:
    def __init__(self, texts: list[bytes], label: np.ndarray, parts: int = 3):
        self.constant = float(label.mean()) if len(label) else 0.0
        self.trees = None
        rarer = int(min(label.sum(), len(label) - label.sum()))
        if not rarer:
            return
        parts = min(parts, rarer)
        terms = Terms(texts, label)
        part = np.empty(len(texts), int)
        for y in (0, 1):  # each fold has its share of either class
            own = np.flatnonzero(label == y)
            part[own] = np.arange(len(own)) % parts
        x = np.zeros((len(texts), len(FEATURES)))
        for k in range(parts):
            own = np.flatnonzero(part == k)
            rest = np.flatnonzero(part != k) if parts > 1 else own
            seen = Featurizer(learn_lexicon(terms, label, rest))
            for at in range(0, len(own), 200):
                x[own[at : at + 200]] = seen.batch([texts[i] for i in own[at : at + 200]])
        unseen = np.zeros(len(texts))
        for k in range(parts):
            rest = part != k if parts > 1 else part == k
            unseen[part == k] = Trees().fit(x[rest], label[rest]).raw(x[part == k])
        self.knots = isotonic(unseen, label, PRIOR_ROWS(len(label)), PRIOR_SHARE)
        self.trees = Trees().fit(x, label)
        self.lexicon = learn_lexicon(terms, label, np.arange(len(texts)))

    def featurizer(self) -> Featurizer | None:
        return Featurizer(self.lexicon) if self.trees else None

    def score(self, featurizer: Featurizer | None, texts: list[bytes]) -> np.ndarray:
        if not self.trees or not texts:
            return np.full(len(texts), self.constant)
        raw = self.trees.raw(featurizer.batch(texts))
        return np.clip(np.interp(raw, *self.knots), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> ToxicityModel:
    sample = labelled_sample(docs, labels, "toxic", fold("doc_id", FOLDS) != HELD_OUT, rows, chars)
    return ToxicityModel([r.text.encode() for r in sample], np.array([int(r.label > 0) for r in sample], float))


def scored(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str | None = "text") -> DataFrame:
    """(key, score) of every document."""
    narrow, texts_of = text_input(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = model.featurizer()
        for batch in batches:
            score = model.score(featurizer, list(text_slices(texts_of(batch))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["key", "score"])

    return narrow.mapInArrow(run, keyed_schema(narrow, "score double"))


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    found = scored(docs, fit(docs, labels)).withColumnRenamed("key", "doc_id")
    held = (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return found.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, whole; all of them without usable labels."""
    model = fit(docs, labels)
    if not model.trees:
        return docs
    kept = scored(whole_rows(docs), model, key="row", text=None).filter("score < 0.5")
    return kept.select(*unpacked(kept, docs, "key"))
