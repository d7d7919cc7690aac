"""Benchmark decontamination with an FM-index per training shard.

Words are numbered by the benchmark's vocabulary. Each task joins its documents into shards; a shard's
word sequence, parted wherever a word or a pair of neighbours occurs in no benchmark window, is suffix
sorted, and its Burrows-Wheeler transform is kept in a wavelet matrix. All windows are searched
backwards together through its ranks, occurrences are located through sampled suffix positions, and
the spans to remove are merged per document. The documents are not shuffled.

The benchmark is written to the shared scratch folder, and each task reads it from there in blocks of
at most ``BLOCK_BYTES`` bytes (a longer item makes a block of its own) against each of its shards, so
neither the driver nor a task holds more of it than a block.

Defined results: null text has no words, no hits and is clean; benchmark items without words never
occur; items without an id mark words but are not listed; repeated items count once; repeated
documents are judged one by one; texts are read whole, a very long one in a shard of its own; an empty
benchmark leaves everything clean, and an empty table gives an empty result; ids keep their type; other
columns, whatever their names, are not read, or are handed on unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import column, keyed_schema, opened, scratch_path, text_input, text_slices, unpacked, whole_rows

WINDOW = 13
#: A document is contaminated if at least one of so many of its words is hit.
SHARE = 20
BLOCK_BYTES = 4 << 20
#: A shard ends at so many bytes of text or indexed words.
SHARD_BYTES = 24 << 20
SHARD_WORDS = 400_000
SAMPLE_EVERY = 8
PAIR_BITS = 22
#: Bytes of a word: digits, letters in lower case, everything outside ASCII; A-Z become a-z.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD_RE = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD_BYTES).split()


class WaveletMatrix:
    """Rank queries over a sequence of small integers."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        seq = symbols
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)].astype(np.int32))
            self.zeros.append(int(len(seq) - self.ones[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.bits - 1 - depth)) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low = np.where(bit, zeros + a, low - a)
            high = np.where(bit, zeros + b, high - b)
        return high - low


def suffix_order(rank: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling over what is still tied."""
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    start = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if n else np.zeros(0, np.int64)
    group = np.repeat(start, np.diff(np.r_[start, n]))
    rank = np.empty(n, np.int64)
    rank[order] = group
    size = np.zeros(n, np.int64)
    k = 1
    while True:
        size[:] = 0
        np.add.at(size, rank, 1)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            break
        after = np.where(open_ + k < n, rank[np.minimum(open_ + k, n - 1)] + 1, 0)
        head = rank[open_]
        by = np.argsort(head * (n + 2) + after, kind="stable")
        head, after, where = head[by], after[by], open_[by]
        new_head = np.r_[True, head[1:] != head[:-1]]
        new = new_head | np.r_[True, after[1:] != after[:-1]]
        at = np.arange(len(by))
        first = np.maximum.accumulate(np.where(new_head, at, 0))
        rank[where] = head + np.maximum.accumulate(np.where(new, at, 0)) - first
        k *= 2
    order[rank] = np.arange(n)
    return order


class FMIndex:
    """Backward search and location over a sequence in which symbol 0 parts what is searched."""

    def __init__(self, seq: np.ndarray, symbols: int):
        """seq: ends with 0. Every 0 is a symbol of its own to the suffix order."""
        n = len(seq)
        zero = seq == 0
        order = suffix_order(np.where(zero, np.cumsum(zero) - 1, seq + int(zero.sum())))
        bwt = seq[order - 1]
        self.starts = np.r_[0, np.cumsum(np.bincount(seq, minlength=symbols))]
        self.wavelet = WaveletMatrix(bwt, max(1, (symbols - 1).bit_length()))
        # run starts are sampled too, so that no walk steps over a 0
        sampled = (order % SAMPLE_EVERY == 0) | (bwt == 0)
        self.bwt = bwt
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]
        self.n = n

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (low, high) of the suffixes that start with each pattern; patterns of equal length."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n)
        live = np.arange(len(patterns))
        for at in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, at]
            low[live] = self.starts[c] + self.wavelet.rank(c, low[live])
            high[live] = self.starts[c] + self.wavelet.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        gone = np.ones(len(patterns), bool)
        gone[live] = False
        high[gone] = low[gone]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix rows, each walked back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walk = np.flatnonzero(~self.sampled[rows])
        while len(walk):
            c = self.bwt[rows[walk]]
            rows[walk] = self.starts[c] + self.wavelet.rank(c, rows[walk])
            steps[walk] += 1
            walk = walk[~self.sampled[rows[walk]]]
        return self.samples[self.sample_rank[rows]] + steps


class Phrases:
    """A block of the benchmark: its windows as number sequences, and the items that hold each."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int = WINDOW):
        self.words: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, raw in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(raw)]
            for at in range(max(1, len(ids) - width + 1) if ids else 0):
                owners.setdefault(tuple(ids[at : at + width]), set()).update([] if item is None else [item])
        by_size: dict[int, list] = {}
        for window in owners:
            by_size.setdefault(len(window), []).append(window)
        self.windows = {n: np.array(rows, np.int64) for n, rows in by_size.items()}
        self.owners = {n: [sorted(owners[w]) for w in rows] for n, rows in by_size.items()}
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for n, rows in self.windows.items():
            for at in range(n - 1):
                self.pairs[self.pair(rows[:, at], rows[:, at + 1])] = True
        self.single = np.zeros(len(self.words) + 1, bool)
        if 1 in self.windows:
            self.single[self.windows[1][:, 0]] = True
        self.least = min((n for n in self.windows if n > 1), default=1 << 60)

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b * 0x85EBCA6B) >> 7) & ((1 << PAIR_BITS) - 1)

    def runs(self, ids: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ids that some window may cover, in order, and where a new run starts among
        them. new: whether each word starts a document."""
        keep = np.flatnonzero(ids)
        if not len(keep):
            return keep, np.zeros(0, bool)
        kept = ids[keep]
        joined = (np.diff(keep) == 1) & ~new[keep[1:]] & self.pairs[self.pair(kept[:-1], kept[1:])]
        start = np.r_[True, ~joined]
        run = np.cumsum(start) - 1
        size = np.bincount(run)
        good = size >= self.least
        if self.single.any():
            good |= np.bincount(run, self.single[kept]) > 0
        chosen = good[run]
        return keep[chosen], start[chosen]


class Shard:
    """Documents under one index."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.docs = self.size = self.kept = 0
        self.n_words: list[int] = []
        self.ids: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.word: list[np.ndarray] = []
        self.start: list[np.ndarray] = []

    def add(self, texts: list[bytes]) -> None:
        known = self.phrases.words
        sizes, ids = [], []
        for raw in texts:
            words = words_of(raw)
            sizes.append(len(words))
            ids.append(np.array([known.get(w, 0) for w in words], np.int64))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        sizes_a = np.array(sizes, np.int64)
        first = np.cumsum(np.r_[0, sizes_a])[:-1]
        new = np.zeros(len(flat), bool)
        new[first[sizes_a > 0]] = True
        at, start = self.phrases.runs(flat, new)
        doc = np.repeat(np.arange(len(texts)), sizes_a)[at]
        self.ids.append(flat[at])
        self.start.append(start)
        self.doc.append(doc + self.docs)
        self.word.append(at - first[doc])
        self.n_words += sizes
        self.docs += len(texts)
        self.size += sum(map(len, texts))
        self.kept += len(at)

    def hits(self) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """Per document: its number of words, merged [start, end) word spans, items that occur."""
        spans: list[list[tuple[int, int]]] = [[] for _ in range(self.docs)]
        found: list[set[str]] = [set() for _ in range(self.docs)]
        if self.kept:
            ids, doc, word, start = (np.concatenate(x) for x in (self.ids, self.doc, self.word, self.start))
            place = np.arange(len(ids)) + np.cumsum(start) - 1  # one 0 before each run but the first
            seq = np.zeros(int(place[-1]) + 2, np.int64)
            seq[place] = ids
            source = np.full(len(seq), -1)
            source[place] = np.arange(len(ids))
            index = FMIndex(seq, len(self.phrases.words) + 1)
            edge = np.zeros(len(ids) + 1, np.int64)
            for n, windows in self.phrases.windows.items():
                low, high = index.search(windows)
                for at in np.flatnonzero(low < high).tolist():
                    items = self.phrases.owners[n][at]
                    for row in range(int(low[at]), int(high[at]), 1 << 20):
                        where = source[index.locate(np.arange(row, min(int(high[at]), row + (1 << 20))))]
                        np.add.at(edge, where, 1)
                        np.add.at(edge, where + n, -1)
                        if items:
                            for d in np.unique(doc[where]).tolist():
                                found[d].update(items)
            hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            if len(hit):
                new = np.r_[True, (doc[hit[1:]] != doc[hit[:-1]]) | (word[hit[1:]] != word[hit[:-1]] + 1)]
                a = np.flatnonzero(new)
                b = np.r_[a[1:], len(hit)] - 1
                for d, x, y in zip(doc[hit[a]].tolist(), word[hit[a]].tolist(), word[hit[b]].tolist(), strict=True):
                    spans[d].append((x, y + 1))
        return self.n_words, spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def text_spans(raw: bytes, spans: list[tuple[int, int]]) -> list[int]:
    """Starts and ends, in code points and in turn, of the texts that word spans cover."""
    if not spans:
        return []
    at = [(m.start(), m.end()) for m in _WORD_RE.finditer(raw)]
    out, done, points = [], 0, 0
    for a, b in spans:
        for pos in (at[a][0], at[b - 1][1]):
            points += len(raw[done:pos].decode())
            done = pos
            out.append(points)
    return out


def _items(folder: str) -> Iterator[tuple[str | None, bytes]]:
    """The written benchmark's items, in the order of their files."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    store, path = opened(folder)
    for file in sorted(f.path for f in store.get_file_info(FileSelector(path)) if f.path.endswith(".parquet")):
        with store.open_input_file(file) as source:
            for batch in pq.ParquetFile(source).iter_batches(1000):
                yield from zip(batch.column(0).to_pylist(), text_slices(batch.column(1)), strict=True)


def _blocks(folder: str, most: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of ``most`` bytes, a longer item alone; one empty block if there are none."""
    block: list[tuple[str | None, bytes]] = []
    size = 0
    for name, raw in _items(folder):
        if block and size + len(raw) > most:
            yield block
            block, size = [], 0
        block.append((name, raw))
        size += len(raw)
    yield block


@lru_cache(1)
def _only_block(folder: str, width: int, most: int) -> Phrases | None:
    """The benchmark's phrases if they make one block: a worker keeps them for its later tasks."""
    blocks = _blocks(folder, most)
    first = next(blocks)
    return Phrases(first, width) if next(blocks, None) is None else None


def phrase_blocks(folder: str, width: int, most: int) -> Iterator[Phrases]:
    only = _only_block(folder, width, most)
    if only is not None:
        yield only
    else:
        yield from (Phrases(block, width) for block in _blocks(folder, most))


def shard_hits(phrases: Phrases, batches: list[list[bytes]]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text: its number of words, the spans hit, the items that occur."""
    shard = Shard(phrases)
    for texts in batches:
        shard.add(texts)
        if shard.kept >= SHARD_WORDS:
            yield from zip(*shard.hits(), strict=True)
            shard = Shard(phrases)
    yield from zip(*shard.hits(), strict=True)


RESULT = "n_words long, n_hit long, n_items long, items array<string>, contaminated boolean, spans array<bigint>"


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str | None = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW
) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items, contaminated, and spans: starts and ends in
    code points, in turn, of the merged text to remove."""
    narrow, texts_of = text_input(docs, key, text)
    folder, most = scratch_path(docs.sparkSession, "benchmark"), BLOCK_BYTES
    benchmark.select(column(item).cast("string").alias("item"), F.coalesce(column(item_text), F.lit("")).alias("text")).write.parquet(folder)
    schema = keyed_schema(narrow, RESULT)

    def results(keys: pa.Array, texts: list[bytes], found: list[tuple]) -> pa.RecordBatch:
        counts, spans, items = zip(*found, strict=True) if found else ((), (), ())
        hit = [sum(b - a for a, b in s) for s in spans]
        return pa.RecordBatch.from_arrays(
            [
                keys,
                pa.array(counts, pa.int64()),
                pa.array(hit, pa.int64()),
                pa.array([len(i) for i in items], pa.int64()),
                pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                pa.array([h > 0 and SHARE * h >= n for h, n in zip(hit, counts, strict=True)], pa.bool_()),
                pa.array([text_spans(t, s) for t, s in zip(texts, spans, strict=True)], pa.list_(pa.int64())),
            ],
            names=schema.names,
        )

    def flush(held: list[tuple[pa.Array, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for phrases in phrase_blocks(folder, width, most):
            more = list(shard_hits(phrases, [texts for _, texts in held]))
            found = [(n, merged([*a, *b]), i | j) for (n, a, i), (_, b, j) in zip(found, more, strict=True)] if found else more
        at = 0
        for keys, texts in held:
            yield results(keys, texts, found[at : at + len(texts)])
            at += len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            texts = list(text_slices(texts_of(batch)))
            held.append((batch.column(0), texts))
            size += sum(map(len, texts))
            if size >= SHARD_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return narrow.mapInArrow(run, schema)


def contamination_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = contamination(docs, benchmark)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_hit", "n_items", digest, "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that the benchmark does not contaminate, whole."""
    kept = contamination(whole_rows(docs), benchmark, key="row", text=None).filter(~F.col("contaminated"))
    return kept.select(*unpacked(kept, docs, "key"))


#: DuckDB SQL for contamination_table over documents and benchmark.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[p : p + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)
), dp AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d
), dw AS (
  SELECT doc_id, p, m, array_to_string(w[p : p + m - 1], ' ') AS win
  FROM dp, (SELECT DISTINCT m FROM bw) WHERE p + m - 1 <= len(w)
), hits AS (
  SELECT dw.doc_id, dw.p, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win
), n_hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n_hit n USING (doc_id) LEFT JOIN items i USING (doc_id)
"""
