"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 32 bytes cuts a text into chunks, so a passage shared by documents gives
the same chunks wherever it stands. A chunk is encoded once per task and kept, within ``CACHE_BYTES``,
for all documents that share it. Tokens can cross a cut, so every join of two chunks is repaired: a
window around the cut is encoded anew, from a place in the left chunk to one in the right, and is
spliced in where its first and last tokens are those of the chunks. Windows begin and end where the
pre-tokenizer always breaks, before white space that follows another sign; one that finds no such place
in a chunk grows over it into the next, and a text in which a window does not agree is encoded whole.
The ids are exactly those of the whole text.

The library that the file belongs to encodes slowly, so texts of common scripts go to an encoder by
merge ranks once it is proved equal at start-up: every merge must make the next id, so the order of
merges is the order of ids, and probes of every code point below ``PROVED`` must give the library's
ids. Where the proof fails, and for later code points and special tokens, the library encodes.

Defined results: null text counts as empty and has no ids; a text of any length is one row, its chunks
are encoded one by one, and one without white space as a whole; repeated rows give repeated results; an
empty table gives an empty one; ids keep their type, and other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import hashlib
import os
import json
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackmill.llm.common import keyed_schema, text_buffer, text_input

#: The low bits of the rolling hash that are zero at a cut: one byte in 256 on average.
CUT_BITS = 8
CACHE_BYTES = 48 << 20
#: Texts are encoded in slices of so many bytes, since chunks, ids and windows of a slice take many times as much; a
#: longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Code points below this are probed; in UTF-8 all bytes of their texts are below PROVED_BYTE.
PROVED, PROVED_BYTE = 0x3000, 0xE3
#: Fixed value: the published pre-tokenizer pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 characters
    stand for themselves, all other bytes for the code points from 256 on, in order."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _gear() -> np.ndarray:
    """A 32-bit random number for each byte value."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))).astype(np.uint32)


GEAR = _gear()


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of its window's numbers, each shifted by its distance: 32 bytes back."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending positions that part all texts into chunks: their own bounds, and the first code point
    at or after each cut of the rolling hash."""
    n = int(offsets[-1])
    if not n:
        return np.zeros(1, np.int64)
    cuts = np.flatnonzero((rolling_hash(data) >> np.uint32(32 - CUT_BITS)) == 0) + 1
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    starts = np.append(starts, n)
    return np.union1d(starts[np.searchsorted(starts, cuts)], offsets)


def breaks(data: np.ndarray) -> np.ndarray:
    """Positions before which the pre-tokenizer always breaks: ASCII white space after another sign.

    The sign is one of ASCII, or has a first byte that no white space in Unicode has."""
    n = len(data)
    if n < 2:
        return np.zeros(0, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    last = data[at - 1]
    lead = lambda k: np.where(at >= k, data[np.maximum(at - k, 0)], 0)
    two, three, four = lead(2), lead(3), lead(4)
    sure = (last > 32) & (last < 127) | (last >= 128) & (last < 192) & (
        (two >= 0xC3) & (two <= 0xDF) | (two < 192) & (two >= 128) & ((three >= 0xE4) & (three <= 0xED) | (three < 192) & (three >= 128) & (four >= 0xF0))
    )
    return at[sure]


class Chunk:
    """A chunk's own encoding between its first and its last break, and the text that a repair needs.

    ``head`` reaches to the second break, ``tail`` from the last but one; ``first`` and ``last`` are the
    ids between those breaks, on which a window must agree."""

    __slots__ = ("head", "first", "ids", "back", "tail", "last")

    def __init__(self, raw: bytes, ids: list[int], at: tuple[int, int, int, int], codec: ChunkCodec):
        a, b, c, d = at  # the first two breaks and the last two: all are ends of tokens
        sizes, n = codec.sizes, len(ids)
        end = i = 0
        while end < a:
            end += sizes[ids[i]]
            i += 1
        j = i
        while end < b:
            end += sizes[ids[j]]
            j += 1
        end, m = len(raw), n
        while end > d:
            m -= 1
            end -= sizes[ids[m]]
        k = m
        while end > c:
            k -= 1
            end -= sizes[ids[k]]
        self.head, self.tail = raw[:b], raw[c:]
        self.first, self.last = tuple(ids[i:j]), tuple(ids[k:m])
        self.ids, self.back = codec.result(ids[i:m])


@lru_cache(2)
def codec(path: str) -> ChunkCodec:
    """A worker's codec, kept for its later tasks."""
    return ChunkCodec(path)


class ChunkCodec:
    """Encodes and decodes texts with a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters = byte_letters()
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = list(added.values())
        size = self.tokenizer.get_vocab_size(True)
        self.pieces = [added.get(i) or bytes(letters[c] for c in self.tokenizer.id_to_token(i)) for i in range(size)]
        self.sizes = list(map(len, self.pieces))
        self.ranked = self._ranked(path)
        self.chunks: dict[bytes, Chunk | None] = {}
        self.windows: dict[tuple, tuple[bytes, bytes] | None] = {}
        self.held = 0
        #: What became of chunks and joins so far.
        self.counts = {"chunks": 0, "encoded": 0, "joins": 0, "repaired": 0, "whole": 0}

    def _ranked(self, path: str):
        """An encoder by merge ranks that is proved equal for code points below PROVED, or None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        first = len(vocab) - len(merges)
        if any(vocab.get("".join(m)) != first + i for i, m in enumerate(merges)):
            return None
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        probes = [f"a{c} {c}1{c}.{c}{c} \n{c}\n " for c in map(chr, range(PROVED))]
        for probe, whole in zip(probes, self.tokenizer.encode_batch_fast(probes, add_special_tokens=False), strict=True):
            if ranked.encode_ordinary(probe) != whole.ids:
                return None
        return ranked.encode_ordinary

    def encode_batch(self, raw: bytes, offsets: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids as little-endian uint32 and its decoded bytes."""
        offsets = offsets.astype(np.int64)
        start, n = 0, len(offsets) - 1
        while start < n:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, "right")) - 1)
            yield from self._encode_slice(raw, offsets[start : end + 1])
            start = end

    def forget(self) -> None:
        """Drop what is kept of chunks and windows."""
        self.chunks, self.windows, self.held = {}, {}, 0

    def _encode_slice(self, raw: bytes, offsets: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        base = int(offsets[0])
        raw, offsets = raw[base : int(offsets[-1])], offsets - base
        data = np.frombuffer(raw, np.uint8)
        bounds = chunk_bounds(data, offsets)
        edges = bounds.tolist()
        pieces = [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        if self.held > CACHE_BYTES:
            self.forget()
        self._learn_chunks(pieces, bounds, breaks(data))
        at = np.searchsorted(bounds, offsets).tolist()
        plans = [self._plan(pieces[a:b]) for a, b in zip(at, at[1:], strict=False)]
        self._learn_windows({w for plan in plans for w in plan if type(w) is tuple})
        for plan, start, end in zip(plans, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield self._joined(plan, raw[start:end])

    def _learn_chunks(self, pieces: list[bytes], bounds: np.ndarray, safe: np.ndarray) -> None:
        low, high = np.searchsorted(safe, bounds[:-1], "right"), np.searchsorted(safe, bounds[1:], "left")
        own = np.flatnonzero(high - low >= 4)
        at: list[tuple | None] = [None] * len(pieces)
        if len(own):
            four = np.stack([safe[low[own]], safe[low[own] + 1], safe[high[own] - 2], safe[high[own] - 1]], axis=1) - bounds[own][:, None]
            for i, x in zip(own.tolist(), map(tuple, four.tolist()), strict=True):
                at[i] = x
        self.counts["chunks"] += len(pieces)
        known = self.chunks
        new = {p: x for p, x in zip(pieces, at, strict=True) if p not in known}
        closed = [p for p, x in new.items() if x]
        self.counts["encoded"] += len(closed)
        for piece, ids in zip(closed, self._encode(closed), strict=True):
            known[piece] = Chunk(piece, ids, new[piece], self)
            self.held += 7 * len(piece) + 600
        for piece in new:
            known.setdefault(piece, None)  # too few breaks: a window will grow over it
            self.held += len(piece) + 100

    def _plan(self, pieces: list[bytes]) -> list:
        """A text as chunks and, between them, windows: (text, ids to agree on at its start, at its end)."""
        plan: list = []
        open_, agreed = [], ()
        for piece in pieces:
            chunk = self.chunks[piece]
            if chunk is None:
                open_.append(piece)
                continue
            plan += [(b"".join([*open_, chunk.head]), agreed, chunk.first), chunk]
            open_, agreed = [chunk.tail], chunk.last
        if open_:
            plan.append((b"".join(open_), agreed, ()))
        return plan

    def _learn_windows(self, windows: set[tuple]) -> None:
        new = [w for w in windows if w not in self.windows]
        for window, ids in zip(new, self._encode([w[0] for w in new]), strict=True):
            _, left, right = window
            a, b = len(left), len(ids) - len(right)
            agrees = a <= b and tuple(ids[:a]) == left and tuple(ids[b:]) == right
            self.windows[window] = self.result(ids[a:b]) if agrees else None
            self.held += 8 * len(window[0]) + 400

    def _joined(self, plan: list, raw: bytes) -> tuple[bytes, bytes]:
        parts = [self.windows[w] if type(w) is tuple else (w.ids, w.back) for w in plan]
        self.counts["joins"] += len(plan) // 2
        if None in parts:
            self.counts["whole"] += 1
            return self.result(self._encode([raw])[0])
        self.counts["repaired"] += len(plan) // 2
        return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def result(self, ids: list[int]) -> tuple[bytes, bytes]:
        """Ids as little-endian uint32, and their decoded bytes."""
        return pack(f"<{len(ids)}I", *ids), b"".join(map(self.pieces.__getitem__, ids))

    def _encode(self, texts: list[bytes]) -> list[list[int]]:
        """The ids of each text, by the ranks where they are proved, else by the library in batches."""
        out: list[list[int] | None] = [None] * len(texts)
        if self.ranked and texts:
            joined = b"".join(texts)
            size = np.array([len(t) for t in texts], np.int64)
            plain = size == 0
            some = np.flatnonzero(size)
            starts = (np.cumsum(size) - size)[some]
            if len(some):
                plain[some] = np.maximum.reduceat(np.frombuffer(joined, np.uint8), starts) < PROVED_BYTE
            for special in self.specials:
                if special in joined:
                    plain &= np.array([special not in t for t in texts])
            for i in np.flatnonzero(plain).tolist():
                out[i] = self.ranked(texts[i].decode())
        rest = [i for i, ids in enumerate(out) if ids is None]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            found = self.tokenizer.encode_batch_fast([texts[i].decode() for i in part], add_special_tokens=False)
            for i, e in zip(part, found, strict=True):
                out[i] = e.ids
        return out


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", outputs: bool = True) -> DataFrame:
    """Per document: key, n_tokens, ids_sha256, decoded_sha256 and, with ``outputs``, ids and decoded."""
    narrow, texts_of = text_input(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids, decoded = [], []
            counts, sums, backs = [], [], []
            for i, d in own.encode_batch(*text_buffer(texts_of(batch))):
                counts.append(len(i) // 4)
                sums.append(hashlib.sha256(i).hexdigest())
                d = d.decode("utf-8", "replace").encode() if not outputs else d.decode("utf-8", "replace")
                backs.append(hashlib.sha256(d.encode() if outputs else d).hexdigest())
                if outputs:
                    ids.append(np.frombuffer(i, "<u4").astype(np.int32))
                    decoded.append(d)
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(backs, pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if outputs:
                arrays += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        own.forget()  # the worker may serve other stages next

    rest = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return narrow.mapInArrow(run, keyed_schema(narrow, rest + (", ids array<int>, decoded string" if outputs else "")))


def codec_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encoded(docs, path, outputs=False).withColumnRenamed("key", "doc_id")
