"""SimHash near-duplicate groups, found with BK-trees over shards of fingerprints.

Two fingerprints within ``RADIUS`` bits agree on at least two of five bit blocks, so every
fingerprint is filed under each of the ten pairs of blocks; a pair's value names a shard. A shard's
fingerprints form a BK-tree (children keyed by their integer Hamming distance to the parent), and a
search follows only the edges whose key is within the radius of the query's distance. Trees are sent
to the tasks that hold their queries instead of to everyone: a tree of all documents has no bound, a
shard has one. A shard over ``SHARD_LIMIT`` fingerprints is filed again under blocks of its
remaining bits, so no task meets an unbounded shard and no pair is lost.

Only links that can still join two groups are followed: a subtree whose members all belong to the
query's group is skipped. Groups are therefore exact, while a dense cluster costs about its size
rather than its square.

Defined results: null text counts as empty; texts without words have fingerprint zero, which links
like any other; repeated rows and equal texts share a fingerprint; a null ``doc_id`` keeps its row
and never names a component; texts are read whole, in pieces; an empty table gives an empty result; ids
keep their type; other columns, whatever their names, are not read, or are handed on unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import keyed_schema, materialize, text_input, text_slices

RADIUS = 3
SHINGLE_WORDS = 3
HASH_SEED = 42
BLOCKS = 5
SHARD_LIMIT = 100_000
#: (query, node) pairs held by a search at once.
FRONTIER = 4_000_000
#: Rows of whole shards that one forest is built from.
FOREST_ROWS = 500_000


def simhash(raw: bytes) -> int:
    """The 64-bit fingerprint of one text's word shingles."""
    words = raw.lower().split()  # of bytes: A-Z only, and \x20 \x09-\x0D
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 17):
        part = words[at : at + (1 << 17) + SHINGLE_WORDS - 1]
        if len(part) < SHINGLE_WORDS:
            shingles = iter([b" ".join(part)])
        else:
            shingles = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE_WORDS)), strict=False))
        digests = b"".join(map(xxhash.xxh64_digest, shingles, repeat(HASH_SEED)))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str | None = "text") -> DataFrame:
    """One row (key, fp) per document; fp holds the unsigned fingerprint's bits as a long."""
    narrow, texts_of = text_input(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(map(simhash, text_slices(texts_of(batch))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    return narrow.mapInArrow(run, keyed_schema(narrow, "fp long"))


def _spans(bits: int, parts: int) -> list[tuple[int, int]]:
    """Start and width of each of ``parts`` nearly equal blocks of ``bits`` bits."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _shards(radius: int) -> list[int]:
    """Masks of the bits that name a shard: all choices of BLOCKS - radius blocks."""
    spans = _spans(64, max(BLOCKS, radius + 1))
    masks = [((1 << w) - 1) << a for a, w in spans]
    return [sum(chosen) for chosen in combinations(masks, len(spans) - radius)]


def _split(mask: int, radius: int) -> list[int]:
    """``mask`` widened by each of radius + 1 blocks of its other bits; one of them holds any pair."""
    rest = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in rest[a : a + w]) for a, w in _spans(len(rest), radius + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _filed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, shard, fp) for each of the masks."""
    pairs = [F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("shard")) for m in masks]
    return fps.select(F.explode(F.array(*pairs)).alias("s"), "fp").select("s.mask", "s.shard", "fp")


def shard_entries(fps: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT) -> DataFrame:
    """All distinct fingerprints filed under their shards, none with more than ``limit`` rows unless
    its free bits alone keep it small."""
    entries, masks = _filed(fps, _shards(radius)), _shards(radius)
    settled = None
    while 64 - bin(masks[0]).count("1") > 17:
        hot = entries.groupBy("mask", "shard").count().filter(F.col("count") > limit).select("mask", "shard")
        hot = materialize(hot, "hot-shards")
        if hot.isEmpty():
            break
        cold = entries.join(hot, ["mask", "shard"], "left_anti")
        settled = cold if settled is None else settled.unionByName(cold)
        refined = [
            _filed(entries.join(hot, ["mask", "shard"], "left_semi").filter(F.col("mask") == _signed(m)).select("fp"), _split(m, radius))
            for m in masks
        ]
        masks = [x for m in masks for x in _split(m, radius)]
        entries = refined[0]
        for more in refined[1:]:
            entries = entries.unionByName(more)
        entries = materialize(entries.distinct(), "shards")
    return entries if settled is None else settled.unionByName(entries)


def components(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The smallest member of each node's component, for the links a-b over 0..n-1."""
    lab = np.arange(n) if start is None else start.copy()
    while len(a):
        x, y = lab[a], lab[b]
        live = x != y
        if not live.any():
            break
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(lab, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    return lab


class Forest:
    """BK-trees over the distinct fingerprints of many shards, built and searched level by level."""

    def __init__(self, shard: np.ndarray, fps: np.ndarray):
        """shard: group number of each row, ascending; fps: uint64, distinct within a group."""
        n = len(fps)
        self.fps, self.n = fps, n
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
        self.sizes = np.diff(np.r_[first, n])
        self.root = np.repeat(first, self.sizes)
        self.size = np.repeat(self.sizes, self.sizes)
        self.parent = np.full(n, -1)
        self.gap = np.zeros(n, np.int64)
        self.levels: list[np.ndarray] = []
        cur = self.root.copy()
        active = np.flatnonzero(cur != np.arange(n))
        codes, kids = [], []
        while len(active):
            gap = np.bitwise_count(fps[active] ^ fps[cur[active]]).astype(np.int64)
            code = cur[active] * 65 + gap
            unique, at, back = np.unique(code, return_index=True, return_inverse=True)
            child = active[at]
            self.parent[child], self.gap[child] = unique // 65, unique % 65
            self.levels.append(child)
            codes.append(unique)
            kids.append(child)
            cur[active] = child[back]
            active = active[cur[active] != active]
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        order = np.argsort(code)
        self.code = code[order]
        self.child = np.concatenate(kids)[order] if kids else np.zeros(0, np.int64)
        self.inner = np.zeros(n, bool)
        self.inner[self.parent[self.parent >= 0]] = True

    def groups(self, radius: int) -> np.ndarray:
        """The smallest row number linked with each row, through links within ``radius``."""
        near = np.flatnonzero((self.parent >= 0) & (self.gap <= radius))
        lab = components(self.n, near, self.parent[near])
        queries = np.flatnonzero(self.size > 1)
        work = np.cumsum(self.size[queries])
        at, most = 0, FRONTIER // 64
        while at < len(queries):
            done = work[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(work, done + most, "right")))
            a, b = self._search(queries[at:to], lab, radius)
            lab = components(self.n, a, b, lab)
            at, most = to, min(FRONTIER, most * 4)
        return lab

    def _search(self, query: np.ndarray, lab: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = lab.copy(), lab.copy()
        for child in reversed(self.levels):
            np.minimum.at(low, self.parent[child], low[child])
            np.maximum.at(high, self.parent[child], high[child])
        a, b = [], []
        node = self.root[query]
        while len(query):
            live = (low[node] != high[node]) | (low[node] != lab[query])
            query, node = query[live], node[live]
            gap = np.bitwise_count(self.fps[query] ^ self.fps[node]).astype(np.int64)
            hit = gap <= radius
            a.append(query[hit])
            b.append(node[hit])
            inner = self.inner[node]
            query, node, gap = query[inner], node[inner], gap[inner]
            next_q, next_n = [], []
            for step in range(-radius, radius + 1):
                code = node * 65 + gap + step
                ok = (gap + step > 0) & (gap + step <= 64)
                pos = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
                ok &= self.code[pos] == code
                next_q.append(query[ok])
                next_n.append(self.child[pos[ok]])
            query, node = np.concatenate(next_q), np.concatenate(next_n)
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Sorted (mask, shard, fp) rows in pieces of whole shards."""
    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy() for i in range(3)]))
        rows += batch.num_rows
        if rows >= FOREST_ROWS:
            block = np.concatenate(held, axis=1)
            same = (block[0] == block[0, -1]) & (block[1] == block[1, -1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield block[:, :cut]
            held, rows = [block[:, cut:]], block.shape[1] - cut
    if held:
        yield np.concatenate(held, axis=1)


def shard_links(entries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a > b, that connect every shard's groups of fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mask, shard, fp in _whole_shards(batches):
            new = np.r_[True, (mask[1:] != mask[:-1]) | (shard[1:] != shard[:-1])]
            group = np.cumsum(new) - 1
            alone = np.bincount(group)[group] == 1
            fp = fp[~alone]
            lab = Forest(group[~alone], fp.view(np.uint64)).groups(radius)
            tied = lab != np.arange(len(fp))
            a, b = fp[tied], fp[lab[tied]]
            links = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], names=["a", "b"])

    sorted_entries = entries.repartition("mask", "shard").sortWithinPartitions("mask", "shard")
    return sorted_entries.mapInArrow(run, "a long, b long").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node it reaches.

    Each round gives a node its smallest neighbour as parent and contracts the graph; a round is
    written to the scratch folder, so lost executors cost one round at most.
    """
    links = materialize(links.filter("a <> b").select("a", "b"), "links")
    star = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        parent = materialize(parent.select("node", F.least("node", "low").alias("up")), "parents")
        if star is None:
            star = parent.select("node", F.col("up").alias("root"))
        else:
            step = parent.select(F.col("node").alias("root"), "up")
            star = star.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        of_a = parent.select(F.col("node").alias("a"), F.col("up").alias("x"))
        of_b = parent.select(F.col("node").alias("b"), F.col("up").alias("y"))
        links = links.join(of_a, "a").join(of_b, "b").filter("x <> y")
        links = links.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        links = materialize(links, "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if star is None else star


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row (key, fp, component, root) per document; component is the smallest key reachable, root
    names the group."""
    prints = materialize(fingerprints(docs, key, text), "fingerprints")
    reps = prints.groupBy("fp").agg(F.min("key").alias("rep"))
    star = connected(shard_links(shard_entries(reps.select("fp"), radius), radius))
    star = materialize(star, "groups")
    linked = reps.join(star.withColumnRenamed("node", "fp"), "fp", "left")
    linked = materialize(linked.select("fp", "rep", F.coalesce("root", "fp").alias("root")), "classes")
    # written, so that the join below has plain exchanges on both sides and a huge group can be split
    least = materialize(linked.groupBy("root").agg(F.min("rep").alias("component")), "components")
    named = linked.join(least, "root").select("fp", "component", "root")
    return prints.join(named, "fp").select("key", "fp", "component", "root")


def dedup_table(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = near_duplicates(docs)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("key").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))
