"""Document fingerprints from improbable features in chained Bloom filters.

Every 64-byte window of a text is ranked by how rare its entropy is in the whole corpus (the rarer, the
better; windows of almost no entropy never count). A window is a feature if it is the best of many of
the 64 windows-wide neighbourhoods it stands in; besides, the same number of eight-byte windows of every
text are, those of the rarest entropies, and of one entropy those with the smallest hashes. Of a long text
they are few among many, of a short one, which holds few long windows, they are most. Features are hashed into a chain of Bloom filters, a
new one each time one is full. The likeness of two chains is the mean over the filters of the shorter
one of the best normalised overlap of set bits with a filter of the other: 0 for what chance explains,
1 for equal sets.

Defined results: null text counts as empty; a text without a window that counts (of less than eight bytes,
or of one byte over and over) is one feature as a whole; the empty text has no feature and is like itself
only; texts are read whole, in pieces; equal texts have equal fingerprints; of rows with
equal ids the one whose text has the smaller hash comes first; a null id comes before all others; ids that
are not whole numbers are ordered as text, and all keep their type; a single row is its own next document;
an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from trackmill.llm.common import column, keyed_schema, materialize, text_buffer, text_input

WINDOW = 64
#: Entropy levels: bits per byte of a window, of at most log2(64), in thousandths of that.
LEVELS = 1000
#: Windows below this level are never features.
LEAST_LEVEL = 100
#: Of its shorter windows so many are features of every text, if it has as many that differ.
SHORT_WINDOW, SHORT_FEATURES = 8, 32
#: Neighbourhoods in which a window must be the best.
POPULAR = 16
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
#: Texts are processed together up to so many bytes.
GROUP_BYTES = 1 << 20
#: The rank of what is no feature; all others are below.
NO_RANK = 1 << 20

_COUNT_LOG = np.zeros(WINDOW + 1, np.int64)
_COUNT_LOG[1:] = np.round(np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1)) * (1 << 16))


def entropy_levels(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The entropy level of the window that starts at each byte, as far as windows fit.

    The sum of c log c over a window's byte counts changes only by the byte that leaves and the one that
    enters, so all windows follow from counts of equal bytes within reach, without a loop over them.
    """
    n = len(data)
    if n < window:
        return np.zeros(0, np.int16)
    ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for k in range(1, window):
        same = (data[k:] == data[:-k]).view(np.uint8)
        ahead[:-k] += same
        behind[k:] += same
    first = _COUNT_LOG[np.bincount(data[:window], minlength=256)].sum()
    leave = (_COUNT_LOG - np.r_[0, _COUNT_LOG[:-1]])[ahead[: n - window]]
    enter = (_COUNT_LOG - np.r_[0, _COUNT_LOG[:-1]])[behind[window:]]
    # the entering byte's count is taken with the leaving byte gone: behind reaches window - 1 back
    total = np.empty(n - window + 1, np.int64)
    total[0] = first
    np.cumsum(enter - leave, out=total[1:])
    total[1:] += first
    full = int(_COUNT_LOG[window])
    return ((full - total) * LEVELS // full).astype(np.int16)


def survey(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int, int]:
    """How often each entropy level occurs among all long and all short windows of all texts, as two rows,
    and the texts' number and bytes."""
    size = 2 * (LEVELS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(0))
            total[size:] += batch.num_rows, offsets[-1] - offsets[0]
            for a, b in _pieces(offsets):
                data = np.frombuffer(raw, np.uint8)[offsets[a] : offsets[b]]
                for i, window in enumerate((WINDOW, SHORT_WINDOW)):
                    level = entropy_levels(data, window)
                    own = level[_inside(offsets[a : b + 1] - offsets[a], window)[: len(level)]]
                    total[i * (LEVELS + 1) : (i + 1) * (LEVELS + 1)] += np.bincount(own, minlength=LEVELS + 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["level", "n"])

    counts = docs.select(column(text).alias("text")).mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n"))
    out = np.zeros(size + 2, np.int64)
    for level, n in counts.collect():  # at most size + 2 rows
        out[level] = n
    return out[:size].reshape(2, -1), int(out[size]), int(out[size + 1])


def histogram(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each entropy level occurs among all long and all short windows of all texts, as two rows."""
    return survey(docs, text)[0]


def ranks(counts: np.ndarray) -> np.ndarray:
    """The place of each level among the levels from rare to common, for long and for short windows."""
    out = np.empty((2, LEVELS + 1), np.int64)
    for row, n in zip(out, counts, strict=True):
        row[np.lexsort((np.arange(LEVELS + 1), n))] = np.arange(LEVELS + 1)
    out[:, :LEAST_LEVEL] = NO_RANK
    return out


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about GROUP_BYTES together."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, "right")) - 1)
        yield at, min(to, n)
        at = to


def _inside(bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether a whole window of one text starts at each byte; bounds: the texts' n + 1 offsets."""
    size = np.diff(bounds)
    edge = np.zeros(int(bounds[-1]) + 1, np.int32)
    np.add.at(edge, bounds[:-1][size >= window], 1)
    np.add.at(edge, bounds[1:][size >= window] - window + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _short_features(data: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The hashes of one text's rarest short windows, of SHORT_FEATURES that differ if it has as many."""
    rank = rank[entropy_levels(data, SHORT_WINDOW)].astype(np.int32)
    places = np.flatnonzero(rank < NO_RANK)
    rank = rank[places]
    views = np.lib.stride_tricks.sliding_window_view(data, SHORT_WINDOW) if len(places) else None
    wanted = 4 * SHORT_FEATURES
    while len(places):
        # windows up to the rank that so many have; only they are hashed
        most = np.partition(rank, wanted - 1)[wanted - 1] if wanted < len(rank) else NO_RANK
        near = rank <= most
        hashes = _mixed(np.ascontiguousarray(views[places[near]]).view(np.uint64))
        hashes, first = np.unique(hashes, return_index=True)
        if len(hashes) >= SHORT_FEATURES or near.all():
            return hashes[np.lexsort((hashes, rank[near][first]))[:SHORT_FEATURES]]
        wanted *= 4
    return np.zeros(0, np.uint64)


def _mixed(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of 64-bit words."""
    h = np.full(len(rows), 0x243F6A8885A308D3, np.uint64)
    for j in range(rows.shape[1]):
        h = (h ^ rows[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Digester:
    """Fingerprints of texts for the level ranks of long and short windows."""

    def __init__(self, rank: np.ndarray):
        self.rank = rank

    def features(self, raw: bytes, offsets: np.ndarray) -> list[np.ndarray]:
        """The hashes of each text's features: long windows in the order in which they first stand there, then
        short ones from rare to common."""
        out: list[np.ndarray] = []
        for a, b in _pieces(offsets):
            out += self._piece(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        return out

    def _piece(self, raw: bytes, bounds: np.ndarray) -> list[np.ndarray]:
        data, n_texts = np.frombuffer(raw, np.uint8), len(bounds) - 1
        size = np.diff(bounds)
        place, hashes, text = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        level = entropy_levels(data)
        n = len(level)
        inside = _inside(bounds)[:n]
        if inside.any():
            best = np.where(inside, self.rank[0][level], NO_RANK) << 32 | np.arange(n)
            # the leftmost best of the next WINDOW windows; other texts' windows lie WINDOW - 1 bytes off
            best = np.r_[best, np.full(WINDOW - 1, NO_RANK << 32)]
            for k in (1, 2, 4, 8, 16, 32):
                best = np.minimum(best[:-k], best[k:])
            chosen = best[inside] & 0xFFFFFFFF
            starts = np.flatnonzero(inside)
            # a neighbourhood reaches at most the first window of the next text: not its own
            text_of = np.searchsorted(bounds, starts, "right") - 1
            own = (chosen < bounds[text_of + 1]) & (best[inside] >> 32 < NO_RANK)
            votes = np.bincount(chosen[own], minlength=n)
            place = np.flatnonzero(votes >= POPULAR)
            text = np.searchsorted(bounds, place, "right") - 1
            windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[place]
            hashes = _mixed(np.ascontiguousarray(windows).view(np.uint64))
        rare = [_short_features(data[a:b], self.rank[1]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        text = np.r_[text, np.repeat(np.arange(n_texts), [len(h) for h in rare])]
        hashes = np.concatenate([hashes, *rare])
        short = np.flatnonzero((size > 0) & (np.bincount(text, minlength=n_texts) == 0))
        whole = [int.from_bytes(hashlib.sha1(raw[bounds[i] : bounds[i + 1]]).digest()[:8], "little") for i in short.tolist()]
        text, hashes = np.r_[text, short], np.r_[hashes, np.array(whole, np.uint64)]
        order = np.argsort(text, kind="stable")
        cut = np.searchsorted(text[order], np.arange(n_texts + 1))
        hashes = hashes[order]
        return [_distinct(hashes[cut[i] : cut[i + 1]]) for i in range(n_texts)]

    def digests(self, raw: bytes, offsets: np.ndarray) -> list[np.ndarray]:
        """Each text's chain: one row of packed bits per filter, at least one."""
        return [chain(h) for h in self.features(raw, offsets)]


def _distinct(hashes: np.ndarray) -> np.ndarray:
    if len(hashes) < 2:
        return hashes
    _, first = np.unique(hashes, return_index=True)
    return hashes[np.sort(first)]


def chain(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros((max(1, -(-len(hashes) // FILTER_FEATURES)), FILTER_BITS), bool)
    which = np.arange(len(hashes)) // FILTER_FEATURES
    for k in range(HASHES):
        bits[which, (hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)] = True
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The mean over the shorter chain's filters of the best normalised overlap with the other's."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b) or len(a) == len(b) and a.tobytes() > b.tobytes():
        a, b = b, a
    x, y = a.view(np.uint64), b.view(np.uint64)
    ones = lambda m: np.bitwise_count(m).sum(axis=-1, dtype=np.int64)
    nx, ny = ones(x), ones(y)
    if not nx.any() or not ny.any():
        return 0.0
    total = 0.0
    for row, n in zip(x, nx, strict=True):
        best = 0.0
        for at in range(0, len(y), 4096):
            both = ones(row & y[at : at + 4096])
            least = np.minimum(n, ny[at : at + 4096])
            chance = n * ny[at : at + 4096] / FILTER_BITS
            score = np.where(least > chance, (both - chance) / np.maximum(least - chance, 1e-9), 0.0)
            best = max(best, float(score.max()))
        total += min(1.0, max(0.0, best))
    return total / len(x)


def as_text(digest: np.ndarray) -> str:
    return base64.b64encode(digest.tobytes()).decode()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every document, ranked by the corpus' own entropy histogram."""
    rank = ranks(histogram(docs, text))
    narrow, texts_of = text_input(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digester = Digester(rank)
        for batch in batches:
            found = [as_text(d) for d in digester.digests(*text_buffer(texts_of(batch)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["key", "fingerprint"])

    return narrow.mapInArrow(run, keyed_schema(narrow, "fingerprint string"))


# --- each text beside its edited form and its successor ------------------------------------------

#: Buckets of consecutive rows hold about so many bytes of text, unless there would be too many of them:
#: a task streams through its bucket, whatever its size.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 20_000
#: Rows from which a bucket's bounds are chosen, per bucket.
SAMPLE_PER_BUCKET = 32
#: Rows with one id and one text are many, and worked out once, from so many on; at most so many such groups.
HOT_ROWS, HOT_MOST = 10_000, 100_000
OUT_ROWS = 20_000


class Cuts:
    """Bounds of buckets in the order of rows: null ids first, then by id, then by the text's hash."""

    def __init__(self, cuts: list[tuple]):
        """cuts: the smallest (id, hash) of each bucket but the first, ascending."""
        self.null_hash = np.array([h for k, h in cuts if k is None], np.int64)
        held = [c for c in cuts if c[0] is not None]
        self.key = np.array([k for k, _ in held], object if held and isinstance(held[0][0], str) else np.int64)
        self.hash = np.array([h for _, h in held], np.int64)

    def bucket(self, k: pa.Array, h: np.ndarray) -> np.ndarray:
        """The number of bounds that are not above each row."""
        null, v = _values(k)
        if not len(self.key):
            out = np.full(len(h), len(self.null_hash))
        else:
            low, high = np.searchsorted(self.key, v, "left"), np.searchsorted(self.key, v, "right")
            out = len(self.null_hash) + low
            for a in np.unique(low[(high > low) & ~null]).tolist():  # ids that a bound has
                own = (low == a) & (high > a)
                out[own] += np.searchsorted(self.hash[a : high[own][0]], h[own], "right")
        out[null] = np.searchsorted(self.null_hash, h[null], "right")
        return out


def _values(k: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each id is null, and the ids as a numpy array without nulls."""
    null = k.is_null().to_numpy(zero_copy_only=False)
    return null, k.fill_null("" if pa.types.is_string(k.type) or pa.types.is_large_string(k.type) else 0).to_numpy(zero_copy_only=False)


def bucket_cuts(keys: DataFrame, n: int, buckets: int) -> list[tuple]:
    """Bounds of about equal buckets, from the rows (k, h) whose hashes a divisor keeps."""
    step = max(1, n // (buckets * SAMPLE_PER_BUCKET))
    kept = keys.filter(F.pmod(F.xxhash64("h", "k", F.lit(7)), F.lit(step)) == 0).collect()
    found = sorted(((r.k, r.h) for r in kept), key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1]))
    cuts = [found[len(found) * i // buckets] for i in range(1, buckets)] if found else []
    return [c for i, c in enumerate(cuts) if not i or c != cuts[i - 1]]


def edited(raw: bytes, following: bytes, n_chars: int) -> bytes:
    """The text with its last quarter replaced by as much of the start of the following one."""
    quarter = n_chars // 4
    if not quarter:
        return raw
    if raw.isascii():
        kept = raw[: len(raw) - quarter]
    else:
        kept = raw.decode()[: n_chars - quarter].encode()
    # so many code points need at most four times as many bytes
    taken = following[: 4 * quarter + 4].decode("utf-8", "ignore")[:quarter].encode()
    return kept + taken


RESULT = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rank: np.ndarray):
    """Rows (extra, doc_id, copies, text) of one bucket in order, at last the first of the next bucket:
    each row with its successor, and its further copies with itself."""

    def group(digester: Digester, rows: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        pairs = [(i, i + 1, 1) for i in range(len(rows) - 1)]
        pairs += [(i, i, r[2] - 1) for i, r in enumerate(rows[:-1]) if r[2] > 1]
        texts = [r[3] for r in rows]
        points = [len(t) if t.isascii() else len(t.decode()) for t in texts]
        changed = [edited(texts[i], texts[j], points[i]) for i, j, _ in pairs]
        both = texts + changed
        found = digester.digests(b"".join(both), np.cumsum([0, *map(len, both)]))
        own, new = found[: len(texts)], found[len(texts) :]
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][1] for i, _, _ in pairs], kind),
                pa.array([points[i] for i, _, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
                pa.array([as_text(own[i]) for i, _, _ in pairs], pa.string()),
                pa.array([as_text(d) for d in new], pa.string()),
                pa.array([likeness(own[i], d) for (i, _, _), d in zip(pairs, new, strict=True)], pa.float64()),
                pa.array([likeness(own[i], own[j]) for i, j, _ in pairs], pa.float64()),
            ],
            names=[c.split()[0] for c in RESULT.split(", ")],
        )
        once = sum(times == 1 for *_, times in pairs)
        if once == len(pairs):
            yield batch
            return
        yield batch.slice(0, len(rows) - 1)
        for at in range(len(rows) - 1, len(pairs)):
            for done in range(0, pairs[at][2], OUT_ROWS):
                yield batch.take(pa.array([at] * min(OUT_ROWS, pairs[at][2] - done)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digester = Digester(rank)
        rows: list[tuple] = []
        size, ended, kind = 0, False, None
        for batch in batches:
            if ended:
                continue  # other rows that equal the first one of the next bucket
            raw, offsets = text_buffer(batch.column(3))
            edges, kind = offsets.tolist(), batch.column(1).type
            for i, (extra, key, copies) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)):
                if ended:
                    break
                text = raw[edges[i] : edges[i + 1]]
                rows.append((extra, key, copies, text))
                size, ended = size + len(text), extra
                if size > 4 * GROUP_BYTES and len(rows) > 1:
                    yield from group(digester, rows, kind)
                    rows, size = rows[-1:], len(text)
        if rows and not ended:
            raise ValueError("a document's successor is missing from its bucket")
        if len(rows) > 1:
            yield from group(digester, rows, kind)

    return run


def digest_table(docs: DataFrame, rows: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows are dealt to buckets of consecutive ids (``rows`` of them, by default by bytes), one task each,
    the first row of each bucket also to the bucket before, so every document meets its successor in one
    shuffle of the texts. The bounds come from (id, hash of the text), so rows of one id are split too;
    copies with one id and one text beyond ``HOT_ROWS`` travel once, with their number.
    """
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    text = F.coalesce(F.col("text"), F.lit(""))
    counts, n, size = survey(docs)
    all_ = docs.select(F.col("doc_id").cast("long" if whole else "string").alias("k"), F.xxhash64(text).alias("h"), "doc_id", F.lit(1).cast("long").alias("copies"), text.alias("text"))
    keys = materialize(all_.select("k", "h"), "keys")
    hot = keys.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(HOT_ROWS, n // HOT_MOST))
    hot = materialize(hot.select(F.col("k").alias("hot_k"), F.col("h").alias("hot_h"), "n"), "hot")
    if not hot.isEmpty():
        same = F.col("k").eqNullSafe(F.col("hot_k")) & (F.col("h") == F.col("hot_h"))
        few = F.broadcast(hot)  # at most HOT_MOST rows
        one = all_.join(few, same).dropDuplicates(["k", "h"]).withColumn("copies", F.col("n"))
        all_ = all_.join(few, same, "left_anti").unionByName(one.select(*all_.columns))
        keys = keys.join(few, same, "left_anti").unionByName(hot.select(F.col("hot_k").alias("k"), F.col("hot_h").alias("h")))
    buckets = -(-n // rows) if rows else min(-(-size // BUCKET_BYTES), MOST_BUCKETS)
    cuts = Cuts(bucket_cuts(keys, n, max(1, buckets)))

    @F.arrow_udf("int")
    def bucket(k: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(cuts.bucket(k, h.to_numpy()), pa.int32())

    firsts = keys.select(bucket("k", "h").alias("bucket"), F.struct("k", "h").alias("first")).groupBy("bucket").agg(F.min("first").alias("first")).collect()
    firsts = {r["bucket"]: tuple(r["first"]) for r in firsts}  # a row for each bucket
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    parts = order[-1] + 1 if order else 1
    places = _places(cuts, firsts, before)
    dealt = all_.select(F.explode(places("k", "h")).alias("p"), "*").select("p.bucket", "p.extra", "k", "h", "doc_id", "copies", "text")
    dealt = dealt.repartitionById(parts, "bucket").sortWithinPartitions("extra", "k", "h", "text").select("extra", "doc_id", "copies", "text")
    return dealt.mapInArrow(_compare(ranks(counts)), keyed_schema(dealt.select("doc_id"), RESULT.partition(", ")[2]))


def _places(cuts: Cuts, firsts: dict[int, tuple], before: dict[int, int]):
    """A row's bucket and, if it is the first of that, also the bucket before."""
    most = max(firsts, default=0) + 1
    hash_, back = np.zeros(most, np.int64), np.zeros(most, np.int64)
    null = np.zeros(most, bool)
    key = [None] * most
    for b, (k, h) in firsts.items():
        hash_[b], back[b], null[b], key[b] = h, before[b], k is None, k
    key = np.array(key, object)

    @F.arrow_udf("array<struct<bucket: int, extra: boolean>>")
    def places(k: pa.Array, h: pa.Array) -> pa.Array:
        h = h.to_numpy()
        bucket = cuts.bucket(k, h)
        none, v = _values(k)
        first = (hash_[bucket] == h) & (null[bucket] == none)
        maybe = np.flatnonzero(first & ~none)
        first[maybe] = key[bucket[maybe]] == v[maybe].astype(object)
        at = np.cumsum(np.r_[0, 1 + first])
        where = np.repeat(bucket, 1 + first)
        extra = np.zeros(len(where), bool)
        extra[at[1:][first] - 1] = True
        where[extra] = back[where[extra]]
        inner = pa.StructArray.from_arrays([pa.array(where, pa.int32()), pa.array(extra)], names=["bucket", "extra"])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), inner)

    return places
