"""Near-duplicate texts: groups of texts that share four fifths of their five-word shingles.

Texts with equal sets of shingles are one text from the start. Candidates come from the BK-trees over
SimHash fingerprints of the same shingles (``simhash_dedup``) and from buckets of MinHash bands, in which
two texts of similarity 0.8 meet with a probability of 0.99. All pairs among the candidates that are alike are
then found by prefix filtering: two such texts share one of their rarest shingles. Texts that only have a common
passage share none, however many they are. What sizes and parities of two sets show to be unlike
(bounds without error) is left out as pairs are made; the others are compared exactly, by the hashes of all their
shingles, so that nothing else is ever linked. Groups are what the links connect.

The texts of a shingle are not compared pair by pair: they are compared with their hub, the text that meets most
others, then those that are not in one group yet with the next six hubs, the next 24 and so on. A bucket
of near copies is done after one round, and every pair of a bucket that can be alike is compared or connected.

Only signatures, candidates' shingles and places are shuffled, no texts: rows are known by their place in a
Parquet table (file and row), and those to go are sent back there in small files that a second scan reads.

Defined results: of a group that row stays whose doc_id is smallest (null last), of several the first by
the text's identity and its place; null texts count as empty; texts without words are one group; of texts
with fewer words than a shingle the whole is one; texts are read whole; an empty table gives an empty one; ids
keep their type, and other columns, whatever their names, are handed on unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.llm.common import keyed_schema, materialize, place_rows, scratch_path, text_slices, unpacked, with_places, write_places
from trackmill.llm.simhash_dedup import connected, shard_entries, shard_links

WORDS, SIMILARITY = 5, 0.8
#: MinHash values of one band, and bands.
BAND, BANDS = 6, 16
#: Bits of a set's parities.
SKETCH = 512
HASH_SEED = 42
#: Words, or shingles, that are worked on at a time.
PART = 1 << 15
_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 63, BAND * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_parts(raw: bytes, words: int = WORDS) -> Iterator[np.ndarray]:
    """64-bit hashes of a text's shingles, repeats included, in parts; none for a text without words."""
    split = raw.lower().split()  # of bytes: A-Z only, and \\x20 \\x09-\\x0D
    if 0 < len(split) < words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(split), HASH_SEED)], np.uint64)
    for at in range(0, len(split) - words + 1, PART):
        part = split[at : at + PART + words - 1]
        digests = b"".join(map(xxhash.xxh64_digest, map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)), repeat(HASH_SEED)))
        yield np.frombuffer(digests, ">u8").astype(np.uint64)


def fingerprint(parts: list[np.ndarray]) -> int:
    """SimHash: a bit is set if it is in over half of the hashes; the signed 64-bit number."""
    counts, n = np.zeros(64, np.int64), 0
    for h in parts:
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts, n = counts + bits.sum(axis=0, dtype=np.uint32), n + len(h)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True) if n else 0


def bands(shingles: np.ndarray) -> list[int]:
    """A hash of each band of MinHash values of a set of shingles."""
    least = np.full(BAND * BANDS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        mixed = shingles[at : at + 4096, None] * _MULTIPLIERS
        mixed ^= mixed >> np.uint64(29)
        least = np.minimum(least, mixed.min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, BAND))]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, fps, rows = [], [], []
        for raw in text_slices(batch.column(3)):
            parts = list(shingle_parts(raw))
            shingles = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
            ids.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            fps.append(fingerprint(parts))
            rows.append(bands(shingles))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary()), pa.array(fps, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["key", "file", "row", "id", "fp", "bands"])


def signatures(placed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, file, row, id (of the set of shingles), fp and bands of every row."""
    narrow = placed.select(F.col(f"data.`{key}`").alias("key"), "file", "row", F.col(f"data.`{text}`").alias("text"))
    return narrow.mapInArrow(_signatures, keyed_schema(narrow, "file string, row long, id binary, fp long, bands array<long>"))


def parities(shingles: np.ndarray) -> np.ndarray:
    """Of each of SKETCH sorts of hashes, whether a set has an odd number: a bit each, in 64-bit numbers."""
    odd = np.bincount((shingles >> np.uint64(32)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _meeting(texts: DataFrame) -> DataFrame:
    """(id) of the texts that meet another in a band's bucket; the fingerprint is a band too."""
    names = F.posexplode(F.concat("bands", F.array("fp"))).alias("band", "hash")
    entries = texts.select("id", names)
    sizes = entries.groupBy("band", "hash").agg(F.count("*").alias("n")).filter("n > 1")
    return entries.join(materialize(sizes, "sizes"), ["band", "hash"]).select("id")


def _buckets(sets: DataFrame, similarity: float) -> DataFrame:
    """(bucket, id, size, odd, lead, place): the texts that share one of their rarest shingles.

    Shingles are ordered by the number of texts that have them. Of two texts of that similarity the smaller
    has a common shingle before its last 2s / (1 + s), the larger the same one before its last s: ``lead`` tells
    if the shingle is among the former. What very many texts share comes last and makes no bucket. Shingles of
    the same texts are one bucket. Places go by lead and by the texts that each meets, most first.
    """
    each = sets.select("id", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("texts")).filter("texts > 1")
    # from the end, so that shingles of one text alone, which come first, need not be counted
    back = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("texts"), F.desc("shingle")))
    within = lambda share: F.col("back") >= F.col("size") * share - 1e-6
    meet = each.join(often, "shingle").withColumn("back", back).filter(within(similarity))
    meet = materialize(meet.select("shingle", "id", "size", within(2 * similarity / (1 + similarity)).alias("lead")), "rare")
    mix = [F.bit_xor(F.xxhash64(F.lit(seed), "id", "lead")) for seed in (1, 2)]
    named = meet.groupBy("shingle").agg(F.count("*").alias("n"), F.max("lead").alias("led"), F.struct(*mix).alias("bucket")).filter("n > 1 AND led")
    entries = meet.join(materialize(named.select("shingle", "bucket", "n"), "names"), "shingle").select("bucket", "n", "id", "size", "lead").distinct()
    entries = materialize(entries, "entries")
    degree = entries.groupBy("id").agg(F.sum("n").alias("degree"))
    order = Window.partitionBy("bucket").orderBy(F.desc("lead"), F.desc("degree"), "id")
    return entries.join(degree, "id").join(sets.select("id", "odd"), "id").select("bucket", "id", "size", "odd", "lead", F.row_number().over(order).alias("place"))


def _shingles(wanted: str):
    """(id, shingles, odd) of the rows whose places are listed in a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = place_rows(wanted, "id")
        for batch in batches:
            ids, sets, odd = [], [], []
            found = lookup(batch.column(0), batch.column(1))
            for at, raw in enumerate(text_slices(batch.column(2))):
                if found[at] is not None:
                    parts = list(shingle_parts(raw))
                    ids.append(found[at])
                    unique = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                    sets.append(unique.view(np.int64))
                    odd.append(parities(unique))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (sets, odd)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), *lists], names=["id", "shingles", "odd"])

    return run


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar enough, by all their shingles."""
    left, right = (sets.select(F.col("id").alias(n), F.col("shingles").alias(f"{n}_set")) for n in ("a", "b"))
    both, shared = F.size("a_set") + F.size("b_set"), F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(left, "a").join(right, "b").filter(shared / (both - shared) >= similarity).select("a", "b")


def groups(signed: DataFrame, placed: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, root) of texts that are connected with others; root is the smallest id of the group."""
    spark = placed.sparkSession
    texts = signed.groupBy("id").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min(F.struct("file", "row")).alias("place"))
    texts = materialize(texts, "texts")
    of_fp = texts.groupBy("fp").agg(F.min("id").alias("id"))
    trees = materialize(shard_links(shard_entries(of_fp.select("fp"))), "near")
    near = trees.select("a").union(trees.select("b")).distinct().join(of_fp.select(F.col("fp").alias("a"), "id"), "a").select("id")
    wanted = scratch_path(spark, "wanted")
    places = texts.join(_meeting(texts).union(near).distinct(), "id").select("place.file", "place.row", "id")
    write_places(places, wanted)
    sets = placed.select("file", "row", F.col(f"data.`{text}`").alias("text")).mapInArrow(_shingles(wanted), "id binary, shingles array<long>, odd array<long>")
    sets = materialize(sets, "shingles")
    entries = materialize(_buckets(sets, similarity), "buckets")
    larger, smaller = F.greatest("a_size", "size"), F.least("a_size", "size")
    leads = F.col("a_lead") & (F.col("a_size") <= F.col("size")) | F.col("lead") & (F.col("size") <= F.col("a_size"))
    # sets differ in one shingle at least for each bit of their parities that differs
    apart = sum((F.bit_count(F.col("a_odd")[i].bitwiseXOR(F.col("odd")[i])) for i in range(SKETCH // 64)), F.lit(0))
    close = (smaller >= larger * similarity - 1e-6) & (apart <= (larger + smaller) * ((1 - similarity) / (1 + similarity)) + 1e-6)
    links, star, hubs, upto = None, None, 1, 2
    while True:
        root = F.col("id")
        if star is not None:
            entries = entries.drop("root").join(star.select(F.col("node").alias("id"), "root"), "id", "left")
            root = F.coalesce("root", "id")
        entries = entries.filter(F.col("place") >= hubs).select("bucket", "id", "size", "odd", "lead", "place", root.alias("root"))
        live = entries.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("lead").alias("led")).filter("low <> high AND led")
        entries = materialize(entries.join(live.select("bucket"), "bucket"), "buckets")
        if star is not None and entries.isEmpty():
            return star.select(F.col("node").alias("id"), "root")
        first = entries.filter(F.col("place") < upto).select("bucket", F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("size", "odd", "lead", "root", "place")])
        pairs = entries.join(first, "bucket").filter("place > a_place AND root <> a_root").filter(leads & close)
        found = _alike(pairs.select("a", F.col("id").alias("b")).distinct(), sets, similarity)
        links = materialize(found if links is None else links.unionByName(found), "links")
        star = materialize(connected(links), "star")
        hubs, upto = upto, 4 * upto


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, component) of every row: the smallest key of its group."""
    placed = with_places(docs)
    signed = materialize(signatures(placed, key, text), "signatures")
    named = signed.join(groups(signed, placed, text, similarity), "id", "left").select("key", F.coalesce("root", "id").alias("root"))
    least = materialize(named.groupBy("root").agg(F.min("key").alias("component")), "components")
    return named.join(least, "root").select("key", "component")


def _kept(gone: str):
    """Rows but those whose places are listed in a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = place_rows(gone, "row")
        for batch in batches:
            found = lookup(batch.column(0), batch.column(1))
            yield batch.select([2]).filter(pa.array([f is None for f in found], pa.bool_()))

    return run


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, one of each group."""
    placed = with_places(docs)
    signed = materialize(signatures(placed, key, text), "signatures")
    named = signed.join(groups(signed, placed, text, similarity), "id", "left").withColumn("root", F.coalesce("root", "id"))
    place = F.struct(F.col("key").isNull().alias("none"), "key", "id", "file", "row")
    named = materialize(named.select("root", place.alias("place")), "named")
    stays = materialize(named.groupBy("root").agg(F.min("place").alias("first")), "stays")
    gone = scratch_path(docs.sparkSession, "gone")
    write_places(named.join(stays, "root").filter("place <> first").select("place.file", "place.row"), gone)
    rows = placed.select("file", "row", "data").mapInArrow(_kept(gone), placed.select("data").schema)
    return rows.select(*unpacked(rows, docs, "data"))
