"""Joins laid out for size: tables that meet without a shuffle, filters before one, and keys dealt by counts.

Spark chooses among hash, merge and broadcast joins itself. What it can't know is here: that tables will be
joined again by the same key (``bucketed``), that most rows of the larger side have no partner (``prefiltered``),
and which keys hold so many rows that a task can't (``salted_join``). Rows are those of the plain join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.sources.scratch import scratch_dir

#: Bits of a filter at most (8 MB on each executor), bits and hashes per key: one key in 120 passes by chance.
MOST_BITS, KEY_BITS, HASHES = 1 << 26, 10, 5
#: Rows of a bucket, which a task sorts, about.
BUCKET_ROWS = 2_000_000


def buckets_for(*tables: DataFrame, least: int = 8) -> int:
    """A number of buckets for tables that are to be joined: about BUCKET_ROWS rows of the largest in each."""
    return max(least, -(-max(t.count() for t in tables) // BUCKET_ROWS))


def bucketed(df: DataFrame, keys: list[str], buckets: int, name: str, path: str | None = None) -> DataFrame:
    """Write a table dealt to buckets by its keys and sorted in them; two such tables of one number of buckets
    are joined, and each is grouped, by these keys without a shuffle."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex[:12]}"
    path = path or f"{scratch_dir(spark)}/{name}"
    df.repartition(buckets, *keys).write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


def _place(keys: list[str], i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), *[F.col(k) for k in keys]), F.lit(bits))


def bloom_filter(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """One row, ``words``: the bits of a Bloom filter of the keys, 64 to a word; None for more keys than the
    largest filter is good for."""
    known = df.select(*keys).distinct()
    n = known.count()
    bits = max(64, 1 << max(0, n * KEY_BITS - 1).bit_length())
    if bits > MOST_BITS:
        return None
    place = F.explode(F.array(*[_place(keys, i, bits) for i in range(HASHES)])).alias("place")
    set_ = known.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits"))
    every = df.sparkSession.range(bits >> 6).withColumnRenamed("id", "word").join(set_, "word", "left")
    words = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(F.transform(words, lambda w: w.bits).alias("words"))


def prefiltered(large: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``large`` that may have a partner in ``small`` by the keys, to be shuffled for the join; rows
    with a null key go. All rows stay if the filter would be too large."""
    found = bloom_filter(small, keys)
    kept = large.dropna(subset=keys)
    if found is None:
        return kept
    bits = F.size("words") * 64
    test = lambda i: F.getbit(F.col("words")[F.shiftright(_place(keys, i, bits), 6).cast("int")], (_place(keys, i, bits) % 64).cast("int")) == 1
    held = kept.crossJoin(F.broadcast(found))  # one row of at most MOST_BITS bits
    for i in range(HASHES):
        held = held.filter(test(i))
    return held.drop("words")


def hot_keys(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """(*keys, parts): keys of more than so many rows, and into how many parts of that size they fall."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > rows)
    return counts.select(*keys, F.ceil(F.col("n") / rows).alias("parts"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (inner or left) by keys of which some have many rows in ``left``: those
    are dealt to parts of about ``rows`` rows, and their rows in ``right`` go to every part."""
    if how not in ("inner", "left"):
        raise ValueError(f"no salted {how} join; known: inner, left")
    hot = hot_keys(left, keys, rows)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    dealt = left.alias("l").join(hot.alias("h"), same, "left").select("l.*", F.pmod(F.xxhash64(*[F.col(f"l.`{c}`") for c in left.columns], F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1))).alias("_part"))
    same = [F.col(f"r.{k}") == F.col(f"h.{k}") for k in keys]
    spread = right.alias("r").join(hot.alias("h"), same, "left").select("r.*", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("_part"))
    return dealt.join(spread, [*keys, "_part"], how).drop("_part")
