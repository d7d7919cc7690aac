"""Stored sketches: distinct counts, quantiles and frequent items that can be merged later.

A sketch table has a row per key (a day and a type, say) with sketches of fixed size, whatever the number of
rows. Coarser keys, roll-ups and cubes are made of those rows alone, without the data. What the estimates are
off by is bounded: ``DISTINCT_ERROR`` is the standard error of a merged distinct count as a share of it,
``RANK_ERROR`` that of a quantile's place among all rows, and an item's count is too low or high by the number
of rows over ``ITEMS`` at most (exact while there are fewer different items). Items that may owe their place
to that error are not named, so the list of a table with many equally frequent items can be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_BUCKETS, QUANTILE_SIZE, ITEMS = 12, 400, 4096
DISTINCT_ERROR = 1.04 / (1 << LG_BUCKETS) ** 0.5
RANK_ERROR = 0.007


def sketched(df: DataFrame, keys: list[str], distinct: str, value: str, item: str) -> DataFrame:
    """(*keys, n, distincts, values, items): sketches of three columns per key."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(distinct, LG_BUCKETS).alias("distincts"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_SIZE).alias("values"),
        F.expr(f"approx_top_k_accumulate(`{item}`, {ITEMS})").alias("items"),
    )


def _merges() -> list[Column]:
    return [
        F.sum("n").alias("n"),
        F.hll_union_agg("distincts").alias("distincts"),
        F.kll_merge_agg_double("values", QUANTILE_SIZE).alias("values"),
        F.expr(f"approx_top_k_combine(items, {ITEMS})").alias("items"),
    ]


def merged(table: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser keys; no keys give one row of all."""
    return table.groupBy(*keys).agg(*_merges())


def merged_sets(table: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    """Sketches of several sets of keys at once, the others null, with ``level``: the places of the keys that
    are added up, as bits, the last key's lowest."""
    return table.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.grouping_id().alias("level"), *_merges())


def merged_cube(table: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of all subsets of keys."""
    return merged_sets(table, keys, [[k for i, k in enumerate(keys) if mask >> i & 1] for mask in range(1 << len(keys))])


def estimated(table: DataFrame, quantiles: list[float], most: int) -> DataFrame:
    """Sketches replaced by estimates: ``distincts``, ``quantiles`` and ``top``, (item, count) of the most frequent."""
    sketches = {
        "distincts": F.hll_sketch_estimate("distincts"),
        "quantiles": F.kll_sketch_get_quantile_double("values", F.array(*map(F.lit, quantiles))),
        "top": F.expr(f"approx_top_k_estimate(items, {most})"),
    }
    return table.withColumns(sketches).drop("values", "items")
