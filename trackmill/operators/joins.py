"""Joins of the video data model: references, anchors, instance matches, box overlaps, windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.boxes import Box, iou

ANCHOR = ["video_id", "frame", "track_id", "category_id"]


def missing_references(facts: DataFrame, key: str, dim: DataFrame, dim_key: str = "id") -> DataFrame:
    """Facts whose key is not in the dimension; a null key is missing too."""
    return facts.join(dim.select(F.col(dim_key).alias(key)).distinct(), key, "left_anti")


def null_safe(left: str, right: str, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def anchor_diff(reference: DataFrame, current: DataFrame, key: list[str], compared: dict[str, Column], filtered: DataFrame | None = None) -> DataFrame:
    """Outcome of each anchor of two versions: preserved, modified (with the changed fields), filtered
    (missing, but listed in ``filtered``), missing, or added. Null key parts are equal.

    ``compared``: for each field whether it is equal, over the aliases r and c. The full outer join is a
    left and an anti join, which take null-safe keys without a cross product.
    """
    r, c = reference.alias("r"), current.alias("c")
    changed = F.array_compact(F.array(*[F.when(~same, F.lit(f)) for f, same in compared.items()]))
    both = r.join(c.withColumn("_there", F.lit(True)).alias("c"), null_safe("r", "c", key), "left")
    both = both.select(*[F.col(f"r.{k}").alias(k) for k in key], F.col("c._there").alias("_there"), F.when(F.col("c._there"), changed).alias("changed"))
    if filtered is not None:
        listed = filtered.select(*key).distinct().withColumn("_listed", F.lit(True))
        both = both.alias("r").join(listed.alias("c"), null_safe("r", "c", key), "left").select("r.*", F.col("c._listed").alias("_listed"))
    else:
        both = both.withColumn("_listed", F.lit(None).cast("boolean"))
    outcome = F.when(F.col("_there"), F.when(F.size("changed") > 0, "modified").otherwise("preserved")).when(F.col("_listed"), "filtered").otherwise("missing")
    both = both.select(*key, outcome.alias("outcome"), F.coalesce("changed", F.array().cast("array<string>")).alias("changed"))
    added = c.join(r, null_safe("r", "c", key), "left_anti").select(*key, F.lit("added").alias("outcome"), F.array().cast("array<string>").alias("changed"))
    return both.unionByName(added)


def identity_diff(reference: DataFrame, current: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(key, outcome): new, or modified if a field differs; null equals null."""
    new = current.join(reference.select(key), key, "left_anti").select(key, F.lit("new").alias("outcome"))
    both = current.alias("c").join(reference.alias("r"), key)
    return new.unionByName(both.filter(~null_safe("r", "c", fields)).select(key, F.lit("modified").alias("outcome")))


def overlaid(base: DataFrame, full: DataFrame, key: str = "id") -> DataFrame:
    """Base rows, and those of the full table whose key the base does not have."""
    return base.unionByName(full.join(base.select(key), key, "left_anti"))


def remapped(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Values replaced by mapping (old, new); rows without a new value go."""
    return df.join(mapping.withColumnRenamed("old", column), column).withColumn(column, F.col("new")).drop("new").select(df.columns)


def remapped_array(values: Column, mapping: Column) -> Column:
    """Array values by a map column; those without an image go."""
    return F.array_compact(F.transform(values, lambda x: F.try_element_at(mapping, x)))


def instance_matches(left: DataFrame, right: DataFrame, pair: list[str], instance: str = "instance_id", index: str = "idx", positive_only: bool = False) -> DataFrame:
    """(pair, index, match): the first index of the same instance on the other side, or -1.

    With positive_only, ids of zero or less never match.
    """
    side = right.filter(F.col(instance) > 0) if positive_only else right
    first = side.groupBy(*pair, instance).agg(F.min(index).alias("match"))
    return left.join(first, [*pair, instance], "left").select(*pair, index, F.coalesce("match", F.lit(-1)).alias("match"))


def repaired_matches(left: DataFrame, right: DataFrame, pair: list[str], kept: str = "kept", index: str = "idx", match: str = "match") -> DataFrame:
    """Match indices after rows have been dropped on both sides: new indices count the kept rows, and a
    match to a dropped row becomes -1."""
    w = Window.partitionBy(*pair).orderBy(index)
    renumber = lambda df: df.filter(kept).withColumn("new", (F.row_number().over(w) - 1).cast("long"))
    target = renumber(right).select(*pair, F.col(index).alias(match), F.col("new").alias("new_match"))
    return renumber(left).join(target, [*pair, match], "left").select(*pair, F.col("new").alias(index), F.coalesce("new_match", F.lit(-1)).alias(match))


def concatenated_matches(parts: DataFrame, group: str, part: str, n_other: DataFrame, match: str = "match") -> DataFrame:
    """Matches of parts put one after the other: shifted by the other side's rows in earlier parts."""
    w = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shift = n_other.select(group, part, F.coalesce(F.sum("n").over(w), F.lit(0)).alias("shift"))
    moved = F.when(F.col(match) >= 0, F.col(match) + F.col("shift")).otherwise(F.col(match))
    return parts.join(shift, [group, part]).withColumn(match, moved).drop("shift")


def overlaps(df: DataFrame, frame: list[str], least: float = 0.0, same_category: bool = False, cell: float | None = None) -> DataFrame:
    """(frame, i, j, iou) of all pairs of a frame's boxes, i before j by ord, over ``least``.

    With ``cell``, boxes meet only in the grid cells that they share, and each pair once: in the cell
    of their intersection's corner. That suits frames with very many boxes.
    """
    columns = [*frame, "ord", "category_id", "x1", "y1", "x2", "y2"]
    a, b = df.select(*columns), df.select(*columns)
    on = list(frame)
    if cell:
        spread = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
        grid = lambda d: d.withColumn("cx", spread("x1", "x2")).withColumn("cy", spread("y1", "y2"))
        a, b, on = grid(a), grid(b), [*frame, "cx", "cy"]
    if same_category:
        on = [*on, "category_id"]
    rename = lambda d, p: d.select(*on, *[F.col(c).alias(p + c) for c in d.columns if c not in on])
    pairs = rename(a, "a_").join(rename(b, "b_"), on).filter("a_ord < b_ord")
    left, right = Box.corners("a_"), Box.corners("b_")
    if cell:
        once = (F.floor(F.greatest("a_x1", "b_x1") / cell) == F.col("cx")) & (F.floor(F.greatest("a_y1", "b_y1") / cell) == F.col("cy"))
        pairs = pairs.filter(once)
    out = pairs.select(*frame, F.col("a_ord").alias("i"), F.col("b_ord").alias("j"), iou(left, right).alias("iou"))
    return out.filter(F.col("iou") > least)


def frame_window(df: DataFrame, scope: int, key: str = "video_id", order: str = "frame_id") -> DataFrame:
    """(key, frame, ref): the frames up to ``scope`` positions around each, but itself."""
    frames = df.select(key, order).distinct()
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-scope, scope)
    near = frames.withColumn("_near", F.collect_list(order).over(w))
    return near.select(key, order, F.explode("_near").alias("ref")).filter(F.col("ref") != F.col(order))


def best_matches(gt: DataFrame, detections: DataFrame, frame: list[str], least: float = 0.5) -> DataFrame:
    """(frame, gt, detection, iou): each ground-truth box with its best detection from ``least`` up."""
    left = gt.select(*frame, F.col("ord").alias("gt"), *[F.col(c).alias("a_" + c) for c in ("x1", "y1", "x2", "y2")])
    right = detections.select(*frame, F.col("ord").alias("detection"), *[F.col(c).alias("b_" + c) for c in ("x1", "y1", "x2", "y2")])
    pairs = left.join(right, frame).withColumn("iou", iou(Box.corners("a_"), Box.corners("b_"))).filter(F.col("iou") >= least)
    best = F.max_by(F.struct("detection", "iou"), F.struct("iou", -F.col("detection")))
    return pairs.groupBy(*frame, "gt").agg(best.alias("b")).select(*frame, "gt", "b.detection", "b.iou")
