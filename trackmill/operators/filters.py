"""Row filters over boxes and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.boxes import Box, clipped

FRAME = ["video_id", "frame_id"]


def effective(box: Box, width: Column, height: Column, ignore: Column | None = None, area: Column | None = None) -> Column:
    """Whether training would use an annotation: not ignored, at least a pixel each way, some area, and
    some of it inside the image."""
    inside_w = F.greatest(F.lit(0.0), F.least(box.x2, width) - F.greatest(box.x1, F.lit(0.0)))
    inside_h = F.greatest(F.lit(0.0), F.least(box.y2, height) - F.greatest(box.y1, F.lit(0.0)))
    kept = (inside_w * inside_h != 0) & ((box.area if area is None else area) > 0) & (box.w >= 1) & (box.h >= 1)
    return kept if ignore is None else kept & ~F.coalesce(ignore, F.lit(False))


def min_size(df: DataFrame, box: Box, width: float, height: float, keep_empty: bool = True, frame: list[str] = FRAME) -> DataFrame:
    """Boxes of at least a size. Without keep_empty a frame that loses all boxes is told apart by the
    rows it no longer has; with it, such a frame keeps its rows."""
    good = (box.w >= width) & (box.h >= height)
    if not keep_empty:
        return df.filter(good)
    marked = df.withColumn("_good", good).withColumn("_any", F.max(good).over(Window.partitionBy(*frame)))
    return marked.filter(F.col("_good") | ~F.col("_any")).drop("_good", "_any")


def cropped(df: DataFrame, left: float, top: float, right: float, bottom: float, allow_negative: bool = False, frame: list[str] = FRAME) -> DataFrame:
    """Boxes shifted into a crop and clipped to it; empty ones go, and with them nothing else: a frame
    without any box left has no rows, unless allow_negative keeps its rows with null corners."""
    b = clipped(Box.corners(), left, top, right, bottom)
    moved = {"x1": b.x1 - left, "y1": b.y1 - top, "x2": b.x2 - left, "y2": b.y2 - top}
    out = df.withColumns({f"_{k}": v for k, v in moved.items()})
    good = (F.col("_x2") > F.col("_x1")) & (F.col("_y2") > F.col("_y1"))
    if allow_negative:
        out = out.withColumn("_any", F.max(good).over(Window.partitionBy(*frame))).filter(good | ~F.col("_any"))
        return out.select(*[(F.when(F.col("_any"), F.col(f"_{c}")) if c in moved else F.col(c)).alias(c) for c in df.columns])
    return out.filter(good).select(*[F.col(f"_{c}" if c in moved else c).alias(c) for c in df.columns])


def score_bands(df: DataFrame, high: float, low: float, score: str = "score", frame: list[str] = FRAME) -> DataFrame:
    """Scores divided by their frame's largest, and the band of each: high above ``high``, low strictly
    between ``low`` and ``high``, otherwise (equality too) none."""
    scaled = F.try_divide(F.col(score), F.max(score).over(Window.partitionBy(*frame)))
    out = df.withColumn("scaled", scaled)
    return out.withColumn("band", F.when(F.col("scaled") > high, "high").when((F.col("scaled") > low) & (F.col("scaled") < high), "low"))


def above_class_chance(df: DataFrame, n_classes: int, score: str = "score") -> DataFrame:
    """Scores over what an even guess among the classes would give, by a thousandth."""
    return df.filter(F.col(score) > 1.001 / n_classes)


def above_quantile(df: DataFrame, ratio: float, score: str = "score", frame: list[str] = FRAME) -> DataFrame:
    """Rows over their frame's k-th smallest score, k = int(n * ratio); with k = 0 all rows stay."""
    w = Window.partitionBy(*frame)
    k = F.floor(F.count(F.lit(1)).over(w) * ratio)
    ranked = df.withColumn("_k", k).withColumn("_rank", F.row_number().over(w.orderBy(score, "ord")))
    cut = F.max(F.when(F.col("_rank") == F.col("_k"), F.col(score))).over(w)
    return ranked.withColumn("_cut", cut).filter(F.col("_cut").isNull() | (F.col(score) > F.col("_cut"))).drop("_k", "_rank", "_cut")


def matched_only(df: DataFrame, track: str = "track_id") -> DataFrame:
    return df.filter(F.col(track) > -1)


def long_sequences(df: DataFrame, min_length: int, key: str = "video_id", frame: str = "frame_id") -> DataFrame:
    """Rows of sequences with more than so many frames."""
    lengths = df.groupBy(key).agg(F.count_distinct(frame).alias("_n")).filter(F.col("_n") > min_length)
    return df.join(lengths.select(key), key, "left_semi")


def valid_id(raw: Column, kind: Column) -> Column:
    """An id is a whole number or a text that is not empty; ``kind`` is its JSON type."""
    return (kind == "integer") | ((kind == "string") & (raw != ""))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def valid_bbox(bbox: Column) -> Column:
    return F.coalesce((F.size(bbox) == 4) & F.forall(bbox, finite), F.lit(False))
