"""Average precision of boxes and of tracks, with categories that are labelled in part of the images only.

After the published definitions: detections of one unit (an image, or a video for tracks) and category take,
best score first, the free object they overlap most, at each threshold; a category's detections in order of
score then give precision and recall, and the mean over 101 points of recall of the best precision at that
recall or above is its average precision. Objects count as ignored outside an area range, or where they say
so: to match one, or to match none outside the range, is neither right nor wrong.

Units are labelled for the categories of their objects and for those known to be absent (``negative``);
detections of other categories there are left out. Where not all objects of a category are labelled
(``partial``), detections that match none are left out.

Only pairs that overlap are shuffled to be matched, group by group; counts along the scores run over ranges
of rows, so a category of any size is spread over many tasks. Defined results: ties in score go by the
detection's id, detections that overlap two objects alike take the one with the larger id, those without
score or category are left out, categories without an object that counts have no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.boxes import Box, intersection
from trackmill.operators.aggregates import running_sums
from trackmill.operators.groups import Columns, over_groups
from trackmill.sources.scratch import kept

#: Area ranges of objects in pixels, [low, high).
AREAS = {"all": (0.0, float("inf")), "small": (0.0, 1024.0), "medium": (1024.0, 9216.0), "large": (9216.0, float("inf"))}
#: Points of recall: 0, 0.01, ..., 1.
POINTS = 100
THRESHOLDS = (0.5, 0.75)
MOST = 300


def box_pairs(gt: DataFrame, detections: DataFrame, least: float = 0.5) -> DataFrame:
    """(unit, category_id, det, gt, iou) of the boxes of one image and category that overlap enough."""
    a, b = Box.corners("a_"), Box.corners("b_")
    named = lambda df, p, name: df.select("unit", "category_id", F.col("id").alias(name), *[F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")])
    shared = intersection(a, b)
    iou = F.try_divide(shared, a.area + b.area - shared)
    pairs = named(detections, "a", "det").join(named(gt, "b", "gt"), ["unit", "category_id"])
    return pairs.select("unit", "category_id", "det", "gt", iou.alias("iou")).filter(F.col("iou") >= least)


def track_pairs(gt: DataFrame, detections: DataFrame, least: float = 0.5) -> DataFrame:
    """The same of tracks over a video's frames: areas shared in all frames by areas covered in all frames.
    Rows are boxes, with frame_id."""
    a, b = Box.corners("a_"), Box.corners("b_")
    named = lambda df, p, name: df.select("unit", "category_id", "frame_id", F.col("id").alias(name), *[F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")])
    covered = lambda df, p, name: named(df, p, name).groupBy("unit", "category_id", name).agg(F.sum(a.area if p == "a" else b.area).alias(f"{p}_area"))
    key = ["unit", "category_id"]
    shared = named(detections, "a", "det").join(named(gt, "b", "gt"), [*key, "frame_id"]).groupBy(*key, "det", "gt").agg(F.sum(intersection(a, b)).alias("shared"))
    pairs = shared.filter("shared > 0").join(covered(detections, "a", "det"), [*key, "det"]).join(covered(gt, "b", "gt"), [*key, "gt"])
    iou = F.col("shared") / (F.col("a_area") + F.col("b_area") - F.col("shared"))
    return pairs.select(*key, "det", "gt", iou.alias("iou")).filter(F.col("iou") >= least)


def greedy_matches(det: np.ndarray, gt: np.ndarray, iou: np.ndarray, ignored: np.ndarray, threshold: float) -> dict[int, tuple[int, bool]]:
    """det -> (gt, whether that is ignored). Pairs come best detection first, its objects by id; objects
    that count go before ignored ones, and of equal overlaps the last wins."""
    taken: set[int] = set()
    found: dict[int, tuple[int, bool]] = {}
    edges = [0, *(np.flatnonzero(det[1:] != det[:-1]) + 1).tolist(), len(det)]
    for a, b in zip(edges, edges[1:], strict=False):
        for skip in (False, True):
            free = [i for i in range(a, b) if ignored[i] == skip and iou[i] >= threshold and gt[i] not in taken]
            if free:
                best = max(free, key=lambda i: (iou[i], i))
                taken.add(gt[best])
                found[int(det[a])] = (int(gt[best]), skip)
                break
    return found


def matched(pairs: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(unit, category_id, area, threshold, det, gt, spared) of pairs with score, area and ignored."""
    keys = ["unit", "category_id", "area"]

    def solve(c: Columns) -> tuple | None:
        rows = [(t, d, g, s) for t in thresholds for d, (g, s) in greedy_matches(c["det"], c["gt"], c["iou"], c["ignored"], t).items()]
        if not rows:
            return None
        t, d, g, s = map(np.array, zip(*rows, strict=True))
        return (*(np.repeat(c[k][:1], len(rows)) for k in keys), t, d, g, s)

    order = pairs.select(*keys, (-F.col("score")).alias("worst"), "det", "gt", "iou", "ignored")
    return over_groups(order, keys, ["worst", "det", "gt"], solve, "unit long, category_id long, area string, threshold double, det long, gt long, spared boolean")


def _areas(df: DataFrame, areas: dict[str, tuple[float, float]], size: Column) -> DataFrame:
    """Each row once per area range, with ``outside``."""
    ranges = F.array(*[F.struct(F.lit(n).alias("area"), F.lit(low).alias("low"), F.lit(high).alias("high")) for n, (low, high) in areas.items()])
    out = df.withColumn("_range", F.explode(ranges)).withColumn("outside", (size < F.col("_range.low")) | (size >= F.col("_range.high")))
    return out.withColumn("area", F.col("_range.area")).drop("_range")


def judged(gt: DataFrame, detections: DataFrame, pairs: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, areas: dict[str, tuple[float, float]] | None = None, negative: DataFrame | None = None, partial: DataFrame | None = None, most: int | None = MOST) -> tuple[DataFrame, DataFrame]:
    """Objects that count, as (category_id, area, n_gt), and detections that do, as (category_id, area,
    threshold, score, det, hit). gt: unit, id, category_id, size, ignored; detections: unit, id,
    category_id, score, size; negative, partial: (unit, category_id)."""
    key = ["unit", "category_id"]
    areas = areas or {"all": AREAS["all"]}
    found = detections.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("category_id").isNotNull()).select("unit", F.col("id").alias("det"), "category_id", "score", "size")
    if most is not None:
        best = Window.partitionBy("unit").orderBy(F.desc("score"), "det")
        found = found.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= most).drop("_place")
    labelled = gt.select(*key)
    if negative is not None:
        labelled = labelled.union(negative.select(*key))
    found = found.join(labelled.distinct(), key)
    open_ = F.lit(False)
    if partial is not None:
        found = found.join(partial.select(*key).distinct().withColumn("_open", F.lit(True)), key, "left").withColumn("_open", F.coalesce("_open", F.lit(False)))
        open_ = F.col("_open")
    objects = _areas(gt.select(*key, F.col("id").alias("gt"), "size", "ignored"), areas, F.col("size"))
    objects = objects.withColumn("ignored", F.coalesce("ignored", F.lit(False)) | F.col("outside")).drop("outside", "size")
    found = _areas(found, areas, F.col("size")).drop("size")
    close = pairs.join(found.select(*key, "det", "score", "area"), [*key, "det"]).join(objects, [*key, "gt", "area"])
    hits = matched(close, thresholds).withColumnRenamed("gt", "hit")
    every = found.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).join(hits, [*key, "area", "threshold", "det"], "left")
    spared = F.when(F.col("hit").isNotNull(), F.col("spared")).otherwise(F.col("outside") | open_)
    rows = every.filter(~spared).select("category_id", "area", "threshold", "score", "det", F.col("hit").isNotNull().cast("long").alias("hit"))
    return objects.filter("NOT ignored").groupBy("category_id", "area").agg(F.count("*").alias("n_gt")), rows


def precision_at_recall(counted: DataFrame, rows: DataFrame) -> DataFrame:
    """(category_id, area, threshold, n_gt, n_det, recall, ap) of judged detections."""
    keys = ["category_id", "area", "threshold"]
    order = rows.withColumn("worst", -F.col("score")).withColumn("one", F.lit(1).cast("long")).drop("score")
    run = running_sums(order, keys, ["worst", "det"], {"hit": "hits", "one": "dets"}).join(counted, ["category_id", "area"])
    reached = F.expr(f"hits * {POINTS} div n_gt")  # the last point of recall up to here
    best = run.groupBy(*keys, reached.alias("point")).agg(F.max(F.col("hits") / F.col("dets")).alias("p"), F.max("hits").alias("hits"), F.max("dets").alias("dets"))
    down = Window.partitionBy(*keys).orderBy(F.desc("point"))  # at most POINTS + 1 rows
    share = (F.col("point") - F.coalesce(F.lead("point").over(down), F.lit(-1))) * F.max("p").over(down)
    found = best.withColumn("share", share).groupBy(*keys).agg((F.sum("share") / (POINTS + 1)).alias("ap"), F.max("hits").alias("hits"), F.max("dets").alias("n_det"))
    return found.select(*keys, "n_det", "hits", "ap")


def average_precision(gt: DataFrame, detections: DataFrame, pairs: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, **options) -> DataFrame:
    """(category_id, area, threshold, n_gt, n_det, recall, ap) of every category with objects that count;
    the options are those of ``judged``."""
    counted, rows = judged(gt, detections, pairs, thresholds, **options)
    counted = kept(counted, "objects")
    found = precision_at_recall(counted, kept(rows, "judged"))
    every = counted.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).join(found, ["category_id", "area", "threshold"], "left")
    zero = {"n_det": 0, "ap": 0.0, "hits": 0}
    return every.fillna(zero).select("category_id", "area", "threshold", "n_gt", "n_det", (F.col("hits") / F.col("n_gt")).alias("recall"), "ap")


def box_ap(gt: DataFrame, detections: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, **options) -> DataFrame:
    """AP of boxes. gt and detections: unit (the image), id, category_id and corners; gt with ignored,
    detections with score."""
    size = Box.corners().area
    g, d = gt.withColumn("size", size), detections.withColumn("size", size)
    return average_precision(g, d, box_pairs(gt, detections, min(thresholds)), thresholds, **options)


def track_ap(gt: DataFrame, detections: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, **options) -> DataFrame:
    """AP of tracks: rows are their boxes, unit is the video, id the track, frame_id the frame. A track's
    score and size are the means of its boxes'; it is ignored if all of them are."""
    size = Box.corners().area
    key = ["unit", "category_id", "id"]
    g = gt.groupBy(*key).agg(F.avg(size).alias("size"), F.every(F.coalesce("ignored", F.lit(False))).alias("ignored"))
    d = detections.groupBy(*key).agg(F.avg(size).alias("size"), F.avg("score").alias("score"))
    return average_precision(g, d, track_pairs(gt, detections, min(thresholds)), thresholds, **options)


def ap_summary(per_category: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """(name, value): AP over all thresholds, per threshold, per area and, with (category_id, frequency), per
    frequency of categories; means over categories."""
    every = F.col("area") == "all"
    per = per_category if frequency is None else per_category.join(frequency.select("category_id", "frequency"), "category_id", "left")
    names = [F.when(every, F.lit("AP")), F.when(every, F.concat(F.lit("AP"), F.format_string("%.0f", F.col("threshold") * 100))), F.when(~every, F.concat(F.lit("AP_"), F.col("area")))]
    if frequency is not None:
        names.append(F.when(every & F.col("frequency").isNotNull(), F.concat(F.lit("AP_"), F.col("frequency"))))
    out = per.withColumn("name", F.explode(F.array_compact(F.array(*names)))).groupBy("name")
    return out.agg(F.avg("ap").alias("value"))
