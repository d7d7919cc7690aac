"""Queries over average precision: results with known faults, whose overlaps follow from their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.plans import average_precision as A
from trackmill.registry import query
from trackmill.sources.adapters import boxes, oracle
from trackmill.sources.scratch import kept

#: Boxes of a frame lie apart, so each overlaps its own copies only.
APART = "SELECT *, track_id % 50 * 200.0::DOUBLE AS left_, video_id * 50 + frame_id AS image_id FROM boxes"


def _apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.col("track_id") % 50 * 200.0
    b = boxes(spark, sf_dir).withColumns({"x1": left, "x2": left + F.col("w"), "y1": F.lit(0.0), "y2": F.col("h")})
    return b.withColumn("image_id", F.col("video_id") * 50 + F.col("frame_id"))


def _labels(units: DataFrame, kind: str) -> DataFrame:
    """(unit, category_id): categories known to be absent, or labelled in part."""
    every = units.select("unit").distinct().withColumn("category_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return every.filter((F.col("unit") + F.col("category_id")) % (2 if kind == "negative" else 3) == 0)


#: The counts along the scores, and the mean over the points of recall of the best precision from there on.
_AP = """, ranked AS (SELECT category_id, area, threshold, hit, sum(hit) OVER w AS hits, count(*) OVER w AS dets FROM judged WINDOW w AS (PARTITION BY category_id, area, threshold ORDER BY score DESC, det)),
curve AS (SELECT r.*, n_gt FROM ranked r JOIN objects USING (category_id, area)),
points AS (SELECT category_id, area, threshold, p, max(CASE WHEN hits * 100 >= p * n_gt THEN hits / dets::DOUBLE ELSE 0 END) AS best FROM curve, range(101) t(p) GROUP BY ALL),
aps AS (SELECT category_id, area, threshold, avg(best) AS ap FROM points GROUP BY ALL)
SELECT category_id, area, threshold, n_gt, coalesce((SELECT count(*) FROM judged j WHERE j.category_id = o.category_id AND j.area = o.area AND j.threshold = t.threshold), 0) AS n_det,
  round(coalesce((SELECT sum(hit) FROM judged j WHERE j.category_id = o.category_id AND j.area = o.area AND j.threshold = t.threshold), 0) / n_gt::DOUBLE, 9) AS recall, round(coalesce(ap, 0), 9) AS ap
FROM objects o CROSS JOIN (VALUES (0.5::DOUBLE), (0.75::DOUBLE)) t(threshold) LEFT JOIN aps USING (category_id, area, threshold)"""

#: A box is found shifted by ord % 8 eighths of its width; every tenth is lost, every fifth found twice,
#: every seventh under the next class.
_SHIFT = "ord % 8 / 8.0::DOUBLE"
_BOXES = {
    "apart": APART,
    "found": f"SELECT ord * 2 + twice AS det, image_id AS unit, CASE WHEN ord % 7 = 0 THEN (category_id + 1) % 5 ELSE category_id END AS category_id, score - twice * 0.0005::DOUBLE AS score, w * h AS size, ord % 7 <> 0 AND twice = 0 AS own, (1 - {_SHIFT}) / (1 + {_SHIFT}) AS iou, ord % 13 = 0 AS spared FROM apart, (VALUES (0), (1)) v(twice) WHERE ord % 10 <> 0 AND (twice = 0 OR ord % 5 = 1)",
    "labelled": "SELECT DISTINCT image_id AS unit, category_id FROM apart UNION SELECT DISTINCT image_id, c FROM apart, (VALUES (0), (1), (2), (3), (4)) v(c) WHERE (image_id + c) % 2 = 0",
    "areas": "SELECT * FROM (VALUES ('all', 0::DOUBLE, 'infinity'::DOUBLE), ('small', 0, 1024), ('medium', 1024, 9216), ('large', 9216, 'infinity'::DOUBLE)) v(area, low, high)",
    "objects": "SELECT category_id, area, count(*) AS n_gt FROM apart, areas WHERE w * h >= low AND w * h < high AND ord % 13 <> 0 GROUP BY ALL",
    "judged": """SELECT category_id, area, threshold, score, det, (own AND iou >= threshold)::BIGINT AS hit
      FROM found JOIN labelled USING (unit, category_id), areas, (VALUES (0.5::DOUBLE), (0.75::DOUBLE)) t(threshold)
      WHERE CASE WHEN own AND iou >= threshold THEN NOT spared AND size >= low AND size < high ELSE size >= low AND size < high AND (unit + category_id) % 3 <> 0 END""",
}


def _found_boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = _apart(spark, sf_dir)
    gt = b.select(F.col("image_id").alias("unit"), F.col("ord").alias("id"), F.col("category_id").cast("long"), "x1", "y1", "x2", "y2", (F.col("ord") % 13 == 0).alias("ignored"))
    twice = b.withColumn("twice", F.explode(F.array(F.lit(0), F.lit(1)))).filter("ord % 10 <> 0 AND (twice = 0 OR ord % 5 = 1)")
    shift = F.col("ord") % 8 / 8.0 * F.col("w")
    label = F.when(F.col("ord") % 7 == 0, (F.col("category_id") + 1) % 5).otherwise(F.col("category_id")).cast("long")
    found = twice.select(
        F.col("image_id").alias("unit"), (F.col("ord") * 2 + F.col("twice")).alias("id"), label.alias("category_id"), (F.col("score") - F.col("twice") * 0.0005).alias("score"),
        (F.col("x1") + shift).alias("x1"), "y1", (F.col("x2") + shift).alias("x2"), "y2",
    )
    return gt, found


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"recall": F.round("recall", 9), "ap": F.round("ap", 9)})


@query("EVL-5b", oracle("SELECT * FROM (WITH judged AS (SELECT * FROM judged_)" + _AP + ")", **{("judged_" if k == "judged" else k): v for k, v in _BOXES.items()}))
def evl_5b(spark, sf_dir):
    """Box AP per category, area range and threshold, with absent and partly labelled categories."""
    gt, found = _found_boxes(spark, sf_dir)
    return _rounded(A.box_ap(gt, found, areas=A.AREAS, negative=_labels(gt, "negative"), partial=_labels(gt, "partial")))


#: Every tenth box of a track is lost, and its id changes at frame 30, 40 or 49.
_TRACKS = {
    "apart": APART,
    "win": "SELECT track_id, category_id FROM (SELECT track_id, category_id, row_number() OVER (PARTITION BY track_id ORDER BY count(*) DESC, category_id) AS r FROM boxes GROUP BY 1, 2) WHERE r = 1",
    "whole": "SELECT a.video_id, a.track_id, win.category_id, a.frame_id, a.ord, w * h AS size, score FROM apart a JOIN win USING (track_id)",
    "cut": "SELECT *, frame_id >= least(30 + track_id % 3 * 10, 49) AS late FROM whole WHERE ord % 10 <> 0",
    "covered": "SELECT track_id, sum(size) AS size FROM whole GROUP BY 1",
    "found": "SELECT track_id * 2 + late::INT AS det, cut.track_id, any_value(video_id) AS unit, any_value(category_id) AS category_id, sum((score * 1000)::BIGINT) / count(*)::DOUBLE AS score, sum(cut.size) / any_value(covered.size) AS iou FROM cut JOIN covered USING (track_id) GROUP BY 1, 2",
    "objects": "SELECT category_id, 'all' AS area, count(*) AS n_gt FROM win GROUP BY 1",
    "labelled": "SELECT DISTINCT video_id AS unit, category_id FROM whole",
    "judged": """SELECT f.category_id, 'all' AS area, threshold, score, det, (iou >= threshold AND best)::BIGINT AS hit
      FROM (SELECT *, row_number() OVER (PARTITION BY track_id, iou >= 0.5 ORDER BY score DESC, det) = 1 AS best FROM found) f, (VALUES (0.5::DOUBLE), (0.75::DOUBLE)) t(threshold)
      WHERE iou >= threshold AND best OR (unit + category_id) % 3 <> 0""",
}


@query("EVL-5c", oracle("SELECT * FROM (WITH judged AS (SELECT * FROM judged_)" + _AP + ")", **{("judged_" if k == "judged" else k): v for k, v in _TRACKS.items()}))
def evl_5c(spark, sf_dir):
    """Track AP per category and threshold, by overlap over space and time."""
    from trackmill.operators.aggregates import majority_category

    b = majority_category(_apart(spark, sf_dir)).withColumn("category_id", F.col("category_id").cast("long"))
    corners = ["x1", "y1", "x2", "y2"]
    gt = b.select(F.col("video_id").alias("unit"), F.col("track_id").alias("id"), "category_id", "frame_id", *corners, F.lit(False).alias("ignored"))
    late = (F.col("frame_id") >= F.least(30 + F.col("track_id") % 3 * 10, F.lit(49))).cast("long")
    found = b.filter("ord % 10 <> 0").select(F.col("video_id").alias("unit"), (F.col("track_id") * 2 + late).alias("id"), "category_id", "frame_id", *corners, F.round(F.col("score") * 1000).alias("score"))
    return _rounded(A.track_ap(gt, found, partial=_labels(gt, "partial")))


@query("EVL-5d", oracle("SELECT CASE WHEN area = 'all' THEN 'AP' ELSE 'AP_' || area END AS name, round(avg(ap), 9) AS value FROM (WITH judged AS (SELECT * FROM judged_)" + _AP + ") GROUP BY 1 UNION ALL SELECT 'AP' || (threshold * 100)::INT, round(avg(ap), 9) FROM (WITH judged AS (SELECT * FROM judged_)" + _AP + ") WHERE area = 'all' GROUP BY threshold UNION ALL SELECT 'AP_' || CASE WHEN category_id = 4 THEN 'r' WHEN category_id = 3 THEN 'c' ELSE 'f' END, round(avg(ap), 9) FROM (WITH judged AS (SELECT * FROM judged_)" + _AP + ") WHERE area = 'all' GROUP BY 1", **{("judged_" if k == "judged" else k): v for k, v in _BOXES.items()}))
def evl_5d(spark, sf_dir):
    """Means over categories: overall, per threshold, per area range, for rare, common and frequent ones."""
    per_category = kept(evl_5b(spark, sf_dir), "precision")  # a few rows, read twice
    frequency = per_category.select("category_id").distinct()
    frequency = frequency.withColumn("frequency", F.when(F.col("category_id") == 4, "r").when(F.col("category_id") == 3, "c").otherwise("f"))
    return A.ap_summary(per_category, frequency).withColumn("value", F.round("value", 9))
