"""Queries over sources, sinks, quality checks, logs and text functions."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.operators import aggregates as A
from trackmill.plans import logs as G
from trackmill.plans.quality import Checks, temporal_screens, training_frames
from trackmill.registry import query
from trackmill.sources import detections as detection_files
from trackmill.sources import files as S
from trackmill.sources import side_inputs as X
from trackmill.sources import sinks as K
from trackmill.sources.adapters import boxes, oracle
from trackmill.sources.annotations import Dataset, still_image_name
from trackmill.sources.scratch import kept, opened, scratch_dir

FRAME = ["video_id", "frame_id"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    """The boxes as an annotation dataset with some defects: lost images, tracks and categories, wrong
    areas, categories that change within a track, boxes beyond their image."""
    b = boxes(spark, sf_dir)
    text = lambda c: F.concat(F.lit("i:"), c.cast("string"))
    size = [F.lit(640.0).alias("width"), F.lit(480.0).alias("height")]
    videos = b.select("video_id").distinct().select(text(F.col("video_id")).alias("id"), F.lit(True).alias("id_ok"), F.concat(F.lit("s:v"), "video_id").alias("name"), F.col("video_id").alias("ord"), *size)
    image = F.col("video_id") * 50 + F.col("frame_id")
    images = b.select(*FRAME).distinct().select(text(image).alias("id"), F.lit(True).alias("id_ok"), text(F.col("video_id")).alias("video_id"), F.col("frame_id").alias("frame_index"), F.lit(True).alias("frame_ok"), text(F.col("frame_id")).alias("frame_key"), image.alias("ord"), (F.col("frame_id") % 5 == 0).alias("is_ori"), "frame_id", *size)
    tracks = b.filter("track_id % 17 <> 0").select("track_id", "video_id").distinct().select(text(F.col("track_id")).alias("id"), F.lit(True).alias("id_ok"), text(F.col("video_id")).alias("video_id"), text(F.col("track_id") % 50 % 5).alias("category_id"), F.col("track_id").alias("ord"))
    categories = spark.range(4).select(text(F.col("id")).alias("id"), F.lit(True).alias("id_ok"), F.concat(F.lit("s:c"), "id").alias("name"), F.col("id").alias("ord"))
    bad = F.col("ord") % 101 == 0
    annotations = b.select(
        "ord", text(F.col("ord")).alias("id"), F.lit(True).alias("id_ok"), F.when(bad, "i:-1").otherwise(text(image)).alias("image_id"), text(F.col("video_id")).alias("video_id"), text(F.col("track_id")).alias("track_id"),
        text(F.col("category_id")).alias("category_id"), F.array("x1", "y1", "w", "h").alias("bbox"), F.lit(True).alias("bbox_ok"), F.when(F.col("ord") % 97 == 0, 1.0).otherwise(F.col("w") * F.col("h")).alias("area"), F.lit(True).alias("has_area"),
    )
    return Dataset.of(spark, videos=videos, images=images, annotations=annotations, tracks=tracks, categories=categories)


_INSIDE = "(greatest(0.0, least(x2, 640.0) - greatest(x1, 0.0)) * greatest(0.0, least(y2, 480.0) - greatest(y1, 0.0)) > 0)"
_OVER = "greatest(-x1, -y1, x2 - 640.0, y2 - 480.0, 0.0)"
_FINDINGS = f"""SELECT kind, n FROM (
SELECT 'annotation_image_reference_missing' AS kind, count(*) AS n FROM boxes WHERE ord % 101 = 0
UNION ALL SELECT 'annotation_category_reference_missing', count(*) FROM boxes WHERE category_id = 4
UNION ALL SELECT 'annotation_track_reference_missing', count(*) FROM boxes WHERE track_id % 17 = 0
UNION ALL SELECT 'track_category_reference_missing', count(DISTINCT track_id) FROM boxes WHERE track_id % 17 <> 0 AND track_id % 50 % 5 = 4
UNION ALL SELECT 'annotation_track_category_mismatch', count(*) FROM boxes WHERE track_id % 17 <> 0 AND category_id <> track_id % 50 % 5
UNION ALL SELECT 'track_category_changed', count(*) FROM (SELECT category_id, first_value(category_id) OVER (PARTITION BY track_id ORDER BY ord) AS f FROM boxes) WHERE category_id <> f
UNION ALL SELECT 'multiple_boxes_same_track_image', sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM boxes WHERE ord % 101 = 0 GROUP BY track_id)
UNION ALL SELECT 'bbox_out_of_bounds', count(*) FROM boxes WHERE ord % 101 <> 0 AND {_INSIDE} AND {_OVER} > 8 AND NOT (ord % 97 = 0 AND FALSE)
UNION ALL SELECT 'bbox_boundary_overshoot_within_tolerance', count(*) FROM boxes WHERE ord % 101 <> 0 AND {_INSIDE} AND {_OVER} > 1e-4 AND {_OVER} <= 8
UNION ALL SELECT 'area_mismatch', count(*) FROM boxes WHERE ord % 97 = 0 AND (ord % 101 = 0 OR {_INSIDE})
) WHERE n > 0"""


@query("QA-findings", oracle(_FINDINGS))
def qa_findings(spark, sf_dir):
    """All findings of the checks over the dataset with defects, by kind."""
    f = Checks(dataset(spark, sf_dir), verbose=True).findings()
    return f.groupBy("kind").agg(F.sum("n").alias("n"))


@query("QA-areas", oracle(f"SELECT * FROM (VALUES ('0.0001'), ('0.001'), ('0.00001')) t(tolerance), LATERAL (SELECT count(*) FILTER (ord % 97 = 0 OR ord % 5 = 0 AND tolerance <> '0.001' OR ord % 5 = 1 AND tolerance = '0.00001') AS n FROM boxes WHERE ord % 101 = 0 OR {_INSIDE})"))
def qa_areas(spark, sf_dir):
    """Areas that are off by two ten-thousandths or half of one, at the usual tolerance and two others."""
    d = dataset(spark, sf_dir)
    off = F.when(F.col("ord") % 97 == 0, F.col("area")).when(F.col("ord") % 5 == 0, F.col("area") * (1 + 2e-4)).when(F.col("ord") % 5 == 1, F.col("area") * (1 + 5e-5)).otherwise(F.col("area"))
    rows = Dataset(d.rows.withColumn("area", F.when(F.col("section") == "annotations", off).otherwise(F.col("area"))))
    out = None
    for tolerance, checks in (("0.0001", Checks(rows)), ("0.001", Checks(rows, area_tolerance=1e-3)), ("0.00001", Checks(rows, area_tolerance=1e-5))):
        found = reduce(DataFrame.unionByName, checks.annotations()).filter("kind = 'area_mismatch'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        part = found.select(F.lit(tolerance).alias("tolerance"), F.col("n").cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


@query("QA-groups", oracle(f"WITH f AS ({_FINDINGS}) SELECT CASE WHEN kind LIKE '%reference_missing' THEN 'reference' WHEN kind LIKE 'multiple%' THEN 'duplicate' WHEN kind LIKE '%categor%' THEN 'track_category' ELSE 'bbox' END AS \"group\", sum(n)::BIGINT AS n FROM f WHERE kind <> 'bbox_boundary_overshoot_within_tolerance' GROUP BY 1".replace("WITH f AS", "SELECT * FROM (WITH f AS", 1) + ")"))
def qa_groups(spark, sf_dir):
    """Hard errors by group."""
    f = Checks(dataset(spark, sf_dir)).findings().filter("severity = 'error'")
    return f.groupBy("group").agg(F.sum("n").alias("n"))


@query("QA-anchors", oracle("SELECT CASE WHEN ord % 29 = 0 THEN 'missing' WHEN ord % 31 = 0 THEN 'modified' ELSE 'preserved' END AS outcome, count(*) AS n FROM boxes WHERE ord % 101 <> 0 GROUP BY 1"))
def qa_anchors(spark, sf_dir):
    """Anchors of the dataset against a version of it with lost and moved boxes."""
    old = dataset(spark, sf_dir)
    rows = old.rows
    a = F.col("section") == "annotations"
    moved = F.when(a & (F.col("ord") % 31 == 0), F.transform("bbox", lambda x, i: F.when(i == 0, x + 1).otherwise(x))).otherwise(F.col("bbox"))
    new = Dataset(rows.filter(~(a & (F.col("ord") % 29 == 0))).withColumn("bbox", moved))
    return Checks(new, old).anchor_outcomes().groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_T = {"low_iou": 0.9, "center_displacement": 0.05, "box_size_jump": 1.05, "aspect_ratio_jump": 1.04}
_A, _B = "((ax2 - ax1) * (ay2 - ay1))", "((bx2 - bx1) * (by2 - by1))"
_I = "(greatest(0.0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0.0, least(ay2, by2) - greatest(ay1, by1)))"
_R = "((bx2 - bx1) / (by2 - by1))"


@query(
    "WIN-1",
    oracle(
        f"""SELECT flag_type, count(*) AS n FROM (
SELECT 'low_iou' AS flag_type FROM steps WHERE {_I} / ({_A} + {_B} - {_I}) < 0.9
UNION ALL SELECT 'center_displacement' FROM steps WHERE sqrt(((ax1 + ax2) / 2 - (bx1 + bx2) / 2) ** 2 + ((ay1 + ay2) / 2 - (by1 + by2) / 2) ** 2) / sqrt(({_A} + {_B}) / 2) > 0.05
UNION ALL SELECT 'box_size_jump' FROM steps WHERE greatest({_A}, {_B}) / least({_A}, {_B}) > 1.05
UNION ALL SELECT 'aspect_ratio_jump' FROM steps WHERE greatest({_R}, (ax2 - ax1) / (ay2 - ay1)) / least({_R}, (ax2 - ax1) / (ay2 - ay1)) > 1.04
) GROUP BY flag_type"""
    ),
)
def win_1(spark, sf_dir):
    """Temporal screens over all tracks, by flag."""
    o = boxes(spark, sf_dir).select("video_id", "track_id", F.col("frame_id").alias("image_id"), "ord", F.col("frame_id").alias("frame"), F.array("x1", "y1", "w", "h").alias("bbox"), F.lit(None).cast("double").alias("visibility"))
    return temporal_screens(o, _T).groupBy("flag_type").agg(F.count(F.lit(1)).alias("n"))


# --- sampling of training frames ----------------------------------------------------------------


@query("SMP-2", None)
def smp_2(spark, sf_dir):
    """Original frames and a fifth as many others of each video, drawn without replacement (seed 42)."""
    frames = boxes(spark, sf_dir).select(*FRAME, (F.col("frame_id") % 5 == 0).alias("is_ori")).distinct()
    return A.original_frames(frames, 0.2)


@query(
    "SMP-3",
    oracle(
        "SELECT role, count(*) AS n FROM (SELECT DISTINCT video_id, frame_id, 'key' AS role FROM boxes WHERE frame_id % 4 = 0 UNION ALL SELECT DISTINCT a.video_id, a.frame_id, 'reference' FROM (SELECT DISTINCT video_id, frame_id FROM boxes) a JOIN (SELECT DISTINCT video_id, frame_id FROM boxes WHERE frame_id % 4 = 0) k ON a.video_id = k.video_id AND abs(a.frame_id - k.frame_id) <= 1 AND a.frame_id <> k.frame_id) GROUP BY role"
    ),
)
def smp_3(spark, sf_dir):
    """Key frames and their reference candidates, as training would read them."""
    return training_frames(dataset(spark, sf_dir).index("images"), 4, 1).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SMP-7",
    oracle(
        """SELECT d.video_id, d.frame_id, coalesce(d.pair_key, -1) AS pair_key, coalesce(p.frame_id, -1) AS pair_frame, d.positive FROM (
  SELECT e.*, v.video_id AS pair_key, CASE WHEN positive THEN CASE WHEN high > low THEN low + (draw + 4) % (high - low) ELSE pos END ELSE (draw + 5) % v.n END AS pair
  FROM (
    SELECT video_id, frame_id, pos, frame_id % 3 <> 0 AS positive, draw, greatest(pos - 5, 0) AS low, least(pos + 5, n) AS high,
      CASE WHEN frame_id % 3 <> 0 THEN k WHEN total > 1 THEN (k + 1 + (draw + 5) % greatest(total - 1, 1)) % total END AS other
    FROM (SELECT *, video_id * 31 + frame_id * 17 AS draw FROM placed) JOIN videos USING (video_id)
  ) e LEFT JOIN videos v ON v.k = e.other
) d LEFT JOIN placed p ON p.video_id = d.pair_key AND p.pos = d.pair""",
        placed="SELECT video_id, frame_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS pos FROM (SELECT DISTINCT video_id, frame_id FROM boxes)",
        videos="SELECT video_id, count(*) AS n, row_number() OVER (ORDER BY video_id) - 1 AS k, count(*) OVER () AS total FROM placed GROUP BY video_id",
    ),
)
def smp_7(spark, sf_dir):
    """Each frame with one near it in its video (two thirds), or with one of another video, by a known draw."""
    f = boxes(spark, sf_dir).select(*FRAME).distinct()
    draw = lambda name: F.col("video_id") * 31 + F.col("frame_id") * 17 + len(name)
    return A.sampled_pairs(f, positive=F.col("frame_id") % 3 != 0, draw=draw).fillna(-1, ["pair_key", "pair_frame"])


@query("SMP-7b", None)
def smp_7b(spark, sf_dir):
    """Each frame with its pair: of its video within five places with probability 0.8, else of another."""
    return A.sampled_pairs(boxes(spark, sf_dir).select(*FRAME).distinct())


# --- sources ------------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str, broken: bool = False) -> str:
    """A folder with an annotation document per video; with ``broken``, odd videos' documents lack their
    tracks, and their categories hold a number beside an object."""
    path = f"{scratch_dir(spark)}/documents-{uuid.uuid4().hex}"
    b = boxes(spark, sf_dir)
    image = F.col("video_id") * 50 + F.col("frame_id")
    rows = b.groupBy("video_id", "frame_id").agg(F.collect_list(F.struct(F.col("ord").alias("id"), image.alias("image_id"), "video_id", "track_id", "category_id", F.array("x1", "y1", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"))).alias("a"))
    picture = F.struct(image.alias("id"), "video_id", F.col("frame_id").alias("frame_index"), "frame_id", F.lit(640).alias("width"), F.lit(480).alias("height"))
    per = rows.groupBy("video_id").agg(F.collect_list(picture).alias("images"), F.flatten(F.collect_list("a")).alias("annotations"))
    video = F.array(F.struct(F.col("video_id").alias("id"), F.concat(F.lit("v"), "video_id").alias("name"), F.lit(640).alias("width"), F.lit(480).alias("height")))
    odd = (F.col("video_id") % 2 == 1) & F.lit(broken)
    category = F.when(odd, F.lit('{"id": 0}, 7')).otherwise(F.lit('{"id": 0}'))
    body = F.concat(F.lit('{"videos": '), F.to_json(video), F.lit(', "images": '), F.to_json("images"), F.lit(', "annotations": '), F.to_json("annotations"), F.lit(', "categories": ['), category, F.when(odd, F.lit("]}")).otherwise(F.lit('], "tracks": []}')))
    per.select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("SRC-1", oracle("SELECT section, ids, n, area FROM (SELECT 'videos' AS section, count(DISTINCT video_id) AS ids, count(DISTINCT video_id) AS n, 0.0::DOUBLE AS area FROM boxes UNION ALL SELECT 'images', count(DISTINCT (video_id, frame_id)), count(DISTINCT (video_id, frame_id)), 0.0 FROM boxes UNION ALL SELECT 'annotations', count(DISTINCT ord), count(*), sum(w * h) FROM boxes UNION ALL SELECT 'categories', 1, count(DISTINCT video_id), 0.0 FROM boxes)"))
def src_1(spark, sf_dir):
    """Annotation documents, one per video, read into typed rows: ids, rows and areas by section."""
    rows = Dataset.read(spark, _documents(spark, sf_dir)).rows
    return rows.groupBy("section").agg(F.count_distinct("id").alias("ids"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"))


@query("SRC-2", oracle("SELECT kind, section, n FROM (SELECT 'record_not_object' AS kind, NULL::VARCHAR AS section UNION ALL SELECT 'missing_top_level_field', 'tracks'), (SELECT count(DISTINCT video_id) AS n FROM boxes WHERE video_id % 2 = 1) WHERE n > 0".replace("NULL::VARCHAR", "'categories'")))
def src_2(spark, sf_dir):
    """Shape problems of documents whose sections hold what they should not, or are not there."""
    issues = Dataset.read(spark, _documents(spark, sf_dir, broken=True)).issues()
    return issues.groupBy("kind", "section").agg(F.count(F.lit(1)).alias("n"))


@query("SRC-3", oracle("SELECT video_id * 50 + frame_id AS image, count(*) AS n, min(ord) AS first FROM boxes GROUP BY ALL"))
def src_3(spark, sf_dir):
    """The image-to-annotations index of documents, as a join of the last row of each id."""
    d = Dataset.read(spark, _documents(spark, sf_dir))
    number = lambda c: F.substring(c, 3, 20).cast("long")
    images = d.index("images", last=True).select(F.col("id").alias("image_id"))
    joined = images.join(d.index("annotations", last=True).select("image_id", F.col("id")), "image_id")
    return joined.groupBy(number("image_id").alias("image")).agg(F.count(F.lit(1)).alias("n"), F.min(number(F.col("id"))).alias("first"))


@query("SRC-4", oracle("SELECT frame_id FROM (SELECT DISTINCT frame_id FROM boxes WHERE video_id = 1)"))
def src_4(spark, sf_dir):
    """The frames of one video in order."""
    return dataset(spark, sf_dir).frames_of(["i:1"]).select("frame_id")


@query("SRC-5", oracle("SELECT ord FROM boxes WHERE category_id IN (1, 2) AND CASE WHEN ord % 97 = 0 THEN 1.0 ELSE w * h END > 1000 AND CASE WHEN ord % 97 = 0 THEN 1.0 ELSE w * h END < 3000"))
def src_5(spark, sf_dir):
    return dataset(spark, sf_dir).annotation_ids(categories=["i:1", "i:2"], area=(1000.0, 3000.0), iscrowd=False).select("ord")


@query("SRC-6", oracle("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lpad(p_partkey::VARCHAR, 12, '0') || '.jpg' ELSE 'x' || p_partkey || '.jpg' END AS file_name FROM part"))
def src_6(spark, sf_dir):
    """Long still-image names cut to their last 16 characters."""
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("COCO_train2017_"), F.lpad(k.cast("string"), 12, "0"), F.lit(".jpg"))).otherwise(F.concat(F.lit("x"), k.cast("string"), F.lit(".jpg")))
    return read(spark, sf_dir, "part").select("p_partkey", still_image_name(name).alias("file_name"))


@query("SRC-7", oracle("SELECT video_id, count(*) AS n FROM (SELECT DISTINCT video_id, frame_id FROM boxes WHERE frame_id % 5 = 0) GROUP BY video_id"))
def src_7(spark, sf_dir):
    """Video frames to load when only original ones are selected."""
    images = dataset(spark, sf_dir).index("images")
    return training_frames(images, 1, 0, original_only=True).join(images.select("id", "video_id"), "id").groupBy(F.substring("video_id", 3, 20).cast("long").alias("video_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SRC-8", oracle("SELECT video_id, count(*) AS n FROM (SELECT DISTINCT video_id, frame_id FROM boxes WHERE frame_id % 3 = 0) GROUP BY video_id"))
def src_8(spark, sf_dir):
    """Video frames to load by stride alone."""
    images = dataset(spark, sf_dir).index("images")
    return training_frames(images, 3).join(images.select("id", "video_id"), "id").groupBy(F.substring("video_id", 3, 20).cast("long").alias("video_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SRC-9", oracle("SELECT label, 's:c' || k AS name, 'i:' || k AS id, n FROM (VALUES (0, 2), (1, 0)) v(label, k) JOIN (SELECT category_id, count(*) AS n FROM boxes GROUP BY 1) ON category_id = k"))
def src_9(spark, sf_dir):
    """Classes in the order asked for, with the number of their annotations."""
    d = dataset(spark, sf_dir)
    classes = d.ordered_classes(["c2", "c0"]).withColumn("label", F.col("label").cast("int"))
    sizes = d.section("annotations").groupBy(F.col("category_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return classes.join(sizes, "id").select("label", "name", "id", "n")


@query("SRC-10", oracle("SELECT user_id, chunk, count(*) AS n FROM (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS chunk, count(*) OVER (PARTITION BY user_id) AS a FROM events) WHERE a > 40 AND chunk < a // 16 GROUP BY user_id, chunk"))
def src_10(spark, sf_dir):
    """Sequences longer than 40 in full chunks of 16."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id")
    return A.chunked(e, 16, 40, "user_id", "event_id").groupBy("user_id", "chunk").agg(F.count(F.lit(1)).alias("n"))


@query("SRC-11", oracle("SELECT page_id, 'c/' || page_id || '.jpg' AS lasot, page_id || '.jpg' AS lvis FROM pages"))
def src_11(spark, sf_dir):
    """Keys of blob stores in different layouts."""
    p = F.concat(F.lit("a/b/c/"), F.col("page_id").cast("string"), F.lit(".jpg"))
    return read(spark, sf_dir, "pages").select("page_id", S.blob_keys(p, "lasot").alias("lasot"), S.blob_keys(p, "lvis").alias("lvis"))


@query("SRC-14", oracle("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"))
def src_14(spark, sf_dir):
    """Coverage: what the manifest does not list."""
    return S.uncovered(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


@query("SRC-15", oracle("SELECT DISTINCT lower(regexp_replace(p_name, ' ', ' ')) AS name FROM part"))
def src_15(spark, sf_dir):
    """A vocabulary from names in CamelCase with numbers at their end."""
    camel = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.initcap(w)), "")
    name = F.concat(camel, F.col("p_partkey").cast("string"), F.lit(".jpg"))
    return read(spark, sf_dir, "part").select(S.class_name(name).alias("name")).distinct()


@query("SRC-16", oracle("SELECT layout, 'i:' || id AS category_id, novel AS is_novel FROM (SELECT 'a' AS layout, n_nationkey AS id, n_regionkey = 3 AS novel FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT 'b', n_nationkey, n_regionkey = 3 FROM nation UNION ALL SELECT 'c', n_nationkey, n_regionkey = 3 FROM nation)"))
def src_16(spark, sf_dir):
    """Category splits in three layouts; categories without a frequency are left out."""
    n = read(spark, sf_dir, "nation")
    path = f"{scratch_dir(spark)}/splits-{uuid.uuid4().hex}"
    frequency = F.element_at(F.array(F.lit(None).cast("string"), F.lit("c"), F.lit("f"), F.lit("r"), F.lit("c")), (F.col("n_regionkey") + 1).cast("int"))
    novel = F.col("n_regionkey") == 3
    ids = lambda of: F.to_json(F.collect_list(F.when(of, F.col("n_nationkey"))))
    texts = n.agg(
        F.concat(F.lit('{"categories": '), F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), frequency.alias("frequency")))), F.lit("}")).alias("a"),
        F.concat(F.lit('{"base_category_ids": '), ids(~novel), F.lit(', "novel_category_ids": '), ids(novel), F.lit("}")).alias("b"),
        F.concat(F.lit('{"base": '), ids(~novel), F.lit(', "novel": '), ids(novel), F.lit("}")).alias("c"),
    )
    texts.unpivot([], ["a", "b", "c"], "layout", "value").write.partitionBy("layout").text(path)
    rows, _ = X.category_splits(X.documents(spark, f"{path}/*"))
    return rows.select(F.regexp_extract("path", "layout=([a-c])", 1).alias("layout"), "category_id", "is_novel")


@query("SRC-17", oracle("SELECT 'i:' || n_regionkey AS video_id, 'i:' || n_nationkey AS frame_key, 's:' || n_name AS track_id, 'i:2' AS category_id, CASE WHEN n_regionkey = 2 THEN 'blurred' ELSE 'declared filter' END AS reason FROM nation WHERE n_regionkey <> 1"))
def src_17(spark, sf_dir):
    """Manifests of known filtered anchors, one per region; entries without a whole key are left out."""
    n = read(spark, sf_dir, "nation")
    path = f"{scratch_dir(spark)}/manifests-{uuid.uuid4().hex}"
    entry = F.struct(F.col("n_regionkey").alias("video_id"), F.col("n_nationkey").alias("frame_id"), F.col("n_name").alias("track_id"), F.when(F.col("n_regionkey") != 1, 2).alias("category_id"), F.when(F.col("n_regionkey") == 2, "blurred").alias("reason"))
    listed = n.groupBy("n_regionkey").agg(F.to_json(F.collect_list(entry)).alias("value"))
    value = F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.lit('{"filtered_anchors": '), "value", F.lit("}"))).otherwise(F.col("value"))
    listed.select("n_regionkey", value.alias("value")).write.partitionBy("n_regionkey").text(path)
    return X.known_anchors(X.documents(spark, f"{path}/*"))[0].drop("path")


@query("SRC-18", oracle("SELECT n_name AS name, 'data/' || n_name || '.json' AS ann_file, n_nationkey AS interval FROM nation"))
def src_18(spark, sf_dir):
    """Options of the last matching call in a configuration, which is parsed and never run."""
    n = read(spark, sf_dir, "nation")
    path = f"{scratch_dir(spark)}/configurations-{uuid.uuid4().hex}"
    call = lambda folder, interval: F.concat(F.lit("a"), "n_nationkey", F.lit(f" = dict(ann_file='{folder}/"), "n_name", F.lit(".json', interval="), interval, F.lit(", f=open('no'))"))
    calls = n.select(F.explode(F.array(F.struct(F.lit(0).alias("k"), call("old", F.lit("-1")).alias("line")), F.struct(F.lit(1).alias("k"), call("data", F.col("n_nationkey").cast("string")).alias("line")))).alias("c"))
    calls.agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.line), "\n").alias("value")).write.text(path)
    asked = X.documents(spark, path, "part-*").filter("text <> ''").crossJoin(n.select("n_name", F.concat("n_name", F.lit(".json")).alias("file")))  # one configuration
    found = X.configured(asked.select("path", "text", "file"))
    return found.select(F.regexp_replace("file", ".json$", "").alias("name"), "ann_file", "interval")


@query("SRC-19", oracle("SELECT dataset, copy, count(*) AS n FROM (SELECT 0 AS dataset FROM supplier UNION ALL SELECT 1 FROM nation), range(0, 2) r(copy) GROUP BY ALL"))
def src_19(spark, sf_dir):
    """Two datasets put together, and the whole repeated."""
    s, n = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    both = A.repeated(S.concatenated(s, n), 2)
    return both.groupBy("dataset", F.col("copy").cast("long").alias("copy")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SRC-19b",
    oracle("SELECT user_id, CAST(max(ceil(greatest(1.0, sqrt(0.9 / (n / t))))) AS BIGINT) AS factor FROM (SELECT DISTINCT user_id, event_type FROM events) JOIN (SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1) USING (event_type), (SELECT count(DISTINCT user_id) AS t FROM events) GROUP BY user_id"),
)
def src_19b(spark, sf_dir):
    """Repeat factors that balance classes."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), F.col("event_type").alias("category_id"))
    return A.balance_factors(e, 0.9).withColumnRenamed("image_id", "user_id")


@query("SRC-13", oracle("SELECT CASE WHEN s_nationkey <> 7 THEN 'frame ' || s_suppkey || '.jpg' END AS file_name, s_nationkey = 7 AS corrupt, count(*) AS n FROM supplier GROUP BY ALL"))
def src_13(spark, sf_dir):
    """Detection files, one object each, some of which cannot be parsed: kept and marked."""
    path = f"{scratch_dir(spark)}/detections-{uuid.uuid4().hex}"
    name = F.concat(F.lit("frame "), F.col("s_suppkey"), F.lit(".jpg"))
    text = F.when(F.col("s_nationkey") == 7, F.lit("{broken")).otherwise(F.to_json(F.struct(name.alias("file_name"), F.array().cast("array<double>").alias("boxes"))))
    S.write_files(read(spark, sf_dir, "supplier").select(F.lit(None).alias("folder"), text.alias("value")), path)
    return S.detection_manifest(spark, f"{path}/*").groupBy("file_name", "corrupt").agg(F.count(F.lit(1)).alias("n"))


@query("SRC-21", oracle("SELECT 'v' || (s_nationkey % 5) AS video, count(*) AS files, count(*) FILTER (s_suppkey % 9 = 0) AS corrupt, sum(CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey % 4 ELSE 0 END)::BIGINT AS boxes FROM supplier WHERE s_nationkey % 5 IN (1, 3) GROUP BY 1"))
def src_21(spark, sf_dir):
    """Detection files in folders of videos, through the library's data source; two videos are asked for."""
    detection_files.register(spark)
    path = f"{scratch_dir(spark)}/folders-{uuid.uuid4().hex}"
    corner = F.transform(F.sequence(F.lit(1), F.col("s_suppkey") % 4), lambda k: F.array(k.cast("double"), F.lit(0.0), k + 1.0, F.lit(1.0), F.lit(0.5), F.lit(0.0)))
    some = F.when(F.col("s_suppkey") % 4 == 0, F.array().cast("array<array<double>>")).otherwise(corner)
    text = F.when(F.col("s_suppkey") % 9 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.concat(F.lit("frame "), "s_suppkey", F.lit(".jpg")).alias("file_name"), some.alias("boxes"))))
    S.write_files(read(spark, sf_dir, "supplier").select(F.concat(F.lit("v"), F.col("s_nationkey") % 5).alias("folder"), text.alias("value")), path)
    rows = spark.read.format("detections").option("files_per_task", 50).load(path).filter("video IN ('v1', 'v3')")
    return rows.groupBy("video").agg(F.count("*").alias("files"), F.count_if("corrupt").alias("corrupt"), F.sum(F.coalesce(F.size("boxes"), F.lit(0)).cast("long")).alias("boxes"))


# --- sinks --------------------------------------------------------------------------------------


def _predictions(spark, sf_dir) -> DataFrame:
    b = boxes(spark, sf_dir).withColumn("image_id", F.col("video_id") * 50 + F.col("frame_id"))
    return b.withColumn("track_id", F.when(F.col("ord") % 6 == 0, -1).otherwise(F.col("track_id") % 50)).withColumn("label", F.col("category_id"))


@query("SNK-1", oracle(f"SELECT 'FAIL' AS status, (SELECT count(*) FROM boxes) AS annotations, (SELECT sum(n)::BIGINT FROM ({_FINDINGS}) WHERE kind <> 'bbox_boundary_overshoot_within_tolerance') AS errors, (SELECT count(*) FROM boxes WHERE ord % 97 = 0 AND (ord % 101 = 0 OR {_INSIDE})) AS area_mismatch, (SELECT string_agg('i:' || ord, ',' ORDER BY ord) FROM (SELECT ord FROM boxes WHERE ord % 101 = 0 ORDER BY ord LIMIT 20)) AS examples"))
def snk_1(spark, sf_dir):
    """The report of the checks, as JSON text: status, counts, and the ids in a kind's examples."""
    report = Checks(dataset(spark, sf_dir)).report()
    text = spark.createDataFrame([(json.dumps(report, sort_keys=True, allow_nan=False),)], "r string")
    at = lambda path, kind="long": F.get_json_object("r", path).cast(kind)
    ids = F.array_join(F.from_json(at("$.hard_errors.examples.annotation_image_reference_missing[*].id", "string"), "array<string>"), ",")
    return text.select(at("$.status", "string").alias("status"), at("$.counts.annotations").alias("annotations"), at("$.hard_errors.total").alias("errors"), at("$.hard_errors.by_type.area_mismatch").alias("area_mismatch"), ids.alias("examples"))


@query("SNK-2", oracle("SELECT 'low_iou' AS flag_type, '0.9' AS threshold, count(*) AS n FROM steps WHERE " + f"{_I} / ({_A} + {_B} - {_I}) < 0.9"))
def snk_2(spark, sf_dir):
    """Temporal flags written as CSV and read back."""
    path = f"{scratch_dir(spark)}/flags-{uuid.uuid4().hex}"
    o = boxes(spark, sf_dir).select("video_id", "track_id", F.col("frame_id").alias("image_id"), "ord", F.col("frame_id").alias("frame"), F.array("x1", "y1", "w", "h").alias("bbox"), F.lit(None).cast("double").alias("visibility"))
    K.write_flags(temporal_screens(o, _T).filter("flag_type = 'low_iou'"), path)
    return spark.read.option("header", True).csv(path).groupBy("flag_type", "threshold").agg(F.count(F.lit(1)).alias("n"))


@query("SNK-10", oracle("SELECT s_suppkey, CAST(2 AS BIGINT) AS n FROM supplier"))
def snk_10(spark, sf_dir):
    """A log table that two writers append to."""
    path = f"{scratch_dir(spark)}/log-{uuid.uuid4().hex}"
    for _ in range(2):
        K.append_log(read(spark, sf_dir, "supplier"), path)
    return spark.read.parquet(path).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("SNK-3", oracle("SELECT video_id * 50 + frame_id AS image_id, [x1, y1, w, h] AS bbox, score, category_id + 1 AS category_id FROM boxes"))
def snk_3(spark, sf_dir):
    labels = spark.range(5).select(F.col("id").alias("label"), (F.col("id") + 1).alias("category_id"))
    return K.detection_records(_predictions(spark, sf_dir), labels)


_KEPT = "SELECT *, track_id % 50 AS local_id FROM boxes WHERE ord % 6 <> 0"
_WIN = "SELECT track_id, category_id AS winner FROM (SELECT track_id, category_id, row_number() OVER (PARTITION BY track_id ORDER BY count(*) DESC, category_id) AS n FROM kept GROUP BY 1, 2) WHERE n = 1"
_SHIFT = "SELECT video_id, coalesce(sum(span) OVER (ORDER BY video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM (SELECT video_id, max(local_id) + 1 AS span FROM kept GROUP BY 1)"


@query("SNK-4", oracle("SELECT video_id * 50 + frame_id AS image_id, [x1, y1, w, h] AS bbox, score, winner AS category_id, video_id, local_id + shift AS track_id FROM kept JOIN votes USING (track_id) JOIN shifts USING (video_id)", kept=_KEPT, votes=_WIN, shifts=_SHIFT))
def snk_4(spark, sf_dir):
    return K.track_records(_predictions(spark, sf_dir))


@query("SNK-5", oracle("SELECT i.image_id, count(b.ord) AS n_labels, round(coalesce(sum(b.score), 0), 6) AS total FROM (SELECT DISTINCT video_id * 50 + frame_id AS image_id FROM boxes) i LEFT JOIN (SELECT *, video_id * 50 + frame_id AS image_id FROM boxes WHERE frame_id % 10 <> 0) b USING (image_id) GROUP BY i.image_id"))
def snk_5(spark, sf_dir):
    """Labels per image; images without predictions have empty lists."""
    p = _predictions(spark, sf_dir)
    images = p.select("image_id", F.concat(F.lit("f"), "image_id").alias("name"), F.concat(F.lit("v"), "video_id").alias("video_name"), F.col("frame_id").alias("frame_index")).distinct()
    categories = spark.range(5).select(F.col("id").alias("category_id"), F.concat(F.lit("c"), "id").alias("category"))
    out = K.image_labels(images, p.filter("frame_id % 10 <> 0"), categories)
    total = F.aggregate("labels", F.lit(0.0), lambda s, x: s + x["score"])
    return out.select("image_id", F.size("labels").cast("long").alias("n_labels"), F.round(total, 6).alias("total"))


def _class_names(spark) -> DataFrame:
    return spark.range(5).select(F.col("id").alias("category_id"), F.concat(F.lit("c"), "id").alias("category"))


@query("SNK-6", oracle("SELECT video_id * 50 + frame_id AS image_id, CAST(row_number() OVER (ORDER BY video_id * 50 + frame_id, category_id, ord) AS VARCHAR) AS id, 'c' || category_id AS category, score, x1, y1, x2, y2 FROM boxes"))
def snk_6(spark, sf_dir):
    return K.export_all(_predictions(spark, sf_dir), _class_names(spark), ["det"])["det"]


@query("SNK-6b", oracle("SELECT video_id * 50 + frame_id AS image_id, CAST(row_number() OVER (ORDER BY video_id * 50 + frame_id, category_id, ord) AS VARCHAR) AS id, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY category_id, ord) AS index, score FROM boxes"))
def snk_6b(spark, sf_dir):
    """Instances with their place in their image."""
    return K.export_all(_predictions(spark, sf_dir), _class_names(spark), ["ins_seg"])["ins_seg"]


@query("SNK-6c", oracle("SELECT video_id * 50 + frame_id AS image_id, video_id, frame_id AS frame_index, CAST(track_id % 50 AS VARCHAR) AS id, 'c' || category_id AS category, score, x1, y1, x2, y2 FROM boxes WHERE ord % 6 <> 0"))
def snk_6c(spark, sf_dir):
    """Labels of tracks."""
    return K.export_all(_predictions(spark, sf_dir), _class_names(spark), ["box_track"])["box_track"]


@query("SNK-6d", oracle("SELECT video_id * 50 + frame_id AS image_id, ord, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY score, ord) - 1 AS paint, category_id + 1 AS r, track_id % 50 AS a FROM boxes WHERE ord % 6 <> 0"))
def snk_6d(spark, sf_dir):
    """Paint order of the masks of tracks."""
    out = K.export_all(_predictions(spark, sf_dir), _class_names(spark), ["seg_track"])["seg_track"]
    return out.select("image_id", "ord", F.col("paint").cast("long").alias("paint"), "r", "a")


@query("SNK-7", oracle("SELECT video_id * 50 + frame_id AS image_id, ord, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY score, ord) - 1 AS paint, category_id + 1 AS r, (track_id >> 8) & 255 AS b, track_id & 255 AS a FROM boxes"))
def snk_7(spark, sf_dir):
    p = boxes(spark, sf_dir).withColumn("image_id", F.col("video_id") * 50 + F.col("frame_id"))
    return K.mask_order(p).drop("g").withColumn("paint", F.col("paint").cast("long"))


@query("SNK-8", oracle("SELECT count(*) AS n, count(DISTINCT track_id) AS tracks FROM boxes WHERE ord % 6 <> 0"))
def snk_8(spark, sf_dir):
    out = K.format_results(_predictions(spark, sf_dir), "track")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("track_id").alias("tracks"))


@query("SNK-9", oracle("SELECT section, id, image_id, coalesce(frame_id, -1) AS frame_id, place FROM (SELECT 'videos' AS section, 'i:' || video_id AS id, NULL AS image_id, NULL::BIGINT AS frame_id, video_id AS place FROM (SELECT DISTINCT video_id FROM boxes) UNION ALL SELECT 'images', 'i:' || (video_id * 50 + frame_id), NULL, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1, row_number() OVER (ORDER BY video_id, frame_id) - 1 FROM (SELECT DISTINCT video_id, frame_id FROM boxes) UNION ALL SELECT 'annotations', 'i:' || ord, 'i:' || (video_id * 50 + frame_id), NULL, row_number() OVER (ORDER BY ord) - 1 FROM boxes)"))
def snk_9(spark, sf_dir):
    """A converted dataset, its frames numbered anew and its annotations with an instance each, written
    as one document and read back."""
    b = boxes(spark, sf_dir)
    image = F.col("video_id") * 50 + F.col("frame_id")
    frames = A.dense_frames(b.select(*FRAME).distinct().select(image.alias("id"), "video_id", (F.col("frame_id") * 30).alias("frame_index")))
    ranges = frames.groupBy(F.col("video_id").alias("id")).agg(F.max("frame_range").alias("frame_range"))
    annotations = b.select("ord", F.col("ord").alias("id"), image.alias("image_id"), "video_id", "track_id", F.col("track_id").alias("instance_id"), "category_id", F.array("x1", "y1", "w", "h").alias("bbox"))
    path = f"{scratch_dir(spark)}/converted-{uuid.uuid4().hex}.json"
    K.write_document({"videos": ranges.orderBy("id"), "images": frames.orderBy("id"), "annotations": annotations.orderBy("ord").drop("ord")}, path)
    rows = Dataset.read(spark, path).rows.filter("section IN ('videos', 'images', 'annotations')")
    return rows.select("section", "id", "image_id", F.coalesce("frame_id", F.lit(-1)).alias("frame_id"), F.col("ord").alias("place"))


# --- text and logs ------------------------------------------------------------------------------


@query("STR-1", oracle("SELECT page_id, regexp_extract(url, '[^/]*$') AS base, replace(url, '/', '-') AS flat FROM pages"))
def str_1(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.substring_index("url", "/", -1).alias("base"), F.replace("url", F.lit("/"), F.lit("-")).alias("flat"))


@query("STR-2", oracle("SELECT p_partkey, format('{:<10.3f} {:<10}', p_size / 8.0::DOUBLE, p_brand) AS line FROM part"))
def str_2(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.format_string("%-10.3f %-10s", F.col("p_size") / 8, F.col("p_brand")).alias("line"))


def nonfinite_numbers(text: Column) -> Column:
    """How many numbers of a JSON text are NaN or infinite, also by an exponent too large; texts inside don't count."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', '""')
    large = F.filter(F.regexp_extract_all(bare, F.lit("(-?[0-9][0-9.]*[eE][0-9+-]+)")), lambda n: F.abs(n.cast("double")) == float("inf"))
    return F.regexp_count(bare, F.lit("NaN|Infinity")) + F.size(large)


@query("JSN-1", oracle("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 2 WHEN event_id % 10 = 1 THEN 3 ELSE 0 END AS n FROM events"))
def jsn_1(spark, sf_dir):
    """Numbers that are not finite, anywhere in a document."""
    e = read(spark, sf_dir, "events")
    third = F.col("event_id") % 10
    odd = F.when(third == 0, '{"a": [NaN, 1], "b": {"c": -Infinity}}').when(third == 1, r'{"NaN": "Infinity \" NaN", "a": [1e999, -2.5E+400, 1e-999, 12], "b": NaN}')
    return e.select("event_id", nonfinite_numbers(odd.otherwise(F.col("props"))).alias("n"))


@query("JSN-2", oracle("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"))
def jsn_2(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_VALUES = "p_size / 8.0::DOUBLE + k"


def _log(spark, sf_dir, title) -> DataFrame:
    """A log block per part: three lines of ten values made of its size."""
    line = lambda add: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.col("p_size") / 8 + k + add)
    p = read(spark, sf_dir, "part")
    return p.select(G.log_block(title(F.col("p_partkey").cast("string")), {"Combined": line(0), "Base": line(1), "Novel": line(2)}).alias("text"))


def _log_oracle(keys: str, value: str) -> str:
    return f"""SELECT {keys}, category, (['TETA','LocS','AssocS','ClsS','LocRe','LocPr','AssocRe','AssocPr','ClsRe','ClsPr'])[k + 1] AS metric, {value} AS value
FROM part, (VALUES ('Combined', 0), ('Base', 1), ('Novel', 2)) c(category, a), range(0, 10) r(k)"""


_TEXT = "format('{:.3f}', p_size / 8.0::DOUBLE + k + a)"


@query("LOG-1", oracle(_log_oracle("p_partkey::VARCHAR AS max_instance", _TEXT)))
def log_1(spark, sf_dir):
    return G.top_k_log(_log(spark, sf_dir, lambda k: F.concat(F.lit("max_instance_per_cate: "), k)))


@query("LOG-2", oracle(_log_oracle("'work_dirs/c' || p_partkey || '.py' AS config, '7' AS epoch", _TEXT)))
def log_2(spark, sf_dir):
    return G.checkpoint_log(_log(spark, sf_dir, lambda k: F.concat(F.lit("work_dirs/c"), k, F.lit(".py\nepoch[7]:"))))


@query("LOG-3", oracle(_log_oracle("p_partkey::VARCHAR AS epoch, '0.37' AS match_score", _TEXT)))
def log_3(spark, sf_dir):
    return G.match_score_log(_log(spark, sf_dir, lambda k: F.concat(F.lit("epoch["), k, F.lit("], match score thres[0.37]:"))))


@query("LOG-4", oracle(_log_oracle("p_partkey::VARCHAR AS epoch, '0.37' AS match_score, '80' AS max_bbox", f"CAST({_TEXT} AS DOUBLE)")))
def log_4(spark, sf_dir):
    return G.search_log(_log(spark, sf_dir, lambda k: F.concat(F.lit("epoch["), k, F.lit("], match score thres[0.37], max bbox [80]:"))))


def _threshold_text(spark, sf_dir) -> DataFrame:
    return _log(spark, sf_dir, lambda k: F.concat(F.lit("epoch["), k, F.lit("], match score thres[0.5]:")))


@query("LOG-5", oracle(_log_oracle("p_partkey::VARCHAR AS epoch, '0.5' AS match_score", _TEXT)))
def log_5(spark, sf_dir):
    return G.threshold_log(_threshold_text(spark, sf_dir))


@query("SNK-11", oracle("SELECT p_partkey::VARCHAR AS epoch, '0.5' AS match_score, category, " + ", ".join(f"format('{{:.3f}}', p_size / 8.0::DOUBLE + {k} + a) AS \"{m}\"" for k, m in enumerate(G.METRICS)) + " FROM part, (VALUES ('Combined', 0), ('Base', 1), ('Novel', 2)) c(category, a)"))
def snk_11(spark, sf_dir):
    """A log as one wide row per line, ready for a CSV file."""
    return G.wide_lines(G.threshold_lines(_threshold_text(spark, sf_dir)), ["epoch", "match_score"])


@query("EVL-9", oracle("SELECT k, category_id, count(*) AS n FROM (SELECT category_id, row_number() OVER (PARTITION BY category_id ORDER BY score DESC, ord) AS r FROM boxes), (SELECT unnest([50, 100, 500]) AS k) WHERE r <= k GROUP BY ALL"))
def evl_9(spark, sf_dir):
    """A sweep over top-k limits in one pass: each row counts for all limits at or over its rank."""
    w = Window.partitionBy("category_id").orderBy(F.col("score").desc(), "ord")
    ranked = boxes(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r <= 500")
    limits = F.explode(F.array(*[F.lit(k) for k in (50, 100, 500)])).alias("k")
    return ranked.select("category_id", "r", limits).filter("r <= k").groupBy("k", "category_id").agg(F.count(F.lit(1)).alias("n"))


@query("EVL-10", oracle("SELECT s AS score_limit, m AS max_boxes, count(*) AS n FROM (SELECT s, m, row_number() OVER (PARTITION BY s, m, video_id, frame_id ORDER BY score DESC, ord) AS r FROM boxes, (SELECT unnest([0.37, 0.5]::DOUBLE[]) AS s), (SELECT unnest([5, 20]) AS m) WHERE score > s) WHERE r <= m GROUP BY ALL"))
def evl_10(spark, sf_dir):
    """A grid of score limits and box limits, one row of results per run."""
    grid = F.array(*[F.struct(F.lit(s).alias("score_limit"), F.lit(m).alias("max_boxes")) for s in (0.37, 0.5) for m in (5, 20)])
    runs = boxes(spark, sf_dir).withColumn("run", F.explode(grid)).select("*", "run.*").filter("score > score_limit")
    w = Window.partitionBy("score_limit", "max_boxes", *FRAME).orderBy(F.col("score").desc(), "ord")
    return runs.withColumn("r", F.row_number().over(w)).filter("r <= max_boxes").groupBy("score_limit", "max_boxes").agg(F.count(F.lit(1)).alias("n"))
