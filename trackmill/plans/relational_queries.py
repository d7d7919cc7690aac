"""Queries over filters, joins, aggregates, windows, top-k, set operations and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.functions.boxes import Box
from trackmill.operators import aggregates as A
from trackmill.operators import filters as L
from trackmill.operators import joins as J
from trackmill.registry import query
from trackmill.sources.adapters import boxes, oracle

box = Box.corners()
FRAME = ["video_id", "frame_id"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- filters ------------------------------------------------------------------------------------

_EFFECTIVE = "greatest(0.0, least(x2, {w}) - greatest(x1, 0.0)) * greatest(0.0, least(y2, {h}) - greatest(y1, 0.0)) <> 0 AND w * h > 0 AND w >= 1 AND h >= 1 AND NOT (ord % 11 = 0)"
#: Images small enough that some boxes lie outside.
_SMALL = _EFFECTIVE.format(w="400.0", h="300.0")


def _effective(df: DataFrame) -> DataFrame:
    return df.filter(L.effective(box, F.lit(400.0), F.lit(300.0), F.col("ord") % 11 == 0))


@query("FLT-1", oracle(f"SELECT ord, category_id, ord % 7 = 0 AS crowd FROM boxes WHERE {_SMALL} AND category_id IN (0, 1, 3)"))
def flt_1(spark, sf_dir):
    """Effective annotations of the selected categories; crowds are marked, to be ignored."""
    selected = spark.createDataFrame([(0,), (1,), (3,)], "category_id long")
    kept = _effective(boxes(spark, sf_dir)).join(F.broadcast(selected), "category_id", "left_semi")
    return kept.select("ord", "category_id", (F.col("ord") % 7 == 0).alias("crowd"))


@query("FLT-2", oracle(f"SELECT video_id, count(*) AS n FROM boxes WHERE {_SMALL} AND frame_id % 3 = 0 GROUP BY video_id"))
def flt_2(spark, sf_dir):
    """Effective annotations on training frames (each third), by video."""
    frames = A.strided(boxes(spark, sf_dir).select("video_id", "frame_id").distinct(), 3)
    kept = _effective(boxes(spark, sf_dir)).join(frames, FRAME, "left_semi")
    return kept.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))


@query("FLT-3", oracle(f"SELECT ord, x1, y1 FROM boxes WHERE NOT ({_SMALL})"))
def flt_3(spark, sf_dir):
    """The boxes whose diagnostics are suppressed, as training would drop them."""
    return boxes(spark, sf_dir).filter(~L.effective(box, F.lit(400.0), F.lit(300.0), F.col("ord") % 11 == 0)).select("ord", "x1", "y1")


@query("FLT-4", oracle("SELECT ord FROM (SELECT *, max(w >= 40 AND h >= 40) OVER (PARTITION BY video_id, frame_id) AS has_good FROM boxes) WHERE (w >= 40 AND h >= 40) OR NOT has_good"))
def flt_4(spark, sf_dir):
    return L.min_size(boxes(spark, sf_dir), box, 40, 40).select("ord")


@query("FLT-5", oracle("SELECT ord FROM boxes WHERE w >= 60 AND h >= 50"))
def flt_5(spark, sf_dir):
    return L.min_size(boxes(spark, sf_dir), box, 60, 50, keep_empty=False).select("ord")


@query("FLT-6", oracle("SELECT * FROM (SELECT ord, least(greatest(x1, 100.0), 300.0) - 100 AS x1, least(greatest(y1, 50.0), 250.0) - 50 AS y1, least(greatest(x2, 100.0), 300.0) - 100 AS x2, least(greatest(y2, 50.0), 250.0) - 50 AS y2 FROM boxes) WHERE x2 > x1 AND y2 > y1"))
def flt_6(spark, sf_dir):
    return L.cropped(boxes(spark, sf_dir), 100.0, 50.0, 300.0, 250.0).select("ord", "x1", "y1", "x2", "y2")


@query("FLT-7", oracle("SELECT ord, score > 0.5 AS detected, score > 0.8 AS starts, score < 0.3 AS skipped FROM boxes WHERE score > 0.05"))
def flt_7(spark, sf_dir):
    s = F.col("score")
    return boxes(spark, sf_dir).filter(s > 0.05).select("ord", (s > 0.5).alias("detected"), (s > 0.8).alias("starts"), (s < 0.3).alias("skipped"))


@query("FLT-8", oracle("SELECT ord, CASE WHEN s > 0.6 THEN 'high' WHEN s > 0.0001 AND s < 0.6 THEN 'low' ELSE 'none' END AS band FROM (SELECT ord, score / nullif(max(score) OVER (PARTITION BY video_id, frame_id), 0) AS s FROM boxes)"))
def flt_8(spark, sf_dir):
    return L.score_bands(boxes(spark, sf_dir), 0.6, 0.0001).select("ord", F.coalesce("band", F.lit("none")).alias("band"))


@query("FLT-9", oracle("SELECT ord FROM boxes WHERE CASE WHEN ord % 6 = 0 THEN -1 ELSE track_id END > -1"))
def flt_9(spark, sf_dir):
    found = boxes(spark, sf_dir).withColumn("track_id", F.when(F.col("ord") % 6 == 0, -1).otherwise(F.col("track_id")))
    return L.matched_only(found).select("ord")


@query("FLT-10", oracle("SELECT DISTINCT a.video_id, a.frame_id FROM boxes a JOIN boxes b ON a.video_id = b.video_id AND a.frame_id + 1 = b.frame_id AND a.track_id = b.track_id AND a.user_id = b.user_id"))
def flt_10(spark, sf_dir):
    """Pairs of neighbouring frames with at least one match."""
    b = boxes(spark, sf_dir)
    nxt = b.select("video_id", (F.col("frame_id") - 1).alias("frame_id"), "track_id", "user_id")
    return b.join(nxt, [*FRAME, "track_id", "user_id"], "left_semi").select(*FRAME).distinct()


@query("FLT-11", oracle("SELECT ord FROM boxes WHERE score > 1.001::DOUBLE / 5"))
def flt_11(spark, sf_dir):
    return L.above_class_chance(boxes(spark, sf_dir), 5).select("ord")


@query("FLT-12", oracle("SELECT ord FROM (SELECT *, max(CASE WHEN r = k THEN score END) OVER (PARTITION BY video_id, frame_id) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY score, ord) AS r, floor(count(*) OVER (PARTITION BY video_id, frame_id) * 0.3) AS k FROM boxes)) WHERE cut IS NULL OR score > cut"))
def flt_12(spark, sf_dir):
    return L.above_quantile(boxes(spark, sf_dir), 0.3).select("ord")


@query("FLT-13", oracle("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TRUE WHEN event_id % 3 = 1 THEN event_type <> 'click' ELSE FALSE END AS valid_id, value > 0 AS dimension, user_id >= 0 AS frame, TRUE AS bbox FROM events"))
def flt_13(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "integer").when(F.col("event_id") % 3 == 1, "string").otherwise("boolean")
    raw = F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))
    bbox = L.valid_bbox(F.array("value", "value", F.lit(1.0), F.lit(2.0)))
    return e.select("event_id", L.valid_id(raw, kind).alias("valid_id"), (L.finite(F.col("value")) & (F.col("value") > 0)).alias("dimension"), (F.col("user_id") >= 0).alias("frame"), bbox.alias("bbox"))


@query("FLT-14", oracle("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_id) > 60)"))
def flt_14(spark, sf_dir):
    return L.long_sequences(read(spark, sf_dir, "events"), 60, "user_id", "event_id").select("event_id")


# --- joins --------------------------------------------------------------------------------------


@query("JON-1", oracle("SELECT 'customer' AS kind, count(*) AS n FROM orders WHERE o_custkey % 13 = 0 UNION ALL SELECT 'label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"))
def jon_1(spark, sf_dir):
    """Missing references by kind."""
    customers = read(spark, sf_dir, "customer").filter("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("id"))
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "ref")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"))
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(J.missing_references(orders, "ref", customers), "customer").unionByName(count(J.missing_references(docs, "ref", labels), "label"))


@query("JON-2", oracle("SELECT c.c_custkey, n.n_nationkey IS NULL AS missing, coalesce(n.n_name <> 'NATION_' || (c.c_nationkey % 20), FALSE) AS mismatch, coalesce(c.c_custkey % 30 >= n.n_nationkey + 10, FALSE) AS outside FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 7) n ON c.c_nationkey = n.n_nationkey"))
def jon_2(spark, sf_dir):
    """A fact with its dimension: missing, of another name, beyond its length."""
    n = read(spark, sf_dir, "nation").filter("n_nationkey <> 7")
    c = read(spark, sf_dir, "customer")
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    name = F.concat(F.lit("NATION_"), (F.col("c_nationkey") % 20).cast("string"))
    return joined.select("c_custkey", F.col("n_nationkey").isNull().alias("missing"), F.coalesce(F.col("n_name") != name, F.lit(False)).alias("mismatch"), F.coalesce(F.col("c_custkey") % 30 >= F.col("n_nationkey") + 10, F.lit(False)).alias("outside"))


@query("JON-3", oracle("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)"))
def jon_3(spark, sf_dir):
    dim = read(spark, sf_dir, "nation").filter("n_regionkey <> 2")
    return J.missing_references(read(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "ref"), "ref", dim, "n_nationkey").select("s_suppkey")


_CHANGED = "SELECT CASE WHEN o_orderkey % 19 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey, o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 23 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 17 <> 0"


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey")
    changed = o.filter(k % 17 != 0).select(
        F.when(k % 19 == 0, k + 10000000).otherwise(k).alias("o_orderkey"),
        "o_custkey",
        F.when(k % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 23 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    return o, changed




def _diff(spark, sf_dir, key, filtered=None) -> DataFrame:
    o, changed = _versions(spark, sf_dir)
    compared = {"price": F.abs(F.col("r.o_totalprice") - F.col("c.o_totalprice")) <= 1e-4, "status": F.col("r.o_orderstatus").eqNullSafe(F.col("c.o_orderstatus"))}
    return J.anchor_diff(o, changed, key, compared, filtered)


_DIFF = """SELECT coalesce(r.o_orderkey, c.o_orderkey) AS o_orderkey, coalesce(r.o_custkey, c.o_custkey) AS o_custkey,
  CASE WHEN r.o_orderkey IS NULL THEN 'added' WHEN c.o_orderkey IS NULL THEN CASE WHEN r.o_orderkey % 34 = 0 THEN 'filtered' ELSE 'missing' END
    WHEN abs(r.o_totalprice - c.o_totalprice) > 1e-4 OR r.o_orderstatus <> c.o_orderstatus THEN 'modified' ELSE 'preserved' END AS outcome
FROM orders r FULL JOIN changed c ON r.o_orderkey = c.o_orderkey AND r.o_custkey = c.o_custkey"""


@query("JON-4", oracle(_DIFF, changed=_CHANGED))
def jon_4(spark, sf_dir):
    """Anchors of two versions on a composite key, with a manifest of known filtered ones."""
    listed = read(spark, sf_dir, "orders").filter("o_orderkey % 34 = 0")
    return _diff(spark, sf_dir, ["o_orderkey", "o_custkey"], listed).drop("changed")


@query("JON-5", oracle("SELECT outcome, count(*) AS n FROM (SELECT replace(outcome, 'filtered', 'missing') AS outcome FROM (" + _DIFF + ")) GROUP BY outcome", changed=_CHANGED))
def jon_5(spark, sf_dir):
    """Anchors of two versions on the raw id, counted by outcome."""
    return _diff(spark, sf_dir, ["o_orderkey"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("JON-6", oracle("SELECT c.o_orderkey AS id, CASE WHEN r.o_orderkey IS NULL THEN 'new' ELSE 'modified' END AS outcome FROM changed c LEFT JOIN orders r ON c.o_orderkey = r.o_orderkey WHERE r.o_orderkey IS NULL OR c.o_orderstatus IS DISTINCT FROM r.o_orderstatus", changed=_CHANGED))
def jon_6(spark, sf_dir):
    o, changed = (d.withColumnRenamed("o_orderkey", "id") for d in _versions(spark, sf_dir))
    return J.identity_diff(o, changed, ["o_orderstatus"])


@query("JON-7", oracle("SELECT o_orderkey, o_orderstatus FROM changed UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changed)", changed=_CHANGED))
def jon_7(spark, sf_dir):
    o, changed = (d.select("o_orderkey", "o_orderstatus") for d in _versions(spark, sf_dir))
    return J.overlaid(changed, o, "o_orderkey")


@query("JON-8", oracle("SELECT count(*) AS n FROM (SELECT CAST(s_suppkey AS VARCHAR) AS v FROM supplier INTERSECT SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0 UNION SELECT DISTINCT CAST(s_nationkey AS VARCHAR) || 'n' FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer))"))
def jon_8(spark, sf_dir):
    """The overlap of two splits by id and by name, in one value space."""
    s, c = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer")
    ids = s.select(F.col("s_suppkey").cast("string").alias("v")).intersect(c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string")))
    name = lambda k: F.concat(F.col(k).cast("string"), F.lit("n")).alias("v")
    names = s.select(name("s_nationkey")).intersect(c.select(name("c_nationkey")))
    return ids.union(names).distinct().agg(F.count(F.lit(1)).alias("n"))


@query("JON-9", oracle("SELECT c_custkey, n_regionkey AS c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 4 <> 0"))
def jon_9(spark, sf_dir):
    """Categories remapped by a small table; rows without an image go."""
    mapping = read(spark, sf_dir, "nation").filter("n_nationkey % 4 <> 0").selectExpr("n_nationkey AS old", "n_regionkey AS new")
    return J.remapped(read(spark, sf_dir, "customer"), "c_nationkey", mapping).select("c_custkey", "c_nationkey")


@query("JON-9b", oracle("SELECT c_custkey, list_transform(list_filter([c_nationkey, (c_nationkey + 1) % 25, 99], lambda x: x < 25 AND x % 4 <> 0), lambda x: CAST(x % 5 AS BIGINT)) AS mapped FROM customer"))
def jon_9b(spark, sf_dir):
    """The same for arrays, by a map of the small table's rows."""
    pairs = read(spark, sf_dir, "nation").filter("n_nationkey % 4 <> 0").select(F.struct("n_nationkey", (F.col("n_nationkey") % 5)).alias("p"))
    mapping = pairs.agg(F.map_from_entries(F.collect_list("p")).alias("m"))
    c = read(spark, sf_dir, "customer").crossJoin(F.broadcast(mapping))
    values = F.array(F.col("c_nationkey").cast("long"), ((F.col("c_nationkey") + 1) % 25).cast("long"), F.lit(99).cast("long"))
    return c.select("c_custkey", J.remapped_array(values, F.col("m").cast("map<bigint,bigint>")).alias("mapped"))


@query("JON-10", oracle("SELECT s_suppkey, n_name, r_name, s_suppkey AS instance_id FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"))
def jon_10(spark, sf_dir):
    dims = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf_dir, "supplier").join(dims, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name", F.col("s_suppkey").alias("instance_id"))


_SIDES = "SELECT video_id, frame_id AS pair, user_id % 40 - 2 AS instance_id, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY ord) - 1 AS idx, ord % 9 <> 0 AS kept FROM boxes"
_LEFT = "SELECT * FROM (" + _SIDES + ") WHERE pair < 49"
_RIGHT = "SELECT video_id, pair - 1 AS pair, instance_id, idx, kept FROM (" + _SIDES + ") WHERE pair > 0"
PAIR = ["video_id", "pair"]


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each frame beside the next one, with instance ids that repeat and some of zero or less."""
    w = Window.partitionBy(*FRAME).orderBy("ord")
    s = boxes(spark, sf_dir).select("video_id", F.col("frame_id").alias("pair"), (F.col("user_id") % 40 - 2).alias("instance_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"), (F.col("ord") % 9 != 0).alias("kept"))
    return s.filter("pair < 49"), s.filter("pair > 0").withColumn("pair", F.col("pair") - 1)


_MATCH = "SELECT l.video_id, l.pair, l.idx, coalesce((SELECT min(r.idx) FROM r WHERE r.video_id = l.video_id AND r.pair = l.pair AND r.instance_id = l.instance_id{more}), -1) AS match, l.kept FROM l"


@query("JON-11", oracle("SELECT video_id, pair, idx, match FROM (" + _MATCH.format(more="") + ")", l=_LEFT, r=_RIGHT))
def jon_11(spark, sf_dir):
    return J.instance_matches(*_sides(spark, sf_dir), PAIR)


@query("JON-12", oracle("SELECT video_id, pair, idx, match FROM (" + _MATCH.format(more=" AND r.instance_id > 0") + ")", l=_LEFT, r=_RIGHT))
def jon_12(spark, sf_dir):
    return J.instance_matches(*_sides(spark, sf_dir), PAIR, positive_only=True)


@query("JON-13", oracle("SELECT video_id, pair, idx, CASE WHEN instance_id = -1 THEN -1 ELSE match END AS match FROM (" + _MATCH.format(more="").replace("l.kept", "l.instance_id") + ")", l=_LEFT, r=_RIGHT))
def jon_13(spark, sf_dir):
    """Assigned indices on both sides, of which -1 matches nothing."""
    left, right = _sides(spark, sf_dir)
    return J.instance_matches(left, right.filter("instance_id <> -1"), PAIR)


@query(
    "JON-14",
    oracle(
        """SELECT m.video_id, m.pair, m.new_idx AS idx, coalesce(k.new_idx, -1) AS match
FROM (SELECT *, row_number() OVER (PARTITION BY video_id, pair ORDER BY idx) - 1 AS new_idx FROM m WHERE kept) m
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY video_id, pair ORDER BY idx) - 1 AS new_idx FROM r WHERE kept) k ON m.video_id = k.video_id AND m.pair = k.pair AND m.match = k.idx""",
        l=_LEFT,
        r=_RIGHT,
        m=_MATCH.format(more=""),
    ),
)
def jon_14(spark, sf_dir):
    """Matches after rows have been dropped on both sides."""
    left, right = _sides(spark, sf_dir)
    matched = left.join(J.instance_matches(left, right, PAIR), [*PAIR, "idx"])
    return J.repaired_matches(matched, right, PAIR)


@query(
    "JON-14b",
    oracle(
        "SELECT m.video_id, m.pair, m.idx, CASE WHEN m.match >= 0 THEN m.match + CAST(s.shift AS BIGINT) ELSE m.match END AS match FROM m JOIN (SELECT video_id, pair, coalesce(sum(n) OVER (PARTITION BY video_id ORDER BY pair ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM (SELECT video_id, pair, count(*) AS n FROM r GROUP BY ALL)) s ON m.video_id = s.video_id AND m.pair = s.pair",
        l=_LEFT,
        r=_RIGHT,
        m=_MATCH.format(more=""),
    ),
)
def jon_14b(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    sizes = right.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    return J.concatenated_matches(J.instance_matches(left, right, PAIR), "video_id", "pair", sizes).select(*PAIR, "idx", "match")


_OVERLAP = "SELECT a.video_id, a.frame_id, a.ord AS i, b.ord AS j, inter / (a.w * a.h + b.w * b.h - inter) AS iou FROM boxes a JOIN boxes b ON a.video_id = b.video_id AND a.frame_id = b.frame_id AND a.ord < b.ord{more}, LATERAL (SELECT greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter) WHERE inter > 0"


@query("JON-15", oracle(_OVERLAP.format(more="")))
def jon_15(spark, sf_dir):
    return J.overlaps(boxes(spark, sf_dir), FRAME)


@query("JON-15b", oracle(_OVERLAP.format(more="")))
def jon_15b(spark, sf_dir):
    """The same by shared grid cells."""
    return J.overlaps(boxes(spark, sf_dir), FRAME, cell=100.0)


@query("JON-16", oracle(_OVERLAP.format(more=" AND a.category_id = b.category_id")))
def jon_16(spark, sf_dir):
    return J.overlaps(boxes(spark, sf_dir), FRAME, same_category=True)


@query("JON-18", oracle("SELECT a.video_id, a.frame_id, a.ord AS i, b.ord AS j, CAST(a.user_id = b.user_id AS BIGINT) AS target, max(CAST(a.user_id = b.user_id AS BIGINT)) OVER (PARTITION BY a.ord) AS weight FROM boxes a JOIN boxes b ON a.video_id = b.video_id AND a.frame_id + 1 = b.frame_id"))
def jon_18(spark, sf_dir):
    """The target matrix of neighbouring frames: same instance or not, and whether a row has any."""
    b = boxes(spark, sf_dir).select(*FRAME, "ord", "user_id")
    nxt = b.select("video_id", (F.col("frame_id") - 1).alias("frame_id"), F.col("ord").alias("j"), F.col("user_id").alias("other"))
    same = (F.col("user_id") == F.col("other")).cast("long")
    pairs = b.join(nxt, FRAME).select(*FRAME, F.col("ord").alias("i"), "j", same.alias("target"))
    return pairs.withColumn("weight", F.max("target").over(Window.partitionBy("i")))


@query(
    "JON-19",
    oracle(
        "SELECT video_id, frame_id, gt, arg_max(detection, {'iou': iou, 'o': -detection}) AS detection, max(iou) AS iou FROM (SELECT g.video_id, g.frame_id, g.ord AS gt, d.ord AS detection, inter / (g.w * g.h + d.w * d.h - inter) AS iou FROM boxes g JOIN boxes d ON g.video_id = d.video_id AND g.frame_id = d.frame_id AND g.ord % 2 = 0 AND d.score > 0.3, LATERAL (SELECT greatest(0.0, least(g.x2, d.x2) - greatest(g.x1, d.x1)) * greatest(0.0, least(g.y2, d.y2) - greatest(g.y1, d.y1)) AS inter)) WHERE iou >= 0.5 GROUP BY ALL"
    ),
)
def jon_19(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return J.best_matches(b.filter("ord % 2 = 0"), b.filter("score > 0.3"), FRAME)


@query("JON-20", oracle("SELECT a.video_id, a.frame_id, b.frame_id AS ref FROM f a JOIN f b ON a.video_id = b.video_id AND abs(a.n - b.n) <= 3 AND a.n <> b.n", f="SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) AS n FROM (SELECT DISTINCT video_id, frame_id FROM boxes)"))
def jon_20(spark, sf_dir):
    return J.frame_window(boxes(spark, sf_dir), 3)


# --- aggregations -------------------------------------------------------------------------------

_MODE = "SELECT track_id, category_id AS winner FROM (SELECT track_id, category_id, row_number() OVER (PARTITION BY track_id ORDER BY count(*) DESC, category_id) AS n FROM boxes WHERE ord % 21 <> 0 GROUP BY track_id, category_id) WHERE n = 1"


@query("AGG-1", oracle("SELECT ord, track_id, winner AS category_id FROM boxes JOIN votes USING (track_id) WHERE ord % 21 <> 0", votes=_MODE))
def agg_1(spark, sf_dir):
    """Majority category per track; every 21st box has no track."""
    b = boxes(spark, sf_dir).withColumn("track_id", F.when(F.col("ord") % 21 != 0, F.col("track_id")))
    return A.majority_category(b).select("ord", "track_id", "category_id")


_ERRORS = "SELECT ord, CASE WHEN x2 > 600 THEN 'bbox_out_of_bounds' WHEN w < 22 THEN 'small_box' ELSE 'low_score' END AS kind, CASE WHEN x2 > 600 OR w < 22 THEN 'bbox' ELSE 'schema' END AS grp FROM boxes WHERE x2 > 600 OR w < 22 OR score < 0.01"


def _errors(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("x2") > 600, "bbox_out_of_bounds").when(F.col("w") < 22, "small_box").otherwise("low_score")
    group = F.when((F.col("x2") > 600) | (F.col("w") < 22), "bbox").otherwise("schema")
    return boxes(spark, sf_dir).filter("x2 > 600 OR w < 22 OR score < 0.01").select("ord", kind.alias("kind"), group.alias("group"))


@query("AGG-2", oracle("SELECT g AS \"group\", count(ord) AS n FROM (VALUES ('bbox'), ('schema'), ('anchor')) v(g) LEFT JOIN errors ON grp = g GROUP BY g", errors=_ERRORS))
def agg_2(spark, sf_dir):
    groups = spark.createDataFrame([("bbox",), ("schema",), ("anchor",)], "group string")
    return A.error_counts(_errors(spark, sf_dir), groups)


@query("AGG-3", oracle("SELECT kind, ord FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ord) AS n FROM errors) WHERE n <= 20", errors=_ERRORS))
def agg_3(spark, sf_dir):
    return A.first_examples(_errors(spark, sf_dir), 20).select("kind", "ord")


@query("AGG-4", oracle("SELECT count(*) AS annotations, count(DISTINCT track_id) AS tracks, count(DISTINCT video_id) AS videos FROM boxes"))
def agg_4(spark, sf_dir):
    return boxes(spark, sf_dir).agg(F.count(F.lit(1)).alias("annotations"), F.count_distinct("track_id").alias("tracks"), F.count_distinct("video_id").alias("videos"))


@query("AGG-5", oracle("SELECT count(*) FILTER (category_id IN (0, 1)) AS base, count(*) FILTER (category_id = 2) AS novel, count(*) FILTER (category_id > 2) AS unclassified FROM boxes"))
def agg_5(spark, sf_dir):
    split = spark.createDataFrame([(0, False), (1, False), (2, True)], "category_id long, is_novel boolean")
    return A.class_shares(boxes(spark, sf_dir), F.broadcast(split))


@query("AGG-6", oracle("SELECT field, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN abs(r.o_totalprice - c.o_totalprice) > 1e-4 THEN 'price' END, CASE WHEN r.o_orderstatus <> c.o_orderstatus THEN 'status' END], lambda x: x IS NOT NULL)) AS field FROM orders r JOIN changed c ON r.o_orderkey = c.o_orderkey) GROUP BY field", changed=_CHANGED))
def agg_6(spark, sf_dir):
    return A.changed_fields(_diff(spark, sf_dir, ["o_orderkey"]))


@query("AGG-7", oracle("SELECT n_nationkey AS id, count(s_suppkey) AS instance_count, count(DISTINCT s_suppkey % 10) AS image_count FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey <> 3) ON n_nationkey = s_nationkey GROUP BY 1"))
def agg_7(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").filter("s_nationkey <> 3").select(F.col("s_nationkey").alias("category_id"), (F.col("s_suppkey") % 10).alias("image_id"))
    return A.category_counts(s, read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "id"))


@query("AGG-8", oracle("SELECT DISTINCT category_id FROM boxes WHERE category_id IN (SELECT category_id FROM boxes WHERE frame_id % 2 = 0 UNION SELECT user_id % 3 FROM boxes)"))
def agg_8(spark, sf_dir):
    b = boxes(spark, sf_dir)
    used = b.filter("frame_id % 2 = 0").select("category_id").union(b.select(F.col("user_id") % 3)).distinct()
    return b.select("category_id").distinct().join(used, "category_id", "left_semi")


_METRICS = "SELECT category_id, CASE WHEN category_id >= 3 THEN 'novel' ELSE 'base' END AS split, avg(score) AS m1, avg(w) AS m2 FROM boxes GROUP BY 1, 2"


@query("AGG-9", oracle("SELECT split, round(avg(m1), 6) AS m1, round(avg(m2), 6) AS m2 FROM (SELECT split, m1, m2 FROM metrics UNION ALL SELECT 'combined', m1, m2 FROM metrics) GROUP BY split", metrics=_METRICS))
def agg_9(spark, sf_dir):
    """Means of class metrics over base, novel and all classes."""
    split = F.when(F.col("category_id") >= 3, "novel").otherwise("base")
    per = boxes(spark, sf_dir).groupBy("category_id", split.alias("split")).agg(F.avg("score").alias("m1"), F.avg("w").alias("m2"))
    return A.split_means(per, ["m1", "m2"]).select("split", F.round("m1", 6).alias("m1"), F.round("m2", 6).alias("m2"))


@query("AGG-11", oracle("SELECT coalesce(category, 'OVERALL') AS category, count(*) AS n, round(sum(value), 2) AS total FROM boxes GROUP BY ROLLUP (category)"))
def agg_11(spark, sf_dir):
    """Additive counts per class and over all classes, as a rollup."""
    r = boxes(spark, sf_dir).rollup("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return r.select(F.coalesce("category", F.lit("OVERALL")).alias("category"), "n", "total")


@query("AGG-12", oracle("SELECT video_id, frame_id, arg_max(ord, {'s': score, 'o': -ord}) AS best, max(score) AS score FROM boxes GROUP BY 1, 2"))
def agg_12(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy(*FRAME).agg(A.first_argmax("score", "ord").alias("best"), F.max("score").alias("score"))


@query("AGG-13", oracle("SELECT ord, round(score / nullif(max(score) OVER (PARTITION BY video_id, frame_id), 0), 6) AS scaled FROM boxes"))
def agg_13(spark, sf_dir):
    return L.score_bands(boxes(spark, sf_dir), 0.6, 0.1).select("ord", F.round("scaled", 6).alias("scaled"))


@query("AGG-14", oracle("SELECT frame_id, label FROM (SELECT frame_id, label, row_number() OVER (PARTITION BY frame_id ORDER BY count(*) DESC, label) AS n FROM vectors GROUP BY 1, 2) WHERE n = 1"))
def agg_14(spark, sf_dir):
    """The most frequent cluster of each frame, the lowest label of several."""
    from trackmill.sources.adapters import vectors

    return vectors(spark, sf_dir).groupBy("frame_id").agg(F.mode("label", True).alias("label"))


_LOCAL = "SELECT *, track_id % 50 AS local_id FROM boxes"
_UNIQUE = "SELECT video_id, CAST(coalesce(sum(span) OVER (ORDER BY video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM (SELECT video_id, max(local_id) + 1 AS span FROM locals GROUP BY 1)"


@query("AGG-15", oracle("SELECT video_id, max(local_id) AS top, shift FROM locals JOIN shifts USING (video_id) GROUP BY video_id, shift", locals=_LOCAL, shifts=_UNIQUE))
def agg_15(spark, sf_dir):
    """Each video's largest track id and the offset of its ids."""
    local = boxes(spark, sf_dir).withColumn("local_id", F.col("track_id") % 50).select("video_id", "local_id", F.col("local_id").alias("track_id"))
    out = A.unique_track_ids(local)
    return out.groupBy("video_id").agg(F.max("local_id").alias("top"), F.max(F.col("track_id") - F.col("local_id")).alias("shift"))


@query("FMT-2", oracle("SELECT ord, video_id, local_id + shift AS track_id FROM locals JOIN shifts USING (video_id)", locals=_LOCAL, shifts=_UNIQUE))
def fmt_2(spark, sf_dir):
    """Track ids unique over all videos."""
    return A.unique_track_ids(boxes(spark, sf_dir).withColumn("track_id", F.col("track_id") % 50)).select("ord", "video_id", "track_id")


@query("AGG-17", oracle("SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents"))
def agg_17(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


# --- windows, top-k, sets -----------------------------------------------------------------------


@query("WIN-2", oracle("SELECT ord, track_id, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY track_id, run ORDER BY frame_id) AS n FROM (SELECT *, sum(changed) OVER (PARTITION BY track_id ORDER BY frame_id) AS run FROM (SELECT *, CASE WHEN lag(q) OVER (PARTITION BY track_id ORDER BY frame_id) IS NOT DISTINCT FROM q THEN 0 ELSE 1 END AS changed FROM (SELECT *, frame_id // 7 AS q FROM boxes)))) WHERE n = 5"))
def win_2(spark, sf_dir):
    """Runs of equal boxes (boxes here change each seventh frame), flagged once at length five."""
    still = F.floor(F.col("frame_id") / 7).cast("double")
    b = boxes(spark, sf_dir).withColumns({c: still for c in ("x1", "y1", "x2", "y2")})
    return A.identical_runs(b, 5).select("ord", "track_id", "frame_id")


@query("WIN-3", oracle("SELECT ord FROM (SELECT *, first_value(category_id) OVER (PARTITION BY track_id ORDER BY ord) AS f FROM boxes) WHERE category_id <> f"))
def win_3(spark, sf_dir):
    """Rows that differ from their track's first one."""
    first = F.first_value("category_id").over(Window.partitionBy("track_id").orderBy("ord"))
    return boxes(spark, sf_dir).withColumn("f", first).filter("category_id <> f").select("ord")


@query("WIN-4", oracle("SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE ts <= p"))
def win_4(spark, sf_dir):
    """Rows not later than the row before them in input order."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    return read(spark, sf_dir, "events").withColumn("p", before).filter("ts <= p").select("event_id")


@query("WIN-5", oracle("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_id, coalesce(nth_value(event_id, 2) OVER w - first_value(event_id) OVER w, -1) AS frame_range FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"))
def win_5(spark, sf_dir):
    out = A.dense_frames(read(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")
    return out.withColumn("frame_range", F.coalesce("frame_range", F.lit(-1)))


@query("TOP-1", oracle("SELECT ord, category_id FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY score DESC, ord) AS n FROM boxes) WHERE n <= 100"))
def top_1(spark, sf_dir):
    return A.top_per_category(boxes(spark, sf_dir), 100).select("ord", "category_id")


@query("TOP-1b", oracle("SELECT ord, category_id FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY score DESC, ord) AS n FROM boxes) WHERE n <= 100 OR category_id < 3"))
def top_1b(spark, sf_dir):
    """Only novel categories are cut."""
    return A.top_per_category(boxes(spark, sf_dir), 100, F.col("category_id") >= 3).select("ord", "category_id")


@query("TOP-2", oracle("SELECT ord FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY score DESC, ord) AS m FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id, category_id ORDER BY score DESC, ord) AS n FROM boxes) WHERE n <= 4) WHERE m <= 10"))
def top_2(spark, sf_dir):
    """The best per level of each frame, then the best of the frame."""
    return A.top_per_frame(A.top_per_frame(boxes(spark, sf_dir), 4, [*FRAME, "category_id"]), 10, FRAME).select("ord")


@query("TOP-3", oracle("SELECT ord FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY score DESC, ord) AS n FROM boxes WHERE score > 0.05) WHERE n <= 20"))
def top_3(spark, sf_dir):
    """The best of each frame over a score limit."""
    return A.top_per_frame(boxes(spark, sf_dir).filter("score > 0.05"), 20, FRAME).select("ord")


@query("TOP-4", oracle("SELECT ord FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY score DESC, ord) AS n FROM boxes) WHERE n <= 6"))
def top_4(spark, sf_dir):
    return A.top_per_frame(boxes(spark, sf_dir), 6, FRAME).select("ord")


@query("TOP-5", oracle("SELECT ord FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id, category_id ORDER BY score DESC, ord) AS n FROM boxes WHERE score > 0.3) WHERE n <= 2"))
def top_5(spark, sf_dir):
    return A.top_per_frame(boxes(spark, sf_dir).filter("score > 0.3"), 2, [*FRAME, "category_id"]).select("ord")


@query("SRT-1", oracle("SELECT p_partkey, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS brand_no FROM part ORDER BY brand_no, p_partkey"))
def srt_1(spark, sf_dir):
    """Rows in the order of the number in their name."""
    return read(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("brand_no")).orderBy("brand_no", "p_partkey")


@query("SET-1", oracle("(SELECT 'difference' AS op, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) UNION ALL (SELECT 'intersection', doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) UNION ALL (SELECT 'union', doc_id FROM (SELECT doc_id FROM labels UNION SELECT page_id FROM pages))"))
def set_1(spark, sf_dir):
    d, l, p = (read(spark, sf_dir, t) for t in ("documents", "labels", "pages"))
    ids = d.select("doc_id"), l.select("doc_id"), p.select(F.col("page_id").alias("doc_id"))
    parts = {"difference": ids[0].subtract(ids[1]), "intersection": ids[0].intersect(ids[1]), "union": ids[1].union(ids[2]).distinct()}
    out = [df.select(F.lit(op).alias("op"), "doc_id") for op, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SET-2", oracle("SELECT track_id, list_sort(list_filter(range(0, 5), lambda x: NOT list_contains(list(DISTINCT category_id), x))) AS unmatched FROM boxes GROUP BY track_id"))
def set_2(spark, sf_dir):
    every = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda x: x.cast("long"))
    return boxes(spark, sf_dir).groupBy("track_id").agg(F.sort_array(F.array_except(every, F.collect_set("category_id"))).alias("unmatched"))


@query("SET-3", oracle("SELECT 0 AS part, event_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 1, event_id FROM events WHERE event_id % 2 = 1"))
def set_3(spark, sf_dir):
    """Parts of several workers put together, each with its number."""
    e = read(spark, sf_dir, "events").select("event_id")
    part = lambda k: e.filter(F.col("event_id") % 2 == k).select(F.lit(k).alias("part"), "event_id")
    return part(0).unionByName(part(1))


# --- sampling -----------------------------------------------------------------------------------


@query("SMP-1", oracle("SELECT ord FROM boxes WHERE frame_id % 4 = 0"))
def smp_1(spark, sf_dir):
    return A.strided(boxes(spark, sf_dir), 4).select("ord")


@query("SMP-4", oracle("SELECT video_id, frame_id, CASE WHEN len(l) = 0 THEN frame_id ELSE l[1 + (video_id * 31 + frame_id * 17) % len(l)] END AS ref FROM (SELECT a.video_id, a.frame_id, coalesce(list(b.frame_id ORDER BY b.frame_id) FILTER (b.frame_id IS NOT NULL), []) AS l FROM (SELECT DISTINCT video_id, frame_id FROM boxes) a LEFT JOIN (SELECT DISTINCT video_id, frame_id FROM boxes) b ON a.video_id = b.video_id AND abs(a.frame_id - b.frame_id) <= 2 AND a.frame_id <> b.frame_id GROUP BY ALL)"))
def smp_4(spark, sf_dir):
    """One reference frame of those around each frame, by a known draw."""
    return A.uniform_reference(boxes(spark, sf_dir), 2, F.col("video_id") * 31 + F.col("frame_id") * 17)


@query("SMP-5", oracle("SELECT ord FROM boxes WHERE frame_id >= (video_id * 7) % 31 AND frame_id < (video_id * 7) % 31 + 20"))
def smp_5(spark, sf_dir):
    return A.contiguous_crop(boxes(spark, sf_dir), 20, F.col("video_id") * 7).select("ord")


@query("SMP-5b", oracle("SELECT ord, g AS segment FROM (SELECT *, (video_id * 7) % (n - 7) AS a, (video_id * 7) % (n - 7) + 4 + (video_id * 5) % (least(n - 4, (video_id * 7) % (n - 7) + 12) - (video_id * 7) % (n - 7) - 3) AS b FROM (SELECT *, dense_rank() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS pos FROM boxes) JOIN (SELECT video_id, count(DISTINCT frame_id) AS n FROM boxes GROUP BY 1) USING (video_id) WHERE n >= 8), (VALUES (0), (1)) v(g) WHERE pos >= CASE WHEN g = 0 THEN a ELSE b END AND pos < CASE WHEN g = 0 THEN a ELSE b END + 4"))
def smp_5b(spark, sf_dir):
    """Two runs of four frames within sixteen."""
    return A.two_segments(boxes(spark, sf_dir), 8, 16, F.col("video_id") * 7, F.col("video_id") * 5).select("ord", "segment")


@query("SMP-6", oracle("SELECT video_id, frame_id, greatest(frame_id - 3, 0) AS before, least(frame_id + 3, m) AS after FROM (SELECT DISTINCT video_id, frame_id, max(frame_id) OVER (PARTITION BY video_id) AS m FROM boxes)"))
def smp_6(spark, sf_dir):
    """Each frame with one before and one after it that share a track."""
    return A.trident(boxes(spark, sf_dir), 3)


@query("SMP-8", oracle("SELECT ord FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, ord) AS n, count(*) FILTER (score < 0.2) OVER (PARTITION BY track_id) AS positives FROM boxes) WHERE n <= least(positives * 2, 8)"))
def smp_8(spark, sf_dir):
    """Hard negatives by cost, no more than twice the positives and eight."""
    w = Window.partitionBy("track_id")
    b = boxes(spark, sf_dir).withColumn("cap", F.least(F.sum((F.col("score") < 0.2).cast("long")).over(w) * 2, F.lit(8)))
    return b.withColumn("n", F.row_number().over(w.orderBy(F.col("score").desc(), "ord"))).filter("n <= cap").select("ord")


@query("SMP-9", oracle("WITH f AS (SELECT video_id, frame_id, max(score) > 0.98 AS ok FROM boxes GROUP BY 1, 2), g AS (SELECT video_id, list(frame_id ORDER BY frame_id) AS l FROM f WHERE ok GROUP BY 1) SELECT video_id, frame_id, CASE WHEN ok THEN frame_id ELSE l[1 + (frame_id * 13) % len(l)] END AS used FROM f JOIN g USING (video_id)".join(["SELECT * FROM (", ")"])))
def smp_9(spark, sf_dir):
    """Samples without a strong box are drawn again among those of their video that have one."""
    frames = boxes(spark, sf_dir).groupBy(*FRAME).agg(F.max("score").alias("s"))
    return A.redrawn(frames, F.col("s") > 0.98, F.col("frame_id") * 13)


@query("SMP-10", oracle("SELECT shard, arg_min(start, {'gap': abs(start - shard * total / 4.0), 's': start}) AS start FROM (SELECT o_custkey AS v, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, (SELECT count(*) FROM orders) AS total FROM orders GROUP BY o_custkey), range(0, 4) r(shard) GROUP BY shard"))
def smp_10(spark, sf_dir):
    """Contiguous shards that start where a video starts, nearest to even shares."""
    o = A.global_rank(read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_custkey") * 4294967296 + F.col("o_orderkey")).alias("k")), "k", "rank")
    videos = o.groupBy("o_custkey").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("size"), F.max("n_rows").alias("total"))
    return A.shard_starts(videos, 4)


@query("SMP-11", oracle("SELECT event_id, ntile(7) OVER (ORDER BY event_id) - 1 AS part FROM events"))
def smp_11(spark, sf_dir):
    return A.even_parts(read(spark, sf_dir, "events").select("event_id"), 7, "event_id")
