"""Queries over scalar functions: geometry of consecutive boxes and similarity of vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.functions import boxes as B
from trackmill.functions import vectors as V
from trackmill.registry import query
from trackmill.sources.adapters import boxes, oracle, steps, vector_pairs, vectors

a, b = B.Box.corners("a"), B.Box.corners("b")
box = B.Box.corners()


def _over(source: Callable, view: str, keys: str, name: str, made: Callable[[], dict[str, Column]], sql: dict[str, str]) -> None:
    """A query that adds expressions to the keys of a view, and the same in SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return source(spark, sf_dir).select(*keys.split(", "), *[c.alias(n) for n, c in made().items()])

    run.__doc__ = f"{name} over {view}"
    query(name, oracle(f"SELECT {keys}, {', '.join(f'{text} AS {n}' for n, text in sql.items())} FROM {view}"))(run)


def on_steps(name: str, made: Callable[[], dict[str, Column]], sql: dict[str, str]) -> None:
    _over(steps, "steps", "ord", name, made, sql)


def on_boxes(name: str, made: Callable[[], dict[str, Column]], sql: dict[str, str]) -> None:
    _over(boxes, "boxes", "ord", name, made, sql)


def on_pairs(name: str, made: Callable[[], dict[str, Column]], sql: dict[str, str]) -> None:
    _over(vector_pairs, "pairs", "frame_id, i, j", name, made, sql)


def r6(c: Column) -> Column:
    return F.round(c, 6)


# SQL pieces
I = "(greatest(0.0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0.0, least(ay2, by2) - greatest(ay1, by1)))"
A1, A2 = "((ax2 - ax1) * (ay2 - ay1))", "((bx2 - bx1) * (by2 - by1))"
U = f"({A1} + {A2} - {I})"
IOU = f"({I} / {U})"
HULL = "((greatest(ax2, bx2) - least(ax1, bx1)) * (greatest(ay2, by2) - least(ay1, by1)))"
CD2 = "(((ax1 + ax2) / 2 - (bx1 + bx2) / 2) ** 2 + ((ay1 + ay2) / 2 - (by1 + by2) / 2) ** 2)"
DIAG2 = "((greatest(ax2, bx2) - least(ax1, bx1)) ** 2 + (greatest(ay2, by2) - least(ay1, by1)) ** 2)"

on_steps("GEO-1", lambda: {"inter": B.intersection(a, b), "area_a": a.area, "area_b": b.area}, {"inter": I, "area_a": A1, "area_b": A2})
on_steps("GEO-2", lambda: {"iou": B.iou(a, b)}, {"iou": IOU})
on_steps("GEO-3", lambda: {"iou": B.iou_or_zero(a, b)}, {"iou": f"CASE WHEN {U} > 0 THEN {IOU} ELSE 0.0 END"})
on_steps(
    "GEO-4",
    lambda: {"hmiou": r6(B.height_modulated_iou(a, b))},
    {"hmiou": f"round((least(ay2, by2) - greatest(ay1, by1)) / (greatest(ay2, by2) - least(ay1, by1)) * {IOU}, 6)"},
)
on_steps(
    "GEO-5",
    lambda: {"giou": r6(B.giou(a, b)), "giou_standard": r6(B.giou(a, b, standard=True))},
    {"giou": f"round(({IOU} - ({HULL} - {I}) / {HULL} + 1) / 2, 6)", "giou_standard": f"round(({IOU} - ({HULL} - {U}) / {HULL} + 1) / 2, 6)"},
)
on_steps("GEO-6", lambda: {"diou": r6(B.diou(a, b))}, {"diou": f"round(({IOU} - {CD2} / {DIAG2} + 1) / 2, 6)"})
_V = "(4 / (pi() * pi()) * (atan((bx2 - bx1) / (by2 - by1 + 1)) - atan((ax2 - ax1) / (ay2 - ay1 + 1))) ** 2)"
on_steps(
    "GEO-7",
    lambda: {"ciou": r6(B.ciou(a, b))},
    {"ciou": f"round(({IOU} - {CD2} / {DIAG2} - CASE WHEN 1 - {IOU} + {_V} = 0 THEN 0.0 ELSE {_V} / (1 - {IOU} + {_V}) END * {_V} + 1) / 2, 6)"},
)


@query("GEO-8", oracle(f"SELECT ord, round(max(sqrt({CD2})) OVER w / nullif(max(sqrt({CD2})) OVER w, 0) - sqrt({CD2}) / nullif(max(sqrt({CD2})) OVER w, 0), 6) AS closeness FROM steps WINDOW w AS (PARTITION BY video_id, frame_id)"))
def geo_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre closeness, scaled by the frame's largest distance."""
    top = F.max(B.centre_distance(a, b)).over(Window.partitionBy("video_id", "frame_id"))
    return steps(spark, sf_dir).select("ord", r6(F.try_divide(top, top) - F.try_divide(B.centre_distance(a, b), top)).alias("closeness"))


on_steps("GEO-9", lambda: {"gap": B.score_gap(F.col("a_score"), F.col("b_score"))}, {"gap": "abs(b_score - a_score)"})


def _direction_sql(dx: str, dy: str) -> tuple[str, str]:
    n = f"(sqrt(({dx}) ** 2 + ({dy}) ** 2) + 1e-6)"
    return f"round(({dy}) / {n}, 6)", f"round(({dx}) / {n}, 6)"


_SIDES = {"centre": ("(bx1 + bx2) / 2 - (ax1 + ax2) / 2", "(by1 + by2) / 2 - (ay1 + ay2) / 2"), "lt": ("bx1 - ax1", "by1 - ay1"), "rt": ("bx1 - ax1", "by2 - ay2"), "lb": ("bx2 - ax2", "by1 - ay1"), "rb": ("bx2 - ax2", "by2 - ay2")}
on_steps(
    "GEO-10",
    lambda: {f"{p}_{k}": r6(v) for p in B.POINTS for k, v in zip(("dy", "dx"), B.direction(a, b, p), strict=True)},
    {f"{p}_{k}": v for p, d in _SIDES.items() for k, v in zip(("dy", "dx"), _direction_sql(*d), strict=True)},
)
on_steps(
    "GEO-11",
    lambda: {"cost": r6(B.direction_cost(B.direction(a, b), B.direction(a, b, "lt"), F.col("a_score") >= 0.2, F.col("b_score"), 0.2))},
    {
        "cost": "CASE WHEN a_score >= 0.2 THEN round((pi() / 2 - abs(acos(greatest(-1.0, least(1.0, "
        "((bx1 + bx2) / 2 - (ax1 + ax2) / 2) / (sqrt(((bx1 + bx2) / 2 - (ax1 + ax2) / 2) ** 2 + ((by1 + by2) / 2 - (ay1 + ay2) / 2) ** 2) + 1e-6) * ((bx1 - ax1) / (sqrt((bx1 - ax1) ** 2 + (by1 - ay1) ** 2) + 1e-6))"
        " + ((by1 + by2) / 2 - (ay1 + ay2) / 2) / (sqrt(((bx1 + bx2) / 2 - (ax1 + ax2) / 2) ** 2 + ((by1 + by2) / 2 - (ay1 + ay2) / 2) ** 2) + 1e-6) * ((by1 - ay1) / (sqrt((bx1 - ax1) ** 2 + (by1 - ay1) ** 2) + 1e-6))"
        "))))) / pi() * 0.2 * b_score, 6) ELSE 0.0 END"
    },
)


def _geo_12() -> dict[str, Column]:
    ratio, area = B.to_centre_ratio(box), B.to_centre_area(box)
    back, again = B.from_centre_ratio(*ratio), B.from_centre_area(*area)
    return {"cx": ratio[0], "cy": ratio[1], "ratio": ratio[2], "area": area[2], "x1_ratio": r6(back.x1), "y2_ratio": r6(back.y2), "x1_area": r6(again.x1), "y2_area": r6(again.y2)}


on_boxes("GEO-12", _geo_12, {"cx": "x1 + w / 2", "cy": "y1 + h / 2", "ratio": "w / h", "area": "w * h", "x1_ratio": "round(x1, 6)", "y2_ratio": "round(y2, 6)", "x1_area": "round(x1, 6)", "y2_area": "round(y2, 6)"})
on_boxes(
    "GEO-13",
    lambda: {**dict(zip(("x", "y", "bw", "bh"), box.to_xywh(), strict=True)), "back_x2": B.Box.xywh(*box.to_xywh()).x2, "back_y2": B.Box.xywh(*box.to_xywh()).y2},
    {"x": "x1", "y": "y1", "bw": "w", "bh": "h", "back_x2": "x1 + w", "back_y2": "y1 + h"},
)
on_boxes("GEO-14", lambda: dict(zip(("nx1", "ny1", "nx2", "ny2"), map(r6, B.normalised(box, F.lit(640.0), F.lit(480.0))), strict=True)), {f"n{c}": f"round({c} / (640.0 * 0.7), 6)" for c in ("x1", "y1", "x2", "y2")})
on_steps(
    "GEO-15",
    lambda: {"distance": r6(B.cut_distance(B.iou(a, b))), "covered": r6(B.iof(a, b))},
    {"distance": f"CASE WHEN 1 - {IOU} <= 0.5 THEN round(1 - {IOU}, 6) END", "covered": f"round({I} / {A1}, 6)"},
)
on_boxes(
    "GEO-16",
    lambda: {"over": B.overshoot(box, F.lit(640.0), F.lit(480.0)), "within": B.overshoot(box, F.lit(640.0), F.lit(480.0)) <= B.overshoot_limit(F.lit(640.0), F.lit(480.0))},
    {"over": "greatest(-x1, -y1, x2 - 640.0, y2 - 480.0, 0.0)", "within": "greatest(-x1, -y1, x2 - 640.0, y2 - 480.0, 0.0) <= greatest(8.0, 0.01 * greatest(640.0, 480.0))"},
)
on_steps(
    "GEO-17",
    lambda: {"same_x": B.close(a.x1, b.x1), "same_area": B.close(a.area, b.area, 0.05)},
    {"same_x": "abs(ax1 - bx1) <= 1e-4", "same_area": f"abs({A1} - {A2}) <= greatest(0.05 * greatest(abs({A1}), abs({A2})), 1e-4)"},
)
on_steps(
    "GEO-18",
    lambda: {"moved": r6(B.displacement(a, b)), "area_ratio": r6(B.ratio_of_larger(a.area, b.area)), "aspect_ratio": r6(B.ratio_of_larger(a.w / a.h, b.w / b.h))},
    {
        "moved": f"round(sqrt({CD2}) / sqrt(({A1} + {A2}) / 2), 6)",
        "area_ratio": f"round(greatest({A1}, {A2}) / least({A1}, {A2}), 6)",
        "aspect_ratio": "round(greatest((ax2 - ax1) / (ay2 - ay1), (bx2 - bx1) / (by2 - by1)) / least((ax2 - ax1) / (ay2 - ay1), (bx2 - bx1) / (by2 - by1)), 6)",
    },
)
_M = [[1.5, 0.25, 3.0], [-0.25, 0.5, 7.0]]


def _geo_19() -> dict[str, Column]:
    w = B.warped(box, _M)
    return {"wx1": w.x1, "wy1": w.y1, "wx2": w.x2, "wy2": w.y2}


on_boxes("GEO-19", _geo_19, {"wx1": "1.5 * x1 + 0.25 * y1 + 3", "wy1": "-0.25 * x1 + 0.5 * y1 + 7", "wx2": "1.5 * x2 + 0.25 * y2 + 3", "wy2": "-0.25 * x2 + 0.5 * y2 + 7"})

# --- vectors ------------------------------------------------------------------------------------

DOT, NA, NB = "list_dot_product(a, b)", "sqrt(list_dot_product(a, a))", "sqrt(list_dot_product(b, b))"
COS = f"({DOT} / (greatest({NA}, 1e-12) * greatest({NB}, 1e-12)))"

on_pairs(
    "VEC-1",
    lambda: {"dot": r6(V.similarity(F.col("a"), F.col("b"))), "cosine": r6(V.similarity(F.col("a"), F.col("b"), "cosine")), "warm_cosine": r6(V.similarity(F.col("a"), F.col("b"), "cosine", 0.5)), "warm_dot": r6(V.similarity(F.col("a"), F.col("b"), temperature=2.0))},
    {"dot": f"round({DOT}, 6)", "cosine": f"round({COS}, 6)", "warm_cosine": f"round({COS} / 0.5, 6)", "warm_dot": f"round({DOT} * 2, 6)"},
)
on_pairs("VEC-2", lambda: {"distance": r6(V.cosine_distance(F.col("a"), F.col("b")))}, {"distance": f"round(greatest(0.0, 1 - {COS}), 6)"})
on_pairs("VEC-3", lambda: {"distance": r6(V.euclidean(F.col("a"), F.col("b")))}, {"distance": "round(list_distance(a, b), 6)"})
on_pairs("VEC-4", lambda: {"likeness": r6(V.unit_cosine(F.col("a"), F.col("b")))}, {"likeness": f"round((1 + {COS}) / 2, 6)"})


@query("VEC-5", oracle(f"SELECT frame_id, i, j, round((e / (sum(e) OVER (PARTITION BY frame_id, i) + 1e-6) + e / (sum(e) OVER (PARTITION BY frame_id, j) + 1e-6)) / 2, 6) AS score FROM (SELECT *, exp({DOT}) AS e FROM pairs)"))
def vec_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vector_pairs(spark, sf_dir).select("frame_id", "i", "j", V.dot(F.col("a"), F.col("b")).alias("s"))
    return p.select("frame_id", "i", "j", r6(V.bi_softmax(p, "s", ["frame_id"], "i", "j")).alias("score"))


@query("VEC-6", oracle(f"SELECT frame_id, i, j, round((e / (sum(e) OVER (PARTITION BY frame_id, i) + 1e-6) + e / (sum(e) OVER (PARTITION BY frame_id, j) + 1e-6)) / 2, 6) AS score FROM (SELECT *, CASE WHEN label_i = label_j THEN exp({DOT}) ELSE 0.0 END AS e FROM pairs)"))
def vec_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vector_pairs(spark, sf_dir).select("frame_id", "i", "j", "label_i", "label_j", V.dot(F.col("a"), F.col("b")).alias("s"))
    return p.select("frame_id", "i", "j", r6(V.bi_softmax(p, "s", ["frame_id"], "i", "j", F.col("label_i") == F.col("label_j"))).alias("score"))


on_pairs("VEC-7", lambda: {"score": r6(V.gated(V.cosine(F.col("a"), F.col("b")), V.dot(F.col("a"), F.col("b")), 0.1))}, {"score": f"CASE WHEN {DOT} > 0.1 THEN round({COS}, 6) ELSE 0.0 END"})


@query(
    "VEC-8",
    oracle(
        """SELECT frame_id, i, round(sum(there * back), 6) AS consistency FROM (
  SELECT frame_id, i, exp(s - max(s) OVER r) / sum(exp(s - m1)) OVER r AS there, exp(t - max(t) OVER c) / sum(exp(t - m2)) OVER c AS back
  FROM (SELECT *, max(s) OVER (PARTITION BY frame_id, i) AS m1, max(t) OVER (PARTITION BY frame_id, j) AS m2 FROM (
    SELECT frame_id, i, j, d * ln(count(*) OVER (PARTITION BY frame_id, i)) / 0.1 AS s, d * ln(count(*) OVER (PARTITION BY frame_id, j)) / 0.1 AS t
    FROM (SELECT frame_id, i, j, list_dot_product(a, b) AS d FROM pairs)))
  WINDOW r AS (PARTITION BY frame_id, i), c AS (PARTITION BY frame_id, j)) GROUP BY frame_id, i"""
    ),
)
def vec_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vector_pairs(spark, sf_dir).select("frame_id", "i", "j", V.dot(F.col("a"), F.col("b")).alias("s"))
    return V.cycle_consistency(p, "s", ["frame_id"], "i", "j").select("frame_id", "i", r6(F.col("consistency")).alias("consistency"))


@query(
    "VEC-9",
    oracle("SELECT track_id, round(list_reduce(list(score ORDER BY frame_id, ord), lambda s, x: 0.2 * s + 0.8 * x), 6) AS ema_new, round(list_reduce(list(score ORDER BY frame_id, ord), lambda s, x: 0.8 * s + 0.2 * x), 6) AS ema_old FROM boxes GROUP BY track_id"),
)
def vec_9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both weightings of a running average over a track's scores."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame_id", "ord", "score"))), lambda s: s["score"])
    per = boxes(spark, sf_dir).groupBy("track_id").agg(ordered.alias("s"))
    return per.select("track_id", r6(V.ema_fold(F.col("s"), 0.8)).alias("ema_new"), r6(V.ema_fold(F.col("s"), 0.2)).alias("ema_old"))


on_steps("VEC-10", lambda: {"blended": r6(V.ema(F.col("a_score"), F.col("b_score"), 0.8))}, {"blended": "round(0.2 * a_score + 0.8 * b_score, 6)"})
on_steps(
    "VEC-11",
    lambda: {"score": r6(V.ensemble(F.col("a_score"), F.col("b_score"), F.col("category_id") > 2))},
    {"score": "CASE WHEN category_id > 2 THEN round(pow(a_score, 2.0::DOUBLE / 3) * pow(b_score, 1.0::DOUBLE / 3), 6) ELSE round(pow(a_score, 1.0::DOUBLE / 3) * pow(b_score, 2.0::DOUBLE / 3), 6) END"},
)


@query("VEC-12", oracle(f"SELECT frame_id, i, j, round(exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY frame_id, i), 6) AS p FROM (SELECT *, max(s) OVER (PARTITION BY frame_id, i) AS m FROM (SELECT frame_id, i, j, {COS} / 0.07 AS s FROM pairs))"))
def vec_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vector_pairs(spark, sf_dir).select("frame_id", "i", "j", (V.cosine(F.col("a"), F.col("b")) / 0.07).alias("s"))
    return p.select("frame_id", "i", "j", r6(V.softmax_over(F.col("s"), Window.partitionBy("frame_id", "i"))).alias("p"))


@query("VEC-13", oracle("SELECT track_id, category_id, round(avg(score) OVER (PARTITION BY track_id, category_id), 6) AS group_p, ord FROM boxes"))
def vec_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean probability of a prompt group beside each of its members."""
    mean = F.avg("score").over(Window.partitionBy("track_id", "category_id"))
    return boxes(spark, sf_dir).select("track_id", "category_id", r6(mean).alias("group_p"), "ord")


on_boxes("VEC-14", lambda: {"ratio": r6(V.fusion_ratio(F.col("score"), 2.0))}, {"ratio": "round(2.0 * (1 - score) * (1 - score), 6)"})
on_steps(
    "VEC-15",
    lambda: {"cost": F.when(V.fused_motion(F.col("a_score"), F.col("b_score") * 20) == float("inf"), -1.0).otherwise(r6(V.fused_motion(F.col("a_score"), F.col("b_score") * 20)))},
    {"cost": "CASE WHEN b_score * 20 > 9.4877 THEN -1.0 ELSE round(0.98 * a_score + (1 - 0.98::DOUBLE) * (b_score * 20), 6) END"},
)
on_steps("VEC-16", lambda: {"score": r6(V.motion_blend(F.col("b_score"), B.iou(a, b), 0.4))}, {"score": f"round(0.6 * b_score + 0.4 * {IOU}, 6)"})


@query(
    "MTH-1",
    oracle(
        f"""SELECT frame_id, i, round(max(m) + ln(sum(exp(s - m))) - coalesce(sum(CASE WHEN label_i = label_j THEN s END) / nullif(count(*) FILTER (label_i = label_j), 0), 0), 6) AS contrastive,
  round(sum(CASE WHEN label_i = label_j THEN (s - 1) ** 2 ELSE s ** 2 END) / count(*), 6) AS squared
FROM (SELECT *, max(s) OVER (PARTITION BY frame_id, i) AS m FROM (SELECT frame_id, i, label_i, label_j, {COS} AS s FROM pairs)) GROUP BY frame_id, i"""
    ),
)
def mth_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses as measures over pairs: supervised contrastive (log-sum-exp less the mean of positives) and L2."""
    p = vector_pairs(spark, sf_dir).select("frame_id", "i", "label_i", "label_j", V.cosine(F.col("a"), F.col("b")).alias("s"))
    p = p.withColumn("lse", V.log_sum_exp(F.col("s"), Window.partitionBy("frame_id", "i")))
    same = F.col("label_i") == F.col("label_j")
    target = F.when(same, 1.0).otherwise(0.0)
    positives = F.try_divide(F.sum(F.when(same, F.col("s"))), F.nullif(F.count_if(same), F.lit(0)))
    squared = F.avg((F.col("s") - target) * (F.col("s") - target))
    return p.groupBy("frame_id", "i").agg(r6(F.max("lse") - F.coalesce(positives, F.lit(0.0))).alias("contrastive"), r6(squared).alias("squared"))


on_boxes(
    "MTH-2",
    lambda: {
        "e": r6(F.exp(F.col("score"))),
        "l": r6(F.log(F.col("w"))),
        "hyp": r6(F.hypot("w", "h")),
        "sig": r6(V.sigmoid(F.col("value") / 100)),
        "clip": F.least(F.greatest("x1", F.lit(100.0)), F.lit(300.0)),
        "quotient": F.floor(F.col("ord") / 7),
        "rest": F.col("ord") % 7,
    },
    {"e": "round(exp(score), 6)", "l": "round(ln(w), 6)", "hyp": "round(sqrt(w * w + h * h), 6)", "sig": "round(1 / (1 + exp(-value / 100)), 6)", "clip": "least(greatest(x1, 100.0), 300.0)", "quotient": "ord // 7", "rest": "ord % 7"},
)


@query(
    "ARR-1",
    oracle(
        """SELECT track_id, list(score ORDER BY frame_id)[1:3] AS first_three, list(score ORDER BY frame_id)[-1] AS last_one,
  len(list_filter(list(score ORDER BY frame_id), lambda s: s > 0.5)) AS n_high, coalesce(list_position(list(category_id ORDER BY frame_id), 3), 0) AS first_of_3,
  list_sort(list_distinct(list(category_id))) AS kinds FROM boxes GROUP BY track_id"""
    ),
)
def arr_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices, gathers, masks, argsort and distinct values of a track's columns."""
    ordered = F.array_sort(F.collect_list(F.struct("frame_id", "score", "category_id")))
    per = boxes(spark, sf_dir).groupBy("track_id").agg(ordered.alias("o"), F.sort_array(F.collect_set("category_id")).alias("kinds"))
    s, c = F.transform("o", lambda x: x["score"]), F.transform("o", lambda x: x["category_id"])
    position = F.array_position(c, F.lit(3))
    return per.select(
        "track_id", F.slice(s, 1, 3).alias("first_three"), F.element_at(s, -1).alias("last_one"), F.size(F.filter(s, lambda x: x > 0.5)).cast("long").alias("n_high"), position.cast("int").alias("first_of_3"), "kinds"
    )


@query("AGG-16", oracle("SELECT label, list_transform(range(1, 65), lambda k: round(list_sum(list_transform(l[-5:], lambda v: v[CAST(k AS INTEGER)])) / len(l[-5:]), 6)) AS mean FROM (SELECT label, list(list_transform(embedding, lambda x: CAST(x AS DOUBLE)) ORDER BY vec_id) AS l FROM vectors GROUP BY label)"))
def agg_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each label's last five vectors."""
    last = Window.partitionBy("label").orderBy(F.col("vec_id").desc())
    v = vectors(spark, sf_dir).withColumn("back", F.row_number().over(last)).filter("back <= 5")
    per = v.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("l"))
    return per.select("label", F.transform(V.mean_of_last(F.col("l"), 5), lambda x: F.round(x, 6)).alias("mean"))
