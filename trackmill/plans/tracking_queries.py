"""Queries over assignment, suppression, motion, trackers, clusters and tracking metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.functions.boxes import ASSOCIATIONS, Box
from trackmill.functions.sql import register
from trackmill.operators import kernels as K
from trackmill.operators.aggregates import majority_category, split_means
from trackmill.operators.groups import Columns, corners, over_groups
from trackmill.operators.suppression import greedy_nms, remove_distractors
from trackmill.operators.tracking import track
from trackmill.plans import geometry_queries as G
from trackmill.plans import metrics as M
from trackmill.registry import OPERATORS, query
from trackmill.sources.adapters import boxes, oracle, steps, vectors
from trackmill.sources.scratch import kept

FRAME = ["video_id", "frame_id"]
BOX = ["x1", "y1", "x2", "y2"]


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes with an appearance vector that depends on the object and a little on the frame."""
    b = boxes(spark, sf_dir)
    wave = lambda k: F.sin((F.col("track_id") % 50 + 1) * (k + 1)) + F.sin(F.col("ord") * (k + 3)) * 0.05
    return b.withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(7)), wave)).withColumn("score", 0.4 + F.col("score") * 0.6)


_DISTRACTED = "SELECT ord FROM boxes a WHERE NOT (score < 0.5 AND EXISTS (SELECT 1 FROM boxes b WHERE b.video_id = a.video_id AND b.frame_id = a.frame_id AND b.ord < a.ord{more} AND (greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))) / (a.w * a.h + b.w * b.h - (greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))) > {cut}))"


@query("NMS-1", oracle(_DISTRACTED.format(more="", cut="0.05")))
def nms_1(spark, sf_dir):
    return remove_distractors(boxes(spark, sf_dir), FRAME, overlap=0.05).select("ord")


@query("NMS-1b", oracle(_DISTRACTED.format(more=" AND b.category_id = a.category_id", cut="0.02")))
def nms_1b(spark, sf_dir):
    """Distractors of the same class only."""
    return remove_distractors(boxes(spark, sf_dir), FRAME, overlap=0.02, same_category=True).select("ord")


_SUPPRESSED = """SELECT ord FROM (
WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY score DESC, ord) AS r FROM ({rows})),
near AS (
  SELECT a.ord AS strong, c.ord AS weak
  FROM b a JOIN b c ON a.video_id = c.video_id AND a.frame_id = c.frame_id AND a.class = c.class AND a.r < c.r
  WHERE (greatest(0.0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0.0, least(a.y2, c.y2) - greatest(a.y1, c.y1)))
    / (a.w * a.h + c.w * c.h - (greatest(0.0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0.0, least(a.y2, c.y2) - greatest(a.y1, c.y1)))) > {cut}
), over AS (SELECT weak, list(strong) AS strong FROM near GROUP BY weak),
step AS (
  SELECT video_id, frame_id, 0 AS pos, []::BIGINT[] AS kept, NULL::BIGINT AS ord FROM b WHERE r = 1
  UNION ALL
  SELECT s.video_id, s.frame_id, s.pos + 1, CASE WHEN o.weak IS NULL OR NOT list_has_any(s.kept, o.strong) THEN list_append(s.kept, b.ord) ELSE s.kept END,
    CASE WHEN o.weak IS NULL OR NOT list_has_any(s.kept, o.strong) THEN b.ord END
  FROM step s JOIN b ON b.video_id = s.video_id AND b.frame_id = s.frame_id AND b.r = s.pos + 1 LEFT JOIN over o ON o.weak = b.ord
) SELECT ord FROM step WHERE ord IS NOT NULL)"""


@query("NMS-2", oracle(_SUPPRESSED.format(rows="SELECT *, category_id AS class FROM boxes WHERE score > 0.05", cut="0.4")))
def nms_2(spark, sf_dir):
    """Greedy suppression per class after a score limit."""
    return greedy_nms(boxes(spark, sf_dir).filter("score > 0.05"), FRAME, 0.4, by_class=True).select("ord")


@query("NMS-3", oracle(_SUPPRESSED.format(rows="SELECT *, CASE WHEN w * h > 3000 THEN 1 ELSE 0 END AS class FROM boxes", cut="0.7")))
def nms_3(spark, sf_dir):
    """Greedy suppression per level of proposals: the size class of a box."""
    level = F.when(F.col("w") * F.col("h") > 3000, 1).otherwise(0).cast("long")
    return greedy_nms(boxes(spark, sf_dir).withColumn("category_id", level), FRAME, 0.7, by_class=True).select("ord")


def _next_frames(spark, sf_dir, solve, schema: str) -> DataFrame:
    """A kernel over each frame and the next one of its video, whose frames come by in order."""
    before: dict = {}

    def pair(c: Columns) -> tuple | None:
        a = dict(before)
        before.update(c)
        if not a or a["video_id"][0] != c["video_id"][0] or a["frame_id"][0] + 1 != c["frame_id"][0]:
            return None
        found = solve(a, c)
        return (*(np.repeat(a[k][:1], len(found[0])) for k in FRAME), *found)

    b = boxes(spark, sf_dir).select(*FRAME, "ord", *BOX)
    return over_groups(b, FRAME, ["ord"], pair, schema, by=["video_id"])


@query("ASN-1")
def asn_1(spark, sf_dir):
    """The least-cost matching of neighbouring frames by 1 - IoU, at most 0.7 a pair."""

    def solve(a, c):
        pairs = K.assign(1 - K.iou_matrix(corners(a), corners(c)), 0.7)
        return a["ord"][pairs[:, 0]], c["ord"][pairs[:, 1]]

    return _next_frames(spark, sf_dir, solve, "video_id long, frame_id long, i long, j long")


@query("ASN-2")
def asn_2(spark, sf_dir):
    """Association with its unmatched rows and columns, by frame."""

    def solve(a, c):
        return [np.array([len(x)]) for x in K.associate(K.height_iou_matrix(corners(a), corners(c)), 0.3)]

    return _next_frames(spark, sf_dir, solve, "video_id long, frame_id long, matched long, left_rows long, left_columns long")


_GREEDY = """SELECT video_id, frame_id, i, j FROM (
WITH RECURSIVE pairs AS (
  SELECT a.video_id, a.frame_id, a.ord AS i, c.ord AS j, (greatest(0.0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0.0, least(a.y2, c.y2) - greatest(a.y1, c.y1))) AS inter,
    inter / (a.w * a.h + c.w * c.h - inter) AS iou
  FROM boxes a JOIN boxes c ON a.video_id = c.video_id AND a.frame_id + 1 = c.frame_id
), close AS (SELECT * FROM pairs WHERE iou > 0.3),
rows AS (SELECT video_id, frame_id, list(DISTINCT i ORDER BY i) AS todo FROM close GROUP BY ALL),
step AS (
  SELECT video_id, frame_id, todo, 1 AS pos, []::BIGINT[] AS taken, NULL::BIGINT AS i, NULL::BIGINT AS j FROM rows
  UNION ALL
  SELECT video_id, frame_id, todo, pos + 1, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best) END, todo[pos], best
  FROM (SELECT s.*, (SELECT arg_min(c.j, (-c.iou, c.j)) FROM close c WHERE c.video_id = s.video_id AND c.frame_id = s.frame_id AND c.i = s.todo[s.pos] AND NOT list_contains(s.taken, c.j)) AS best
        FROM step s WHERE s.pos <= len(s.todo))
) SELECT * FROM step WHERE j IS NOT NULL)"""


@query("ASN-3", oracle(_GREEDY))
def asn_3(spark, sf_dir):
    """Greedy one-to-one matching in row order."""

    def solve(a, c):
        hit = K.greedy_match(K.iou_matrix(corners(a), corners(c)), 0.3)
        return a["ord"][hit >= 0], c["ord"][hit[hit >= 0]]

    return _next_frames(spark, sf_dir, solve, "video_id long, frame_id long, i long, j long")


class Filters:
    """Filters of a video's tracks side by side: each frame's tracks take one step."""

    def __init__(self):
        self.video, self.ids = None, np.zeros(0, np.int64)

    def places(self, c: Columns) -> tuple[np.ndarray, np.ndarray, bool]:
        """The place of each row's track, and whether it is new; a new video begins without tracks."""
        begins = c["video_id"][0] != self.video
        if begins:
            self.video, self.ids = c["video_id"][0], np.zeros(0, np.int64)
        order = np.argsort(self.ids, kind="stable")
        at = np.searchsorted(self.ids, c["track_id"], sorter=order)
        new = (at == len(order)) | (self.ids[order[np.minimum(at, len(order) - 1)]] != c["track_id"]) if len(order) else np.ones(len(at), bool)
        place = np.where(new, len(self.ids) + np.cumsum(new) - 1, order[np.minimum(at, len(order) - 1)] if len(order) else 0)
        self.ids = np.r_[self.ids, c["track_id"][new]]
        return place, new, begins


def _by_video(df: DataFrame, columns: list[str], step, schema: str) -> DataFrame:
    return over_groups(df.select(*FRAME, "track_id", *columns), FRAME, ["track_id"], step, schema, by=["video_id"])


class BoxFold(Filters):
    def __call__(self, c: Columns) -> tuple:
        kf, z = K.BoxKalman(), K.BoxKalman.measure(corners(c))
        place, new, begins = self.places(c)
        if begins:
            self.mean, self.cov = np.zeros((0, 8)), np.zeros((0, 8, 8))
        mean, cov = kf.initiate(z[new])
        self.mean, self.cov = np.r_[self.mean, mean], np.r_[self.cov, cov]
        gate, old = np.zeros(len(z)), np.flatnonzero(~new)
        if len(old):
            mean, cov = kf.predict(self.mean[place[old]], self.cov[place[old]])
            gate[old] = kf.gating(mean, cov, z[old])
            self.mean[place[old]], self.cov[place[old]] = kf.update(mean, cov, z[old])
        return c["ord"], gate, self.mean[place, 0], self.mean[place, 1]


@query("KAL-1")
def kal_1(spark, sf_dir):
    """Each box's gating distance to its track's prediction, and the filtered centre."""
    return _by_video(boxes(spark, sf_dir), ["ord", *BOX], BoxFold(), "ord long, gate double, cx double, cy double")


class ScoreFold(Filters):
    def __call__(self, c: Columns) -> tuple:
        z = np.array([K.ScoreKalman.measure(b, s) for b, s in zip(corners(c), c["score"], strict=True)])
        place, new, begins = self.places(c)
        if begins:
            self.filters = K.ScoreKalmans()
        self.filters.begin(z[new])
        old = np.flatnonzero(~new)
        if len(old):
            self.filters.predict(place[old])
            self.filters.update(place[old], z[old], c["frame_id"][old] % 5 != 0)
        return c["ord"], *self.filters.box(place).T, self.filters.x[place, 3]


@query("KAL-2")
def kal_2(spark, sf_dir):
    """The score-aware filter; every fifth frame is not observed, and replayed on the next one."""
    return _by_video(boxes(spark, sf_dir), ["ord", *BOX, "score"], ScoreFold(), "ord long, x1 double, y1 double, x2 double, y2 double, score double")


#: Position and speed, with little noise in either.
_F, _Q, _H = np.array([[1.0, 1.0], [0.0, 1.0]]), np.eye(2) * 0.1, np.array([[1.0, 0.0]])


@query("KAL-3")
def kal_3(spark, sf_dir):
    """Smoothed positions along x: the filter's states corrected by those after them. A group is the
    tracks of one video; the covariances of tracks of one length are the same."""

    def solve(c: Columns) -> tuple:
        cut = np.flatnonzero(np.r_[True, c["track_id"][1:] != c["track_id"][:-1]])
        size = np.diff(np.r_[cut, len(c["ord"])])
        x_out, v_out = np.zeros(len(c["ord"])), np.zeros(len(c["ord"]))
        for n in np.unique(size):
            rows = cut[size == n][None, :] + np.arange(n)[:, None]
            z = c["x1"][rows]
            x, p, means, covs = np.stack([z[0], np.zeros(z.shape[1])]), np.eye(2) * 100, [], []
            for k in range(n):
                gain = p @ _H.T / (_H @ p @ _H.T + 1)
                x, p = x + gain @ (z[k] - _H @ x), p - gain @ _H @ p
                means.append(x)
                covs.append(p)
                x, p = _F @ x, _F @ p @ _F.T + _Q
            smooth, _ = K.smooth(_F, _Q, np.array(means), np.array(covs))
            x_out[rows], v_out[rows] = smooth[:, 0], smooth[:, 1]
        return c["ord"], x_out, v_out

    b = boxes(spark, sf_dir).select("video_id", "track_id", "frame_id", "ord", "x1")
    return over_groups(b, ["video_id"], ["track_id", "frame_id"], solve, "ord long, x double, speed double")


@query("KAL-3b")
def kal_3b(spark, sf_dir):
    """Of each track the log-likelihood of its positions, and the last state under the steady gain."""

    def solve(c: Columns) -> tuple:
        zs = c["x1"][:, None]
        start = lambda: K.LinearKalman(_F, _H, _Q, np.eye(1), np.array([zs[0, 0], 0.0]), np.eye(2) * 100)
        steady = start().steady(zs)
        return c["track_id"][:1], np.array([start().batch(list(zs))[2]]), steady[-1:, 0], steady[-1:, 1]

    b = boxes(spark, sf_dir).select("track_id", "frame_id", "x1")
    return over_groups(b, ["track_id"], ["frame_id"], solve, "track_id long, log_likelihood double, x double, speed double")


@query("WIN-6", oracle("SELECT ord, coalesce(lag(x1, 3) OVER w, lag(x1, 2) OVER w, lag(x1, 1) OVER w, x1) AS x1 FROM boxes WINDOW w AS (PARTITION BY track_id ORDER BY frame_id)"))
def win_6(spark, sf_dir):
    """The observation three steps back, else the oldest within reach, else the newest."""
    from pyspark.sql import Window

    w = Window.partitionBy("track_id").orderBy("frame_id")
    return boxes(spark, sf_dir).select("ord", F.coalesce(*[F.lag("x1", k).over(w) for k in (3, 2, 1)], "x1").alias("x1"))


def _tracked(name: str, config: dict, doc: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return track(detections(spark, sf_dir), config).select("ord", "track_id")

    run.__doc__ = doc
    query(name)(run)


_tracked("TRK-1", {"type": "memo"}, "Appearance memory, distractors of any class.")
_tracked("TRK-1b", {"type": "memo", "method": "intra"}, "The same within classes, with blended scores.")
_tracked("TRK-2", {"type": "memo", "fusion": 2.0, "match_score": 0.37, "memo_frames": 50, "momentum": 0.4}, "Appearance weighed by cycle consistency.")
_tracked("TRK-3", {"type": "memo", "motion_weight": 0.3, "match_score": 0.3}, "Appearance and predicted overlap, matched greedily.")
_tracked("TRK-4", {"type": "sort"}, "Motion gate, appearance, overlap; tentative tracks.")
_tracked("TRK-5", {"type": "blend"}, "Appearance and predicted overlap, solved for the least total.")
_tracked("TRK-6", {"type": "hybrid_sort"}, "Three rounds with corner directions and scores.")
_tracked("TRK-7", {"type": "hybrid_sort_public"}, "Two rounds within classes; tracks are followed back over the boxes held back at their head.")


@query("STA-1")
def sta_1(spark, sf_dir):
    """Ids per video of a memory that forgets after two frames, when every object is hidden for five."""
    hidden = detections(spark, sf_dir).filter("NOT (frame_id BETWEEN 20 AND 24)")
    out = track(hidden, {"type": "memo", "memo_frames": 2})
    return out.filter("track_id > -1").groupBy("video_id").agg(F.count_distinct("track_id").alias("ids"))


@query("STA-2")
def sta_2(spark, sf_dir):
    """Tracks that die while tentative: ids of at most two boxes, when each object is seen on two frames of three."""
    seen = detections(spark, sf_dir).filter("frame_id % 3 <> 2")
    out = track(seen, {"type": "sort"}).filter("track_id > -1").groupBy("video_id", "track_id").agg(F.count(F.lit(1)).alias("n"))
    return out.groupBy("video_id").agg(F.count_if(F.col("n") <= 2).alias("tentative"), F.count(F.lit(1)).alias("tracks"))


@query("STA-3", oracle("SELECT DISTINCT video_id, TRUE AS consecutive, TRUE AS some FROM boxes"))
def sta_3(spark, sf_dir):
    """New ids are consecutive from 0 in each video: their number is the largest plus one."""
    out = track(detections(spark, sf_dir), {"type": "memo"}).filter("track_id > -1")
    ids, next_id = F.count_distinct("track_id"), F.max("track_id") + 1
    return out.groupBy("video_id").agg((ids == next_id).alias("consecutive"), (next_id > 1).alias("some"))


@query("STA-4", oracle("SELECT DISTINCT video_id, 0::BIGINT AS first_id FROM boxes"))
def sta_4(spark, sf_dir):
    """Ids start anew with each video."""
    out = track(detections(spark, sf_dir), {"type": "memo"}).filter("track_id > -1")
    return out.groupBy("video_id").agg(F.min("track_id").alias("first_id"))


@query("CLU-1")
def clu_1(spark, sf_dir):
    """k-means with ten clusters: cluster sizes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors(spark, sf_dir).select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=10, seed=42, maxIter=10).fit(v)
    return model.transform(v).select("vec_id", F.col("prediction").cast("long").alias("cluster"))


@query("CLU-2")
def clu_2(spark, sf_dir):
    """Density clusters of the box centres of each frame, and whether a box is in the largest one."""

    def run(c: Columns) -> tuple:
        label = K.dbscan(np.stack([c["x1"], c["y1"]], axis=1) / 640.0, 0.12)
        best = np.bincount(label[label >= 0]).argmax() if (label >= 0).any() else -1
        return c["ord"], label, (label == best) & (label >= 0)

    return over_groups(boxes(spark, sf_dir).select(*FRAME, "ord", "x1", "y1"), FRAME, ["ord"], run, "ord long, cluster long, largest boolean")


@query("CLU-3")
def clu_3(spark, sf_dir):
    """The members of each frame's largest cluster."""
    return clu_2(spark, sf_dir).filter("largest").select("ord")


_MEASURES = {
    "iou": G.IOU,
    "height_modulated_iou": f"(least(ay2, by2) - greatest(ay1, by1)) / (greatest(ay2, by2) - least(ay1, by1)) * {G.IOU}",
    "giou": f"({G.IOU} - ({G.HULL} - {G.I}) / {G.HULL} + 1) / 2",
    "diou": f"({G.IOU} - {G.CD2} / {G.DIAG2} + 1) / 2",
    "ciou": f"({G.IOU} - {G.CD2} / {G.DIAG2} - CASE WHEN 1 - {G.IOU} + {G._V} = 0 THEN 0.0 ELSE {G._V} / (1 - {G.IOU} + {G._V}) END * {G._V} + 1) / 2",
}


@query("UDX-3", oracle("SELECT video_id, count(*) AS n, count(*) AS same FROM boxes GROUP BY 1"))
def udx_3(spark, sf_dir):
    """A tracker called from SQL as a table function, beside the same tracker over the table."""
    register(spark)
    d = kept(detections(spark, sf_dir), "detections")
    found = spark.sql("SELECT ord, track_id FROM track_objects(TABLE(SELECT * FROM {d}), 'sort', '{{\"tentative\": 2}}')", d=d)
    plain = track(d, {"type": "sort", "tentative": 2}).select("ord", "video_id", F.col("track_id").alias("plain"))
    return plain.join(found, "ord", "left").groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("track_id").eqNullSafe(F.col("plain"))).alias("same"))


_WH = "(ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1)"
_SHARED = "greatest(0.0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0.0, least(ay2, by2) - greatest(ay1, by1))"
_HULL = "(greatest(ax2, bx2) - least(ax1, bx1)) * (greatest(ay2, by2) - least(ay1, by1))"


@query("UDX-3b", oracle(f"SELECT ord, round(s / (wh - s), 9) AS iou, round(s / (wh - s) - (hull - (wh - s)) / hull, 9) AS giou FROM (SELECT ord, {_SHARED} AS s, {_WH} AS wh, {_HULL} AS hull FROM steps)"))
def udx_3b(spark, sf_dir):
    """Measures of boxes as functions of SQL."""
    register(spark)
    corners_ = ", ".join(f"{p}{c}" for p in "ab" for c in ("x1", "y1", "x2", "y2"))
    return spark.sql(f"SELECT ord, round(box_iou({corners_}), 9) AS iou, round(box_giou({corners_}), 9) AS giou FROM {{s}}", s=steps(spark, sf_dir))


@query("UDX-3c", oracle("SELECT track_id, median(x1) AS x1, median(y2) AS y2 FROM boxes GROUP BY 1"))
def udx_3c(spark, sf_dir):
    """An aggregate over boxes as a function of SQL."""
    register(spark)
    found = spark.sql("SELECT track_id, consensus_box(array(x1, y1, x2, y2)) AS box FROM {b} GROUP BY track_id", b=boxes(spark, sf_dir))
    return found.select("track_id", F.col("box")[0].alias("x1"), F.col("box")[3].alias("y2"))


@query("UDX-2", oracle(" UNION ALL ".join(f"SELECT '{n}' AS measure, round(min({m}), 6) AS least, round(max({m}), 6) AS most, count(*) FILTER ({m} > 0.7) AS close FROM steps" for n, m in _MEASURES.items())))
def udx_2(spark, sf_dir):
    """All association measures by name over neighbouring boxes."""
    a, b = Box.corners("a"), Box.corners("b")
    values = F.array(*[F.struct(F.lit(n).alias("measure"), f(a, b).alias("v")) for n, f in sorted(ASSOCIATIONS.items())])
    rows = steps(spark, sf_dir).select(F.inline(values))
    return rows.groupBy("measure").agg(F.round(F.min("v"), 6).alias("least"), F.round(F.max("v"), 6).alias("most"), F.count_if(F.col("v") > 0.7).alias("close"))


@query("UDX-1", oracle("SELECT name, count(*) AS n, count(DISTINCT ord) AS boxes FROM boxes, (SELECT unnest(['blend', 'hybrid_sort', 'hybrid_sort_public', 'memo', 'sort']) AS name) GROUP BY name"))
def udx_1(spark, sf_dir):
    """The registered trackers, each built by its name and run over all boxes."""
    every = kept(detections(spark, sf_dir), "detections")
    out = None
    for name in sorted(OPERATORS):
        found = track(every, {"type": name}).select(F.lit(name).alias("name"), "ord")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ord").alias("boxes"))


def _events(spark, sf_dir) -> DataFrame:
    """Events of a tracker's result against the objects it saw, without regard to class."""
    gt = boxes(spark, sf_dir).withColumn("category_id", F.col("track_id") % 2)
    ids = track(detections(spark, sf_dir), {"type": "memo"}).filter("track_id > -1").select("ord", F.col("track_id").alias("found"))
    pred = gt.join(ids, "ord").withColumn("track_id", F.col("found"))
    return kept(M.clear_events(gt, pred, ignore=gt.filter("ord % 211 = 0")), "events")


@query("EVL-1")
def evl_1(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("EVL-2")
def evl_2(spark, sf_dir):
    """Twelve metrics per class, overall and on average."""
    return M.mot_report(_events(spark, sf_dir))


#: A result with known faults: every tenth box is lost, and ids change at frame 25. Boxes match none but
#: themselves at this limit.
SAME = 0.01
_HITS = "SELECT track_id, count(*) AS n, count(*) FILTER (ord % 10 <> 0) AS h, count(*) FILTER (ord % 10 <> 0 AND frame_id < 25) AS a, count(*) FILTER (ord % 10 <> 0 AND frame_id >= 25) AS b FROM boxes GROUP BY 1"
_MOTA = "round(1 - (sum(n - h) + count(*) FILTER (a > 0 AND b > 0)) / sum(n)::DOUBLE, 9)"


def _faulty(gt: DataFrame) -> DataFrame:
    return gt.filter("ord % 10 <> 0").withColumn("track_id", F.col("track_id") + F.when(F.col("frame_id") >= 25, 1_000_000).otherwise(0))


@query("EVL-2b", oracle(f"SELECT round(2 * sum(greatest(a, b)) / (sum(n) + sum(h))::DOUBLE, 9) AS \"IDF1\", {_MOTA} AS \"MOTA\", 1.0::DOUBLE AS \"MOTP\", 0::BIGINT AS \"FP\", sum(n - h)::BIGINT AS \"FN\", count(*) FILTER (a > 0 AND b > 0) AS \"IDSw\", count(*) FILTER (h / n::DOUBLE >= 0.8) AS \"MT\", count(*) FILTER (h / n::DOUBLE < 0.8 AND h / n::DOUBLE >= 0.2) AS \"PT\" FROM hits", hits=_HITS))
def evl_2b(spark, sf_dir):
    """Metrics of a result with known faults."""
    gt = boxes(spark, sf_dir).withColumn("category_id", F.col("track_id") % 2)
    m = M.mot_metrics(M.mot_counts(kept(M.clear_events(gt, _faulty(gt), limit=SAME), "events"), []))
    return m.select(F.round("IDF1", 9).alias("IDF1"), F.round("MOTA", 9).alias("MOTA"), "MOTP", "FP", "FN", "IDSw", "MT", "PT")


@query("EVL-1b", oracle("SELECT kind, n::BIGINT AS n FROM (SELECT 'RAW' AS kind, sum(h) AS n FROM hits UNION ALL SELECT 'SWITCH', count(*) FILTER (a > 0 AND b > 0) FROM hits UNION ALL SELECT 'MATCH', sum(h) - count(*) FILTER (a > 0 AND b > 0) FROM hits UNION ALL SELECT 'MISS', sum(n - h) FROM hits) WHERE n > 0", hits=_HITS))
def evl_1b(spark, sf_dir):
    """Events of a result with known faults, by kind."""
    gt = boxes(spark, sf_dir).withColumn("category_id", F.col("track_id") % 2)
    return M.clear_events(gt, _faulty(gt), limit=SAME).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_BY = "SELECT {key}, round(2 * sum(greatest(a, b)) / (sum(n) + sum(h))::DOUBLE, 9) AS \"IDF1\", {mota} AS \"MOTA\", sum(n - h)::BIGINT AS \"FN\", count(*) FILTER (a > 0 AND b > 0) AS \"IDSw\", round(sum(h) / sum(n)::DOUBLE, 9) AS \"Rcll\" FROM hits GROUP BY 1"


def _faulty_counts(spark, sf_dir, by: list[str]) -> DataFrame:
    gt = boxes(spark, sf_dir).withColumn("category_id", F.col("track_id") % 2)
    m = M.mot_metrics(M.mot_counts(kept(M.clear_events(gt, _faulty(gt), limit=SAME), "events"), by))
    return m.select(*by, F.round("IDF1", 9).alias("IDF1"), F.round("MOTA", 9).alias("MOTA"), "FN", "IDSw", F.round("Rcll", 9).alias("Rcll"))


@query("EVL-4b", oracle(_BY.format(key="track_id // 50 AS video_id", mota=_MOTA), hits=_HITS))
def evl_4b(spark, sf_dir):
    """Metrics of a result with known faults per video."""
    return _faulty_counts(spark, sf_dir, ["video_id"])


@query("EVL-6b", oracle(_BY.format(key="CASE WHEN track_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category", mota=_MOTA), hits=_HITS))
def evl_6b(spark, sf_dir):
    """Metrics of a result with known faults by names of classes."""
    names = spark.createDataFrame([(0, "even"), (1, "odd")], "category_id long, category string")
    return _faulty_counts(spark, sf_dir, ["category_id"]).join(F.broadcast(names), "category_id").drop("category_id")


@query("AGG-10b", oracle("SELECT 'AVERAGE' AS category_id, round(avg(\"IDF1\"), 9) AS \"IDF1\", round(avg(\"MOTA\"), 9) AS \"MOTA\", sum(\"FN\")::BIGINT AS \"FN\" FROM (" + _BY.format(key="track_id % 2", mota=_MOTA.replace(", 9)", ", 15)")).replace(", 9)", ", 15)") + ") UNION ALL SELECT 'OVERALL', \"IDF1\", \"MOTA\", \"FN\" FROM (" + _BY.format(key="1 AS one", mota=_MOTA) + ")", hits=_HITS))
def agg_10b(spark, sf_dir):
    """The OVERALL and AVERAGE rows of a result with known faults."""
    gt = boxes(spark, sf_dir).withColumn("category_id", F.col("track_id") % 2)
    report = M.mot_report(kept(M.clear_events(gt, _faulty(gt), limit=SAME), "events")).filter("category_id IN ('OVERALL', 'AVERAGE')")
    return report.select("category_id", F.round("IDF1", 9).alias("IDF1"), F.round("MOTA", 9).alias("MOTA"), "FN")


@query("EVL-3")
def evl_3(spark, sf_dir):
    """The summary as text lines, one per class and two over all."""
    r = evl_2(spark, sf_dir)
    cells = F.concat_ws(" ", *[F.format_string("%-8.3f", F.col(c).cast("double")) for c in r.columns[1:]])
    return r.select(F.format_string("%-10s %s", "category_id", cells).alias("line"))


@query("EVL-4")
def evl_4(spark, sf_dir):
    """Evaluation per video."""
    return M.mot_metrics(M.mot_counts(_events(spark, sf_dir), ["video_id"]))


@query("EVL-6")
def evl_6(spark, sf_dir):
    """Evaluation with classes by name."""
    names = spark.createDataFrame([(0, "even"), (1, "odd")], "category_id long, category string")
    return M.mot_metrics(M.mot_counts(_events(spark, sf_dir), ["category_id"])).join(F.broadcast(names), "category_id").drop("category_id")


@query("EVL-7", oracle(f"SELECT split, round(avg(m), 9) AS \"MOTA\" FROM (SELECT track_id % 4 AS c, {_MOTA} AS m FROM hits GROUP BY 1), (VALUES ('base'), ('combined'), ('novel')) v(split) WHERE split = 'combined' OR (split = 'novel') = (c > 2) GROUP BY split", hits=_HITS))
def evl_7(spark, sf_dir):
    """Means of a metric over base, novel and all classes, of a result with known faults."""
    gt = boxes(spark, sf_dir).withColumn("category_id", F.col("track_id") % 4)
    per = M.mot_metrics(M.mot_counts(kept(M.clear_events(gt, _faulty(gt), limit=SAME), "events"), ["category_id"]))
    split = per.withColumn("MOTA", F.round("MOTA", 9)).withColumn("split", F.when(F.col("category_id") > 2, "novel").otherwise("base"))
    return split_means(split, ["MOTA"]).withColumn("MOTA", F.round("MOTA", 9))


@query("EVL-8", oracle("SELECT run, round(avg(recall), 9) AS recall, sum(missed)::BIGINT AS missed FROM (SELECT run, video_id, avg(CASE WHEN run = 1 AND ord % 10 = 0 THEN 0.0 ELSE 1.0 END) AS recall, count(*) FILTER (run = 1 AND ord % 10 = 0) AS missed FROM boxes, (VALUES (0::BIGINT), (1)) v(run) GROUP BY ALL) GROUP BY run"))
def evl_8(spark, sf_dir):
    """Two result sets evaluated in one job: runs are told apart by the video number."""
    gt = boxes(spark, sf_dir).withColumn("category_id", F.lit(0).cast("long")).withColumn("run", F.explode(F.array(F.lit(0), F.lit(1))))
    gt = gt.withColumn("video_id", F.col("video_id") * 2 + F.col("run"))
    events = kept(M.clear_events(gt, gt.filter("run = 0 OR ord % 10 <> 0"), limit=SAME), "events")
    return M.mot_metrics(M.mot_counts(events, ["video_id"])).groupBy((F.col("video_id") % 2).alias("run")).agg(F.round(F.avg("Rcll"), 9).alias("recall"), F.sum("FN").alias("missed"))


_TETA = """WITH c AS (
  SELECT avg(coalesce(tp / nullif(tp + fn + fp, 0)::DOUBLE, 0)) AS s, avg(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)) AS re, avg(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)) AS pr
  FROM (SELECT c, (SELECT count(*) FROM p WHERE gl = pl AND gl = c) AS tp, (SELECT count(*) FROM p WHERE gl <> pl AND gl = c) AS fn, (SELECT count(*) FROM p WHERE gl <> pl AND pl = c) AS fp
        FROM (SELECT gl AS c FROM p UNION SELECT pl FROM p))
), a AS (
  SELECT sum(t * t / (n + t - t)::DOUBLE) / sum(t) AS s, sum(t * t / n::DOUBLE) / sum(t) AS re, sum(t * t / t::DOUBLE) / sum(t) AS pr
  FROM (SELECT track_id, late, count(*) AS t FROM p GROUP BY ALL) JOIN (SELECT track_id, count(*) AS n FROM boxes GROUP BY 1) USING (track_id)
), l AS (SELECT (SELECT count(*) FROM p) / count(*)::DOUBLE AS s FROM boxes)
SELECT round((l.s + a.s + c.s) / 3, 9) AS "TETA", round(l.s, 9) AS "LocS", round(a.s, 9) AS "AssocS", round(c.s, 9) AS "ClsS", round(l.s, 9) AS "LocRe", 1.0::DOUBLE AS "LocPr",
  round(a.re, 9) AS "AssocRe", round(a.pr, 9) AS "AssocPr", round(c.re, 9) AS "ClsRe", round(c.pr, 9) AS "ClsPr" FROM c, a, l"""


@query(
    "EVL-5",
    oracle(
        f"SELECT * FROM ({_TETA})",
        win="SELECT track_id, category_id AS gl FROM (SELECT track_id, category_id, row_number() OVER (PARTITION BY track_id ORDER BY count(*) DESC, category_id) AS r FROM boxes GROUP BY 1, 2) WHERE r = 1",
        p="SELECT track_id, frame_id >= 25 AS late, gl, CASE WHEN ord % 7 = 0 THEN (gl + 1) % 5 ELSE gl END AS pl FROM boxes JOIN win USING (track_id) WHERE ord % 10 <> 0",
    ),
)
def evl_5(spark, sf_dir):
    """The ten numbers of a result with known faults, and wrong classes for every seventh box."""
    gt = kept(majority_category(boxes(spark, sf_dir)), "gt")
    wrong = F.when(F.col("ord") % 7 == 0, (F.col("category_id") + 1) % 5).otherwise(F.col("category_id"))
    found = M.teta(gt, _faulty(gt).withColumn("category_id", wrong), limit=SAME)
    return found.select(*[F.round(m, 9).alias(m) for m in M.TETA])


@query("AGG-10")
def agg_10(spark, sf_dir):
    """The OVERALL and AVERAGE rows."""
    return M.mot_report(_events(spark, sf_dir)).filter("category_id IN ('OVERALL', 'AVERAGE')")


@query("JON-17")
def jon_17(spark, sf_dir):
    """Detections joined to the memory of their video, as far as they matched a track born earlier."""
    out = track(detections(spark, sf_dir), {"type": "memo"}).filter("track_id > -1")
    born = out.groupBy("video_id", "track_id").agg(F.min("frame_id").alias("born"))
    return out.join(born, ["video_id", "track_id"]).filter("frame_id > born").select("ord", "track_id", "born")
