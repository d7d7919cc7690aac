"""Tracking metrics: frame-by-frame matching gives events, everything else aggregates events."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.operators import kernels as K
from trackmill.operators.groups import over_groups
from trackmill.operators.tracking import frames_of

SCOPE = ["video_id", "category_id"]
EVENT = "video_id long, category_id long, frame_id long, kind string, gt long, pred long, distance double"
BOX = ["x1", "y1", "x2", "y2"]


class ClearMatcher:
    """Keeps a frame's earlier matches where they still hold, then solves the rest."""

    def __init__(self, limit: float = 0.5, ignore_share: float = 0.5):
        self.limit, self.ignore_share = limit, ignore_share
        self.now: dict[int, int] = {}
        self.last: dict[int, int] = {}

    def step(self, gt_ids: np.ndarray, gt: np.ndarray, pred_ids: np.ndarray, pred: np.ndarray, ignore: np.ndarray) -> list[tuple]:
        """(kind, gt, pred, distance) of one frame: RAW for every close pair, MATCH, SWITCH, MISS, FP."""
        d = 1 - K.iou_matrix(gt, pred)
        d = np.where(d <= self.limit, d, np.inf)
        if len(ignore) and len(pred):
            unmatched = np.ones(len(pred), bool)
            unmatched[K.assign(d)[:, 1]] = False
            keep = ~(unmatched & (K.iou_matrix(pred, ignore, "first") > self.ignore_share).any(1))
            pred_ids, d = pred_ids[keep], d[:, keep]
        out = [("RAW", int(gt_ids[i]), int(pred_ids[j]), float(d[i, j])) for i, j in np.argwhere(np.isfinite(d))]
        place = {int(p): j for j, p in enumerate(pred_ids)}
        pairs: dict[int, int] = {}
        taken: set[int] = set()
        for i, g in enumerate(gt_ids.tolist()):
            j = place.get(self.now.get(g, -(1 << 62)))
            if j is not None and np.isfinite(d[i, j]) and j not in taken:
                pairs[i] = j
                taken.add(j)
        rows = np.array([i for i in range(len(gt_ids)) if i not in pairs], int)
        columns = np.array([j for j in range(len(pred_ids)) if j not in taken], int)
        for i, j in K.assign(d[np.ix_(rows, columns)]):
            pairs[int(rows[i])] = int(columns[j])
            taken.add(int(columns[j]))
        self.now = {}
        for i, g in enumerate(gt_ids.tolist()):
            if i not in pairs:
                out.append(("MISS", g, None, None))
                continue
            p = int(pred_ids[pairs[i]])
            kind = "SWITCH" if g in self.last and self.last[g] != p else "MATCH"
            out.append((kind, g, p, float(d[i, pairs[i]])))
            self.now[g] = self.last[g] = p
        out += [("FP", None, int(p), None) for j, p in enumerate(pred_ids.tolist()) if j not in taken]
        return out


def clear_events(gt: DataFrame, predictions: DataFrame, ignore: DataFrame | None = None, limit: float = 0.5) -> DataFrame:
    """Events of every (video, class, frame). gt and predictions: SCOPE, frame_id, track_id and corners;
    ignore: the same without track ids. Frames are streamed in order, a matcher per (video, class)."""
    side = lambda df, name: df.select(*SCOPE, "frame_id", F.lit(name).alias("side"), (F.col("track_id") if name != "ignore" else F.lit(-1)).cast("long").alias("track_id"), *BOX)
    rows = side(gt, "gt").unionByName(side(predictions, "pred"))
    if ignore is not None:
        rows = rows.unionByName(side(ignore, "ignore"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, scope, held = None, None, None
        for batch in chain(batches, [None]):
            if batch is not None:
                batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
                frames = frames_of(batch, [*SCOPE, "frame_id"])
                held = frames.pop() if frames else None  # the last frame may go on in the next batch
            else:
                frames = [held] if held is not None and len(held) else []
            out: list[tuple] = []
            for part in frames:
                here = (int(part["video_id"].iloc[0]), int(part["category_id"].iloc[0]))
                if here != scope:
                    matcher, scope = ClearMatcher(limit), here
                sides, ids, corners, at = part["side"].to_numpy(), part["track_id"].to_numpy(), part[BOX].to_numpy(float), int(part["frame_id"].iloc[0])
                g, p = sides == "gt", sides == "pred"
                out += [(*here, at, *e) for e in matcher.step(ids[g], corners[g], ids[p], corners[p], corners[sides == "ignore"])]
            if out:
                table = pd.DataFrame(out, columns=["video_id", "category_id", "frame_id", "kind", "gt", "pred", "distance"])
                yield table.astype({"gt": "Int64", "pred": "Int64", "distance": "float64"})

    return rows.repartition(*SCOPE).sortWithinPartitions(*SCOPE, "frame_id", "side", "track_id").mapInPandas(run, EVENT)


def most_explained(gt: np.ndarray, pred: np.ndarray, n: np.ndarray) -> int:
    """The largest sum of n over pairs that use each gt and each pred at most once.

    Pairs that share neither, directly or through others, don't affect each other, so each component of
    the pairs is solved alone, and no table of all gt by all pred is made."""
    _, g = np.unique(gt, return_inverse=True)
    _, p = np.unique(pred, return_inverse=True)
    label, least = np.arange(g.max(initial=-1) + 1), np.zeros(p.max(initial=-1) + 1, int)
    while True:
        least[:] = len(label)
        np.minimum.at(least, p, label[g])
        lower = label.copy()
        np.minimum.at(lower, g, least[p])
        if (lower == label).all():
            break
        label = lower
    order = np.argsort(label[g], kind="stable")
    total = 0
    for rows in np.split(order, np.flatnonzero(np.diff(label[g][order])) + 1):
        names_g, i = np.unique(g[rows], return_inverse=True)
        names_p, j = np.unique(p[rows], return_inverse=True)
        if min(len(names_g), len(names_p)) < 2:
            total += int(n[rows].max(initial=0))
            continue
        table = np.zeros((len(names_g), len(names_p)))
        table[i, j] = n[rows]
        chosen = K.assign(-table)
        total += int(table[chosen[:, 0], chosen[:, 1]].sum())
    return total


def identity_matches(events: DataFrame) -> DataFrame:
    """(video, class, idtp): the most detections that one-to-one track identities can explain."""
    pairs = events.filter("kind = 'RAW'").groupBy(*SCOPE, "gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    best = lambda c: (*(c[k][:1] for k in SCOPE), np.array([most_explained(c["gt"], c["pred"], c["n"])]))
    return over_groups(pairs, SCOPE, ["gt", "pred"], best, "video_id long, category_id long, idtp long")


COUNTS = ["gt", "pred", "matches", "misses", "fp", "switches", "distance", "idtp", "mt", "pt", "ml", "fragments"]


def mot_counts(events: DataFrame, by: list[str]) -> DataFrame:
    """Additive counts per ``by`` (a subset of SCOPE); an empty list gives one row."""
    hit = F.col("kind").isin("MATCH", "SWITCH")
    count = lambda c: F.count_if(c)
    base = events.groupBy(*SCOPE).agg(
        count(hit | (F.col("kind") == "MISS")).alias("gt"), count(hit | (F.col("kind") == "FP")).alias("pred"), count(hit).alias("matches"), count(F.col("kind") == "MISS").alias("misses"),
        count(F.col("kind") == "FP").alias("fp"), count(F.col("kind") == "SWITCH").alias("switches"), F.coalesce(F.sum(F.when(hit, F.col("distance"))), F.lit(0.0)).alias("distance"),
    )
    w = Window.partitionBy(*SCOPE, "gt").orderBy("frame_id")
    seen = events.filter("kind IN ('MATCH', 'SWITCH', 'MISS')").withColumn("on", (F.col("kind") != "MISS").cast("int"))
    seen = seen.withColumn("lost", F.when((F.col("on") == 0) & (F.lag("on").over(w) == 1), 1).otherwise(0)).withColumn("later", F.max("on").over(w.rowsBetween(1, Window.unboundedFollowing)))
    tracks = seen.groupBy(*SCOPE, "gt").agg(F.avg("on").alias("share"), F.sum(F.when(F.col("later") == 1, F.col("lost")).otherwise(0)).alias("fragments"))
    tracks = tracks.groupBy(*SCOPE).agg(
        count(F.col("share") >= 0.8).alias("mt"), count((F.col("share") < 0.8) & (F.col("share") >= 0.2)).alias("pt"), count(F.col("share") < 0.2).alias("ml"), F.sum("fragments").alias("fragments")
    )
    joined = base.join(tracks, SCOPE, "left").join(identity_matches(events), SCOPE, "left")
    return joined.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])


def mot_metrics(counts: DataFrame) -> DataFrame:
    """IDF1, MOTA, MOTP (the mean overlap), FP, FN, IDSw, Rcll, Prcn, MT, PT, ML, FM of rows of counts."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    keys = [k for k in counts.columns if k not in COUNTS]
    return counts.select(
        *keys, ratio(2 * c("idtp"), c("gt") + c("pred")).alias("IDF1"), (1 - ratio(c("fp") + c("misses") + c("switches"), c("gt"))).alias("MOTA"), (1 - ratio(c("distance"), c("matches"))).alias("MOTP"),
        c("fp").alias("FP"), c("misses").alias("FN"), c("switches").alias("IDSw"), ratio(c("matches"), c("gt")).alias("Rcll"), ratio(c("matches"), c("pred")).alias("Prcn"), c("mt").alias("MT"), c("pt").alias("PT"),
        c("ml").alias("ML"), c("fragments").alias("FM"),
    )


def mot_report(events: DataFrame) -> DataFrame:
    """Per class, OVERALL (metrics of the summed counts) and AVERAGE (sums of counts, means of ratios).
    Events are read several times, so they should be a written table."""
    per = mot_metrics(mot_counts(events, ["category_id"])).withColumn("category_id", F.col("category_id").cast("string"))
    overall = mot_metrics(mot_counts(events, [])).withColumn("category_id", F.lit("OVERALL"))
    whole = {"FP", "FN", "IDSw", "MT", "PT", "ML", "FM"}
    average = per.agg(*[(F.sum(m) if m in whole else F.avg(F.coalesce(F.nanvl(m, F.lit(0.0)), F.lit(0.0)))).alias(m) for m in per.columns[1:]]).withColumn("category_id", F.lit("AVERAGE"))
    return per.unionByName(overall).unionByName(average)


TETA = ["TETA", "LocS", "AssocS", "ClsS", "LocRe", "LocPr", "AssocRe", "AssocPr", "ClsRe", "ClsPr"]


def teta(gt: DataFrame, predictions: DataFrame, limit: float = 0.5) -> DataFrame:
    """The ten numbers at overlap 0.5, after their published definition: boxes are located without regard
    to class, then associations and classes are judged among located pairs only."""
    one = lambda df: df.withColumn("label", F.col("category_id")).withColumn("category_id", F.lit(0).cast("long"))
    g, p = one(gt), one(predictions)
    m = clear_events(g, p, limit=limit).filter("kind IN ('MATCH', 'SWITCH')").select("video_id", "frame_id", "gt", "pred")
    m = m.join(g.select("video_id", "frame_id", F.col("track_id").alias("gt"), F.col("label").alias("gl")), ["video_id", "frame_id", "gt"])
    m = m.join(p.select("video_id", "frame_id", F.col("track_id").alias("pred"), F.col("label").alias("pl")), ["video_id", "frame_id", "pred"])
    pairs = m.groupBy("video_id", "gt", "pred").agg(F.count(F.lit(1)).alias("tpa"))
    of = lambda df, name: df.groupBy("video_id", F.col("track_id").alias(name)).agg(F.count(F.lit(1)).alias("n_" + name))
    pairs = pairs.join(of(g, "gt"), ["video_id", "gt"]).join(of(p, "pred"), ["video_id", "pred"])
    weight, tpa = F.sum("tpa"), F.col("tpa")
    assoc = pairs.agg(
        (F.sum(tpa * tpa / (F.col("n_gt") + F.col("n_pred") - tpa)) / weight).alias("AssocS"), (F.sum(tpa * tpa / F.col("n_gt")) / weight).alias("AssocRe"), (F.sum(tpa * tpa / F.col("n_pred")) / weight).alias("AssocPr"), weight.alias("tp")
    )
    classes = m.select(F.col("gl").alias("c")).union(m.select("pl")).distinct()
    tally = lambda cond, key: m.filter(cond).groupBy(F.col(key).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    same = classes.join(tally("gl = pl", "gl").withColumnRenamed("n", "tp"), "c", "left").join(tally("gl <> pl", "gl").withColumnRenamed("n", "fn"), "c", "left").join(tally("gl <> pl", "pl").withColumnRenamed("n", "fp"), "c", "left").fillna(0)
    share = lambda *rest: F.avg(F.coalesce(F.try_divide(F.col("tp"), sum((F.col(r) for r in rest), F.col("tp"))), F.lit(0.0)))
    cls = same.agg(share("fn", "fp").alias("ClsS"), share("fn").alias("ClsRe"), share("fp").alias("ClsPr"))
    sizes = gt.agg(F.count(F.lit(1)).alias("n_gt")).crossJoin(predictions.agg(F.count(F.lit(1)).alias("n_pred")))  # one row by one row
    all_ = assoc.crossJoin(cls).crossJoin(sizes).withColumn("tp", F.coalesce("tp", F.lit(0)))
    tp = F.col("tp")
    all_ = all_.withColumns({"LocS": F.try_divide(tp, F.col("n_gt") + F.col("n_pred") - tp), "LocRe": F.try_divide(tp, F.col("n_gt")), "LocPr": F.try_divide(tp, F.col("n_pred"))}).fillna(0.0)
    return all_.withColumn("TETA", (F.col("LocS") + F.col("AssocS") + F.col("ClsS")) / 3).select(*TETA)
