"""Average precision against plain loops over images, categories and detections."""

import random

import pytest
from pyspark.sql import functions as F

from trackmill.operators.aggregates import running_sums
from trackmill.operators.groups import over_groups
from trackmill.plans import average_precision as A

THRESHOLDS = (0.5, 0.75)


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(w, 0) * max(h, 0)
    return shared / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared)


def size(b):
    return (b[2] - b[0]) * (b[3] - b[1])


def plain_ap(objects, found, overlap, threshold, low, high, negative, partial, most):
    """objects: (unit, id, category, size, ignored); found: (unit, id, category, score, size) -> {category:
    (n_gt, ap)}. One detection after the other, as the definition says."""
    out = {}
    for category in {o[2] for o in objects}:
        rows, total = [], 0
        for unit in {o[0] for o in objects} | {f[0] for f in found}:
            here = [(i, g or not low <= s < high) for u, i, c, s, g in objects if (u, c) == (unit, category)]
            here.sort(key=lambda o: (o[1], o[0]))
            total += sum(not g for _, g in here)
            best = sorted([f for f in found if f[0] == unit and f[3] is not None], key=lambda f: (-f[3], f[1]))[:most]
            if not here and (unit, category) not in negative:
                if not any(o[0] == unit and o[2] == category for o in objects):
                    continue
            taken = set()
            for _, i, c, score, s in best:
                if c != category:
                    continue
                hit, reach = None, threshold
                for o, g in here:
                    if o in taken:
                        continue
                    if hit is not None and not hit[1] and g:
                        break
                    v = overlap(unit, i, o)
                    if v < (reach if hit is None or hit[1] == g else threshold):
                        continue
                    hit, reach = (o, g), v
                if hit:
                    taken.add(hit[0])
                if hit and hit[1] or not hit and (not low <= s < high or (unit, category) in partial):
                    continue
                rows.append((-score, i, bool(hit)))
        if total:
            rows.sort()
            curve, hits = [], 0
            for n, (_, _, hit) in enumerate(rows, 1):
                hits += hit
                curve.append((hits, hits / n))
            points = [max((p for h, p in curve if h * 100 >= k * total), default=0) for k in range(101)]
            out[category] = (total, sum(points) / 101)
    return out


def scene(seed, tracks=False):
    rng = random.Random(seed)
    gt, found = [], []
    n = 0
    for unit in range(6):
        frames = range(5) if tracks else [0]
        for i in range(rng.randrange(1, 7)):
            c, x, y, w, h = rng.randrange(3), rng.uniform(0, 90), rng.uniform(0, 90), rng.uniform(10, 60), rng.uniform(10, 60)
            ignored = rng.random() < 0.15
            for t in frames:
                if rng.random() < 0.9:
                    gt.append((unit, unit * 100 + i, c, t, x + 3 * t, y, x + 3 * t + w, y + h, ignored))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                n += 1
                dx, dy, label = rng.gauss(0, 5), rng.gauss(0, 5), c if rng.random() < 0.8 else rng.randrange(4)
                score = rng.choice([0.1, 0.3, 0.5, 0.9, rng.random()])
                for t in frames:
                    if rng.random() < 0.9:
                        found.append((unit, 1000 + n, label, t, x + 3 * t + dx, y + dy, x + 3 * t + w + dx, y + h + dy, score))
    return gt, found


GT = "unit long, id long, category_id long, frame_id long, x1 double, y1 double, x2 double, y2 double, ignored boolean"
FOUND = GT.replace("ignored boolean", "score double")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_boxes_match_plain_loops(spark, seed):
    gt, found = scene(seed)
    found += [(0, 5000, 1, 0, 0.0, 0.0, 10.0, 10.0, None), (9, 5001, 1, 0, 0.0, 0.0, 10.0, 10.0, 0.5)]
    negative, partial = {(u, c) for u in range(6) for c in range(4) if (u + c) % 2}, {(u, c) for u in range(6) for c in range(4) if (u * 3 + c) % 5 == 0}
    pairs = lambda s: spark.createDataFrame(sorted(s), "unit long, category_id long")
    areas = {"all": (0.0, float("inf")), "small": (0.0, 900.0), "rest": (900.0, float("inf"))}
    got = A.box_ap(spark.createDataFrame(gt, GT), spark.createDataFrame(found, FOUND), THRESHOLDS, areas=areas, negative=pairs(negative), partial=pairs(partial), most=8).collect()
    objects = [(u, i, c, size(b), g) for u, i, c, _, *b, g in gt]
    dets = [(u, i, c, s, size(b)) for u, i, c, _, *b, s in found]
    at = {i: b for _, i, _, _, *b, _ in gt + found}
    want = {}
    for name, (low, high) in areas.items():
        for t in THRESHOLDS:
            for c, v in plain_ap(objects, dets, lambda _, d, o: iou(at[d], at[o]), t, low, high, negative, partial, 8).items():
                want[c, name, t] = v
    assert {(r.category_id, r.area, r.threshold) for r in got} == set(want)
    for r in got:
        n, ap = want[r.category_id, r.area, r.threshold]
        assert r.n_gt == n and r.ap == pytest.approx(ap, abs=1e-12), r


@pytest.mark.parametrize("seed", [4, 5])
def test_tracks_match_plain_loops(spark, seed):
    gt, found = scene(seed, tracks=True)
    got = A.track_ap(spark.createDataFrame(gt, GT), spark.createDataFrame(found, FOUND), THRESHOLDS, most=None).collect()
    boxes, rows = {}, {}
    for u, i, c, t, *b, last in gt + found:
        boxes.setdefault(i, {})[t] = b
        rows.setdefault(i, []).append((u, c, last, size(b)))
    def overlap(_, d, o):
        shared = covered = 0
        for t in boxes[d].keys() | boxes[o].keys():
            a, b = boxes[d].get(t), boxes[o].get(t)
            both = size(a) + size(b) if a and b else size(a or b)
            s = iou(a, b) * both / (1 + iou(a, b)) if a and b else 0
            shared, covered = shared + s, covered + both - s
        return shared / covered
    objects = [(r[0][0], i, r[0][1], 1, all(x[2] for x in r)) for i, r in rows.items() if i < 1000]
    dets = [(r[0][0], i, r[0][1], sum(x[2] for x in r) / len(r), 1) for i, r in rows.items() if i >= 1000]
    for t in THRESHOLDS:
        want = plain_ap(objects, dets, overlap, t, 0, 9, set(), set(), None)
        assert {r.category_id: (r.n_gt, round(r.ap, 9)) for r in got if r.threshold == t} == {c: (n, round(ap, 9)) for c, (n, ap) in want.items()}


def test_no_detections_and_no_objects(spark):
    gt, found = scene(1)
    g, f = spark.createDataFrame(gt, GT), spark.createDataFrame(found, FOUND)
    rows = A.box_ap(g, f.limit(0)).collect()
    assert rows and all(r.ap == 0 and r.n_det == 0 and r.recall == 0 for r in rows)
    assert A.box_ap(g.limit(0), f).collect() == []


def test_running_sums_of_a_category_that_holds_most_rows(spark):
    rng = random.Random(0)
    rows = [(0 if rng.random() < 0.8 else rng.randrange(1, 4), rng.random(), i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, s double, i long, v long").repartition(7)
    got = {r.i: r.total for r in running_sums(df, ["k"], ["s", "i"], {"v": "total"}).collect()}
    total = {}
    for k, s, i, v in sorted(rows):
        total[k] = total.get(k, 0) + v
        assert got[i] == total[k]


def test_groups_longer_than_a_batch_are_joined_once(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, i) for k, n in enumerate([1, 100, 7, 14, 3, 50]) for i in range(n)]
        df = spark.createDataFrame(rows, "k long, i long").repartition(3)
        got = over_groups(df, ["k"], ["i"], lambda c: (c["k"][:1], c["i"].sum(keepdims=True), (c["i"][:1] == 0)), "k long, s long, first boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(k, n * (n - 1) // 2, True) for k, n in enumerate([1, 100, 7, 14, 3, 50])]


def test_summary(spark):
    rows = [(c, a, t, c / 10) for c in (1, 2, 3) for a in ("all", "small") for t in THRESHOLDS]
    per = spark.createDataFrame(rows, "category_id long, area string, threshold double, ap double")
    names = spark.createDataFrame([(1, "f"), (2, "r")], "category_id long, frequency string")
    got = {r.name: round(r.value, 9) for r in A.ap_summary(per, names).collect()}
    assert got == {"AP": 0.2, "AP50": 0.2, "AP75": 0.2, "AP_small": 0.2, "AP_f": 0.1, "AP_r": 0.2}
    assert A.ap_summary(per.withColumn("ap", F.lit(1.0))).count() == 4


def test_the_summary_of_a_result_evaluates_it_once(spark, sf, monkeypatch):
    from trackmill.plans import precision_queries as Q

    calls, box_ap = [], Q.A.box_ap
    monkeypatch.setattr(Q.A, "box_ap", lambda *a, **k: calls.append(1) or box_ap(*a, **k))
    Q.evl_5d(spark, sf)
    assert len(calls) == 1
