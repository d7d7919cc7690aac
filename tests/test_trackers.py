"""Trackers row by row against plain loops over dictionaries, with frames without detections, frames with
one detection and videos with one track."""

import math
import random
from itertools import permutations

import numpy as np
import pandas as pd
import pytest

from trackmill.operators import kernels as K
from trackmill.operators.tracking import COLUMNS, Frame, Run, track
from trackmill.plans.metrics import most_explained


def video(seed, objects=4, frames=26, size=6):
    """Boats that drift, each with its own look; some frames are empty, in some only one is seen."""
    rng = random.Random(seed)
    boats = [dict(x=rng.uniform(0, 60), y=rng.uniform(0, 60), dx=rng.uniform(-3, 3), dy=rng.uniform(-3, 3), w=rng.uniform(20, 40), h=rng.uniform(20, 40), label=rng.randrange(2), look=[rng.gauss(0, 1) for _ in range(size)]) for _ in range(objects)]
    out, n = [], 0
    for t in range(frames):
        for b in boats:
            b["x"], b["y"] = b["x"] + b["dx"], b["y"] + b["dy"]
        seen = [] if t in (5, 6, 7, 15) or t in range(18, 22) and seed % 2 else [rng.choice(boats)] if t % 9 == 4 else [b for b in boats if rng.random() < 0.85]
        for b in seen:
            x, y = b["x"] + rng.gauss(0, 0.5), b["y"] + rng.gauss(0, 0.5)
            label = b["label"] if rng.random() < 0.95 else 1 - b["label"]
            out.append((seed, t, n, label, x, y, x + b["w"], y + b["h"], round(rng.uniform(0.05, 1), 3), [v + rng.gauss(0, 0.15) for v in b["look"]]))
            n += 1
    return out


VIDEOS = [video(s, objects=n) for s, n in ((1, 4), (2, 5), (3, 1), (4, 3), (5, 6))]


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return inter / (area(a) + area(b) - inter)


def height_iou(a, b):
    return (min(a[3], b[3]) - max(a[1], b[1])) / (max(a[3], b[3]) - min(a[1], b[1])) * iou(a, b)


def cosine(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))


def cheapest(cost):
    """All ways to pair rows with columns, tried one by one; the cheapest of those that pair most."""
    n, m = len(cost), len(cost[0]) if cost else 0
    if not n or not m:
        return []
    small, turned = (range(n), False) if n <= m else (range(m), True)
    big = lambda i, j: cost[j][i] if turned else cost[i][j]
    best = min(permutations(range(max(n, m)), len(small)), key=lambda p: sum(min(big(i, j), 1e9) for i, j in zip(small, p, strict=True)))
    return sorted((j, i) if turned else (i, j) for i, j in zip(small, best, strict=True))


def frames_of(rows, every):
    """Each frame's detections in order; frames without any too, where they are told of."""
    last = max(r[1] for r in rows)
    first = min(r[1] for r in rows)
    for t in range(first, last + 1):
        found = [dict(ord=r[2], label=r[3], box=r[4:8], score=r[8], look=r[9]) for r in rows if r[1] == t]
        if found or every:
            yield t, found


def without_weak(found):
    return [d for i, d in enumerate(found) if not (d["score"] < 0.5 and any(iou(d["box"], o["box"]) > 0.3 for o in found[:i]))]


def plain_memo(rows, memory=10, momentum=0.8):
    tracks, out, born = {}, {r[2]: -1 for r in rows}, 0
    for t, found in frames_of(rows, every=False):
        found = without_weak(found)
        names = list(tracks)
        e = [[math.exp(sum(p * q for p, q in zip(d["look"], tracks[k]["look"], strict=True))) for k in names] for d in found]
        score = [[(e[i][j] / (sum(e[i]) + 1e-6) + e[i][j] / (sum(r[j] for r in e) + 1e-6)) / 2 for j in range(len(names))] for i in range(len(found))]
        score = [[(v + cosine(found[i]["look"], tracks[names[j]]["look"])) / 2 for j, v in enumerate(r)] for i, r in enumerate(score)]
        for i, d in enumerate(found):
            if names and d["score"] >= 0.3:
                j = max(range(len(names)), key=lambda j: score[i][j])
                if score[i][j] > 0.5:
                    out[d["ord"]] = names[j]
                    for other in range(len(found)):
                        if other != i:
                            score[other][j] = 0
        for d in found:
            k = out[d["ord"]]
            if k < 0 and d["score"] > 0.5:
                k = out[d["ord"]] = born
                tracks[k], born = {"look": d["look"]}, born + 1
            elif k >= 0:
                tracks[k]["look"] = [(1 - momentum) * a + momentum * b for a, b in zip(tracks[k]["look"], d["look"], strict=True)]
            if k >= 0:
                tracks[k]["seen"] = t
        tracks = {k: v for k, v in tracks.items() if t - v["seen"] < memory}
    return out


def plain_sort(rows):
    kf, tracks, out, born = K.BoxKalman(), {}, {r[2]: -1 for r in rows}, 0
    for t, found in frames_of(rows, every=True):
        found = [d for d in found if d["score"] > 0.5]
        z = [K.BoxKalman.measure(np.array(d["box"])) for d in found]
        if found:
            for v in tracks.values():
                v["at"] = kf.predict(*v["at"])
        sure = [k for k, v in tracks.items() if v["n"] >= 3]
        cost = []
        for k in sure:
            mean = [sum(c) / len(tracks[k]["looks"]) for c in zip(*tracks[k]["looks"], strict=True)]
            gate = [float(kf.gating(*tracks[k]["at"], m[None])[0]) for m in z]
            cost.append([math.dist(mean, d["look"]) if g <= kf.gate() else math.inf for d, g in zip(found, gate, strict=True)])
        got = {}
        for i, j in cheapest(cost):
            if cost[i][j] <= 2.0:
                got[j] = sure[i]
        recent = [k for k, v in tracks.items() if v["seen"] == t - 1 and k not in got.values()]
        left = [j for j in range(len(found)) if j not in got]
        cost = [[1 - iou(tracks[k]["box"], found[j]["box"]) for j in left] for k in recent]
        for i, j in cheapest(cost):
            if cost[i][j] < 1 - 0.7:
                got[left[j]] = recent[i]
        for j, d in enumerate(found):
            if j not in got:
                got[j] = born
                tracks[born], born = {"n": 0, "looks": [], "at": kf.initiate(z[j])}, born + 1
            else:
                tracks[got[j]]["at"] = kf.update(*tracks[got[j]]["at"], z[j])
            v = tracks[got[j]]
            v.update(n=v["n"] + 1, looks=[*v["looks"], d["look"]][-10:], box=d["box"], seen=t)
            out[d["ord"]] = got[j]
        tracks = {k: v for k, v in tracks.items() if v["seen"] == t or v["n"] >= 3 and t - v["seen"] < 100}
    return out


def heading(a, b):
    dy, dx = (b[1] + b[3] - a[1] - a[3]) / 2, (b[0] + b[2] - a[0] - a[2]) / 2
    n = math.hypot(dy, dx) + 1e-6
    return dy / n, dx / n


def plain_public(rows, thresh=0.6, limit=0.15, hits=3, steps=3, age=30):
    tracks, out, born, frames = {}, {r[2]: -1 for r in rows}, 0, 0
    for _, found in frames_of(rows, every=True):
        frames += 1
        found = [d for d in found if d["score"] > thresh]
        guess = {}
        for k, v in list(tracks.items()):
            v["filter"].predict()
            guess[k] = v["filter"].box()
            v["age"] += 1
            v["run"], v["gap"] = v["run"] if not v["gap"] else 0, v["gap"] + 1
            if not np.isfinite(guess[k]).all():
                del tracks[k]
        names = list(tracks)

        def back(v):
            return next((v["boxes"][v["age"] - k] for k in range(steps, 0, -1) if v["age"] - k in v["boxes"]), v["last"])

        same = lambda d, k: d["label"] == tracks[k]["label"]
        gain = [[iou(d["box"], guess[k]) if same(d, k) else -1e9 for k in names] for d in found]
        cost = []
        for d, row in zip(found, gain, strict=True):
            cost.append([])
            for k, g in zip(names, row, strict=True):
                ref, turn = back(tracks[k]), 0.0
                if ref is not None:
                    a, b = heading(ref, d["box"]), tracks[k]["way"]
                    turn = (math.pi / 2 - abs(math.acos(max(-1, min(1, a[0] * b[0] + a[1] * b[1]))))) / math.pi * 0.05
                cost[-1].append(-(g + turn))
        over = [(i, j) for i, r in enumerate(gain) for j, g in enumerate(r) if g > limit]
        alone = over and len({i for i, _ in over}) == len({j for _, j in over}) == len(over)
        pairs = over if alone else cheapest(cost)
        got = {i: names[j] for i, j in pairs if gain[i][j] >= limit}
        left, free = [i for i in range(len(found)) if i not in got], [k for k in names if k not in got.values() and tracks[k]["last"] is not None]
        gain = [[height_iou(found[i]["box"], tracks[k]["last"]) if same(found[i], k) else -1e9 for k in free] for i in left]
        if left and free and max(map(max, gain)) > limit - 0.1:
            got |= {left[i]: free[j] for i, j in cheapest([[-g for g in r] for r in gain]) if gain[i][j] >= limit - 0.1}
        for i, k in got.items():
            v, box = tracks[k], np.array(found[i]["box"])
            before = back(v)
            v["filter"].update(K.ScoreKalman.measure(box, 1.0))
            v["way"] = (0.0, 0.0) if before is None else heading(before, found[i]["box"])
            v["boxes"][v["age"]] = v["last"] = found[i]["box"]
            v["boxes"] = {a: b for a, b in v["boxes"].items() if a >= v["age"] - steps}
            v["gap"], v["run"] = 0, v["run"] + 1
            v["rows"].append(found[i]["ord"])
            if frames <= hits or v["run"] >= hits:
                out[found[i]["ord"]] = k + 1
            if v["run"] == hits:
                for o in v["rows"][-hits:-1]:
                    out[o] = k + 1
        for i, d in enumerate(found):
            if i not in got:
                tracks[born] = dict(filter=K.ScoreKalman(K.ScoreKalman.measure(np.array(d["box"]), 1.0)), age=0, gap=0, run=0, last=None, boxes={}, way=(0.0, 0.0), rows=[], label=d["label"])
                if frames <= hits:
                    out[d["ord"]] = born + 1
                born += 1
        tracks = {k: v for k, v in tracks.items() if v["gap"] <= age}
    return out


SCHEMA = "video_id long, frame_id long, ord long, category_id long, x1 double, y1 double, x2 double, y2 double, score double, embedding array<double>"


@pytest.mark.parametrize(("kind", "plain"), [("memo", plain_memo), ("sort", plain_sort), ("hybrid_sort_public", plain_public)])
def test_tracks_row_by_row(spark, kind, plain):
    rows = [(v, t, v * 1000 + o, *rest) for part in VIDEOS for v, t, o, *rest in part]
    got = {r.ord: r.track_id for r in track(spark.createDataFrame(rows, SCHEMA).repartition(3), {"type": kind}).collect()}
    want = {part[0][0] * 1000 + o: k for part in VIDEOS for o, k in plain(part).items()}
    assert got == want
    assert len(set(want.values())) > 3 and -1 in want.values()


def test_frames_without_detections_count(spark):
    """A boat seen on five frames, gone for seven, seen again: a tracker that waits three frames for it
    must find a new track, whether the empty frames are named or are gaps in the numbers."""
    still = lambda t, o: (1, t, o, 0, 10.0, 10.0, 40.0, 40.0, 0.9, [1.0, 0.0])
    rows = [still(t, t) for t in range(5)] + [still(t, t) for t in range(12, 17)]
    df = spark.createDataFrame(rows, SCHEMA)
    frames = spark.createDataFrame([(1, t) for t in range(17)], "video_id long, frame_id long")
    last = lambda out: {r.ord: r.track_id for r in out.collect()}[16]
    short, long = {"type": "hybrid_sort", "max_age": 3}, {"type": "hybrid_sort", "max_age": 30}
    assert last(track(df, short)) == last(track(df, short, frames)) == 2
    assert last(track(df, long)) == last(track(df, long, frames)) == 1
    thinned = df.selectExpr("video_id", "frame_id * 30 AS frame_id", *COLUMNS[2:])
    named = frames.selectExpr("video_id", "frame_id * 30 AS frame_id").filter("frame_id < 150 OR frame_id >= 360")
    assert last(track(thinned, short, named)) == 1  # no frame in between was ever taken


def test_fusion_has_no_size_limit():
    """One detection and one track: the confidence of a lone pair is what the formula gives."""
    assert K.cycle_confidence(np.array([[0.3]])).tolist() == [1.0]
    assert np.allclose(K.cycle_confidence(np.array([[0.3, 0.1]])), 1.0)


def test_doubled_updates_and_stable_scores(spark):
    rows = [(v, t, v * 1000 + o, *rest) for part in VIDEOS[:2] for v, t, o, *rest in part]
    df = spark.createDataFrame(rows, SCHEMA)
    ids = lambda c: {r.ord: r.track_id for r in track(df, c).collect()}
    assert ids({"type": "memo", "stable": True}) == ids({"type": "memo"})
    assert len(ids({"type": "blend", "compat": True})) == len(rows)
    assert np.isfinite(K.bi_softmax_matrix(np.array([[900.0, 1.0], [2.0, 880.0]]), stable=True)).all()


def test_many_filters_are_as_one():
    rng = np.random.default_rng(5)
    start = rng.uniform(20, 60, (6, 5))
    many, alone = K.ScoreKalmans(), [K.ScoreKalman(z) for z in start]
    many.begin(start)
    for _ in range(12):
        z, seen = start + rng.normal(0, 2, (6, 5)), rng.random(6) < 0.6
        at = np.flatnonzero(rng.random(6) < 0.9)
        many.predict(at)
        many.update(at, z[at], seen[at])
        for i in at.tolist():
            alone[i].predict()
            alone[i].update(z[i] if seen[i] else None)
        assert np.allclose(many.x, [k.x for k in alone]) and np.allclose(many.p, [k.p for k in alone])
        assert np.allclose(many.box(np.arange(6)), [k.box() for k in alone])
    kf, boxes = K.BoxKalman(), rng.uniform(0, 50, (7, 2))
    z = K.BoxKalman.measure(np.c_[boxes, boxes + rng.uniform(10, 30, (7, 2))])
    state = kf.predict(*kf.initiate(z))
    off = z + rng.normal(0, 1, z.shape)
    one = [kf.predict(*kf.initiate(m)) for m in z]
    assert np.allclose(kf.gating(*state, off), [kf.gating(*s, o[None])[0] for s, o in zip(one, off, strict=True)])
    assert np.allclose(kf.update(*state, off)[1], [kf.update(*s, o)[1] for s, o in zip(one, off, strict=True)])


def test_linear_filter():
    f, h, q, r = np.array([[1.0, 1], [0, 1]]), np.array([[1.0, 0]]), np.eye(2) * 0.01, np.eye(1)
    zs = [np.array([0.5 * t + math.sin(t)]) for t in range(200)]
    made = lambda m=None: K.LinearKalman(f, h, q, r, np.zeros(2), np.eye(2) * 10, m)
    means, covs, total = made().batch(zs)
    assert np.allclose(means[-1], made().steady(np.array(zs))[-1], atol=1e-6)
    step, want = made(), 0.0
    for z in zs:  # the likelihood of a number under its own normal distribution
        step.predict()
        spread = (h @ step.p @ h.T + r)[0, 0]
        want += -((z[0] - step.x[0]) ** 2) / spread / 2 - math.log(2 * math.pi * spread) / 2
        step.update(z)
    assert np.isclose(total, want)
    missing = [z if t % 3 else None for t, z in enumerate(zs)]
    assert np.trace(made().batch(missing)[1][-1]) > np.trace(covs[-1])
    m = np.array([[0.05], [0.02]])
    k = made(m)
    k.predict()
    joint = np.block([[k.p, k.p @ h.T + m], [(k.p @ h.T + m).T, h @ k.p @ h.T + h @ m + (h @ m).T + r]])
    x, z = k.x, np.array([1.5])
    k.update(z)  # the state given the measurement, from their joint distribution
    assert np.allclose(k.x, x + joint[:2, 2:] @ np.linalg.solve(joint[2:, 2:], z - h @ x))
    assert np.allclose(k.p, joint[:2, :2] - joint[:2, 2:] @ np.linalg.solve(joint[2:, 2:], joint[2:, :2]))


def test_identities_explained_by_components():
    rng = random.Random(2)
    for _ in range(40):
        pairs = sorted({(rng.randrange(5), rng.randrange(5)) for _ in range(rng.randrange(1, 9))})
        n = [rng.randrange(1, 9) for _ in pairs]
        best = 0
        for order in permutations(range(len(pairs))):
            g, p, total = set(), set(), 0
            for i in order:
                if pairs[i][0] not in g and pairs[i][1] not in p:
                    g.add(pairs[i][0])
                    p.add(pairs[i][1])
                    total += n[i]
            best = max(best, total)
            if len(pairs) > 6:
                break
        got = most_explained(*map(np.array, zip(*pairs, strict=True)), np.array(n))
        assert got == best if len(pairs) <= 6 else got >= best
    assert most_explained(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)) == 0


def test_stream_with_gaps_equals_batch(spark, tmp_path):
    from trackmill.streaming.tracking_stream import track_stream

    rows = pd.DataFrame(VIDEOS[1], columns=COLUMNS)
    rows["complete"] = rows.groupby("frame_id")["ord"].transform("max") == rows["ord"]
    schema = SCHEMA + ", complete boolean"
    for k, part in enumerate((rows[rows["frame_id"] < 9], rows[rows["frame_id"] >= 9])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = track_stream(source, {"type": "hybrid_sort_public"}).writeStream.format("memory").queryName("gaps_tracked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.ord: r.track_id for r in spark.table("gaps_tracked").collect()}
    want = plain_public(VIDEOS[1])
    held_back = set(want) - set(got)
    assert {o: k for o, k in want.items() if o in got} == got
    assert held_back <= set(rows[rows["frame_id"] >= sorted(set(rows["frame_id"]))[-2]]["ord"])


@pytest.mark.parametrize("config", [{"type": "sort"}, {"type": "blend"}, {"type": "memo", "motion_weight": 0.3, "match_score": 0.3}, {"type": "hybrid_sort"}, {"type": "hybrid_sort_public"}], ids=lambda c: c["type"])
def test_filters_of_a_frame_take_their_steps_together(config, monkeypatch):
    calls, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda *a: calls.append(1) or solve(*a))
    tracker, n = Run(config).tracker, 30
    x, look = np.arange(n) * 100.0, np.eye(n) * 5
    for t in range(12):
        boxes = np.stack([x + t, np.zeros(n), x + t + 40, np.full(n, 50.0)], 1)
        ids = tracker.step(Frame(t, boxes, np.full(n, 0.9), np.zeros(n, int), look))
    assert len(set(ids.tolist())) == n and min(ids) >= 0  # all objects are followed
    assert len(calls) <= 3 * 12
