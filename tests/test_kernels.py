import itertools

import numpy as np
import pandas as pd
import pytest

from trackmill.operators import kernels as K
from trackmill.operators.tracking import COLUMNS, track, tracked
from trackmill.plans import metrics as M
from trackmill.registry import build


def best_cost(cost):
    n, m = cost.shape
    if n > m:
        return best_cost(cost.T)
    return min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


def test_assign_is_optimal_and_one_to_one():
    rng = np.random.default_rng(0)
    for _ in range(200):
        cost = rng.normal(size=(rng.integers(1, 6), rng.integers(1, 6)))
        pairs = K.assign(cost)
        assert len(pairs) == min(cost.shape) and len(set(pairs[:, 0])) == len(set(pairs[:, 1])) == len(pairs)
        assert np.isclose(cost[pairs[:, 0], pairs[:, 1]].sum(), best_cost(cost))


def test_assign_limits_and_impossible_pairs():
    cost = np.array([[np.inf, 1.0], [np.inf, 0.5]])
    assert K.assign(cost).tolist() == [[1, 1]]
    assert K.assign(np.array([[0.9, 2.0], [2.0, 0.1]]), 0.5).tolist() == [[1, 1]]
    assert K.assign(np.zeros((0, 3))).shape == (0, 2)


def test_associate_reports_the_rest():
    pairs, rows, columns = K.associate(np.array([[0.9, 0.0], [0.0, 0.1], [0.2, 0.0]]), 0.3)
    assert pairs.tolist() == [[0, 0]] and rows.tolist() == [1, 2] and columns.tolist() == [1]


def test_greedy_match_takes_columns_once():
    score = np.array([[0.9, 0.8], [0.95, 0.2], [0.4, 0.7]])
    assert K.greedy_match(score, 0.3).tolist() == [0, -1, 1]
    with pytest.raises(ValueError, match="negative"):
        K.greedy_match(score, -0.1)


def test_iou_is_symmetric_and_bounded():
    rng = np.random.default_rng(1)
    a = np.sort(rng.random((30, 2, 2)), axis=1).reshape(30, 4)
    m = K.iou_matrix(a, a)
    assert np.allclose(m, m.T) and (m >= 0).all() and (m <= 1 + 1e-12).all() and np.allclose(np.diag(m), 1)


def test_nms_against_definition():
    rng = np.random.default_rng(2)
    xy = rng.random((40, 2)) * 20
    boxes, scores = np.c_[xy, xy + 8], rng.random(40).round(1)
    kept = K.greedy_nms(boxes, scores, 0.3)
    iou = K.iou_matrix(boxes, boxes)
    order = sorted(range(40), key=lambda i: (-scores[i], i))
    want = []
    for i in order:
        if all(iou[i, j] <= 0.3 for j in want):
            want.append(i)
    assert kept.tolist() == want


def test_kalman_follows_constant_velocity():
    kf = K.BoxKalman()
    state = kf.initiate(np.array([0.0, 0.0, 1.0, 20.0]))
    for t in range(1, 40):
        state = kf.predict(*state)
        z = np.array([3.0 * t, -2.0 * t, 1.0, 20.0])
        gate = kf.gating(*state, z[None])[0]
        state = kf.update(*state, z)
    assert np.allclose(state[0][4:6], [3, -2], atol=0.05) and gate < kf.gate()
    assert np.allclose(state[1], state[1].T) and (np.linalg.eigvalsh(state[1]) > 0).all()


def test_score_kalman_replays_gaps():
    seen = lambda t: K.ScoreKalman.measure(np.array([2.0 * t, 0, 2.0 * t + 10, 20]), 0.8)
    f = K.ScoreKalman(seen(0))
    for t in range(1, 30):
        f.predict()
        f.update(None if 10 <= t < 15 else seen(t))
    assert np.allclose(f.box(), [58, 0, 68, 20], atol=1.0) and abs(f.x[3] - 0.8) < 0.01


def test_smoother_is_surer_than_the_filter():
    f, q, h = np.array([[1, 1], [0, 1.0]]), np.eye(2) * 0.01, np.array([[1.0, 0]])
    x, p, means, covs = np.zeros(2), np.eye(2) * 10, [], []
    for z in (0.1, 1.0, 2.2, 2.9, 4.1):
        gain = p @ h.T / (h @ p @ h.T + 0.5)
        x, p = x + gain @ (z - h @ x), p - gain @ h @ p
        means.append(x)
        covs.append(p)
        x, p = f @ x, f @ p @ f.T + q
    means, covs = np.array(means), np.array(covs)
    sx, sp = K.smooth(f, q, means, covs)
    assert np.allclose(sx[-1], means[-1]) and np.allclose(sp[-1], covs[-1])
    assert all(np.trace(a) < np.trace(b) for a, b in zip(sp[:-1], covs[:-1], strict=True))
    assert np.abs(sx[:, 0] - np.arange(5)).max() < 0.25


def test_dbscan():
    points = np.array([[0, 0], [0, 0.03], [0.03, 0], [1, 1], [1, 1.02], [1.02, 1], [5, 5.0]])
    assert K.dbscan(points).tolist() == [0, 0, 0, 1, 1, 1, -1]


def scene(frames=12, hidden=range(0)):
    """Three objects on straight lines with their own looks; the second is hidden for some frames."""
    looks = np.eye(4)[:3] * 3
    rows = []
    for t in range(frames):
        for k in range(3):
            if k == 1 and t in hidden:
                continue
            x, y = 100.0 * k + 4 * t, 50.0 + 2 * t * (k - 1)
            rows.append((k // 3, t, t * 3 + k, k, x, y, x + 40.0, y + 60.0, 0.9 - 0.05 * k, (looks[k] + 0.01 * t).tolist(), k))
    return pd.DataFrame(rows, columns=[*COLUMNS, "object"])


ALL = ["memo", "sort", "blend", "hybrid_sort", "hybrid_sort_public"]


def run(rows, config):
    tracker = build(config)
    return pd.concat([tracked(part, tracker) for _, part in rows.groupby("frame_id")])


@pytest.mark.parametrize("kind", ALL)
def test_trackers_keep_identities(kind):
    rows = scene()
    out = run(rows, {"type": kind}).merge(rows[["ord", "object"]], on="ord")
    out = out[out["frame_id"] >= 4]
    assert (out["track_id"] > -1).all()
    assert (out.groupby("object")["track_id"].nunique() == 1).all() and out["track_id"].nunique() == 3


@pytest.mark.parametrize("options", [{"method": "intra"}, {"metric": "cosine"}, {"motion_weight": 0.4}, {"fusion": 2.0, "match_score": 0.37}])
def test_memo_variants_keep_identities(options):
    rows = scene()
    out = run(rows, {"type": "memo", **options}).merge(rows[["ord", "object"]], on="ord")
    assert (out.groupby("object")["track_id"].nunique() == 1).all() and out["track_id"].nunique() == 3


def test_memory_is_forgotten():
    rows = scene(16, hidden=range(5, 10))
    ids = lambda n: run(rows, {"type": "memo", "memo_frames": n}).merge(rows, on="ord").query("object == 1")["track_id"].nunique()
    assert ids(10) == 1 and ids(3) == 2


def test_weak_and_distracting_detections_get_no_track():
    rows = scene(1)
    extra = rows.iloc[[0]].assign(ord=50, score=0.3, x1=lambda r: r["x1"] + 1)
    out = run(pd.concat([rows, extra]), {"type": "memo"})
    assert out.set_index("ord")["track_id"][50] == -1


@pytest.mark.parametrize("kind", ["memo", "hybrid_sort"])
def test_batch_over_videos_equals_kernel(spark, kind):
    rows = pd.concat([scene().assign(video_id=v, ord=lambda r, v=v: r["ord"] + 100 * v) for v in range(5)])
    df = spark.createDataFrame(rows[COLUMNS].sample(frac=1, random_state=1), "video_id long, frame_id long, ord long, category_id long, x1 double, y1 double, x2 double, y2 double, score double, embedding array<double>")
    got = {r.ord: r.track_id for r in track(df, {"type": kind}).collect()}
    one = run(scene(), {"type": kind}).set_index("ord")["track_id"]
    assert got == {o + 100 * v: int(t) for v in range(5) for o, t in one.items()}


def test_stream_equals_batch(spark, tmp_path):
    from trackmill.streaming.tracking_stream import LATE, track_stream

    rows = scene()
    schema = "video_id long, frame_id long, ord long, category_id long, x1 double, y1 double, x2 double, y2 double, score double, embedding array<double>, complete boolean"
    rows["complete"] = rows.groupby("frame_id")["ord"].transform("max") == rows["ord"]
    late = rows.iloc[[2]].assign(ord=999, complete=False)
    for k, part in enumerate((rows[rows["frame_id"] < 5], pd.concat([rows[rows["frame_id"].between(5, 8)], late]), rows[rows["frame_id"] > 8])):
        spark.createDataFrame(part[[*COLUMNS, "complete"]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = track_stream(source, {"type": "memo"}).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.ord: r.track_id for r in spark.table("tracked").collect()}
    assert got.pop(999) == LATE
    assert got == run(scene(), {"type": "memo"}).set_index("ord")["track_id"].to_dict()


def test_gap_screen_stream(spark, tmp_path):
    from trackmill.streaming.tracking_stream import screen_stream

    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "user_id long, t string").selectExpr("user_id", "CAST(t AS timestamp) AS ts").write.parquet(str(tmp_path / "e"))
    source = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "e"))
    q = screen_stream(source, 30).writeStream.format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.key, r.gap) for r in spark.table("gaps").collect()] == [(1, 55.0)]


# --- metrics ------------------------------------------------------------------------------------

SCHEMA = "video_id long, category_id long, frame_id long, track_id long, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, rows):
    return spark.createDataFrame([(1, 1, f, t, float(x), 0.0, x + 10.0, 10.0) for f, t, x in rows], SCHEMA)


def test_clear_mot_on_a_small_case(spark):
    gt = boxes(spark, [(0, 1, 0), (1, 1, 0), (2, 1, 0), (3, 1, 0), (0, 2, 50), (1, 2, 50), (2, 2, 50), (3, 2, 50)])
    # object 1 changes its name once, object 2 is missed once in the middle, and there is one false alarm
    pred = boxes(spark, [(0, 7, 0), (1, 7, 0), (2, 8, 0), (3, 8, 0), (0, 9, 50), (2, 9, 50), (3, 9, 50), (1, 5, 200)])
    events = M.clear_events(gt, pred)
    row = M.mot_metrics(M.mot_counts(events, [])).first()
    assert (row.FP, row.FN, row.IDSw, row.FM, row.MT, row.PT, row.ML) == (1, 1, 1, 1, 1, 1, 0)
    assert row.MOTA == pytest.approx(1 - 3 / 8) and row.MOTP == 1 and row.Rcll == pytest.approx(7 / 8) and row.Prcn == pytest.approx(7 / 8)
    assert row.IDF1 == pytest.approx(2 * 5 / 16)


def test_ignored_regions_swallow_false_alarms(spark):
    gt, pred = boxes(spark, [(0, 1, 0)]), boxes(spark, [(0, 1, 0), (0, 2, 200)])
    kinds = lambda ignore: sorted(r.kind for r in M.clear_events(gt, pred, ignore).collect())
    assert kinds(None) == ["FP", "MATCH", "RAW"] and kinds(boxes(spark, [(0, -1, 200)])) == ["MATCH", "RAW"]


def test_report_rows(spark):
    gt = boxes(spark, [(0, 1, 0), (1, 1, 0)])
    both = gt.unionByName(gt.withColumn("category_id", M.F.lit(2).cast("long")))
    rows = {r.category_id: r for r in M.mot_report(M.clear_events(both, gt)).collect()}
    assert set(rows) == {"1", "2", "OVERALL", "AVERAGE"}
    assert rows["1"].MOTA == 1 and rows["2"].MOTA == 0 and rows["OVERALL"].FN == 2 and rows["AVERAGE"].Rcll == 0.5


def test_teta_of_wrong_classes(spark):
    gt = boxes(spark, [(0, 1, 0), (1, 1, 0)])
    row = M.teta(gt, gt.withColumn("category_id", M.F.lit(2).cast("long"))).first()
    assert row.LocS == 1 and row.AssocS == 1 and row.ClsS == 0 and row.TETA == pytest.approx(2 / 3)
