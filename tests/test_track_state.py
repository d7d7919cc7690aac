"""The trackers in event time: unordered frames give the batch result, ended videos leave no state."""

import datetime as dt
import random

import pandas as pd
import pytest
from test_trackers import VIDEOS, video

from trackmill.operators.tracking import COLUMNS, Run, track
from trackmill.streaming import track_state as T
from trackmill.streaming.event_time import run_to

SCHEMA = "video_id long, frame_id long, ord long, category_id long, x1 double, y1 double, x2 double, y2 double, score double, embedding array<double>"
START = dt.datetime(2024, 5, 1)
KINDS = ["memo", "sort", "blend", "hybrid_sort", "hybrid_sort_public"]


@pytest.mark.parametrize("kind", KINDS)
def test_a_run_taken_apart_and_put_together_goes_on_alike(kind):
    rows = pd.DataFrame(video(7, objects=5), columns=COLUMNS)
    whole, parts, out = Run({"type": kind}), Run({"type": kind}), ([], [])
    for frame, part in rows.groupby("frame_id"):
        out[0].extend(whole.frame(int(frame), part, True))
        rest, tracks = T.taken_apart(parts)
        parts = T.put_together({"type": kind}, rest, tracks)
        out[1].extend(parts.frame(int(frame), part, True))
        assert {k for _, k in tracks} <= set(range(1000))
    a, b = (pd.concat([*o, *r.close()]).sort_values("ord")["track_id"].tolist() for o, r in zip(out, (whole, parts), strict=True))
    assert a == b and max(a) > 2


@pytest.mark.parametrize("kind", ["memo", "hybrid_sort_public"])
def test_unordered_frames_give_the_batch_result(spark, tmp_path, kind):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", T.PROVIDER)
    try:
        rows = [r for v in VIDEOS[:3] for r in v]
        at = lambda r: START + dt.timedelta(hours=3 * VIDEOS.index(next(v for v in VIDEOS if v[0][0] == r[0])), seconds=int(r[1]))
        rng = random.Random(3)
        arrival = sorted(rows, key=lambda r: (at(r), rng.random()))
        arrival.sort(key=lambda r: at(r) + dt.timedelta(seconds=rng.randrange(5)))  # up to four frames late
        table = [(*r[:2], i, *r[3:], at(r)) for i, r in enumerate(arrival)]
        last = (99, 0, 10**6, 0, 0.0, 0.0, 1.0, 1.0, 0.9, [1.0] * len(rows[0][-1]), START + dt.timedelta(days=9))
        (tmp_path / "in").mkdir()
        source = spark.readStream.schema(SCHEMA + ", ts timestamp").parquet(str(tmp_path / "in"))
        out = T.track_events(source, {"type": kind}, "6 seconds", 60)
        n = len(table)
        for part in (table[: n // 3], table[n // 3 : n // 2], table[n // 2 :], [last], [(98, *last[1:2], 10**6 + 1, *last[3:-1], last[-1] + dt.timedelta(days=1))]):
            spark.createDataFrame(part, SCHEMA + ", ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            run_to(out, str(tmp_path / "out"), str(tmp_path / "log"))
        got = {r.ord: r.track_id for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.ord < 10**6}
        want = {r.ord: r.track_id for r in track(spark.createDataFrame([r[:-1] for r in table], SCHEMA), {"type": kind}).collect()}
        assert got == want
        state = spark.read.format("statestore").option("stateVarName", "rest").load(str(tmp_path / "log"))
        assert {r.key[0] for r in state.collect()} <= {98, 99}  # only videos that are not over
        tracks = spark.read.format("statestore").option("stateVarName", "tracks").load(str(tmp_path / "log"))
        assert {r.key[0] for r in tracks.collect()} <= {98, 99}
    finally:
        if provider is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
