import duckdb
import pytest

import __spark_entry__ as entry
from trackmill.operators.aggregates import sampled_pairs


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(v, f * 3) for v, n in ((7, 40), (8, 25), (20, 1), (31, 60)) for f in range(n)]
    return spark.createDataFrame(rows, "video_id long, frame_id long")


@pytest.mark.parametrize("with_self", [True, False])
def test_pairs(frames, with_self):
    given = {tuple(r) for r in frames.collect()}
    out = sampled_pairs(frames, (-2, 3), 0.6, with_self).collect()
    assert sorted((r.video_id, r.frame_id) for r in out) == sorted(given)
    assert all((r.pair_key, r.pair_frame) in given for r in out)
    assert all((r.pair_key == r.video_id) == r.positive for r in out)
    steps = {(r.pair_frame - r.frame_id) // 3 for r in out if r.positive and r.video_id != 20}
    assert steps == {-2, -1, 1, 2} | ({0} if with_self else set())
    assert 0.45 < sum(r.positive for r in out) / len(out) < 0.75
    assert {(r.video_id, r.pair_key) for r in out if not r.positive} >= {(7, 8), (7, 31), (31, 7), (31, 8)}


def test_a_single_video_has_no_other_side_for_negative_pairs(frames):
    out = sampled_pairs(frames.filter("video_id = 7"), positive=0.5).collect()
    assert len(out) == 40 and {r.positive for r in out} == {True, False}
    assert all((r.pair_frame is not None, r.pair_key is not None) == (r.positive, r.positive) for r in out)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_queries(spark, sf, size):
    sf = sf.replace("sf0.001", size)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    rows = entry.queries()["SMP-7"](spark, sf).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, con.execute(entry.oracle_sql()["SMP-7"]).fetchall()))
    assert "pair_frame" in entry.queries()["SMP-7b"](spark, sf).columns
