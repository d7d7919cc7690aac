import pytest
from test_trackers import VIDEOS

from trackmill.functions.sql import register
from trackmill.operators.tracking import track

SCHEMA = "video_id long, frame_id long, ord long, category_id long, x1 double, y1 double, x2 double, y2 double, score double, embedding array<double>"


@pytest.mark.parametrize("kind", ["memo", "hybrid_sort_public"])
def test_trackers_from_sql_equal_the_operator(spark, kind):
    register(spark)
    rows = [(*r[:2], i, *r[3:]) for i, r in enumerate(r for v in VIDEOS for r in v)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = spark.sql("SELECT * FROM track_objects(TABLE(SELECT *, 1 AS more FROM {d}), {k})", d=d, k=kind)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, track(d, {"type": kind}).collect()))
    assert found.schema.simpleString() == track(d, {"type": kind}).schema.simpleString()


def test_tables_without_needed_columns_are_refused(spark):
    register(spark)
    with pytest.raises(Exception, match="needs a table with frame_id"):
        spark.sql("SELECT * FROM track_objects(TABLE(SELECT 1L AS video_id), 'memo')").collect()


def test_measures_and_aggregate(spark):
    register(spark)
    r = spark.sql("SELECT box_iou(0, 0, 2, 2, 1, 1, 3, 3) AS iou, box_iou(0, 0, 0, 0, 0, 0, 0, 0) AS none, box_giou(0, 0, 2, 2, 2, 0, 4, 2) AS giou, box_distance(0, 0, 2, 2, 3, 4, 5, 6) AS d, box_area(1, 1, 3, 4) AS a").first()
    assert (r.iou, r.none, r.giou, r.d, r.a) == (pytest.approx(1 / 7), 0, 0, 5, 6)
    b = spark.sql("SELECT k, consensus_box(b) AS box FROM VALUES (1, array(0D, 0D, 2D, 2D)), (1, array(4D, 0D, 6D, 2D)), (1, NULL), (2, CAST(NULL AS array<double>)) t(k, b) GROUP BY k")
    assert {x.k: x.box for x in b.collect()} == {1: [2, 0, 4, 2], 2: None}
