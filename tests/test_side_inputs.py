"""Side inputs read by tasks against the reader of one document."""

import json

from trackmill.sources import side_inputs as X
from trackmill.sources.annotations import category_split, known_filtered

SPLITS = [
    {"categories": [{"id": 1, "frequency": "r"}, {"id": "1", "frequency": "c"}, {"id": 2.0, "frequency": "f"}, {"id": True, "frequency": "r"}, {"id": "", "frequency": "r"}, {"id": 3}, {"id": 4, "frequency": 7}, 5, None, {"id": 1, "frequency": "c"}]},
    {"base_category_ids": [1, "a", 2.5, 1], "novel_category_ids": [2, 1.0], "base": [9], "novel": []},
    {"base": [], "novel": ["x"]}, {"categories": {"id": 1}}, {"categories": None, "base": [1], "novel": [2]}, {"base": [1]}, {},
]
MANIFESTS = [
    {"filtered_anchors": [{"video_id": 1, "frame_index": 0, "frame_id": 7, "track_id": "t", "category_id": 2, "reason": "blurred"}, {"video_id": 1, "frame_id": 7, "track_id": 3, "category_id": 2.5}, {"video_id": 1}, 5]},
    [{"video_id": "v", "frame_id": 1, "track_id": True, "category_id": 1}], {"anchors": [{"video_id": 1, "frame_id": 1, "track_id": 1, "category_id": 1}]}, {"filtered_anchors": 7}, {}, "text",
]


def texts(spark, documents):
    return spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(documents)], "path string, text string").repartition(3)


def test_category_splits(spark):
    rows, issues = X.category_splits(texts(spark, SPLITS))
    rows, issues = rows.collect(), issues.collect()
    for i, d in enumerate(SPLITS):
        pairs, wrong = category_split(d)
        assert sorted((r.category_id, r.is_novel) for r in rows if r.path == str(i)) == sorted(pairs), d
        assert {r.kind: r.n for r in issues if r.path == str(i)} == wrong, d


def test_manifests(spark):
    rows, issues = X.known_anchors(texts(spark, MANIFESTS))
    rows, issues = rows.collect(), issues.collect()
    for i, d in enumerate(MANIFESTS):
        want, wrong = known_filtered(d)
        assert sorted(tuple(r)[1:] for r in rows if r.path == str(i)) == sorted(want), d
        assert {r.kind: r.n for r in issues if r.path == str(i)} == wrong, d


def test_configurations(spark):
    source = "a = dict(ann_file='x/one.json', interval=3)\nb = dict(ann_file='y/one.json', interval='no')\nc = dict(ann_file='two.json', interval=2)"
    df = spark.createDataFrame([("p", source, f) for f in ("one.json", "two.json", "three.json")], "path string, text string, file string")
    assert sorted(map(str, (tuple(r)[1:] for r in X.configured(df).collect()))) == sorted(map(str, [("one.json", "y/one.json", None), ("two.json", "two.json", 2), ("three.json", None, None)]))
