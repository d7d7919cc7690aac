import json

import pytest

from trackmill.sources import detections as D
from trackmill.streaming.event_time import run_to


@pytest.fixture
def folder(tmp_path):
    for video in ("a", "b", "c"):
        (tmp_path / "in" / video).mkdir(parents=True)
        for i in range(7):
            put(tmp_path / "in", video, i)
    (tmp_path / "in" / "a" / "bad.json").write_text("{broken")
    (tmp_path / "in" / "b" / "list.json").write_text("[1, 2]")
    (tmp_path / "in" / "b" / "note.txt").write_text("no")
    return tmp_path


def put(path, video, i):
    (path / video / f"{i}.json").write_text(json.dumps({"file_name": f"{video}{i}.jpg", "boxes": [[0, 0, i, 1, 0.5, 2]] * (i % 3)}))


def test_rows_and_conditions_on_the_video(spark, folder):
    D.register(spark)
    source = lambda: spark.read.format("detections").option("files_per_task", 3).load(str(folder / "in"))
    rows = source().collect()
    assert len(rows) == 23 and sum(r.corrupt for r in rows) == 2
    assert {(r.video, r.file_name): r.boxes for r in rows if not r.corrupt} == {(v, f"{v}{i}.jpg"): [[0, 0, i, 1, 0.5, 2]] * (i % 3) for v in "abc" for i in range(7)}
    assert source().rdd.getNumPartitions() == 8
    one = source().filter("video = 'c' AND NOT corrupt")
    assert one.rdd.getNumPartitions() == 3 and one.count() == 7
    two = source().filter("video IN ('a', 'c') AND file_name LIKE '%3.jpg'")
    assert two.rdd.getNumPartitions() == 5 and sorted(r.file_name for r in two.collect()) == ["a3.jpg", "c3.jpg"]
    assert source().filter("video = 'none'").count() == 0
    with pytest.raises(Exception, match="need a path"):
        spark.read.format("detections").load().count()


def test_streams_read_each_file_once(spark, folder):
    import os

    D.register(spark)
    stream = spark.readStream.format("detections").option("files_per_task", 4).load(str(folder / "in"))
    counts = []
    for i in (None, 100, None, 101):
        if i:
            put(folder / "in", "c", i)
            os.utime(folder / "in" / "c" / f"{i}.json", ns=(2 * 10**18 + i, 2 * 10**18 + i))
        run_to(stream, str(folder / "out"), str(folder / "log"))
        counts.append(spark.read.schema(D.SCHEMA).parquet(str(folder / "out")).count())
    assert counts == [23, 24, 24, 25]
