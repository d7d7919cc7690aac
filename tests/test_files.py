import hashlib
import io
import json
import os

import pytest
from pyspark.sql import functions as F
from test_quality import Survey

from trackmill.operators import aggregates as A
from trackmill.plans import quality_cli
from trackmill.plans.catalog import QUERIES
from trackmill.plans.logs import checkpoint_log, match_score_log, read_logs, search_log, threshold_lines, threshold_log, top_k_log, wide, wide_lines
from trackmill.registry import build
from trackmill.sources import files as S
from trackmill.sources import sinks as K
from trackmill.sources.annotations import Dataset, JsonStream, canonical, nonfinite, read_document, records, valid_id
from trackmill.sources.scratch import scratch_dir


def test_canonical_values():
    assert canonical(1) == canonical(1.0) == canonical(True) == "i:1" and canonical("1") == "s:1" and canonical(None) is None
    assert [valid_id(v) for v in (1, "a", "", True, None, 1.5, [1])] == [True, True, False, False, False, False, False]
    assert nonfinite({"a": [float("nan"), {"b": float("-inf")}], "c": 1.0}) == 2


def test_document_must_be_an_object(spark, tmp_path):
    (tmp_path / "d.json").write_text("[1]")
    with pytest.raises(Exception, match="must be one JSON object"):
        read_document(spark, str(tmp_path / "d.json")).collect()


def test_frame_folders_and_clips(spark, tmp_path):
    for video, n in (("a", 7), ("b", 3)):
        (tmp_path / video).mkdir()
        for i in range(n):
            (tmp_path / video / f"{i:03}.jpg").write_bytes(b"x")
    (tmp_path / "a" / "note.txt").write_text("no")
    files = S.frame_files(spark, str(tmp_path))
    assert files.count() == 10
    out = {(r.video, r.chunk): r["count"] for r in S.clips(files, 3, min_length=3).groupBy("video", "chunk").count().collect()}
    assert out == {("a", 0): 3, ("a", 1): 3}
    listed = spark.createDataFrame([("000.jpg",), ("001.jpg",)], "file_name string")
    assert sorted(r.file_name for r in S.uncovered(files, listed).select("file_name").distinct().collect()) == ["002.jpg", "003.jpg", "004.jpg", "005.jpg", "006.jpg"]


def test_detection_manifest_survives_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"file_name": "x.jpg", "boxes": []}))
    (tmp_path / "b.json").write_text("{broken")
    rows = {r.json_name: (r.file_name, r.corrupt) for r in S.detection_manifest(spark, str(tmp_path)).collect()}
    assert rows == {"a.json": ("x.jpg", False), "b.json": (None, True)}


def test_many_detection_files_are_written_by_many_tasks(spark, tmp_path):
    suppliers = spark.range(2500).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).alias("s_nationkey"))
    for name, rows in (("many", suppliers), ("none", suppliers.limit(0))):
        rows.coalesce(1).write.parquet(str(tmp_path / name / "supplier.parquet"))
    scratch = scratch_dir(spark).removeprefix("file:")
    before = set(os.listdir(scratch))
    got = QUERIES["SRC-13"](spark, str(tmp_path / "many")).collect()
    assert sorted(r.n for r in got) == [1] * 2400 + [100] and [r.n for r in got if r.corrupt] == [100]
    (own,) = [d for d in set(os.listdir(scratch)) - before if d.startswith("detections-")]
    sizes = [len([f for f in names if f.endswith(".json")]) for _, _, names in os.walk(os.path.join(scratch, own))]
    assert sum(sizes) == 2500 and max(sizes) <= S.FILES_PER_TASK
    assert QUERIES["SRC-13"](spark, str(tmp_path / "none")).collect() == []


def test_files_written_again_replace_their_own(spark, tmp_path):
    rows = spark.createDataFrame([("v1", "a"), ("v1", "a"), ("v2", "b"), (None, "c"), ("v1", None)], "folder string, value string")
    for _ in range(2):
        S.write_files(rows, str(tmp_path))
        texts = sorted((os.path.basename(d), open(os.path.join(d, f)).read()) for d, _, names in os.walk(tmp_path) for f in names)
        assert texts == [("000000", "c"), ("v1", ""), ("v1", "a"), ("v1", "a"), ("v2", "b")]


def test_dataset_options_are_literal_and_last():
    text = "x = 3\ntrain = dict(ann_file='a/t.json', classes='c.txt', n=x)\nval = dict(ann_file='b/v.json')\nbest = dict(ann_file='z/t.json', n=5)"
    assert S.dataset_options(text, "t.json") == {"ann_file": "z/t.json", "n": 5}
    assert S.dataset_options(text, "none.json") is None


def test_unknown_operator():
    with pytest.raises(KeyError, match="memo"):
        build({"type": "nothing"})


def block(title, first):
    rows = "\n".join(f"{name:<10} " + " ".join(f"{first + i + k:<10.3f}" for k in range(10)) for i, name in enumerate(("Combined", "Base", "Novel")))
    return f"{title}\nTETA50:    TETA LocS AssocS ClsS LocRe LocPr AssocRe AssocPr ClsRe ClsPr\n{rows}\n"


def test_logs(spark, tmp_path):
    def rows(parse, text):
        (tmp_path / "log.txt").write_text(text)
        return parse(read_logs(spark, str(tmp_path / "log.txt")))

    out = rows(top_k_log, block("max_instance_per_cate: 18000", 1) + block("max_instance_per_cate: 20000", 2))
    assert out.count() == 60 and out.filter("max_instance = '20000' AND category = 'Base' AND metric = 'LocS'").first().value == "4.000"
    out = rows(checkpoint_log, "work_dirs/a/b.py\n" + block("epoch[3]:", 1) + "work_dirs/c.py\n" + block("epoch[4]:", 5).replace(f"{15 + 1:.3f}", ""))
    assert {(r.config, r.epoch) for r in out.select("config", "epoch").distinct().collect()} == {("work_dirs/a/b.py", "3"), ("work_dirs/c.py", "4")}
    assert out.filter("value = 'N/A'").count() >= 1
    assert rows(match_score_log, block("epoch[3], match score thres[0.5]:", 1) + "\n" + block("epoch[3], match score thres[0.6]:", 1)).count() == 60
    out = rows(search_log, block("epoch[3], match score thres[0.5], max bbox [50]:", 1) + "\n\nnothing here\n")
    assert out.count() == 30 and out.filter("max_bbox = '50' AND category = 'Novel' AND metric = 'ClsPr'").first().value == 12.0
    out = rows(threshold_log, block("epoch[7], match score thres[0.4]:", 1))
    assert wide(out, ["epoch", "match_score"]).filter("category = 'Base'").first().TETA == "2.000"


def test_wide_logs_meet_as_lines(spark, tmp_path):
    text = block("epoch[7], match score thres[0.4]:", 1) + block("epoch[8], match score thres[0.4]:", 5).replace(f"{15:<10.3f}", "").replace("AssocS", "Other")
    (tmp_path / "log.txt").write_text(text)
    logs, keys = read_logs(spark, str(tmp_path / "log.txt")), ["epoch", "match_score"]
    lines = wide_lines(threshold_lines(logs), keys)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan[plan.index("Exchange") :]  # rows are shuffled before they are sorted
    assert sorted(map(str, lines.collect())) == sorted(map(str, wide(threshold_log(logs), keys).collect()))
    got = {(r.epoch, r.category): r for r in lines.collect()}
    assert got["8", "Combined"].AssocS is None and got["8", "Novel"].ClsPr == "N/A" and got["8", "Combined"].ClsPr == "14.000" and got["8", "Combined"].TETA == "5.000"


def test_sinks_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    K.write_json_records(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"id":1,"name":"a"}', '{"id":2}']
    K.append_log(df, str(tmp_path / "p"))
    K.append_log(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    flags = spark.createDataFrame([("v", "t", 0, 1, "low_iou", 0.125, 0.5), ("v", "t", 0, 9, "temporal_gap", 9.0, 1.0)], "video_id string, track_id string, frame_t long, frame_t1 long, flag_type string, measured_value double, threshold double")
    K.write_flags(flags, str(tmp_path / "f"))
    assert {(r.flag_type, r.measured_value, r.threshold) for r in spark.read.option("header", True).csv(str(tmp_path / "f")).collect()} == {("low_iou", "0.125", "0.5"), ("temporal_gap", "9", "1")}


def test_majority_vote_is_idempotent_and_breaks_ties_low(spark):
    df = spark.createDataFrame([(1, 7, 5), (2, 7, 3), (3, 8, 1), (4, 8, 1), (5, 8, 2), (6, None, 9)], "ord long, track_id long, category_id long")
    once = A.majority_category(df)
    assert sorted((r.ord, r.category_id) for r in once.collect()) == [(1, 3), (2, 3), (3, 1), (4, 1), (5, 1)]
    assert sorted(A.majority_category(once).collect()) == sorted(once.collect())
    assert A.majority_category(df.limit(0)).collect() == []


def test_unique_ids_over_empty_and_many_videos(spark):
    df = spark.range(0, 6000).selectExpr("id AS ord", "id div 2 AS video_id", "id % 2 AS track_id")
    ids = [r.track_id for r in A.unique_track_ids(df).collect()]
    assert sorted(ids) == list(range(6000))


def test_original_frames_draw_like_the_standard_generator(spark):
    import random

    frames = spark.createDataFrame([(1, f, f % 5 == 0) for f in range(50)], "video_id long, frame_id long, is_ori boolean")
    got = sorted(r.frame_id for r in A.original_frames(frames, 0.5).collect())
    chosen = list(range(0, 50, 5))
    others = list(set(range(50)) - set(chosen))
    assert got == sorted(chosen + random.Random(42).sample(others, 5))


@pytest.fixture
def cli(spark, tmp_path):
    def go(data, *more):
        (tmp_path / "current.json").write_text(json.dumps(data))
        code = quality_cli.main([str(tmp_path / "current.json"), "--report", str(tmp_path / "report.json"), *more], spark)
        return code, json.loads((tmp_path / "report.json").read_text()) if code != 2 else None

    return go


def survey(change=lambda s: None):
    s = Survey()
    change(s)
    return s.doc


def test_command_line(cli, tmp_path):
    leap = survey(lambda s: s.seen(32, 3).update(bbox=[20, 20, 24, 30]))
    flags = str(tmp_path / "flags")
    code, report = cli(leap, "--temporal-diagnostics", "--temporal-flags", flags, "--fail-on-warnings")
    assert code == 0 and report["status"] == "PASS" and report["diagnostics"]["total"] > 0
    assert cli(survey(), "--temporal-diagnostics")[0] == 2
    assert cli(survey(), "--report", str(tmp_path / "current.json"))[0] == 2
    assert cli(survey(), "--profile", "none")[0] == 2
    assert cli(survey(lambda s: s.seen(41, 0).update(image_id=4711)))[0] == 1


def test_command_line_reads_class_lists_from_a_configuration(cli, tmp_path):
    def rare(s):
        for row in (*s.doc["tracks"], *s.doc["annotations"]):
            row["category_id"] = 6 if row["category_id"] == 5 else row["category_id"]

    data = survey(rare)
    (tmp_path / "classes.txt").write_text("ferry\n")
    (tmp_path / "config.py").write_text("d = dict(ann_file='x/current.json', classes='classes.txt')")
    (tmp_path / "split.json").write_text(json.dumps({"categories": data["categories"]}))
    split = ["--split", "base-only", "--category-split", str(tmp_path / "split.json")]
    code, report = cli(data, *split, "--training-config", str(tmp_path / "config.py"))
    assert code == 0 and report["leakage"]["novel_annotations"] == 4
    assert cli(data, *split)[0] == 1


def test_command_line_tolerances_references_and_digests(cli, tmp_path):
    off = survey()
    for i, a in enumerate(off["annotations"]):
        a["area"] = a["bbox"][2] * a["bbox"][3] * (1 + (2e-4 if i == 0 else 5e-5 if i == 1 else 0))
    kinds = lambda *more: cli(off, *more)[1]["hard_errors"]["by_type"].get("area_mismatch", 0)
    assert kinds() == 1 and kinds("--area-tolerance", "1e-3") == 0 and kinds("--area-tolerance", "1e-5") == 2
    assert cli(off, "--area-tolerance", "-1")[0] == 2
    moved = survey()
    moved["annotations"][0]["bbox"][0] += 0.5
    (tmp_path / "refs").mkdir()
    (tmp_path / "refs" / "a_train_base.json").write_text(json.dumps(survey()))
    (tmp_path / "refs" / "a_train.json").write_text(json.dumps(moved))
    refs = ["--reference-dir", str(tmp_path / "refs"), "--split", "base-only"]
    code, report = cli(moved, *refs)
    assert report["anchors"]["modified"] == 1 and [os.path.basename(p) for p in report["reference_selection"]["candidates"]] == ["a_train_base.json", "a_train.json"]
    code, report = cli(moved, *refs, "--bbox-tolerance", "1", "--sha256")
    assert report["anchors"]["modified"] == 0 and report["parameters"]["bbox_tolerance"] == 1
    want = hashlib.sha256((tmp_path / "current.json").read_bytes()).hexdigest()
    assert report["inputs"]["current"] == {"path": os.path.realpath(tmp_path / "current.json"), "size_bytes": os.path.getsize(tmp_path / "current.json"), "sha256": want}
    assert "sha256" not in cli(moved)[1]["inputs"]["current"]


def test_loader_source_must_filter_by_class(tmp_path):
    (tmp_path / "loader.py").write_text("ids = self.get_ann_ids(cat_ids=self.cat_ids)")
    assert not S.filters_classes(str(tmp_path / "loader.py"))
    (tmp_path / "other.py").write_text('if ann["category_id"] not in self.cat_ids: pass')
    assert S.filters_classes(str(tmp_path / "loader.py")) and S.filters_classes(str(tmp_path))


def test_logs_of_any_length(spark, tmp_path):
    """More lines and columns than any block of the published logs has."""
    names = [f"m{k}" for k in range(150)]
    lines = [f"class{i} " + " ".join(str(i + k) for k in range(150)) for i in range(10_500)]
    (tmp_path / "long.txt").write_text("epoch[3], match score thres[0.5]:\nTETA50: " + " ".join(names) + "\n" + "\n".join(lines) + "\n")
    out = threshold_log(read_logs(spark, str(tmp_path / "long.txt")))
    assert out.count() == 150 * 10_500
    assert out.filter("category = 'class10499' AND metric = 'm149'").first().value == str(10_499 + 149)
    few = [f"class{i} " + " ".join(str(k) for k in range(10)) for i in range(10_500)]
    (tmp_path / "many.txt").write_text("\n\n  \nepoch[3], match score thres[0.5]:\nhead\n" + "\n".join(few) + "\n \t\nepoch[4], match score thres[0.6]:\nhead\n" + few[0])
    assert match_score_log(read_logs(spark, str(tmp_path / "many.txt"))).count() == 10 * 10_501


def test_documents_are_streamed(tmp_path):
    """Records come out of a stream whatever its buffers cut apart."""
    doc = survey()
    doc["info"] = {"note": 'brackets ]}, quotes \\" and é 漢 😀', "n": [1.5, -2e3, float("nan")], "deep": {"annotations": [1]}}
    text = json.dumps(doc, ensure_ascii=False).encode()
    want = list(records(io.BytesIO(text)))
    assert sum(r["section"] == "annotations" for r in want) == 12 and [r["n"] for r in want if r.get("name") == "nonfinite_numeric"] == [1]
    chunk = JsonStream.CHUNK
    try:
        for JsonStream.CHUNK in (1, 7, 100):
            assert str(list(records(io.BytesIO(text)))) == str(want)
    finally:
        JsonStream.CHUNK = chunk
    for broken in (b"[]", b"", b'{"videos": [1 2]}', b'{"videos": []} x', b'{"videos": [', b'{1: 2}'):
        with pytest.raises(ValueError):
            list(records(io.BytesIO(broken)))


def test_written_documents_read_back(spark, tmp_path):
    videos = spark.createDataFrame([(2, "b"), (1, "a")], "id long, name string")
    K.write_document({"videos": videos.orderBy("id"), "images": videos.limit(0)}, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"videos": [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}], "images": []}
    rows = Dataset.read(spark, str(tmp_path / "d.json")).rows.filter("section = 'videos'").orderBy("ord").collect()
    assert [(r.ord, r.id, r.name) for r in rows] == [(0, "i:1", "s:a"), (1, "i:2", "s:b")]


def test_exports_by_task(spark):
    p = spark.createDataFrame([(1, 1, 0, 5, 7, 0.5, *[0.0] * 4)], "image_id long, video_id long, frame_id long, ord long, track_id long, score double, x1 double, y1 double, x2 double, y2 double").withColumn("category_id", F.lit(0).cast("long"))
    names = spark.createDataFrame([(0, "boat")], "category_id long, category string")
    out = K.export_all(p, names, ["det", "ins_seg", "box_track", "seg_track"])
    assert {k: df.count() for k, df in out.items()} == {"det": 1, "ins_seg": 1, "box_track": 1, "seg_track": 1}
    with pytest.raises(ValueError, match="no export drawing"):
        K.export_all(p, names, ["drawing"])
