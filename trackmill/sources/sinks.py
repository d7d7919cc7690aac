"""Result formats: JSON records of detections and tracks, per-image labels, exports and logs."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.boxes import Box
from trackmill.operators.aggregates import majority_category, unique_track_ids
from trackmill.sources.scratch import opened, scratch_dir

#: Between the records of a document, and bytes copied at a time when its parts are joined.
SEPARATOR, COPIED = ",\n", 8 << 20


def bbox_record(extra: list[str] = ()) -> list[Column]:
    """image_id, bbox as x, y, w, h, score and category_id, and further columns."""
    return [F.col("image_id"), F.array(*Box.corners().to_xywh()).alias("bbox"), F.col("score"), F.col("category_id"), *[F.col(c) for c in extra]]


def detection_records(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """Detections by label, as records of their category; labels: (label, category_id)."""
    return detections.drop("category_id").join(labels, "label").select(*bbox_record())


def track_records(tracks: DataFrame, majority: bool = True) -> DataFrame:
    """Matched rows with ids unique over videos and, by default, each track's majority category."""
    unique = unique_track_ids(tracks.filter("track_id > -1"))
    return (majority_category(unique) if majority else unique).select(*bbox_record(["video_id", "track_id"]))


def image_labels(images: DataFrame, predictions: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per image with its labels, an empty list where nothing was predicted.

    images: image_id, name, video_name, frame_index; categories: category_id, category.
    """
    b = Box.corners()
    label = F.struct(F.col("ord"), F.col("track_id").cast("string").alias("id"), "score", "category", F.struct(b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2")).alias("box2d"))
    grouped = predictions.drop("category").join(categories, "category_id").groupBy("image_id").agg(F.array_sort(F.collect_list(label)).alias("l"))
    fields = lambda s: F.struct(s["id"].alias("id"), s["score"].alias("score"), s["category"].alias("category"), s["box2d"].alias("box2d"))
    joined = images.join(grouped, "image_id", "left")
    labels = F.coalesce(F.transform("l", fields), F.array())
    return joined.select("image_id", F.col("name"), F.col("video_name").alias("videoName"), F.col("frame_index").alias("frameIndex"), labels.alias("labels"))


#: Order of labels in the exports that number them: by image, class, then as they came.
_RUNNING = ("image_id", "category_id", "ord")


def _numbered(predictions: DataFrame) -> DataFrame:
    """Predictions with ``id``, their number through all images, classes and rows, from 1."""
    from trackmill.operators.aggregates import global_rank

    ranked = global_rank(predictions.withColumn("_place", F.struct(*_RUNNING)), "_place", "_rank")
    return ranked.withColumn("id", (F.col("_rank") + 1).cast("string")).drop("_place", "_rank", "n_rows")


def _boxes(rows: DataFrame, categories: DataFrame, *keys: str) -> DataFrame:
    return rows.drop("category").join(categories, "category_id").select(*keys, "id", "category", "score", *[F.col(c) for c in ("x1", "y1", "x2", "y2")])


def export_detections(predictions: DataFrame, categories: DataFrame) -> DataFrame:
    """det: per image and class, labels numbered through all images in order, from 1."""
    return _boxes(_numbered(predictions), categories, "image_id")


def export_instances(predictions: DataFrame) -> DataFrame:
    """ins_seg: labels numbered through all images, and their place in their image, from 1, under which
    the image's mask holds them."""
    index = F.row_number().over(Window.partitionBy("image_id").orderBy("category_id", "ord"))
    return _numbered(predictions.withColumn("index", index.cast("long"))).select("image_id", "id", "index", "score")


def export_tracks(predictions: DataFrame, categories: DataFrame) -> DataFrame:
    """box_track: labels of tracks under their track's id, with the frame's place in its video."""
    tracks = predictions.filter("track_id > -1").withColumn("id", F.col("track_id").cast("string")).withColumn("frame_index", F.col("frame_id"))
    return _boxes(tracks, categories, "image_id", "video_id", "frame_index")


def export_masks(predictions: DataFrame) -> DataFrame:
    """seg_track: the paint order and channels of each track's mask; the painting is not done here."""
    return mask_order(predictions.filter("track_id > -1"))


def export_all(predictions: DataFrame, categories: DataFrame, tasks: list[str]) -> dict[str, DataFrame]:
    """The export of each task: det, ins_seg, box_track or seg_track."""
    known = {
        "det": lambda: export_detections(predictions, categories),
        "ins_seg": lambda: export_instances(predictions),
        "box_track": lambda: export_tracks(predictions, categories),
        "seg_track": lambda: export_masks(predictions),
    }
    unknown = sorted(set(tasks) - set(known))
    if unknown:
        raise ValueError(f"no export {', '.join(unknown)}; known: {', '.join(known)}")
    return {t: known[t]() for t in tasks}


def mask_order(predictions: DataFrame) -> DataFrame:
    """Paint order by ascending score, and the four channels that name an instance in a mask image."""
    w = Window.partitionBy("image_id").orderBy("score", "ord")
    id_ = F.col("track_id")
    return predictions.select("image_id", "ord", (F.row_number().over(w) - 1).alias("paint"), (F.col("category_id") + 1).alias("r"), F.lit(0).alias("g"), F.shiftright(id_, 8).bitwiseAND(F.lit(255)).alias("b"), id_.bitwiseAND(F.lit(255)).alias("a"))


def format_results(predictions: DataFrame, kind: str, majority: bool = True) -> DataFrame:
    """Records of a kind: bbox or track."""
    if kind not in ("bbox", "track"):
        raise ValueError(f"no result format {kind!r}")
    return track_records(predictions, majority) if kind == "track" else predictions.select(*bbox_record())


def write_json_records(df: DataFrame, path: str) -> None:
    """One JSON object per line; a folder, so that every task writes its own part."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_document(sections: dict[str, DataFrame], path: str) -> None:
    """One annotation document: an object with an array per section, its rows in their table's order.

    Tasks write the rows as text parts; the driver copies whole parts one after the other, a block at a time."""
    store, name = opened(path)
    with store.open_output_stream(name, compression=None) as out:
        for i, (section, rows) in enumerate(sections.items()):
            out.write(f"{',' if i else '{'}{json.dumps(section)}:[\n".encode())
            parts = f"{scratch_dir(rows.sparkSession)}/parts-{uuid.uuid4().hex}"
            rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.option("lineSep", SEPARATOR).text(parts)
            _joined(parts, out)
            out.write(b"]")
        out.write(b"}\n" if sections else b"{}\n")


def _joined(folder: str, out) -> None:
    """Copy a folder's parts in order, without the separator after the last row."""
    store, name = opened(folder)
    files = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(name)) if f.base_name.startswith("part-") and f.size)
    for k, (file, size) in enumerate(files):
        left = size - (len(SEPARATOR) if k == len(files) - 1 else 0)
        with store.open_input_stream(file) as part:
            while left:
                block = part.read(min(left, COPIED))
                out.write(block)
                left -= len(block)
    store.delete_dir(name)


def write_flags(flags: DataFrame, path: str) -> None:
    """Temporal flags as CSV, numbers with up to ten significant digits."""
    short = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.10g", c), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    flags.withColumns({c: short(c) for c in ("measured_value", "threshold")}).write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append to a table; the commit protocol keeps writers apart, no lock is needed."""
    df.write.mode("append").parquet(path)
