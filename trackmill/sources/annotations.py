"""Annotation documents as typed tables.

A document is one JSON object with five arrays. It is cut into ranges of bytes, which tasks parse (see
``split_json``), into rows of ``RECORD``; all checks and queries run on those rows, or on tables of the same columns that never were
one document. Ids and other values keep their JSON type in a canonical text: ``i:12`` is not ``s:12``,
and 1, 1.0 and true are one value, as they are to a dictionary of the documents' usual readers.
"""

from __future__ import annotations

import codecs
import json
import math
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.sources.scratch import kept
from trackmill.sources.split_json import RANGE, elements, parsed, split

SECTIONS = ("videos", "images", "annotations", "tracks", "categories")
RECORD = """section string, ord long, n long, id string, id_ok boolean, name string, synset string, frequency string, video string, file_name string,
width double, height double, length double, video_id string, image_id string, track_id string, category_id string,
frame_index long, frame_ok boolean, frame_id long, has_frame_id boolean, frame_id_ok boolean, frame_key string, is_ori boolean,
bbox array<double>, bbox_ok boolean, area double, has_area boolean, ignore boolean, iscrowd boolean, visibility double"""
_FIELDS = [part.split()[:2] for part in RECORD.replace("\n", " ").split(", ")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in _FIELDS])
ISSUE = "$issue"


def canonical(value) -> str | None:
    """A text that is equal for equal values."""
    if value is None:
        return None
    if isinstance(value, (bool, int)):
        return f"i:{int(value)}"
    if isinstance(value, float):
        return f"i:{int(value)}" if math.isfinite(value) and value == int(value) else f"f:{value!r}"
    return f"s:{value}" if isinstance(value, str) else "j:" + json.dumps(value, sort_keys=True)


def valid_id(value) -> bool:
    return isinstance(value, (int, str)) and not isinstance(value, bool) and value != ""


def _is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _finite(value) -> float | None:
    return float(value) if _is_number(value) and math.isfinite(value) else None


def _whole(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def nonfinite(value) -> int:
    """How many numbers anywhere in a parsed document are NaN or infinite."""
    todo, n = [value], 0
    while todo:
        x = todo.pop()
        if isinstance(x, float):
            n += not math.isfinite(x)
        elif isinstance(x, dict):
            todo.extend(x.values())
        elif isinstance(x, list):
            todo.extend(x)
    return n


def record(section: str, ord_: int, r: dict) -> dict:
    """One typed row of a section's object."""
    frame, frame_id, bbox = r.get("frame_index"), r.get("frame_id"), r.get("bbox")
    box = [_finite(v) for v in bbox] if isinstance(bbox, list) and len(bbox) == 4 else [None]
    whole, whole_id = _whole(frame), _whole(frame_id)
    seen = r.get("visibility", r.get("visibility_ratio"))
    return {
        "section": section, "ord": ord_, "id": canonical(r.get("id")), "id_ok": valid_id(r.get("id")),
        **{c: canonical(r.get(c)) for c in ("name", "synset", "video", "video_id", "image_id", "track_id", "category_id")},
        "frequency": r.get("frequency") if isinstance(r.get("frequency"), str) else None,
        "file_name": r.get("file_name") if isinstance(r.get("file_name"), str) else None,
        "width": _finite(r.get("width")), "height": _finite(r.get("height")), "length": _finite(r.get("length", r.get("num_frames"))),
        "frame_index": whole, "frame_ok": whole is not None and whole >= 0, "frame_id": whole_id, "has_frame_id": "frame_id" in r,
        "frame_id_ok": whole_id is not None and whole_id >= 0, "frame_key": canonical(frame if frame is not None else frame_id), "is_ori": r.get("is_ori") is True,
        "bbox": box if None not in box else None, "bbox_ok": None not in box, "area": _finite(r.get("area")), "has_area": "area" in r,
        "ignore": bool(r.get("ignore", False)), "iscrowd": bool(r.get("iscrowd", False)), "visibility": _finite(seen),
    }


class JsonStream:
    """Values of a JSON text one after the other, from a buffer that is filled as far as needed."""

    CHUNK = 1 << 20
    _SPACE = re.compile(r"[ \t\n\r]*")

    def __init__(self, stream: BinaryIO):
        self.stream, self.decoder = stream, codecs.getincrementaldecoder("utf-8")()
        self.text, self.at, self.ended = "", 0, False
        self.scan = json.JSONDecoder().raw_decode

    def _fill(self) -> None:
        data = self.stream.read(max(self.CHUNK, len(self.text) - self.at))
        self.ended = not data
        self.text, self.at = self.text[self.at :] + self.decoder.decode(data, self.ended), 0

    def peek(self) -> str:
        """The next sign that is not white space, empty at the end."""
        while True:
            self.at = self._SPACE.match(self.text, self.at).end()
            if self.at < len(self.text) or self.ended:
                return self.text[self.at : self.at + 1]
            self._fill()

    def take(self, signs: str) -> str:
        found = self.peek()
        if not found or found not in signs:
            raise ValueError(f"expected one of {signs!r} and found {found!r}")
        self.at += 1
        return found

    def value(self):
        self.peek()
        while True:
            try:
                value, end = self.scan(self.text, self.at)
            except ValueError:
                if self.ended:
                    raise
            else:
                if end < len(self.text) or self.ended:  # what ends with the buffer may go on
                    self.at = end
                    return value
            self._fill()

    def items(self) -> Iterator:
        """The elements of the array that comes next."""
        self.take("[")
        if self.peek() == "]":
            self.take("]")
            return
        while True:
            yield self.value()
            if self.take(",]") == "]":
                return

    def members(self) -> Iterator[str]:
        """The names of the object that comes next; each one's value is to be read before the next."""
        self.take("{")
        if self.peek() == "}":
            self.take("}")
            return
        while True:
            name = self.value()
            if not isinstance(name, str):
                raise ValueError(f"a member's name must be text, not {name!r}")
            self.take(":")
            yield name
            if self.take(",}") == "}":
                return


def records(stream: BinaryIO) -> Iterator[dict]:
    """The rows of one document; what is wrong with its shape comes as rows of section $issue."""
    issue = lambda kind, n=1, section=None: {"section": ISSUE, "name": kind, "n": n, "file_name": section}
    data, bad, seen = JsonStream(stream), 0, set()
    if data.peek() != "{":
        raise ValueError("an annotation document must be one JSON object")
    for name in data.members():
        seen.add(name)
        if name not in SECTIONS or data.peek() != "[":
            bad += nonfinite(data.value())
            if name in SECTIONS:
                yield issue("top_level_not_array", section=name)
            continue
        for ord_, r in enumerate(data.items()):
            bad += nonfinite(r)
            yield record(name, ord_, r) if isinstance(r, dict) else issue("record_not_object", section=name)
    if data.peek():
        raise ValueError("there is something after the document's end")
    for section in SECTIONS:
        if section not in seen:
            yield issue("missing_top_level_field", section=section)
    if bad:
        yield issue("nonfinite_numeric", bad)


def _range_rows(file, other, start: int, stop: int, state: int, depth: int, members: list[dict]) -> Iterator[dict]:
    """The rows of a range: records that begin in it, and what is wrong with members that do."""
    bad = 0
    for m in members:
        if start <= m["place"] < stop and m["opens"] != ord("["):
            other.seek(m["place"] + 1)
            value = JsonStream(other)
            bad += nonfinite(value.value())
            if value.peek() not in (",", "}"):
                raise ValueError(f"there is something after the value of {m['name']!r}")
            if m["name"] in SECTIONS:
                yield {"section": ISSUE, "name": "top_level_not_array", "n": 1, "file_name": m["name"]}
    for m, values in elements(file, start, stop, state, depth, members):
        for r in values:
            bad += nonfinite(r)
            if m["name"] in SECTIONS:
                yield record(m["name"], m["first"], r) if isinstance(r, dict) else {"section": ISSUE, "name": "record_not_object", "n": 1, "file_name": m["name"]}
            m["first"] += 1
    if bad:
        yield {"section": ISSUE, "name": "nonfinite_numeric", "n": bad}


def read_document(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """The rows of the annotation documents at a path, parsed by a task per range of ``size`` bytes. They
    are those of ``records``, but numbers that are not finite are counted per range."""
    ranges, members = split(spark, path, size)
    rows = ranges.mapInArrow(parsed(_range_rows, SCHEMA), RECORD)
    present = ranges.select("path").distinct().withColumn("section", F.explode(F.array(*map(F.lit, SECTIONS))))
    missing = present.join(members.select("path", F.col("name").alias("section")), ["path", "section"], "left_anti")
    found = {"section": F.lit(ISSUE), "name": F.lit("missing_top_level_field"), "n": F.lit(1).cast("long"), "file_name": F.col("section")}
    return rows.unionByName(missing.select(*[found.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _FIELDS]))


class Dataset:
    """The five tables of a dataset, with the issues of its reading."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @staticmethod
    def read(spark: SparkSession, path: str, table: str | None = None) -> Dataset:
        """Read documents once: their rows are kept as Parquet by section, in ``table`` or a scratch folder."""
        return Dataset(kept(read_document(spark, path), "annotations", table, "section"))

    @staticmethod
    def of(spark: SparkSession, **tables: DataFrame) -> Dataset:
        """From tables that have some of the columns of RECORD; the others are null or false."""
        parts = []
        for section, df in tables.items():
            have = set(df.columns)
            columns = [F.lit(section).alias("section")]
            for name, kind in _FIELDS[1:]:
                default = F.lit(False) if kind == "boolean" else F.lit(None)
                columns.append((F.col(name) if name in have else default).cast(kind).alias(name))
            parts.append(df.select(columns))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return Dataset(out)

    def section(self, name: str) -> DataFrame:
        return self.rows.filter(F.col("section") == name)

    def index(self, name: str, last: bool = False) -> DataFrame:
        """One row per valid id: the first one, or the last."""
        order = F.col("ord").desc() if last else F.col("ord")
        w = Window.partitionBy("id").orderBy(order)
        return self.section(name).filter("id_ok").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

    def issues(self) -> DataFrame:
        return self.section(ISSUE).select(F.col("name").alias("kind"), F.col("n"), F.col("file_name").alias("section"))

    def load_videos(self, ids: list[str] | None = None) -> DataFrame:
        v = self.index("videos", last=True)
        return v.filter(F.col("id").isin(ids)) if ids else v

    def frames_of(self, video_ids: list[str] | None = None) -> DataFrame:
        """Images of videos in frame order; no ids mean all."""
        images = self.index("images", last=True)
        images = images.filter(F.col("video_id").isin(video_ids)) if video_ids else images
        return images.orderBy("video_id", "frame_id", "ord")

    def annotation_ids(self, images: list[str] = (), categories: list[str] = (), area: tuple[float, float] | None = None, iscrowd: bool | None = None) -> DataFrame:
        """Annotations that pass all filters given; an empty one passes everything."""
        a = self.section("annotations")
        if images:
            a = a.filter(F.col("image_id").isin(list(images)))
        if categories:
            a = a.filter(F.col("category_id").isin(list(categories)))
        if area:
            a = a.filter((F.col("area") > area[0]) & (F.col("area") < area[1]))
        return a if iscrowd is None else a.filter(F.col("iscrowd") == iscrowd)

    def ordered_classes(self, names: list[str]) -> DataFrame:
        """(label, name, id) of the classes in the order asked for, the first id of each name."""
        wanted = self.rows.sparkSession.createDataFrame([(i, f"s:{n}") for i, n in enumerate(names)], "label long, name string")
        first = self.section("categories").groupBy("name").agg(F.min_by("id", "ord").alias("id"))
        found = wanted.join(first, "name", "left").select("label", "name", "id")
        missing = [r.name[2:] for r in found.filter("id IS NULL").collect()]  # at most the names asked for
        if missing:
            raise ValueError(f"no category named {', '.join(missing)}")
        return found


def still_image_name(file_name):
    """The last 16 characters of names with the long COCO prefix, others as they are."""
    c = F.col(file_name) if isinstance(file_name, str) else file_name
    return F.when(c.startswith("COCO"), F.right(c, F.lit(16))).otherwise(c)


def category_split(data: dict) -> tuple[list[tuple[str, bool]], dict[str, int]]:
    """((category, is novel), ...) of a parsed split in any of its three layouts, and what is wrong
    with it: kind -> count."""
    issues: dict[str, int] = {}
    pairs: list[tuple[str, bool]] = []
    listed = data.get("categories")
    if listed is None:
        names = next((n for n in (("base_category_ids", "novel_category_ids"), ("base", "novel")) if set(n) <= set(data)), None)
        if names is None:
            return [], {"category_split_unrecognized": 1}
        pairs = [(canonical(v), novel) for name, novel in zip(names, (False, True), strict=True) for v in data[name]]
    elif not isinstance(listed, list):
        return [], {"category_split_unrecognized": 1}
    else:
        for c in listed:
            if not isinstance(c, dict) or not valid_id(c.get("id")):
                kind = "category_split_invalid_category"
            elif c.get("frequency") in ("r", "c", "f"):
                pairs.append((canonical(c["id"]), c["frequency"] == "r"))
                continue
            else:
                kind = "category_split_missing_frequency"
            issues[kind] = issues.get(kind, 0) + 1
    pairs = sorted(set(pairs))
    both = {c for c, novel in pairs if novel} & {c for c, novel in pairs if not novel}
    if both:
        issues["category_split_overlap"] = len(both)
    return pairs, issues


def known_filtered(data) -> tuple[list[tuple[str, str, str, str, str]], dict[str, int]]:
    """(video, frame, track, category, reason) of a manifest, an object or a list, and its issues."""
    entries = data.get("filtered_anchors", data.get("anchors", [])) if isinstance(data, dict) else data
    if not isinstance(entries, list):
        return [], {"known_filter_manifest_invalid": 1}
    rows, issues = [], {}
    for e in entries:
        if not isinstance(e, dict):
            kind = "known_filter_manifest_entry_invalid"
        else:
            key = [canonical(e.get("video_id")), canonical(e.get("frame_index", e.get("frame_id"))), canonical(e.get("track_id")), canonical(e.get("category_id"))]
            if None not in key:
                rows.append((*key, str(e.get("reason", "declared filter"))))
                continue
            kind = "known_filter_manifest_key_invalid"
        issues[kind] = issues.get(kind, 0) + 1
    return rows, issues
