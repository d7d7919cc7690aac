"""Folders of detection files as a data source, for tables and for streams.

    register(spark)
    spark.read.format("detections").load("/data/detections").filter("video = 'v1'")
    spark.readStream.format("detections").load("/data/detections")

A folder holds a folder of JSON files per video; a file is one object with ``file_name`` and ``boxes`` (rows of
corners, score and label). Rows: video, json_name, file_name, boxes, corrupt. What can't be parsed is kept and
marked. Conditions on the video pick folders before anything is read; ``register`` switches that on for the
session (``spark.sql.python.filterPushdown.enabled``), as Spark refuses such readers else. A task reads ``files_per_task`` files.

As a stream, files come in the order of their times of change, then of their names; an offset names the last
file taken, so a restart reads each file once. A file must be moved to its folder when it is whole, as a file
that turns up later with an earlier time is not seen.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from trackmill.sources.scratch import opened

SCHEMA = "video string, json_name string, file_name string, boxes array<array<double>>, corrupt boolean"
ROWS = pa.schema([("video", pa.string()), ("json_name", pa.string()), ("file_name", pa.string()), ("boxes", pa.list_(pa.list_(pa.float64()))), ("corrupt", pa.bool_())])
START = [0, ""]


@dataclass
class Files(InputPartition):
    names: list[str]


def _listed(path: str, videos: set[str] | None = None) -> list[tuple[int, str]]:
    """(time of change, path) of the files of all videos, or of some, in order."""
    store, name = opened(path)
    folders = [i for i in store.get_file_info(fs.FileSelector(name)) if i.type == fs.FileType.Directory]
    wanted = [f for f in folders if videos is None or f.base_name in videos]
    files = [i for f in wanted for i in store.get_file_info(fs.FileSelector(f.path)) if i.is_file and i.base_name.endswith(".json")]
    return sorted((i.mtime_ns or 0, i.path) for i in files)


def _row(text: bytes) -> tuple[str | None, list | None, bool]:
    try:
        found = json.loads(text)
        boxes = found.get("boxes")
        return found.get("file_name"), None if boxes is None else [[float(v) for v in b] for b in boxes], False
    except (ValueError, AttributeError, TypeError):
        return None, None, True


def _read(path: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    store, _ = opened(path)
    held: list[dict] = []
    for name in names:
        with store.open_input_stream(name) as stream:
            file_name, boxes, corrupt = _row(stream.read())
        *_, video, json_name = name.split("/")
        held.append({"video": video, "json_name": json_name, "file_name": file_name, "boxes": boxes, "corrupt": corrupt})
        if len(held) == 500:
            yield pa.RecordBatch.from_pylist(held, schema=ROWS)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=ROWS)


def _dealt(files: list[tuple[int, str]], size: int) -> list[Files]:
    return [Files([name for _, name in files[i : i + size]]) for i in range(0, len(files), size)]


class Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.videos: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes conditions on the video; the others are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("video",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("video",):
                self._only(set(f.value))
            else:
                yield f

    def _only(self, videos: set[str]) -> None:
        self.videos = videos if self.videos is None else self.videos & videos

    def partitions(self) -> list[Files]:
        return _dealt(_listed(self.path, self.videos), self.size) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition.names)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"last": START}

    def latestOffset(self) -> dict:
        files = _listed(self.path)
        return {"last": list(files[-1]) if files else START}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = tuple(start["last"]), tuple(end["last"])
        return _dealt([f for f in _listed(self.path) if low < f <= high], self.size)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition.names)

    def commit(self, end: dict) -> None:
        """Nothing is held for what was read."""


class Detections(DataSource):
    @classmethod
    def name(cls) -> str:
        return "detections"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        path, size = self.options.get("path"), int(self.options.get("files_per_task", 1000))
        if not path or size < 1:
            raise ValueError("detections need a path, and at least one file per task")
        return path, size

    def reader(self, schema: StructType) -> Reader:
        return Reader(*self._options())

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(*self._options())


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Detections)
