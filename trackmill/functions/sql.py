"""The library's functions in SQL: measures of boxes, an aggregate of boxes, and trackers as a table function.

    register(spark)
    SELECT box_iou(a.x1, a.y1, a.x2, a.y2, b.x1, b.y1, b.x2, b.y2) FROM a JOIN b USING (frame_id)
    SELECT video_id, consensus_box(array(x1, y1, x2, y2)) FROM boxes GROUP BY video_id
    SELECT * FROM track_objects(TABLE(detections), 'memo', '{"match_score": 0.37}')

The measures are expressions, which the optimizer sees through. The table function asks for its rows by video
and in order of frames itself; a task holds one tracker and a frame at a time, as in ``track``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, Row, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from trackmill.operators.tracking import COLUMNS, RESULT, Run

KINDS = {"long": LongType(), "double": DoubleType()}
_TWO = ", ".join(f"{p}{c} DOUBLE" for p in "ab" for c in ("x1", "y1", "x2", "y2"))
_SHARED = "greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1))"
_BOTH = f"((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - {_SHARED})"
_HULL = "((greatest(ax2, bx2) - least(ax1, bx1)) * (greatest(ay2, by2) - least(ay1, by1)))"
MEASURES = {
    "box_area": ("x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "(x2 - x1) * (y2 - y1)"),
    "box_iou": (_TWO, f"coalesce(try_divide({_SHARED}, {_BOTH}), 0)"),
    "box_giou": (_TWO, f"coalesce(try_divide({_SHARED}, {_BOTH}), 0) - coalesce(try_divide({_HULL} - {_BOTH}, {_HULL}), 0)"),
    "box_distance": (_TWO, "sqrt(pow((ax1 + ax2 - bx1 - bx2) / 2, 2) + pow((ay1 + ay2 - by1 - by2) / 2, 2))"),
}


def consensus(boxes: pa.Array) -> list:
    """The box of the median corners; null ones don't count."""
    held = [b for b in boxes.to_pylist() if b is not None and None not in b]
    return np.median(np.array(held, float), axis=0).tolist() if held else None


class TrackObjects:
    """``track`` as a table function: the columns of its result for the rows of a table and a tracker's name, with
    further options as JSON."""

    def __init__(self):
        self.run: Run | None = None
        self.rows: list[tuple] = []

    @staticmethod
    def analyze(table: AnalyzeArgument, kind: AnalyzeArgument, options: AnalyzeArgument | None = None) -> AnalyzeResult:
        missing = [c for c in COLUMNS if c not in table.dataType.names] if table.isTable else COLUMNS
        if missing:
            raise ValueError(f"track_objects needs a table with {', '.join(missing)}")
        return AnalyzeResult(
            schema=StructType([StructField(c.split()[0], KINDS[c.split()[1]]) for c in RESULT.split(", ")]),
            partitionBy=[PartitioningColumn("video_id")],
            orderBy=[OrderingColumn("frame_id"), OrderingColumn("ord")],
        )

    def eval(self, row: Row, kind: str, options: str | None = None) -> Iterator[tuple]:
        if self.run is None:
            self.run = Run({"type": kind} | json.loads(options or "{}"))
        if self.rows and self.rows[0][1] != row["frame_id"]:
            yield from self._frame()
        self.rows.append(tuple(row[c] for c in COLUMNS))

    def _frame(self) -> Iterator[tuple]:
        rows, self.rows = pd.DataFrame(dict(zip(COLUMNS, map(list, zip(*self.rows, strict=True)), strict=True))), []
        yield from self._out(self.run.frame(int(rows["frame_id"].iloc[0]), rows, True))

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            yield from self._frame()
        if self.run is not None:
            yield from self._out(self.run.close())

    @staticmethod
    def _out(parts: list[pd.DataFrame]) -> Iterator[tuple]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        for part in parts:
            yield from zip(*[part[n].tolist() for n in names], strict=True)


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    for name, (arguments, body) in MEASURES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}")
    spark.udf.register("consensus_box", F.arrow_udf(consensus, ArrayType(DoubleType())))
    spark.udtf.register("track_objects", F.udtf(TrackObjects))
