"""Suppression of overlapping boxes within frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.operators.groups import Columns, corners, over_groups
from trackmill.operators.joins import overlaps
from trackmill.operators.kernels import greedy_nms as nms


def remove_distractors(df: DataFrame, frame: list[str], score_limit: float = 0.5, overlap: float = 0.3, same_category: bool = False) -> DataFrame:
    """Boxes but those of a low score that overlap any box before them, dropped or not."""
    low = df.filter(F.col("score") < score_limit).select(F.col("ord").alias("j"))
    pairs = overlaps(df, frame, overlap, same_category).join(low, "j", "left_semi")
    return df.join(pairs.select(F.col("j").alias("ord")).distinct(), "ord", "left_anti")


def greedy_nms(df: DataFrame, frame: list[str], overlap: float, by_class: bool = False) -> DataFrame:
    """(frame, ord) of the boxes left by greedy suppression, best score first, ties in input order."""
    columns = [*frame, "ord", "category_id", "score", "x1", "y1", "x2", "y2"]

    def solve(c: Columns) -> tuple:
        kept = np.sort(nms(corners(c), c["score"].astype(float), overlap, c["category_id"] if by_class else None))
        return (*(c[k][kept] for k in frame), c["ord"][kept])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in (*frame, "ord"))
    return over_groups(df.select(*columns), frame, ["ord"], solve, schema)
