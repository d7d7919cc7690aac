"""Views of plain tables as the video data model: boxes, consecutive steps, vectors in frames.

Coordinates are whole numbers, so that arithmetic on them is the same in every engine. A frame holds
50 boxes, a video 50 frames, so a frame's size does not grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The same text runs in Spark and DuckDB.
BOXES = """
SELECT event_id AS ord, CAST((event_id - event_id % 2500) / 2500 AS BIGINT) AS video_id,
  CAST((event_id % 2500 - event_id % 50) / 50 AS BIGINT) AS frame_id,
  CAST((event_id - event_id % 2500) / 50 AS BIGINT) + event_id % 50 AS track_id,
  CASE WHEN event_id % 4 = 0 THEN event_id % 5 ELSE event_id % 50 % 5 END AS category_id,
  event_type AS category, user_id, value,
  CAST(event_id % 50 * 61 % 600 + CAST((event_id % 2500 - event_id % 50) / 50 AS BIGINT) * 2 + event_id * 7 % 3 AS DOUBLE) AS x1,
  CAST(event_id % 50 * 83 % 440 + CAST((event_id % 2500 - event_id % 50) / 50 AS BIGINT) + event_id * 11 % 5 AS DOUBLE) AS y1,
  CAST(20 + event_id % 50 * 7 % 61 + event_id % 3 AS DOUBLE) AS w, CAST(20 + event_id % 50 * 11 % 47 + event_id % 4 AS DOUBLE) AS h,
  CAST(event_id * 29 % 1000 AS DOUBLE) / 1000 AS score
FROM events
"""
BOXES = f"SELECT *, x1 + w AS x2, y1 + h AS y2 FROM ({BOXES})"

#: Each box of a track (b) with the one before it (a).
STEPS = """
SELECT b.ord, b.video_id, b.track_id, b.frame_id, b.category_id, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, a.score AS a_score,
  b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2, b.score AS b_score
FROM boxes a JOIN boxes b ON a.track_id = b.track_id AND a.frame_id + 1 = b.frame_id
"""

#: Twenty vectors a frame; even ones stand for memory, odd ones for detections.
VECTORS = """
SELECT vec_id, CAST((vec_id - vec_id % 20) / 20 AS BIGINT) AS frame_id, vec_id % 20 AS idx, label, embedding FROM embeddings
"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BOXES.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STEPS.replace("boxes a", "{boxes} a").replace("boxes b", "{boxes} b"), boxes=boxes(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VECTORS.replace("FROM embeddings", "FROM {embeddings}"), embeddings=spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every memory vector (i) with every detection vector (j) of its frame."""
    v = vectors(spark, sf_dir)
    left = v.filter("idx % 2 = 0").selectExpr("frame_id", "idx AS i", "vec_id AS vec_i", "label AS label_i", "embedding AS a")
    right = v.filter("idx % 2 = 1").selectExpr("frame_id", "idx AS j", "vec_id AS vec_j", "label AS label_j", "embedding AS b")
    return left.join(right, "frame_id")


_VIEWS = f"WITH boxes AS ({BOXES}), steps AS ({STEPS}), vectors AS ({VECTORS})"
_PAIRS = """, pairs AS (
SELECT l.frame_id, l.idx AS i, r.idx AS j, l.vec_id AS vec_i, r.vec_id AS vec_j, l.label AS label_i, r.label AS label_j,
  list_transform(l.embedding, lambda x: CAST(x AS DOUBLE)) AS a, list_transform(r.embedding, lambda x: CAST(x AS DOUBLE)) AS b
FROM vectors l JOIN vectors r ON l.frame_id = r.frame_id AND l.idx % 2 = 0 AND r.idx % 2 = 1)"""


def oracle(sql: str, **views: str) -> str:
    """DuckDB SQL over the views boxes, steps, vectors and pairs, and over further ones given by name."""
    more = "".join(f", {name} AS ({text})" for name, text in views.items())
    return f"{_VIEWS}{_PAIRS}{more}\n{sql}"
