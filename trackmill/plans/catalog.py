"""All queries of the library: importing the plan modules registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackmill.plans import dataset_queries, event_time_queries, geometry_queries, loss_queries, precision_queries, relational_queries, scale_queries, tracking_queries  # noqa: F401
from trackmill.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes without distractors, their tracks' majority category, the best hundred of each category."""
    from trackmill.operators.aggregates import majority_category, top_per_category
    from trackmill.operators.suppression import remove_distractors
    from trackmill.sources.adapters import boxes

    kept = remove_distractors(boxes(spark, sf_dir), ["video_id", "frame_id"], overlap=0.05)
    return top_per_category(majority_category(kept), 100).select("ord", "video_id", "frame_id", "track_id", "category_id", "score")
