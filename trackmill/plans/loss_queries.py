"""Queries over matching losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.functions import losses as L
from trackmill.functions import vectors as V
from trackmill.registry import query
from trackmill.sources.adapters import oracle, vector_pairs

FRAME = ["frame_id"]
_S = "SELECT frame_id, i, j, label_i % 3 = label_j % 3 AS same, list_dot_product(a, b) AS s, label_i / 10.0::DOUBLE AS c FROM pairs"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vector_pairs(spark, sf_dir)
    return p.select("frame_id", "i", "j", (F.col("label_i") % 3 == F.col("label_j") % 3).alias("same"), V.dot(F.col("a"), F.col("b")).alias("s"), (F.col("label_i") / 10).alias("c"))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("loss", F.round("loss", 6))


@query("MTH-1b", oracle("SELECT frame_id, i, round(ln(1 + sum(CASE WHEN same THEN exp(-s) ELSE 0 END) * sum(CASE WHEN same THEN 0 ELSE exp(s) END)), 6) AS loss FROM sims GROUP BY 1, 2", sims=_S))
def mth_1b(spark, sf_dir):
    """Multi-positive cross entropy."""
    return rounded(L.multi_positive(pairs(spark, sf_dir), FRAME))


_LP = "SELECT *, s - m - ln(sum(CASE WHEN same THEN exp(s - m) / k ELSE exp(s - m) END) OVER (PARTITION BY frame_id, i)) AS lp FROM (SELECT *, max(s) OVER (PARTITION BY frame_id, i) AS m, count(*) FILTER (same) OVER (PARTITION BY frame_id, i) AS k FROM sims) WHERE k > 0"


@query("MTH-1c", oracle("SELECT frame_id, i, round(-avg(lp), 6) AS loss FROM lps WHERE same GROUP BY 1, 2", sims=_S, lps=_LP))
def mth_1c(spark, sf_dir):
    """The unbiased form."""
    return rounded(L.multi_positive_unbiased(pairs(spark, sf_dir), FRAME))


_FOCAL = "SELECT frame_id, i, j, 0.25 * pow(1 - 1 / (1 + exp(-s / max(abs(s)) OVER (PARTITION BY frame_id))), (c - min(c) OVER (PARTITION BY frame_id)) / (max(c) OVER (PARTITION BY frame_id) - min(c) OVER (PARTITION BY frame_id) + 1e-6) * 2) AS w FROM sims"


@query("MTH-1d", oracle("SELECT l.frame_id, l.i, round(-avg(w * lp), 6) AS loss FROM lps l JOIN focal f ON l.frame_id = f.frame_id AND l.i = f.i AND l.j = f.j WHERE same GROUP BY 1, 2", sims=_S, lps=_LP, focal=_FOCAL))
def mth_1d(spark, sf_dir):
    """Weighted by uncertainty."""
    return rounded(L.multi_positive_uncertain(pairs(spark, sf_dir), FRAME, "c"))


@query(
    "MTH-1e",
    oracle(
        "SELECT frame_id, round(avg(cost), 6) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, same ORDER BY cost DESC, i, j) AS r, 3 * count(*) FILTER (same) OVER (PARTITION BY frame_id) AS cap FROM (SELECT *, CASE WHEN same THEN (least(greatest(s, 0.0), 1.0) - 1) ** 2 ELSE least(greatest(s - 0.05, 0.0), 1.0) ** 2 END AS cost FROM sims)) WHERE same OR cap = 0 OR r <= cap GROUP BY 1",
        sims=_S,
    ),
)
def mth_1e(spark, sf_dir):
    """Squared error with the hardest negatives."""
    return rounded(L.mined_l2(pairs(spark, sf_dir), FRAME, neg_margin=0.05))


@query(
    "MTH-1f",
    oracle(
        """SELECT frame_id, round(avg(miss), 6) AS loss FROM (
  SELECT frame_id, a, greatest(0.0, coalesce(max(p) FILTER (a <> b), 0) + 0.5 - max(p) FILTER (a = b)) AS miss FROM trips GROUP BY 1, 2
  UNION ALL SELECT frame_id, b, greatest(0.0, coalesce(max(p) FILTER (a <> b), 0) + 0.5 - max(p) FILTER (a = b)) FROM trips GROUP BY 1, 2) GROUP BY 1""",
        sims=_S,
        sharp="SELECT *, exp(x - max(x) OVER (PARTITION BY frame_id, i)) AS ex, exp(y - max(y) OVER (PARTITION BY frame_id, j)) AS ey FROM (SELECT frame_id, i, j, s * ln(count(*) OVER (PARTITION BY frame_id, i)) / 0.1 AS x, s * ln(count(*) OVER (PARTITION BY frame_id, j)) / 0.1 AS y FROM sims)",
        soft="SELECT frame_id, i, j, ex / sum(ex) OVER (PARTITION BY frame_id, i) AS there, ey / sum(ey) OVER (PARTITION BY frame_id, j) AS back FROM sharp",
        trips="SELECT x.frame_id, x.i AS a, y.i AS b, sum(x.there * y.back) AS p FROM soft x JOIN soft y ON x.frame_id = y.frame_id AND x.j = y.j GROUP BY 1, 2, 3",
    ),
)
def mth_1f(spark, sf_dir):
    """The cycle margin of round trips."""
    return rounded(L.cycle_margin(pairs(spark, sf_dir), FRAME))


@query("MTH-1g", oracle("SELECT frame_id, i, round(-ln(sum(p) FILTER (same)), 6) AS loss FROM (SELECT frame_id, i, same, exp(s) / sum(exp(s)) OVER (PARTITION BY frame_id, i) AS p FROM sims) GROUP BY 1, 2 HAVING count(*) FILTER (same) > 0", sims=_S))
def mth_1g(spark, sf_dir):
    """Cross entropy of row softmaxes."""
    return rounded(L.row_cross_entropy(pairs(spark, sf_dir), FRAME))


@query("MTH-1h", oracle("SELECT frame_id, round(avg(-(CASE WHEN same THEN ln(1 / (1 + exp(-s))) ELSE ln(1 - 1 / (1 + exp(-s))) END)), 6) AS loss FROM sims GROUP BY 1", sims=_S))
def mth_1h(spark, sf_dir):
    """Binary cross entropy."""
    target = F.when(F.col("same"), 1.0).otherwise(0.0)
    return rounded(pairs(spark, sf_dir).groupBy("frame_id").agg(F.avg(L.binary_cross_entropy(F.col("s"), target)).alias("loss")))
