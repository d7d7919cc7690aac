"""Matching losses as measures over pair tables (group, i, j, value, same); no gradients.

``same`` tells the positive pairs. Rows without a positive have no value where a mean over positives is
taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.vectors import cycle_sharpness, sigmoid, softmax_over


def multi_positive(pairs: DataFrame, group: list[str], i: str = "i", value: str = "s", same: str = "same") -> DataFrame:
    """(group, i, loss): log(1 + sum over positives p and negatives n of exp(n - p))."""
    s = F.col(value)
    per = pairs.groupBy(*group, i).agg(F.sum(F.when(F.col(same), F.exp(-s)).otherwise(0.0)).alias("_p"), F.sum(F.when(F.col(same), 0.0).otherwise(F.exp(s))).alias("_n"))
    return per.select(*group, i, F.log1p(F.col("_p") * F.col("_n")).alias("loss"))


def _log_probability(pairs: DataFrame, group: list[str], i: str, value: str, same: str) -> DataFrame:
    """log of each pair's share, in which the positives of a row together count as one entry."""
    w = Window.partitionBy(*group, i)
    df = pairs.withColumn("_e", F.exp(F.col(value) - F.max(value).over(w))).withColumn("_k", F.sum(F.col(same).cast("int")).over(w))
    total = F.sum(F.when(F.col(same), F.col("_e") / F.col("_k")).otherwise(F.col("_e"))).over(w)
    return df.filter("_k > 0").withColumn("_lp", F.col(value) - F.max(value).over(w) - F.log(total))


def multi_positive_unbiased(pairs: DataFrame, group: list[str], i: str = "i", value: str = "s", same: str = "same") -> DataFrame:
    """(group, i, loss): minus the mean log share of a row's positives."""
    lp = _log_probability(pairs, group, i, value, same)
    return lp.filter(same).groupBy(*group, i).agg((-F.avg("_lp")).alias("loss"))


def multi_positive_uncertain(pairs: DataFrame, group: list[str], certainty: str, i: str = "i", value: str = "s", same: str = "same", scale: float = 2.0, alpha: float = 0.25) -> DataFrame:
    """The same with focal weights: alpha (1 - p) ** gamma, p the sigmoid of the value over its largest
    magnitude, gamma the row's certainty brought to [0, scale], both within the group."""
    whole = Window.partitionBy(*group)
    p = sigmoid(F.col(value) / F.max(F.abs(value)).over(whole))
    low, high = F.min(certainty).over(whole), F.max(certainty).over(whole)
    gamma = (F.col(certainty) - low) / (high - low + 1e-6) * scale
    marked = pairs.withColumn("_w", alpha * F.pow(1 - F.least(F.greatest(p, F.lit(1e-8)), F.lit(1 - 1e-8)), gamma))
    lp = _log_probability(marked, group, i, value, same)
    return lp.filter(same).groupBy(*group, i).agg((-F.avg(F.col("_w") * F.col("_lp"))).alias("loss"))


def mined_l2(pairs: DataFrame, group: list[str], value: str = "s", same: str = "same", pos_margin: float = 0.0, neg_margin: float = 0.3, limit: int = 3) -> DataFrame:
    """(group, loss): mean squared error to 1 or 0 after margins, over the positives and the hardest
    negatives, at most ``limit`` times as many; all negatives of a group without positives."""
    s = F.least(F.greatest(F.col(value) - F.when(F.col(same), pos_margin).otherwise(neg_margin), F.lit(0.0)), F.lit(1.0))
    df = pairs.withColumn("_cost", F.when(F.col(same), (s - 1) * (s - 1)).otherwise(s * s))
    df = df.withColumn("_cap", F.sum(F.col(same).cast("int")).over(Window.partitionBy(*group)) * limit)
    rank = F.row_number().over(Window.partitionBy(*group, same).orderBy(F.col("_cost").desc(), "i", "j"))
    return df.withColumn("_r", rank).filter(F.col(same) | (F.col("_cap") == 0) | (F.col("_r") <= F.col("_cap"))).groupBy(*group).agg(F.avg("_cost").alias("loss"))


def cycle_margin(pairs: DataFrame, group: list[str], i: str = "i", j: str = "j", value: str = "s", margin: float = 0.5) -> DataFrame:
    """(group, loss): how far the way from each i to the j and back misses its start by a margin, over
    the rows and the columns of the round trip. The round trip of a group is one join on j."""
    rows, columns = Window.partitionBy(*group, i), Window.partitionBy(*group, j)
    sharp = pairs.withColumn("_s", F.col(value) * cycle_sharpness(F.count(F.lit(1)).over(rows))).withColumn("_t", F.col(value) * cycle_sharpness(F.count(F.lit(1)).over(columns)))
    soft = sharp.withColumn("_there", softmax_over(F.col("_s"), rows)).withColumn("_back", softmax_over(F.col("_t"), columns))
    there = soft.select(*group, F.col(i).alias("a"), j, "_there")
    back = soft.select(*group, F.col(i).alias("b"), j, "_back")
    trip = there.join(back, [*group, j]).groupBy(*group, "a", "b").agg(F.sum(F.col("_there") * F.col("_back")).alias("p"))
    home = F.max(F.when(F.col("a") == F.col("b"), F.col("p")))
    away = F.coalesce(F.max(F.when(F.col("a") != F.col("b"), F.col("p"))), F.lit(0.0))
    miss = lambda side: trip.groupBy(*group, F.col(side).alias("k")).agg(F.greatest(F.lit(0.0), away + margin - home).alias("miss"))
    return miss("a").unionByName(miss("b")).groupBy(*group).agg(F.avg("miss").alias("loss"))


def row_cross_entropy(pairs: DataFrame, group: list[str], i: str = "i", value: str = "s", same: str = "same") -> DataFrame:
    """(group, i, loss): minus the log of the softmax share of a row's positives together."""
    p = softmax_over(F.col(value), Window.partitionBy(*group, i))
    per = pairs.withColumn("_p", p).groupBy(*group, i).agg(F.sum(F.when(F.col(same), F.col("_p"))).alias("_p"))
    return per.filter("_p IS NOT NULL").select(*group, i, (-F.log("_p")).alias("loss"))


def binary_cross_entropy(logit: Column, target: Column) -> Column:
    """Of a logit, stable for either sign."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))
