"""Vector similarity and score arithmetic as Column expressions.

Matrices are long tables with one row per (group, i, j); row and column sums are windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 0.95 quantiles of the chi-square distribution by degrees of freedom.
CHI2_95 = {1: 3.8415, 2: 5.9915, 3: 7.8147, 4: 9.4877, 5: 11.070, 6: 12.592, 7: 14.067, 8: 15.507, 9: 16.919}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, eps: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def similarity(a: Column, b: Column, kind: str = "dot_product", temperature: float = -1) -> Column:
    """Cosine is divided by a temperature in (0, 1]; a dot product is multiplied by one over 1."""
    if kind == "cosine":
        return cosine(a, b) / temperature if 0 < temperature <= 1 else cosine(a, b)
    return dot(a, b) * temperature if temperature > 1 else dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - cosine(a, b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def unit_cosine(a: Column, b: Column) -> Column:
    """Cosine mapped to [0, 1]."""
    return (1 + cosine(a, b)) / 2


def softmax_over(value: Column, window, stable: bool = True) -> Column:
    shifted = F.exp(value - F.max(value).over(window)) if stable else F.exp(value)
    return shifted / F.sum(shifted).over(window)


def bi_softmax(pairs: DataFrame, value: str, group: list[str], i: str, j: str, same: Column | None = None, eps: float = 1e-6) -> Column:
    """Mean of the row and the column softmax of a pair table; with ``same``, other pairs count 0 in both.

    The exponentials are taken as they are: values must stay below about 700.
    """
    e = F.exp(F.col(value))
    e = e if same is None else F.when(same, e).otherwise(0.0)
    rows, columns = Window.partitionBy(*group, i), Window.partitionBy(*group, j)
    return (e / (F.sum(e).over(rows) + eps) + e / (F.sum(e).over(columns) + eps)) / 2


def gated(cos: Column, gate: Column, threshold: float) -> Column:
    return F.when(gate > threshold, cos).otherwise(0.0)


def cycle_sharpness(n: Column, delta: float = 0.5, eps: float = 0.1) -> Column:
    """The factor that makes a softmax over n entries pick a winner by eps with confidence delta."""
    return F.log(n * (delta / (1 - delta))) / eps


def cycle_consistency(pairs: DataFrame, value: str, group: list[str], i: str, j: str) -> DataFrame:
    """(group, i, consistency): how surely each i comes back to itself by way of the best j."""
    rows, columns = Window.partitionBy(*group, i), Window.partitionBy(*group, j)
    sharp = pairs.withColumn("_rows", F.count(F.lit(1)).over(rows)).withColumn("_columns", F.count(F.lit(1)).over(columns))
    sharp = sharp.withColumn("_s", F.col(value) * cycle_sharpness(F.col("_rows"))).withColumn("_t", F.col(value) * cycle_sharpness(F.col("_columns")))
    there, back = softmax_over(F.col("_s"), rows), softmax_over(F.col("_t"), columns)
    both = sharp.withColumn("_there", there).withColumn("_back", back)
    return both.groupBy(*group, i).agg(F.sum(F.col("_there") * F.col("_back")).alias("consistency"))


def ema(old: Column, new: Column, weight_of_new: float) -> Column:
    return (1 - weight_of_new) * old + weight_of_new * new


def ema_fold(values: Column, weight_of_new: float) -> Column:
    """The running average of an ordered array, started by its first value."""
    return F.aggregate(F.slice(values, 2, F.size(values)), F.element_at(values, 1).cast("double"), lambda s, x: (1 - weight_of_new) * s + weight_of_new * x)


def ema_vector(old: Column, new: Column, weight_of_old: float) -> Column:
    """Running average of vectors, brought back to unit length."""
    return unit(F.zip_with(old, new, lambda x, y: weight_of_old * x + (1 - weight_of_old) * y))


def ensemble(image: Column, text: Column, novel: Column) -> Column:
    """Geometric mean of two scores; the image's weighs double on novel classes, the text's on base ones."""
    major, minor = 2.0 / 3, 1.0 / 3
    return F.when(novel, F.pow(image, F.lit(major)) * F.pow(text, F.lit(minor))).otherwise(F.pow(image, F.lit(minor)) * F.pow(text, F.lit(major)))


def fusion_ratio(confidence: Column, largest: float) -> Column:
    return largest * (1 - confidence) * (1 - confidence)


def fused_motion(cost: Column, maha: Column, weight: float = 0.98, freedom: int = 4) -> Column:
    """Appearance and motion cost together; beyond the gate the pair is impossible."""
    return F.when(maha > CHI2_95[freedom], F.lit(math.inf)).otherwise(weight * cost + (1 - weight) * maha)


def motion_blend(appearance: Column, overlap: Column, weight: float) -> Column:
    return (1 - weight) * appearance + weight * overlap


def log_sum_exp(value: Column, window) -> Column:
    top = F.max(value).over(window)
    return top + F.log(F.sum(F.exp(value - top)).over(window))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def mean_of_last(vectors: Column, n: int) -> Column:
    """Element-wise mean of the last n vectors of an array of vectors."""
    last = F.slice(vectors, F.greatest(F.lit(1), F.size(vectors) - n + 1), F.least(F.lit(n), F.size(vectors)))
    first = F.transform(F.element_at(last, 1), lambda x: x.cast("double"))
    total = F.aggregate(F.slice(last, 2, F.size(last)), first, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(last))
