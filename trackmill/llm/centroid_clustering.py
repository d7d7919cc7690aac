"""Exact integer k-means with block-norm screening.

A vector is kept once as integers and once compressed to whole steps of at most LEVELS either way, with the
norm of what the compression leaves of each segment of its components. By Cauchy-Schwarz the product of vector
and centroid is at most that of the compressed vector and the centroid, plus the product of both norms for each
segment, so the compressed vectors and the segment norms bound every distance from below. A vector's distance
to the centroid of the smallest bound is worked out; centroids whose bound is above it are pruned, all others
get their exact integer distance. Bounds are lowered by more than floating point can be off, so the result does
not depend on them.

Vectors are written once to the shared folder. Each round broadcasts the centroids (as many as asked for, of
fixed length) and adds up integer sums per task and cluster before any shuffle; the driver sees one row per
cluster.

Defined results: vectors of another length, or with a null or a component that is not finite, are left out;
a scaled component beyond 2 ** 27 either way counts as that (above, a squared distance is no 64-bit number);
vectors without an id are clustered, but start no centroid unless ids run out; rows of one id are ordered by
their components, and repeated rows are vectors of their own; of fewer vectors than centroids each starts
one; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from trackmill.llm.common import keyed_schema, materialize

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Components of one segment, and steps either way of a compressed component.
SEGMENT, LEVELS = 8, 31
LIMIT = 1 << 27
#: Pairs whose exact distances are worked out at a time.
PAIRS = 1 << 15


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and ``v``, the kept vectors as whole numbers."""
    x = F.col("embedding")
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    whole = F.transform(x, lambda e: F.greatest(F.least(F.floor(F.lit(float(scale)) * e.cast("double")), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return vectors.filter((F.size(x) == dimensions) & usable).select("vec_id", whole.alias("v"))


def segment_norms(x: np.ndarray) -> np.ndarray:
    """(n, segments) norms of the rows' segments."""
    return np.sqrt(np.add.reduceat(x.astype(float) ** 2, np.arange(0, x.shape[1], SEGMENT), axis=1))


def compressed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole steps of each row's components, and per row: the step, its squared norm, the norms of what is left
    of its segments."""
    x = v.astype(float)
    step = np.maximum(1.0, np.ceil(np.abs(x).max(axis=1, initial=0) / LEVELS))
    q = np.rint(x / step[:, None])
    return q.astype(np.int8), np.hstack([step[:, None], (x**2).sum(axis=1)[:, None], segment_norms(x - q * step[:, None])])


def lower_bounds(q: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(n, k) bounds below the squared distances, lowered by more than rounding can have raised them."""
    c = centroids.astype(float)
    sizes = norms[:, 1:2] + (c**2).sum(axis=1)
    most = norms[:, :1] * (q.astype(float) @ c.T) + norms[:, 2:] @ segment_norms(c).T
    return sizes - 2 * most - 1e-9 * (sizes + 2 * np.abs(most)) - 1


def exact(v: np.ndarray, centroids: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (row, centroid), as 64-bit integers."""
    out = np.empty(len(rows), np.int64)
    for a in range(0, len(rows), PAIRS):
        d = v[rows[a : a + PAIRS]].astype(np.int64) - centroids[which[a : a + PAIRS]]
        out[a : a + PAIRS] = (d * d).sum(axis=1)
    return out


@dataclass
class Assigned:
    cluster: np.ndarray
    distance: np.ndarray
    pairs: int  # that got an exact distance


def assign(v: np.ndarray, q: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> Assigned:
    """Nearest centroid of each row, the smaller number of equally near ones."""
    n = len(v)
    bounds = lower_bounds(q, norms, centroids)
    nearest = bounds.argmin(axis=1)
    every = np.arange(n)
    first = exact(v, centroids, every, nearest)
    open_ = bounds <= first[:, None]
    open_[every, nearest] = False
    rows, which = np.nonzero(open_)
    best = np.full((n, len(centroids)), np.iinfo(np.int64).max)
    best[every, nearest] = first
    best[rows, which] = exact(v, centroids, rows, which)
    cluster = best.argmin(axis=1)
    return Assigned(cluster, best[every, cluster], n + len(rows))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))


def _compress(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, norms = compressed(_matrix(batch.column(1), dimensions))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(q), _lists(norms)], names=["vec_id", "v", "q", "norms"])

    return run


def _of_batch(batch: pa.RecordBatch, centroids: np.ndarray) -> tuple[np.ndarray, Assigned]:
    d = centroids.shape[1]
    v = _matrix(batch.column(1), d)
    return v, assign(v, _matrix(batch.column(2), d), _matrix(batch.column(3), 2 + -(-d // SEGMENT)), centroids)


def _sums(centroids: np.ndarray):
    """Per task and cluster: number of vectors, their sum, and how many exact distances were needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centroids.shape
        sums, counts, pairs = np.zeros((k, d), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            v, got = _of_batch(batch, centroids)
            np.add.at(sums, got.cluster, v.astype(np.int64))
            counts += np.bincount(got.cluster, minlength=k)
            pairs += got.pairs
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": used, "n": counts[used], "sums": list(sums[used]), "pairs": np.where(np.arange(len(used)) == 0, pairs, 0)})

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, got = _of_batch(batch, centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.cluster, pa.int32()), pa.array(got.distance)], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(whole: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors with the k smallest hashes of ``seed:vec_id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = whole.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r.v for r in rows], np.int64)


@dataclass
class Clustering:
    vectors: DataFrame  # vec_id, v, q, norms
    centroids: np.ndarray
    pairs: list[int]  # exact distances of each round


def fit(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Clustering:
    whole = quantised(vectors, dimensions, scale)
    schema = keyed_schema(whole, "v array<int>, q array<byte>, norms array<double>")
    held = materialize(whole.mapInArrow(_compress(dimensions), schema), "vectors")
    centroids, pairs = first_centroids(held, k, seed), []
    for _ in range(rounds if len(centroids) else 0):
        parts = held.mapInArrow(_sums(centroids), "cluster long, n long, sums array<long>, pairs long")
        sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dimensions)]
        found = parts.groupBy("cluster").agg(F.sum("n"), F.sum("pairs"), *sums).collect()  # a row per cluster
        pairs.append(sum(r[2] for r in found))
        for cluster, n, _, *total in found:
            centroids[cluster] = [t // n for t in total]  # rounds down
    return Clustering(held, centroids, pairs)


def _of_cluster(values: list, kind: str) -> Column:
    """A value per cluster, taken by the column ``cluster``."""
    return F.array(*[F.lit(v).cast(kind) for v in values])[F.col("cluster")]


def clusters(vectors: DataFrame, **options) -> DataFrame:
    """Per kept vector: vec_id, cluster, squared distance, the distances summed over its cluster and over
    all vectors, and the SHA-256 of its centroid."""
    fitted = fit(vectors, **options)
    schema = keyed_schema(fitted.vectors, "cluster int, distance long")
    if not len(fitted.centroids):
        none = fitted.vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    found = materialize(fitted.vectors.mapInArrow(_assigned(fitted.centroids), schema), "assigned")
    sums = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # a row per cluster
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in fitted.centroids.tolist()]
    return found.select(
        "*",
        _of_cluster([sums.get(j, 0) for j in range(len(hashes))], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast(LongType()).alias("inertia"),
        _of_cluster(hashes, "string").alias("centroid_sha256"),
    )


def oracle() -> str:
    """The rounds written out one after the other."""
    square = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    usable = f"len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMENSIONS}"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) v FROM embeddings WHERE {usable})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 j, v FROM kept QUALIFY j < {CENTROIDS})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min(({square}, j)) best FROM kept v, c{i} c GROUP BY r)")
        if i < ROUNDS:
            parts = f"SELECT best[2] j, i, sum(v[i]) s, count(*) n FROM a{i} JOIN kept USING (r), (SELECT unnest(range(1, {DIMENSIONS + 1})) i) GROUP BY ALL"
            means = f"SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) v FROM ({parts}) GROUP BY j"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m.v, c{i}.v) v FROM c{i} LEFT JOIN ({means}) m USING (j))")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, best[2]::INTEGER cluster, best[1]::BIGINT distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT cluster_inertia,
      (sum(best[1]) OVER ())::BIGINT inertia, sha256(array_to_string(c.v, ',')) centroid_sha256
    FROM a{ROUNDS} JOIN kept USING (r) JOIN c{ROUNDS} c ON c.j = best[2]"""


ORACLE = oracle()
