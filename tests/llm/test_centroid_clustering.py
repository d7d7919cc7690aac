import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from trackmill.llm import centroid_clustering as K

SCHEMA = "vec_id long, embedding array<float>"


def plain_clusters(rows, k=K.CENTROIDS, rounds=K.ROUNDS):
    """rows (vec_id, embedding) with a usable embedding -> rows of the query, by loops over Python integers."""
    kept = []
    for i, x in rows:
        if x is not None and len(x) == 64 and all(e is not None and math.isfinite(e) for e in x):
            kept.append((i, [max(min(math.floor(256 * float(np.float32(e))), K.LIMIT), -K.LIMIT) for e in x]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    if not kept:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(column) // len(vs) for column in zip(*vs, strict=True)]
    best = [nearest(v) for _, v in kept]
    inertia = {j: sum(d for d, i in best if i == j) for _, j in best}
    return sorted(((i, j, d, inertia[j], sum(d for d, _ in best), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, best, strict=True)), key=str)


def found(df):
    return sorted(map(tuple, K.clusters(df).collect()), key=str)


def test_random_vectors_ties_and_unusable_ones(spark):
    rng = random.Random(3)
    grid = [[rng.choice([-0.5, 0.0, 0.25]) for _ in range(64)] for _ in range(12)]
    rows = [(i, rng.choice(grid) if rng.random() < 0.4 else [rng.uniform(-1, 1) for _ in range(64)]) for i in range(180)]
    rows += [(3, rows[3][1]), (3, grid[0]), (None, grid[1]), (-7, grid[2])]
    odd = [None, [], [1.0] * 63, [1.0] * 65, [None] + [0.0] * 63, [math.nan] + [0.0] * 63, [math.inf] * 64, [-math.inf] + [0.0] * 63]
    rows += [(1000 + i, x) for i, x in enumerate(odd)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 7])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", cluster int, v string")
    assert found(df) == plain_clusters(rows)
    assert K.clusters(df).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_huge_components_stay_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([3.4e38, -3.4e38, 1e5 * rng.random(), 0.0, 400000.0 + rng.random()]) for _ in range(64)]) for i in range(60)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain_clusters(rows)


def test_bounds_are_below_the_distances_and_prune():
    rng = np.random.default_rng(0)
    centres = rng.integers(-2000, 2000, (20, 64))
    v = (centres[rng.integers(0, 20, 500)] + rng.integers(-150, 150, (500, 64))).astype(np.int64)
    q, norms = K.compressed(v)
    got = K.assign(v, q, norms, centres)
    every = ((v[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert np.abs(q).max() <= K.LEVELS and (K.lower_bounds(q, norms, centres) <= every).all()
    assert (got.cluster == every.argmin(axis=1)).all() and (got.distance == every.min(axis=1)).all()
    assert got.pairs < 0.1 * every.size
    huge = rng.integers(-K.LIMIT, K.LIMIT, (300, 64))
    assert (K.lower_bounds(*K.compressed(huge), huge[:50]) <= ((huge[:, None, :] - huge[None, :50]) ** 2).sum(axis=2)).all()


def test_most_centroids_of_the_table_are_pruned(spark, sf):
    fitted = K.fit(spark.read.parquet(f"{sf}/embeddings.parquet"))
    n = fitted.vectors.count()
    assert len(fitted.pairs) == K.ROUNDS and max(fitted.pairs) < 0.5 * n * len(fitted.centroids)


def test_text_ids(spark):
    rows = [(f"id {i}", [i / 10, *[0.0] * 63]) for i in range(50)]
    out = K.clusters(spark.createDataFrame(rows, "vec_id string, embedding array<double>"))
    assert out.schema[0].dataType.simpleString() == "string" and out.count() == 50


def test_query_matches_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    out = K.clusters(spark.read.parquet(f"{sf}/embeddings.parquet"))
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({K.ORACLE})").fetchall()
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert [k for _, k in out.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
