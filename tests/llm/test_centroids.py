"""Orchard search and the clustering against plain loops."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from kinweave.llm import centroids, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, cluster string, distance double, v int, h string"


def plain(rows, k, rounds, dimension, scale):
    """rows (key, vector) to a list of what cluster() returns."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    own = [v for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(own))
    for _ in range(rounds):
        given = [near(v)[1] for _, v in kept]
        for j in range(len(own)):
            members = [v for (_, v), g in zip(kept, given, strict=True) if g == j]
            if members:
                own[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    got = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in got)
    return [(i, j, d, sum(e for _, e, c in got if c == j), total, hashlib.sha256(",".join(map(str, own[j])).encode()).hexdigest()) for i, d, j in got]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_orchard_search_is_exact_with_ties_and_skips_centroids():
    rng = np.random.default_rng(3)
    for spread, k in ((1, 7), (40, 30), (3000, 64)):
        own = rng.integers(-spread, spread + 1, (k, 5))
        own[-1] = own[0]  # the smaller number wins
        own = np.concatenate([own, own[:2] * 2])
        vectors = np.concatenate([own, own[rng.integers(0, len(own), 2000)] + rng.integers(-spread // 20 - 1, spread // 20 + 2, (2000, 5))])
        d = ((vectors[:, None, :] - own[None]) ** 2).sum(axis=2)
        found, best, computed = centroids.nearest(vectors, own, centroids.orders(own))
        assert (found == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        assert computed <= len(vectors) * len(own)
        if k == 64:
            assert computed < 0.75 * len(vectors) * len(own)


def test_query_equals_loops_and_sql(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = ordered(queries.op11_centroids(spark, DATA).collect())
    assert got == ordered(plain([tuple(r) for r in rows], 16, 3, 64, 64))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
        assert got == ordered(c.sql(centroids.oracle()).fetchall())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], [1.0, 2.0], None, [], [1.0], [1.0, None], [nan, 1.0], [1.0, inf], [-0.01, -3.0], [5.5, 5.5], [1.0, 2.0, 3.0]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(0, [1.0, 2.0]), (0, [9.0, 9.0]), (None, [1.0, 2.0]), (None, [7.0, -7.0])]
    df = spark.createDataFrame([(i, v, "x", 1.5, 2, "h") for i, v in rows], SCHEMA)
    for k in (1, 3, 50):
        assert ordered(centroids.cluster(df, k=k, dimension=2).collect()) == ordered(plain(rows, k, 3, 2, 64))
    none = centroids.cluster(df.limit(0), dimension=2)
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_beyond_the_exact_range_fail(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="or larger"):
        centroids.cluster(df, dimension=2).collect()
