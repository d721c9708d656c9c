"""Clustering of integer vectors around centroids, each vector's nearest centroid found by Orchard search.

Each centroid has a list of all centroids by distance from it. A search holds a centroid and walks its list: a centroid
seen for the first time is compared with the vector; if it is closer, or as close with a smaller number, the search jumps
to that one's list; it stops at the first entry that is strictly beyond twice the current distance, since by the triangle
inequality no centroid from there on can be as close. The batch's vectors walk in step, so each step is a few numpy calls.
Distances and sums are those of whole numbers, so results do not depend on how rows are dealt.

A round reads the stored vectors once and gives back, for each task and centroid, a count and componentwise sums; these
are added up by Spark, and the k x dimension totals alone reach the driver.

Defined results: a vector counts if it has exactly `dimension` components, none null or not finite; all others are left
out, as are null vectors. A null key is clustered but never seeds. Repeated keys and rows are rows of their own, and may
seed more than once. Seeds of one hash are taken in the order of their components. With fewer vectors than k all seed; an
empty table gives an empty result. A scaled component of `largest(dimension)` or more in size (2^26 for
64) fails the job, because four times a squared distance would no longer fit a long. Other columns, whatever their names, are ignored."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Vectors that one numpy pass takes.
ROWS = 16_384


def largest(dimension: int) -> int:
    """Components below this size give squared distances below 2^60."""
    return math.isqrt((1 << 60) // max(1, dimension)) // 2


def orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the squared distances of all centroids in ascending order, and their numbers."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(apart, axis=1, kind="stable")
    return np.take_along_axis(apart, order, axis=1), order


def nearest(vectors: np.ndarray, centroids: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the nearest centroids, squared distances to them, and how many distances were computed."""
    n, k = len(vectors), len(centroids)
    apart, order = lists
    own = np.zeros(n, np.int64)
    best = ((vectors - centroids[0]) ** 2).sum(axis=1)
    seen = np.zeros((n, k), bool)
    seen[:, 0] = True
    place, going, computed = np.zeros(n, np.int64), np.arange(n), n
    while len(going):
        at = place[going]
        going, at = going[at < k], at[at < k]
        # d(own, next) > 2 d(vector, own), squared; strictly, so that a tie is still looked at
        near = apart[own[going], at] <= 4 * best[going]
        going, at = going[near], at[near]
        new = order[own[going], at]
        place[going] += 1
        fresh = ~seen[going, new]
        rows, new = going[fresh], new[fresh]
        seen[rows, new] = True
        computed += len(rows)
        d = ((vectors[rows] - centroids[new]) ** 2).sum(axis=1)
        closer = (d < best[rows]) | ((d == best[rows]) & (new < own[rows]))
        rows = rows[closer]
        own[rows], best[rows], place[rows] = new[closer], d[closer], 0
    return own, best, computed


def scaled(df: DataFrame, key: str, vector: str, dimension: int, scale: int) -> DataFrame:
    """(key, v) of the vectors that count, with components floor(scale * x) as ints."""
    x, most = F.col(vector), largest(dimension)
    whole = F.coalesce(F.size(x) == dimension, F.lit(False)) & ~F.coalesce(F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(True))
    own = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    fits = F.forall(F.transform(x, lambda c: F.abs(F.lit(float(scale)) * c.cast("double"))), lambda c: c < most)
    checked = F.when(fits, own.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a scaled component is {most} or larger")).cast("array<int>"))
    return df.filter(whole).select(F.col(key), checked.alias("v"))


def seeds(vectors: DataFrame, key: str, k: int, seed: int) -> np.ndarray:
    """The k vectors whose keys have the smallest hashes, in ascending order of these: k rows on the driver."""
    named = vectors.filter(F.col(key).isNotNull()).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    return np.array([r["v"] for r in named.orderBy("h", "v").limit(k).collect()], np.int64)


def matrix(lists: pa.Array, dimension: int) -> np.ndarray:
    return lists.flatten().to_numpy().astype(np.int64).reshape(-1, dimension)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: componentwise floor(sum / count) of the vectors of each; one without any stays."""
    k, dimension = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, sums, counts = orders(centroids), np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = matrix(batch.column(0).slice(a, ROWS), dimension)
                own = nearest(part, centroids, lists)[0]
                turn, n = np.argsort(own, kind="stable"), np.bincount(own, minlength=k)
                there = np.flatnonzero(n)
                sums[there] += np.add.reduceat(part[turn], (np.cumsum(n) - n)[there], axis=0)
                counts += n
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["c", "n", "sums"])

    parts = vectors.select("v").mapInArrow(run, "c int, n long, sums array<long>")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = parts.select("c", "n", F.posexplode("sums").alias("i", "x")).groupBy("c", "i").agg(total("n").alias("n"), total("x").alias("x")).collect()  # k x dimension
    out = centroids.copy()
    for r in rows:
        out[r["c"], r["i"]] = int(r["x"]) // int(r["n"])
    return out


def assigned(vectors: DataFrame, key: str, centroids: np.ndarray) -> DataFrame:
    """(key, cluster, distance) of every vector."""
    dimension, kind = centroids.shape[1], vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = orders(centroids)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                own, best, _ = nearest(matrix(part.column(1), dimension), centroids, lists)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.astype(np.int32)), pa.array(best)], names=[key, "cluster", "distance"])

    return vectors.select(key, "v").mapInArrow(run, f"`{key}` {kind}, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts."""
    spark = df.sparkSession
    vectors = stored(scaled(df, key, vector, dimension, scale), "vectors")
    centroids = seeds(vectors, key, k, seed)
    if not len(centroids):
        kind = df.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    rows = stored(assigned(vectors, key, centroids), "assigned")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # k rows
    total = sum(r["s"] for r in sums)
    about = spark.createDataFrame([(r["cluster"], r["s"], total, digest(centroids[r["cluster"]])) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows, whatever the table


def oracle(k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same as one statement for DuckDB, by comparing every vector with every centroid."""
    near = lambda centroids: f"SELECT no, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT x.no, y.c, list_sum(list_transform(list_zip(x.v, y.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept x, {centroids} y) GROUP BY no"
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimension})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM (SELECT * FROM kept WHERE vec_id IS NOT NULL ORDER BY sha256('{seed}:' || vec_id), v LIMIT {k}))",
    ]
    for r in range(rounds):
        parts += [
            f"a{r} AS MATERIALIZED ({near(f'c{r}')})",
            f"m{r} AS (SELECT c, list(m ORDER BY i) AS v FROM (SELECT a.c, u.i, (sum(u.x) - ((sum(u.x) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM a{r} a JOIN (SELECT no, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept) u ON a.no = u.no GROUP BY a.c, u.i) GROUP BY c)",
            f"c{r + 1} AS MATERIALIZED (SELECT c0.c, coalesce(m.v::BIGINT[], c0.v) AS v FROM c{r} c0 LEFT JOIN m{r} m ON c0.c = m.c)",
        ]
    parts += [f"a{rounds} AS MATERIALIZED ({near(f'c{rounds}')})"]
    return "WITH " + ", ".join(parts) + (
        f" SELECT k.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256"
        f" FROM a{rounds} a JOIN kept k ON a.no = k.no JOIN c{rounds} c ON a.c = c.c"
    )
