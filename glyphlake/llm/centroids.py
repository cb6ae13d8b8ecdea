"""Centroid clustering of integer vectors by partial-distance search.

Components become integers, floor(scale * x). Every round assigns each vector to its nearest centroid and replaces the centroids by the
floors of their vectors' means; all of it is whole-number arithmetic, so results do not depend on order or partitions. A search takes the
dimensions by falling variance, a few at a time: it sums the squared differences of those for all centroids, finishes the most promising
one, and carries the others on only while their sum is not strictly above the best distance so far; those that survive finish all
dimensions. Ties go to the smaller number.

The integers are written once to the shared folder; each round reads them, sums per task and cluster, and shuffles a row per task, cluster
and dimension. What goes through the driver are the centroids, and sums of their size.

Nulls and edge cases: vectors that are null, of another length, or hold null or non-finite components are not kept and have no row; components
whose integer lies beyond ±2**27 count as ±2**27, as a squared distance would else leave the range of a long, and sums of distances beyond
that range are its end; rows with a null key are clustered but never start a centroid unless others are too few; repeated rows count each;
fewer vectors than centroids give fewer centroids, an empty table no rows; any other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.words import saved, slices

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Integers lie within ±LIMIT, so that any squared distance of 64 dimensions is a long.
LIMIT = 1 << 27
#: Dimensions that are added before the next look at who may still win; rows searched at once.
STEP, ROWS = 8, 4096
LONGEST = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(key, q array of int) of the vectors that are kept."""
    kept = vectors.select(F.col(key).alias("key"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    kept = kept.filter((F.size("v") == dimensions) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return kept.select("key", F.transform("v", lambda x: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), x * scale))).cast("int")).alias("q"))


def _matrix(lists: pa.Array, dimensions: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def nearest(q: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, by partial distances along `order`."""
    q, c = np.ascontiguousarray(q[:, order]), centroids[:, order]
    width = q.shape[1]
    step = min(STEP, width)
    partial = np.stack([np.square(q[:, :step] - x[:step]).sum(1) for x in c], axis=1)
    cluster = partial.argmin(1)
    rest = q[:, step:] - c[cluster, step:]
    best = partial[np.arange(len(q)), cluster] + np.square(rest).sum(1)
    first = cluster.copy()
    for k, x in enumerate(c):
        rows = np.flatnonzero((first != k) & (partial[:, k] <= best))
        so_far = partial[rows, k]
        for d in range(step, width, STEP):
            if not len(rows):
                break
            so_far = so_far + np.square(q[rows, d : d + STEP] - x[d : d + STEP]).sum(1)
            alive = so_far <= best[rows]
            rows, so_far = rows[alive], so_far[alive]
        wins = (so_far < best[rows]) | (k < cluster[rows])  # here so_far <= best, and a tie goes to the smaller number
        cluster[rows[wins]], best[rows[wins]] = k, so_far[wins]
    return cluster, best


def _by_variance(ints: DataFrame, dimensions: int) -> np.ndarray:
    """Dimensions by falling variance. It sets the order of the search only, never its result."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, dimensions))
        for b in slices(batches, ROWS):
            q = _matrix(b.column(1), dimensions).astype(np.float64)
            total += np.stack([np.full(dimensions, len(q)), q.sum(0), np.square(q).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions)), *map(pa.array, total)], names=["d", "n", "s", "ss"])

    rows = ints.mapInArrow(moments, "d long, n double, s double, ss double").groupBy("d").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]).collect()
    spread = {r["d"]: r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2 if r["n"] else 0.0 for r in rows}
    return np.array(sorted(range(dimensions), key=lambda d: (-spread.get(d, 0.0), d)))


def _moved(ints: DataFrame, centroids: list[list[int]], order: np.ndarray) -> list[list[int]]:
    """The centroids after one round."""
    c = np.array(centroids, np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for b in slices(batches, ROWS):
            q = _matrix(b.column(1), c.shape[1])
            cluster, _ = nearest(q, c, order)
            n += np.bincount(cluster, minlength=len(c))
            for k in np.unique(cluster):
                total[k] += q[cluster == k].sum(0)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen]), pa.array(list(total[seen]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    rows = ints.mapInArrow(sums, "cluster long, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("d", "s"))
    rows = rows.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    new = [list(x) for x in centroids]
    for r in rows.collect():  # a row per centroid and dimension
        new[r["cluster"]][r["d"]] = int(r["s"]) // r["n"]
    return new


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Per kept vector: the key, cluster, distance, cluster_inertia, inertia, centroid (array of int)."""
    spark = vectors.sparkSession
    ints = saved(integer_vectors(vectors, key, vector, dimensions, scale))
    start = ints.select("q", F.sha2(F.concat_ws(":", F.lit(seed), F.col("key").cast("string")), 256).alias("h"), F.col("key").isNull().alias("last")).orderBy("last", "h", "q").limit(k)
    centroids = [r["q"] for r in start.collect()]
    shape = f"`{key}` {vectors.schema[key].dataType.simpleString()}, cluster int, distance long"
    if not centroids:
        return spark.createDataFrame([], f"{shape}, cluster_inertia long, inertia long, centroid array<int>")
    order = _by_variance(ints, dimensions)
    for _ in range(rounds):
        moved = _moved(ints, centroids, order)
        if moved == centroids:  # no later round would change anything
            break
        centroids = moved
    c = np.array(centroids, np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            cluster, best = nearest(_matrix(b.column(1), dimensions), c, order)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array(best)], names=[key, "cluster", "distance"])

    assigned = ints.mapInArrow(assign, shape)
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(inertia.values()), LONGEST)
    about = spark.createDataFrame([(i, min(inertia.get(i, 0), LONGEST), total, x) for i, x in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid array<int>")
    return assigned.join(F.broadcast(about), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # a row per centroid


def brute_force(rows: list[tuple[int, list[float]]], k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> dict[int, tuple]:
    """The same for a few rows with distinct keys, by whole distances: key -> (cluster, distance, cluster inertia, inertia, centroid)."""
    ints = {i: [max(-LIMIT, min(LIMIT, int(np.floor(x * scale)))) for x in v] for i, v in rows}
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    centroids = [ints[i] for i in sorted(ints, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())[:k]]
    near = lambda: {i: min((far(v, c), j) for j, c in enumerate(centroids))[::-1] for i, v in ints.items()}
    for _ in range(rounds):
        for j, members in groupby(sorted(near().items(), key=lambda x: x[1][0]), key=lambda x: x[1][0]):
            own = [ints[i] for i, _ in members]
            centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = near()
    inertia = [sum(d for j, d in found.values() if j == c) for c in range(len(centroids))]
    return {i: (j, d, inertia[j], sum(inertia), centroids[j]) for i, (j, d) in found.items()}


def op11_partial_distance_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")
