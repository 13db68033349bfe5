"""Centroid clustering with the threshold algorithm.

Vectors become integers, ``floor(scale * x)``, so that all sums and distances
are exact.  Centroids 0, 1, ... start as the ``k`` vectors with the smallest
sha256 of ``<seed>:<id>``.  Each round assigns every vector to its nearest
centroid (squared Euclidean distance, ties to the smaller number) and replaces
every centroid that has vectors by the floor of their mean; after the last
round the vectors are assigned once more.

Search: for every dimension the centroids stand in a list sorted by their value
there.  A vector enters each list at its own value and walks outward, the
nearer side first, one entry per list and step.  A centroid met for the first
time gets its exact distance.  No centroid that is still unmet can be nearer
than the sum over the lists of the squared distance to the next entry; the walk
stops when that sum strictly exceeds the best exact distance, so that a tie
with a smaller number is never cut off.

How it runs: the integer vectors are written once.  A pass over them broadcasts
the centroids (``k`` rows, a parameter) and returns at most ``k`` partial sums
per task, which are added up by (centroid, dimension); only the ``k`` new
centroids come to the driver.  The last pass is written, since both the sums of
distances and the result read it.

Defined results: kept are vectors of exactly ``dims`` components, none null,
NaN or infinite; other rows give no row.  Components beyond +-2^27 after
scaling count as that.  Rows that repeat an id are vectors of their own; equal
hashes (equal ids) order by their components; a row with a null id is kept and
starts a centroid only where too few rows have one.  Fewer than ``k`` kept
vectors give as many centroids as vectors; no kept vector gives an empty
result.  A sum of distances beyond a long is null.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.llm.common import stored, table
from precis.llm.vectors import integer_vectors, matrix

DIMS, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, "1"
MOST = 1 << 27           # 64 squared differences of such components fit a long
_FAR = np.int64(1) << 31  # farther than any two components
_CELLS = 1 << 21         # rows x centroids x dimensions handled at once


class Lists:
    """Centroids and, per dimension, their values in order."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.k, self.dims = centroids.shape
        self.ids = np.argsort(centroids, axis=0, kind="stable").T.copy()       # dims x k
        self.values = np.take_along_axis(centroids.T, self.ids, axis=1)        # dims x k

    def entry(self, x: np.ndarray) -> np.ndarray:
        """Where each component enters its list (the first value not below it)."""
        out = np.empty(x.shape, np.int64)
        for d in range(self.dims):
            out[:, d] = np.searchsorted(self.values[d], x[:, d])
        return out


def nearest(x: np.ndarray, lists: Lists, steps: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row of ``x``;
    ``steps`` collects how many entries of each list every row read."""
    n, k = len(x), lists.k
    exact = np.full((n, k), np.iinfo(np.int64).max)
    rows, at = np.arange(n), np.arange(lists.dims)
    right = lists.entry(x)
    left = right - 1
    for step in range(k):
        if step:  # distance to the next entry of each list; both sides cannot be used up before step k
            frontier = (np.minimum(*_sides(x, left, right, lists, at)) ** 2).sum(axis=1)
            on = frontier <= exact[rows].min(axis=1)
            if steps is not None:
                steps.extend([step] * int((~on).sum()))
            if not on.any():
                break
            rows, x, left, right = rows[on], x[on], left[on], right[on]
        down, up = _sides(x, left, right, lists, at)
        lower = down <= up
        met = np.zeros((len(rows), k), bool)
        np.put_along_axis(met, lists.ids[at, np.where(lower, left, np.minimum(right, k - 1))], True, axis=1)
        who, which = np.nonzero(met & (exact[rows] == np.iinfo(np.int64).max))
        exact[rows[who], which] = ((x[who] - lists.centroids[which]) ** 2).sum(axis=1)
        left, right = left - lower, right + ~lower
    else:
        if steps is not None:
            steps.extend([k] * len(rows))
    best = exact.argmin(axis=1)
    return best, exact[np.arange(n), best]


def _sides(x, left, right, lists: Lists, at) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the next entry below and above."""
    below = np.where(left >= 0, x - lists.values[at, np.maximum(left, 0)], _FAR)
    above = np.where(right < lists.k, lists.values[at, np.minimum(right, lists.k - 1)] - x, _FAR)
    return below, above


def _slices(batch: pa.RecordBatch, lists: Lists):
    size = max(_CELLS // (lists.k * lists.dims), 64)
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``i, cluster, distance`` of the rows ``i, v``."""
    def run(batches):
        lists = Lists(centroids)
        for batch in batches:
            for part in _slices(batch, lists):
                number, distance = nearest(matrix(part.column(1), lists.dims), lists)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=["i", "cluster", "distance"])

    return vectors.select("i", "v").mapInArrow(run, "i long, cluster int, distance long")


def partial_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, n, sums``: at most one row per task and centroid."""
    def run(batches):
        lists = Lists(centroids)
        n, sums = np.zeros(lists.k, np.int64), np.zeros((lists.k, lists.dims), np.int64)
        for batch in batches:
            for part in _slices(batch, lists):
                x = matrix(part.column(0), lists.dims)
                number, _ = nearest(x, lists)
                n += np.bincount(number, minlength=lists.k)
                np.add.at(sums, number, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"])

    return vectors.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    rows = (partial_sums(vectors, centroids).select("cluster", "n", F.posexplode("sums").alias("d", "s"))
            .groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
            .collect())  # centroids x dimensions
    out = centroids.copy()
    for r in rows:
        out[r.cluster, r.d] = int(r.s) // r.n
    return out


def first_centroids(vectors: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("i").cast("string")), 256)
    rows = vectors.orderBy(rank.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE,
            k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(``i, cluster, distance`` of each kept vector, the final centroids)."""
    rows = df.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("x"))
    vectors = integer_vectors(rows, "i long", "x", scale, MOST, dims, "cluster-vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], "i long, cluster int, distance long"), np.zeros((0, dims), np.int64)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    return stored(assign(vectors, centroids), "assigned"), centroids


def cluster_digest(df: DataFrame) -> DataFrame:
    assigned, centroids = cluster(df)
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row per centroid
    total = _long(sum(sums.values()))
    each = [(c, _long(sums[c]), total, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
            for c, row in enumerate(centroids.tolist()) if c in sums]
    each = df.sparkSession.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (assigned.join(F.broadcast(each), "cluster")
            .select(F.col("i").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def _long(x: int) -> int | None:
    return x if x < 1 << 63 else None


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_digest(table(spark, sf_dir, "embeddings"))


def oracle(dims: int = DIMS, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """The same rounds as plain distances to every centroid."""
    parts = [f"""v AS MATERIALIZED (
  SELECT vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dims}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m
  FROM (SELECT v, sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h LIMIT {k})
)"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, min((d, c)) AS best FROM (
    SELECT vec_id, v, c, CAST(list_sum([(v[i] - m[i]) * (v[i] - m[i]) FOR i IN range(1, {dims + 1})]) AS BIGINT) AS d
    FROM v, c{r}) GROUP BY vec_id
)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(n.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
    SELECT c, list(s ORDER BY i) AS m FROM (
      SELECT best[2] AS c, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS s
      FROM a{r}, range(1, {dims + 1}) AS t(i) GROUP BY ALL) GROUP BY c) n ON n.c = c{r}.c
)""")
    last = rounds
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance,
       CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
       CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{last}.m, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON c{last}.c = best[2]
"""
