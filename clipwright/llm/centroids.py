"""Integer k-means with a LAESA pivot table.

Components become integers, floor(scale * x).  The pivots are the first
centroids and a few vectors far apart from a bounded sample.  They stay fixed,
and every vector's squared distance to each of them is computed once and stored
beside it.  In a round the distances of the
centroids to the pivots are known, and by the triangle inequality
|d(v, p) - d(c, p)| bounds d(v, c) from below.  The centroid with the least
bound gets an exact distance first; only centroids whose bound does not exceed
it get theirs.  All that decides is integer arithmetic; roots serve the bounds
alone and give way by more than their rounding.

A round is one pass over the stored table.  Tasks give out one sum for each
cluster, so that what the driver sees is k rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import mapped
from .store import keep

K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: Pivots besides the first centroids, and of how many vectors, those with the least hashes, they are chosen.
PIVOTS, POOL = 8, 512
#: Integers beyond this have squared distances that a long may not hold.
LARGEST = 1 << 26
#: Exact distances computed at a time.
TOGETHER = 1 << 14


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def to_each(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(vectors, points) exact squared distances."""
    return np.stack([_squared(vectors, p[None, :]) for p in points], axis=1) if len(points) else np.zeros((len(vectors), 0), np.int64)


def far_apart(pool: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different vectors of ``pool``, each as far as can be from those before it; the first is the farthest from the mean."""
    if not len(pool):
        return pool
    mean = np.floor_divide(pool.sum(axis=0), len(pool))
    chosen = [int(np.argmax(_squared(pool, mean[None, :])))]
    gap = _squared(pool, pool[chosen[0]][None, :])
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, _squared(pool, pool[chosen[-1]][None, :]))
    return pool[chosen]


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, exact distances computed) of each vector; of equally near centroids the smaller number."""
    n, k = len(vectors), len(centroids)
    roots, across = np.sqrt(to_pivots), np.sqrt(to_each(centroids, pivots))
    bound = np.zeros((n, k))
    for p in range(len(pivots)):
        gap = np.abs(roots[:, p, None] - across[None, :, p])
        np.maximum(bound, gap - 1e-9 * (roots[:, p, None] + across[None, :, p]), out=bound)
    bound *= bound
    first = bound.argmin(axis=1)
    found = np.full((n, k), np.iinfo(np.int64).max)
    rows = np.arange(n)
    least = _squared(vectors, centroids[first])
    found[rows, first] = least
    survives = bound <= least[:, None]
    survives[rows, first] = False
    at, to = np.nonzero(survives)
    for i in range(0, len(at), TOGETHER):
        a, c = at[i : i + TOGETHER], to[i : i + TOGETHER]
        found[a, c] = _squared(vectors[a], centroids[c])
    cluster = found.argmin(axis=1)
    return cluster, found[rows, cluster], n + len(at)


def _matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, width)


def _to_pivots(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            d = to_each(_matrix(b, "q", pivots.shape[1]), pivots)
            ends = pa.array(np.arange(0, d.size + 1, len(pivots), dtype=np.int32))
            yield {"vec_id": b.column("vec_id"), "q": b.column("q"), "far": pa.ListArray.from_arrays(ends, pa.array(d.ravel()))}

    return run


def _sums(pivots: np.ndarray, centroids: np.ndarray):
    """For each cluster of a task its size and componentwise sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for b in batches:
            q = _matrix(b, "q", centroids.shape[1])
            cluster, _, _ = nearest(q, _matrix(b, "far", len(pivots)), pivots, centroids)
            count += np.bincount(cluster, minlength=len(centroids))
            np.add.at(total, cluster, q)
        yield {"cluster": np.arange(len(centroids), dtype=np.int32), "n": count, "total": total.tolist()}

    return run


def _assigned(pivots: np.ndarray, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            cluster, distance, exact = nearest(_matrix(b, "q", centroids.shape[1]), _matrix(b, "far", len(pivots)), pivots, centroids)
            yield {"vec_id": b.column("vec_id"), "cluster": cluster.astype(np.int32), "distance": distance}

    return run


def _by_hash(table: DataFrame, salt: int, n: int) -> np.ndarray:
    """The ``n`` vectors with the least SHA-256 of salt and id, in that order; a null id has none."""
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = table.filter("vec_id is not null").select(mark.alias("mark"), "q").orderBy("mark", "q").limit(n).collect()
    return np.array([r["q"] for r in rows], np.int64)


def _next(table: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    dims = range(centroids.shape[1])
    sums = mapped(table, _sums(pivots, centroids), "cluster int, n long, total array<long>").groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in dims])
    new = centroids.copy()
    for r in sums.filter("n > 0").collect():  # k rows
        new[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in dims]
    return new


def _by_cluster(values: list, kind: str) -> Column:
    return F.element_at(F.array([F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)


def centroid_clusters(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept vector.

    Kept are vectors of exactly ``dims`` components, none null or non-finite;
    others have no row.  The first centroids are the ``k`` kept vectors with
    the least SHA-256 of ``1:<vec_id>``; a null id is assigned but starts no
    centroid, rows that repeat an id are vectors of their own, and with fewer
    than ``k`` there are fewer clusters.  Raises where an integer component is
    beyond 2**26, as squared distances would not fit a long.  Other columns
    are ignored.
    """
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    plain = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    finite = f"size(e) = {dims} and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    most = f"exists(e, x -> abs({scale} * x) > {LARGEST})"
    whole = plain.filter(finite).select("vec_id", F.expr(f"if({most}, raise_error('a component beyond 2**26'), transform(e, x -> cast(floor({scale} * x) as int)))").alias("q"))
    integers = keep(whole)
    centroids = _by_hash(integers.df, 1, k)
    if not len(centroids):
        integers.drop()
        return vectors.sparkSession.createDataFrame([], schema)
    pivots = np.concatenate((centroids, far_apart(_by_hash(integers.df, 2, POOL), PIVOTS)))
    table = keep(mapped(integers.df, _to_pivots(pivots), "vec_id long, q array<int>, far array<long>"))
    integers.drop()
    for _ in range(rounds):
        centroids = _next(table.df, pivots, centroids)
    found = keep(mapped(table.df, _assigned(pivots, centroids), "vec_id long, cluster int, distance long"))
    table.drop()
    sums = dict.fromkeys(range(len(centroids)), 0) | {r["cluster"]: r["s"] for r in found.df.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return found.df.select("vec_id", "cluster", "distance", _by_cluster(list(sums.values()), "long").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), _by_cluster(marks, "string").alias("centroid_sha256"))
