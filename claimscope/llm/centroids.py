"""Centroid clustering with a table of pivot distances (LAESA).

Vectors become integers, ``floor(scale * x)``. A fixed number of pivots is chosen
among them, and the distance of every vector to every pivot is stored once, beside
the vector. In each round the distances of the centroids to the pivots are computed
anew; for a vector x and a centroid c each pivot p bounds their distance from below
by ``|d(x,p) - d(c,p)|``. The centroid with the smallest bound is measured first;
only centroids whose bound does not exceed that distance survive and receive exact
integer distances. Bounds are lowered by more than the rounding of the square roots,
so no nearest centroid is lost, and ties go to the smaller number.

A round is one pass over the staged vectors. Centroids and pivots are of fixed
number and are sent with the task; a task adds its vectors up per cluster, so that
a round shuffles a few rows per task, however large a cluster is. The driver sees
the sums of the clusters, never vectors.

Defined cases: vectors that are null, of another length, or hold null or non-finite
components take no part; a null id hashes like an empty text; repeated rows
are vectors of their own; of rows with equal hashes the smaller vector comes first;
fewer vectors than centroids start fewer centroids; an empty table gives an empty
result. Integers are exact: beyond 2^26 they are computed in Python integers, and a
component or a distance outside the range of long is an error, not another value.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.staging import staged

K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, "2:"
#: Pivots of the table. More bound better and cost more to compare.
PIVOTS = 12
#: Up to here sums of squares of differences are exact in int64.
LARGEST = 1 << 26


def integer_vectors(vectors: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """``_id, _v`` (array of long) of the vectors that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    kept = vectors.where(x.isNotNull() & (F.size(x) == dim) & finite)
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    inside = F.forall(x, lambda c: F.abs(c.cast("double") * scale) < float(1 << 62))
    return kept.select(F.col(key).cast("long").alias("_id"), F.when(inside, scaled).otherwise(
        F.raise_error(F.lit("vector component beyond the range of long")).cast("array<bigint>")).alias("_v"))


def _exact(a: np.ndarray) -> np.ndarray:
    """``a`` as Python integers if int64 could overflow on it."""
    return a.astype(object) if np.abs(a).max(initial=0) > LARGEST else a


def _roots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``v`` to the pivots, as doubles."""
    d = v.astype(np.float64)[:, None, :] - pivots.astype(np.float64)[None, :, :]
    return np.sqrt((d * d).sum(2))


def _squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return (d * d).sum(1)


def nearest(v: np.ndarray, table: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray):
    """``cluster, distance, evaluated`` of each row of ``v``: the nearest centroid,
    its exact squared distance and how many centroids were measured.
    ``table`` and ``to_pivots`` are the pivot distances of vectors and centroids."""
    n, k = len(v), len(centroids)
    lower = np.zeros((n, k))
    for p in range(table.shape[1]):
        np.maximum(lower, np.abs(table[:, p, None] - to_pivots[None, :, p]), out=lower)
    size = max(table.max(initial=0.0), to_pivots.max(initial=0.0), 1.0)
    lower -= size * 1e-9  # more than the rounding of the roots and their difference
    both = _exact(np.concatenate((v, centroids)))
    v, centroids = both[:n], both[n:]
    first = lower.argmin(1)
    best, distance = first.copy(), _squares(v, centroids[first])
    reach = np.sqrt(distance.astype(np.float64)) * (1 + 1e-12)
    rows, cols = np.nonzero(lower <= reach[:, None])
    other = cols != first[rows]
    rows, cols = rows[other], cols[other]
    for a in range(0, len(rows), 1 << 16):
        r, c = rows[a:a + (1 << 16)], cols[a:a + (1 << 16)]
        found = _squares(v[r], centroids[c])
        better = (found < distance[r]) | ((found == distance[r]) & (c < best[r]))
        while better.any():
            # of a row's candidates the best one is left: the last to improve it
            at = np.flatnonzero(better)
            order = at[np.lexsort((c[at], found[at].astype(np.float64), r[at]))]
            lead = order[np.concatenate(([True], r[order][1:] != r[order][:-1]))]
            best[r[lead]], distance[r[lead]] = c[lead], found[lead]
            better = (found < distance[r]) | ((found == distance[r]) & (c < best[r]))
    return best, distance, n + len(rows)


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _rooted(pivots: np.ndarray):
    """mapInArrow function: adds the pivot distances to ``_id, _v``."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                flat = _roots(_matrix(b.column("_v"), pivots.shape[1]), pivots).ravel()
                offsets = np.arange(b.num_rows + 1, dtype=np.int32) * len(pivots)
                table = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_v"), table], names=["_id", "_v", "_d"])
    return run


def _assigned(pivots: np.ndarray, centroids: np.ndarray):
    """Generator of ``batch, vectors, cluster, distance`` over batches of the stored table."""
    to_pivots = _roots(centroids, pivots)

    def over(batches):
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("_v"), centroids.shape[1])
                cluster, distance, _ = nearest(v, _matrix(b.column("_d"), len(pivots)), centroids, to_pivots)
                yield b, v, cluster, distance
    return over


def _sums(pivots: np.ndarray, centroids: np.ndarray):
    """mapInArrow function: a task's vectors added up: ``cluster, component, total, n``."""
    over = _assigned(pivots, centroids)

    def run(batches):
        import decimal

        import pyarrow as pa

        k, dim = centroids.shape
        total, n = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for _, v, cluster, _ in over(batches):
            order = np.argsort(cluster, kind="stable")
            names, at = np.unique(cluster[order], return_index=True)
            total[names] += np.add.reduceat(_exact(v)[order], at, axis=0)
            n += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(some, dim).astype(np.int32)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(some))),
                 pa.array([decimal.Decimal(int(x)) for x in total[some].ravel()], pa.decimal128(38, 0)),
                 pa.array(np.repeat(n[some], dim))], names=["cluster", "component", "total", "n"])
    return run


def _rows(pivots: np.ndarray, centroids: np.ndarray):
    """mapInArrow function: ``vec_id, cluster, distance`` per vector."""
    over = _assigned(pivots, centroids)

    def run(batches):
        import pyarrow as pa

        for b, _, cluster, distance in over(batches):
            # a distance beyond long raises here
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(cluster.astype(np.int32)), pa.array(distance.tolist(), pa.int64())],
                names=["_id", "cluster", "distance"])
    return run


def _head(rows: DataFrame, seed: str, n: int, dim: int) -> np.ndarray:
    """The ``n`` vectors with the smallest hash of ``seed`` and id, in order."""
    mark = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"), 256)
    got = rows.orderBy(mark, "_v").limit(n).select("_v").collect()
    return np.array([r._v for r in got], np.int64).reshape(len(got), dim)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding",
            dim: int = DIM, scale: int = SCALE, seed: str = SEED, n_pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """``(rows, centroids)``: a row ``key, cluster, distance`` per vector (staged)
    and the final centroids, at most ``k`` rows of ``dim`` integers."""
    base = integer_vectors(vectors, key, vector, dim, scale)
    plain = staged(base, "centroid-vectors")
    centroids = _head(plain, seed, k, dim)
    pivots = _head(plain, "pivot:", n_pivots, dim)
    if not len(centroids):
        return plain.select(F.col("_id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    table = staged(plain.mapInArrow(_rooted(pivots), "_id long, _v array<long>, _d array<double>"), "centroid-table")
    for _ in range(rounds):
        parts = table.mapInArrow(_sums(pivots, centroids), "cluster int, component int, total decimal(38,0), n long")
        moved = centroids.copy()
        # k * dim numbers
        for r in parts.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            moved[r.cluster, r.component] = int(r.total) // r.n
        centroids = moved
    rows = staged(table.mapInArrow(_rows(pivots, centroids), "_id long, cluster int, distance long"), "centroid-rows")
    return rows.withColumnRenamed("_id", key), centroids


def summary(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` of :func:`cluster` with ``cluster_inertia, inertia`` (sums of the
    distances) and ``centroid_sha256``. A row per centroid is broadcast."""
    spark = rows.sparkSession
    total = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    every = sum(total.values())
    about = [(c, total[c], every, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
             for c in sorted(total)]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster")
