"""Centroid clustering (Lloyd's rounds) of integer vectors, exact whatever their magnitude.

Distances come from |x|^2 - 2 x.c + |c|^2, a matrix product in blocks of rows. A float64 product of integers is
exact while nothing in it reaches 2^53, so every block is guarded by the largest component of a row and of the
centroids; rows above the bound are measured in Python integers instead. Each task sums its rows by cluster and hands
over one row of sums a cluster, which a tree aggregation adds up: nothing is shuffled by cluster, so a cluster or
a vector that holds most rows costs no more than others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, trimmed, written

#: Below this every integer is a float64.
EXACT = 2.0**53
LONG = 2**63
#: Rows a matrix product.
BLOCK = 8192

Sums = dict[int, tuple[int, list[int], int]]  # cluster -> rows, componentwise sums, summed distances


def whole(x: Column, dim: int) -> Column:
    """True for vectors of `dim` components, none null, NaN or infinite."""
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) == dim) & fine, F.lit(False))


def to_integers(x: np.ndarray, scale: int) -> tuple[np.ndarray, list[int]]:
    """floor(scale * x) as float64, and the rows where that is no float64 (the product overflows). scale is a power of two, so all else is exact."""
    with np.errstate(over="ignore"):
        out = np.floor(x * float(scale))
    return out, np.flatnonzero(~np.isfinite(out).all(axis=1)).tolist()


def exact_integers(row: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of one row in Python integers."""
    return [math.floor(v * scale) if abs(v) < EXACT else int(v) * scale for v in row.tolist()]


def nearest(x: np.ndarray, scale: int, centroids: list[list[int]]) -> tuple[np.ndarray, list[int] | np.ndarray, np.ndarray, dict[int, list[int]]]:
    """Cluster and squared distance of each row (ties: the smaller number), the rows as float64 integers, and the large rows in full."""
    v, over = to_integers(x, scale)
    n, dim = v.shape
    most = max((abs(c) for row in centroids for c in row), default=0)
    height = np.abs(v).max(axis=1)
    # (|x| + |c|)^2 bounds |x|^2, 2|x.c|, |c|^2 and every partial sum of them.
    with np.errstate(over="ignore"):
        safe = dim * (height + (float(most) if most < EXACT else np.inf)) ** 2 < EXACT
    label, dist = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.float64)
    at = np.flatnonzero(safe)
    if len(at):
        c = np.array(centroids, dtype=np.float64)
        square = (c * c).sum(axis=1)
        for k in range(0, len(at), BLOCK):
            part = at[k : k + BLOCK]
            b = v[part]
            d = (b * b).sum(axis=1)[:, None] - 2.0 * (b @ c.T) + square[None, :]
            label[part] = d.argmin(axis=1)  # the first of equal ones
            dist[part] = d[np.arange(len(part)), label[part]]
    large: dict[int, list[int]] = {}
    if len(at) == n:
        return label, dist.astype(np.int64), v, large
    far: list[int] = [int(d) for d in dist]
    for i in np.flatnonzero(~safe).tolist():
        large[i] = exact_integers(x[i], scale) if i in set(over) else [int(t) for t in v[i]]
        far[i], label[i] = min((sum((a - b) ** 2 for a, b in zip(large[i], c, strict=True)), k) for k, c in enumerate(centroids))
    return label, far, v, large


def _arrays(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    x = batch.column(column)
    return x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def partial_sums(dim: int, scale: int, centroids: list[list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task hands over: one row a cluster, numbers written out in decimal as they may exceed a long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Sums = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            label, dist, v, large = nearest(_arrays(batch, "x", dim), scale, centroids)
            small = np.ones(len(label), dtype=bool)
            small[list(large)] = False
            top = int(np.abs(v[small]).max()) if small.any() else 0
            for k in np.unique(label).tolist():
                mine = np.flatnonzero((label == k) & small)
                # Components of rows that passed the guard are below 2^27, so a batch's sums are longs.
                assert top * max(1, len(mine)) < LONG
                sums = v[mine].astype(np.int64).sum(axis=0).tolist()
                rows = np.flatnonzero(label == k).tolist()
                for i in (i for i in rows if i in large):
                    sums = [a + b for a, b in zip(sums, large[i], strict=True)]
                total = add_sums(total, (k, len(rows), sums, sum(int(dist[i]) for i in rows)))
        cols = [[*total], [n for n, _, _ in total.values()], [",".join(map(str, s)) for _, s, _ in total.values()], [str(d) for _, _, d in total.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["cluster", "n", "sums", "dist"])

    return run


def add_sums(total: Sums, row: tuple[int, int, list[int], int]) -> Sums:
    k, n, sums, dist = row
    if k in total:
        m, old, d = total[k]
        total[k] = (m + n, [a + b for a, b in zip(old, sums, strict=True)], d + dist)
    else:
        total[k] = (n, sums, dist)
    return total


def merge_sums(a: Sums, b: Sums) -> Sums:
    for k, (n, sums, dist) in b.items():
        a = add_sums(a, (k, n, sums, dist))
    return a


def aggregate(vectors: DataFrame, dim: int, scale: int, centroids: list[list[int]]) -> Sums:
    """Assign all vectors and add up each cluster; what comes to the driver has a row a cluster, however many vectors there are."""
    rows = vectors.select("x").mapInArrow(trimmed(partial_sums(dim, scale, centroids)), "cluster int, n long, sums string, dist string").rdd
    return rows.map(lambda r: (r.cluster, r.n, [int(s) for s in r.sums.split(",")], int(r.dist))).treeAggregate({}, add_sums, merge_sums, depth=2)


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def _long(n: int) -> int | None:
    return n if -LONG <= n < LONG else None


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1:") -> DataFrame:
    """One row per vector kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with exactly `dim` components, none null or non-finite; a component x becomes floor(scale * x), scale
    being a power of two. The k kept vectors of smallest sha256 of seed and id, in that order, are the first centroids (all
    of them, if there are fewer). Each round assigns every vector to its nearest centroid (ties: smaller number) and puts the
    floor of its vectors' means in place of each centroid that has any; then vectors are assigned once more.
    Rows with a null id are clustered, and are first centroids only if ids run out; rows that share an id are rows of their
    own (as first centroids in the order of their components). Distances and sums beyond a long are null; the clusters are
    right there too. An empty table, or one without a kept vector, gives an empty result; other columns are ignored.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale is a power of two")
    spark = vectors.sparkSession
    bounded_batches(spark)
    x = vectors[vec_col]
    element = x_type.elementType.simpleString() if (x_type := vectors.schema[vec_col].dataType).typeName() == "array" else "double"
    x = x if element in ("float", "double") else x.cast("array<double>")
    kept = written(vectors.select(vectors[id_col].cast("long").alias("vec_id"), x.alias("x")).where(whole(F.col("x"), dim)), "vectors")
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), F.col("x").cast("array<double>")).limit(k).select(F.col("x").cast("array<double>").alias("x")).collect()
    centroids = [exact_integers(np.array(r["x"]), scale) for r in first]
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        for at, (n, sums, _) in aggregate(kept, dim, scale, centroids).items():
            centroids[at] = [s // n for s in sums]
    last = aggregate(kept, dim, scale, centroids)
    by_cluster = [_long(last[c][2]) if c in last else 0 for c in range(len(centroids))]
    inertia, digests = _long(sum(d for _, _, d in last.values())), [digest(c) for c in centroids]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            label, dist, _, _ = nearest(_arrays(b, "x", dim), scale, centroids)
            at = pa.array(label, pa.int32())
            distance = pa.array(dist, pa.int64()) if isinstance(dist, np.ndarray) else pa.array([_long(d) for d in dist], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), at, distance, pa.array(by_cluster, pa.int64()).take(at), pa.array([inertia] * b.num_rows, pa.int64()), pa.array(digests).take(at)],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return kept.mapInArrow(trimmed(assign), schema)


_ASSIGN = """
a{k} AS MATERIALIZED (
  SELECT vec_id, v, arg_min(cluster, d * 1000 + cluster) AS cluster, min(d) AS distance
  FROM (SELECT vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{k}) GROUP BY vec_id, v)"""
_MOVE = """
m{k} AS (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
  FROM (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{k}, range(1, 65) r(i) GROUP BY cluster, i) GROUP BY cluster),
c{n} AS MATERIALIZED (
  SELECT c{k}.cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} ON c{k}.cluster = m{k}.cluster)"""

#: Three rounds and the last assignment in SQL, for unique ids and sums that a long holds.
ORACLE = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c FROM kept ORDER BY 1 LIMIT 16),""" + ",".join(
    _ASSIGN.format(k=k) + "," + _MOVE.format(k=k, n=k + 1) for k in range(3)) + "," + _ASSIGN.format(k=3) + """
SELECT vec_id, CAST(a3.cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a3.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.c, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON a3.cluster = c3.cluster
"""
