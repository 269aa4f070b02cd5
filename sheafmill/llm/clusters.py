"""Exact k-means over vectors of integers, for centroid clustering of embeddings.

A component x becomes floor(scale * x). Distances come from the expansion |x|^2 - 2 x.c + |c|^2 as a product of matrices in float64, a block of rows at a
time. Where (max |x| + max |c|)^2 times the dimensions stays below 2^53, every number on the way is an integer that float64 holds, so the distances are
exact; other rows are worked out in integers. An RDD treeAggregate combines the partitions' sums as unbounded integers, so the floor of a mean does not depend
on how rows are dealt. A round reads the vectors once and moves k sums a partition; the driver holds the k centroids.

Edge cases: vectors that are null, of another length, or with a null, NaN or infinite component are left out; equal vectors are clustered alike and repeated rows
count again; a null key comes last as a seed, and of equal keys the vector that sorts first; fewer vectors than clusters make as many clusters as vectors;
distances and inertias beyond the range of a long are its largest value; an empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialise, scratch

BLOCK = 8192
EXACT = 1 << 53
MAX_LONG = (1 << 63) - 1
#: Sums, counts and summed distances of each cluster.
Totals = list[tuple[int, list[int], int]]


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` components, all of them finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def as_integers(row: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of doubles, without a bound."""
    return [math.floor(Fraction(x) * scale) for x in row.tolist()]


def distances(raw: np.ndarray, centroids: list[list[int]], scale: int) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Cluster and squared distance of each row; the rows that float64 does not hold exactly have their distance in a dict of unbounded integers."""
    with np.errstate(over="ignore"):
        x = np.floor(raw * scale)
    top_c = max((abs(v) for c in centroids for v in c), default=0)
    limit = max(-1, math.isqrt((EXACT - 1) // max(1, raw.shape[1])) - top_c)
    exact = np.abs(x).max(axis=1, initial=0) <= limit
    near, far, wide = np.zeros(len(x), dtype=np.int32), np.zeros(len(x), dtype=np.int64), {}
    if exact.any():
        own, c = x[exact], np.array(centroids, dtype=np.float64)
        d = (own * own).sum(axis=1)[:, None] - 2 * (own @ c.T) + (c * c).sum(axis=1)[None, :]
        near[exact] = d.argmin(axis=1)  # ties: the smaller number
        far[exact] = d.min(axis=1)
    for i in np.flatnonzero(~exact).tolist():
        q = as_integers(raw[i], scale)
        wide[i], near[i] = min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))
    return near, far, wide


def _blocks(batch: pa.RecordBatch, at: int, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """The vectors of a batch as float64 matrices of at most BLOCK rows."""
    column = batch.column(at)
    for first in range(0, batch.num_rows, BLOCK):
        part = column.slice(first, BLOCK)
        yield first, part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), dims)


def block_totals(raw: np.ndarray, centroids: list[list[int]], scale: int) -> Totals:
    near, far, wide = distances(raw, centroids, scale)
    narrow = np.ones(len(raw), dtype=bool)
    narrow[list(wide)] = False
    out = []
    for j in range(len(centroids)):
        own = (near == j) & narrow
        # At most BLOCK components below 2^26.5, and distances below 2^53 in two halves: within int64.
        sums = np.floor(raw[own] * scale).astype(np.int64).sum(axis=0).tolist()
        inertia = (int((far[own] >> 26).sum()) << 26) + int((far[own] & ((1 << 26) - 1)).sum())
        for i in (i for i in wide if near[i] == j):
            sums = [a + b for a, b in zip(sums, as_integers(raw[i], scale), strict=True)]
            inertia += wide[i]
        out.append((int((near == j).sum()), sums, inertia))
    return out


def merged(a: Totals, b: Totals) -> Totals:
    if not a or not b:
        return a or b
    return [(m + n, [x + y for x, y in zip(s, t, strict=True)], d + e) for (m, s, d), (n, t, e) in zip(a, b, strict=True)]


def _mapped(step: Callable[[np.ndarray], Totals], dims: int) -> Callable:
    """A partition's totals as one row of decimal text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Totals = []
        for batch in batches:
            for _, raw in _blocks(batch, 0, dims):
                total = merged(total, step(raw))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([";".join(f"{n}:{','.join(map(str, s))}:{d}" for n, s, d in total)])], names=["totals"])

    return run


def _read(row: str) -> Totals:
    parts = [p.split(":") for p in row.split(";")]
    return [(int(n), [int(x) for x in s.split(",")], int(d)) for n, s, d in parts]


def totals(vectors: DataFrame, centroids: list[list[int]], scale: int) -> Totals:
    """Each cluster's rows, component sums and summed distances."""
    dims = len(centroids[0])
    rows = vectors.select("vector").mapInArrow(_mapped(lambda raw: block_totals(raw, centroids, scale), dims), "totals string")
    return rows.rdd.treeAggregate([], lambda a, row: merged(a, _read(row["totals"])), merged)


def seeds(vectors: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and key."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256)
    first = vectors.select("vector", rank.alias("rank")).orderBy(F.asc_nulls_last("rank"), "vector").limit(k).collect()
    return [as_integers(np.array(r["vector"], dtype=np.float64), scale) for r in first]


def centroid_text(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 8, dims: int = 64, rounds: int = 10, seed: int = 3, scale: int = 1024) -> DataFrame:
    """Per kept vector: key, cluster, distance, cluster_inertia, inertia, centroid (decimal text of its components) and centroid_sha256."""
    field = vectors.schema[key]
    out = StructType([field, *StructType.fromDDL("cluster int, distance long")])
    with scratch(vectors.sparkSession) as kept:
        held = vectors.filter(usable(F.col(f"`{vector}`"), dims)).select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
        held = materialise(held, "vectors")
        kept.append(held)
        centroids = seeds(held, k, seed, scale)
        for _ in range(rounds if centroids else 0):
            found = totals(held, centroids, scale)
            centroids = [[s // n for s in sums] if n else c for c, (n, sums, _) in zip(centroids, found, strict=True)]
        found = totals(held, centroids, scale) if centroids else []

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in _blocks(batch, 1, dims):
                near, far, wide = distances(raw, centroids, scale)
                for i, d in wide.items():
                    far[i] = min(d, MAX_LONG)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raw)), pa.array(near), pa.array(far)], names=out.names)

    whole = min(MAX_LONG, sum(d for _, _, d in found))
    rows = [(j, min(MAX_LONG, d), whole, ",".join(map(str, c)), centroid_text(c)) for j, (c, (_, _, d)) in enumerate(zip(centroids, found, strict=True))]
    known = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid string, centroid_sha256 string")
    assigned = held.mapInArrow(assign, out)
    return assigned.join(F.broadcast(known), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
