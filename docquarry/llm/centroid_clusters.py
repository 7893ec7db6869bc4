"""Clusters around moving centroids, found by a table of pivot distances.

The integer vectors are written once with their distances to a few fixed pivots.  By the triangle
inequality the difference of two pivot distances bounds the distance of a vector to a centroid
from below, so each round compares a vector in full only with centroids whose bound doesn't
exceed the best distance so far.  Bounds are in floating point, with room for rounding; all
distances that decide are exact integers.  A round is one narrow pass over the written table and
returns sums of a few rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docquarry.session import cut_lineage

#: Fixed pivots, chosen among this many vectors.  Both change the work, not the result.
PIVOTS = 16
PIVOT_SAMPLE = 512
#: Components beyond this would make squared distances exceed 64 bits.
LARGEST = 1 << 27


def integer_vectors(vectors: DataFrame, vec_id: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, q): whole vectors without null or non-finite components, as floor(scale * x)."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    whole = vectors.where((F.size(x) == dimensions) & F.forall(x, finite))
    part = lambda v: F.when(F.abs(v * scale) <= LARGEST, F.floor(v * scale).cast("int")).otherwise(
        F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}: its squared distance doesn't fit 64 bits"))
    )
    return whole.select(F.col(f"`{vec_id}`").alias("vec_id"), F.transform(x, part).alias("q"))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one vector, or row by row."""
    difference = left - right
    return np.einsum("ij,ij->i", difference, difference)


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it."""
    chosen, nearest = [0], squared(sample, sample[0])
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(sample, sample[chosen[-1]]))
    return sample[chosen]


def pivot_distances(q: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(q, p) for p in pivots], 1).astype(float))


def assign(q: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number) and squared distance of each row; how many were compared."""
    bound = np.zeros((len(q), len(centroids)))
    for p in range(between.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - between[None, :, p]), out=bound)
    slack = 1e-9 + 1e-12 * (to_pivots.max(1, initial=0) + between.max(initial=0))
    bound = np.maximum(bound - slack[:, None], 0) ** 2 * (1 - 1e-12)
    first = bound.argmin(1)
    cluster, best, compared = first.copy(), squared(q, centroids[first]), len(q)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
        compared += len(rows)
        distance = squared(q[rows], centroids[c])
        better = (distance < best[rows]) | ((distance == best[rows]) & (c < cluster[rows]))
        cluster[rows[better]], best[rows[better]] = c, distance[better]
    return cluster, best, compared


def centroid_clusters(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    clusters: int = 16,
    rounds: int = 3,
    dimensions: int = 64,
    scale: int = 64,
    seed: str = "1",
) -> DataFrame:
    """One row per kept vector: ``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Kept are vectors of ``dimensions`` components, none null or non-finite, as floor(scale * x).
    The first centroids are the vectors with the smallest sha256 of ``<seed>:<vec_id>`` (a null id
    comes last, equal hashes by components), all of them where there are fewer than ``clusters``.
    Each round assigns every vector and moves non-empty centroids to the componentwise floor of
    the mean; then vectors are assigned once more.  Rows that repeat an id are vectors of their
    own.  Further columns are ignored; without kept vectors the result is empty.  A component
    whose squared distance can't fit 64 bits is an error, since no row could report it.
    """
    spark = vectors.sparkSession
    whole = integer_vectors(vectors, vec_id, vector, dimensions, scale)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    take = max(clusters, PIVOT_SAMPLE)
    sample = whole.withColumn("name", name).orderBy(F.col("name").asc_nulls_last(), "q").select("q").limit(take).collect()
    sample = np.array([r["q"] for r in sample], np.int64).reshape(len(sample), dimensions)
    centroids = sample[:clusters]
    if not len(centroids):
        kinds = [("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")]
        return whole.where(F.lit(False)).select(F.col("vec_id").alias(vec_id), *[F.lit(None).cast(k).alias(n) for n, k in kinds])
    pivots = spread_pivots(sample[:PIVOT_SAMPLE], PIVOTS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = pivot_distances(_matrix(batch.column("q"), np.int64), pivots)
                offsets = np.arange(len(near) + 1, dtype=np.int32) * len(pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, near.ravel())], ["vec_id", "q", "near"])

    kind = whole.schema["vec_id"].dataType.simpleString()
    stored = cut_lineage(whole.mapInArrow(measure, f"vec_id {kind}, q array<int>, near array<double>"), "pivot-table")
    for _ in range(rounds):
        centroids = _moved(stored, centroids, pivots)

    fixed = centroids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = pivot_distances(fixed, pivots)
        for batch in batches:
            cluster, distance, _ = assign(_matrix(batch.column("q"), np.int64), _matrix(batch.column("near"), float), fixed, between)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    placed = cut_lineage(stored.mapInArrow(place, f"vec_id {kind}, cluster int, distance long"), "clusters")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total = int(sum(r["s"] for r in sums))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    found = spark.createDataFrame(
        [(r["cluster"], int(r["s"]), total, digest[r["cluster"]]) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return placed.join(F.broadcast(found), "cluster").select(  # a row a cluster
        F.col("vec_id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _moved(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = pivot_distances(centroids, pivots)
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            q = _matrix(batch.column("q"), np.int64)
            cluster, _, _ = assign(q, _matrix(batch.column("near"), float), centroids, between)
            for c in range(len(centroids)):
                members = q[cluster == c]
                sums[c] += members.sum(0)
                counts[c] += len(members)
        offsets = np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(counts), pa.ListArray.from_arrays(offsets, sums.ravel())], ["cluster", "n", "sums"])

    partial = stored.mapInArrow(gather, T._parse_datatype_string("cluster int, n long, sums array<long>"))
    totals = (
        partial.where("n > 0").select("cluster", "n", F.posexplode("sums").alias("place", "s"))
        .groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        .collect()  # clusters x dimensions rows
    )
    out = centroids.copy()
    for r in totals:
        out[r["cluster"], r["place"]] = int(r["s"]) // r["n"]
    return out
