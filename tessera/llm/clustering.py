"""Exact k-means with geometric drift tightening.

Each vector carries an upper bound of the distance to its centroid and a lower bound of the distance to any other. When
centroids move, the upper bound grows by its own centroid's drift. The lower bound is loosened by less than the largest
drift: the members of cluster i lie in a sphere around their old centroid, and how much nearer a centroid that moves from
c to c' can come to any point of that sphere is bounded in the plane through c, c' and the sphere's centre. |x - c| - |x -
c'| is at most |c - c'| cos(phi), where phi is the angle between x and c' seen from the middle of c and c' (level sets are
hyperbolas, which lie inside the cones of their asymptotes); over a sphere that doesn't hold that middle, phi is at
least the angle of the centre less the half-angle of the sphere. A vector whose upper bound stays below its lower bound,
or below half the way from its centroid to the next one, keeps its cluster unseen; the others are compared with all
centroids in integers. Bounds are rounded outwards, so they decide nothing that the integers would decide otherwise.

A round is one pass over a table of vectors with their bounds, written for the next round, and one aggregate of k rows of
counts, sums and radii. Nothing is shuffled but these partial sums; the driver holds k centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

K, ROUNDS, DIMENSIONS, SCALE = 8, 10, 64, 1024
#: Components are kept below this bound, so that squared distances of up to 64 of them fit in 64 bits.
LARGEST = 1 << 27
#: Rounding of the bounds, each outwards: of one step, and of a cosine.
STEP, COSINE = 1e-9, 1e-6
#: Vectors that are compared with a centroid at once.
ROWS = 4096


def usable(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE
) -> DataFrame:
    """(vec_id, x): vectors of the right size without nulls and infinities, each component as floor(scale * component)."""
    v, whole = F.col(vector), lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))
    right = (F.size(v) == dimensions) & F.forall(
        v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < LARGEST / scale)
    )
    x = F.when(right, F.transform(v, lambda e: whole(e).cast("int")))
    return vectors.select(F.col(vec_id).alias("vec_id"), x.alias("x")).where("x is not null")


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How much less far another centroid can be, at most, from a member of each cluster after the move from old to new.

    ``radius``: of a sphere around each old centroid that holds its members.
    """
    step = new - old
    drift = np.sqrt((step**2).sum(1))
    middle = (old + new) / 2
    out = np.zeros(len(old))
    for i in range(len(old)):
        for j in np.flatnonzero(drift > 0):
            if i == j:
                continue
            to = old[i] - middle[j]
            far = np.sqrt((to**2).sum())
            share = 1.0
            if far > radius[i]:
                cos_phi = np.clip(to @ step[j] / (far * drift[j]), -1.0, 1.0)
                sin_half = radius[i] / far
                cos_half = np.sqrt(1 - sin_half**2)
                if cos_phi < cos_half:
                    share = min(1.0, max(0.0, cos_phi * cos_half + np.sqrt(1 - cos_phi**2) * sin_half) + COSINE)
            out[i] = max(out[i], share * drift[j] * (1 + STEP))
    return out


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows from one centroid, or from one each."""
    d = x - c
    return (d * d).sum(1)


def _assign(old: np.ndarray | None, new: np.ndarray, radius: np.ndarray, last: bool):
    """Batches (vec_id, x, cluster, upper, lower, ...) after the move of the centroids; ``last``: with exact distances."""
    k, size = new.shape
    if old is not None:
        a, b = old.astype(np.float64), new.astype(np.float64)
        drift = np.sqrt(((b - a) ** 2).sum(1)) * (1 + STEP)
        loose = loosening(a, b, radius)
    between = np.sqrt(((new[:, None].astype(np.float64) - new[None]) ** 2).sum(2)) + np.diag(np.full(k, np.inf))
    half = between.min(1) / 2 * (1 - STEP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, size)
            if old is None:
                cluster, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
            else:
                cluster, upper, lower = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (2, 3, 4))
                cluster = cluster.astype(np.int64)
                upper = (upper + drift[cluster]) * (1 + STEP)
                lower = lower - loose[cluster] - STEP * (lower + loose[cluster])
            enough = np.maximum(lower, half[cluster])
            doubtful = np.flatnonzero(~(upper < enough))
            upper[doubtful] = np.sqrt(_squared(x[doubtful], new[cluster[doubtful]]).astype(np.float64)) * (1 + STEP)
            doubtful = doubtful[~(upper[doubtful] < enough[doubtful])]
            scanned = np.zeros(len(x), bool)
            scanned[doubtful] = True
            for start in range(0, len(doubtful), ROWS):
                at = doubtful[start : start + ROWS]
                every = np.stack([_squared(x[at], c) for c in new], axis=1)
                best = every.argmin(1)  # the first of equal ones
                nearest = every[np.arange(len(at)), best]
                every[np.arange(len(at)), best] = np.iinfo(np.int64).max
                cluster[at], upper[at] = best, np.sqrt(nearest.astype(np.float64)) * (1 + STEP)
                lower[at] = np.sqrt(every.min(1).astype(np.float64)) * (1 - STEP)
            distance = pa.array(_squared(x, new[cluster])) if last else pa.nulls(len(x), pa.int64())
            columns = [*batch.columns[:2], pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scanned), distance]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "cluster", "upper", "lower", "scanned", "distance"])

    return run


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hash of ``seed`` and id, equal ones by their components; null ids come last."""
    draw = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = rows.select(draw.alias("draw"), "x").orderBy(F.asc_nulls_last("draw"), "x").limit(k).collect()
    return np.array([r["x"] for r in first], np.int64)


def kmeans(
    vectors: DataFrame,
    *,
    k: int = K,
    rounds: int = ROUNDS,
    seed: str = "3:",
    vec_id: str = "vec_id",
    vector: str = "embedding",
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray, list[float]]:
    """(vec_id, cluster, distance; final centroids; share of vectors that each pass compared with all centroids)."""
    scratch = Scratch(vectors.sparkSession)
    rows = usable(vectors, vec_id=vec_id, vector=vector, dimensions=dimensions, scale=scale)
    kind = dict(vectors.dtypes)[vec_id]
    schema = f"vec_id {kind}, x array<int>, cluster int, upper double, lower double, scanned boolean, distance long"
    now = scratch.save(rows, "vectors")
    new = first_centroids(now, k, seed)
    if not len(new):
        return now.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), new, []
    old, radius, scans = None, np.zeros(len(new)), []
    sums = [F.sum(F.get("x", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dimensions)]
    for turn in range(rounds + 1):
        moved = scratch.save(now.mapInArrow(_assign(old, new, radius, turn == rounds), schema), "assigned")
        scratch.drop(now)
        now = moved
        # k rows: sizes, radii, sums.
        totals = now.groupBy("cluster").agg(F.count("*").alias("n"), F.max("upper").alias("radius"), F.count_if("scanned").alias("scans"), *sums)
        totals = totals.collect()
        scans.append(sum(r["scans"] for r in totals) / sum(r["n"] for r in totals))
        if turn == rounds:
            break
        old, new, radius = new, new.copy(), np.zeros(len(new))
        for r in totals:
            new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dimensions)]
            radius[r["cluster"]] = r["radius"]
    return now.select("vec_id", "cluster", "distance"), new, scans


def cluster_vectors(vectors: DataFrame, **options) -> DataFrame:
    """One row a kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Options are those of ``kmeans``. Components become floor(scale * component). Centroids start as the vectors with the
    smallest hashes of seed and id. A round assigns each vector to the nearest centroid (ties: the smaller number) and
    moves each centroid that has vectors to the floor of their mean; after the last round vectors are assigned once more.

    Vectors of another size, with a null or an infinite component, or with one of 2^27 or more after scaling (distances
    would not fit in 64 bits) have no row. Fewer vectors than k give as many clusters. A null vec_id is kept, but starts a
    cluster only where ids are too few. Repeated rows count each. An empty table gives an empty table. Other columns play no part.
    """
    found, centroids, _ = kmeans(vectors, **options)
    sizes = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    total = sum(r["cluster_inertia"] for r in sizes)
    names = {i: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for i, c in enumerate(centroids.tolist())}
    table = [(r["cluster"], r["cluster_inertia"], total, names[r["cluster"]]) for r in sizes]
    table = found.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
