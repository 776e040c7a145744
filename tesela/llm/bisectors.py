"""Lloyd's clustering with a tournament of bisectors.

Between two centroids a and b lies a hyperplane of integers: x is nearer to b where 2 (b - a) x > |b|^2 - |a|^2.  Normals and thresholds of
all pairs are computed once a round.  A vector then takes k - 1 linear sign tests: the winner so far meets the next centroid, and at zero,
where both are equally near, the smaller number stays.  Only the distance to the last winner is formed, exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import stash

#: Vectors whose tests are done at once.
ROWS = 2048
#: Sums leave a task in signed digits of so many bits, so that Spark adds numbers of any size in longs.
DIGIT = 30
#: The greatest long; a larger distance or sum is returned as it.
MOST = (1 << 63) - 1


@dataclass
class Bisectors:
    """Centroids as Python integers, and for each pair i < j the normal and threshold of its bisector; doubles of them beside."""

    centroids: list[list[int]]

    def __post_init__(self):
        c = self.centroids
        self.pairs = {(i, j): ([2 * (b - a) for a, b in zip(c[i], c[j], strict=True)], sum(b * b for b in c[j]) - sum(a * a for a in c[i])) for j in range(len(c)) for i in range(j)}
        k, d = len(c), len(c[0]) if c else 0
        self.normals, self.thresholds = np.zeros((k, k, d)), np.zeros((k, k))
        for (i, j), (normal, threshold) in self.pairs.items():
            self.normals[i, j], self.thresholds[i, j] = [_double(x) for x in normal], _double(threshold)


def _double(x: int) -> float:
    """The nearest double; infinite where there is none."""
    try:
        return float(x)
    except OverflowError:
        return math.inf if x > 0 else -math.inf


def _whole(x: float, scale: int) -> int:
    """floor(scale * x) of a finite double and a whole scale, whatever its size."""
    return scale * int(x) if x.is_integer() else math.floor(scale * x)


def wins(b: Bisectors, x: np.ndarray) -> np.ndarray:
    """The number of each vector's nearest centroid, ties to the smaller number; x: whole numbers as doubles.

    A test's sign is taken from doubles where their error bound allows it, which is always so below 2**53; else the test is repeated in
    integers.
    """
    best = np.zeros(len(x), np.int64)
    unit = (x.shape[1] + 4) * 2.0**-52
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(1, len(b.centroids)):
            normal, threshold = b.normals[best, j], b.thresholds[best, j]
            side = np.einsum("nd,nd->n", normal, x) - threshold
            size = np.einsum("nd,nd->n", np.abs(normal), np.abs(x)) + np.abs(threshold)
            later = side > 0
            for i in np.flatnonzero(~((size < 2.0**53) | (np.abs(side) > unit * size))):
                exact, bound = b.pairs[int(best[i]), j]
                later[i] = sum(n * int(v) for n, v in zip(exact, x[i], strict=True)) > bound
            best[later] = j
    return best


def _slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column("key"), part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles.  From 2**52 on a double is whole, and scaling by a power of two keeps that; infinite if it overflows."""
    with np.errstate(over="ignore"):
        return np.floor(x * scale)


def _wins(b: Bisectors, x: np.ndarray, scale: int) -> np.ndarray:
    """wins() of components before scaling; rows that scaling takes out of the doubles are told apart in integers."""
    y = _scaled(x, scale)
    fine = np.isfinite(y).all(1)
    best = np.zeros(len(x), np.int64)
    best[fine] = wins(b, y[fine])
    for i in np.flatnonzero(~fine):
        v = [_whole(float(u), scale) for u in x[i]]
        best[i] = min(range(len(b.centroids)), key=lambda c: (sum((p - q) ** 2 for p, q in zip(v, b.centroids[c], strict=True)), c))
    return best


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of an integer in base 2**DIGIT, all digits with its sign; zeros are left out."""
    sign, rest, place = (1 if value >= 0 else -1), abs(value), 0
    while rest:
        if rest & ((1 << DIGIT) - 1):
            yield place, sign * (rest & ((1 << DIGIT) - 1))
        rest, place = rest >> DIGIT, place + 1


def _sums(b: Bisectors, dim: int, scale: int):
    """(cluster, at, place, part): a task's sums of each cluster's components as digits; at -1: its number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(b.centroids)
        counts, sums = [0] * k, [[0] * dim for _ in range(k)]
        for _, x in _slices(batches, dim):
            best, y = _wins(b, x, scale), _scaled(x, scale)
            small = np.abs(y).max(1, initial=0.0) < 2.0**40  # sums of ROWS of them stay exact in doubles
            for c in np.unique(best).tolist():
                mine = best == c
                counts[c] += int(mine.sum())
                some = y[mine & small].sum(0)
                sums[c] = [s + int(v) for s, v in zip(sums[c], some, strict=True)]
                for row in x[mine & ~small].tolist():
                    sums[c] = [s + _whole(v, scale) for s, v in zip(sums[c], row, strict=True)]
        out = [(c, at, place, part) for c in range(k) if counts[c] for at, total in [(-1, counts[c]), *enumerate(sums[c])] for place, part in _digits(total)]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "at", "place", "part"])

    return run


def _assign(b: Bisectors, dim: int, scale: int):
    """(key, cluster, distance) with the exact squared distance to the winner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.array([[_double(v) for v in c] for c in b.centroids]).reshape(-1, dim)
        for key, x in _slices(batches, dim):
            best = _wins(b, x, scale)
            with np.errstate(over="ignore", invalid="ignore"):
                apart = _scaled(x, scale) - held[best]
                square = (apart**2).sum(1)
            near = np.abs(held[best]).max(1, initial=0.0) < 2.0**52
            far = [int(s) if n and s < 2.0**53 else None for s, n in zip(square.tolist(), near.tolist(), strict=True)]
            for i in (i for i, s in enumerate(far) if s is None):
                far[i] = min(MOST, sum((_whole(v, scale) - c) ** 2 for v, c in zip(x[i].tolist(), b.centroids[int(best[i])], strict=True)))
            yield pa.RecordBatch.from_arrays([key, pa.array(best, pa.int32()), pa.array(far, pa.int64())], names=["key", "cluster", "distance"])

    return run


def kept_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = 64) -> DataFrame:
    """(key long, v array<double>) of the vectors with exactly dim components, none of them null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.filter(F.coalesce((F.size(vector) == dim) & fine, F.lit(False)))
    return rows.select(F.col(key).cast("long").alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:key`, ties by components, as integers; rows without a key are none of them."""
    named = vectors.filter(F.col("key").isNotNull()).withColumn("_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256))
    return [[_whole(x, scale) for x in r["v"]] for r in named.orderBy("_hash", "v").limit(k).select("v").collect()]


def next_centroids(vectors: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Each cluster's componentwise floor(sum / count); empty clusters keep their centroid."""
    dim = len(centroids[0])
    parts = vectors.mapInArrow(_sums(Bisectors(centroids), dim, scale), "cluster int, at int, place int, part long")
    totals = [[0] * (dim + 1) for _ in centroids]
    for r in parts.groupBy("cluster", "at", "place").agg(F.sum("part").alias("part")).collect():
        totals[r["cluster"]][r["at"] + 1] += r["part"] << (DIGIT * r["place"])
    return [[s // t[0] for s in t[1:]] if t[0] else c for c, t in zip(centroids, totals, strict=True)]


def cluster_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> DataFrame:
    """(key, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string), a row for each vector that takes part.

    Components become integers floor(scale * x), of any size (scale: a power of two).  Vectors that are null, of another dimension, or hold
    null or non-finite components take no part.  Rows that share a key are vectors of their own, and so are rows without one, which are no
    first centroids.  Fewer than k keyed vectors give as many clusters as there are; none give no rows.  Equal distances go to the smaller
    number.  Distances and sums beyond 64 bits are returned as the greatest long.  Other columns are not looked at.

    Rounds read the vectors where they lie; a task returns k * dim sums, whatever it reads, and the driver holds the k centroids.
    """
    vectors = kept_vectors(df, key, vector, dim)
    centroids = first_centroids(vectors, k, seed, scale)
    shape = f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return df.sparkSession.createDataFrame([], shape)
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids, scale)
    assigned = stash(vectors.mapInArrow(_assign(Bisectors(centroids), dim, scale), "key long, cluster int, distance long"))
    # at most k rows
    totals = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    named = [(c, min(MOST, totals.get(c, 0)), min(MOST, sum(totals.values())), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    told = df.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.withColumnRenamed("key", key).join(F.broadcast(told), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
