import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from tesela.llm.bisectors import MOST, Bisectors, cluster_vectors, wins

SHAPE = "vec_id long, embedding array<double>, label int, cluster string, distance string"


def brute(rows, dim, k, rounds=3, scale=64):
    """Nearest by distances, in fractions; rows: (key, vector or None)."""
    kept = [(key, [math.floor(scale * Fraction(x)) for x in v]) for key, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    best = lambda v: min(range(len(c)), key=lambda i: (far(v, c[i]), i))
    for _ in range(rounds if c else 0):
        groups = {}
        for _, v in kept:
            groups.setdefault(best(v), []).append(v)
        c = [[sum(x) // len(x) for x in zip(*groups[i], strict=True)] if i in groups else c[i] for i in range(len(c))]
    out = [(key, best(v), far(v, c[best(v)])) for key, v in kept] if c else []
    inertia = {i: sum(d for _, b, d in out if b == i) for i in range(len(c))}
    return sorted(
        ((key, b, min(MOST, d), min(MOST, inertia[b]), min(MOST, sum(inertia.values())), hashlib.sha256(",".join(map(str, c[b])).encode()).hexdigest()) for key, b, d in out),
        key=str,
    )


def check(spark, rows, dim, k):
    df = spark.createDataFrame([(key, v, 1, "x", "y") for key, v in rows], SHAPE).repartition(3)
    got = cluster_vectors(df, dim=dim, k=k)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, dim, k)


def test_random_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(3)
    # a coarse grid: many vectors lie on bisectors, many are equal
    rows = [(i, (rng.integers(-3, 4, 4) / 32).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, rows[9][1])]
    check(spark, rows, 4, 6)


def test_vectors_that_take_no_part(spark):
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [0.5, -0.5]), (9, [0.25, -1.0])]
    check(spark, rows, 2, 16)
    check(spark, rows[:7], 2, 16)
    check(spark, [], 2, 16)


@pytest.mark.parametrize("size", [1e9, 1e17, 1e60, 1.7e308])
def test_any_size(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * (size / 8 if i % 3 == 0 else 1)).tolist()) for i in range(60)]
    rows += [(100 + i, [size, -size, size / 3]) for i in range(3)]
    check(spark, rows, 3, 5)


def test_zero_favours_the_smaller_number():
    b = Bisectors([[0, 0], [2, 0], [0, 2], [0, 0]])
    assert wins(b, np.array([[1.0, 1.0], [1.0, 0.0], [0.0, 0.0], [2.0, 2.0], [3.0, 3.0]])).tolist() == [0, 0, 0, 1, 1]
    # one unit beside the bisector of centroids whose squares leave doubles
    n = 1 << 60
    assert wins(Bisectors([[0], [2 * n]]), np.array([[float(n)], [float(n + 512)]])).tolist() == [0, 1]
