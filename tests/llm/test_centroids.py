"""Centroid clustering against whole numbers of Python, and vectors that take no part."""

import hashlib
import math
import random

import numpy as np
import pytest

from terrane.llm.centroids import clustered, nearest, numbers_of, planes_of, products, squares

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def plain(rows, clusters, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()))
    centres = [v for _, v in order[:clusters]]
    near = lambda v: min((far(v, c), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        labels = [near(v)[1] for _, v in kept]
        for k in range(len(centres)):
            own = [v for (_, v), label in zip(kept, labels) if label == k]
            if own:
                centres[k] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    total = {k: sum(d for _, label, d in out if label == k) for k in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, k, d, total[k], sum(total.values()), sha[k]) for i, k, d in out), key=str)


def test_planes_give_exact_products():
    rng = np.random.default_rng(3)
    v, c = rng.integers(-900, 900, (50, 64)), rng.integers(-(1 << 20), 1 << 20, (7, 64))
    a, b = planes_of(v), planes_of(c)
    assert (numbers_of(a) == v).all() and (numbers_of(b) == c).all()
    assert (products(a, b) == v @ c.T).all() and (squares(a) == (v * v).sum(1)).all()
    label, gap = nearest(a, squares(a), b, squares(b))
    d = ((v[:, None] - c[None]) ** 2).sum(2)
    assert (label == d.argmin(1)).all() and (gap == d.min(1)).all()


@pytest.mark.parametrize("size", [1.0, 3e4, 3e5])  # the last takes more planes than are safe in 64 bits
def test_clusters_match_whole_numbers(spark, size):
    draw = random.Random(int(size))
    rows = [(i, [draw.gauss(i % 5, 0.3) * size for _ in range(64)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(20)] + [(7, rows[7][1]), (None, [0.1] * 64)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [1.0] * 63 + [None]), (205, [1.0] * 63 + [math.nan]), (206, [1.0] * 63 + [math.inf])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    for clusters, rounds in ((6, 3), (200, 1)):
        got = sorted((tuple(r) for r in clustered(df, clusters, rounds).collect()), key=str)
        assert got == plain(rows, clusters, rounds)


def test_nothing_to_cluster(spark):
    assert clustered(spark.createDataFrame([], SCHEMA)).count() == 0
    assert clustered(spark.createDataFrame([(1, None, "x")], SCHEMA)).count() == 0


def test_equal_vectors_are_one_cluster(spark):
    got = clustered(spark.createDataFrame([(i, [0.5] * 64, "") for i in range(50)], SCHEMA)).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 50
