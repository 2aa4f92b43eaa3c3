"""Instances in tasks of their own, growth over edges, and assignments."""

import itertools
import random
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane import simulate
from terrane.config import VARIANTS
from terrane.operators import partition


def test_nearly_every_instance_is_a_task(spark):
    rows = spark.createDataFrame([(f"s{k}", i) for k in range(9) for i in range(20)], "instance string, id long")
    edges = spark.createDataFrame([(0, 1)], "i long, j long")

    def run(instance, r, e):
        from pyspark import TaskContext

        return r.assign(task=TaskContext.get().partitionId())[["instance", "task"]].head(1)

    tasks = [r.task for r in partition._on_one(rows, edges, run, "instance string, task long").collect()]
    assert len(tasks) == 9 and len(set(tasks)) >= 8
    keys = spark.createDataFrame([(k,) for k in range(16)], "seed long")
    parts = partition.spread(keys, "seed").select(F.spark_partition_id().alias("p")).collect()
    assert len({r.p for r in parts}) >= 14


def test_replicates_are_spread(spark):
    plan = simulate.monte_carlo(spark, [("a", 1.0, 0.1)], range(16))._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan


def queue(seeds, near, n):
    label, line = dict.fromkeys(range(n), None), sorted(seeds, key=lambda i: seeds[i])
    label |= seeds
    for i in line:
        for j in sorted(near[i]):
            if label[j] is None:
                label[j] = label[i]
                line.append(j)
    return label


def test_growth_is_that_of_a_queue(spark):
    for seed, n, more in ((1, 60, 40), (2, 90, 5), (3, 40, 300)):
        rng = random.Random(seed)
        pairs = {(rng.randrange(k), k) for k in range(1, n)} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(more)}
        near = {k: {b for a, b in pairs if a == k} | {a for a, b in pairs if b == k} for k in range(n)}
        seeds = {i: g for g, i in enumerate(rng.sample(range(n), 4))}
        frames = spark.createDataFrame([("x", i, g) for i, g in seeds.items()], "instance string, id long, regime long"), spark.createDataFrame(list(pairs), "i long, j long"), spark.range(n)
        got = {r.id: r.regime for r in partition.breadth_first(*frames).collect()}
        assert got == queue(seeds, near, n)


def test_growth_through_pieces_is_that_of_a_queue(spark, monkeypatch):
    monkeypatch.setattr(partition, "PIECE", 40)
    rng, n = random.Random(9), 120
    pairs = {(max(0, k - rng.randrange(1, 4)), k) for k in range(1, n)} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(8)}
    near = {k: {b for a, b in pairs if a == k} | {a for a, b in pairs if b == k} for k in range(n)}
    seeds = {0: 7, 50: 3, 90: 5, 119: 4}
    frames = spark.createDataFrame([(x, i, g) for x in "ab" for i, g in seeds.items()], "instance string, id long, regime long"), spark.createDataFrame(list(pairs), "i long, j long"), spark.range(n)
    got = {(r.instance, r.id): r.regime for r in partition.breadth_first(*frames).collect()}
    assert got == {(x, i): g for x in "ab" for i, g in queue(seeds, near, n).items()}


def test_growth_along_a_path_takes_few_tables(spark, monkeypatch):
    made, kept = [], partition.kept
    monkeypatch.setattr(partition, "kept", lambda df: made.append(1) or kept(df))
    seeds = spark.createDataFrame([("x", 0, 2), ("x", 299, 1)], "instance string, id long, regime long")
    got = {r.id: r.regime for r in partition.breadth_first(seeds, spark.range(299).selectExpr("id AS i", "id + 1 AS j"), spark.range(300)).collect()}
    assert got == {i: 2 if i < 150 else 1 for i in range(300)}
    assert len(made) < 20


def test_a_node_out_of_reach_is_an_error(spark):
    seeds, edges = spark.createDataFrame([("x", 0, 1)], "instance string, id long, regime long"), spark.createDataFrame([(0, 1)], "i long, j long")
    with pytest.raises(Exception, match="can't be reached"):
        partition.breadth_first(seeds, edges, spark.range(3)).collect()


def test_assignments_are_the_best_there_are():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (2, 2), (3, 5), (6, 6), (5, 7)):
        for _ in range(20):
            gain = rng.integers(0, 6, (n, m))
            best = max(sum(gain[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))
            found = partition._assigned(gain)
            assert len(set(found.tolist())) == n and gain[np.arange(n), found].sum() == best
    began = time.perf_counter()
    assert sorted(partition._assigned(rng.integers(0, 10**6, (60, 60))).tolist()) == list(range(60)) and time.perf_counter() - began < 1


def test_labels_are_matched_by_rows_of_counts(spark):
    rows = [(0, 5, 10), (0, 6, 1), (1, 5, 11), (1, 6, 9), (2, 7, 1)]
    got = {r.pred: r.true for r in partition.best_match(spark.createDataFrame(rows, "pred long, true long, n long")).collect()}
    assert got == {0: 5, 1: 6, 2: 7}


def test_sums_that_follow_moves_give_the_errors_of_whole_refits():
    draw = np.random.default_rng(5)
    xy = np.array([(a, b) for a in range(9) for b in range(9)], float)
    edges = np.array([(i, j) for i in range(81) for j in range(i + 1, 81) if abs(xy[i] - xy[j]).max() <= 1])
    x = np.column_stack([np.ones(81), draw.normal(size=(81, 2))])
    one = partition.Instance(x, draw.normal(size=81), xy, edges, replace(VARIANTS["county"], bandwidth=None, full_rank=True))
    labels = np.repeat([4, 1, 7], 27)
    sums, whole = partition.Sums(one, labels), {}
    for _ in range(60):
        i = int(draw.integers(81))
        for g in (1, 4, 7):
            assert np.isclose(one.error(i, g, labels, sums), one.error(i, g, labels), rtol=1e-9)
        assert one.may_leave(i, labels, whole) == one.may_leave(i, labels)
        own, to = int(labels[i]), int(draw.choice(labels[one.near[i]]))
        if to != own and (labels == own).sum() > 12:
            labels[i] = to
            sums.move(i, own, to)
            whole = {}
