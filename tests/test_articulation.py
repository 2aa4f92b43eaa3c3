"""Nodes that split a graph, against taking each one out."""

import random

import pytest

from terrane.operators import graph


def _parts(nodes, edges):
    left, n = set(nodes), 0
    near = {v: set() for v in nodes}
    for a, b in edges:
        if a in left and b in left:
            near[a].add(b)
            near[b].add(a)
    while left:
        n, todo = n + 1, [left.pop()]
        while todo:
            new = near[todo.pop()] & left
            left -= new
            todo += new
    return n


def _tables(spark, n, edges, labels=None):
    rows = [(v, (labels or {}).get(v, 0)) for v in range(n)]
    return spark.createDataFrame(rows, "id long, regime long"), spark.createDataFrame(edges, "i long, j long")


def _random(seed, n, m):
    draw = random.Random(seed)
    return [(draw.randrange(n), draw.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize(
    "n, edges",
    [
        (40, _random(1, 40, 45)),
        (60, _random(2, 60, 110)),
        (33, [(i, i + 1) for i in range(32)]),
        (20, [(0, i) for i in range(1, 20)]),
        (21, [(i, (i + 1) % 20) for i in range(20)] + [(3, 3), (1, 0), (0, 1)]),
    ],
    ids=["sparse", "dense", "path", "star", "ring, loop, repeats and a lone node"],
)
def test_points_are_those_whose_removal_splits(spark, n, edges):
    found = {r.node: r.splits for r in graph.articulation_points(*_tables(spark, n, edges)).collect()}
    whole = _parts(range(n), edges)
    near = {v: any(a != b and v in (a, b) for a, b in edges) for v in range(n)}
    assert found == {v: near[v] and _parts(set(range(n)) - {v}, edges) > whole for v in range(n)}


def test_critical_rows_of_whole_and_broken_regimes(spark):
    labels = {v: 0 if v < 8 else 1 if v < 14 else 2 if v < 18 else 3 for v in range(20)}
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 5)]  # one part
    edges += [(8, 9), (9, 10), (10, 11), (11, 12)]  # a path and a lone row
    edges += [(14, 15)]  # three parts
    edges += [(7, 8), (13, 14)]  # between regimes
    found = {r.id: r.critical for r in graph.critical_nodes(*_tables(spark, 20, edges, labels)).collect()}
    want = {}
    for v, g in labels.items():
        rest = {u for u in labels if labels[u] == g} - {v}
        want[v] = len(rest) > 1 and _parts(rest, edges) > 1
    assert found == want


def test_graphs_of_nothing(spark):
    nodes, edges = _tables(spark, 0, [])
    assert graph.articulation_points(nodes, edges).count() == 0
    nodes, edges = _tables(spark, 3, [])
    assert [r.splits for r in graph.articulation_points(nodes, edges).collect()] == [False] * 3


def test_long_tables_are_not_sent_to_all_tasks(spark):
    star = spark.range(1, graph.MANY + 2).selectExpr("0L AS i", "id AS j")
    found = graph.components(spark.range(graph.MANY + 2), star)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("root = 0").count() == graph.MANY + 2
