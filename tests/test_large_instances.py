"""Steps whose memory and work follow the rows, not their pairs."""

import time
import tracemalloc
from dataclasses import replace

import numpy as np

from terrane.config import VARIANTS
from terrane.operators import partition


def strip(n, seed=3):
    """A lattice of 25 columns with three regimes, the third of them in bands: terms, response, places, edges, labels that are off."""
    draw, ids = np.random.default_rng(seed), np.arange(n)
    px, py = ids % 25, ids // 25
    x = np.column_stack([np.ones(n), draw.normal(size=n)])
    true = np.where(px < 11, 1, np.where(py % 20 >= 10, 2, 3))
    y = 1 + np.array([0, 2, -1, 0.5])[true] * x[:, 1] + 0.3 * draw.normal(size=n)
    steps = ((1, 0), (0, 1), (1, 1), (-1, 1))
    edges = np.concatenate([np.stack([ids[ok], ids[ok] + a + 25 * b], 1) for a, b in steps for ok in [(px + a >= 0) & (px + a < 25) & (ids + a + 25 * b < n)]])
    return x, y, np.stack([px, py], 1).astype(float), edges, np.where(px < 13, 1, np.where((py + 2) % 20 >= 10, 2, 3))


def test_a_refinement_holds_no_table_of_pairs():
    n = 5000
    x, y, xy, edges, labels = strip(n)
    tracemalloc.start()
    path, history, moves, _ = partition.Instance(x, y, xy, edges, replace(VARIANTS["monte_carlo"], sweeps=1)).refine(labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert moves and history[1]["objective"] < history[0]["objective"]
    assert peak < n * n * 8 / 4  # a table of distances alone takes four times as much


def test_fits_and_errors_are_those_over_all_rows():
    x, y, xy, edges, labels = strip(300)
    for how in (VARIANTS["county"], replace(VARIANTS["county"], bandwidth=20), replace(VARIANTS["county"], bandwidth=4.0), replace(VARIANTS["county"], bandwidth=5.0, kernel="gaussian")):
        one, draw = partition.Instance(x, y, xy, edges, how), np.random.default_rng(1)
        beta, resid, hat = one.fit(labels)
        for i in draw.integers(0, 300, 25).tolist():
            rows = np.flatnonzero(labels == labels[i])
            w = partition.weights(np.sqrt(((xy[rows] - xy[i]) ** 2).sum(1)), how.bandwidth, how.kernel)
            m = (x[rows] * w[:, None]).T @ x[rows]
            assert np.allclose(beta[i], np.linalg.solve(m, (x[rows] * w[:, None]).T @ y[rows]), rtol=1e-9)
            assert np.isclose(hat[i], x[i] @ np.linalg.solve(m, x[i]) * w[rows == i][0], rtol=1e-9) and np.isclose(resid[i], y[i] - x[i] @ beta[i])
            other = rows[rows != i]
            w = partition.weights(np.sqrt(((xy[other] - xy[i]) ** 2).sum(1)), how.bandwidth, how.kernel)
            b = np.linalg.solve((x[other] * w[:, None]).T @ x[other], (x[other] * w[:, None]).T @ y[other])
            assert np.isclose(one.error(i, int(labels[i]), labels), (y[i] - x[i] @ b) ** 2, rtol=1e-6)


def test_a_row_may_leave_where_the_rest_hangs_together():
    x, y, xy, edges, labels = strip(250)
    one, draw = partition.Instance(x, y, xy, edges, VARIANTS["county"]), np.random.default_rng(2)
    for _ in range(40):
        labels, whole = np.where(draw.random(250) < 0.45, 2, 1), {}
        labels[:75] = 3
        for i in range(250):
            assert one.may_leave(i, labels, whole) == one.may_leave(i, labels)


def test_a_tree_that_is_a_chain_is_cut_at_once():
    n = 20_000
    tree = [(0, 1, 0.0), *((n + k - 2, k, 0.0) for k in range(2, n))]  # each merge adds one row to the cluster before
    began = time.perf_counter()
    assert partition.cut_tree(n, tree, 3).tolist() == [0] * (n - 2) + [1, 2]
    assert time.perf_counter() - began < 2  # row by row up the chain, 200 million steps


def test_a_hub_with_many_neighbours_merges_them_by_cost():
    n = 400
    edges = np.array([(0, k) for k in range(1, n)])
    tree = partition.merge_tree(np.arange(n, dtype=float)[:, None] ** 2, edges)
    assert [b for _, b, _ in tree[:1]] == [1] and len(tree) == n - 1 and all(a < n + k and b < n + k for k, (a, b, _) in enumerate(tree))


def test_fits_after_moves_are_those_of_a_new_instance():
    x, y, xy, edges, labels = strip(1500)
    how, draw = replace(VARIANTS["county"], bandwidth=30), np.random.default_rng(5)
    one, labels = partition.Instance(x, y, xy, edges, how), np.where(np.arange(1500) < 28, 9, labels)  # a regime of fewer rows than the bandwidth too
    for _ in range(4):
        got, want = one.fit(labels), partition.Instance(x, y, xy, edges, how).fit(labels)
        assert all(np.allclose(a, b, rtol=1e-9) for a, b in zip(got, want))
        for i in draw.integers(0, 1500, 30).tolist():  # the loop over single rows
            rows, w = one.weighing(i, labels[i], labels, int((labels == labels[i]).sum()), False)
            m = (x[rows] * w[:, None]).T @ x[rows]
            assert np.allclose(got[0][i], np.linalg.solve(m, (x[rows] * w[:, None]).T @ y[rows]), rtol=1e-9)
        labels = labels.copy()
        moved = draw.integers(0, 1500, 40)
        labels[moved] = draw.choice([1, 2, 3, 9], 40)


def test_rows_whose_neighbours_are_of_their_regime_are_not_weighed(monkeypatch):
    x, y, xy, edges, labels = strip(2500)
    asked, one = [], partition.Instance.may_leave
    monkeypatch.setattr(partition.Instance, "may_leave", lambda self, i, *a: asked.append(i) or one(self, i, *a))
    whole = partition.Instance(x, y, xy, edges, VARIANTS["county"])
    whole.sweep(labels, 1)
    assert len(asked) < 1000
    got, moves = whole.sweep(labels, 1)
    monkeypatch.setattr(partition.Instance, "beside_others", lambda self, z: Every())  # every row is looked at

    class Every(list):
        __getitem__, __setitem__ = lambda self, i: True, lambda self, i, v: None

    asked.clear()
    want, every = whole.sweep(labels, 1)
    assert len(asked) == 2500 and (got == want).all() and moves == every
