"""Regimes from features and a graph, and their refinement.

Both are sequential by definition: each merge, and each move, sees the one
before. One instance (a graph, its features or observations, a setting) is
therefore one task; instances are dealt to many more partitions than there are, so that nearly each has a
task of its own. An instance is a lattice or a map of areas, not the corpus. Growth over edges from seeds goes through pieces of a graph.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Refinement
from ..functions.linalg import solve
from ..tables import dropped, kept
from .graph import both_ways
from .local import SMALL, _hull


def neighbour_lists(n: int, edges: np.ndarray) -> list[np.ndarray]:
    near: list[set[int]] = [set() for _ in range(n)]
    for a, b in edges:
        near[a].add(int(b))
        near[b].add(int(a))
    return [np.array(sorted(s), dtype=int) for s in near]


def merge_tree(features: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, cost) down to one cluster; the k-th makes cluster n + k. Only clusters that touch merge, the pair that adds
    least to the sum of squares first, ties to smaller numbers; if none touch, the cheapest pair does."""
    n = len(features)
    size, centre = dict.fromkeys(range(n), 1), {i: features[i].astype(float) for i in range(n)}
    near = {i: set(map(int, a)) for i, a in enumerate(neighbour_lists(n, edges))}
    cost = lambda a, b: size[a] * size[b] / (size[a] + size[b]) * float(((centre[a] - centre[b]) ** 2).sum())
    heap = [(cost(a, b), a, b) for a in range(n) for b in near[a] if a < b]
    heapq.heapify(heap)
    out: list[tuple[int, int, float]] = []
    while len(size) > 1:
        while heap and not (heap[0][1] in size and heap[0][2] in size):
            heapq.heappop(heap)
        c, a, b = heapq.heappop(heap) if heap else min((cost(a, b), a, b) for a in size for b in size if a < b)
        new = n + len(out)
        out.append((a, b, c))
        centre[new] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
        size[new] = size[a] + size[b]
        few, many = sorted((near.pop(a), near.pop(b)), key=len)
        many |= few
        many -= {a, b}
        near[new] = many
        for x in (a, b):
            del size[x], centre[x]
        for x in many:  # in place: a neighbour of very many isn't copied for each merge
            near[x] -= {a, b}
            near[x].add(new)
            heapq.heappush(heap, (cost(x, new), x, new))
    return out


def cut_tree(n: int, merges: Sequence[tuple[int, int, float]], k: int) -> np.ndarray:
    """Labels 0 .. k-1 in the order of each cluster's first row."""
    parent = list(range(n + len(merges)))
    for step, (a, b, _) in enumerate(merges[: n - k]):
        parent[a] = parent[b] = n + step
    root = np.array(parent)
    while ((further := root[root]) != root).any():  # each round doubles how far is looked up
        root = further
    root = root[:n]
    _, first, label = np.unique(root, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[label]


def feasible_regimes(n: int, regimes: int, least: int) -> int:
    return min(regimes, max(1, n // least))


def merge_small(labels: np.ndarray, features: np.ndarray, edges: np.ndarray, least: int) -> np.ndarray:
    """The smallest regime under the least size goes to the neighbour (else any) with the nearest centroid, until none is left.

    Regimes are rows of a table of sizes and sums of features; joining two adds one row to another, and the graph between
    regimes counts the edges of the rows' graph."""
    names, z = np.unique(labels, return_inverse=True)
    k = len(names)
    size, total, touch = np.bincount(z, minlength=k), np.zeros((k, features.shape[1])), np.zeros((k, k), np.int64)
    np.add.at(total, z, features)
    if len(edges):
        np.add.at(touch, (z[edges[:, 0]], z[edges[:, 1]]), 1)
    touch += touch.T
    into, alive = np.arange(k), np.ones(k, bool)
    while alive.sum() > 1 and (short := np.flatnonzero(alive & (size < least))).size:
        r = short[np.argmin(size[short])]
        others = np.flatnonzero(alive & (touch[r] > 0) & (np.arange(k) != r))
        others = others if others.size else np.flatnonzero(alive & (np.arange(k) != r))
        gap = np.sqrt(((total[others] / size[others, None] - total[r] / size[r]) ** 2).sum(1))
        to = others[np.argmin(gap)]
        size[to], total[to] = size[to] + size[r], total[to] + total[r]
        touch[to] += touch[r]
        touch[:, to] += touch[:, r]
        into[into == r], alive[r] = to, False
    return np.unique(into[z], return_inverse=True)[1]


def weights(d: np.ndarray, bandwidth: int | float | None, kernel: str = "bisquare") -> np.ndarray:
    """Weights out to the k-th nearest (an integer), the farthest (None), or a distance (a float)."""
    if isinstance(bandwidth, float):
        b = bandwidth
    else:
        b = float(np.sort(d)[min(bandwidth or len(d), len(d)) - 1])
        if b <= 1e-12:
            b = float(d[d > 1e-12].min()) if (d > 1e-12).any() else 1.0
        b = np.nextafter(b, np.inf)
    u = d / b
    if kernel == "bisquare":
        return np.where(u < 1, (1 - u * u) ** 2, 0.0)
    return np.exp(-0.5 * u * u) if kernel == "gaussian" else np.exp(-u)


class Sums:
    """Of each regime its moments of coordinates up to order four, times the products of terms and response: a bisquare fit out to the regime's farthest
    row, at any place, is read off them, as its weight is a polynomial in the coordinates. A move takes one row from a regime's moments and adds it to
    another's. A regime's own centre and width are the unit, taken anew when half of it has changed."""

    def __init__(self, one: Instance, labels: np.ndarray) -> None:
        n, self.p = one.x.shape
        self.xy, self.terms = one.xy, np.concatenate([(one.x[:, :, None] * one.x[:, None]).reshape(n, self.p**2), one.x * one.y[:, None]], 1)
        self.labels = labels.copy()
        self.size, self.unit, self.sums, self.rim, self.moved = {}, {}, {}, {}, {}
        for g in np.unique(labels).tolist():
            self._begin(g)

    def _begin(self, g: int) -> None:
        rows = np.flatnonzero(self.labels == g)
        self.size[g], self.moved[g] = len(rows), 0
        xy = self.xy[rows]
        wide = float(np.ptp(xy, axis=0).max()) if len(rows) else 0.0
        self.unit[g] = (xy.mean(0) if len(rows) else np.zeros(2)), wide if wide > SMALL else 1.0
        self.rim[g] = _hull(xy)
        self.sums[g] = self._powers(rows, g) @ self.terms[rows]

    def _powers(self, rows: np.ndarray, g: int) -> np.ndarray:
        centre, wide = self.unit[g]
        u, v = ((self.xy[rows] - centre) / wide).T
        q = u * u + v * v
        return np.stack([np.ones(len(rows)), u, v, u * u, u * v, v * v, q * u, q * v, q * q])

    def move(self, i: int, own: int, to: int) -> None:
        row = np.array([i])
        self.labels[i] = to
        for g, sign in ((own, -1), (to, 1)):
            self.size[g] += sign
            self.moved[g] += 1
            if 2 * self.moved[g] > self.size[g]:
                self._begin(g)
                continue
            self.sums[g] = self.sums[g] + sign * self._powers(row, g) @ self.terms[row]
            if sign > 0:
                self.rim[g] = np.concatenate([self.rim[g], self.xy[row]])
                if len(self.rim[g]) > 512:
                    self.rim[g] = _hull(self.rim[g])
            elif (self.rim[g] == self.xy[i]).all(1).any():
                self.rim[g] = _hull(self.xy[self.labels == g])

    def surely_full(self, i: int, g: int) -> bool:
        """Whether the terms of regime g without row i are far from dependent; if not, it takes a look at the rows."""
        m = self.sums[g][0] - (self.terms[i] if self.labels[i] == g else 0.0)
        values = np.linalg.eigvalsh(m[: self.p**2].reshape(self.p, self.p))
        return bool(values[0] > 1e-8 * values[-1])

    def weighed(self, rows: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
        """At each of rows, sums of weights times products over regime g, and whether they can be trusted: not where all the regime is at the
        row's place, or where weights all but vanish, as sums would lose their digits."""
        centre, wide = self.unit[g]
        u, v = ((self.xy[rows] - centre) / wide).T[:, :, None]
        q, (s, sx, sy, sxx, sxy, syy, sx3, sy3, s4) = u * u + v * v, self.sums[g]
        far = np.zeros(len(rows))
        for corners in np.array_split(self.rim[g], max(1, len(self.rim[g]) // 64)):
            far = np.maximum(far, ((self.xy[rows, None] - corners) ** 2).sum(2).max(1, initial=0.0))
        b2 = np.nextafter(np.sqrt(far), np.inf)[:, None] ** 2
        c = np.maximum(b2 / wide**2, 1e-300)
        along, square = u * sx + v * sy, sxx + syy
        two = q * s - 2 * along + square
        four = q * q * s + s4 + 4 * (u * u * sxx + 2 * u * v * sxy + v * v * syy) + 2 * q * square - 4 * q * along - 4 * (u * sx3 + v * sy3)
        out = s - 2 * two / c + four / (c * c)
        trace = lambda m: m[..., : self.p**2 : self.p + 1].sum(-1)
        return out, (b2[:, 0] > 1e-24) & (trace(out) > 1e-4 * trace(s))

    def fit(self, i: int, g: int) -> np.ndarray | None:
        """Coefficients at row i of regime g without it; None where sums can't be trusted."""
        s, sure = self.weighed(np.array([i]), g)
        if not sure[0]:
            return None
        s = s[0] - (self.terms[i] if self.labels[i] == g else 0.0)
        m = s[: self.p**2].reshape(self.p, self.p)
        other = self.sums[g][0] - (self.terms[i] if self.labels[i] == g else 0.0)
        if np.trace(m) < 1e-4 * np.trace(other[: self.p**2].reshape(self.p, self.p)):
            return None
        return solve(m[None], s[None, self.p**2 :, None])[0, :, 0]


class Cells:
    """Rows of an instance by square cells of about so many: the rows near one are looked for around it, not in the whole instance."""

    def __init__(self, xy: np.ndarray, each: int) -> None:
        self.xy, low = xy, xy.min(0, initial=np.inf) if len(xy) else np.zeros(2)
        wide = np.ptp(xy, axis=0) if len(xy) else np.zeros(2)
        flat = max(float(wide.max(initial=0.0)), SMALL)
        self.side = max(float(np.sqrt(max(wide[0], flat / max(1, len(xy))) * max(wide[1], flat / max(1, len(xy))) * each / max(1, len(xy)))), flat / 2**20)
        self.at = ((xy - low) // self.side).astype(np.int64)
        self.high = int(self.at[:, 1].max(initial=0)) + 1
        key = self.at[:, 0] * self.high + self.at[:, 1]
        self.order = np.argsort(key, kind="stable")
        self.key, self.last = key[self.order], int(self.at[:, 0].max(initial=0))

    def around(self, i: int, ring: int) -> tuple[np.ndarray, bool]:
        """Rows of cells up to so many away, ascending, and whether those are all: any row within ring sides is among them."""
        x, y = self.at[i].tolist()
        lo, hi = max(0, y - ring), min(self.high - 1, y + ring)
        across = np.arange(max(0, x - ring), min(self.last, x + ring) + 1) * self.high
        a, b = np.searchsorted(self.key, across + lo), np.searchsorted(self.key, across + hi, "right")
        every = lo == 0 and hi == self.high - 1 and len(across) == self.last + 1
        return np.sort(np.concatenate([self.order[s:e] for s, e in zip(a.tolist(), b.tolist())])), every


class Instance:
    """Observations of one instance: design matrix, response, places, neighbours. Distances are worked out where they are asked for."""

    def __init__(self, x: np.ndarray, y: np.ndarray, xy: np.ndarray, edges: np.ndarray, how: Refinement) -> None:
        self.x, self.y, self.xy, self.how, self.edges = x, y, xy, how, edges
        self.near = neighbour_lists(len(y), edges)
        self.beside = [set(v.tolist()) for v in self.near]
        self.held: tuple | None = None
        self.by_sums = how.bandwidth is None and how.kernel == "bisquare"
        self.cells = None if how.bandwidth is None or how.kernel != "bisquare" else Cells(xy, how.bandwidth if isinstance(how.bandwidth, int) else 64)

    def away(self, i: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.xy[rows] - self.xy[i]) ** 2).sum(1))

    def weighing(self, i: int, g: int, labels: np.ndarray, size: int, alone: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows of regime g (of size rows, without row i if alone) that weigh at row i, at least all of them, and their weights."""
        how = self.how
        if self.cells is not None:
            ring = 1 if isinstance(how.bandwidth, int) else max(1, int(how.bandwidth / self.cells.side) + 1)
            while True:
                rows, every = self.cells.around(i, ring)
                rows = rows[labels[rows] == g]
                rows = rows[rows != i] if alone else rows
                d = self.away(i, rows)
                if every or not isinstance(how.bandwidth, int):
                    break
                k = min(how.bandwidth, size)
                if len(rows) >= k > 0 and SMALL < (b := np.partition(d, k - 1)[k - 1]) <= ring * self.cells.side:
                    rows, d = rows[d <= b], d[d <= b]
                    break
                ring *= 2
        else:
            rows = np.flatnonzero(labels == g)
            rows = rows[rows != i] if alone else rows
            d = self.away(i, rows)
        return rows, weights(d, how.bandwidth, how.kernel) if len(d) else d

    def fit(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coefficients, residuals and own leverages of a fit within regimes."""
        n, p = self.x.shape
        m, r, own = np.empty((n, p, p)), np.empty((n, p, 2)), np.empty(n)
        sums = Sums(self, labels) if self.by_sums else None
        by_cells = self.cells is not None and isinstance(self.how.bandwidth, int)
        if by_cells:
            m, r[:, :, 0], own, again = self.near_sums(labels)
        for g in np.unique(labels).tolist():
            rows = left = np.flatnonzero(labels == g)
            if by_cells:
                left = again[labels[again] == g]
            if sums is not None:
                left = []
                for part in np.array_split(rows, 1 + len(rows) // 10_000):
                    s, sure = sums.weighed(part, g)
                    m[part], r[part, :, 0], own[part] = s[:, : p * p].reshape(-1, p, p), s[:, p * p :], 1.0
                    left.append(part[~sure])
                left = np.concatenate(left)
            for i in left.tolist():
                some, w = self.weighing(i, g, labels, len(rows), False)
                xg = self.x[some]
                m[i] = (xg * w[:, None]).T @ xg
                r[i, :, 0] = (xg * w[:, None]).T @ self.y[some]
                own[i] = w[np.searchsorted(some, i)]
        r[:, :, 1] = self.x
        out = solve(m, r)
        return out[:, :, 0], self.y - (out[:, :, 0] * self.x).sum(1), (out[:, :, 1] * self.x).sum(1) * own

    def near_sums(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each row, sums over its nearest of its regime (m, r), its own weight, and rows that must be looked for farther than a cell away.

        Rows of a cell and regime are weighed at once. What was worked out for the labels before stays for rows that nothing has left or joined
        within their bandwidths."""
        n, p, k = *self.x.shape, self.how.bandwidth
        if self.held is None:
            self.held = np.full(n, -1), np.empty((n, p, p)), np.empty((n, p)), np.empty(n), np.full(n, np.inf)
        before, m, r, own, reach = self.held
        todo = (before != labels) | ~np.isfinite(reach)
        for j in np.flatnonzero((before != labels) & (before >= 0)).tolist() if (before >= 0).any() else ():
            rows, _ = self.cells.around(j, 1)  # reaches that are kept are at most a cell
            todo[rows[((labels[rows] == labels[j]) | (labels[rows] == before[j])) & (self.away(j, rows) <= reach[rows])]] = True
        names, name, size = np.unique(labels, return_inverse=True, return_counts=True)
        most = np.minimum(k, size)
        size = dict(zip(*(a.tolist() for a in np.unique(before, return_counts=True))))
        todo |= (most != [min(k, size.get(g, 0)) for g in names.tolist()])[name]
        some = np.flatnonzero(todo)
        some = some[np.lexsort((labels[some], self.cells.at[some, 1], self.cells.at[some, 0]))]
        cut = np.flatnonzero((np.diff(self.cells.at[some], axis=0) != 0).any(1) | (np.diff(labels[some]) != 0)) + 1
        for rows in np.split(some, cut) if len(some) else ():
            g, near, reach[rows] = labels[rows[0]], int(most[name[rows[0]]]), np.inf
            others, _ = self.cells.around(int(rows[0]), 1)
            others = others[labels[others] == g]
            if len(others) < near:
                continue
            terms = np.concatenate([(self.x[others][:, :, None] * self.x[others][:, None]).reshape(-1, p * p), self.x[others] * self.y[others, None]], 1)
            for part in np.array_split(rows, 1 + len(rows) // 256):
                d = np.sqrt((self.xy[part, None, 0] - self.xy[None, others, 0]) ** 2 + (self.xy[part, None, 1] - self.xy[None, others, 1]) ** 2)
                b = np.partition(d, near - 1, 1)[:, near - 1].copy()
                sure = (b > SMALL) & (b <= self.cells.side)
                u = d / np.where(sure, np.nextafter(b, np.inf), 1.0)[:, None]
                w = np.where(u < 1, (1 - u * u) ** 2, 0.0)
                sums = w @ terms
                m[part], r[part], own[part] = sums[:, : p * p].reshape(-1, p, p), sums[:, p * p :], w[np.arange(len(part)), np.searchsorted(others, part)]
                reach[part] = np.where(sure, b, np.inf)
        self.held = labels.copy(), m, r, own, reach
        return m.copy(), r.copy(), own.copy(), np.flatnonzero(~np.isfinite(reach))

    def cuts(self, labels: np.ndarray) -> int:
        return int((labels[self.edges[:, 0]] != labels[self.edges[:, 1]]).sum()) if len(self.edges) else 0

    def beside_others(self, labels: np.ndarray) -> list[bool]:
        """Of each row, whether a neighbour is of another regime."""
        out = np.zeros(len(labels), bool)
        out[self.edges[labels[self.edges[:, 0]] != labels[self.edges[:, 1]]]] = True
        return out.tolist()

    def error(self, i: int, g: int, labels: np.ndarray, sums: Sums | None = None, size: int | None = None) -> float:
        """The squared error at row i of a fit to regime g (of size rows) without it, from the regime's sums where they give it."""
        p = self.x.shape[1]
        size = size if size is not None else int((labels == g).sum() if sums is None else sums.size[g])
        n = size - int(labels[i] == g)
        if n < max(p + self.how.fit, self.how.fit_size):
            return np.inf
        if self.how.full_rank and not (sums is not None and sums.surely_full(i, g)):
            rows = np.flatnonzero(labels == g)
            if np.linalg.matrix_rank(self.x[rows[rows != i]]) < p:
                return np.inf
        beta = None if sums is None else sums.fit(i, g)
        if beta is None:
            rows, w = self.weighing(i, g, labels, n, True)
            xg = self.x[rows]
            beta = solve(((xg * w[:, None]).T @ xg)[None], ((xg * w[:, None]).T @ self.y[rows])[None, :, None])[0, :, 0]
        return float((self.y[i] - self.x[i] @ beta) ** 2)

    def in_one_piece(self, rows: np.ndarray) -> bool:
        left = set(rows.tolist())
        todo = [left.pop()] if left else []
        while todo and left:
            found = left & self.beside[todo.pop()]
            left -= found
            todo += found
        return not left

    def meet_without(self, i: int, ring: list[int], labels: np.ndarray) -> bool:
        """Whether the rows of ring reach each other in their regime without row i. Searches from all of them grow in turns, so that it
        ends where they have met, or where the smallest part is known."""
        own, of = labels[i], {r: k for k, r in enumerate(ring)}
        todo, top, left = [[r] for r in ring], list(range(len(ring))), len(ring)

        def root(k: int) -> int:
            while top[k] != k:
                top[k] = k = top[top[k]]
            return k

        while left > 1:
            for k in {root(k) for k in range(len(ring))}:
                k = root(k)
                if not todo[k]:
                    return False
                for b in self.beside[todo[k].pop()]:
                    if b == i or labels[b] != own:
                        continue
                    if b not in of:
                        of[b] = k
                        todo[k].append(b)
                    elif (other := root(of[b])) != k:
                        top[other], left = k, left - 1
                        todo[k] += todo[other]
                if left == 1:
                    break
        return True

    def may_leave(self, i: int, labels: np.ndarray, whole: dict[int, bool] | None = None, size: int | None = None) -> bool:
        """Whether row i's regime (of size rows) stays large enough, and in one piece, without it.

        Where the regime is whole, its rows around this one need only reach each other; where it isn't, a row beside others of it
        can't change that. whole keeps what is known of regimes."""
        own = int(labels[i])
        left = int((labels == own).sum() if size is None else size) - 1
        if left < self.how.spare:
            return False
        if not self.how.connected or left <= 1:
            return True
        ring = self.near[i][labels[self.near[i]] == own]
        if whole is not None and len(ring):
            if own not in whole:
                whole[own] = self.in_one_piece(np.flatnonzero(labels == own))
            return whole[own] and (self.in_one_piece(ring) or self.meet_without(i, ring.tolist(), labels))
        rest = np.flatnonzero(labels == own)
        return self.in_one_piece(rest[rest != i])

    def sweep(self, labels: np.ndarray, number: int) -> tuple[np.ndarray, list[dict]]:
        """One pass over the rows in a seeded order; each move is seen by the rows after it."""
        z, moves, how = labels.copy(), [], self.how
        sums = Sums(self, z) if self.by_sums else None
        size = dict(zip(*(a.tolist() for a in np.unique(z, return_counts=True))))
        whole: dict[int, bool] = {}
        rows: np.ndarray | int = len(z)
        if how.nodes == "boundary":
            cut = self.edges[z[self.edges[:, 0]] != z[self.edges[:, 1]]]
            rows = np.unique(cut)
        beside = self.beside_others(z)
        for i in np.random.default_rng(how.seed + number).permutation(rows).tolist():
            if not beside[i]:
                continue  # there is no regime to move to
            own, around = int(z[i]), z[self.near[i]]
            if not self.may_leave(i, z, whole, size[own]):
                continue
            costs = {}
            for g in sorted({*around.tolist(), own}):
                away = int((around != g).sum())
                costs[g] = (error := self.error(i, g, z, sums, size[g])) + how.penalty * away, error, away
            to = min(costs, key=lambda g: (costs[g][0], g != own, g))
            if to != own and costs[to][0] < costs[own][0] - how.gain:
                moves.append({"iteration": number, "node": i, "from_regime": own, "to_regime": to} | {f"{a}_{b}": v for a, g in (("old", own), ("new", to)) for b, v in zip(("cost", "error", "disagreement"), costs[g])})
                z[i] = to
                size[own], size[to] = size[own] - 1, size[to] + 1
                for b in (i, *self.near[i].tolist()):
                    beside[b] = bool((z[self.near[b]] != z[b]).any())
                if sums is not None:
                    sums.move(i, own, to)
                whole = {g: True for g, one in whole.items() if one}  # a row that comes may join parts, and never makes new ones
        return z, moves

    def refine(self, labels: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], list[dict], list[dict], str]:
        """Sweeps until nothing moves, the objective would grow, or there have been enough: labels at the start and after each accepted
        sweep (its number, labels), history, moves of accepted sweeps, why it ended."""
        how, stop = self.how, "max_iterations"

        def record(number: int, z: np.ndarray, changes: int) -> dict:
            _, resid, hat = self.fit(z)
            rss, cuts = float(resid @ resid), self.cuts(z)
            return {"iteration": number, "accepted": True, "changes": changes, "rss": rss, "trace": float(hat.sum()), "cut_edges": cuts, "objective": rss + how.penalty * cuts, "sizes": ";".join(str(int(c)) for c in np.unique(z, return_counts=True)[1])}

        history, moves, path = [record(0, labels, 0)], [], [(how.first - 1, labels)]
        for number in range(how.first, how.first + how.sweeps):
            z, proposed = self.sweep(labels, number)
            changes = int((z != labels).sum())
            if not changes:
                stop = "no_label_changes"
                break
            new = record(number, z, changes)
            new["accepted"] = new["objective"] <= history[-1]["objective"] + how.guard
            history.append(new)
            if not new["accepted"]:
                stop = "objective_guard"
                break
            moves += [m for m in proposed if z[m["node"]] != labels[m["node"]]]
            labels = z
            path.append((number, z))
        return path, history, moves, stop


# -- on DataFrames -----------------------------------------------------------------------------


def _edge_array(edges: pd.DataFrame, ids: np.ndarray) -> np.ndarray:
    place = pd.Series(np.arange(len(ids)), index=ids)
    out = edges[edges.i.isin(place.index) & edges.j.isin(place.index)]
    return np.stack([place.loc[out.i].to_numpy(), place.loc[out.j].to_numpy()], 1) if len(out) else np.zeros((0, 2), int)


#: Partitions that each instance gets when instances are dealt out, so that few of them meet in one.
SPREAD = 8


def spread(df: DataFrame, *by: str, n: int | None = None) -> DataFrame:
    """df dealt by its instances (the columns by; n of them, else they are counted), to many more partitions than there are instances. A number that is asked for isn't coalesced, so nearly all instances are tasks of their own."""
    n = df.select(*by).distinct().count() if n is None else n
    return df.repartition(max(1, min(SPREAD * n, 100_000)), *by)


def _on_one(df: DataFrame, edges: DataFrame, run, schema: str) -> DataFrame:
    """run(rows, edges) for each instance of df (column instance; edges of all instances, or with the column too)."""
    n = df.select("instance").distinct().count()
    keyed = edges.withColumnRenamed("instance", "of") if "instance" in edges.columns else edges.crossJoin(df.select(F.col("instance").alias("of")).distinct())
    names = [c.split()[0] for c in schema.split(", ")]

    def each(key, rows, lines):
        return run(key[0], rows.sort_values("id").reset_index(drop=True), lines) if len(rows) else pd.DataFrame(columns=names)

    return spread(df, "instance", n=n).groupBy("instance").cogroup(spread(keyed, "of", n=n).groupBy("of")).applyInPandas(each, schema)


def ward_labels(features: DataFrame, edges: DataFrame, columns: Sequence[str], ks: Sequence[int], least: int = 0) -> DataFrame:
    """(instance, k, id, regime, step_cost): graph-constrained Ward labels of every k from one tree. features: instance, id, columns."""
    schema = "instance string, k long, id long, regime long, step_cost double"

    def run(instance, rows, e):
        ids, x = rows["id"].to_numpy(), rows[list(columns)].to_numpy(float)
        lines = _edge_array(e, ids)
        tree, out = merge_tree(x, lines), []
        for k in ks:
            k = min(k, len(ids))
            z = cut_tree(len(ids), tree, k)
            z = merge_small(z, x, lines, least) if least else z
            out.append(pd.DataFrame({"instance": instance, "k": k, "id": ids, "regime": z, "step_cost": tree[len(ids) - k][2] if k > 1 else np.nan}))
        return pd.concat(out)

    return _on_one(features, edges, run, schema)


def merge_small_regimes(rows: DataFrame, edges: DataFrame, columns: Sequence[str], least: int) -> DataFrame:
    """(instance, id, regime) after small regimes have gone to their neighbours. rows: instance, id, regime, columns."""

    def run(instance, r, e):
        z = merge_small(r["regime"].to_numpy(), r[list(columns)].to_numpy(float), _edge_array(e, r["id"].to_numpy()), least)
        return pd.DataFrame({"instance": instance, "id": r["id"], "regime": z})

    return _on_one(rows, edges, run, "instance string, id long, regime long")


_RECORDS = {
    "labels": "id long, initial long, regime long",
    "history": "iteration long, accepted boolean, changes long, rss double, trace double, cut_edges long, objective double, sizes string, stop string",
    "moves": "iteration long, node long, from_regime long, to_regime long, old_cost double, old_error double, old_disagreement long, new_cost double, new_error double, new_disagreement long",
    "path": "iteration long, id long, regime long",
}


class Refined(NamedTuple):
    """labels (instance, id, initial, regime), history and moves of a refinement, and path: the labels (instance, iteration, id, regime)
    at the start (one before the first sweep's number) and after each accepted sweep."""

    labels: DataFrame
    history: DataFrame
    moves: DataFrame
    path: DataFrame


def refined(obs: DataFrame, edges: DataFrame, how: Refinement | Mapping[str, Refinement]) -> Refined:
    """The refinement of obs (id, px, py, yy, x0 .., regime), worked out once.

    A mapping gives settings by name, and each is an instance: a grid of
    penalties is refined side by side from the same start.
    """
    settings = dict(how) if isinstance(how, Mapping) else {"": how}
    p = sum(c[0] == "x" and c[1:].isdigit() for c in obs.columns)
    rows = obs.crossJoin(F.broadcast(obs.sparkSession.createDataFrame([(k,) for k in settings], "instance string")))  # a row a setting
    fields: dict[str, str] = dict(f.split() for kind in _RECORDS.values() for f in kind.split(", "))

    def run(instance, r, e):
        ids = r["id"].to_numpy()
        one = Instance(r[[f"x{a}" for a in range(p)]].to_numpy(float), r["yy"].to_numpy(float), r[["px", "py"]].to_numpy(float), _edge_array(e, ids), settings[instance])
        z = r["regime"].to_numpy().astype(int)
        path, history, moves, stop = one.refine(z)
        parts = {
            "labels": pd.DataFrame({"id": ids, "initial": z, "regime": path[-1][1]}),
            "history": pd.DataFrame(history).assign(stop=stop),
            "moves": pd.DataFrame([m | {"node": ids[m["node"]]} for m in moves]),
            "path": pd.concat([pd.DataFrame({"iteration": n, "id": ids, "regime": x}) for n, x in path]),
        }
        out = pd.concat([part.assign(record=name) for name, part in parts.items()]).assign(instance=instance)
        return out.reindex(columns=["instance", "record", *fields]).astype({f: "Int64" if k == "long" else "boolean" if k == "boolean" else object if k == "string" else float for f, k in fields.items()})

    every = kept(_on_one(rows, edges, run, "instance string, record string, " + ", ".join(f"{f} {k}" for f, k in fields.items())))
    return Refined(*(every.where(F.col("record") == name).select("instance", *(f.split()[0] for f in kind.split(", "))) for name, kind in _RECORDS.items()))


def label_path(path: DataFrame, iterations: Sequence[int]) -> DataFrame:
    """A row an id, a column (after_n, start for the first) for the labels at each of the iterations; what wasn't reached has the last ones."""
    first, *rest = iterations
    at = path.groupBy("id").agg(*(F.max_by(F.when(F.col("iteration") <= n, F.col("regime")), F.when(F.col("iteration") <= n, F.col("iteration"))).alias("start" if n == first else f"after_{n}") for n in (first, *rest)))
    return at.join(path.groupBy("id").agg(F.max_by("regime", "iteration").alias("final")), "id")


def nearest_seeds(points: DataFrame, targets: Sequence[tuple[float, float]]) -> DataFrame:
    """(id, regime): for each target in turn (a place in the points' extent, as shares of it), the nearest point that isn't taken yet,
    ties to the smaller id; regimes are numbered from 1. A job a target."""
    lo = points.agg(*(f(c).alias(f"{n}{c}") for c in ("px", "py") for n, f in (("lo", F.min), ("hi", F.max)))).first()
    share = lambda c: (F.col(c) - lo[f"lo{c}"]) / max(lo[f"hi{c}"] - lo[f"lo{c}"], 1e-12)
    taken: list[int] = []
    for x, y in targets:
        away = F.pow(share("px") - x, 2) + F.pow(share("py") - y, 2)
        taken.append(points.where(~F.col("id").isin(taken)).orderBy(away, "id").first().id)
    return points.sparkSession.createDataFrame([(k, r) for r, k in enumerate(taken, 1)], "id long, regime long")


#: Nodes and edge ends of a piece of a graph that one task spreads labels in.
PIECE = 1 << 17
_FAR = 1 << 62


def _in_pieces(ids: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, piece) of nodes (id) and the ends (i, j) of their edges: consecutive ids share a piece, up to PIECE nodes and ends of edges. Kept."""
    heavy = kept(ids.select("id", F.lit(1).alias("w")).unionByName(ends.select(F.col("i").alias("id"), F.lit(1).alias("w"))).groupBy("id").agg(F.sum("w").alias("w")))
    whole = heavy.agg(F.sum("w")).first()[0] or 0
    dealt = heavy.repartitionByRange(max(1, whole // (4 * PIECE)), "id").withColumn("part", F.spark_partition_id().cast("long"))
    up_to = F.sum("w").over(Window.partitionBy("part").orderBy("id"))
    out = kept(dealt.select("id", "part", F.floor((up_to - 1) / PIECE).alias("nth")).select("id", (F.shiftleft("part", 32) + F.col("nth")).alias("piece")))
    dropped(heavy)
    return out


def _spread_in(kind: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, ...]:
    """(ids, d, label, new) of a piece's nodes that are reached. Rows are edges i to j (kind 0), what nodes i have (1) and what has come to
    them (2); new: whether a node has less than before. The waves go up by distance, so a node is met once a distance."""
    edge = kind == 0
    ids, at = np.unique(np.concatenate([i, j[edge]]), return_inverse=True)
    names, rank = np.unique(label[~edge], return_inverse=True)
    m, own = len(names), at[: len(i)]
    value = d[~edge] * m + rank
    old = np.full(len(ids), _FAR)
    np.minimum.at(old, own[kind == 1], value[kind[~edge] == 1])
    best = old.copy()
    np.minimum.at(best, own[kind == 2], value[kind[~edge] == 2])
    order = np.argsort(own[edge], kind="stable")
    to = at[len(i) :][order]
    first = np.concatenate([[0], np.cumsum(np.bincount(own[edge], minlength=len(ids)))])
    todo = np.flatnonzero(best < old)
    todo = todo[np.argsort(best[todo], kind="stable")]
    levels, p, wave, step = best[todo] // m, 0, todo[:0], 0
    while p < len(todo) or len(wave):
        step = step if len(wave) else levels[p]
        q = int(np.searchsorted(levels, step, "right"))
        now, p = np.unique(np.concatenate([wave, todo[p:q]])), q
        now = now[best[now] // m == step]  # the others were reached by a shorter way
        n = first[now + 1] - first[now]
        near = to[np.repeat(first[now] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        value = np.repeat(best[now], n) + m
        less = value < best[near]
        np.minimum.at(best, near[less], value[less])
        wave, step = np.unique(near[less]), step + 1
    met = np.flatnonzero(best < _FAR)
    return ids[met], best[met] // m, names[best[met] % m], best[met] < old[met]


def breadth_first(seeds: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(instance, id, regime): every node takes the label of the seed (instance, id, regime) that reaches it first;
    seeds by label, neighbours ascending, first in first out.

    In such a queue the nodes of one distance stand by label, so that a node takes the smallest label among the seeds nearest to it: the
    least (distance, label). It spreads within pieces of the graph, a task each, and a job a round takes what has become less over the edges between
    pieces; only pieces that something comes to are asked again. Any pieces give the same; with ids that follow places a round crosses a whole piece.
    A node that can't be reached is an error."""
    ends = both_ways(edges)
    piece = _in_pieces(nodes.select("id").unionByName(ends.select(F.col("i").alias("id"))).distinct(), ends)
    side = lambda c: piece.select(F.col("id").alias(c), F.col("piece").alias(f"p{c}"))
    met = kept(ends.join(side("i"), "i").join(side("j"), "j"))
    kind = seeds.schema["instance"].dataType.simpleString()
    schema = f"instance {kind}, piece long, id long, d long, regime long, new boolean"
    zero = F.lit(0).cast("long")
    none = [zero.alias("d"), zero.alias("regime")]

    def run(key, pdf):
        ids, d, regime, new = _spread_in(*(pdf[c].to_numpy() for c in ("kind", "i", "j", "d", "regime")))
        return pd.DataFrame({"instance": key[0], "piece": key[1], "id": ids, "d": d, "regime": regime, "new": new})

    come = kept(seeds.groupBy("instance", "id").agg(F.min("regime").cast("long").alias("regime")).join(piece, "id").select("instance", "piece", "id", zero.alias("d"), "regime"))
    done = None
    while not come.isEmpty():
        asked = kept(come.select("instance", "piece").distinct())
        rows = asked.join(met.where("pi = pj").select(F.col("pi").alias("piece"), "i", "j"), "piece").select("instance", "piece", F.lit(0).alias("kind"), "i", "j", *none)
        held = [(come, 2)] if done is None else [(come, 2), (done.join(asked, ["instance", "piece"], "left_semi"), 1)]
        for df, k in held:
            rows = rows.unionByName(df.select("instance", "piece", F.lit(k).alias("kind"), F.col("id").alias("i"), F.col("id").alias("j"), "d", "regime"))
        grown = kept(rows.groupBy("instance", "piece").applyInPandas(run, schema))
        before = [come, asked, done, grown]
        over = grown.where("new").join(met.where("pi <> pj").withColumnRenamed("i", "id"), "id").select("instance", F.col("pj").alias("piece"), F.col("j").alias("id"), F.col("d") + 1, "regime")
        come = kept(over.toDF("instance", "piece", "id", "d", "regime").groupBy("instance", "piece", "id").agg(F.min(F.struct("d", "regime")).alias("m")).select("instance", "piece", "id", "m.*"))
        all_of = grown.drop("new")
        done = kept(all_of if done is None else done.join(asked, ["instance", "piece"], "left_anti").unionByName(all_of))
        dropped(*before)
    dropped(piece, met, come)
    asked = nodes.select("id").crossJoin(seeds.select("instance").distinct())  # a node an instance
    out = asked.join(done.select("instance", "id", "regime"), ["instance", "id"], "left") if done is not None else asked.withColumn("regime", F.lit(None).cast("long"))
    return out.select("instance", "id", F.coalesce("regime", F.raise_error(F.lit("some nodes can't be reached from a seed")).cast("long")).alias("regime"))


def _assigned(gain: np.ndarray) -> np.ndarray:
    """For each row of gains (rows <= columns) its column, so that the sum is largest: shortest augmenting paths over reduced costs."""
    n, m = gain.shape
    cost = gain.max(initial=0) - gain.astype(float)
    row_of, pay, price = np.full(m, -1), np.zeros(n), np.zeros(m)
    for start in range(n):
        row, far, seen, back = start, np.full(m, np.inf), np.zeros(m, bool), np.full(m, -1)
        steps = [(start, -1)]
        while True:  # grow the tree of cheapest ways until it meets a free column
            slack = cost[row] - pay[row] - price
            last = steps[-1][1]
            near = ~seen & (slack < far)
            far[near], back[near] = slack[near], last
            column = int(np.where(seen, np.inf, far).argmin())
            step = far[column]
            for r, c in steps:
                pay[r] += step
                if c >= 0:
                    price[c] -= step
            far[~seen] -= step
            seen[column] = True
            if row_of[column] < 0:
                break
            row = int(row_of[column])
            steps.append((row, column))
        while column >= 0:  # turn the way around
            before = int(back[column])
            row_of[column] = row_of[before] if before >= 0 else start
            column = before
    out = np.empty(n, int)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


def best_match(counts: DataFrame) -> DataFrame:
    """(pred, true): the matching of predicted to true labels (pred, true, n) that agrees most. One row a pair of labels, so a table of labels by labels; its time grows with their cube."""

    def run(pdf):
        wide = pdf.pivot_table(index="pred", columns="true", values="n", aggfunc="sum", fill_value=0)
        if wide.shape[0] > wide.shape[1]:
            raise ValueError("more predicted than true labels")
        return pd.DataFrame({"pred": wide.index, "true": wide.columns[_assigned(wide.to_numpy())]})

    return counts.withColumn("all_rows", F.lit(True)).groupBy("all_rows").applyInPandas(run, "pred long, true long")


# -- partitions as tables ------------------------------------------------------------------------


def partition_summary(rows: DataFrame, edges: DataFrame, columns: Sequence[str], regime: str = "regime", by: str = "k") -> DataFrame:
    """Of each partition (by, id, regime, columns): wcss, cut edges and their share, sizes."""
    centre = rows.groupBy(by, regime).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"c_{c}") for c in columns))
    gap = sum((F.pow(F.col(c) - F.col(f"c_{c}"), 2) for c in columns), F.lit(0.0))
    wcss = rows.join(centre, [by, regime]).groupBy(by).agg(F.sum(gap).alias("wcss"))
    side = lambda s: rows.select(by, F.col("id").alias(s), F.col(regime).alias(f"r{s}"))
    cuts = edges.join(side("i"), "i").join(side("j"), ["j", by]).groupBy(by).agg(F.sum(F.when(F.col("ri") != F.col("rj"), 1).otherwise(0)).cast("long").alias("cut_edges"), F.count(F.lit(1)).alias("n_edges"))
    sizes = centre.groupBy(by).agg(F.count(F.lit(1)).alias("n_regimes"), F.min("n").alias("size_min"), F.median("n").alias("size_median"), F.max("n").alias("size_max"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(regime, "n"))), lambda s: s["n"].cast("string")), ";").alias("sizes"))
    return wcss.join(cuts, by).join(sizes, by).withColumn("cut_share", F.col("cut_edges") / F.col("n_edges"))


def merge_costs(summary: DataFrame, by: str = "k") -> DataFrame:
    """What a partition into one fewer adds to the sum of squares."""
    return summary.select(by, "wcss", (F.lag("wcss").over(Window.orderBy(by)) - F.col("wcss")).alias("merge_cost"))


def regime_profile(rows: DataFrame, columns: Sequence[str], regime: str = "regime") -> DataFrame:
    """Of each regime: size, wcss, mean and largest distance to the centroid, mean and spread of each column."""
    centre = rows.groupBy(regime).agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), *(F.stddev_pop(c).alias(f"std_{c}") for c in columns))
    gap = sum((F.pow(F.col(c) - F.col(f"mean_{c}"), 2) for c in columns), F.lit(0.0))
    spread = rows.join(centre, regime).groupBy(regime).agg(F.count(F.lit(1)).alias("n"), F.sum(gap).alias("wcss"), F.avg(F.sqrt(gap)).alias("mean_distance"), F.max(F.sqrt(gap)).alias("max_distance"))
    return spread.join(centre, regime)


def decisive_moves(moves: DataFrame) -> DataFrame:
    """The last move of each row, with its path and what drove it."""
    last = moves.groupBy("node").agg(F.max_by(F.struct(*[c for c in moves.columns if c != "node"]), "iteration").alias("m"), F.array_sort(F.collect_list(F.struct("iteration", "from_regime", "to_regime"))).alias("path"))
    flat = last.select("node", "m.*", F.array_join(F.concat(F.array(F.col("path")[0]["from_regime"].cast("string")), F.transform("path", lambda s: s["to_regime"].cast("string"))), "→").alias("path"))
    out = flat.withColumn("error_gain", F.col("old_error") - F.col("new_error")).withColumn("boundary_gain", F.col("old_disagreement") - F.col("new_disagreement"))
    return out.withColumn("driver", driver("error_gain", "boundary_gain"))


def driver(error: str, boundary: str):
    e, b = F.col(error), F.col(boundary)
    return F.when((e > 0) & (b > 0), "both").when((e > 0) & (b == 0), "error_only").when((e > 0) & (b < 0), "error_over_boundary").when((e <= 0) & (b > 0), "boundary_over_error").otherwise("neither")
