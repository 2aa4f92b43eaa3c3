"""Local regression: pairs, weights, grouped moments, small solves.

Observations are rows (id, px, py, yy, x0 .. x{p-1}) with an optional regime. A
fit is a join of focal rows with the rows that may weigh on them, a weight
column, and sums of w x_a x_b and w x_a y by focal row; only the sums, one row a
focal row, go to a solver. For a kernel of bounded support and a fixed
bandwidth the join is an equi-join on grid cells; within regimes it is one on
the regime. For a bounded kernel that reaches the k-th neighbour it is one on
cells too, of a ring around each cell that is sure to hold k rows. A bisquare
weight that reaches the farthest row of a regime is a polynomial in the
coordinates for all its rows, so that sums over the regime follow from its moments of
coordinates up to order four, and no pairs are made. Unbounded
kernels, and searches over all numbers of neighbours, weigh every row on every
row, as the method has it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TINY, kernel_weight
from ..functions.linalg import regular, solve
from ..tables import dropped, kept

SMALL = 1e-12
#: Neighbours from which on whole cells are weighed at once.
FAR = 1000
#: Neighbours within a regime from which on blocks meet, not rows.
WIDE = 256
#: Regimes up to which their moments are sent to every task.
MANY_REGIMES = 10_000


def observations(df: DataFrame, y: str, predictors: Sequence[str], coords: tuple[str, str] = ("px", "py"), key: str = "id", intercept: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """df as id, px, py, yy, x0 .. and the columns to keep."""
    terms = ([F.lit(1.0)] if intercept else []) + [F.col(c).cast("double") for c in predictors]
    return df.select(F.col(key).alias("id"), F.col(coords[0]).cast("double").alias("px"), F.col(coords[1]).cast("double").alias("py"), F.col(y).cast("double").alias("yy"), *(t.alias(f"x{i}") for i, t in enumerate(terms)), *keep)


def n_terms(obs: DataFrame) -> int:
    return sum(c[0] == "x" and c[1:].isdigit() for c in obs.columns)


#: Cells of one level that make a side of a cell of the next.
_COARSER = 4


def _dense(points: DataFrame, k: Column, side: float, most: float, x: str, y: str, by: list[str]) -> list[DataFrame]:
    """Tables (by, cx, cy) of cells that hold more than k points at more than one place, the first of cells of this side, each further one of
    cells within those of the last, _COARSER times as narrow, until there are none."""
    out: list[DataFrame] = []
    while True:
        width = side / _COARSER ** len(out)
        cell = lambda c, w: F.floor(F.col(c) / w)
        inside = points
        if out:
            parent = width * _COARSER
            inside = inside.withColumn("cx", cell(x, parent)).withColumn("cy", cell(y, parent)).join(out[-1], [*by, "cx", "cy"], "left_semi")
        full = inside.groupBy(*by, cell(x, width).alias("cx"), cell(y, width).alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.max(k).alias("k"), (F.max(x) > F.min(x)).alias("wide"), (F.max(y) > F.min(y)).alias("high"))
        full = kept(full.where((F.col("n") > F.col("k")) & (F.col("wide") | F.col("high"))).select(*by, "cx", "cy"))
        if full.isEmpty() or most / width * _COARSER > 2.0**50:
            dropped(full)
            return out
        out.append(full)


def rings(points: DataFrame, k: int | None, x: str = "px", y: str = "py", by: str | None = None) -> tuple[DataFrame, float, list[int]] | None:
    """(cx, cy, level, ring) of each cell that has points, the cells' side, and the levels in use: the k nearest points of
    any point of a cell lie at most ring cells of that level away. None if there are so few points that cells would ask for most of them.

    Cells hold about k / 4 points each, and are split where they hold over k at different places; those of each level are
    four times as wide as those before, and a cell begins at the level of which it is a whole cell. Cells are counted, not
    points: blocks around a cell widen until they hold k points, and a point's k-th nearest is then no farther than the
    block's far corner. What isn't found within two cells, in sparse places, is asked for at the next level.
    by: of points of the same group only, each group by itself; then k is None, a column k has each group's own, and the result has the group too.
    """
    g, own = ([by], F.col("k")) if by else ([], F.lit(k))
    points = points.select(x, y, *g, *(["k"] if by else []))
    points = points.where(F.col(by).isNotNull()) if by else points
    ends = points.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{name}{c}") for c in (x, y) for name, f in (("lo", F.min), ("hi", F.max)))).first()
    if by:
        sizes = points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k")).agg(F.count_if(F.col("n") > 4 * F.col("k")), F.min(F.when(F.col("n") > 4 * F.col("k"), F.col("k")))).first()
        k = sizes[1]
    if not (sizes[0] if by else ends.n > 4 * k):
        return None
    wide, high = ends[f"hi{x}"] - ends[f"lo{x}"], ends[f"hi{y}"] - ends[f"lo{y}"]
    flat = max(wide, high)
    side = math.sqrt(max(wide, flat / ends.n) * max(high, flat / ends.n) * k / (4 * ends.n)) or 1.0
    dense = _dense(points, own, side, max(abs(ends[f"{name}{c}"]) for name in ("lo", "hi") for c in (x, y)), x, y, g)
    top = len(dense)
    side /= _COARSER**top
    cells = points.groupBy(*g, F.floor(F.col(x) / side).alias("cx"), F.floor(F.col(y) / side).alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.max(own).alias("k")).withColumn("begin", F.lit(top))
    for j, table in enumerate(dense):
        scale = _COARSER ** (top - j)
        parents = table.select(*(F.col(c).alias(f"of_{c}") for c in g), F.col("cx").alias("dx"), F.col("cy").alias("dy"))
        same = (F.floor(F.col("cx") / scale) == F.col("dx")) & (F.floor(F.col("cy") / scale) == F.col("dy"))
        cells = cells.join(parents, same & (F.col(by) == F.col(f"of_{by}")) if by else same, "left")
        cells = cells.select(*g, "cx", "cy", "n", "k", F.when(F.col("dx").isNotNull(), top - 1 - j).otherwise(F.col("begin")).alias("begin"))
    cells = kept(cells)
    dropped(*dense)
    todo, done, level, levels = cells.where("begin = 0").select(*g, "cx", "cy", "k"), None, 0, []
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(max(abs(a), abs(b))).alias("m")) for a in range(-2, 3) for b in range(-2, 3)))
    while True:
        at = lambda c: F.floor(F.col(c) / _COARSER**level)  # noqa: B023, E731
        now = todo.select(*g, "cx", "cy", "k", at("cx").alias("ax"), at("cy").alias("ay"))
        asks = now.select(*g, "ax", "ay", "k").distinct().select(*g, "ax", "ay", "k", F.inline(steps)).withColumn("bx", F.col("ax") + F.col("a")).withColumn("by", F.col("ay") + F.col("b"))
        counts = cells.groupBy(*g, at("cx").alias("bx"), at("cy").alias("by")).agg(F.sum("n").alias("n"))
        enough = [F.sum(F.when(F.col("m") <= m, F.col("n")).otherwise(0)) >= F.max("k") for m in range(3)]
        found = asks.join(counts, [*g, "bx", "by"]).groupBy(*g, "ax", "ay").agg(F.when(enough[0], 0).when(enough[1], 1).when(enough[2], 2).alias("m"))
        placed = kept(now.join(found, [*g, "ax", "ay"]))
        ready = placed.where("m is not null").select(*g, "cx", "cy", F.lit(level).alias("level"), F.ceil((F.col("m") + 1) * math.sqrt(2)).cast("int").alias("ring"))
        done = ready if done is None else done.unionByName(ready)
        every, told = placed.agg(F.count(F.lit(1)), F.count("m")).first()
        levels += [level] if told else []
        level += 1
        if told == every and level > top:
            return done, side, levels
        todo = placed.where("m is null").select(*g, "cx", "cy", "k")
        todo = todo.unionByName(cells.where(F.col("begin") == level).select(*g, "cx", "cy", "k")) if level <= top else todo


def near_pairs(focal: DataFrame, other: DataFrame, k: int | None, points: DataFrame, x: str = "px", y: str = "py", by: str | None = None) -> DataFrame:
    """focal (f_x, f_y ..) joined with the rows of other (x, y ..) that may be among its k nearest; all of them are.

    by: among rows of the same group (f_by, by), of which points (x, y, by, k) tell each group's own k."""
    if (found := rings(points, k, x, y, by)) is None:  # up to four times k rows
        return focal.join(other, F.col(f"f_{by}") == F.col(by)) if by else focal.crossJoin(other)
    ring, side, levels = found
    ring = ring.withColumnRenamed(by, f"f_{by}") if by else ring
    cell = lambda c: F.floor(F.col(c) / side)
    step, scale = F.sequence(-F.col("ring"), F.col("ring")), F.pow(F.lit(_COARSER), F.col("level"))
    coarse = lambda c: F.floor(F.col(c) / scale).cast("long")
    asks = focal.withColumn("cx", cell(f"f_{x}")).withColumn("cy", cell(f"f_{y}")).join(ring, [*([f"f_{by}"] if by else []), "cx", "cy"])
    asks = asks.withColumn("a", F.explode(step)).withColumn("b", F.explode(step)).withColumn("cx", coarse("cx") + F.col("a")).withColumn("cy", coarse("cy") + F.col("b"))
    there = other.withColumn("cx", cell(x)).withColumn("cy", cell(y)).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    there = there.withColumn("cx", coarse("cx")).withColumn("cy", coarse("cy"))
    there = there.withColumn(f"f_{by}", F.col(by)) if by else there
    joined = asks.join(there, [*([f"f_{by}"] if by else []), "level", "cx", "cy"])
    reach = F.col("ring") * side * F.pow(F.lit(_COARSER), F.col("level"))  # no less than the k-th nearest is far
    close = F.pow(F.col(f"f_{x}") - F.col(x), 2) + F.pow(F.col(f"f_{y}") - F.col(y), 2) <= F.pow(reach, 2)
    return joined.where(close).drop("cx", "cy", "a", "b", "ring", "level")


def pairs(obs: DataFrame, within: str | None = None, radius: float | None = None, carry: Sequence[str] = (), nearest: int | DataFrame | None = None) -> DataFrame:
    """(i, j, d2, focal columns f_*, columns of j) for each row and each that may weigh on it, itself included.

    radius: only rows about so close; nearest: only rows that may be among each row's so many nearest, itself counted, or, within groups, a
    table (within, k) of each group's own number."""
    p = n_terms(obs)
    own = ["px", "py", "yy", *(f"x{a}" for a in range(p)), *([within] if within else []), *carry]
    focal = obs.select(F.col("id").alias("i"), *(F.col(c).alias(f"f_{c}") for c in own))
    other = obs.select(F.col("id").alias("j"), *own)
    if radius is not None:
        cell = lambda c: F.floor(F.col(c) / radius)
        steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
        focal = focal.withColumn("s", F.explode(steps)).withColumn("cx", cell("f_px") + F.col("s.a")).withColumn("cy", cell("f_py") + F.col("s.b")).drop("s")
        other = other.withColumn("cx", cell("px")).withColumn("cy", cell("py"))
        joined = focal.join(other, ["cx", "cy"])
        joined = joined.where(F.col(f"f_{within}").eqNullSafe(F.col(within))) if within else joined
    elif within and nearest is not None:
        joined = near_pairs(focal, other, None, obs.select("px", "py", within).join(nearest.select(within, "k"), within), by=within)
    elif within:
        joined = focal.join(other, F.col(f"f_{within}") == F.col(within))
    elif nearest is not None:
        joined = near_pairs(focal, other, nearest, obs)
    else:
        joined = focal.crossJoin(other)
    dx, dy = F.col("f_px") - F.col("px"), F.col("f_py") - F.col("py")
    return joined.withColumn("d2", dx * dx + dy * dy)


def with_reach(table: DataFrame, k: Column, boundary: str = "next", when: Column | None = None) -> DataFrame:
    """table with b2, the squared distance to the k-th nearest row of each focal row.

    A distance of nothing becomes the least one of the table over 1e-12, or 1. The boundary
    "next" is the next number; its effect on a weight is under 1e-30 and is left
    out. when: rows that are counted.
    """
    by = Window.partitionBy("i")
    d = F.sqrt("d2")
    ranked = table.withColumn("rn", F.row_number().over(by.orderBy(*([F.when(when, 0).otherwise(1)] if when is not None else []), "d2", "j")))
    count = F.sum(F.when(when, 1).otherwise(0) if when is not None else F.lit(1)).over(by)
    kth = F.max(F.when(F.col("rn") == F.least(k, count), d)).over(by)
    least = F.coalesce(F.min(F.when(d > TINY, d)).over(by), F.lit(1.0))
    b = F.when(kth <= TINY, least).otherwise(kth) * (1.0000001 if boundary == "factor" else 1.0)
    return ranked.withColumn("b2", F.pow(b, 2)).drop("rn")


def moments(weighted: DataFrame, p: int, by: Sequence[str] = ("i",), keep: Sequence[str] = ()) -> DataFrame:
    """Sums m_a_b of w x_a x_b and r_a of w x_a y by focal row; n_pos counts weights over zero; w_own is the row's own weight."""
    w = F.col("w")
    sums = [F.sum(w * F.col(f"x{a}") * F.col(f"x{b}")).alias(f"m_{a}_{b}") for a in range(p) for b in range(a, p)]
    sums += [F.sum(w * F.col(f"x{a}") * F.col("yy")).alias(f"r_{a}") for a in range(p)]
    sums += [F.sum(F.when(w > 0, 1).otherwise(0)).alias("n_pos"), F.sum(F.when(F.col("i") == F.col("j"), w).otherwise(0.0)).alias("w_own")]
    focal = [F.first(c).alias(c) for c in (*(f"f_x{a}" for a in range(p)), "f_yy", *keep)]
    return weighted.groupBy(*by).agg(*sums, *focal)


def _solver(p: int, by: Sequence[str], strict: bool):
    def run(batches):
        for batch in batches:
            col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names if n not in by}
            n = batch.num_rows
            m, r, x = np.empty((n, p, p)), np.empty((n, p, 1)), np.empty((n, p, 1))
            for a in range(p):
                r[:, a, 0], x[:, a, 0] = col[f"r_{a}"], col[f"f_x{a}"]
                for b in range(a, p):
                    m[:, a, b] = m[:, b, a] = col[f"m_{a}_{b}"]
            fails = (col["n_pos"] < p) | ~regular(m) if strict else np.zeros(n, bool)
            m[fails] = np.eye(p)
            both = solve(m, np.concatenate([r, x], 2)) if n else np.zeros((0, p, 2))
            beta, lever = both[:, :, 0], (both[:, :, 1] * x[:, :, 0]).sum(1)
            fitted = (beta * x[:, :, 0]).sum(1)
            out = [*beta.T, fitted, col["f_yy"] - fitted, lever * col["w_own"]]
            out = [np.where(fails, np.inf if k == p + 1 else np.nan, v) for k, v in enumerate(out)]
            names = [*(f"b{a}" for a in range(p)), "fitted", "resid", "hat"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *map(pa.array, out)], [*by, *names])

    return run


def solved(sums: DataFrame, p: int, by: Sequence[str] = ("i",), strict: bool = False) -> DataFrame:
    """by, b0 .., fitted, resid and hat (the row's own leverage) of each row of moments.

    strict: a row with fewer than p weights or without full rank gets NaN and an infinite residual.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.select(*by).schema)
    return sums.mapInArrow(_solver(p, by, strict), f"{kinds}, {', '.join(f'b{a} double' for a in range(p))}, fitted double, resid double, hat double")


def local_fit(obs: DataFrame, bandwidth: int | float, kernel: str = "bisquare", boundary: str = "next", counts: bool | None = None, strict: bool = False, far: bool | None = None) -> DataFrame:
    """A local regression at each row: id, b0 .., fitted, resid, hat.

    far: whether cells within a bisquare bandwidth are weighed as one, as suits bandwidths that reach many rows; by default
    from so many neighbours on, and never for a distance, as how many rows it reaches isn't known here."""
    p, counts = n_terms(obs), isinstance(bandwidth, int) if counts is None else counts
    if kernel == "bisquare" and (far or far is None and counts and bandwidth >= FAR):
        from .cells import far_fit

        return far_fit(obs, bandwidth, counts, boundary, strict)
    if counts:
        table = with_reach(pairs(obs, nearest=int(bandwidth) if kernel == "bisquare" else None), F.lit(int(bandwidth)), boundary)
    elif kernel == "bisquare":
        table = pairs(obs, radius=float(bandwidth)).withColumn("b2", F.lit(float(bandwidth) ** 2))
    else:
        from .tiles import moment_sums

        return solved(moment_sums(obs, p, [float(bandwidth)], kernel), p, strict=strict).withColumnRenamed("i", "id")
    return _finished(table, p, kernel, strict)


def _finished(table: DataFrame, p: int, kernel: str, strict: bool = False) -> DataFrame:
    weighted = table.withColumn("w", kernel_weight(F.col("d2"), F.col("b2"), kernel))
    return solved(moments(weighted, p), p, strict=strict).withColumnRenamed("i", "id")


def regime_sizes(obs: DataFrame, bandwidth: str | int | Mapping[int, int], regime: str = "regime") -> DataFrame:
    """(regime, n, k): each regime's size and bandwidth. A regime without one fails when it is computed."""
    sizes = obs.groupBy(regime).agg(F.count(F.lit(1)).alias("n"))
    if isinstance(bandwidth, Mapping):
        given = F.create_map(*(F.lit(x) for kv in bandwidth.items() for x in kv))[F.col(regime)]
        k = F.coalesce(given, F.raise_error(F.concat(F.lit("no bandwidth for regime "), F.col(regime).cast("string"))).cast("int"))
    else:
        k = F.col("n") if bandwidth == "regime_size" else F.lit(bandwidth)
    return sizes.withColumn("k", F.least(k, F.col("n")))


def _hull(xy: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points, which are all that can be farthest from anywhere."""
    xy = np.unique(xy[np.isfinite(xy).all(1)], axis=0)
    if len(xy) > 64:  # what lies within the polygon of extremes in eight directions is no corner
        way = np.array([[1, 0], [1, 1], [0, 1], [-1, 1], [-1, 0], [-1, -1], [0, -1], [1, -1]], float)
        poly = xy[(xy @ way.T).argmax(0)]
        edge = np.roll(poly, -1, 0) - poly
        real = (edge != 0).any(1)
        left = edge[real, 0, None] * (xy[None, :, 1] - poly[real, 1, None]) - edge[real, 1, None] * (xy[None, :, 0] - poly[real, 0, None])
        xy = xy[~(left > 0).all(0)]
    if len(xy) < 3:
        return xy

    def chain(points):
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(xy.tolist()) + chain(xy[::-1].tolist()))


def hulls(points: DataFrame, by: str, x: str = "px", y: str = "py") -> DataFrame:
    """by and hull, an array of the corners (x, y) of each group's points. Tasks give the corners of what they read, and these are what is
    gathered: as a rule their number grows with the logarithm of the points, but points on one circle are all corners."""
    kind = points.schema[by].dataType.simpleString()

    def corners(frames):
        held: dict = {}
        for pdf in frames:
            for g, rows in pdf.groupby(by, dropna=False):
                xy = rows[["x", "y"]].to_numpy(float)
                held[g] = _hull(np.concatenate([held[g], xy]) if g in held else xy)
        for g, xy in held.items():
            yield pd.DataFrame({by: [g] * len(xy), "x": xy[:, 0], "y": xy[:, 1]})

    parts = points.select(by, F.col(x).alias("x"), F.col(y).alias("y")).mapInPandas(corners, f"`{by}` {kind}, x double, y double")
    whole = parts.groupBy(by).applyInPandas(lambda pdf: next(corners([pdf]), pdf), f"`{by}` {kind}, x double, y double")
    return whole.groupBy(by).agg(F.collect_list(F.struct("x", "y")).alias("hull"))


def _products(p: int, y: str = "yy") -> dict[str, Column]:
    """The products whose weighted sums a fit needs, by the names that moments() gives them."""
    out = {f"m_{a}_{b}": F.col(f"x{a}") * F.col(f"x{b}") for a in range(p) for b in range(a, p)}
    return out | {f"r_{a}": F.col(f"x{a}") * F.col(y) for a in range(p)}


#: Powers of (x, y) by which a sum over (1 - d2/b2)^2 is made of moments.
_ORDERS = ("0", "x", "y", "xx", "xy", "yy", "x3", "y3", "4")


def coordinate_moments(obs: DataFrame, regime: str = "regime") -> DataFrame:
    """A row a regime: n, its centre cx, cy, its width s, the corners of its hull, and for each product of a fit an array of its sums times the powers of
    _ORDERS of the coordinates from the centre, in widths."""
    centre = obs.groupBy(regime).agg(F.count(F.lit(1)).alias("n"), F.avg("px").alias("cx"), F.avg("py").alias("cy"), F.greatest(F.max("px") - F.min("px"), F.max("py") - F.min("py")).alias("s"))
    centre = kept(centre.withColumn("s", F.when(F.col("s") > TINY, F.col("s")).otherwise(1.0)))
    rows = obs.join(centre, obs[regime].eqNullSafe(centre[regime])).drop(centre[regime])
    u, v = (F.col("px") - F.col("cx")) / F.col("s"), (F.col("py") - F.col("cy")) / F.col("s")
    rows = rows.withColumn("u", u).withColumn("v", v).withColumn("q", F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    power = {"0": F.lit(1.0), "x": F.col("u"), "y": F.col("v"), "xx": F.col("u") * F.col("u"), "xy": F.col("u") * F.col("v"), "yy": F.col("v") * F.col("v"), "x3": F.col("q") * F.col("u"), "y3": F.col("q") * F.col("v"), "4": F.col("q") * F.col("q")}
    sums = rows.groupBy(regime).agg(*(F.array(*(F.sum(z * power[o]) for o in _ORDERS)).alias(f"t_{name}") for name, z in _products(n_terms(obs)).items()))
    own, hull = sums.withColumnRenamed(regime, "g1"), hulls(obs, regime).withColumnRenamed(regime, "g2")
    return kept(centre.join(own, F.col(regime).eqNullSafe(F.col("g1"))).join(hull, F.col(regime).eqNullSafe(F.col("g2"))).drop("g1", "g2"))


def _weighted_by_moments(rows: DataFrame, p: int) -> DataFrame:
    """rows (focal columns, cx, cy, s, hull, t_*) with b2 and the sums m_a_b and r_a under bisquare weights that reach the farthest of a regime's rows."""
    far = F.array_max(F.transform("hull", lambda c: F.pow(F.col("f_px") - c["x"], 2) + F.pow(F.col("f_py") - c["y"], 2)))
    rows = rows.withColumn("b2", F.when(F.sqrt(far) <= TINY, 1.0).otherwise(far))
    u, v = (F.col("f_px") - F.col("cx")) / F.col("s"), (F.col("f_py") - F.col("cy")) / F.col("s")
    rows = rows.withColumn("u", u).withColumn("v", v).withColumn("q", F.col("u") * F.col("u") + F.col("v") * F.col("v")).withColumn("c", F.col("b2") / (F.col("s") * F.col("s")))
    u, v, q, c = (F.col(k) for k in ("u", "v", "q", "c"))

    def total(name: str) -> Column:
        s = {o: F.col(f"t_{name}")[k] for k, o in enumerate(_ORDERS)}
        along = u * s["x"] + v * s["y"]
        two = q * s["0"] - 2 * along + s["xx"] + s["yy"]
        four = q * q * s["0"] + s["4"] + 4 * (u * u * s["xx"] + 2 * u * v * s["xy"] + v * v * s["yy"]) + 2 * q * (s["xx"] + s["yy"]) - 4 * q * along - 4 * (u * s["x3"] + v * s["y3"])
        return s["0"] - 2 * two / c + four / (c * c)

    names = list(_products(p))
    return rows.select(*(k for k in rows.columns if k not in {"hull", "u", "v", "q", "c", "cx", "cy", "s"} and not k.startswith("t_")), *(total(n).alias(n) for n in names))


def _focal(obs: DataFrame, keep: Sequence[str]) -> DataFrame:
    return obs.select(F.col("id").alias("i"), *(F.col(k).alias(f"f_{k}") for k in ("px", "py", "yy", *(f"x{a}" for a in range(n_terms(obs))))), *keep)


def regime_fit(obs: DataFrame, bandwidth: str | int | Mapping[int, int] = "regime_size", kernel: str = "bisquare", regime: str = "regime") -> DataFrame:
    """A local regression at each row among the rows of its regime; distances are ranked within it. Bisquare weights as far as the regime goes need no pairs."""
    p = n_terms(obs)
    if bandwidth == "regime_size" and kernel == "bisquare":
        rows = _focal(obs.where(F.col(regime).isNotNull()), [regime]).join(coordinate_moments(obs, regime), regime)
        sums = _weighted_by_moments(rows, p).withColumn("n_pos", F.col("n")).withColumn("w_own", F.lit(1.0))
        return solved(sums, p).withColumnRenamed("i", "id")
    sizes = regime_sizes(obs, bandwidth, regime).select(regime, "k")
    if kernel == "bisquare" and (wide := {r[0]: r.k for r in sizes.where(F.col("k") > WIDE).collect()}):  # a row a regime of many rows
        return _wide_fits(obs, sizes, wide, p, regime)
    table = pairs(obs, within=regime, nearest=sizes if kernel == "bisquare" else None).join(sizes, regime)
    return _finished(with_reach(table, F.col("k")), p, kernel)


def _wide_fits(obs: DataFrame, sizes: DataFrame, wide: Mapping, p: int, regime: str) -> DataFrame:
    """Fits within regimes, those of wide (a number of neighbours by regime) by blocks, others by pairs, which would be too many."""
    from .rims import Rims

    far = F.col(regime).isin(list(wide))
    by_blocks = Rims(obs.where(far), p, regime).fits(wide).drop("of", "reach2")
    near, few = obs.where(~far), sizes.where(~far)
    by_pairs = _finished(with_reach(pairs(near, within=regime, nearest=few).join(few, regime), F.col("k")), p, "bisquare")
    return by_blocks.unionByName(by_pairs)


def shared_fit(obs: DataFrame, k: int, kernel: str = "bisquare", regime: str = "regime") -> DataFrame:
    """Bandwidths from all rows, then only rows of the same regime weigh; rows that can't be told get NaN."""
    table = with_reach(pairs(obs, nearest=k if kernel == "bisquare" else None, carry=[regime]), F.lit(k))
    return _finished(table.where(F.col(f"f_{regime}") == F.col(regime)), n_terms(obs), kernel, strict=True)


def ols(obs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ordinary least squares over all rows or by group: the columns of by, n, b0 .."""
    p = n_terms(obs)
    rows = obs.withColumn("w", F.lit(1.0)).withColumn("j", F.col("id")).withColumn("i", F.col("id")).withColumn("f_yy", F.col("yy"))
    for a in range(p):
        rows = rows.withColumn(f"f_x{a}", F.col(f"x{a}"))
    keys = list(by) or ["all_rows"]
    rows = rows if by else rows.withColumn("all_rows", F.lit(True))
    sums = moments(rows, p, keys)
    sizes = sums.select(*keys, F.col("n_pos").alias("n"))
    out = solved(sums, p, keys).drop("fitted", "resid", "hat").join(sizes, keys)
    return out if by else out.drop("all_rows")


def diagnostics(fit: DataFrame, obs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, rss, rmse, mae, r2, trace and aicc of a fit, over all rows or by group."""
    from ..functions.columns import aicc

    rows = fit.join(obs.select("id", "yy", *by), "id")
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow("resid", 2)).alias("rss"), F.avg(F.abs("resid")).alias("mae"), F.sum("hat").alias("trace"), (F.var_pop("yy") * F.count(F.lit(1))).alias("tss"))
    out = out.withColumn("rmse", F.sqrt(F.col("rss") / F.col("n"))).withColumn("r2", F.when(F.col("tss") > 0, 1 - F.col("rss") / F.col("tss")))
    return out.withColumn("aicc", aicc(F.col("n").cast("double"), F.col("rss"), F.col("trace"))).drop("tss")


def hat_rows(obs: DataFrame, bandwidth: int, boundary: str = "next", kernel: str = "bisquare") -> DataFrame:
    """(i, j, s): the weight of row j's y in row i's fitted value, where it isn't zero."""
    p = n_terms(obs)
    table = pairs(obs, nearest=bandwidth if kernel == "bisquare" else None)
    weighted = with_reach(table, F.lit(bandwidth), boundary).withColumn("w", kernel_weight(F.col("d2"), F.col("b2"), kernel)).where("w > 0")
    # C x_i solves M c = x_i, so that s_ij = w_ij x_j . c
    sums = moments(weighted, p)
    for a in range(p):
        sums = sums.withColumn(f"r_{a}", F.col(f"f_x{a}"))
    c = solved(sums, p).select("i", *(F.col(f"b{a}").alias(f"c{a}") for a in range(p)))
    s = sum((F.col(f"c{a}") * F.col(f"x{a}") for a in range(1, p)), F.col("c0") * F.col("x0"))
    return weighted.join(c, "i").select("i", "j", (F.col("w") * s).alias("s"))


def left_out_error(obs: DataFrame, least: int, regime: str = "regime") -> DataFrame:
    """(id, target, n, error): the squared error at each row of a fit to each regime's rows, itself left out.

    The bandwidth reaches the farthest of them. Fewer than least rows, or than
    terms, give an infinite error. A row and a regime are a row of the result; nothing else is made of them but from the regimes' moments.
    """
    p = n_terms(obs)
    moments_of = coordinate_moments(obs, regime)
    few = moments_of.limit(MANY_REGIMES + 1).count() <= MANY_REGIMES
    targets = moments_of.withColumnRenamed(regime, "target")
    rows = _focal(obs, [regime]).crossJoin(F.broadcast(targets) if few else targets)
    own = F.col(regime).eqNullSafe(F.col("target")).cast("int")
    sums = _weighted_by_moments(rows, p).withColumn("n", F.col("n") - own).where("n > 0")
    for name, z in ({f"m_{a}_{b}": F.col(f"f_x{a}") * F.col(f"f_x{b}") for a in range(p) for b in range(a, p)} | {f"r_{a}": F.col(f"f_x{a}") * F.col("f_yy") for a in range(p)}).items():
        sums = sums.withColumn(name, F.col(name) - own * z)  # a row's own weight is 1
    sums = sums.withColumn("n_pos", F.col("n")).withColumn("w_own", F.lit(0.0))
    fit = solved(sums, p, ["i", "target", "n"])
    return fit.select(F.col("i").alias("id"), "target", "n", F.when(F.col("n") < max(least, p), float("inf")).otherwise(F.pow("resid", 2)).alias("error"))
