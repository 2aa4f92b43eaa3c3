"""Local fits whose bandwidth reaches far: a tree of cells, each with its moments of coordinates.

A bisquare weight is a polynomial in the coordinates inside its bandwidth, so a
cell that lies wholly inside weighs on a row by its moments of order up to four, as
one row would; only cells at the rim are opened. Rows at one place are one
weighted place, as focal rows too: all that depends on where a row is, is worked out once a place.

The tree is descended by joins, from both ends at once: a pair is a cell of focal
places and a cell of others. At each level pairs are replaced by those of their
children, and of each focal cell's others those surely within every bandwidth go to its
moments, those surely beyond go, the rest are the rim. For a bandwidth that reaches the k-th
nearest, what is sure follows from running counts of the cells' least and
greatest distances. A row meets in the order of the square root of k places, not k.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TINY
from ..tables import dropped, kept
from .local import _ORDERS, _focal, _products, n_terms, solved

#: Halvings of the table's side at most. Places still together then stay in one cell: dear, but right.
DEPTH = 20
#: Distances are told apart from a bandwidth by this much, relatively; what is closer is opened and compared row by row.
_SLACK = 1e-6


def _places(obs: DataFrame) -> DataFrame:
    """(px, py, n, z_*): a row for each place, with the sums of the products of a fit over its rows."""
    z = _products(n_terms(obs))
    return obs.groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"z_{name}") for name, c in z.items()))


def _cell(level: Column, x0: float, y0: float, side: float) -> Column:
    """The number of a place's cell at a level; it holds the level and the cell's place in the grid."""
    at = lambda c, low: F.least(F.floor((F.col(c) - low) / side * F.pow(F.lit(2.0), level)), (F.pow(F.lit(2.0), level) - 1)).cast("long")
    return level.cast("long") * (1 << 50) + at("px", x0) * (1 << 25) + at("py", y0)


def _parent(cell: Column) -> Column:
    level, x, y = F.shiftright(cell, 50), F.shiftright(cell, 25).bitwiseAND((1 << 25) - 1), cell.bitwiseAND((1 << 25) - 1)
    return (level - 1) * (1 << 50) + F.shiftright(x, 1) * (1 << 25) + F.shiftright(y, 1)


def tree(obs: DataFrame, leaf: int = 4) -> tuple[DataFrame, DataFrame]:
    """(places with their leaf, nodes). Cells are halved each way while they hold more than leaf places.

    nodes: cell, level, n, box x0 x1 y0 y1, whether it is a leaf, centre cx cy and t_* as in coordinate_moments, in the coordinates' own unit."""
    places = kept(_places(obs).where(F.col("px").isNotNull() & F.col("py").isNotNull()))
    ends = places.agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1")).first()
    if ends.x0 is None:
        return places.withColumn("leaf", F.lit(0).cast("long")), places.select(F.lit(0).cast("long").alias("cell")).limit(0)
    side = max(ends.x1 - ends.x0, ends.y1 - ends.y0) or 1.0
    number = lambda level: _cell(level, ends.x0, ends.y0, side)
    every = places.select("px", "py", F.explode(F.sequence(F.lit(0), F.lit(DEPTH - 1))).alias("level")).withColumn("cell", number(F.col("level")))
    full = kept(every.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf).select("cell"))
    depth = every.join(full, "cell", "left_semi").groupBy("px", "py").agg(F.count(F.lit(1)).cast("int").alias("depth"))  # a full cell's parents are full
    own = places.select("px", F.col("py")).join(depth, ["px", "py"], "left").select("px", "py", F.coalesce("depth", F.lit(0)).alias("depth"))
    placed = kept(places.join(own, ["px", "py"]).withColumn("leaf", number(F.col("depth"))))
    members = placed.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth")))).withColumn("cell", number(F.col("level")))
    width = side / F.pow(F.lit(2.0), F.col("level"))
    corner = lambda low, shift: low + (F.shiftright("cell", shift).bitwiseAND((1 << 25) - 1) + 0.5) * width
    u, v = F.col("px") - corner(ends.x0, 25), F.col("py") - corner(ends.y0, 0)
    q = u * u + v * v
    power = {"0": F.lit(1.0), "x": u, "y": v, "xx": u * u, "xy": u * v, "yy": v * v, "x3": q * u, "y3": q * v, "4": q * q}
    names = list(_products(n_terms(obs)))
    nodes = members.groupBy("cell", "level").agg(
        F.sum("n").alias("n"), F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"), F.max(F.col("leaf") == F.col("cell")).alias("is_leaf"),
        *(F.array(*(F.sum(F.col(f"z_{name}") * power[o]) for o in _ORDERS)).alias(f"t_{name}") for name in names),
    )
    nodes = kept(nodes.withColumn("cx", corner(ends.x0, 25)).withColumn("cy", corner(ends.y0, 0)))
    dropped(places, full)
    return placed, nodes


def _apart() -> tuple[Column, Column]:
    """The least and the greatest distance of points of a focal box (f_x0 ..) and another."""
    least = lambda a: F.greatest(F.col(f"f_{a}0") - F.col(f"{a}1"), F.col(f"{a}0") - F.col(f"f_{a}1"), F.lit(0.0))
    most = lambda a: F.greatest(F.col(f"f_{a}1") - F.col(f"{a}0"), F.col(f"{a}1") - F.col(f"f_{a}0"))
    size = lambda a, b: F.sqrt(a * a + b * b)
    return size(least("x"), least("y")), size(most("x"), most("y"))


def _bounded(pairs: DataFrame, k: int | None, reach: float | None) -> DataFrame:
    """pairs (f, base, n, near, far) with lo and hi, between which the bandwidths of f's places are."""
    if k is None:
        return pairs.withColumn("lo", F.lit(reach)).withColumn("hi", F.lit(reach))
    by = Window.partitionBy("f")
    first = lambda d: F.min(F.when(F.col("base") + F.col(f"upto_{d}") >= k, F.col(d))).over(by)
    pairs = pairs.withColumn("upto_near", F.sum("n").over(by.orderBy("near"))).withColumn("upto_far", F.sum("n").over(by.orderBy("far")))
    # a bandwidth of nothing becomes the least distance that is something
    other = F.coalesce(F.min(F.when(F.col("near") > TINY, F.col("far"))).over(by), F.lit(float("inf")))
    pairs = pairs.withColumn("lo", first("near")).withColumn("hi", first("far")).withColumn("other", other)
    return pairs.withColumn("hi", F.when(F.col("lo") <= TINY, F.greatest("hi", "other")).otherwise(F.col("hi"))).drop("upto_near", "upto_far", "other")


def descended(nodes: DataFrame, k: int | None = None, reach: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(f, c) of cells c wholly within the bandwidths of all places of f, and (f, base, hi, c) of pairs of leaves at the rim; base counts the rows that
    are already within, hi is no less than any bandwidth of f. A leaf has itself at its rim; all others are in one of both tables, or beyond."""
    slim = kept(nodes.select("cell", "level", "n", "x0", "x1", "y0", "y1", "is_leaf"))
    deepest = slim.agg(F.max("level")).first()[0]
    rim, inside = slim.where("level = 0").select(F.col("cell").alias("f"), F.lit(0).cast("long").alias("base"), F.lit(float("inf")).alias("hi"), F.col("cell").alias("c")), []
    for level in range(1, deepest + 1):
        kids = slim.where((F.col("level") == level) | (F.col("is_leaf") & (F.col("level") < level)))
        kids = kids.withColumn("parent", F.when(F.col("level") == level, _parent(F.col("cell"))).otherwise(F.col("cell"))).drop("level", "is_leaf")
        focal = kids.select(F.col("parent").alias("f"), F.col("cell").alias("g"), *(F.col(a).alias(f"f_{a}") for a in ("x0", "x1", "y0", "y1")))
        other = kids.select(F.col("parent").alias("c"), F.col("cell").alias("d"), "n", "x0", "x1", "y0", "y1")
        near, far = _apart()
        pairs = rim.drop("hi").join(focal, "f").join(other, "c").select(F.col("g").alias("f"), "base", F.col("d").alias("c"), "n", near.alias("near"), far.alias("far"))
        pairs = _bounded(pairs, k, reach)
        within = (F.col("far") < F.col("lo") * (1 - _SLACK)) & (F.col("f") != F.col("c"))  # a cell stays with itself, so that none is lost
        pairs = pairs.where(within | (F.col("near") <= F.col("hi") * (1 + _SLACK))).select("f", "base", "hi", "c", "n", within.alias("within"))
        pairs = pairs.withColumn("base", F.col("base") + F.coalesce(F.sum(F.when(F.col("within"), F.col("n"))).over(Window.partitionBy("f")), F.lit(0)))
        now = kept(pairs.drop("n"))
        inside.append(now.where("within").select("f", "c"))
        rim = now.where(~F.col("within")).select("f", "base", "hi", "c")
    none = rim.select("f", "c").limit(0)
    return reduce(DataFrame.unionByName, inside, none), rim


def _moved(name: str, a: Column, b: Column) -> list[Column]:
    """The moments t_name about a centre that is (a, b) before the one they are about, in the order of _ORDERS."""
    s = {o: F.col(f"t_{name}")[k] for k, o in enumerate(_ORDERS)}
    e, two = a * a + b * b, s["xx"] + s["yy"]
    return [
        s["0"],
        s["x"] + a * s["0"],
        s["y"] + b * s["0"],
        s["xx"] + 2 * a * s["x"] + a * a * s["0"],
        s["xy"] + a * s["y"] + b * s["x"] + a * b * s["0"],
        s["yy"] + 2 * b * s["y"] + b * b * s["0"],
        s["x3"] + a * two + 2 * a * s["xx"] + 2 * b * s["xy"] + (2 * a * a + e) * s["x"] + 2 * a * b * s["y"] + e * a * s["0"],
        s["y3"] + b * two + 2 * b * s["yy"] + 2 * a * s["xy"] + (2 * b * b + e) * s["y"] + 2 * a * b * s["x"] + e * b * s["0"],
        s["4"] + 4 * (a * a * s["xx"] + 2 * a * b * s["xy"] + b * b * s["yy"]) + e * e * s["0"] + 4 * (a * s["x3"] + b * s["y3"]) + 2 * e * two + 4 * e * (a * s["x"] + b * s["y"]),
    ]


def _gathered(inside: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """(f, cx, cy, t_*): the moments of all cells within f's bandwidths, about the centre of f."""
    centre = nodes.select(F.col("cell").alias("f"), F.col("cx").alias("f_cx"), F.col("cy").alias("f_cy"))
    rows = inside.join(nodes.select(F.col("cell").alias("c"), "cx", "cy", *(f"t_{n}" for n in names)), "c").join(centre, "f")
    a, b = F.col("cx") - F.col("f_cx"), F.col("cy") - F.col("f_cy")
    moved = rows.select("f", "f_cx", "f_cy", *(c.alias(f"s_{n}_{j}") for n in names for j, c in enumerate(_moved(n, a, b))))
    sums = moved.groupBy("f", F.col("f_cx").alias("cx"), F.col("f_cy").alias("cy")).agg(*(F.sum(f"s_{n}_{j}").alias(f"s_{n}_{j}") for n in names for j in range(len(_ORDERS))))
    return sums.select("f", "cx", "cy", *(F.array(*(f"s_{n}_{j}" for j in range(len(_ORDERS)))).alias(f"t_{n}") for n in names))


def _weighed(b2: Column) -> Callable[[str], Column]:
    """For a place (px, py) and moments about (cx, cy), the sum of bisquare weights times a product."""
    u, v = F.col("px") - F.col("cx"), F.col("py") - F.col("cy")
    q = u * u + v * v

    def total(name: str) -> Column:
        s = {o: F.col(f"t_{name}")[k] for k, o in enumerate(_ORDERS)}
        two, along = s["xx"] + s["yy"], u * s["x"] + v * s["y"]
        second = q * s["0"] - 2 * along + two
        fourth = q * q * s["0"] + s["4"] + 4 * (u * u * s["xx"] + 2 * u * v * s["xy"] + v * v * s["yy"]) + 2 * q * two - 4 * q * along - 4 * (u * s["x3"] + v * s["y3"])
        return s["0"] - 2 * second / b2 + fourth / (b2 * b2)

    return total


def far_fit(obs: DataFrame, bandwidth: int | float, counts: bool | None = None, boundary: str = "next", strict: bool = False, leaf: int = 4) -> DataFrame:
    """local_fit with bisquare weights, for bandwidths that reach far: id, b0 .., fitted, resid, hat.

    The same rows and numbers, up to rounding. Rows without a place weigh on none and have no fit. An empty table gives none."""
    p, counts = n_terms(obs), isinstance(bandwidth, int) if counts is None else counts
    names = list(_products(p))
    placed, nodes = tree(obs, leaf)
    if "level" not in nodes.columns:  # no place at all
        sums = _focal(obs.limit(0), []).select("*", *(F.lit(0.0).alias(n) for n in names), F.lit(0).cast("long").alias("n_pos"), F.lit(1.0).alias("w_own"))
        return solved(sums, p, strict=strict).withColumnRenamed("i", "id")
    k = min(int(bandwidth), placed.agg(F.sum("n")).first()[0]) if counts else None
    inside, rim = descended(nodes, k, None if counts else float(bandwidth))

    focal = placed.select(F.col("leaf").alias("f"), F.col("px").alias("f_px"), F.col("py").alias("f_py"), F.col("depth").alias("f_depth"))
    other = placed.select(F.col("leaf").alias("c"), "px", "py", "n", *(f"z_{n}" for n in names))
    rows = rim.join(focal, "f").join(other, "c")
    dx, dy = F.col("f_px") - F.col("px"), F.col("f_py") - F.col("py")
    rows = rows.withColumn("d2", dx * dx + dy * dy)
    rows = rows.where(F.sqrt("d2") <= F.col("hi") * (1 + _SLACK)).drop("hi")
    by = Window.partitionBy("f_px", "f_py")
    if counts:
        upto = F.col("base") + F.sum("n").over(by.orderBy("d2"))
        rows = rows.withColumn("upto", upto)
        d = F.sqrt("d2")
        kth = F.min(F.when(F.col("upto") >= k, d)).over(by)
        least = F.coalesce(F.min(F.when(d > TINY, d)).over(by), F.lit(1.0))
        b = F.when(kth <= TINY, least).otherwise(kth) * (1.0000001 if boundary == "factor" else 1.0)
        rows = rows.withColumn("b2", F.pow(b, 2))
    else:
        rows = rows.withColumn("b2", F.lit(float(bandwidth) ** 2))
    w = F.when(F.col("d2") < F.col("b2"), F.pow(1 - F.col("d2") / F.col("b2"), 2)).otherwise(0.0)
    close = rows.withColumn("w", w).groupBy("f_px", "f_py").agg(
        F.first("b2").alias("b2"), F.first("f").alias("leaf"), F.first("f_depth").alias("depth"),
        (F.first("base") + F.sum(F.when(F.col("w") > 0, F.col("n")).otherwise(0))).alias("n_pos"), *(F.sum(F.col("w") * F.col(f"z_{n}")).alias(n) for n in names))
    close = kept(close.select(F.col("f_px").alias("px"), F.col("f_py").alias("py"), "b2", "leaf", "depth", "n_pos", *names))

    above = F.transform(F.sequence(F.lit(0), F.col("depth")), lambda up: _ancestor(F.col("leaf"), up))
    whole = close.select("px", "py", "b2", F.explode(above).alias("f")).join(_gathered(inside, nodes, names), "f")
    total = _weighed(F.col("b2"))
    whole = whole.groupBy("px", "py").agg(*(F.sum(total(n)).alias(f"w_{n}") for n in names))
    sums = close.join(whole, ["px", "py"], "left").select("px", "py", "n_pos", *((F.col(n) + F.coalesce(f"w_{n}", F.lit(0.0))).alias(n) for n in names))
    at = sums.select(F.col("px").alias("f_px"), F.col("py").alias("f_py"), "n_pos", F.lit(1.0).alias("w_own"), *names)
    return solved(_focal(obs, []).join(at, ["f_px", "f_py"]), p, strict=strict).withColumnRenamed("i", "id")


def _ancestor(cell: Column, up: Column) -> Column:
    """The cell so many levels above."""
    level, x, y = F.shiftright(cell, 50), F.shiftright(cell, 25).bitwiseAND((1 << 25) - 1), cell.bitwiseAND((1 << 25) - 1)
    half = F.pow(F.lit(2.0), up)
    return (level - up) * (1 << 50) + F.floor(x / half).cast("long") * (1 << 25) + F.floor(y / half).cast("long")
