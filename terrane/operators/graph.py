"""Neighbour graphs as edge tables (i, j) with i < j, and what is read from them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio
from ..tables import dropped, kept
from .local import near_pairs


#: Rows from which on a side of a join isn't left to Spark's own choice.
MANY = 1 << 14


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join that has so many rows. Spark judges a kept table by its files, where long tables of numbers are small, and would
    send it to all tasks through the driver, round by round: from MANY rows on both sides are sorted instead."""
    return df.hint("merge") if rows >= MANY else df


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected edges once each, i < j, without loops."""
    return edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def lattice_edges(cells: DataFrame, x: str = "px", y: str = "py", key: str = "id") -> DataFrame:
    """Edges between cells of a whole-numbered grid that share a side or a corner."""
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))))
    near = cells.select(F.col(key).alias("a"), (F.col(x).cast("long")).alias("x"), F.col(y).cast("long").alias("y"))
    asks = near.withColumn("s", F.explode(steps)).select("a", (F.col("x") + F.col("s.a")).alias("x"), (F.col("y") + F.col("s.b")).alias("y"))
    return canonical(asks.join(near.withColumnRenamed("a", "b"), ["x", "y"]).select(F.col("a").alias("i"), F.col("b").alias("j")))


def contiguity_edges(vertices: DataFrame, key: str = "area", x: str = "vx", y: str = "vy") -> DataFrame:
    """Edges between areas whose outlines (key, vertex) share a vertex."""
    once = vertices.select(key, x, y).distinct()
    return canonical(once.select(F.col(key).alias("i"), x, y).join(once.select(F.col(key).alias("j"), x, y), [x, y]))


def nearest_edges(points: DataFrame, k: int, x: str = "px", y: str = "py", key: str = "id") -> DataFrame:
    """Edges from each point to its k nearest others, ties to the smaller key, either way. Of points at one place the first k + 1 are asked for, as no
    other can be among anyone's nearest."""
    at = Window.partitionBy(x, y).orderBy(key)
    few = points.withColumn("nth", F.row_number().over(at)).where(F.col("nth") <= k + 1).drop("nth")
    a = points.select(F.col(key).alias("i"), F.col(x).alias(f"f_{x}"), F.col(y).alias(f"f_{y}"))
    b = few.select(F.col(key).alias("j"), x, y)
    d2 = F.pow(F.col(f"f_{x}") - F.col(x), 2) + F.pow(F.col(f"f_{y}") - F.col(y), 2)
    found = near_pairs(a, b, k + 1, few, x, y).where("i <> j")
    return canonical(found.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(d2, "j"))).where(F.col("r") <= k))


def _ways(points: DataFrame, comp: DataFrame, radius: float) -> DataFrame:
    """(i, j, d) of points (node, x, y) of different components that are up to radius apart, points at one place aside.

    Cells are as wide as the radius. Points whose own and surrounding cells belong to one component have no way out and are left out."""
    placed = points.join(comp, "node").select("node", "root", "x", "y", F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    around = lambda df: df.withColumn("s", F.explode(steps)).withColumn("cx", F.col("cx") + F.col("s.a")).withColumn("cy", F.col("cy") + F.col("s.b")).drop("s")
    roots = placed.groupBy("cx", "cy").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed = around(roots).groupBy("cx", "cy").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("cx", "cy")
    rim = placed.join(mixed, ["cx", "cy"])
    a = around(rim.select(F.col("node").alias("i"), F.col("root").alias("ri"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy"))
    b = rim.select(F.col("node").alias("j"), F.col("root").alias("rj"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy")
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return a.join(b, ["cx", "cy"]).where("i < j and ri <> rj").select("i", "j", d.alias("d")).where((F.col("d") > 0) & (F.col("d") <= radius))


def _boruvka(ways: DataFrame, comp: DataFrame, tree: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The tree's edges (i, j, d) and components (node, root) after all rounds over ways (i, j, d, ri, rj) between components: each takes
    its least way out, and components that meet become one. ways, comp and tree are removed."""
    while True:
        each = ways.select(F.explode(F.array("ri", "rj")).alias("root"), F.struct("d", "i", "j", "ri", "rj").alias("e"))
        chosen = kept(each.groupBy("root").agg(F.min("e").alias("e")).select("e.*").distinct())
        if tree is None:
            tree = chosen.select("i", "j", "d")
        rows = 2 * chosen.count()  # roots that may get another
        if not rows:
            dropped(ways)
            return tree, comp
        tree, before = kept(tree.unionByName(chosen.select("i", "j", "d")).distinct()), (tree, ways, comp)
        # components of components: their nodes are the roots, and the edges those just chosen
        new = kept(components(chosen.select(F.explode(F.array("ri", "rj")).alias("id")).distinct(), chosen.select(F.col("ri").alias("i"), F.col("rj").alias("j"))))
        to = lambda c: new.select(F.col("node").alias(c), F.col("root").alias(f"{c}_new"))  # noqa: B023, E731
        comp = kept(comp.join(_sized(to("root"), rows), "root", "left").select("node", F.coalesce("root_new", "root").alias("root")))
        moved = ways.join(_sized(to("ri"), rows), "ri", "left").join(_sized(to("rj"), rows), "rj", "left")
        ways = kept(moved.select("i", "j", "d", F.coalesce("ri_new", "ri").alias("ri"), F.coalesce("rj_new", "rj").alias("rj")).where("ri <> rj"))
        dropped(*before, chosen, new)


def spanning_tree(points: DataFrame, x: str = "px", y: str = "py", key: str = "id") -> DataFrame:
    """Edges (i, j, d) of the minimum spanning tree. Points at the same place aren't linked to each other directly.

    Short edges first: the tree's edges up to a radius are those of the graph of all such ways, found by Borůvka's rounds
    (each component takes its shortest way out, and components that meet become one); then the radius grows, and only
    points near another component ask."""
    at = points.select(F.col(key).alias("node"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ends = at.agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    comp, tree = at.select("node", F.col("node").alias("root")), None
    flat = max(ends.w or 0.0, ends.h or 0.0)
    radius = 2.5 * math.sqrt(max(ends.w, flat / ends.n) * max(ends.h, flat / ends.n) / ends.n) if flat else 1.0
    while True:
        ways = kept(_ways(at, comp, radius).join(comp.select(F.col("node").alias("i"), F.col("root").alias("ri")), "i").join(comp.select(F.col("node").alias("j"), F.col("root").alias("rj")), "j"))
        tree, comp = _boruvka(ways, comp, tree)
        if radius > 2 * flat or comp.select("root").distinct().limit(2).count() < 2:
            return tree
        radius *= 3


def components(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating star contractions."""
    hung = kept(canonical(edges).select(F.col("j").alias("a"), F.col("i").alias("b")))
    rows = hung.count()  # rounds don't make more of them
    while not _stars(hung, rows):
        both = hung.unionByName(hung.select(F.col("b").alias("a"), F.col("a").alias("b")))
        before, low = hung, both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(_sized(low, rows), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(_sized(floor, rows), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        hung = kept(moved.unionByName(floor.select("a", F.col("m").alias("b"))).distinct())
        dropped(before)
    roots = _sized(hung.select(F.col("a").alias("node"), F.col("b").alias("root")), rows)
    return nodes.select(F.col(key).alias("node")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _stars(hung: DataFrame, rows: int) -> bool:
    """Whether every node (a) hangs under one other (b), which hangs under none."""
    once = hung.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    under = hung.select(F.col("b").alias("a")).distinct().withColumn("holds", F.lit(True))
    return once.join(_sized(under, rows), "a", "left").where("n > 1 or holds").isEmpty()


def spanning_forest(nodes: DataFrame, edges: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """A tree (i, j) of each component of the graph, and (node, root) with root its smallest node."""
    ways = kept(canonical(edges).select("i", "j", F.lit(0).alias("d"), F.col("i").alias("ri"), F.col("j").alias("rj")))
    tree, comp = _boruvka(ways, nodes.select(F.col(key).alias("node"), F.col(key).alias("root")), None)
    return tree.select("i", "j"), comp


def _tour(tree: DataFrame, comp: DataFrame) -> DataFrame:
    """(node, parent, root, pre, last): where a walk around each tree, from its root, comes to a node and leaves it; a subtree is what is
    come to from pre up to last. The root comes at 0 and has no parent.

    After the step u to v the walk goes to v's neighbour that follows u, the first after the last one. Steps to the end are counted
    by jumping: each round doubles what a step looks past, and a step is asked for by one other only."""
    at, rows = Window.partitionBy("i").orderBy("j"), 2 * tree.count()
    around = both_ways(tree).withColumn("after", F.lead("j").over(at)).join(_sized(comp.select(F.col("node").alias("i"), "root"), rows), "i")
    first = both_ways(tree).groupBy("i").agg(F.min("j").alias("first"))
    follows = F.when(F.col("after").isNotNull() | (F.col("i") != F.col("root")), F.coalesce("after", "first"))
    # a row (i, j) tells what follows the step from j to i
    steps = around.join(_sized(first, rows), "i").select(F.col("j").alias("a"), F.col("i").alias("b"), "root", F.when(follows.isNotNull(), F.col("i")).alias("na"), follows.alias("nb"))
    steps = kept(steps.withColumn("left", F.when(F.col("na").isNull(), 0).otherwise(1).cast("long")))
    while not steps.where("na is not null").isEmpty():
        before = steps
        for _ in range(2):
            ahead = steps.select(F.col("a").alias("na"), F.col("b").alias("nb"), F.col("na").alias("ma"), F.col("nb").alias("mb"), F.col("left").alias("more"))
            jumped = steps.where("na is not null").join(_sized(ahead, rows), ["na", "nb"]).select("a", "b", "root", F.col("ma").alias("na"), F.col("mb").alias("nb"), (F.col("left") + F.col("more")).alias("left"))
            steps = jumped.unionByName(steps.where("na is null"))
        steps = kept(steps)
        dropped(before)
    whole = comp.groupBy("root").agg((2 * (F.count(F.lit(1)) - 1)).alias("size"))
    pairs = steps.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "root").agg(F.max(F.struct("left", "a", "b")).alias("down"), F.min("left").alias("up"))
    below = pairs.join(_sized(whole, rows), "root").select(F.col("down.b").alias("node"), F.col("down.a").alias("parent"), "root", (F.col("size") - F.col("down.left")).alias("pre"), (F.col("size") - F.col("up")).alias("last"))
    tops = whole.select(F.col("root").alias("node"), F.lit(None).cast(tree.schema["i"].dataType).alias("parent"), "root", F.lit(0).cast("long").alias("pre"), (F.col("size") + 1).alias("last"))
    out = kept(below.unionByName(tops))
    dropped(steps)
    return out


#: Bits of a place that a level of blocks leaves out.
LEVEL = 4


def _reach(tour: DataFrame, others: DataFrame) -> DataFrame:
    """(node, low, high): the least and greatest place that a node's subtree holds or has an edge (i, j of others) to.

    Least and greatest are kept for blocks of 1, 16, 256 .. places; a subtree's places are covered by at most 30 blocks a level."""
    rows = tour.count()
    place = _sized(tour.select(F.col("node").alias("j"), "pre"), rows)
    own = tour.select("node", F.col("pre").alias("lo"), F.col("pre").alias("hi"))
    each = own.unionByName(both_ways(others).join(place, "j").select(F.col("i").alias("node"), F.col("pre").alias("lo"), F.col("pre").alias("hi")))
    each = each.groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).join(_sized(tour.select("node", "root", "pre"), rows), "node")
    top = int(tour.agg(F.max("last")).first()[0] or 0).bit_length() // LEVEL
    levels = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")
    shift = lambda c, l: F.expr(f"shiftright({c}, {LEVEL} * {l})")  # noqa: E731, E741
    up = lambda l: F.expr(f"shiftright(pre + shiftleft(1L, {LEVEL} * {l}) - 1, {LEVEL} * {l})")  # noqa: E731, E741
    blocks = each.select("root", "pre", "lo", "hi", levels).groupBy("root", "level", shift("pre", "level").alias("block")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    cover = tour.select("node", "root", "pre", "last", levels).select("node", "root", "level", up("level").alias("a"), shift("last", "level").alias("b"), up("(level + 1)").alias("a1"), shift("last", "(level + 1)").alias("b1")).where("a < b")
    wide = 1 << LEVEL
    cover = cover.select("node", "root", "level", F.explode(F.when((F.col("a1") < F.col("b1")) & (F.col("level") < top), F.concat(run(F.col("a"), wide * F.col("a1")), run(wide * F.col("b1"), F.col("b")))).otherwise(run(F.col("a"), F.col("b")))).alias("block"))
    return cover.join(_sized(blocks, rows), ["root", "level", "block"]).groupBy("node").agg(F.min("lo").alias("low"), F.max("hi").alias("high"))


def articulation_points(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """(node, root, splits): each node's component, by its smallest node, and whether the component falls apart without the node.

    Edges of a spanning forest lie in one block (no node splits it) if an edge outside the forest spans both: such links between tree
    edges, each named by its lower end, are read off the places of a walk around the trees, and blocks are their components. A node
    splits where its tree edges are of several blocks. Rounds grow with the logarithm of the nodes, whatever the graph's width; the
    neighbours of one node are sorted in one task, which spills. Loops and repeated edges don't matter; no nodes give no rows."""
    tree, comp = spanning_forest(nodes.select(key).distinct(), edges, key)
    tour = _tour(tree, comp)
    rows = tour.count()
    others = kept(canonical(edges).join(_sized(tree, rows), ["i", "j"], "left_anti"))
    ends = with_ends(others, _sized(tour.withColumnRenamed("node", "id"), rows), ["pre", "last"])
    apart = ends.where("last_i < pre_j or last_j < pre_i").select("i", "j")
    above = tour.select(F.col("node").alias("parent"), F.col("parent").alias("above"), F.col("pre").alias("p"), F.col("last").alias("l"))
    held = tour.join(_sized(_reach(tour, others), rows), "node").join(_sized(above, rows), "parent")
    along = held.where("above is not null and (low < p or high > l)").select(F.col("parent").alias("i"), F.col("node").alias("j"))
    hung = tour.where("parent is not null").select("node", "parent")
    block = components(hung, apart.unionByName(along), "node").withColumnRenamed("root", "block").join(_sized(hung, rows), "node")
    met = block.select(F.explode(F.array("node", "parent")).alias("node"), "block").groupBy("node").agg((F.min("block") < F.max("block")).alias("splits"))
    out = kept(comp.join(_sized(met, rows), "node", "left").select("node", "root", F.coalesce("splits", F.lit(False)).alias("splits")))
    dropped(tour, others, comp)
    return out


def critical_nodes(labels: DataFrame, edges: DataFrame, regime: str = "regime") -> DataFrame:
    """(id, regime, n, critical): whether what is left of a row's regime (of n rows) lies in several parts without it. Nothing is critical in
    regimes of up to two rows; in a regime of two parts all but a row that is a part by itself, in one of more parts every row."""
    inside = cut_edges(edges, labels, regime).where("not cut").select("i", "j")
    each = kept(articulation_points(labels, inside).join(labels.select(F.col("id").alias("node"), regime), "node"))
    part = each.groupBy(regime, "root").agg(F.count(F.lit(1)).alias("part_n"))
    size = part.groupBy(regime).agg(F.sum("part_n").alias("n"), F.count(F.lit(1)).alias("parts"))
    bad = F.when(F.col("n") <= 2, False).when(F.col("parts") == 1, F.col("splits")).otherwise((F.col("parts") > 2) | (F.col("part_n") > 1))
    return each.join(part, [regime, "root"]).join(size, regime).select(F.col("node").alias("id"), regime, "n", bad.alias("critical"))


def degrees(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    counts = both_ways(edges).groupBy(F.col("i").alias(key)).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select(key).join(counts, key, "left").select(key, F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def graph_summary(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """One row: nodes, edges, density, isolates and the degrees' min, max, mean and median."""
    d = degrees(nodes, edges, key)
    out = d.agg(F.count(F.lit(1)).alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.sum(F.when(F.col("degree") == 0, 1).otherwise(0)).cast("long").alias("isolates"), F.min("degree").alias("degree_min"), F.max("degree").alias("degree_max"), F.avg("degree").alias("degree_mean"), F.median("degree").alias("degree_median"))
    return out.withColumn("density", safe_ratio(2.0 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)))


def with_ends(edges: DataFrame, values: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Edges with the columns of both ends, as c_i and c_j."""
    side = lambda s: values.select(F.col(key).alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns))
    return edges.join(side("i"), "i").join(side("j"), "j")


def cut_edges(edges: DataFrame, labels: DataFrame, regime: str = "regime") -> DataFrame:
    """Edges with both labels and whether they differ (cut)."""
    return with_ends(edges, labels, [regime]).withColumn("cut", F.col(f"{regime}_i") != F.col(f"{regime}_j"))


def boundary_nodes(edges: DataFrame, labels: DataFrame, regime: str = "regime") -> DataFrame:
    return cut_edges(edges, labels, regime).where("cut").select(F.explode(F.array("i", "j")).alias("id")).distinct()


def regime_borders(edges: DataFrame, labels: DataFrame, regime: str = "regime") -> DataFrame:
    """(a, b, n): cut edges of each pair of regimes that meet."""
    c = cut_edges(edges, labels, regime).where("cut")
    return c.groupBy(F.least(f"{regime}_i", f"{regime}_j").alias("a"), F.greatest(f"{regime}_i", f"{regime}_j").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def regime_edges(edges: DataFrame, labels: DataFrame, regime: str = "regime") -> DataFrame:
    """(regime, internal, incident_boundary): edges within each regime and cut edges at it."""
    c = cut_edges(edges, labels, regime)
    ends = c.select(F.explode(F.array_distinct(F.array(f"{regime}_i", f"{regime}_j"))).alias(regime), "cut")
    return ends.groupBy(regime).agg(F.sum(F.when(~F.col("cut"), 1).otherwise(0)).cast("long").alias("internal"), F.sum(F.when(F.col("cut"), 1).otherwise(0)).cast("long").alias("incident_boundary"))


def regimes_connected(edges: DataFrame, labels: DataFrame, regime: str = "regime") -> DataFrame:
    """(regime, n, parts, connected): in how many parts each regime lies."""
    inside = cut_edges(edges, labels, regime).where("not cut").select("i", "j")
    parts = components(labels, inside).join(labels.select(F.col("id").alias("node"), regime), "node")
    out = parts.groupBy(regime).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("root").alias("parts"))
    return out.withColumn("connected", F.col("parts") == 1)


def disagreement(edges: DataFrame, labels: DataFrame, regime: str = "regime") -> DataFrame:
    """(id, target, n): for each node and each label at it or beside it, the neighbours that have another."""
    near = both_ways(edges).join(labels.select(F.col("id").alias("j"), F.col(regime).alias("other")), "j")
    own = labels.select(F.col("id").alias("i"), F.col(regime).alias("target"))
    targets = near.select("i", F.col("other").alias("target")).unionByName(own).distinct()
    out = targets.join(near, "i", "left").groupBy(F.col("i").alias("id"), "target")
    return out.agg(F.sum(F.when(F.col("other") != F.col("target"), 1).otherwise(0)).cast("long").alias("n"))


def adjacency_wide(edges: DataFrame, keys: Sequence[int]) -> DataFrame:
    """The adjacency matrix of the given nodes, a row and a column each."""
    some = both_ways(edges).where(F.col("i").isin(list(keys)) & F.col("j").isin(list(keys)))
    grid = edges.sparkSession.createDataFrame([(int(k),) for k in keys], "i long")
    return grid.join(some, "i", "left").groupBy("i").pivot("j", list(keys)).agg(F.max(F.lit(1))).fillna(0)
