"""Queries of neighbour graphs and of labels on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, local, partition
from ..simulate import CORNERS, on_a_map
from .register import Register
from .tables import EDGES, PTS, edges, points

_r = Register()
QUERIES, ORACLES, query = _r.queries, _r.oracles, _r.add
R = "round({}, 6) + 0.0".format
CUT = "cut AS (SELECT e.i, e.j, a.regime AS ri, b.regime AS rj FROM edges e JOIN pts a ON a.id = e.i JOIN pts b ON b.id = e.j)"
BOTH = "both_ways AS (SELECT i, j FROM edges UNION ALL SELECT j, i FROM edges)"


@query("SELECT i, j FROM edges", ctes=(PTS, EDGES))
def lattice_queen_edges(spark, d):
    return edges(spark, d)


_SQUARES = "v AS (SELECT id AS area, px + dx AS vx, py + dy AS vy FROM pts, (VALUES (0), (1)) x(dx), (VALUES (0), (1)) y(dy))"


@query("SELECT DISTINCT a.area AS i, b.area AS j FROM v a JOIN v b USING (vx, vy) WHERE a.area < b.area", ctes=(PTS, _SQUARES))
def polygon_queen_edges(spark, d):
    steps = F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (0, 1) for b in (0, 1)))
    corners = points(spark, d).select("id", "px", "py", F.inline(steps)).select(F.col("id").alias("area"), (F.col("px") + F.col("dx")).alias("vx"), (F.col("py") + F.col("dy")).alias("vy"))
    return graph.contiguity_edges(corners)


_NEAR = "(SELECT a.id AS i, b.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY (a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py), b.id) AS r FROM pts a JOIN pts b ON a.id <> b.id)"


@query(f"SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM {_NEAR} WHERE r <= 8", ctes=(PTS,))
def knn_edges(spark, d):
    return graph.nearest_edges(points(spark, d), 8)


def _shaken(spark, d):
    return points(spark, d).withColumn("px", F.col("px") + F.col("x1") / 40).withColumn("py", F.col("py") + F.col("x2") / 40)


# An edge of the tree has no third point nearer to both of its ends than they are to each other, and no way round over shorter edges.
_TREE = f"""RECURSIVE {PTS}, sh AS (SELECT id, px + x1 / 40 AS px, py + x2 / 40 AS py FROM pts),
ws AS (SELECT a.id AS i, b.id AS j, sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) AS d FROM sh a JOIN sh b ON a.id < b.id AND abs(a.px - b.px) < 4 AND abs(a.py - b.py) < 4),
w2 AS (SELECT i, j, d FROM ws UNION ALL SELECT j, i, d FROM ws),
lune AS (SELECT w.i, w.j, w.d FROM ws w WHERE NOT EXISTS (SELECT 1 FROM w2 a JOIN w2 b ON a.j = b.j WHERE a.i = w.i AND b.i = w.j AND a.d < w.d AND b.d < w.d)),
l2 AS (SELECT i, j, d, i AS a, j AS b FROM lune UNION ALL SELECT j, i, d, i, j FROM lune),
round_ AS (SELECT i AS a, j AS b, d, i AS node FROM lune UNION SELECT r.a, r.b, r.d, l.j FROM round_ r JOIN l2 l ON l.i = r.node AND (l.d, l.a, l.b) < (r.d, r.a, r.b)),
tree AS (SELECT i, j, d FROM lune WHERE (i, j, j) NOT IN (SELECT a, b, node FROM round_))"""


@query(f"WITH {_TREE} SELECT i, j, {R('d')} AS d FROM tree")
def mst_edges(spark, d):
    return graph.spanning_tree(_shaken(spark, d))


_NEAR_SHAKEN = "(SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM w2)"


@query(f"WITH {_TREE} SELECT least(i, j) AS i, greatest(i, j) AS j FROM {_NEAR_SHAKEN} WHERE r <= 8 UNION SELECT i, j FROM tree")
def knn_mst_graph(spark, d):
    pts = _shaken(spark, d)
    return graph.canonical(graph.nearest_edges(pts, 8).unionByName(graph.spanning_tree(pts).select("i", "j")))


@query("SELECT id, (SELECT count(*) FROM both_ways b WHERE b.i = pts.id) AS degree FROM pts", ctes=(PTS, EDGES, BOTH))
def graph_degree(spark, d):
    return graph.degrees(points(spark, d), edges(spark, d))


_DEGREES = "deg AS (SELECT id, count(i) AS degree FROM pts LEFT JOIN both_ways b ON b.i = pts.id GROUP BY id)"


@query(f"SELECT count(*) AS n_nodes, (sum(degree) / 2)::BIGINT AS n_edges, count(CASE WHEN degree = 0 THEN 1 END) AS isolates, min(degree) AS degree_min, max(degree) AS degree_max, {R('avg(degree)')} AS degree_mean, median(degree) + 0.0 AS degree_median, {R('sum(degree) / (count(*) * (count(*) - 1.0))')} AS density FROM deg", ctes=(PTS, EDGES, BOTH, _DEGREES))
def graph_summary(spark, d):
    return graph.graph_summary(points(spark, d), edges(spark, d))


_WALK = """RECURSIVE pts0 AS (SELECT 1), {pts}, {edges}, {cut}, near AS (SELECT i, j FROM cut WHERE ri = rj UNION ALL SELECT j, i FROM cut WHERE ri = rj),
walk AS (SELECT id AS node, id AS root FROM pts UNION SELECT n.j, w.root FROM walk w JOIN near n ON n.i = w.node WHERE n.j > w.root)"""


@query(f"WITH {_WALK.format(pts=PTS, edges=EDGES, cut=CUT)} SELECT node, min(root) AS root FROM walk GROUP BY node")
def connected_components(spark, d):
    pts, e = points(spark, d), edges(spark, d)
    return graph.components(pts, graph.cut_edges(e, pts).where("not cut"))


@query(f"WITH {_WALK.format(pts=PTS, edges=EDGES, cut=CUT)} SELECT regime, count(*) AS n, count(DISTINCT root) AS parts, count(DISTINCT root) = 1 AS connected FROM (SELECT node, min(root) AS root FROM walk GROUP BY node) JOIN pts ON id = node GROUP BY regime")
def regimes_connected(spark, d):
    return graph.regimes_connected(edges(spark, d), points(spark, d))


_WITHOUT = f"""RECURSIVE {PTS}, {EDGES}, {CUT}, near AS (SELECT i, j, ri AS regime FROM cut WHERE ri = rj UNION ALL SELECT j, i, ri FROM cut WHERE ri = rj),
size AS (SELECT regime, count(*) AS n FROM pts GROUP BY regime),
two AS (SELECT regime, min(id) AS one, (SELECT min(q.id) FROM pts q WHERE q.regime = p.regime AND q.id > min(p.id)) AS next_one FROM pts p GROUP BY regime),
left_ AS (SELECT id AS gone, CASE WHEN id = one THEN next_one ELSE one END AS node FROM pts JOIN two USING (regime) UNION SELECT l.gone, n.j FROM left_ l JOIN near n ON n.i = l.node WHERE n.j <> l.gone),
hit AS (SELECT gone, count(*) AS n FROM left_ GROUP BY gone)"""


@query(f"WITH {_WITHOUT} SELECT p.regime, count(CASE WHEN s.n > 2 AND h.n < s.n - 1 THEN 1 END) AS n_critical FROM pts p JOIN size s USING (regime) JOIN hit h ON h.gone = p.id GROUP BY p.regime")
def critical_nodes(spark, d):
    each = graph.critical_nodes(points(spark, d), edges(spark, d))
    return each.groupBy("regime").agg(F.sum(F.col("critical").cast("long")).alias("n_critical"))


@query(f"WITH {_WITHOUT} SELECT p.id, p.regime, s.n, s.n > 2 AND h.n < s.n - 1 AS critical, s.n > 25 AND h.n = s.n - 1 AS may_leave FROM pts p JOIN size s USING (regime) JOIN hit h ON h.gone = p.id")
def removable_nodes(spark, d):
    """Each row with whether its regime falls apart without it, and whether it may leave a regime that must keep 25 rows in one piece."""
    each = graph.critical_nodes(points(spark, d), edges(spark, d))
    return each.withColumn("may_leave", (F.col("n") > 25) & ~F.col("critical"))


_LACE = "lace AS (SELECT i, j FROM edges WHERE (i * 31 + j * 17) % 5 < 2)"
_LACE_ENDS = f"""RECURSIVE {PTS}, {EDGES}, {_LACE}, near AS (SELECT i, j FROM lace UNION ALL SELECT j, i FROM lace),
walk AS (SELECT id AS node, id AS root FROM pts UNION SELECT n.j, w.root FROM walk w JOIN near n ON n.i = w.node WHERE n.j > w.root),
comp AS (SELECT node, min(root) AS root FROM walk GROUP BY node), size AS (SELECT root, count(*) AS n FROM comp GROUP BY root),
rest AS (SELECT node, root, (SELECT min(q.node) FROM comp q WHERE q.root = c.root AND q.node <> c.node) AS one FROM comp c),
left_ AS (SELECT node AS gone, one AS node FROM rest WHERE one IS NOT NULL UNION SELECT l.gone, n.j FROM left_ l JOIN near n ON n.i = l.node WHERE n.j <> l.gone),
hit AS (SELECT gone, count(*) AS n FROM left_ GROUP BY gone)"""


@query(f"WITH {_LACE_ENDS} SELECT c.node, c.root, coalesce(h.n < s.n - 1, false) AS splits FROM comp c JOIN size s USING (root) LEFT JOIN hit h ON h.gone = c.node")
def articulation_points(spark, d):
    """Of the lattice's edges two in five are taken, so that parts, bridges and blocks of every size come up."""
    lace = edges(spark, d).where("(i * 31 + j * 17) % 5 < 2")
    return graph.articulation_points(points(spark, d), lace)


_SHARES = "sh AS (SELECT id, (px - min(px) OVER ()) / (max(px) OVER () - min(px) OVER ()) AS u, (py - min(py) OVER ()) / (max(py) OVER () - min(py) OVER ()) AS v FROM pts)"
_PICKS = ", ".join(f"t{r} AS (SELECT id FROM sh {f'WHERE id NOT IN ({prior})' if (prior := ' UNION ALL '.join(f'SELECT id FROM t{q}' for q in range(1, r))) else ''} ORDER BY pow(u - {x}, 2) + pow(v - {y}, 2), id LIMIT 1)" for r, (x, y) in enumerate(CORNERS, 1))


@query(" UNION ALL ".join(f"SELECT id, {r}::BIGINT AS regime FROM t{r}" for r in range(1, len(CORNERS) + 1)), ctes=(PTS, _SHARES, _PICKS))
def nearest_seeds(spark, d):
    return partition.nearest_seeds(points(spark, d), CORNERS)


@query()
def grown_map(spark, d):
    """Regimes grown from seeds near the corners, and a response with their coefficients."""
    seeds = partition.nearest_seeds(points(spark, d), CORNERS).withColumn("instance", F.lit("map"))
    return on_a_map(points(spark, d), partition.breadth_first(seeds, edges(spark, d), points(spark, d)))


_SPREAD = f"""RECURSIVE {PTS}, {EDGES}, near AS (SELECT i, j FROM edges UNION ALL SELECT j, i FROM edges), one AS (SELECT min(id) AS id, regime FROM pts GROUP BY regime),
walk AS (SELECT id, regime AS seed, 0 AS far FROM one UNION SELECT n.j, w.seed, w.far + 1 FROM walk w JOIN near n ON n.i = w.id WHERE w.far < (SELECT max(px) + max(py) FROM pts))"""


@query(f"WITH {_SPREAD} SELECT 'lattice' AS instance, id, arg_min(seed, far * 1000 + seed) AS regime FROM walk GROUP BY id")
def multi_source_bfs(spark, d):
    """The label of the seed nearest over edges, the smallest on ties."""
    pts = points(spark, d)
    seeds = pts.groupBy("regime").agg(F.min("id").alias("id")).withColumn("instance", F.lit("lattice"))
    return partition.breadth_first(seeds, edges(spark, d), pts)


@query("SELECT i, j, ri AS regime_i, rj AS regime_j, ri <> rj AS cut FROM cut", ctes=(PTS, EDGES, CUT))
def boundary_edges(spark, d):
    return graph.cut_edges(edges(spark, d), points(spark, d))


@query("SELECT DISTINCT unnest([i, j]) AS id FROM cut WHERE ri <> rj", ctes=(PTS, EDGES, CUT))
def boundary_nodes(spark, d):
    return graph.boundary_nodes(edges(spark, d), points(spark, d))


@query("SELECT least(ri, rj) AS a, greatest(ri, rj) AS b, count(*) AS n FROM cut WHERE ri <> rj GROUP BY 1, 2", ctes=(PTS, EDGES, CUT))
def regime_pair_boundary(spark, d):
    return graph.regime_borders(edges(spark, d), points(spark, d))


@query("SELECT regime, count(CASE WHEN ri = rj THEN 1 END) AS internal, count(CASE WHEN ri <> rj THEN 1 END) AS incident_boundary FROM cut JOIN (SELECT DISTINCT regime FROM pts) r ON regime IN (ri, rj) GROUP BY regime", ctes=(PTS, EDGES, CUT))
def internal_external_edges(spark, d):
    return graph.regime_edges(edges(spark, d), points(spark, d))


@query("""SELECT t.id, target, count(CASE WHEN p.regime <> target THEN 1 END) AS n FROM (
  SELECT id, regime AS target FROM pts UNION SELECT b.i, p.regime FROM both_ways b JOIN pts p ON p.id = b.j) t
  LEFT JOIN both_ways b ON b.i = t.id LEFT JOIN pts p ON p.id = b.j GROUP BY t.id, target""", ctes=(PTS, EDGES, BOTH))
def neighbour_disagreement(spark, d):
    return graph.disagreement(edges(spark, d), points(spark, d))


@query(f"SELECT rss AS rss, cuts, {R('rss + 0.5 * cuts')} AS objective FROM (SELECT {R('sum(pow(yy - fit, 2))')} AS rss, (SELECT count(*) FROM cut WHERE ri <> rj) AS cuts FROM pts JOIN (SELECT regime, regr_intercept(yy, x1) AS b0, regr_slope(yy, x1) AS b1 FROM pts GROUP BY regime) USING (regime), LATERAL (SELECT b0 + b1 * x1 AS fit))", ctes=(PTS, EDGES, CUT))
def cut_objective(spark, d):
    pts = points(spark, d)
    coef = local.ols(local.observations(pts, "yy", ["x1"], keep=["regime"]), ["regime"])
    rss = pts.join(coef, "regime").agg(F.sum(F.pow(F.col("yy") - F.col("b0") - F.col("b1") * F.col("x1"), 2)).alias("rss"))
    cuts = graph.cut_edges(edges(spark, d), pts).agg(F.sum(F.col("cut").cast("long")).alias("cuts"))
    return rss.crossJoin(cuts).withColumn("objective", F.round("rss", 6) + 0.5 * F.col("cuts"))  # one row each


@query("SELECT a.id AS i, " + ", ".join(f"max(CASE WHEN b.j = {k} THEN 1 ELSE 0 END)::INT AS \"{k}\"" for k in range(20)) + " FROM pts a LEFT JOIN both_ways b ON b.i = a.id WHERE a.id < 20 GROUP BY a.id", ctes=(PTS, EDGES, BOTH))
def adjacency_preview(spark, d):
    """The matrix's first 20 rows and columns: a preview by definition."""
    return graph.adjacency_wide(edges(spark, d), range(20))
