"""The tables that the catalogue's queries run over: points, their lattice graph, two labelings.

Points come from the embeddings: place and regime from the id on a lattice of 25
columns, terms and noise from the vector, the response from the regime's slope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, local

SLOPES = {1: 2.0, 2: -1.0, 3: 0.5}
RADIUS = 6.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    px, py = (F.col("vec_id") % 25).cast("double"), F.floor(F.col("vec_id") / 25).cast("double")
    out = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), px.alias("px"), py.alias("py"), (10 * e(1)).alias("x1"), (10 * e(2)).alias("x2"), e(3).alias("noise"), F.col("label").cast("long").alias("label"))
    out = out.withColumn("regime", F.when(F.col("px") < 11, 1).when(F.col("py") % 20 >= 10, 2).otherwise(3).cast("long"))
    slope = F.when(F.col("regime") == 1, 2.0).when(F.col("regime") == 2, -1.0).otherwise(0.5)
    return out.withColumn("slope", slope).withColumn("yy", 1 + F.col("slope") * F.col("x1") + 0.5 * F.col("x2") + F.col("noise")).withColumn("other", (F.col("label") % 3 + 1).cast("long"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lattice_edges(points(spark, sf_dir))


def observed(spark: SparkSession, sf_dir: str, terms: tuple[str, ...] = ("x1",), keep: tuple[str, ...] = ("regime",)) -> DataFrame:
    return local.observations(points(spark, sf_dir), "yy", terms, keep=keep)


#: The same tables in DuckDB: pts, edges, and local fits of yy on x1.
PTS = """pts AS (
  SELECT *, 1 + slope * x1 + 0.5 * x2 + noise AS yy FROM (
    SELECT *, CASE regime WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN -1.0::DOUBLE ELSE 0.5::DOUBLE END AS slope FROM (
      SELECT *, (CASE WHEN px < 11 THEN 1 WHEN py % 20 >= 10 THEN 2 ELSE 3 END)::BIGINT AS regime FROM (
        SELECT vec_id AS id, (vec_id % 25)::DOUBLE AS px, floor(vec_id / 25)::DOUBLE AS py, 10 * embedding[2]::DOUBLE AS x1,
          10 * embedding[3]::DOUBLE AS x2, embedding[4]::DOUBLE AS noise, label::BIGINT AS label, (label % 3 + 1)::BIGINT AS other
        FROM embeddings))))"""
EDGES = """edges AS (
  SELECT a.id AS i, b.id AS j FROM pts a JOIN pts b ON a.id < b.id AND abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1)"""
PAIRS = """pairs AS (
  SELECT a.id AS i, b.id AS j, a.x1 AS fx, a.yy AS fy, a.regime AS fr, b.x1, b.yy, b.regime,
    (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) AS d2 FROM pts a, pts b)"""


def fit_sql(name: str, weighted: str) -> str:
    """A CTE of local fits of yy on an intercept and x1 over weighted (i, j, fx, fy, x1, yy, w)."""
    return f"""{name}_m AS (
  SELECT i, any_value(fx) AS fx, any_value(fy) AS fy, sum(w) AS a, sum(w * x1) AS b, sum(w * x1 * x1) AS c, sum(w * yy) AS p, sum(w * x1 * yy) AS q,
    sum(CASE WHEN i = j THEN w ELSE 0 END) AS own FROM ({weighted}) GROUP BY i),
{name}_b AS (SELECT *, (c * p - b * q) / (a * c - b * b) AS b0, (a * q - b * p) / (a * c - b * b) AS b1, own * (c - 2 * b * fx + a * fx * fx) / (a * c - b * b) AS hat FROM {name}_m),
{name} AS (SELECT i AS id, b0, b1, b0 + b1 * fx AS fitted, fy - (b0 + b1 * fx) AS resid, hat FROM {name}_b)"""


def reach_sql(k: str, part: str = "i", factor: float = 1.0, source: str = "pairs") -> str:
    """Pairs with bisquare weights out to the k-th nearest."""
    return f"""SELECT *, CASE WHEN d2 < b2 THEN pow(1 - d2 / b2, 2) ELSE 0 END AS w FROM (
  SELECT *, pow(max(CASE WHEN rn = least({k}, n) THEN sqrt(d2) END) OVER (PARTITION BY {part}) * {factor!r}, 2) AS b2 FROM (
    SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY d2, j) AS rn, count(*) OVER (PARTITION BY {part}) AS n FROM {source}))"""


FIXED = f"SELECT *, pow(1 - d2 / {RADIUS * RADIUS}, 2) AS w FROM pairs WHERE d2 < {RADIUS * RADIUS}"
