"""Rasters, points and polygons derived from the driver's tables by the same arithmetic in Spark and in SQL.

orders is a dense grid of width 125: row = o_orderkey div 125. Every computed double is rounded to six digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import GridSpec

WIDTH = 125
PIXEL = 240.0

#: The region rings of the queries, in metres of the grid: quadrilaterals of different shape (fixed values).
RINGS = {
    "alpha": [(1000.0, -1000.0), (9000.0, -2500.0), (8000.0, -9000.0), (1500.0, -7000.0)],
    "beta": [(12000.0, -500.0), (20000.0, -4000.0), (15000.0, -9500.0), (11000.0, -6000.0)],
    "gamma": [(3000.0, -12000.0), (14000.0, -11000.0), (16000.0, -20000.0), (2000.0, -18000.0)],
    "delta": [(21000.0, -12000.0), (28500.0, -14000.0), (25000.0, -27000.0), (19000.0, -20000.0)],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(height: int = 1 << 20) -> GridSpec:
    return GridSpec(0.0, 0.0, PIXEL, height, WIDTH)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.expr(f"o_orderkey div {WIDTH}").alias("row"),
        (k % WIDTH).alias("col"),
        F.when(k % 97 != 0, F.col("o_totalprice") / 16384).alias("z"),
        (c * 7919 % 101 / F.lit(100.0)).alias("illum"),
        (c * 104729 % 25 / F.lit(24.0)).alias("los"),
        F.when(k % 89 != 0, (40 + k * 31 % 161).cast("double")).alias("tmax"),
        (c * 13 % 80).cast("double").alias("density"),
        (c % 97 / F.lit(2.0)).alias("scarp_km"),
        (F.floor(F.expr(f"o_orderkey div {WIDTH}") / 40) * 10 + F.floor(k % WIDTH / 42)).cast("long").alias("region"),
    )


CELLS = f"""cells AS (
  SELECT o_orderkey // {WIDTH} AS "row", o_orderkey % {WIDTH} AS col,
    CASE WHEN o_orderkey % 97 <> 0 THEN o_totalprice / 16384 END AS z,
    (o_custkey * 7919 % 101) / 100.0::DOUBLE AS illum, (o_custkey * 104729 % 25) / 24.0::DOUBLE AS los,
    CASE WHEN o_orderkey % 89 <> 0 THEN (40 + o_orderkey * 31 % 161)::DOUBLE END AS tmax,
    (o_custkey * 13 % 80)::DOUBLE AS density, (o_custkey % 97) / 2.0::DOUBLE AS scarp_km,
    ((o_orderkey // {WIDTH}) // 40) * 10 + (o_orderkey % {WIDTH}) // 42 AS region
  FROM orders)"""

X, Y = "(col + 0.5) * 240.0", "-(\"row\" + 0.5) * 240.0"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points on the grid."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("b_id"), ((k * 137508 % 125000) * 0.24).alias("x"), (-(k * 61803 % 120000) * 0.24).alias("y"), F.col("c_acctbal").alias("value"))


POINTS = "points AS (SELECT c_custkey AS b_id, (c_custkey * 137508 % 125000) * 0.24::DOUBLE AS x, -(c_custkey * 61803 % 120000) * 0.24::DOUBLE AS y, c_acctbal AS value FROM customer)"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sites on the grid, with a zone."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("a_id"), ((k * 7907 % 30000).cast("double")).alias("x"), (-(k * 3571 % 28800)).cast("double").alias("y"), F.concat(F.lit("zone"), (k % 7).cast("string")).alias("region"))


SITES = "sites AS (SELECT s_suppkey AS a_id, (s_suppkey * 7907 % 30000)::DOUBLE AS x, (-(s_suppkey * 3571 % 28800))::DOUBLE AS y, 'zone' || (s_suppkey % 7) AS region FROM supplier)"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as another catalog's sites, with lit days of two years."""
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(k.alias("b_id"), (k * 1187 % 30000).cast("double").alias("x"), (-(k * 2753 % 28800)).cast("double").alias("y"), F.concat(F.lit("zone"), (k % 9).cast("string")).alias("region"), (k * 5 % 23).alias("SunDays25"), (k * 7 % 19).alias("Sundays30"))


CATALOG = "catalog AS (SELECT n_nationkey::BIGINT AS b_id, (n_nationkey::BIGINT * 1187 % 30000)::DOUBLE AS x, (-(n_nationkey::BIGINT * 2753 % 28800))::DOUBLE AS y, 'zone' || (n_nationkey % 9) AS region, n_nationkey::BIGINT * 5 % 23 AS d25, n_nationkey::BIGINT * 7 % 19 AS d30 FROM nation)"


def polygons(spark: SparkSession) -> DataFrame:
    rows = [(i, name, [{"x": x, "y": y} for x, y in ring]) for i, (name, ring) in enumerate(RINGS.items())]
    return spark.createDataFrame(rows, "ordinal long, region string, ring array<struct<x: double, y: double>>")


def _edges_sql() -> str:
    rows = [f"({i}, '{name}', {a[0]}, {a[1]}, {b[0]}, {b[1]})" for i, (name, ring) in enumerate(RINGS.items()) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    return "edges AS (SELECT ordinal::BIGINT AS ordinal, region, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM (VALUES " + ", ".join(rows) + ") t(ordinal, region, x0, y0, x1, y1))"


EDGES = _edges_sql()


def r6(x: Column | str) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c, 6) + F.lit(0.0)


def sql6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


SLOPE = """slopes AS (
  SELECT c.*, CASE WHEN c.z IS NOT NULL THEN degrees(atan(sqrt(power((e.z - w.z) / 480.0, 2) + power((s.z - n.z) / 480.0, 2)))) END AS slope
  FROM cells c
  LEFT JOIN cells e ON e."row" = c."row" AND e.col = c.col + 1 LEFT JOIN cells w ON w."row" = c."row" AND w.col = c.col - 1
  LEFT JOIN cells s ON s."row" = c."row" + 1 AND s.col = c.col LEFT JOIN cells n ON n."row" = c."row" - 1 AND n.col = c.col)"""
