"""The registered queries of the engine's operators, each with equivalent SQL over the same tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, local
from ..operators import aggregate, distance, focal, grid, rank, resample, spatial, sweep, validate
from ..sources import tables
from . import binding as b
from .binding import CATALOG, CELLS, EDGES, PIXEL, POINTS, SITES, SLOPE, X, Y, r6, sql6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def cellwise(name: str, columns: Callable[[], dict], sql: str, slope: bool = False) -> None:
    """A query of computed columns of every cell."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = b.cells(spark, sf_dir)
        if slope:
            cells = focal.slope_degrees(cells, PIXEL)
        return cells.select("row", "col", *(c.alias(n) for n, c in columns().items()))

    source = "slopes" if slope else "cells"
    query(name, f'WITH {CELLS}{", " + SLOPE if slope else ""} SELECT "row", col, {sql} FROM {source}')(run)


def clip(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, 0.0), 1.0) END"


# --- local map algebra --------------------------------------------------------------------------------------------------

cellwise("prj_inverse_threshold", lambda: {"v": r6(local.inverse_threshold(F.col("z"), 15.0))}, f"{sql6(clip('1 - z / 15.0'))} AS v")
cellwise("prj_optimal_range", lambda: {"v": r6(local.optimal_range(F.col("tmax"), 140.0, 30.0))}, f"{sql6('exp(-power(tmax - 140.0, 2) / 1800.0)')} AS v")
cellwise("prj_slope_score", lambda: {"v": r6(local.slope_score(F.col("slope")))}, f"{sql6(clip('1 - slope / 15.0'))} AS v", slope=True)
cellwise("prj_illumination_score", lambda: {"v": r6(local.illumination_score(F.col("illum")))}, f"{sql6(clip('illum / 0.7'))} AS v")
cellwise("prj_hazard_score", lambda: {"v": r6(local.hazard_score(F.col("density")))}, f"{sql6(clip('1 - density / 50.0'))} AS v")
cellwise("prj_thermal_score", lambda: {"v": r6(local.thermal_score(F.col("tmax")))}, f"{sql6('exp(-power(tmax - 140.0, 2) / 1800.0)')} AS v")
cellwise("prj_visibility_score", lambda: {"v": r6(local.visibility_score(F.col("los")))}, f"{sql6(clip('(los - 0.2) / (0.5 - 0.2)'))} AS v")
cellwise("prj_seismic_score", lambda: {"v": r6(local.seismic_score(F.when(F.col("scarp_km") == 0, F.lit(float("inf"))).otherwise(F.col("scarp_km"))))}, f"{sql6('CASE WHEN scarp_km = 0 THEN 1.0 ELSE 1 / (1 + exp(-(scarp_km - 25.0) / 8.0)) END')} AS v")
cellwise("prj_coupling_score", lambda: {"v": r6(local.coupling_score(F.col("density") / 10, F.col("scarp_km") / 8))}, f"{sql6('(' + clip('1 - density / 10 / 5.0') + ') * (' + clip('1 - scarp_km / 8 / 5.0') + ')')} AS v")
cellwise("prj_masks", lambda: {"psr": local.psr_mask(F.when(F.col("z").isNotNull(), F.col("illum"))), "ridge": local.sunlit_ridge(F.col("illum"), F.col("slope"))}, "coalesce(CASE WHEN z IS NOT NULL THEN illum END < 0.001, false) AS psr, coalesce(illum >= 0.7 AND slope BETWEEN 5 AND 25, false) AS ridge", slope=True)
cellwise("prj_hls_compliant", lambda: {"ok": local.hls_compliant(F.col("slope"), F.col("illum"), F.col("los"))}, "coalesce(slope <= 8 AND illum >= 0.33 AND los >= 0.5, false) AS ok", slope=True)
cellwise(
    "prj_dominant_criteria",
    lambda: {"top": F.array_join(local.dominant({"thermal": F.when(F.col("tmax") > 80, F.col("tmax") / 200), "illumination": F.col("illum"), "los": F.round("los", 9), "hazard": 1 - F.col("density") / 80}), ",")},
    """(SELECT string_agg(k, ',' ORDER BY s DESC, i) FROM (SELECT * FROM (VALUES (CASE WHEN tmax > 80 THEN tmax / 200 END, 0, 'thermal'), (illum, 1, 'illumination'), (round(los, 9), 2, 'los'), (1 - density / 80, 3, 'hazard')) t(s, i, k) WHERE s IS NOT NULL ORDER BY s DESC, i LIMIT 3)) AS top""",
)
cellwise(
    "prj_affine",
    lambda: {"x": r6(b.grid().x(F.col("col"))), "y": r6(b.grid().y(F.col("row"))), "back_row": b.grid().row(b.grid().y(F.col("row")) + 119), "back_col": b.grid().col(b.grid().x(F.col("col")) - 119)},
    f"{sql6(X)} AS x, {sql6(Y)} AS y, round_even((0.0 - ({Y} + 119)) / 240.0 - 0.5, 0)::BIGINT AS back_row, round_even(({X} - 119) / 240.0 - 0.5, 0)::BIGINT AS back_col",
)


@query("prj_stereographic", "WITH p AS (SELECT c_custkey AS id, (c_custkey * 137508 % 360000) / 1000.0::DOUBLE - 180 AS lon, -90 + (c_custkey % 100 + 1) / 10.0::DOUBLE AS lat FROM customer), q AS (SELECT *, 2 * 1737400.0 * tan(pi() / 4 + radians(lat) / 2) * sin(radians(lon)) AS x, 2 * 1737400.0 * tan(pi() / 4 + radians(lat) / 2) * cos(radians(lon)) AS y FROM p) SELECT id, (round(x, 3) + 0.0) AS x, (round(y, 3) + 0.0) AS y, (round(degrees(atan2(x, y)), 6) + 0.0) AS lon, (round(degrees(2 * atan(sqrt(x * x + y * y) / (2 * 1737400.0)) - pi() / 2), 6) + 0.0) AS lat, (round(atan2(x, y), 6) + 0.0) AS gamma FROM q")
def _stereographic(spark, sf_dir):
    k = F.col("c_custkey")
    p = b.table(spark, sf_dir, "customer").select(k.alias("id"), (k * 137508 % 360000 / F.lit(1000.0) - 180).alias("lon"), (-90 + (k % 100 + 1) / F.lit(10.0)).alias("lat"))
    q = p.select("id", crs.stereo_x(F.col("lon"), F.col("lat")).alias("x"), crs.stereo_y(F.col("lon"), F.col("lat")).alias("y"))
    x, y = F.col("x"), F.col("y")
    return q.select("id", (F.round(x, 3) + 0.0).alias("x"), (F.round(y, 3) + 0.0).alias("y"), r6(crs.lon_of(x, y)).alias("lon"), r6(crs.lat_of(x, y)).alias("lat"), r6(crs.convergence(x, y)).alias("gamma"))


#: A code-to-name dictionary of the queries (fixed values); "C" is out of scope.
_CODES = {"0": "Alpha", "1": "Beta", "2": None, "3": "Delta"}


@query("prj_code_lookup", "SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' WHEN 3 THEN 'Delta' END AS name, s_suppkey % 5 IN (0, 1, 3) AS in_scope FROM supplier")
def _codes(spark, sf_dir):
    name = local.lookup((F.col("s_suppkey") % 5).cast("string"), _CODES)
    return b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), name.alias("name"), name.isNotNull().alias("in_scope"))


# --- filters --------------------------------------------------------------------------------------------------------------

_SCORE = "0.4 * illum + 0.35 * los + 0.25 * (1 - density / 80)"


def _scored(cells: DataFrame) -> DataFrame:
    score = aggregate.weighted_sum({"illumination": F.col("illum"), "los": F.col("los"), "hazard": 1 - F.col("density") / 80}, {"illumination": 0.4, "los": 0.35, "hazard": 0.25})
    return cells.withColumn("score", F.when(F.col("z").isNotNull(), F.round(score, 9)))


SCORED = f"scored AS (SELECT *, CASE WHEN z IS NOT NULL THEN round({_SCORE}, 9) END AS score FROM slopes)"


@query("flt_min_score", f'WITH {CELLS}, {SLOPE}, {SCORED} SELECT "row", col, {sql6("score")} AS score FROM scored WHERE score >= 0.5')
def _min_score(spark, sf_dir):
    return _scored(b.cells(spark, sf_dir)).where("score >= 0.5").select("row", "col", r6("score").alias("score"))


_ELIGIBLE = f"""WITH RECURSIVE {CELLS}, {SLOPE}, {SCORED},
steep AS (SELECT "row", col FROM slopes WHERE NOT coalesce(slope <= 8, false)),
near AS (SELECT DISTINCT s."row" + o.dr AS "row", s.col + o.dc AS col FROM steep s, (SELECT a AS dr, e AS dc FROM range(-2, 3) x(a), range(-2, 3) y(e) WHERE (a * a + e * e) * 240 * 240 < 300 * 300) o),
eligible AS (SELECT s.* FROM scored s ANTI JOIN near n ON s."row" = n."row" AND s.col = n.col WHERE score IS NOT NULL AND slope <= 8 AND illum >= 0.33 AND los >= 0.5)"""


def _eligible(spark, sf_dir):
    return rank.compliant_cells(focal.slope_degrees(_scored(b.cells(spark, sf_dir)), PIXEL), PIXEL, buffer_m=300.0)


@query("flt_compliant", f'{_ELIGIBLE} SELECT "row", col, region, {sql6("score")} AS score FROM eligible')
def _compliant(spark, sf_dir):
    return _eligible(spark, sf_dir).select("row", "col", "region", r6("score").alias("score"))


@query("flt_craters", "WITH p AS (SELECT c_custkey AS id, (c_custkey * 137508 % 360000) / 1000.0::DOUBLE - 180 AS lon, -90 + (c_custkey % 200 + 1) / 10.0::DOUBLE AS lat, CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 30) / 10.0::DOUBLE END AS diam_km FROM customer) SELECT id, lat, diam_km, (round(2 * 1737400.0 * tan(pi() / 4 + radians(lat) / 2) * sin(radians(lon)), 3) + 0.0) AS x FROM p WHERE lat <= -75 AND coalesce(diam_km, 0) >= 1.0")
def _craters(spark, sf_dir):
    k = F.col("c_custkey")
    rows = b.table(spark, sf_dir, "customer").select(k.alias("id"), (k * 137508 % 360000 / F.lit(1000.0) - 180).alias("lon"), (-90 + (k % 200 + 1) / F.lit(10.0)).alias("lat"), F.when(k % 11 != 0, k % 30 / F.lit(10.0)).alias("diam_km"))
    return tables.crater_filter(rows, min_diameter_km=1.0).select("id", "lat", "diam_km", (F.round("x", 3) + 0.0).alias("x"))


@query("flt_scope", f"WITH {SITES} SELECT count(*) FILTER (WHERE region IN ('zone1', 'zone2', 'zone4')) AS kept, string_agg(DISTINCT CASE WHEN region NOT IN ('zone1', 'zone2', 'zone4') THEN region END, ',' ORDER BY CASE WHEN region NOT IN ('zone1', 'zone2', 'zone4') THEN region END) AS dropped FROM sites")
def _scope(spark, sf_dir):
    scope = F.upper("region").isin("ZONE1", "ZONE2", "ZONE4")
    return b.sites(spark, sf_dir).agg(F.count_if(scope).alias("kept"), F.array_join(F.sort_array(F.collect_set(F.when(~scope, F.col("region")))), ",").alias("dropped"))


# --- focal ----------------------------------------------------------------------------------------------------------------

cellwise("foc_slope", lambda: {"slope": r6("slope")}, f"{sql6('slope')} AS slope", slope=True)

_DISC = "(SELECT a AS dr, e AS dc FROM range(-8, 9) x(a), range(-8, 9) y(e) WHERE (a * a + e * e) * 240.0 * 240.0 <= 2000.0 * 2000.0)"


@query("foc_cold_access", f'WITH {CELLS}, n AS (SELECT s."row" + o.dr AS "row", s.col + o.dc AS col, count(*) FILTER (WHERE tmax < 110) / count(*)::DOUBLE AS access FROM cells s, {_DISC} o WHERE tmax IS NOT NULL GROUP BY ALL) SELECT c."row", c.col, CASE WHEN c.tmax IS NOT NULL THEN {sql6("access")} END AS access FROM cells c LEFT JOIN n USING ("row", col)')
def _cold(spark, sf_dir):
    return focal.cold_access(b.cells(spark, sf_dir), PIXEL).select("row", "col", r6("access").alias("access"))


@query("foc_volatiles", f'WITH {CELLS}, n AS (SELECT s."row" + o.dr AS "row", s.col + o.dc AS col, count(*)::DOUBLE AS n, count(*) FILTER (WHERE tmax < 110) AS a, count(*) FILTER (WHERE tmax < 66) AS b, count(*) FILTER (WHERE tmax < 60) AS c FROM cells s, {_DISC} o WHERE tmax IS NOT NULL GROUP BY ALL) SELECT c."row", c.col, CASE WHEN c.tmax IS NOT NULL THEN {sql6("a / n")} END AS h2o, CASE WHEN c.tmax IS NOT NULL THEN {sql6("b / n")} END AS co2, CASE WHEN c.tmax IS NOT NULL THEN {sql6("n.c / n")} END AS ultracold, CASE WHEN c.tmax IS NOT NULL THEN {sql6("(a / n * 0.5 + b / n * 0.3 + n.c / n * 0.2)")} END AS combined FROM cells c LEFT JOIN n USING ("row", col)')
def _volatiles(spark, sf_dir):
    rows = focal.volatile_access(b.cells(spark, sf_dir), PIXEL, weights=(0.5, 0.3, 0.2))
    return rows.select("row", "col", *(r6(c).alias(c) for c in ("h2o", "co2", "ultracold", "combined")))


@query("foc_coarsen", f'WITH {CELLS} SELECT "row" // 4 AS "row", col // 4 AS col, {sql6("avg(z)")} AS z FROM cells WHERE "row" < (SELECT (max("row") + 1) // 4 * 4 FROM cells) AND col < 124 GROUP BY ALL')
def _coarsen(spark, sf_dir):
    cells = b.cells(spark, sf_dir)
    height = cells.agg(F.max("row")).first()[0] + 1
    return grid.coarsened(cells, "z", 4, height, b.WIDTH).select("row", "col", r6("z").alias("z"))


_DISTANCES = focal.ray_distances(PIXEL)
_RAYS = ", ".join(f"({a}, {_DISTANCES[k]!r}, {dr!r}, {dc!r})" for a, k, dr, dc in focal.ray_offsets(focal.AZIMUTHS, [d / PIXEL for d in _DISTANCES]))
_CORNERS = (("p", "(1 - fr) * (1 - fc)"), ("q", "(1 - fr) * fc"), ("u", "fr * (1 - fc)"), ("v", "fr * fc"))
_SAMPLE = " + ".join(f"CASE WHEN {w} = 0 THEN 0 ELSE {w} * {n}.z END" for n, w in _CORNERS)
_HORIZON = f"""rays AS (SELECT azimuth::BIGINT AS azimuth, d::DOUBLE AS d, dr::DOUBLE AS dr, dc::DOUBLE AS dc FROM (VALUES {_RAYS}) t(azimuth, d, dr, dc)),
placed AS (SELECT s."row", s.col, s.z, azimuth, d, floor(s."row" + dr)::BIGINT AS r0, floor(s.col + dc)::BIGINT AS c0,
    s."row" + dr - floor(s."row" + dr) AS fr, s.col + dc - floor(s.col + dc) AS fc
  FROM cells s, rays WHERE s.z IS NOT NULL AND s."row" + dr BETWEEN 0 AND (SELECT max("row") FROM cells) AND s.col + dc BETWEEN 0 AND {b.WIDTH - 1}),
sampled AS (SELECT a."row", a.col, azimuth, d, a.z, {_SAMPLE} AS s
  FROM placed a LEFT JOIN cells p ON p."row" = r0 AND p.col = c0 LEFT JOIN cells q ON q."row" = r0 AND q.col = c0 + 1
  LEFT JOIN cells u ON u."row" = r0 + 1 AND u.col = c0 LEFT JOIN cells v ON v."row" = r0 + 1 AND v.col = c0 + 1),
highest AS (SELECT "row", col, azimuth, max(degrees(atan2(s - z - d * d / (2 * 1737400.0), d))) AS horizon FROM sampled GROUP BY ALL),
horizon AS (SELECT c."row", c.col, a.azimuth, coalesce(h.horizon, -90.0) AS horizon
  FROM cells c CROSS JOIN (SELECT DISTINCT azimuth FROM rays) a LEFT JOIN highest h ON h."row" = c."row" AND h.col = c.col AND h.azimuth = a.azimuth)"""


def _horizon_rows(spark, sf_dir):
    """All cells, with the operator's own azimuths and distances."""
    return focal.horizon_profile(b.cells(spark, sf_dir).select("row", "col", "z"), PIXEL, focal.AZIMUTHS)


@query("foc_horizon", f'WITH {CELLS}, {_HORIZON} SELECT "row", col, azimuth, {sql6("horizon")} AS horizon FROM horizon')
def _horizon(spark, sf_dir):
    return _horizon_rows(spark, sf_dir).select("row", "col", "azimuth", r6("horizon").alias("horizon"))


def _visibility_sql() -> str:
    parts = []
    for k in range(24):
        t = 2 * math.pi * k / 24
        p, q = math.radians(6.5 * math.sin(t)), math.radians(7.9 * math.cos(t))
        e = (math.cos(p) * math.cos(q), math.cos(p) * math.sin(q), math.sin(p))
        parts.append(f"({k}, {e[0]!r}, {e[1]!r}, {e[2]!r})")
    return f"""earth AS (SELECT k, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM (VALUES {', '.join(parts)}) t(k, x, y, z)),
place AS (SELECT "row", col, radians(-89 + "row" / 20.0::DOUBLE) AS la, radians(col * 2.0::DOUBLE) AS lo, radians(col * 2.0::DOUBLE) AS gamma FROM cells),
seen AS (SELECT p."row", p.col, k, degrees(asin(least(greatest(cos(la) * cos(lo) * x + cos(la) * sin(lo) * y + sin(la) * z, -1.0), 1.0))) AS elevation,
    atan2(-sin(lo) * x + cos(lo) * y, -sin(la) * cos(lo) * x - sin(la) * sin(lo) * y + cos(la) * z) - gamma AS az FROM place p, earth),
bucketed AS (SELECT *, (round_even((((az % (2 * pi())) + 2 * pi()) % (2 * pi())) / (2 * pi() / {focal.AZIMUTHS}), 0)::BIGINT % {focal.AZIMUTHS}) AS azimuth FROM seen)"""


@query("vis_fraction", f'WITH {CELLS}, {_HORIZON}, {_visibility_sql()} SELECT v."row", v.col, {sql6("count(*) FILTER (WHERE elevation > horizon) / 24.0")} AS visible FROM bucketed v JOIN horizon h USING ("row", col, azimuth) GROUP BY ALL')
def _visible(spark, sf_dir):
    profile = _horizon_rows(spark, sf_dir).groupBy("row", "col").agg(F.transform(F.sort_array(F.collect_list(F.struct("azimuth", "horizon"))), lambda x: x["horizon"]).alias("h"))
    lat, lon = -89 + F.col("row") / F.lit(20.0), F.col("col") * F.lit(2.0)
    return profile.select("row", "col", r6(focal.visibility_fraction(F.col("h"), lat, lon, F.radians(lon), focal.AZIMUTHS)).alias("visible"))


# --- distances -------------------------------------------------------------------------------------------------------------


def _distance(name: str, condition: str):
    @query(name, f'WITH {CELLS}, m AS (SELECT "row" AS mr, col AS mc FROM cells WHERE {condition}), g AS (SELECT c."row", c.col, min(abs(c.col - mc)) AS g FROM cells c LEFT JOIN m ON mr = c."row" GROUP BY ALL) SELECT c."row", c.col, (round(sqrt(min((c."row" - g."row") ** 2 + g ** 2)) * 240, 3) + 0.0) AS distance_m FROM cells c LEFT JOIN g ON c.col = g.col AND g.g IS NOT NULL GROUP BY c."row", c.col')
    def run(spark, sf_dir):
        return distance.distance_to_mask(b.cells(spark, sf_dir), F.expr(condition), PIXEL).select("row", "col", (F.round("distance_m", 3) + 0.0).alias("distance_m"))


_distance("dst_psr", "illum < 0.02")
_distance("dst_ridge", "illum >= 0.97 AND los > 0.5")


@query("dst_near_psr", f'WITH {CELLS} SELECT DISTINCT c."row", c.col FROM cells c JOIN (SELECT "row" + dr AS "row", col + dc AS col FROM cells, (SELECT a AS dr, e AS dc FROM range(-4, 5) x(a), range(-4, 5) y(e) WHERE (a * a + e * e) * 240 * 240 <= 1000 * 1000) o WHERE illum < 0.02) m USING ("row", col)')
def _near(spark, sf_dir):
    cells = b.cells(spark, sf_dir)
    return distance.near_mask(cells, F.col("illum") < 0.02, 1000.0, PIXEL)


_NEAR = '(SELECT DISTINCT "row" + dr AS "row", col + dc AS col, true AS near FROM cells, (SELECT a AS dr, e AS dc FROM range(-4, 5) x(a), range(-4, 5) y(e) WHERE (a * a + e * e) * 240 * 240 <= 1000 * 1000) o WHERE illum < 0.001)'


def _with_near(cells):
    return cells.join(distance.near_mask(cells, local.psr_mask(F.col("illum")), 1000.0, PIXEL).withColumn("near", F.lit(True)), ["row", "col"], "left")


@query("prj_ice_score", f'WITH {CELLS}, d AS (SELECT c.*, n.near, CASE WHEN density < 40 THEN density / 10 END AS depth FROM cells c LEFT JOIN {_NEAR} n USING ("row", col)) SELECT "row", col, {sql6("least(greatest(coalesce(1 - least(greatest(depth / 2.87, 0), 1), 0) + CASE WHEN depth IS NOT NULL AND abs(depth) < 1e-9 THEN 0.5 ELSE 0 END + CASE WHEN coalesce(near, false) THEN 0.2 ELSE 0 END, 0), 1)").replace("coalesce(1 - least(greatest(depth / 2.87, 0), 1), 0)", "CASE WHEN depth IS NULL THEN 0 ELSE 1 - least(greatest(depth / 2.87, 0), 1) END")} AS score FROM d')
def _ice(spark, sf_dir):
    depth = F.when(F.col("density") < 40, F.col("density") / 10)
    return _with_near(b.cells(spark, sf_dir)).select("row", "col", r6(local.ice_score(depth, F.col("near"))).alias("score"))


@query("prj_neutron_ice_score", f'WITH {CELLS}, s AS (SELECT min(tmax) AS lo, max(tmax) AS hi FROM cells) SELECT c."row", c.col, CASE WHEN tmax IS NOT NULL THEN {sql6("least(greatest(1 - (tmax - lo) / (hi - lo) + CASE WHEN coalesce(near, false) THEN 0.3 ELSE 0 END, 0), 1)")} END AS score FROM s, cells c LEFT JOIN {_NEAR} n USING ("row", col)')
def _neutron(spark, sf_dir):
    cells = b.cells(spark, sf_dir)
    s = cells.agg(F.min("tmax").alias("lo"), F.max("tmax").alias("hi")).first()
    return _with_near(cells).select("row", "col", r6(local.neutron_ice_score(F.col("tmax"), F.lit(s["lo"]), F.lit(s["hi"]), F.col("near"))).alias("score"))


_LINES = "lines AS (SELECT s_suppkey AS line_id, (s_suppkey * 7907 % 30000)::DOUBLE AS x0, (-(s_suppkey * 3571 % 28800))::DOUBLE AS y0, (s_suppkey * 7907 % 30000 + s_suppkey * 37 % 4000)::DOUBLE AS x1, (-(s_suppkey * 3571 % 28800) + s_suppkey * 53 % 3000)::DOUBLE AS y1 FROM supplier), dense AS (SELECT line_id, k, x0 + (x1 - x0) * k / greatest(n - 1, 1) AS x, y0 + (y1 - y0) * k / greatest(n - 1, 1) AS y FROM (SELECT *, greatest(2, ceil(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / 1000.0)::BIGINT + 1) AS n FROM lines) l, LATERAL (SELECT unnest(range(0, n)) AS k))"


def _scarps(spark, sf_dir):
    k = F.col("s_suppkey")
    x0, y0 = (k * 7907 % 30000).cast("double"), (-(k * 3571 % 28800)).cast("double")
    rows = b.table(spark, sf_dir, "supplier").select(k.alias("line_id"), F.array(F.struct(x0.alias("x"), y0.alias("y")), F.struct((x0 + k * 37 % 4000).alias("x"), (y0 + k * 53 % 3000).alias("y"))).alias("points"))
    return distance.densified(rows)


@query("dst_densify", f"WITH {_LINES} SELECT line_id, k, (round(x, 3) + 0.0) AS x, (round(y, 3) + 0.0) AS y FROM dense")
def _densify(spark, sf_dir):
    return _scarps(spark, sf_dir).select("line_id", "k", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))


@query("dst_scarps", f'WITH {CELLS}, {_LINES} SELECT "row", col, (round(min(sqrt(({X} - x) ** 2 + ({Y} - y) ** 2)) / 1000, 3) + 0.0) AS km FROM cells, dense GROUP BY ALL')
def _to_scarps(spark, sf_dir):
    a = b.cells(spark, sf_dir).select((F.col("row") * b.WIDTH + F.col("col")).alias("a_id"), b.grid().x(F.col("col")).alias("x"), b.grid().y(F.col("row")).alias("y"))
    found = distance.feature_distance(a, _scarps(spark, sf_dir).select((F.col("line_id") * 100 + F.col("k")).alias("b_id"), "x", "y"))
    return found.select(F.expr(f"a_id div {b.WIDTH}").alias("row"), (F.col("a_id") % b.WIDTH).alias("col"), (F.round("km", 3) + 0.0).alias("km"))


# --- joins, resampling, rasterising ---------------------------------------------------------------------------------------------


def _placed(spark, sf_dir):
    return b.cells(spark, sf_dir).withColumn("x", b.grid().x(F.col("col"))).withColumn("y", b.grid().y(F.col("row")))


@query("rng_point_density", f'WITH {CELLS}, {POINTS} SELECT c."row", c.col, count(b_id) AS n_points FROM (SELECT "row", col, {X} AS cx, {Y} AS cy FROM cells) c LEFT JOIN points ON x BETWEEN cx - 3000 AND cx + 3000 AND y BETWEEN cy - 3000 AND cy + 3000 AND sqrt((cx - x) ** 2 + (cy - y) ** 2) <= 3000 GROUP BY ALL')
def _density(spark, sf_dir):
    a = _placed(spark, sf_dir).select((F.col("row") * b.WIDTH + F.col("col")).alias("a_id"), "row", "col", "x", "y")
    return spatial.point_density(a, b.points(spark, sf_dir), 3000.0).select("row", "col", "n_points")


_CROSS = "sum(CASE WHEN (y0 > y) <> (y1 > y) AND x < x0 + (y - y0) / (CASE WHEN y1 = y0 THEN NULL ELSE y1 - y0 END) * (x1 - x0) THEN 1 ELSE 0 END) % 2 = 1"
_SPAN = lambda s, e, c: (f"CASE WHEN {e} = {s} THEN CASE WHEN abs({s} - {c}) < 120 THEN 0.0 ELSE 2.0 END ELSE least(({c} - 120 - {s}) / ({e} - {s}), ({c} + 120 - {s}) / ({e} - {s})) END", f"CASE WHEN {e} = {s} THEN CASE WHEN abs({s} - {c}) < 120 THEN 1.0 ELSE -2.0 END ELSE greatest(({c} - 120 - {s}) / ({e} - {s}), ({c} + 120 - {s}) / ({e} - {s})) END")
_TOUCH = f"bool_or(greatest({_SPAN('x0', 'x1', 'x')[0]}, {_SPAN('y0', 'y1', 'y')[0]}, 0.0) < least({_SPAN('x0', 'x1', 'x')[1]}, {_SPAN('y0', 'y1', 'y')[1]}, 1.0))"


def _mask(name: str, condition: str, all_touched: bool):
    @query(name, f'WITH {CELLS}, {EDGES} SELECT "row", col, e.region AS zone FROM (SELECT "row", col, {X} AS x, {Y} AS y FROM cells) c, edges e GROUP BY "row", col, x, y, e.region HAVING {condition}')
    def run(spark, sf_dir):
        cells = _placed(spark, sf_dir).select("row", "col", "x", "y")
        return spatial.polygon_cells(cells, b.polygons(spark), PIXEL, all_touched).select("row", "col", F.col("region").alias("zone"))


_mask("pip_centre_cells", _CROSS, False)
_mask("pip_touched_cells", f"({_CROSS}) OR {_TOUCH}", True)

_SEGMENT = "sqrt((x - (x0 + t * (x1 - x0))) ** 2 + (y - (y0 + t * (y1 - y0))) ** 2)"
_PER_POLYGON = f"""near AS (SELECT *, least(1.0, greatest(0.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS t FROM (SELECT a_id, x, y FROM sites) s, edges),
per AS (SELECT a_id, ordinal, region, {_CROSS} AS inside, min({_SEGMENT}) AS d FROM near GROUP BY ALL)"""


@query("knn_polygons", f"WITH {SITES}, {EDGES}, {_PER_POLYGON} SELECT a_id, (arg_min(region, CASE WHEN inside THEN -1e12 + ordinal ELSE d END)) AS region, bool_or(inside) AS inside, (round(min(CASE WHEN inside THEN -d ELSE d END), 3) + 0.0) AS signed_m FROM per GROUP BY a_id")
def _polygon_distance(spark, sf_dir):
    rows = validate.polygon_distances(b.sites(spark, sf_dir).select("a_id", "x", "y"), b.polygons(spark))
    return rows.select("a_id", "region", "inside", (F.round("signed_m", 3) + 0.0).alias("signed_m"))


@query("knn_polygon_sites", f"WITH {SITES}, {EDGES}, {_PER_POLYGON}, o AS (SELECT *, CASE WHEN inside THEN 0 ELSE d END AS far FROM per) SELECT ordinal, region, arg_min(a_id, (far, a_id)) AS a_id, {sql6('min(far) / 1000')} AS distance_km, bool_or(inside) AS contains FROM o GROUP BY ordinal, region")
def _polygon_sites(spark, sf_dir):
    return validate.polygons_by_sites(b.sites(spark, sf_dir), b.polygons(spark)).withColumn("distance_km", r6("distance_km"))


_MATCHES = "m AS (SELECT a_id, arg_min(b_id, (d, b_id)) AS b_id, min(d) / 1000 AS km FROM (SELECT a_id, c.b_id, sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2) AS d FROM sites s, catalog c) GROUP BY a_id)"


@query("knn_catalog", f"WITH {SITES}, {CATALOG}, {_MATCHES} SELECT a_id, b_id, {sql6('km')} AS km, km <= 5 AS matched FROM m")
def _matches(spark, sf_dir):
    found = validate.matches(b.sites(spark, sf_dir).select("a_id", "x", "y"), b.catalog(spark, sf_dir).select("b_id", "x", "y"), 5.0)
    return found.select("a_id", "b_id", r6("distance_km").alias("km"), "matched")


@query("knn_points", f"WITH {SITES}, {POINTS} SELECT a_id, arg_min(b_id, (d, b_id)) AS b_id, {sql6('min(d)')} AS distance_m FROM (SELECT a_id, p.b_id, sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2) AS d FROM sites s, points p) GROUP BY a_id")
def _nearest_points(spark, sf_dir):
    found = spatial.nearest(b.sites(spark, sf_dir).select("a_id", "x", "y"), b.points(spark, sf_dir).select("b_id", "x", "y"), broadcast_rows=100)
    return found.select("a_id", "b_id", r6("distance_m").alias("distance_m"))


@query("jn_grid", f'WITH {CELLS} SELECT a."row", a.col, {sql6("a.illum + c.los")} AS v FROM cells a JOIN cells c USING ("row", col)')
def _grid_join(spark, sf_dir):
    cells = b.cells(spark, sf_dir)
    return grid.join_layers(cells.select("row", "col", "illum"), cells.select("row", "col", "los")).select("row", "col", r6(F.col("illum") + F.col("los")).alias("v"))


@query("jn_region_names", f"WITH {SITES}, {CATALOG} SELECT region FROM sites UNION SELECT region FROM catalog")
def _names(spark, sf_dir):
    return validate.region_names(b.sites(spark, sf_dir), b.catalog(spark, sf_dir))


@query("jn_compare_regions", f"""WITH {SITES}, {CATALOG},
d AS (SELECT s.a_id, c.b_id, s.region AS ra, c.region AS rb, sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2) / 1000 AS km FROM sites s, catalog c),
f AS (SELECT a_id, any_value(ra) AS region, min(km) AS km, arg_min(rb, (km, b_id)) = any_value(ra) AND min(km) <= 8 AS ok FROM d GROUP BY a_id),
g AS (SELECT b_id, any_value(rb) AS region, arg_min(ra, (km, a_id)) = any_value(rb) AND min(km) <= 8 AS ok FROM d GROUP BY b_id),
l AS (SELECT region, count(*) AS n_a, count(*) FILTER (WHERE ok) AS matched, median(km) FILTER (WHERE ok) AS median_km, string_agg(a_id::VARCHAR, ',' ORDER BY a_id) FILTER (WHERE NOT ok) AS unmatched_a FROM f GROUP BY region),
r AS (SELECT region, count(*) AS n_b, string_agg(b_id::VARCHAR, ',' ORDER BY b_id) FILTER (WHERE NOT ok) AS unmatched_b FROM g GROUP BY region)
SELECT region, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(matched, 0) AS matched, {sql6('median_km')} AS median_km,
  coalesce(unmatched_a, '') AS unmatched_a, coalesce(unmatched_b, '') AS unmatched_b FROM l FULL JOIN r USING (region)""")
def _by_region(spark, sf_dir):
    return validate.compare_by_region(b.sites(spark, sf_dir), b.catalog(spark, sf_dir), 8.0).withColumn("median_km", r6("median_km"))


#: The target grid of 100 m over the whole source, from an offset of 120 m on.
_TARGET = f"""target AS (SELECT tr AS "row", tc AS col, (tc + 0.5) * 100.0::DOUBLE + 120 AS x, -(tr + 0.5) * 100.0::DOUBLE - 120 AS y
  FROM (SELECT unnest(range(0, ceil(((max("row") + 1) * 240.0 - 120.0) / 100.0)::BIGINT)) AS tr FROM cells), range(0, {math.ceil((b.WIDTH * PIXEL - 120.0) / 100.0)}) e(tc))"""


def _target(spark, source, offset: float, pixel: float):
    """A grid over the whole source, from the offset on, and its cells."""
    height, width = ((n * PIXEL - offset) / pixel for n in (source.agg(F.max("row")).first()[0] + 1, b.WIDTH))
    g = grid.GridSpec(offset, -offset, pixel, math.ceil(height), math.ceil(width))
    return g, g.cells(spark).withColumn("x", g.x(F.col("col"))).withColumn("y", g.y(F.col("row")))


def _interpolated(spark, sf_dir, method: str):
    cells = b.cells(spark, sf_dir)
    return resample.resampled(cells, b.grid(), _target(spark, cells, 120.0, 100.0)[0], "z", method).withColumn("z", r6("z"))


@query("int_nearest", f'WITH {CELLS}, {_TARGET} SELECT t."row", t.col, {sql6("z")} AS z FROM target t LEFT JOIN cells c ON c."row" = round_even(-t.y / 240.0 - 0.5, 0)::BIGINT AND c.col = round_even(t.x / 240.0 - 0.5, 0)::BIGINT')
def _int_nearest(spark, sf_dir):
    return _interpolated(spark, sf_dir, "nearest")


def _kernel(axes: tuple[tuple[int, str], ...]) -> str:
    """SQL of a separable kernel: for each axis the offsets and their weights of the fraction f, renormalised over known cells."""
    one = lambda f: ", ".join(f"{{'o': {o}, 'w': {w.replace('f', f)}}}" for o, w in axes)
    return f"""WITH {CELLS}, {_TARGET}, spot AS (SELECT "row", col, -y / 240.0 - 0.5 AS v, x / 240.0 - 0.5 AS u FROM target),
placed AS (SELECT "row", col, floor(v)::BIGINT AS r0, floor(u)::BIGINT AS c0, v - floor(v) AS fr, u - floor(u) AS fc FROM spot),
rows_ AS (SELECT "row", col, r0, c0, fc, unnest([{one('fr')}]) AS i FROM placed),
k AS (SELECT "row", col, r0 + i.o AS sr, c0 + j.o AS sc, i.w * j.w AS w FROM (SELECT *, unnest([{one('fc')}]) AS j FROM rows_)),
known AS (SELECT k."row", k.col, sum(w * z) / nullif(sum(w), 0) AS z FROM k JOIN cells c ON c."row" = sr AND c.col = sc WHERE w <> 0 AND z IS NOT NULL GROUP BY ALL)
SELECT t."row", t.col, {sql6("z")} AS z FROM target t LEFT JOIN known USING ("row", col)"""


@query("int_bilinear", _kernel(((0, "(1 - f)"), (1, "f"))))
def _int_bilinear(spark, sf_dir):
    return _interpolated(spark, sf_dir, "bilinear")


#: Catmull-Rom weights (a = -0.5) of the cell before, the two around and the one after a fraction f.
_CUBIC = ((-1, "(-0.5 * f + f ** 2 - 0.5 * f ** 3)"), (0, "(1 - 2.5 * f ** 2 + 1.5 * f ** 3)"), (1, "(0.5 * f + 2 * f ** 2 - 1.5 * f ** 3)"), (2, "(-0.5 * f ** 2 + 0.5 * f ** 3)"))


@query("int_cubic", _kernel(_CUBIC))
def _int_cubic(spark, sf_dir):
    return _interpolated(spark, sf_dir, "cubic")


def _gather(method: str, sql: str):
    @query(f"int_{method}", f'WITH {CELLS}, t AS (SELECT "row", col FROM (SELECT unnest(range(0, ceil((max("row") + 1) * 240.0 / 960.0)::BIGINT)) AS "row" FROM cells), range(0, {math.ceil(b.WIDTH * PIXEL / 960.0)}) e(col)), g AS (SELECT round_even(-({Y}) / 960.0 - 0.5, 0)::BIGINT AS "row", round_even({X} / 960.0 - 0.5, 0)::BIGINT AS col, {sql6(sql)} AS z FROM cells GROUP BY ALL) SELECT "row", col, z FROM t LEFT JOIN g USING ("row", col)')
    def run(spark, sf_dir):
        cells = b.cells(spark, sf_dir)
        g, target = _target(spark, cells, 0.0, 960.0)
        return resample.resampled(cells, b.grid(), target, "z", method, g).withColumn("z", r6("z"))


for _name, _sql in (("min", "min(z)"), ("max", "max(z)"), ("mean", "avg(z)"), ("median", "median(z)")):
    _gather(_name, _sql)


@query("int_scattered_nearest", f"WITH {SITES}, {POINTS} SELECT a_id, {sql6('arg_min(value, (d, b_id))')} AS value FROM (SELECT a_id, b_id, value, sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2) AS d FROM sites s, points p) GROUP BY a_id")
def _scattered(spark, sf_dir):
    return resample.scattered_nearest(b.sites(spark, sf_dir), b.points(spark, sf_dir), "value").withColumn("value", r6("value"))


@query("int_scattered_linear", f"WITH {SITES}, {POINTS}, p AS (SELECT a_id, value, d, row_number() OVER (PARTITION BY a_id ORDER BY d, b_id) AS i FROM (SELECT a_id, b_id, value, sqrt((s.x - q.x) ** 2 + (s.y - q.y) ** 2) AS d FROM sites s, points q) WHERE d <= 4000), v AS (SELECT a_id, count(*) AS n, min(d) AS near, arg_min(value, i) AS first, sum(CASE WHEN d > 0 THEN value / d END) / sum(CASE WHEN d > 0 THEN 1 / d END) AS mean FROM p WHERE i <= 3 GROUP BY a_id) SELECT s.a_id, CASE WHEN n = 3 THEN {sql6('CASE WHEN near = 0 THEN first ELSE mean END')} END AS value FROM sites s LEFT JOIN v USING (a_id)")
def _scattered_linear(spark, sf_dir):
    return resample.scattered_linear(b.sites(spark, sf_dir), b.points(spark, sf_dir), "value", 4000.0).withColumn("value", r6("value"))


@query("tile_specs", f"WITH {EDGES} SELECT region, floor((min(x0) - 1000) / 20) * 20 AS xmin, floor((min(y0) - 1000) / 20) * 20 AS ymin, ceil((max(x0) + 1000) / 20) * 20 AS xmax, ceil((max(y0) + 1000) / 20) * 20 AS ymax, ((ceil((max(x0) + 1000) / 20) * 20 - floor((min(x0) - 1000) / 20) * 20) / 20)::BIGINT AS width, ((ceil((max(y0) + 1000) / 20) * 20 - floor((min(y0) - 1000) / 20) * 20) / 20)::BIGINT AS height FROM edges GROUP BY region")
def _tiles(spark, sf_dir):
    rows = grid.tile_specs(b.polygons(spark).select("region", F.inline("ring")), 1000.0, 20.0)
    return rows.select("region", *(F.col(c).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")), "width", "height")


@query("tile_cells", "SELECT r AS \"row\", c AS col, (round(5000 + (c + 0.5) * 100, 6) + 0.0) AS x, (round(-2000 - (r + 0.5) * 100, 6) + 0.0) AS y, (round(degrees(atan2(5000 + (c + 0.5) * 100, -2000 - (r + 0.5) * 100)), 6) + 0.0) AS lon FROM range(0, 30) a(r), range(0, 40) e(c)")
def _tile_cells(spark, sf_dir):
    g = grid.TileSpec("t", "T", 5000.0, -5000.0, 9000.0, -2000.0).grid(100.0)
    x, y = g.x(F.col("col")), g.y(F.col("row"))
    return g.cells(spark).select("row", "col", r6(x).alias("x"), r6(y).alias("y"), r6(crs.lon_of(x, y)).alias("lon"))


# --- aggregation -----------------------------------------------------------------------------------------------------------


@query("agg_min_max", f'WITH {CELLS}, s AS (SELECT min(tmax) AS lo, max(tmax) AS hi FROM cells) SELECT "row", col, {sql6("(tmax - lo) / (hi - lo)")} AS v FROM cells, s')
def _min_max(spark, sf_dir):
    return aggregate.min_max(b.cells(spark, sf_dir), "tmax", "v").select("row", "col", r6("v").alias("v"))


@query("agg_weighted_sum", f'WITH {CELLS} SELECT "row", col, {sql6("0.4 * illum + 0.4 * los + 0.2 * (tmax / 200)")} AS v FROM cells')
def _weighted(spark, sf_dir):
    v = aggregate.weighted_sum({"a": F.col("illum"), "b": F.col("los"), "c": F.col("tmax") / 200}, {"a": 2.0, "b": 2.0, "c": 1.0})
    return b.cells(spark, sf_dir).select("row", "col", r6(v).alias("v"))


@query("agg_topsis", f"""WITH {CELLS}, l AS (SELECT *, tmax / 200 AS warm FROM cells), s AS (SELECT sqrt(sum(illum * illum)) AS na, sqrt(sum(los * los)) AS nb, sqrt(sum(warm * warm)) AS nc, max(illum) AS ha, max(los) AS hb, max(warm) AS hc, min(illum) AS la, min(los) AS lb, min(warm) AS lc FROM l),
d AS (SELECT "row", col, sqrt(power(0.5 * (illum - ha) / na, 2) + power(0.3 * (los - hb) / nb, 2) + power(0.2 * (warm - hc) / nc, 2)) AS near, sqrt(power(0.5 * (illum - la) / na, 2) + power(0.3 * (los - lb) / nb, 2) + power(0.2 * (warm - lc) / nc, 2)) AS far FROM l, s)
SELECT "row", col, CASE WHEN near + far > 0 THEN {sql6("far / (near + far)")} END AS v FROM d""")
def _topsis(spark, sf_dir):
    cells = b.cells(spark, sf_dir).withColumn("warm", F.col("tmax") / 200)
    return aggregate.aggregated(cells, {"a": "illum", "b": "los", "c": "warm"}, {"a": 0.5, "b": 0.3, "c": 0.2}, "topsis", "v").select("row", "col", r6("v").alias("v"))


@query("agg_summary", f"WITH {CELLS}, {SLOPE}, {SCORED} SELECT count(score) AS n_finite, {sql6('min(score)')} AS min, {sql6('max(score)')} AS max, {sql6('avg(score)')} AS mean, {sql6('100.0 * count(*) FILTER (WHERE score > 0.7) / count(score)')} AS pct_high, {sql6('100.0 * count(*) FILTER (WHERE score IS NULL) / count(*)')} AS pct_missing FROM scored")
def _summary(spark, sf_dir):
    s = aggregate.summary(_scored(b.cells(spark, sf_dir)), "score")
    return s.select("n_finite", *(r6(c).alias(c) for c in ("min", "max", "mean", "pct_high", "pct_missing")))


@query("agg_two_sample", f"WITH {CELLS}, v AS (SELECT criterion, side, value FROM (SELECT CASE WHEN col < 60 THEN 'a' ELSE 'b' END AS side, illum, los, tmax FROM cells) UNPIVOT (value FOR criterion IN (illum, los, tmax))), g AS (SELECT criterion, count(value) FILTER (WHERE side = 'a') AS n_a, count(value) FILTER (WHERE side = 'b') AS n_b, avg(value) FILTER (WHERE side = 'a') AS mean_a, avg(value) FILTER (WHERE side = 'b') AS mean_b, stddev_samp(value) FILTER (WHERE side = 'a') AS sd_a, stddev_samp(value) FILTER (WHERE side = 'b') AS sd_b FROM v GROUP BY criterion) SELECT criterion, n_a, n_b, {sql6('mean_a')} AS mean_a, {sql6('mean_b')} AS mean_b, {sql6('sd_a')} AS sd_a, {sql6('sd_b')} AS sd_b, {sql6('mean_a - mean_b')} AS delta, {sql6('abs(mean_a - mean_b)')} AS abs_delta, {sql6('(mean_a - mean_b) / sqrt(sd_a * sd_a / n_a + sd_b * sd_b / n_b)')} AS t FROM g")
def _two_sample(spark, sf_dir):
    rows = b.cells(spark, sf_dir).select(F.when(F.col("col") < 60, "a").otherwise("b").alias("side"), "illum", "los", "tmax").unpivot("side", ["illum", "los", "tmax"], "criterion", "value")
    s = aggregate.two_sample(rows)
    return s.select("criterion", "n_a", "n_b", *(r6(c).alias(c) for c in ("mean_a", "mean_b", "sd_a", "sd_b", "delta", "abs_delta", "t"))).orderBy(F.desc("abs_delta"))


_AREAS = "areas AS (SELECT region, count(*) AS n, coalesce(any_value(e.n), 0) AS ok FROM slopes LEFT JOIN (SELECT region, count(*) AS n FROM eligible GROUP BY region) e USING (region) GROUP BY region)"


@query("agg_zonal_area", f"{_ELIGIBLE}, {_AREAS} SELECT region, {sql6('n * 0.0576')} AS area_km2, {sql6('ok * 0.0576')} AS eligible_km2, {sql6('ok / n::DOUBLE')} AS fraction FROM areas")
def _area(spark, sf_dir):
    rows = validate.zonal_area(b.cells(spark, sf_dir), _eligible(spark, sf_dir), PIXEL)
    return rows.select("region", *(r6(c).alias(c) for c in ("area_km2", "eligible_km2", "fraction")))


@query("agg_stretch", f"WITH {CELLS} SELECT {sql6('quantile_cont(z, 0.01)')} AS p01, {sql6('quantile_cont(z, 0.99)')} AS p99 FROM cells")
def _stretch(spark, sf_dir):
    return aggregate.stretch(b.cells(spark, sf_dir), "z").select(r6("p01").alias("p01"), r6("p99").alias("p99"))


@query("agg_compare_sites", f"WITH {SITES}, {CATALOG}, {_MATCHES}, back AS (SELECT c.b_id, min(sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2)) / 1000 AS km FROM sites s, catalog c GROUP BY c.b_id) SELECT (SELECT count(*) FROM m) AS n_a, (SELECT count(*) FROM m WHERE km <= 5) AS matched_a, (SELECT {sql6('median(km)')} FROM m WHERE km <= 5) AS median_km, (SELECT {sql6('max(km)')} FROM m WHERE km <= 5) AS max_km, (SELECT count(*) FROM back) AS n_b, (SELECT count(*) FROM back WHERE km <= 5) AS matched_b")
def _compare(spark, sf_dir):
    s = validate.compare(b.sites(spark, sf_dir).select("a_id", "x", "y"), b.catalog(spark, sf_dir).select("b_id", "x", "y"), 5.0)
    return s.select("n_a", "matched_a", r6("median_km").alias("median_km"), r6("max_km").alias("max_km"), "n_b", "matched_b")


@query("agg_proximity", f"WITH {SITES}, {CATALOG}, {_MATCHES}, back AS (SELECT c.b_id, min(sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2)) / 1000 AS km FROM sites s, catalog c GROUP BY c.b_id) SELECT (SELECT count(*) FROM m) AS n_sites, (SELECT count(*) FROM m WHERE km <= 3) AS sites_near, (SELECT {sql6('median(km)')} FROM m) AS median_km, (SELECT count(*) FROM back) AS n_regions, (SELECT count(*) FROM back WHERE km <= 3) AS regions_near")
def _proximity(spark, sf_dir):
    s = validate.proximity(b.sites(spark, sf_dir).select("a_id", "x", "y"), b.catalog(spark, sf_dir).select("b_id", "x", "y"), 3.0)
    return s.select("n_sites", "sites_near", r6("median_km").alias("median_km"), "n_regions", "regions_near")


@query("agg_launch_years", f"WITH {SITES}, {CATALOG}, {_MATCHES}, j AS (SELECT d25, d30 FROM m JOIN catalog USING (b_id) WHERE km <= 5) SELECT 2025::BIGINT AS year, count(*) FILTER (WHERE d25 >= 10) AS passes FROM j UNION ALL SELECT 2030, count(*) FILTER (WHERE d30 >= 10) FROM j")
def _years(spark, sf_dir):
    catalog = b.catalog(spark, sf_dir)
    found = validate.matches(b.sites(spark, sf_dir).select("a_id", "x", "y"), catalog.select("b_id", "x", "y"), 5.0)
    return validate.launch_years(found, catalog, local.resolve_years(catalog.columns, [2025, 2030]))


def _year_sites(spark, sf_dir):
    catalog = b.catalog(spark, sf_dir)
    found = validate.matches(b.sites(spark, sf_dir).select("a_id", "x", "y"), catalog.select("b_id", "x", "y"), 5.0)
    return validate.launch_year_sites(found, catalog, local.resolve_years(catalog.columns, [2025, 2030]), headline=2030)


@query("agg_launch_sites", f"WITH {SITES}, {CATALOG}, {_MATCHES} SELECT a_id, CASE WHEN km <= 5 THEN b_id END AS b_id, CASE WHEN km <= 5 THEN {sql6('km')} END AS km, CASE WHEN km <= 5 THEN d25 END AS d25, CASE WHEN km <= 5 THEN d30 END AS d30, km <= 5 AND d30 >= 10 AS passes_headline, km <= 5 AND (d25 >= 10 OR d30 >= 10) AS passes_any FROM m JOIN catalog USING (b_id)")
def _launch_sites(spark, sf_dir):
    rows = _year_sites(spark, sf_dir)
    return rows.select("a_id", "b_id", r6("distance_km").alias("km"), *(F.col("days")[y].alias(f"d{y % 100}") for y in (2025, 2030)), "passes_headline", "passes_any")


@query("agg_launch_totals", f"WITH {SITES}, {CATALOG}, {_MATCHES} SELECT count(*) AS n_sites, count(*) FILTER (WHERE km <= 5) AS n_matched, count(*) FILTER (WHERE km <= 5 AND d30 >= 10) AS passes_headline, count(*) FILTER (WHERE km <= 5 AND (d25 >= 10 OR d30 >= 10)) AS passes_any FROM m JOIN catalog USING (b_id)")
def _launch_totals(spark, sf_dir):
    return validate.launch_year_totals(_year_sites(spark, sf_dir))


_RIM = "rim AS (SELECT b_id, x + 1500 * cos(k * (2 * pi() / 64)) AS x0, y + 1500 * sin(k * (2 * pi() / 64)) AS y0, x + 1500 * cos((k + 1) % 64 * (2 * pi() / 64)) AS x1, y + 1500 * sin((k + 1) % 64 * (2 * pi() / 64)) AS y1 FROM catalog, range(0, 64) r(k))"
_DISKS = f"""{_RIM},
near AS (SELECT *, least(1.0, greatest(0.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS t FROM (SELECT a_id, x, y FROM sites) s, rim),
per AS (SELECT a_id, b_id, {_CROSS} AS inside, min({_SEGMENT}) / 1000 AS e FROM near GROUP BY a_id, b_id),
d AS (SELECT p.a_id, p.b_id, inside, CASE WHEN inside THEN -e ELSE e END AS edge, sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2) / 1000 AS km FROM per p JOIN sites s USING (a_id) JOIN catalog c USING (b_id))"""


def _disk_rows(spark, sf_dir):
    ring = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.struct((F.col("x") + 1500 * F.cos(k * (2 * math.pi / 64))).alias("x"), (F.col("y") + 1500 * F.sin(k * (2 * math.pi / 64))).alias("y")))
    return b.sites(spark, sf_dir), b.catalog(spark, sf_dir).select("b_id", "x", "y", F.lit(1.5).alias("radius_km"), ring.alias("ring"))


@query("knn_disk_sites", f"WITH {SITES}, {CATALOG}, {_DISKS} SELECT a_id, arg_min(b_id, (km, b_id)) AS b_id, {sql6('min(km)')} AS distance_km, {sql6('min(edge)')} AS edge_km, bool_or(inside) AS inside FROM d GROUP BY a_id")
def _disk_sites(spark, sf_dir):
    rows = validate.sites_by_disks(*_disk_rows(spark, sf_dir))
    return rows.select("a_id", "b_id", r6("distance_km").alias("distance_km"), r6("edge_km").alias("edge_km"), "inside")


@query("knn_disk_regions", f"WITH {SITES}, {CATALOG}, {_DISKS} SELECT b_id, arg_min(a_id, (km, a_id)) AS a_id, {sql6('min(km)')} AS distance_km, {sql6('arg_min(edge, (km, a_id))')} AS edge_km, bool_or(inside) AS contains, arg_min(edge, (km, a_id)) <= 1.5 AS within_radius FROM d GROUP BY b_id")
def _disk_regions(spark, sf_dir):
    rows = validate.disks_by_sites(*_disk_rows(spark, sf_dir))
    return rows.select("b_id", "a_id", r6("distance_km").alias("distance_km"), r6("edge_km").alias("edge_km"), "contains", "within_radius")


@query("agg_proximity_totals", f"""SELECT * FROM (WITH {SITES}, {CATALOG}, {_DISKS}, s AS (SELECT a_id, min(km) AS km, bool_or(inside) AS inside FROM d GROUP BY a_id),
r AS (SELECT b_id, min(km) AS km, bool_or(inside) AS inside, arg_min(edge, (km, a_id)) AS edge FROM d GROUP BY b_id)
SELECT (SELECT count(*) FROM sites) AS n_sites, (SELECT count(*) FROM catalog) AS n_regions, (SELECT count(*) FROM s WHERE km <= 2) AS sites_near, (SELECT count(*) FROM s WHERE inside) AS sites_inside,
(SELECT count(*) FROM r WHERE km <= 2) AS regions_near, (SELECT count(*) FROM r WHERE inside) AS regions_with_site, (SELECT count(*) FROM r WHERE edge <= 1.5) AS regions_within_radius) a,
(WITH {SITES}, {EDGES}, {_PER_POLYGON}, o AS (SELECT a_id, bool_or(inside) AS inside, min(CASE WHEN inside THEN 0 ELSE d END) / 1000 AS km FROM per GROUP BY a_id)
SELECT (SELECT count(DISTINCT ordinal) FROM edges) AS n_polygons, count(*) FILTER (WHERE inside) AS sites_in_polygons, {sql6('median(km)')} AS median_polygon_km, (SELECT count(DISTINCT ordinal) FROM per WHERE inside) AS polygons_with_site FROM o) b""")
def _proximity_totals(spark, sf_dir):
    rows = validate.proximity_totals(*_disk_rows(spark, sf_dir), 2.0, b.polygons(spark))
    return rows.withColumn("median_polygon_km", r6("median_polygon_km"))


@query("agg_medians", f"SELECT c_mktsegment AS segment, {sql6('median(c_acctbal)')} AS median, false AS overall FROM customer GROUP BY 1 UNION ALL SELECT NULL, {sql6('median(c_acctbal)')}, true FROM customer")
def _medians_overall(spark, sf_dir):
    rows = b.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("double").alias("value"))
    return aggregate.medians(rows, "segment", "value").withColumn("median", r6("median"))


@query("agg_region_medians", f"WITH {CELLS}, {SLOPE}, {SCORED} SELECT region, {sql6('median(score)')} AS median_score FROM scored GROUP BY region")
def _medians(spark, sf_dir):
    return _scored(b.cells(spark, sf_dir)).groupBy("region").agg(r6(F.median("score")).alias("median_score"))


# --- ranking ------------------------------------------------------------------------------------------------------------------


def _nms(k: int, d2: float, by: str) -> str:
    return f"""cand AS (SELECT {by} AS g, "row", col, score, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, "row", col) AS n FROM pool),
pick AS (SELECT g, 1 AS k, [{{'r': "row", 'c': col}}] AS acc, n AS last FROM cand WHERE n = 1
  UNION ALL
  SELECT g, k, acc, last FROM (SELECT p.g, p.k + 1 AS k, list_append(p.acc, {{'r': c."row", 'c': c.col}}) AS acc, c.n AS last, row_number() OVER (PARTITION BY p.g ORDER BY c.n) AS i
    FROM pick p JOIN cand c ON c.g = p.g AND c.n > p.last WHERE p.k < {k} AND len(list_filter(p.acc, lambda a: (a.r - c."row") ** 2 + (a.c - c.col) ** 2 < {d2!r})) = 0) WHERE i = 1),
chosen AS (SELECT p.g, p.k::BIGINT AS "rank", c."row", c.col, c.score FROM pick p JOIN cand c ON c.g = p.g AND c.n = p.last)"""


@query("top_sites", f'WITH RECURSIVE {CELLS}, {SLOPE}, {SCORED}, pool AS (SELECT * FROM scored WHERE score >= 0.5), {_nms(20, (5000 / 240) ** 2, "1")} SELECT format(\'site_{{:02d}}\', "rank") AS site_id, "rank", "row", col, {sql6("score")} AS score FROM chosen')
def _top(spark, sf_dir):
    return rank.top_sites(_scored(b.cells(spark, sf_dir)), 20, 5000.0, 0.5, PIXEL).withColumn("score", r6("score"))


@query("top_sites_per_region", f'{_ELIGIBLE}, pool AS (SELECT * FROM eligible), {_nms(5, (2000 / 240) ** 2, "region")} SELECT g AS region, "rank" AS rank_in_region, "row", col, {sql6("score")} AS score, row_number() OVER (ORDER BY g, "rank") AS site_id FROM chosen')
def _top_regions(spark, sf_dir):
    return rank.top_sites_per_region(_eligible(spark, sf_dir), "region", 5, 2000.0, PIXEL).withColumn("score", r6("score"))


@query("top_sites_per_tile", f'{_ELIGIBLE}, pool AS (SELECT *, "row" // 30 AS tile FROM eligible), {_nms(3, (1500 / 240) ** 2, "tile")} SELECT g AS tile, "rank" AS rank_in_region, "row", col, {sql6("score")} AS score, row_number() OVER (ORDER BY g, "rank") AS site_id, 240.0::DOUBLE AS resolution_m FROM chosen')
def _top_tiles(spark, sf_dir):
    cells = _eligible(spark, sf_dir).withColumn("tile", F.expr("row div 30"))
    return rank.top_sites_per_region(cells, "tile", 3, 1500.0, PIXEL).withColumn("score", r6("score")).withColumn("resolution_m", F.lit(PIXEL))


_RANKED = f'{_ELIGIBLE}, pool AS (SELECT * FROM eligible), {_nms(5, (2000 / 240) ** 2, "region")}, s AS (SELECT *, row_number() OVER (ORDER BY g, "rank") AS site_id FROM chosen), {_AREAS}'


def _compliance_rows(spark, sf_dir):
    cells, eligible = b.cells(spark, sf_dir), _eligible(spark, sf_dir)
    areas = validate.zonal_area(cells, eligible, PIXEL)
    return validate.compliance(areas.select("region"), rank.top_sites_per_region(eligible, "region", 5, 2000.0, PIXEL), areas)


@query("agg_compliance", f"{_RANKED} SELECT a.region, count(s.g) AS n_sites, {sql6('max(score)')} AS best, {sql6('avg(score)')} AS mean, coalesce(arg_min(site_id, (-score, site_id)), 0) AS best_site, {sql6('any_value(a.ok / a.n::DOUBLE)')} AS fraction FROM areas a LEFT JOIN s ON s.g = a.region GROUP BY a.region")
def _compliance(spark, sf_dir):
    rows = _compliance_rows(spark, sf_dir)
    return rows.select("region", "n_sites", r6("best").alias("best"), r6("mean").alias("mean"), F.col("best_site").cast("long").alias("best_site"), r6("fraction").alias("fraction"))


@query("agg_compliance_totals", f"{_RANKED} SELECT (SELECT count(*) FROM s) AS n_sites_total, count(*) AS n_regions_total, count(*) FILTER (WHERE k > 0) AS n_regions_with_sites, count(*) FILTER (WHERE k = 0) AS n_regions_without, coalesce(string_agg(region::VARCHAR, ',' ORDER BY region::VARCHAR) FILTER (WHERE k = 0), '') AS regions_without FROM (SELECT a.region, count(s.g) AS k FROM areas a LEFT JOIN s ON s.g = a.region GROUP BY a.region)")
def _compliance_totals(spark, sf_dir):
    return validate.compliance_totals(_compliance_rows(spark, sf_dir))


@query("top_disagreements", f"WITH {SITES}, {CATALOG}, {_MATCHES} SELECT a_id, b_id, {sql6('km')} AS km FROM m WHERE km > 5 ORDER BY km DESC, a_id LIMIT 3")
def _disagree(spark, sf_dir):
    found = validate.matches(b.sites(spark, sf_dir).select("a_id", "x", "y"), b.catalog(spark, sf_dir).select("b_id", "x", "y"), 5.0)
    return validate.disagreements(found).select("a_id", "b_id", r6("distance_km").alias("km"))


@query("top_notable", f"""WITH {SITES}, {CATALOG}, {_MATCHES}, w AS (SELECT b_id, arg_min(a_id, (d, a_id)) AS a_id, min(d) / 1000 AS km FROM (SELECT a_id, c.b_id, sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2) AS d FROM sites s, catalog c) GROUP BY b_id)
SELECT * FROM (SELECT 'a' AS side, a_id AS id, b_id AS partner, {sql6('km')} AS distance_km FROM m WHERE km > 0.5 ORDER BY km DESC, a_id LIMIT 3) UNION ALL SELECT * FROM (SELECT 'b', b_id, a_id, {sql6('km')} FROM w WHERE km > 0.5 ORDER BY km DESC, b_id LIMIT 3)""")
def _notable(spark, sf_dir):
    found = validate.notable(b.sites(spark, sf_dir).select("a_id", "x", "y"), b.catalog(spark, sf_dir).select("b_id", "x", "y"), 0.5)
    return found.withColumn("distance_km", r6("distance_km"))


@query("knn_names", f"WITH {SITES}, {CATALOG}, {_MATCHES} SELECT a_id, c.region, {sql6('km')} AS distance_km FROM m JOIN catalog c USING (b_id)")
def _names(spark, sf_dir):
    return validate.nearest_names(b.sites(spark, sf_dir), b.catalog(spark, sf_dir)).withColumn("distance_km", r6("distance_km"))


_PARTS = "w AS (SELECT p_partkey AS sample_id, (p_partkey * 17 % 50 + 1)::DOUBLE AS a, (p_partkey * 29 % 50 + 1)::DOUBLE AS c, (p_partkey * 43 % 50 + 1)::DOUBLE AS d FROM part), samples AS (SELECT sample_id, a / (a + c + d) AS illum, c / (a + c + d) AS los, d / (a + c + d) AS warm FROM w)"


def _samples(spark, sf_dir):
    k = F.col("p_partkey")
    w = b.table(spark, sf_dir, "part").select(k.alias("sample_id"), (k * 17 % 50 + 1).cast("double").alias("a"), (k * 29 % 50 + 1).cast("double").alias("c"), (k * 43 % 50 + 1).cast("double").alias("d"))
    total = F.col("a") + F.col("c") + F.col("d")
    return w.select("sample_id", (F.col("a") / total).alias("illum"), (F.col("c") / total).alias("los"), (F.col("d") / total).alias("warm"))


@query("top_best_weights", f"WITH {_PARTS} SELECT sample_id, {sql6('illum')} AS illum FROM samples ORDER BY round(illum, 6) DESC, round(los, 6) DESC, sample_id LIMIT 1")
def _best(spark, sf_dir):
    rows = _samples(spark, sf_dir).withColumn("illum", r6("illum")).withColumn("los", r6("los"))
    return rank.best_weights(rows, ["illum", "los"]).select("sample_id", "illum")


@query("top_nearest_sample", f"WITH {_PARTS}, g AS (SELECT sample_id, round(abs(illum - 0.4) + abs(los - 0.35) + abs(warm - 0.25), 6) AS gap FROM samples) SELECT arg_min(sample_id, (gap, sample_id)) AS sample_id, min(gap) AS gap FROM g")
def _nearest_sample(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    gap = F.round(F.abs(F.col("illum") - 0.4) + F.abs(F.col("los") - 0.35) + F.abs(F.col("warm") - 0.25), 6)
    return rank.nearest_sample(rows.select("sample_id", gap.alias("g")), {"g": 0.0})


# --- sampling and sweeps --------------------------------------------------------------------------------------------------------


def _sampling(name: str, clamp: bool):
    row, col = "round_even(-(y + 3000) / 240.0 - 0.5, 0)::BIGINT", "round_even((x - 2000) / 240.0 - 0.5, 0)::BIGINT"
    if clamp:
        row, col = f'least(greatest({row}, 0), (SELECT max("row") FROM cells))', f"least(greatest({col}, 0), 124)"

    @query(name, f'WITH {CELLS}, {SITES} SELECT a_id, {row} AS "row", {col} AS col, {sql6("illum")} AS illum FROM (SELECT s.*, {row} AS rr, {col} AS cc FROM sites s) s LEFT JOIN cells c ON c."row" = rr AND c.col = cc'.replace("SELECT a_id, " + row + ' AS "row", ' + col + " AS col", 'SELECT a_id, rr AS "row", cc AS col'))
    def run(spark, sf_dir):
        cells = b.cells(spark, sf_dir)
        g = grid.GridSpec(0.0, 0.0, PIXEL, cells.agg(F.max("row")).first()[0] + 1, b.WIDTH)
        points = b.sites(spark, sf_dir).select("a_id", (F.col("x") - 2000).alias("x"), (F.col("y") + 3000).alias("y"))
        return grid.sample_nearest(points, cells.select("row", "col", "illum"), g, clamp).select("a_id", "row", "col", r6("illum").alias("illum"))


_sampling("smp_nearest", False)
_sampling("smp_clamped", True)


@query("smp_site_scores", f'WITH {CELLS}, {SLOPE}, {SCORED}, {SITES} SELECT a_id, {sql6("score")} AS aggregate_score, {sql6("slope")} AS slope_deg, {sql6("illum")} AS illumination, coalesce(slope <= 8 AND illum >= 0.33 AND los >= 0.5, false) AS hls_compliant FROM (SELECT *, least(greatest(round_even(-y / 240.0 - 0.5, 0)::BIGINT, 0), (SELECT max("row") FROM cells)) AS rr, least(greatest(round_even(x / 240.0 - 0.5, 0)::BIGINT, 0), 124) AS cc FROM sites) s LEFT JOIN scored c ON c."row" = rr AND c.col = cc')
def _site_scores(spark, sf_dir):
    cells = focal.slope_degrees(_scored(b.cells(spark, sf_dir)), PIXEL).drop("region")
    g = grid.GridSpec(0.0, 0.0, PIXEL, cells.agg(F.max("row")).first()[0] + 1, b.WIDTH)
    rows = grid.sample_nearest(b.sites(spark, sf_dir).select("a_id", "x", "y"), cells, g, clamp=True)
    return rows.select("a_id", r6("score").alias("aggregate_score"), r6("slope").alias("slope_deg"), r6("illum").alias("illumination"), local.hls_compliant(F.col("slope"), F.col("illum"), F.col("los")).alias("hls_compliant"))


@query("smp_crop", f'WITH {CELLS} SELECT "row", col, {sql6("z")} AS z FROM cells WHERE "row" BETWEEN 4 AND 24 AND col BETWEEN 30 AND 50')
def _crop(spark, sf_dir):
    return grid.crop(b.cells(spark, sf_dir), 14, 40, 10).select("row", "col", r6("z").alias("z"))


@query("swp_latin_hypercube")
def _hypercube(spark, sf_dir):
    return sweep.latin_hypercube(spark, 64, ["a", "b", "c", "d"])


_SWEEP = """vectors AS (SELECT illum, los, warm, min(sample_id) AS sample_id FROM samples GROUP BY ALL),
pool AS (SELECT s.sample_id, c."row", c.col, round(s.illum * c.illum + s.los * c.los + s.warm * (c.tmax / 200), 9) AS score FROM cells c, vectors s WHERE c.tmax IS NOT NULL)"""
#: Samples of equal weights share the sites of the first of them.
_SHARED = "shared AS (SELECT s.sample_id, c.* FROM samples s JOIN vectors v USING (illum, los, warm) JOIN chosen c ON c.g = v.sample_id)"


def _swept(spark, sf_dir):
    """Sites of all samples over all cells; samples of the same weights are swept once and share their sites."""
    cells, names = b.cells(spark, sf_dir).withColumn("warm", F.col("tmax") / 200), ["illum", "los", "warm"]
    samples = _samples(spark, sf_dir)
    vectors = samples.groupBy(*names).agg(F.min("sample_id").alias("first"))
    scored = sweep.sweep_scores(cells, vectors.withColumnRenamed("first", "sample_id"), {n: n for n in names})
    sites = sweep.sweep_sites(scored.withColumn("score", F.round("score", 9)), 6, 3000.0, PIXEL)
    return samples.join(vectors, names).select("sample_id", "first").join(sites.withColumnRenamed("sample_id", "first"), "first").drop("first")


@query("swp_weights", f"""WITH RECURSIVE {CELLS}, {_PARTS}, {_SWEEP}, {_nms(6, (3000 / 240) ** 2, 'sample_id')}, {CATALOG},
placed AS (SELECT g, "rank" AS k, score, {X} AS x, {Y} AS y FROM chosen),
d AS (SELECT g, k, b_id, sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2) / 1000 AS km FROM placed p, catalog c),
m AS (SELECT g, count(DISTINCT k) FILTER (WHERE km <= 4) AS sites_near, count(DISTINCT k) FILTER (WHERE km <= 9) AS sites_far, count(DISTINCT b_id) FILTER (WHERE km <= 4) AS regions_near FROM d GROUP BY g),
n AS (SELECT g, count(*) AS n_sites, avg(score) AS mean FROM placed GROUP BY g)
SELECT s.sample_id, n_sites, sites_near, sites_far, regions_near, {sql6('mean')} AS mean_score FROM samples s JOIN vectors v USING (illum, los, warm) JOIN m ON m.g = v.sample_id JOIN n ON n.g = v.sample_id""")
def _sweep_weights(spark, sf_dir):
    sites = _swept(spark, sf_dir).withColumn("a_id", F.col("sample_id") * 1000 + F.col("rank"))
    rows = sweep.sweep_metrics(sites, b.catalog(spark, sf_dir).select("b_id", "x", "y"), b.grid().x(F.col("col")), b.grid().y(F.col("row")), 4.0, 9.0)
    return rows.withColumn("mean_score", r6("mean_score"))


@query("swp_centroid_scores", f"""WITH {CELLS}, {_PARTS}, {CATALOG},
spot AS (SELECT DISTINCT round_even(-y / 240.0 - 0.5, 0)::BIGINT AS r, round_even(x / 240.0 - 0.5, 0)::BIGINT AS c FROM catalog)
SELECT sample_id, {sql6('avg(s.illum * c.illum + s.los * c.los + s.warm * (c.tmax / 200))')} AS mean_at FROM samples s, cells c JOIN spot ON r = c."row" AND spot.c = c.col GROUP BY sample_id""")
def _centroid_scores(spark, sf_dir):
    cells, g, catalog = b.cells(spark, sf_dir).withColumn("warm", F.col("tmax") / 200), b.grid(), b.catalog(spark, sf_dir)
    at = catalog.select(g.row(F.col("y")).alias("row"), g.col(F.col("x")).alias("col")).distinct()
    rows = sweep.scores_at(cells.join(at, ["row", "col"], "left_semi"), _samples(spark, sf_dir), {n: n for n in ("illum", "los", "warm")})
    return rows.withColumn("mean_at", r6("mean_at"))


@query("swp_distance", f'WITH {CELLS}, s AS (SELECT d::DOUBLE AS distance_km, density / 10 AS psr, scarp_km / 8 AS ridge FROM cells, (VALUES (1.0), (2.0), (5.0), (10.0)) t(d)) SELECT distance_km, count(*) FILTER (WHERE v > 0) AS n_positive, {sql6("avg(v)")} AS mean_score, {sql6("max(v)")} AS max_score FROM (SELECT distance_km, least(greatest(1 - psr / distance_km, 0), 1) * least(greatest(1 - ridge / distance_km, 0), 1) AS v FROM s) GROUP BY distance_km')
def _sweep_distance(spark, sf_dir):
    part = lambda c: F.least(F.greatest(1 - c / F.col("distance_km"), F.lit(0.0)), F.lit(1.0))
    rows = sweep.sweep_distance(b.cells(spark, sf_dir), [1.0, 2.0, 5.0, 10.0], part(F.col("density") / 10) * part(F.col("scarp_km") / 8))
    return rows.groupBy("distance_km").agg(F.count_if(F.col("score") > 0).alias("n_positive"), r6(F.avg("score")).alias("mean_score"), r6(F.max("score")).alias("max_score"))


@query("top_best_distance", f'WITH {CELLS}, s AS (SELECT d::DOUBLE AS distance_km, count(*) FILTER (WHERE density / 10 < d AND scarp_km / 8 < d) AS n_positive FROM cells, (VALUES (1.0), (2.0), (5.0), (10.0), (20.0)) t(d) GROUP BY d) SELECT * FROM s ORDER BY n_positive DESC, distance_km LIMIT 1')
def _best_distance(spark, sf_dir):
    part = lambda c: F.least(F.greatest(1 - c / F.col("distance_km"), F.lit(0.0)), F.lit(1.0))
    rows = sweep.sweep_distance(b.cells(spark, sf_dir), [1.0, 2.0, 5.0, 10.0, 20.0], part(F.col("density") / 10) * part(F.col("scarp_km") / 8))
    return rank.best_distance(rows.groupBy("distance_km").agg(F.count_if(F.col("score") > 0).alias("n_positive")), "n_positive")


@query("agg_sweep_statistics", f"WITH RECURSIVE {CELLS}, {_PARTS}, {_SWEEP}, {_nms(6, (3000 / 240) ** 2, 'sample_id')}, {_SHARED}, n AS (SELECT sample_id, count(*) FILTER (WHERE col < 60) AS west, count(*) FILTER (WHERE score >= 0.9) AS high FROM shared GROUP BY sample_id) SELECT min(west) AS west_min, floor(median(west))::BIGINT AS west_median, max(west) AS west_max, min(high) AS high_min, floor(median(high))::BIGINT AS high_median, max(high) AS high_max FROM n")
def _sweep_statistics(spark, sf_dir):
    n = _swept(spark, sf_dir).groupBy("sample_id").agg(F.count_if(F.col("col") < 60).alias("west"), F.count_if(F.col("score") >= 0.9).alias("high"))
    return sweep.sweep_statistics(n, ["west", "high"])


@query("swp_containment", f"""WITH RECURSIVE {CELLS}, {_PARTS}, {_SWEEP}, {_nms(6, (3000 / 240) ** 2, 'sample_id')}, {SITES}, {CATALOG}, {_RIM},
placed AS (SELECT g, "rank" AS k, {X} AS x, {Y} AS y FROM chosen),
held AS (SELECT g, k, b_id, {_CROSS} AS inside FROM placed, rim GROUP BY g, k, b_id),
n AS (SELECT g, count(DISTINCT k) AS sites_inside, count(DISTINCT b_id) AS regions_with_site FROM held WHERE inside GROUP BY g)
SELECT s.sample_id, sites_inside, regions_with_site FROM samples s JOIN vectors v USING (illum, los, warm) JOIN n ON n.g = v.sample_id""")
def _sweep_containment(spark, sf_dir):
    return sweep.sweep_containment(_swept(spark, sf_dir), _disk_rows(spark, sf_dir)[1], b.grid().x(F.col("col")), b.grid().y(F.col("row")))


# --- sources and sinks --------------------------------------------------------------------------------------------------------------


@query("src_disk_rings", f"WITH {SITES} SELECT a_id, k::BIGINT AS k, (round(x + 15000 * cos(k * (2 * pi() / 64)), 3) + 0.0) AS x, (round(y + 15000 * sin(k * (2 * pi() / 64)), 3) + 0.0) AS y FROM (SELECT a_id, 2 * 1737400.0 * tan(pi() / 4 + radians(-89 + a_id % 10) / 2) * sin(radians(a_id * 13.0)) AS x, 2 * 1737400.0 * tan(pi() / 4 + radians(-89 + a_id % 10) / 2) * cos(radians(a_id * 13.0)) AS y FROM sites) s, range(0, 64) r(k)")
def _rings(spark, sf_dir):
    k = F.col("a_id")
    centres = b.sites(spark, sf_dir).select("a_id", (-89 + k % 10).cast("double").alias("lat"), (k * 13.0).alias("lon"), F.lit(15.0).alias("radius_km"))
    return tables.disk_rings(centres).select("a_id", F.posexplode("ring").alias("k", "p")).select("a_id", F.col("k").cast("long").alias("k"), (F.round("p.x", 3) + 0.0).alias("x"), (F.round("p.y", 3) + 0.0).alias("y"))


@query("src_scaled_layers", "SELECT o_orderkey AS id, (o_orderkey % 30000 - 15000) * 0.5::DOUBLE AS metres, (round((o_orderkey % 25000) * 0.00004::DOUBLE, 9) + 0.0) AS fraction, CASE WHEN o_orderkey % 50 <> 0 THEN (o_orderkey % 50)::DOUBLE END AS value FROM orders")
def _scaled(spark, sf_dir):
    k = F.col("o_orderkey")
    dn = k % 50
    return b.table(spark, sf_dir, "orders").select(k.alias("id"), ((k % 30000 - 15000) * tables.ELEVATION_SCALE).alias("metres"), (F.round(k % 25000 * tables.ILLUMINATION_SCALE, 9) + 0.0).alias("fraction"), F.when(~dn.isin(0), dn.cast("double")).alias("value"))


@query("src_placeholder", "SELECT coalesce(bool_and(starts_with(s_name, 'Supplier')), false) AS placeholder FROM supplier")
def _placeholder(spark, sf_dir):
    return b.table(spark, sf_dir, "supplier").agg(tables.is_placeholder("s_name", "Supplier").alias("placeholder"))


@query("snk_text_table", f"WITH {SITES} SELECT lpad(a_id::VARCHAR, 6, ' ') || ' ' || lpad(CASE WHEN a_id % 3 = 0 THEN '--' ELSE region END, 8, ' ') AS value FROM sites")
def _text(spark, sf_dir):
    rows = b.sites(spark, sf_dir).select("a_id", F.when(F.col("a_id") % 3 != 0, F.col("region")).alias("region"))
    return tables.text_table(rows, {"a_id": 6, "region": 8})


@query("snk_geojson", "SELECT '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || (s_suppkey % 180) || '.0,-' || (s_suppkey % 9 + 80) || '.0]},\"properties\":{\"site_id\":' || s_suppkey || ',\"rank\":' || CASE WHEN s_suppkey % 4 = 0 THEN 'null' ELSE (s_suppkey % 4)::VARCHAR END || '}}' AS value FROM supplier")
def _geojson(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = b.table(spark, sf_dir, "supplier").select(k.alias("site_id"), F.when(k % 4 != 0, k % 4).alias("rank"), (k % 180).cast("double").alias("lon"), (-(k % 9 + 80)).cast("double").alias("lat"))
    return tables.geojson_features(rows)


del _name, _sql
