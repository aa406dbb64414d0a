"""Nearest neighbours in trees and on tiles, against brute force; no pairs but those of the nearest are formed."""

import math

import numpy as np
import pytest
from pyspark.sql.functions import col as t_col

from rastermill.operators import distance, grid, resample, spatial
from rastermill.plans import queries as engine


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute(a, b, k, within=math.inf):
    out = []
    for i, x, y in a:
        near = sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for j, u, v in b)[:k] if x is not None else []
        near = [(d, j) for d, j in near if d <= within]
        out += [(i, p + 1, j, d) for p, (d, j) in enumerate(near)] or [(i, None, None, None)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def sides(spark):
    """Points with ties and copies, in two clusters; targets among and far from them, and one without a place."""
    rng = np.random.default_rng(5)
    b = [(999 - i, float(rng.integers(0, 25) + 500 * (i % 2)), float(rng.integers(0, 25))) for i in range(900)]
    a = [(i, float(rng.integers(-10, 540)), float(rng.integers(-10, 40))) for i in range(150)] + [(900, 1e7, -2e6), (901, None, 3.0)]
    return a, b, spark.createDataFrame(a, "a_id long, x double, y double"), spark.createDataFrame(b, "b_id long, x double, y double")


@pytest.mark.parametrize("array_rows", [1000, 10])
@pytest.mark.parametrize(("k", "within"), [(1, math.inf), (3, math.inf), (3, 12.0)])
def test_nearest_few_equals_brute_force(spark, sides, array_rows, k, within):
    a, b, left, right = sides
    rows = spatial.nearest_few(left, right.withColumn("twice", right.b_id * 2), k, within, ["twice"], array_rows=array_rows, tile_rows=100).collect()
    assert sorted(((r["a_id"], r["place"], r["b_id"], r["distance_m"]) for r in rows), key=str) == brute(a, b, k, within)
    assert all(r["twice"] == (None if r["b_id"] is None else 2 * r["b_id"]) for r in rows)


def test_nearest_by_broadcast_equals_brute_force(sides):
    a, b, left, right = sides
    want = [(i, j, d) for i, _, j, d in brute(a, b, 1)]
    for rows in (spatial.nearest(left, right), spatial.nearest(left, right, broadcast_rows=5)):
        assert sorted(map(tuple, rows.collect()), key=str) == sorted(want, key=str)


def test_scattered_nearest_forms_no_pairs(spark, tmp_path):
    """6,000 sites met 90,000 points in buckets of 10 km, nearly all of them by all."""
    path = str(tmp_path)
    spark.range(40).selectExpr("id as s_suppkey").write.parquet(f"{path}/supplier.parquet")
    spark.range(2500).selectExpr("id as c_custkey", "id * 7 % 1000 / 100D as c_acctbal").write.parquet(f"{path}/customer.parquet")
    found = engine.QUERIES["int_scattered_nearest"](spark, path)
    assert "Join" not in plan(found) and "CartesianProduct" not in plan(found)
    sites = [(r["a_id"], r["x"], r["y"]) for r in engine.b.sites(spark, path).collect()]
    points = engine.b.points(spark, path).collect()
    value = {r["b_id"]: r["value"] for r in points}
    want = {i: round(value[j], 6) for i, _, j, _ in brute(sites, [(r["b_id"], r["x"], r["y"]) for r in points], 1)}
    assert {r["a_id"]: r["value"] for r in found.collect()} == pytest.approx(want)


def test_scattered_linear_forms_no_pairs(spark, sides):
    """every point within 4 km of a site made a pair, 5.8 % of all."""
    a, b, left, right = sides
    value = {j: float(j % 37) for j, _, _ in b}
    found = resample.scattered_linear(left, right.selectExpr("*", "double(b_id % 37) as v"), "v", 12.0)
    assert "Join" not in plan(found) and "CartesianProduct" not in plan(found)
    want = {i: None for i, _, _ in a}
    for i in want:
        three = [(d, value[j]) for k, _, j, d in brute([t for t in a if t[0] == i], b, 3, 12.0) if j is not None]
        if len(three) == 3:
            want[i] = three[0][1] if min(d for d, _ in three) == 0 else sum(v / d for d, v in three) / sum(1 / d for d, _ in three)
    got = {r["a_id"]: r["v"] for r in found.collect()}
    assert {i for i, v in got.items() if v is None} == {i for i, v in want.items() if v is None} and len(got) == len(want)
    assert all(v is None or v == pytest.approx(want[i]) for i, v in got.items())


def test_feature_distances_of_many_points_form_no_pairs(spark):
    """above 50,000 scarp points, cells far off met all of them in buckets."""
    points = spark.range(60_000).selectExpr("id as b_id", "double(id * 7919 % 30011) as x", "double(id * 104729 % 28813) as y")
    cells = spark.range(200).selectExpr("id as a_id", "double(id * 150) as x", "double(id * id * -400) as y")
    found = distance.feature_distance(cells, points)
    assert "Join" not in plan(found) and "CartesianProduct" not in plan(found)
    k = np.arange(60_000)
    x, y = k * 7919 % 30011, k * 104729 % 28813
    got = {r["a_id"]: r["km"] for r in found.collect()}
    assert got == {i: np.sqrt((x - i * 150.0) ** 2 + (y + i * i * 400.0) ** 2).min() / 1000 for i in range(200)}


# --- resampling on tiles


def shuffled(df):
    """Rows that the exchanges of the executed plan wrote."""
    def walk(node):
        name, own = node.nodeName(), 0
        if name == "Exchange":
            own = node.metrics().apply("shuffleRecordsWritten").value()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
        return own + sum(map(walk, inner))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic"])
@pytest.mark.parametrize(("left", "top", "pixel", "height", "width"), [(20.0, -20.0, 7.0, 60, 70), (-35.0, 41.0, 3.0, 100, 90), (5.0, -5.0, 33.0, 40, 40)])
def test_grid_targets_equal_joined_ones(spark, method, left, top, pixel, height, width):
    rng = np.random.default_rng(2)
    rows = [(r, c, None if rng.random() < 0.1 else float(rng.normal()), float(r * c)) for r in range(50) for c in range(45) if rng.random() < 0.95]
    src, g, t = spark.createDataFrame(rows, "row long, col long, z double, e double"), grid.GridSpec(0, 0, 10.0, 50, 45), grid.GridSpec(left, top, pixel, height, width)
    target = t.cells(spark).withColumn("x", t.x(t_col("col"))).withColumn("y", t.y(t_col("row")))
    one, two = ({(r["row"], r["col"]): (r["z"], r["e"]) for r in resample.resampled(src, g, x, ["z", "e"], method).collect()} for x in (t, target))
    assert len(one) == height * width and one.keys() == two.keys()
    for k, values in one.items():
        for a, b in zip(values, two[k], strict=True):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-6, abs=1e-6)), (k, a, b)


def test_cubic_moves_source_cells_once(spark, tmp_path):
    """F2: each of the 5.8 targets a cell met its 16 source cells by a shuffle."""
    path = str(tmp_path)
    spark.range(120 * 125).selectExpr("id as o_orderkey", "id * 7 % 1500 as o_custkey", "cast(id * 48271 % 400009 as double) as o_totalprice").write.parquet(f"{path}/orders.parquet")
    found = engine.QUERIES["int_cubic"](spark, path)
    assert "Join" not in plan(found)
    assert found.count() == 287 * 299
    found.collect()
    assert 120 * 125 <= shuffled(found) < 1.2 * 120 * 125
