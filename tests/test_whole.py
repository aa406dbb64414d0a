"""Queries cover all rows of their tables: fixtures larger than the smallest tables, against brute force."""

import math

import numpy as np
import pytest

from rastermill.operators import spatial
from rastermill.plans import queries as engine

HEIGHT, WIDTH, PIXEL = 50, 125, 240.0


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """orders of 50 grid rows; parts, suppliers and nations to go with them."""
    path = str(tmp_path_factory.mktemp("grown"))
    spark.range(HEIGHT * WIDTH).selectExpr("id as o_orderkey", "id * 7 % 1500 as o_custkey", "cast(id * 48271 % 400009 as double) as o_totalprice").write.parquet(f"{path}/orders.parquet")
    spark.range(70).selectExpr("id as p_partkey").write.parquet(f"{path}/part.parquet")
    spark.range(10).selectExpr("id as s_suppkey").write.parquet(f"{path}/supplier.parquet")
    spark.range(25).selectExpr("cast(id as int) as n_nationkey").write.parquet(f"{path}/nation.parquet")
    return path


def heights():
    k = np.arange(HEIGHT * WIDTH)
    return np.where(k % 97 != 0, k * 48271 % 400009 / 16384, np.nan).reshape(HEIGHT, WIDTH)


# --- horizon


def brute_horizon(z, row, col, azimuth):
    """36 azimuths, 50 distances from a pixel to 100 km."""
    t, best = 2 * math.pi * azimuth / 36, -90.0
    for i in range(50):
        d = PIXEL * (100_000 / PIXEL) ** (i / 49)
        r, c = row + round(-math.cos(t) * d / PIXEL, 9), col + round(math.sin(t) * d / PIXEL, 9)
        r0, c0 = math.floor(r), math.floor(c)
        value = 0.0
        for y, wy in ((r0, 1 - (r - r0)), (r0 + 1, r - r0)):
            for x, wx in ((c0, 1 - (c - c0)), (c0 + 1, c - c0)):
                if wy * wx:
                    value += wy * wx * (z[y, x] if 0 <= y < z.shape[0] and 0 <= x < z.shape[1] else np.nan)
        angle = math.degrees(math.atan2(value - z[row, col] - d * d / (2 * 1737400.0), d))
        best = best if math.isnan(angle) else max(best, angle)
    return best


def test_horizon_of_all_cells_by_all_rays(spark, grown):
    got = {(r["row"], r["col"], r["azimuth"]): r["horizon"] for r in engine.QUERIES["foc_horizon"](spark, grown).collect()}
    assert len(got) == HEIGHT * WIDTH * 36
    z = heights()
    for row, col in ((0, 0), (0, 1), (11, 60), (12, 60), (30, 3), (49, 124)):
        for azimuth in range(36):
            assert got[row, col, azimuth] == pytest.approx(brute_horizon(z, row, col, azimuth), abs=2e-6), (row, col, azimuth)


def test_visibility_of_all_cells(spark, grown):
    got = engine.QUERIES["vis_fraction"](spark, grown).collect()
    assert {(r["row"], r["col"]) for r in got} == {(r, c) for r in range(HEIGHT) for c in range(WIDTH)}
    assert all(0 <= r["visible"] <= 1 for r in got)


# --- sweeps


def greedy(scores, n, d2):
    chosen = []
    for score, row, col in sorted(scores, key=lambda s: (-s[0], s[1], s[2])):
        if len(chosen) < n and all((row - r) ** 2 + (col - c) ** 2 >= d2 for _, r, c in chosen):
            chosen.append((score, row, col))
    return [(row, col) for _, row, col in chosen]


def test_sweep_of_all_samples_over_all_cells(spark, grown):
    cells = [(r["row"], r["col"], r["illum"], r["los"], r["tmax"] / 200) for r in engine.b.cells(spark, grown).where("tmax is not null").collect()]
    got = {}
    for r in engine._swept(spark, grown).orderBy("sample_id", "rank").collect():
        got.setdefault(r["sample_id"], []).append((r["row"], r["col"]))
    weights = {r["sample_id"]: (r["illum"], r["los"], r["warm"]) for r in engine._samples(spark, grown).collect()}
    assert set(got) == set(weights) and len(got) == 70
    for i in (0, 11, 12, 49, 50, 61, 69):
        a, c, d = weights[i]
        assert got[i] == greedy([(round(a * x + c * y + d * w, 9), row, col) for row, col, x, y, w in cells], 6, (3000 / 240) ** 2), i
    assert any(row >= 40 for sites in got.values() for row, _ in sites)
    assert engine.QUERIES["swp_weights"](spark, grown).count() == 70


# --- scarps


def test_scarp_distances_of_all_cells(spark, grown):
    points = np.array([(r["x"], r["y"]) for r in engine._scarps(spark, grown).collect()])
    got = {(r["row"], r["col"]): r["km"] for r in engine.QUERIES["dst_scarps"](spark, grown).collect()}
    assert len(got) == HEIGHT * WIDTH
    for (row, col), km in got.items():
        assert km == pytest.approx(np.hypot(points[:, 0] - (col + 0.5) * PIXEL, points[:, 1] + (row + 0.5) * PIXEL).min() / 1000, abs=6e-4)


def test_nearest_in_arrays_equals_broadcast(spark):
    a = spark.range(300).selectExpr("id as a_id", "cast(id * 37 % 50 as double) as x", "cast(id * 11 % 40 as double) as y")
    p = spark.range(80).selectExpr("79 - id as b_id", "cast(id * 7 % 20 as double) as x", "cast(id * 3 % 20 as double) as y")
    assert sorted(map(tuple, spatial.nearest(a, p).collect())) == sorted(map(tuple, spatial.nearest(a, p, broadcast_rows=5, array_rows=100).collect()))


# --- resampling


def test_targets_cover_the_whole_raster(spark, grown):
    z = heights()
    sizes = {"nearest": (119, 299), "bilinear": (119, 299), "cubic": (119, 299), "min": (13, 32), "max": (13, 32), "mean": (13, 32), "median": (13, 32)}
    for method, (h, w) in sizes.items():
        got = {(r["row"], r["col"]): r["z"] for r in engine.QUERIES[f"int_{method}"](spark, grown).collect()}
        assert set(got) == {(r, c) for r in range(h) for c in range(w)}, method
        if method == "nearest":
            for r, c in ((0, 0), (60, 80), (100, 200), (118, 290)):
                v = z[round((120 + (r + 0.5) * 100) / PIXEL - 0.5), round((120 + (c + 0.5) * 100) / PIXEL - 0.5)]
                assert got[r, c] is None if np.isnan(v) else got[r, c] == pytest.approx(v, abs=1e-6)
        elif method == "bilinear":
            v, u = (120 + 100.5 * 100) / PIXEL - 0.5, (120 + 201.5 * 100) / PIXEL - 0.5
            r, c = int(v), int(u)
            want = [(wy * wx, z[y, x]) for y, wy in ((r, 1 - (v - r)), (r + 1, v - r)) for x, wx in ((c, 1 - (u - c)), (c + 1, u - c)) if not np.isnan(z[y, x])]
            assert got[100, 201] == pytest.approx(sum(a * b for a, b in want) / sum(a for a, _ in want), abs=1e-6)
        elif method != "cubic":
            rows, cols = (np.rint((np.arange(n) + 0.5) / 4 - 0.5) for n in (HEIGHT, WIDTH))
            for r, c in ((0, 0), (9, 30), (11, 31), (12, 5)):
                part = z[np.ix_(rows == r, cols == c)]
                assert got[r, c] == pytest.approx(getattr(np, f"nan{method}")(part), abs=1e-6), (method, r, c)
