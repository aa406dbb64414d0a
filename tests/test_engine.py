"""The engine's operators: hand-made grids, analytic answers, metamorphic properties and error contracts."""

import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.functions import crs, local
from rastermill.operators import aggregate, distance, focal, grid, rank, resample, spatial, sweep, validate
from rastermill.sources import tables

PIXEL = 240.0


def cells_of(spark, arrays):
    names = list(arrays)
    h, w = np.asarray(arrays[names[0]], dtype=object).shape
    rows = [(r, c, *(None if arrays[n][r][c] is None else float(arrays[n][r][c]) for n in names)) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "row long, col long, " + ", ".join(f"{n} double" for n in names))


def array_of(df, layer, h, w):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        if r[layer] is not None:
            out[r["row"], r["col"]] = r[layer]
    return out


@pytest.mark.parametrize("angle", [0, 5, 10, 30])
def test_slope_recovers_a_plane_and_keeps_gaps(spark, angle):
    z = [[c * PIXEL * math.tan(math.radians(angle)) for c in range(8)] for _ in range(6)]
    z[3][4] = None
    s = array_of(focal.slope_degrees(cells_of(spark, {"z": z}), PIXEL), "slope", 6, 8)
    assert np.isnan(s[0]).all() and np.isnan(s[:, 0]).all() and np.isnan(s[3, 4]) and np.isnan(s[3, 3]) and np.isnan(s[2, 4])
    assert abs(s[1, 2] - angle) < 1e-6


def test_slope_of_a_table_with_missing_cells(spark):
    df = cells_of(spark, {"z": np.zeros((5, 5))}).where("not (row = 2 and col = 2)")
    s = array_of(focal.slope_degrees(df, PIXEL), "slope", 5, 5)
    assert np.isnan(s[2, 1]) and np.isnan(s[1, 2]) and s[1, 1] == 0


def test_scores_by_hand(spark):
    row = spark.range(1).select(
        local.inverse_threshold(F.lit(7.5), 15).alias("a"), local.inverse_threshold(F.lit(None).cast("double"), 15).alias("b"), local.seismic_score(F.lit(float("inf"))).alias("c"), local.seismic_score(F.lit(25.0)).alias("d"),
        local.visibility_score(F.lit(0.35)).alias("e"), local.psr_mask(F.lit(None).cast("double")).alias("f"), local.ice_score(F.lit(None).cast("double"), F.lit(True)).alias("g"), local.ice_score(F.lit(0.0), F.lit(False)).alias("h"),
        local.coupling_score(F.lit(2.5), F.lit(0.0)).alias("i"), local.dominant({"x": F.lit(0.2), "y": F.lit(None).cast("double"), "z": F.lit(0.9), "w": F.lit(0.2)}, 2).alias("j"),
    ).first()
    assert row["a"] == 0.5 and row["b"] is None and row["c"] == 1 and row["d"] == 0.5 and abs(row["e"] - 0.5) < 1e-12
    assert row["f"] is False and row["g"] == pytest.approx(0.2) and row["h"] == 1.0 and row["i"] == 0.5 and row["j"] == ["z", "x"]


@pytest.mark.parametrize("f", [lambda: local.inverse_threshold(F.lit(1.0), 0), lambda: local.visibility_score(F.lit(1.0), 0.5, 0.5), lambda: local.illumination_score(F.lit(1.0), 0), lambda: aggregate.normalised_weights([], {}), lambda: aggregate.normalised_weights(["a"], {"a": 0.0}), lambda: aggregate.normalised_weights(["a"], {"a": -1.0}), lambda: grid.GridSpec(0, 0, 0, 1, 1), lambda: local.first_present(["a"], ["b"]), lambda: local.resolve_years(["SunDays25"], [2025, 2026])])
def test_value_errors(spark, f):
    with pytest.raises(ValueError):
        f()


def test_weights():
    with pytest.raises(KeyError):
        aggregate.normalised_weights(["a", "b"], {"a": 1.0})
    with pytest.warns(UserWarning):
        assert aggregate.normalised_weights(["a"], {"a": 2.0, "b": 1.0}) == {"a": 1.0}
    assert local.resolve_years(["SunDays25", "Sundays30"], [2025, 2030]) == {2025: "SunDays25", 2030: "Sundays30"}
    assert sum(aggregate.DEFAULT_WEIGHTS.values()) == pytest.approx(1) and set(aggregate.DEFAULT_WEIGHTS) == set(aggregate.CRITERIA)


def test_stereographic_round_trip(spark):
    p = spark.createDataFrame([(30.0, -85.0), (-170.0, -89.5), (0.0, -80.0)], "lon double, lat double").select("lon", "lat", crs.stereo_x(F.col("lon"), F.col("lat")).alias("x"), crs.stereo_y(F.col("lon"), F.col("lat")).alias("y"))
    for r in p.select("lon", "lat", crs.lon_of(F.col("x"), F.col("y")).alias("lon2"), crs.lat_of(F.col("x"), F.col("y")).alias("lat2")).collect():
        assert r["lon"] == pytest.approx(r["lon2"], abs=1e-9) and r["lat"] == pytest.approx(r["lat2"], abs=1e-9)


def test_volatile_access_equals_brute_force_and_nests(spark):
    rng = np.random.default_rng(1)
    t = rng.uniform(40, 200, (30, 40)).astype(object)
    t[rng.random((30, 40)) < 0.1] = None
    df = cells_of(spark, {"tmax": t})
    found = focal.volatile_access(df, 500.0, radius_m=2000.0).collect()
    for r in found:
        i, j = r["row"], r["col"]
        if t[i, j] is None:
            assert r["h2o"] is None
            continue
        disc = [t[y, x] for y in range(30) for x in range(40) if (y - i) ** 2 + (x - j) ** 2 <= 16 and t[y, x] is not None]
        assert r["h2o"] == pytest.approx(sum(v < 110 for v in disc) / len(disc)) and r["ultracold"] <= r["co2"] <= r["h2o"]
    tiled = focal.over_tiles(df, ["tmax"], 4, lambda a: {"n": focal.disc_sum((~np.isnan(a["tmax"])).astype(float), 2000.0, 500.0)}, ["n"], tile=8)
    whole = focal.over_tiles(df, ["tmax"], 4, lambda a: {"n": focal.disc_sum((~np.isnan(a["tmax"])).astype(float), 2000.0, 500.0)}, ["n"], tile=64)
    assert sorted(map(tuple, tiled.collect())) == sorted(map(tuple, whole.collect()))
    with pytest.raises(ValueError):
        focal.volatile_access(df, 500.0, classes=(("a", 60.0), ("b", 110.0)), weights=(1, 1))


def test_horizon_of_a_flat_moon_and_a_peak(spark):
    z = np.zeros((9, 9))
    flat = focal.horizon_profile(cells_of(spark, {"z": z}), PIXEL, 4, distances_m=[240.0, 480.0])
    dip = {(r["row"], r["col"], r["azimuth"]): r["horizon"] for r in flat.collect()}
    assert dip[4, 4, 0] == pytest.approx(-math.degrees(math.atan(240 / (2 * 1737400.0))), abs=1e-9) and dip[0, 0, 0] == -90
    z[4, 6] = 200
    peak = {(r["row"], r["col"], r["azimuth"]): r["horizon"] for r in focal.horizon_profile(cells_of(spark, {"z": z}), PIXEL, 4, distances_m=[240.0, 480.0], tile=4).collect()}
    assert peak[4, 4, 1] > 20 and peak[4, 4, 3] < 0


def test_visibility(spark):
    df = spark.createDataFrame([(0, 30.0, 0.0), (1, -10.0, 0.0), (2, 0.0, 0.0), (3, 6.0, 180.0)], "i long, h double, lon double").withColumn("a", F.array_repeat("h", 36))
    v = {r["i"]: r["v"] for r in df.select("i", focal.visibility_fraction(F.col("a"), F.lit(-89.0), F.col("lon"), F.lit(0.0), 36).alias("v")).collect()}
    assert v[0] == 0 and v[1] == 1 and 0.4 <= v[2] <= 0.6 and v[3] == 0


def test_distance_transform_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    m = rng.random((25, 33)) < 0.03
    df = cells_of(spark, {"m": m.astype(float)})
    d = array_of(distance.distance_to_mask(df, F.col("m") == 1, 10.0), "distance_m", 25, 33)
    ys, xs = np.nonzero(m)
    for i in range(25):
        for j in range(33):
            assert d[i, j] == pytest.approx(10 * math.sqrt(((ys - i) ** 2 + (xs - j) ** 2).min()))
    assert distance.distance_to_mask(df, F.lit(False), 10.0).where("distance_m is not null").count() == 0


def test_buffer_counts_unknown_slope_as_steep(spark):
    slope = np.full((9, 9), 2.0).astype(object)
    slope[4][4] = None
    left = distance.clear_of_steep(cells_of(spark, {"slope": slope}), "slope", 8.0, 300.0, PIXEL)
    gone = {(r, c) for r in range(9) for c in range(9)} - {(r["row"], r["col"]) for r in left.collect()}
    assert gone == {(4, 4), (3, 4), (5, 4), (4, 3), (4, 5)}


@pytest.mark.parametrize("radius,strict", [(50.0, False), (50.0, True), (250.0, False), (250.0, True), (251.0, True), (0.0, True)])
def test_near_mask_by_offsets_and_by_tiles(spark, radius, strict):
    rng = np.random.default_rng(8)
    m = rng.random((70, 90)) < 0.002
    df = cells_of(spark, {"m": m.astype(float)}).where("not (row = 30 and col between 20 and 50)")
    df = df.withColumn("m", F.when((F.col("row") != 3) | (F.col("col") != 3), F.col("m")))
    here = {(r["row"], r["col"]): r["m"] for r in df.collect()}
    marks = [k for k, v in here.items() if v == 1]
    r2 = (radius / 10) ** 2
    near = lambda d2: d2 < r2 if strict else d2 <= r2
    want = sorted(k for k in here if any(near((k[0] - a) ** 2 + (k[1] - b) ** 2) for a, b in marks))
    got = sorted((r["row"], r["col"]) for r in distance.near_mask(df, F.col("m") == 1, radius, 10.0, strict).collect())
    assert got == want
    assert distance.near_mask(df.limit(0), F.col("m") == 1, radius, 10.0, strict).count() == 0


def test_densify(spark):
    lines = spark.createDataFrame([(1, [(0.0, -10000.0), (0.0, 10000.0)]), (2, [(5.0, 5.0)]), (3, []), (4, [(0.0, 0.0), (3.0, 0.0), (3.0, 4.0)])], "line_id long, points array<struct<x: double, y: double>>")
    rows = distance.densified(lines).collect()
    assert len([r for r in rows if r["line_id"] == 1]) == 21 and {(r["x"], r["y"]) for r in rows if r["line_id"] == 2} == {(5.0, 5.0)}
    assert not [r for r in rows if r["line_id"] == 3] and [(r["x"], r["y"]) for r in sorted(rows, key=lambda r: r["k"]) if r["line_id"] == 4] == [(0, 0), (3, 4)]


def greedy(cand, n, d2):
    chosen = []
    for s, r, c in sorted(cand, key=lambda x: (-x[0], x[1], x[2])):
        if all((r - a) ** 2 + (c - b) ** 2 >= d2 for _, a, b in chosen):
            chosen.append((s, r, c))
            if len(chosen) == n:
                break
    return chosen


def test_separated_equals_a_greedy_loop_with_ties(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.random((40, 40)), 1)
    df = cells_of(spark, {"score": s})
    got = [(r["score"], r["row"], r["col"]) for r in rank.separated(df, [], 12, 1200.0, PIXEL).orderBy("rank").collect()]
    assert got == greedy([(s[r, c], r, c) for r in range(40) for c in range(40)], 12, 25.0)
    assert rank.top_sites(df.where("score > 5"), 3).count() == 0
    with pytest.raises(ValueError):
        rank.separated(df, [], 0, 1.0, 1.0)
    exact = cells_of(spark, {"score": [[0.9, 0.1, 0.8]]})
    assert rank.separated(exact, [], 5, 480.0, PIXEL).where("score > 0.5").count() == 2  # exactly the distance stays


def test_separated_in_parts_of_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    s = np.round(rng.random((60, 60)), 2)
    df = cells_of(spark, {"score": s})
    monkeypatch.setattr(rank, "MERGED_ROWS", 10)
    got = [(r["score"], r["row"], r["col"]) for r in rank.separated(df, [], 6, 2400.0, PIXEL).orderBy("rank").collect()]
    assert got == greedy([(s[r, c], r, c) for r in range(60) for c in range(60)], 6, 100.0)


def test_scattered_linear_by_hand(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 2.0), (2, 3.0, 0.0, 5.0), (3, 0.0, 4.0, 8.0), (4, 900.0, 0.0, 1.0), (5, 0.0, 0.5, None)], "b_id long, x double, y double, v double")
    target = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 900.0, 1.0), (4, 1e6, 1e6)], "a_id long, x double, y double")
    got = {r["a_id"]: r["v"] for r in resample.scattered_linear(target, points, "v", 10.0).collect()}
    assert got[1] == 2.0 and got[3] is None and got[4] is None
    assert got[2] == pytest.approx((2 / 5 + 5 / 4 + 8 / 3) / (1 / 5 + 1 / 4 + 1 / 3))
    same = points.withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.0))
    assert resample.scattered_linear(target.where("a_id = 1"), same, "v", 10.0).first()["v"] == 2.0


def test_regions_are_independent_and_ids_run_over_regions(spark):
    df = cells_of(spark, {"score": np.full((6, 6), 0.5)}).withColumn("region", F.explode(F.array(F.lit("b"), F.lit("a"))))
    rows = rank.top_sites_per_region(df, "region", 2, 480.0, PIXEL).orderBy("site_id").collect()
    assert [r["region"] for r in rows] == ["a", "a", "b", "b"] and [r["site_id"] for r in rows] == [1, 2, 3, 4] and (rows[0]["row"], rows[0]["col"]) == (0, 0)


def test_topsis_by_hand_and_scale_invariance(spark):
    df = cells_of(spark, {"a": [[1.0, 0.0, 0.5]], "b": [[1.0, 0.0, 0.5]]})
    v = array_of(aggregate.topsis(df, {"a": "a", "b": "b"}, {"a": 1, "b": 1}), "topsis", 1, 3)
    assert v[0].tolist() == pytest.approx([1, 0, 0.5])
    scaled = array_of(aggregate.topsis(df.withColumn("a", F.col("a") * 7), {"a": "a", "b": "b"}, {"a": 1, "b": 1}), "topsis", 1, 3)
    assert scaled[0].tolist() == pytest.approx(v[0].tolist())
    with pytest.raises(ValueError):
        aggregate.topsis(df.withColumn("a", F.lit(0.0)), {"a": "a"}, {"a": 1})
    with pytest.raises(ValueError):
        aggregate.aggregated(df, {"a": "a"}, {"a": 1}, "other")


def test_min_max_edges(spark):
    assert [r["v"] for r in aggregate.min_max(cells_of(spark, {"a": [[3.0, 3.0, None]]}), "a", "v").orderBy("col").collect()] == [0.0, 0.0, None]
    assert aggregate.min_max(cells_of(spark, {"a": [[None]]}), "a", "v").first()["v"] is None


def test_nearest_by_growing_buckets_equals_broadcast(spark):
    rng = np.random.default_rng(4)
    a = spark.createDataFrame([(i, *map(float, rng.uniform(0, 50_000, 2))) for i in range(60)], "a_id long, x double, y double")
    p = spark.createDataFrame([(i, *map(float, rng.uniform(0, 9_000, 2))) for i in range(80)], "b_id long, x double, y double")
    one = sorted(map(tuple, spatial.nearest(a, p).collect()))
    two = sorted(map(tuple, spatial.nearest(a, p, 700.0, broadcast_rows=5).collect()))
    assert one == two
    assert spatial.nearest(a, p.where("b_id < 0")).where("b_id is null").count() == 60


def test_polygon_predicates(spark):
    square = spark.createDataFrame([(0, "s", [(0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0)])], "ordinal long, region string, ring array<struct<x: double, y: double>>")
    pts = spark.createDataFrame([(0, 500.0, 500.0), (1, 1500.0, 500.0), (2, -3.0, -4.0)], "a_id long, x double, y double")
    rows = {r["a_id"]: r for r in validate.polygon_distances(pts, square).collect()}
    assert rows[0]["inside"] and rows[0]["signed_m"] == -500 and rows[1]["signed_m"] == 500 and rows[2]["signed_m"] == 5
    cells = spark.createDataFrame([(-60.0, 500.0), (-200.0, 500.0), (500.0, 500.0)], "x double, y double")
    assert spatial.polygon_cells(cells, square, 240.0).count() == 2 and spatial.polygon_cells(cells, square, 240.0, False).count() == 1


def test_resample_keeps_constants_and_rejects_unknown(spark):
    src, g = cells_of(spark, {"z": np.full((10, 10), 0.5)}), grid.GridSpec(0, 0, 10.0, 10, 10)
    t = grid.GridSpec(20, -20, 7.0, 5, 5)
    target = t.cells(spark).withColumn("x", t.x(F.col("col"))).withColumn("y", t.y(F.col("row")))
    for method in ("nearest", "bilinear", "cubic", "mean", "min", "max", "median"):
        values = [r["z"] for r in resample.resampled(src, g, target, "z", method, t).collect() if r["z"] is not None]
        assert values and values == pytest.approx([0.5] * len(values)), method
    with pytest.raises(ValueError):
        resample.resampled(src, g, target, "z", "lanczos")


def test_hypercube(spark):
    rows = sweep.latin_hypercube(spark, 20, ["a", "b", "c"]).collect()
    assert len(rows) == 20 and all(r["a"] + r["b"] + r["c"] == pytest.approx(1) and min(r[1:]) >= 0 for r in rows)
    assert rows == sweep.latin_hypercube(spark, 20, ["a", "b", "c"]).collect() and sweep.latin_hypercube(spark, 3, ["a"]).first()["a"] == 1


def test_azimuth_chunk():
    assert grid.azimuth_chunk(10, 10, 36) is None and grid.azimuth_chunk(1000, 1000, 36, 8_000_000) == 2 and grid.azimuth_chunk(1000, 1000, 36, 1) == 1


LABEL = """<Product xmlns="http://x"><File_Area><Header><object_length unit="byte">10</object_length></Header><Table_Character><records>3</records><Record_Character><record_length unit="byte">22</record_length>
<Field_Character><name>x</name><field_location unit="byte">1</field_location><field_length unit="byte">8</field_length></Field_Character>
<Field_Character><name>y</name><field_location unit="byte">9</field_location><field_length unit="byte">8</field_length></Field_Character>
<Field_Character><name>z</name><field_location unit="byte">17</field_location><field_length unit="byte">4</field_length><Special_Constants><missing_constant>-999</missing_constant></Special_Constants></Field_Character>
</Record_Character></Table_Character></File_Area></Product>"""


def test_fixed_width_source(spark, tmp_path):
    body = b"# header\r\n" + b"".join(f"{x:>8}{y:>8}{z:>4}\r\n".encode() for x, y, z in (("1", "2", "3"), ("4.5", "-1.5", "-999"), ("0", "", ".5"))) + b"cut"
    (tmp_path / "t.tab").write_bytes(body)
    spec = tables.parse_label(LABEL)
    rows = tables.read_fixed_width(spark, str(tmp_path / "t.tab"), spec, chunk=2).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1.0, 2.0, 3.0), (4.5, -1.5, None), (0.0, None, 0.5)], key=str)
    assert tables.read_fixed_width(spark, str(tmp_path / "t.tab"), spec, ["z"]).columns == ["z"]
    with pytest.raises(ValueError):
        tables.read_fixed_width(spark, "x", spec, ["nope"])
    with pytest.raises(ValueError):
        tables.parse_label("<a/>")
    text = tables.read_fixed_width_text(spark, str(tmp_path / "t.tab"), spec).collect()
    assert sorted(map(tuple, text), key=str) == sorted(map(tuple, rows), key=str)


def test_other_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text("# note\nmy_site_id,region,lat,lon\nsynthetic-placeholder-1,A,-84.5,30.0\n")
    catalog = tables.read_catalog(spark, str(tmp_path / "s.csv"))
    assert catalog.count() == 1 and catalog.agg(tables.is_placeholder("site_id")).first()[0] is True
    assert catalog.where("false").agg(tables.is_placeholder("site_id")).first()[0] is False
    with pytest.raises(ValueError):
        tables.read_catalog(spark, "x.xls")
    (tmp_path / "r.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"Region":"R","RegionCode":"r1","Area_km2":4.0},"geometry":{"type":"Polygon","coordinates":[[[0.0,-89.0],[90.0,-89.0],[180.0,-89.0],[0.0,-89.0]]]}}]}')
    region = tables.read_regions(spark, str(tmp_path / "r.geojson")).first()
    assert region["code"] == "R1" and len(region["ring"]) == 4 and region["ring"][0]["y"] > 30_000
    np.arange(12, dtype="<f4").tofile(tmp_path / "a.raw")
    assert tables.read_raster(spark, str(tmp_path / "a.raw"), 3, 4, scale=0.5, no_data=5).where("z is not null").agg(F.sum("z")).first()[0] == (66 - 5) * 0.5
    made = []
    layer = lambda: made.append(1) or spark.range(3).toDF("row")
    for knob in (1, 1, 2):
        assert tables.cached_layer(layer, spark, "file://" + str(tmp_path), "slope", knob=knob).count() == 3
    assert len(made) == 2
    (tmp_path / "c.csv").write_text("LAT_CIRC_IMG,LON_CIRC_IMG,DIAM_CIRC_IMG\n-80,10,2\n-70,10,2\n-80,10,0.5\n")
    assert tables.read_craters(spark, str(tmp_path / "c.csv"), min_diameter_km=1.0).count() == 1


def test_comparison_by_a_known_offset(spark):
    at = lambda i, lat: (i, "r", 0.0, 2 * crs.RADIUS_M * math.tan(math.pi / 4 + math.radians(lat) / 2))
    a = spark.createDataFrame([at(1, -89.0)], "a_id long, region string, x double, y double")
    c = spark.createDataFrame([at(1, -89.099), at(2, -89.27)], "b_id long, region string, x double, y double")
    assert validate.compare(a.drop("region"), c.drop("region"), 5.0).select("matched_a", "matched_b").first() == (1, 1)
    assert validate.compare(a.drop("region"), c.drop("region"), 10.0).select("matched_a", "matched_b").first() == (1, 2)
    assert validate.compare_by_region(a, c, 5.0).first()["matched"] == 1


# --- features, catalogs and launch years


def test_no_feature_is_infinitely_far(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 3000.0, 4000.0)], "a_id long, x double, y double")
    none = spark.createDataFrame([], "b_id long, x double, y double")
    far = distance.feature_distance(a, none)
    assert {r["km"] for r in far.collect()} == {float("inf")}
    assert {r[0] for r in far.select(local.seismic_score(F.col("km"))).collect()} == {1.0}
    near = distance.feature_distance(a, spark.createDataFrame([(1, 0.0, 0.0)], "b_id long, x double, y double"))
    assert {r["a_id"]: r["km"] for r in near.collect()} == {1: 0.0, 2: 5.0}


def test_features_of_a_geojson_and_a_csv(spark, tmp_path):
    shapes = [("Point", [0, -89]), ("LineString", [[0, -90], [0, -89]]), ("MultiLineString", [[[0, -90], [90, -89]], [[180, -89], [180, -88]]]), ("Polygon", [[[0, -90], [0, -89], [90, -89], [0, -90]]])]
    features = [{"type": "Feature", "geometry": {"type": t, "coordinates": c}} for t, c in shapes]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = tables.read_features(spark, str(tmp_path / "a.geojson")).collect()
    assert sorted(len(r["points"]) for r in rows) == [1, 2, 2, 2] and len({r["line_id"] for r in rows}) == 4
    (tmp_path / "a.csv").write_text("# points\nlat,lon\n-89,0\n-88,90\n")
    assert [len(r["points"]) for r in tables.read_features(spark, str(tmp_path / "a.csv")).collect()] == [1, 1]


def test_region_codes_have_names_and_unknown_ones_fail(spark):
    codes = spark.createDataFrame([("HW",), ("dGR1",)], "region string")
    assert {tuple(r) for r in tables.named_regions(codes).collect()} == {("HW", "Haworth", True), ("dGR1", "de Gerlache Rim 1", False)}
    for wrong in ("XX", None):
        with pytest.raises(Exception, match="unknown region code"):
            tables.named_regions(spark.createDataFrame([(wrong,)], "region string")).collect()


def test_launch_years_of_sites_and_wrong_years(spark):
    found = spark.createDataFrame([(1, 7, 2.0, True), (2, 7, 9.0, False), (3, 8, 1.0, True), (4, None, None, False)], "a_id long, b_id long, distance_km double, matched boolean")
    catalog = spark.createDataFrame([(7, 10, 9), (8, None, 3)], "b_id long, d27 long, d28 long")
    rows = validate.launch_year_sites(found, catalog, {2027: "d27", 2028: "d28"})
    got = {r["a_id"]: (r["b_id"], r["days"], r["passes_headline"], r["passes_any"]) for r in rows.collect()}
    assert got == {1: (7, {2027: 10, 2028: 9}, False, True), 2: (None, None, False, False), 3: (8, {2027: 0, 2028: 3}, False, False), 4: (None, None, False, False)}
    assert tuple(validate.launch_year_totals(rows).first()) == (4, 2, 0, 1)
    for columns, options in (({2024: "d27", 2028: "d28"}, {}), ({2027: "d27"}, {}), ({2028: "d28"}, {"threshold": 0})):
        with pytest.raises(ValueError):
            validate.launch_year_sites(found, catalog, columns, **options)


def test_published_areas_stand_in_for_counted_ones(spark):
    regions = spark.createDataFrame([("a", 10.0), ("b", 0.0), ("c", 4.0)], "region string, area_km2 double")
    sites = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5)], "region string, site_id long, score double")
    areas = spark.createDataFrame([("a", 5.0), ("b", 1.0)], "region string, eligible_km2 double")
    rows = validate.compliance(regions, sites, areas)
    assert {r["region"]: (r["n_sites"], r["best_site"], r["fraction"]) for r in rows.collect()} == {"a": (2, 1, 0.5), "b": (0, 0, 0.0), "c": (0, 0, 0.0)}
    assert tuple(validate.compliance_totals(rows).first()) == (2, 3, 1, 2, "b,c")


def test_a_partner_in_another_region_is_no_match(spark):
    a = spark.createDataFrame([(1, "r", 0.0, 0.0)], "a_id long, region string, x double, y double")
    b = spark.createDataFrame([(1, "s", 100.0, 0.0), (2, "r", 900.0, 0.0)], "b_id long, region string, x double, y double")
    got = {r["region"]: (r["n_a"], r["n_b"], r["matched"], r["unmatched_a"], r["unmatched_b"]) for r in validate.compare_by_region(a, b, 5.0).collect()}
    assert got == {"r": (1, 1, 0, "1", ""), "s": (0, 1, 0, "", "1")}


# --- stores, sinks, totals


def test_craters_of_a_zip_and_site_sinks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("a.csv", "lat,lon,diam_km\n-80,1,9\n")
        z.writestr("b.csv", "x,LAT_CIRC_IMG,LON_CIRC_IMG,DIAM_CIRC_IMG\nq,-80,10,2\nq,-70,10,2\nq,-80.5,10,0.5\n")
    rows = tables.read_craters(spark, str(tmp_path / "c.zip"), min_diameter_km=1.0).collect()
    assert [(r["lat"], r["lon"], r["diam_km"]) for r in rows] == [(-80.0, 10.0, 2.0)]
    sites = spark.createDataFrame([(2, 5.0, -80.0, [1]), (1, None, -81.0, [2])], "rank long, lon double, lat double, extra array<long>")
    for some, n in ((sites, 2), (sites.where("false"), 0)):
        tables.write_sites(some, str(tmp_path / f"s{n}"))
        assert spark.read.text(str(tmp_path / f"s{n}/geojson")).count() == n
        back = spark.read.option("header", True).csv(str(tmp_path / f"s{n}/csv"))
        assert back.columns == ["rank", "lon", "lat"] and back.count() == n
    doc = json.loads(tables.geojson_document(sites, "rank").first()["value"])
    assert [f["properties"]["rank"] for f in doc["features"]] == [1, 2] and doc["features"][1]["geometry"]["coordinates"] == [5.0, -80.0]
    assert json.loads(tables.geojson_document(sites.where("false"), "rank").first()["value"])["features"] == []


def test_horizon_store_keeps_profiles_by_bands(spark, tmp_path):
    profile = spark.range(600).selectExpr("id AS row", "id % 3 AS col", "explode(sequence(0, 3)) AS azimuth").withColumn("horizon", F.col("azimuth") * 10.0 + F.col("col"))
    for _ in range(2):  # an older store goes
        tables.write_horizon(profile, str(tmp_path / "h"))
    rows = tables.read_horizon(spark, str(tmp_path / "h"), 4).collect()
    assert len(rows) == 600 and all(r["horizon"] == [r["col"] + 10.0 * i for i in range(4)] for r in rows)
    assert sorted(r["row"] for r in tables.read_horizon(spark, str(tmp_path / "h"), 4, (250, 260)).collect()) == list(range(250, 261))
    with pytest.raises(Exception, match="azimuths"):
        tables.read_horizon(spark, str(tmp_path / "h"), 36).collect()


def test_elevation_source(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.elevation_source(spark, str(tmp_path))
    for name in ("sample_lola.tif", "ldem_80s_80m.lbl", "other.img", "other.txt"):
        (tmp_path / name).write_text("")
    assert tables.elevation_source(spark, str(tmp_path)).endswith("/ldem_80s_80m.lbl")
    assert tables.elevation_source(spark, str(tmp_path), override=str(tmp_path / "other.img")).endswith("other.img")
    with pytest.raises(FileNotFoundError):
        tables.elevation_source(spark, str(tmp_path), 20)
    with pytest.raises(FileNotFoundError):
        tables.elevation_source(spark, str(tmp_path), override=str(tmp_path / "none.img"))
    with pytest.raises(ValueError):
        tables.elevation_source(spark, str(tmp_path), override=str(tmp_path / "other.txt"))


def test_totals_without_sites_or_regions(spark):
    ring = [(0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0)]
    disks = spark.createDataFrame([(1, 500.0, 500.0, 0.7, ring)], "b_id long, x double, y double, radius_km double, ring array<struct<x: double, y: double>>")
    polygons = spark.createDataFrame([(0, "R", ring)], "ordinal long, region string, ring array<struct<x: double, y: double>>")
    sites = spark.createDataFrame([(1, 400.0, 500.0), (2, 500.0, 1600.0), (3, 9000.0, 0.0)], "a_id long, x double, y double")
    row = validate.proximity_totals(sites, disks, 1.1, polygons).first().asDict()
    assert row == dict(n_sites=3, n_regions=1, sites_near=2, sites_inside=1, regions_near=1, regions_with_site=1, regions_within_radius=1, n_polygons=1, sites_in_polygons=1, median_polygon_km=0.6, polygons_with_site=1)
    none = validate.proximity_totals(sites.where("false"), disks, 1.1, polygons).first().asDict()
    assert none.pop("median_polygon_km") is None and none.pop("n_regions") == none.pop("n_polygons") == 1 and set(none.values()) == {0}
    assert validate.nearest_names(sites, disks.where("false").withColumn("region", F.lit("x"))).where("region IS NULL").count() == 3
    found = sweep.sweep_containment(spark.createDataFrame([(7, 0, 0), (7, 9, 9), (8, 9, 9)], "sample_id long, row long, col long"), disks, F.col("col") * 100.0 + 50, F.col("row") * 300.0 + 50)
    assert [tuple(r) for r in found.collect()] == [(7, 1, 1)]
