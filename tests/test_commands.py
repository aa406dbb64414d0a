"""The commands end to end on a small tilted plane."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill import __main__ as cli
from rastermill.functions import crs, local
from rastermill.operators import aggregate
from rastermill.operators.grid import GridSpec
from rastermill.plans import commands, registry
from rastermill.sources import tables


@pytest.fixture(scope="module")
def grid():
    return GridSpec(-3600.0, 20_000.0, 240.0, 30, 30)


@pytest.fixture(scope="module")
def processed(spark, grid):
    rng = np.random.default_rng(1)
    rows = [(r, c, c * 240 * math.tan(math.radians(3)), float(rng.uniform(0.3, 1)), float(rng.uniform(50, 200)), float(rng.uniform(50, 200))) for r in range(30) for c in range(30)]
    df = spark.createDataFrame(rows, "row long, col long, z double, illumination double, temp_avg double, temp_max double")
    craters = spark.createDataFrame([(0.0, 18_000.0)], "x double, y double")
    out = commands.preprocess(spark, df.select("row", "col", "z"), grid, [df.drop("z")], craters, azimuths=4, max_km=2.0, distances=4)
    return out.withColumn("visibility", F.lit(0.9)).cache()


def test_score_and_rank(spark, processed, grid):
    weights = {"slope": 0.2, "illumination": 0.3, "thermal": 0.1, "hazard": 0.1, "los_to_earth": 0.1, "eva_psr_access": 0.1, "multi_volatile": 0.1, "seismic": 0.0}
    scored = commands.score(processed, weights)
    assert "score_seismic" not in scored.columns and {"score_slope", "score_eva_psr_access", "score_hazard"} <= set(scored.columns)
    assert processed.where("crater_density > 0").count() > 0
    sites = commands.rank_sites(scored, grid, 3, 1000.0, 0.1).orderBy("rank").collect()
    assert [s["rank"] for s in sites] == [1, 2, 3] and sites[0]["score"] >= sites[1]["score"] and sites[0]["lat"] < -80
    ring = [(-3600.0, 20_000.0), (3600.0, 20_000.0), (3600.0, 12_800.0), (-3600.0, 12_800.0)]
    regions = spark.createDataFrame([(0, "Whole", "w", ring)], "ordinal long, region string, code string, ring array<struct<x: double, y: double>>")
    found = commands.rank_per_region(scored, regions, grid, 4, 1000.0).collect()
    assert len(found) == 4 and {f["region_name"] for f in found} == {"Whole"}
    assert commands.rank_per_region(scored, regions, grid, codes=["X"]).count() == 0
    topsis = commands.score(processed, weights, "topsis")
    assert topsis.where("score between 0 and 1").count() == topsis.where("score is not null").count() > 0
    centroids = spark.createDataFrame([(1, 0.0, 16_000.0)], "b_id long, x double, y double")
    swept = commands.sensitivity(spark, scored, ["slope", "illumination"], centroids, grid, samples=5, n=2, min_distance_m=1000.0)
    assert swept.count() == 5 and swept.where("n_sites = 2").count() == 5
    assert commands.coupling_sweep(scored.withColumn("psr_km", F.lit(1.0)).withColumn("ridge_km", F.lit(2.0)), (1, 3)).count() == 2
    with pytest.raises(ValueError):
        commands.score(processed.select("row", "col"), weights)


def test_tiles_are_ranked_at_their_own_resolution(spark, processed, grid):
    scored = commands.score(processed.withColumn("illumination", F.lit(0.9)), {"slope": 0.5, "illumination": 0.5, **dict.fromkeys(("thermal", "hazard", "los_to_earth", "eva_psr_access", "multi_volatile", "seismic"), 0.0)})
    box = lambda x, y: [(x, y), (x + 1200.0, y), (x + 1200.0, y - 1200.0), (x, y - 1200.0)]
    regions = spark.createDataFrame([(0, "West", "w", box(-2400.0, 18_800.0)), (1, "East", "e", box(600.0, 16_400.0))], "ordinal long, region string, code string, ring array<struct<x: double, y: double>>")
    found = commands.rank_tiled(scored, regions, grid, 60.0, 300.0, n=3, min_distance_m=400.0).orderBy("site_id").collect()
    assert [(f["region_code"], f["rank_in_region"], f["site_id"]) for f in found] == [("w", 1, 1), ("w", 2, 2), ("w", 3, 3), ("e", 1, 4), ("e", 2, 5), ("e", 3, 6)]
    assert all(f["resolution_m"] == 60.0 and -2400 - 60 <= f["x_m"] <= -1200 + 60 and f["score_slope"] == pytest.approx(0.8, abs=1e-6) for f in found[:3])
    assert {f["region_code"] for f in commands.rank_tiled(scored, regions, grid, 120.0, 300.0, codes=["E"]).collect()} == {"e"}
    with pytest.raises(ValueError, match="no region"):
        commands.rank_tiled(scored, regions, grid, 120.0, codes=["X"])
    catalog = spark.createDataFrame([("a", "West", True, 0.0, 18_000.0), ("b", "Far", False, 0.0, 18_000.0)], "site_id string, region string, in_scope boolean, x double, y double")
    rows = commands.score_catalog(scored, catalog, grid).collect()
    assert [r["site_id"] for r in rows] == ["a"] and rows[0]["hls_compliant"] and rows[0]["score_seismic"] is None and rows[0]["slope_deg"] == pytest.approx(3, abs=1e-6)
    assert commands.score_catalog(scored, catalog, grid, in_scope_only=False).count() == 2


def test_the_coupling_sweep_ranks_for_each_distance(spark, processed, grid):
    scored = processed.select("row", "col", F.lit(0.4).alias("score_slope"), F.lit(0.9).alias("score_eva_psr_access"), (F.col("col") * 0.5).alias("psr_km"), F.lit(0.0).alias("ridge_km"))
    ring = [(-3600.0, 20_000.0), (-3000.0, 20_000.0), (-3000.0, 12_800.0), (-3600.0, 12_800.0)]
    disks = spark.createDataFrame([(1, -3300.0, 19_000.0, 7.3, ring)], "b_id long, x double, y double, radius_km double, ring array<struct<x: double, y: double>>")
    rows = {r["distance_km"]: r for r in commands.coupling_sweep(scored, (1, 4), grid=grid, disks=disks, n=3, min_distance_m=1000.0, near_km=2.0, far_km=9.0).collect()}
    slope, coupling = 0.12 / 0.32, 0.2 / 0.32
    assert [rows[d]["n_coupled"] for d in (1.0, 4.0)] == [60, 240] and rows[1.0]["best_score"] == pytest.approx(slope * 0.4 + coupling)
    assert all(rows[d]["n_sites"] == 3 and rows[d]["sites_inside"] == 3 and rows[d]["regions_with_site"] == 1 and rows[d]["mean_top"] == pytest.approx(slope * 0.4 + coupling) for d in rows)
    assert rows[4.0]["mean_at"] == pytest.approx(slope * 0.4 + coupling * 0.875)


def test_the_default_weights_are_a_sample_of_their_own(spark, processed, grid):
    scored = processed.select("row", "col", F.lit(0.4).alias("score_slope"), F.lit(0.9).alias("score_illumination"))
    centroids = spark.createDataFrame([(1, 0.0, 16_000.0)], "b_id long, x double, y double")
    rows = commands.sensitivity(spark, scored, ["slope", "illumination"], centroids, grid, samples=2, n=1, min_distance_m=1000.0, baseline=True)
    assert rows.where("sample_id = -1").first()["slope"] == pytest.approx(0.12 / 0.29) and rows.count() == 3


def test_thermal_layers_are_read_once(spark, tmp_path):
    small = GridSpec(-480.0, 480.0, 240.0, 4, 4)
    names = ("tri_clat", "tri_clon", "temp_avg", "temp_max", "ice_depth")
    spec = tables.TableSpec(0, 6, 52, tuple(tables.FieldSpec(n, 10 * i, 10, "", ("-999",)) for i, n in enumerate(names)))
    lat = [-89.999, -89.99, -89.985, -89.98, -89.995, -89.99]
    body = "".join(f"{a:>10}{60 * i:>10}{100 + i:>10}{150:>10}{-999 if i == 0 else i:>10}\r\n" for i, a in enumerate(lat))
    (tmp_path / "t.tab").write_bytes(body.encode())
    root = "file://" + str(tmp_path / "layers")
    rows = commands.thermal_layers(spark, "file://" + str(tmp_path / "t.tab"), spec, small, root).collect()
    assert len(rows) == 16 and all(r["temp_max"] == pytest.approx(150.0) and 100 <= r["temp_avg"] <= 105 and r["ice_depth"] in range(1, 6) for r in rows)
    (tmp_path / "t.tab").unlink()
    again = commands.thermal_layers(spark, "file://" + str(tmp_path / "t.tab"), spec, small, root).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_stored_horizons_give_the_same_visibility(spark, grid, tmp_path):
    plane = spark.range(900).selectExpr("id div 30 AS row", "id % 30 AS col", "double(id % 7) AS z")
    a = commands.preprocess(spark, plane, grid, azimuths=4, max_km=2.0, distances=4).select("row", "col", "visibility")
    b = commands.preprocess(spark, plane, grid, azimuths=4, max_km=2.0, distances=4, horizons=str(tmp_path / "h")).select("row", "col", "visibility")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_registry_takes_new_criteria():
    before = dict(registry.CRITERIA)
    registry.register("dust", ("dust",), lambda x: 1 - x)
    assert set(registry.scores_for(["dust"])) == {"dust"}
    registry.CRITERIA.clear()
    registry.CRITERIA.update(before)


def test_guards(tmp_path):
    assert commands.parse_resolution("20 m") == commands.parse_resolution("20m") == 20
    with pytest.raises(ValueError):
        commands.parse_resolution("fine")
    (tmp_path / "w.yaml").write_text("slope: 1\n")
    assert commands.load_weights(str(tmp_path / "w.yaml")) == {"slope": 1.0}
    (tmp_path / "w.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        commands.load_weights(str(tmp_path / "w.yaml"))
    with pytest.raises(SystemExit):
        cli.main(["rank-per-region", "--scored", "x", "--grid", "{}", "--regions", "r", "--resolution", "20m"])


def test_cli_writes_what_it_ranks(spark, tmp_path, grid, capsys):
    rows = [(r, c, ((r * 7 + c * 3) % 10) / 10) for r in range(30) for c in range(30)]
    spark.createDataFrame(rows, "row long, col long, score double").write.parquet(str(tmp_path / "s"))
    shape = json.dumps({"left": grid.left, "top": grid.top, "pixel": 240.0, "height": 30, "width": 30})
    cli.main(["rank", "--scored", str(tmp_path / "s"), "--grid", shape, "--n", "4", "--min-distance-km", "1", "--out", str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4 and "site_01" in capsys.readouterr().out


#: Rows of a published evaluation (fixed values): coordinates, scores and the weighted aggregate.
PUBLISHED = [
    # lon, lat, x_m, y_m, slope_deg, score_slope, illumination, score_illumination, thermal, aggregate
    (31.8506, -85.416, 73391.4896733203, 118135.27408156087, 3.5331497903285687, 0.7644566806447621, 0.19957776367664337, 0.2851110909666334, 0.5043068069981684, 0.5789376771307406),
    (29.5494, -85.481, 67615.26140440385, 119269.51525655211, 2.138585409520835, 0.8574276393672777, 0.0, 0.0, 0.2631963840900981, 0.5139125598274377),
]


def test_closed_forms_give_the_published_values(spark):
    names = "lon lat x_m y_m slope_deg score_slope illumination score_illumination thermal aggregate".split()
    df = spark.createDataFrame(PUBLISHED, ", ".join(f"{n} double" for n in names))
    scores = {"slope": local.slope_score(F.col("slope_deg")), "illumination": local.illumination_score(F.col("illumination")), "coupling": F.lit(0.0), "thermal": F.col("thermal"), "ice": F.lit(1.0), "los_to_earth": F.lit(1.0)}
    weights = {"slope": 0.13, "illumination": 0.18, "coupling": 0.18, "thermal": 0.08, "ice": 0.18, "los_to_earth": 0.15}
    pairs = [(crs.stereo_x(F.col("lon"), F.col("lat")), "x_m"), (crs.stereo_y(F.col("lon"), F.col("lat")), "y_m"), (scores["slope"], "score_slope"), (scores["illumination"], "score_illumination"), (aggregate.weighted_sum(scores, weights), "aggregate")]
    assert max(df.agg(*(F.max(F.abs(a - F.col(b))) for a, b in pairs)).first()) < 1e-7
