"""The commands of the engine as functions over Parquet cell tables; each returns the DataFrame that it wrote."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import crs, local
from ..operators import aggregate, focal, rank, sweep, validate
from ..operators.grid import GridSpec, sample_nearest, tile_specs
from ..operators.resample import resampled, scattered_linear, scattered_nearest
from ..operators.spatial import point_density, polygon_cells
from ..sources import tables
from .registry import scores_for


def load_weights(path: str) -> dict[str, float]:
    """A YAML or JSON mapping of criteria to weights."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} is no mapping of weights")
    return {str(k): float(v) for k, v in found.items()}


def parse_resolution(value: str) -> int:
    """'20m', '20' or '20 m' in whole metres."""
    text = str(value).strip().lower().rstrip("m").strip()
    if not text.isdigit():
        raise ValueError(f"not a resolution in whole metres: {value!r}")
    return int(text)


def saved(df: DataFrame, path: str | None) -> DataFrame:
    if path is None:
        return df
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def preprocess(spark: SparkSession, elevation: DataFrame, grid: GridSpec, layers: Sequence[DataFrame] = (), craters: DataFrame | None = None, crater_radius_m: float = 3000.0, azimuths: int = 36, max_km: float = 100.0, distances: int = 50, out: str | None = None, horizons: str | None = None) -> DataFrame:
    """(row, col, z) and other layers -> slope, visibility from the horizon, crater density, all on one grid.

    With a path for horizons their profiles are stored there, as floats, and read back.
    """
    cells = focal.slope_degrees(elevation.select("row", "col", "z"), grid.pixel)
    profile = focal.horizon_profile(elevation, grid.pixel, azimuths, max_km, distances)
    if horizons is None:
        arrays = profile.groupBy("row", "col").agg(F.transform(F.sort_array(F.collect_list(F.struct("azimuth", "horizon"))), lambda a: a["horizon"]).alias("horizon"))
    else:
        tables.write_horizon(profile, horizons)
        arrays = tables.read_horizon(spark, horizons, azimuths)
    x, y = grid.x(F.col("col")), grid.y(F.col("row"))
    seen = focal.visibility_fraction(F.col("horizon"), crs.lat_of(x, y), crs.lon_of(x, y), crs.convergence(x, y), azimuths)
    cells = cells.join(arrays.select("row", "col", seen.alias("visibility")), ["row", "col"], "left")
    for layer in layers:
        cells = cells.join(layer, ["row", "col"], "left")
    if craters is not None:
        a = cells.select((F.col("row") * grid.width + F.col("col")).alias("a_id"), "row", "col", x.alias("x"), y.alias("y"))
        counts = point_density(a, craters.select(F.monotonically_increasing_id().alias("b_id"), "x", "y"), crater_radius_m)
        cells = cells.join(counts.select("row", "col", F.col("n_points").cast("double").alias("crater_density")), ["row", "col"], "left")
    if "temp_max" in cells.columns:
        found = focal.volatile_access(cells, grid.pixel, "temp_max")
        cells = cells.join(found.select("row", "col", F.col("h2o").alias("cold_access"), F.col("combined").alias("volatiles")), ["row", "col"], "left")
    return saved(cells, out)


def score(cells: DataFrame, weights: dict[str, float], method: str = "weighted_sum", out: str | None = None) -> DataFrame:
    """cells with score_<criterion> for each criterion whose layers are there, and their aggregate `score`."""
    found = scores_for(cells.columns)
    if not found:
        raise ValueError("no criterion has its layers")
    scored = cells.select("*", *(c.alias(f"score_{n}") for n, c in found.items()))
    return saved(aggregate.aggregated(scored, {n: f"score_{n}" for n in found}, {n: weights[n] for n in found}, method), out)


def _located(sites: DataFrame, grid: GridSpec) -> DataFrame:
    x, y = grid.x(F.col("col")), grid.y(F.col("row"))
    return sites.withColumn("x_m", x).withColumn("y_m", y).withColumn("lon", crs.lon_of(x, y)).withColumn("lat", crs.lat_of(x, y))


def _with_scores(sites: DataFrame, scored: DataFrame) -> DataFrame:
    names = [c for c in scored.columns if c.startswith("score_")]
    return sites.join(scored.select("row", "col", *names), ["row", "col"], "left")


def rank_sites(scored: DataFrame, grid: GridSpec, n: int = 20, min_distance_m: float = 5000.0, min_score: float = 0.5, out: str | None = None) -> DataFrame:
    return saved(_with_scores(_located(rank.top_sites(scored, n, min_distance_m, min_score, grid.pixel), grid), scored), out)


def _ranked(cells: DataFrame, regions: DataFrame, grid: GridSpec, n: int, min_distance_m: float, buffer_m: float) -> DataFrame:
    fit = rank.compliant_cells(cells, grid.pixel, buffer_m=buffer_m, illumination="illumination", visibility="visibility")
    placed = fit.select("row", "col", "score", grid.x(F.col("col")).alias("x"), grid.y(F.col("row")).alias("y"))
    inside = polygon_cells(placed, regions.select("ordinal", "region", "code", "ring"), grid.pixel)
    found = rank.top_sites_per_region(inside.withColumn("zone", F.struct("ordinal", "region", "code")).select("row", "col", "score", F.to_json("zone").alias("zone")), "zone", n, min_distance_m, grid.pixel)
    zone = F.from_json("zone", "ordinal long, region string, code string")
    found = found.select("site_id", zone["region"].alias("region_name"), zone["code"].alias("region_code"), "rank_in_region", "row", "col", "score")
    return _with_scores(_located(found, grid), cells).withColumn("hls_compliant", F.lit(True))


def _with_codes(regions: DataFrame, codes: Sequence[str] | None) -> DataFrame:
    return regions.where(F.upper("code").isin([c.upper() for c in codes])) if codes else regions


def rank_per_region(scored: DataFrame, regions: DataFrame, grid: GridSpec, n: int = 10, min_distance_m: float = 2000.0, buffer_m: float = 100.0, codes: Sequence[str] | None = None, out: str | None = None) -> DataFrame:
    """The best compliant sites of each region (ordinal, region, code, ring) on the scores' own grid."""
    return saved(_ranked(scored, _with_codes(regions, codes), grid, n, min_distance_m, buffer_m), out)


def rank_tiled(scored: DataFrame, regions: DataFrame, grid: GridSpec, resolution_m: float = 20.0, around_m: float = 1000.0, n: int = 10, min_distance_m: float = 2000.0, buffer_m: float = 100.0, codes: Sequence[str] | None = None, elevation: DataFrame | None = None, elevation_grid: GridSpec | None = None, out: str | None = None) -> DataFrame:
    """The best compliant sites of each region on a finer tile of its own: elevation, score, illumination and visibility are
    interpolated to the tile (bilinear), the slope is derived there, and the filters hold at that resolution.

    elevation (row, col, z) may have a grid of its own; otherwise z of the scored cells is taken. One plan a region, of which
    there are few; only the cells around a region take part in it.
    """
    layers = ["score", "illumination", "visibility", *(c for c in scored.columns if c.startswith("score_"))]
    heights, heights_grid = (scored, grid) if elevation is None else (elevation, elevation_grid or grid)
    chosen = _with_codes(regions, codes)
    specs = tile_specs(chosen.select("ordinal", F.inline("ring")), around_m, resolution_m, "ordinal").orderBy("ordinal").collect()
    found = None
    for s in specs:
        tile = GridSpec(s["xmin"], s["ymax"], resolution_m, s["height"], s["width"])
        target = tile.cells(scored.sparkSession).withColumn("x", tile.x(F.col("col"))).withColumn("y", tile.y(F.col("row")))

        def around(cells: DataFrame, g: GridSpec, s=s) -> DataFrame:
            x, y = g.x(F.col("col")), g.y(F.col("row"))
            return cells.where(x.between(s["xmin"] - 2 * g.pixel, s["xmax"] + 2 * g.pixel) & y.between(s["ymin"] - 2 * g.pixel, s["ymax"] + 2 * g.pixel))

        z = focal.slope_degrees(resampled(around(heights, heights_grid), heights_grid, target, "z"), resolution_m)
        cells = z.join(resampled(around(scored, grid), grid, target, layers), ["row", "col"])
        sites = _ranked(cells, chosen.where(F.col("ordinal") == s["ordinal"]), tile, n, min_distance_m, buffer_m).withColumn("__ordinal", F.lit(s["ordinal"]))
        found = sites if found is None else found.unionByName(sites)
    if found is None:
        raise ValueError("no region to rank")
    ids = F.row_number().over(Window.orderBy("__ordinal", "rank_in_region")).cast("long")  # n sites a region
    return saved(found.withColumn("site_id", ids).drop("__ordinal").withColumn("resolution_m", F.lit(float(resolution_m))), out)


def score_catalog(scored: DataFrame, catalog: DataFrame, grid: GridSpec, in_scope_only: bool = True, out: str | None = None) -> DataFrame:
    """Each catalog site with the layers and scores of its nearest cell, in fixed columns; layers that scored lacks are NULL.

    A catalog with in_scope is cut to the sites in scope unless in_scope_only is off. The buffer around steep cells is no
    part of hls_compliant here.
    """
    if in_scope_only and "in_scope" in catalog.columns:
        catalog = catalog.where("in_scope")
    names = {"score": "aggregate_score", **{f"score_{c}": f"score_{c}" for c in aggregate.CRITERIA}, "slope": "slope_deg", "illumination": "illumination", "visibility": "los_visibility"}
    layer = lambda c: (F.col(c) if c in scored.columns else F.lit(None)).cast("double")
    cells = scored.select("row", "col", *(layer(c).alias(f"__{new}") for c, new in names.items()))
    own = [c for c in ("site_id", "region", "in_scope", "lat", "lon") if c in catalog.columns]
    rows = sample_nearest(catalog.select(*own, "x", "y"), cells, grid, clamp=True)
    compliant = local.hls_compliant(F.col("__slope_deg"), F.col("__illumination"), F.col("__los_visibility"))
    return saved(rows.select(*own, F.col("x").alias("x_m"), F.col("y").alias("y_m"), *(F.col(f"__{new}").alias(new) for new in names.values()), compliant.alias("hls_compliant")), out)


def compare_catalogs(a: DataFrame, b: DataFrame, km: float = 5.0, out: str | None = None) -> DataFrame:
    return saved(validate.compare(a, b, km), out)


def validate_sites(sites: DataFrame, centroids: DataFrame, near_km: float = 25.0, out: str | None = None, polygons: DataFrame | None = None) -> DataFrame:
    """Totals of the sites and centroids; where the centroids have a radius_km (and so a disk each), those of disks and polygons."""
    if "radius_km" not in centroids.columns:
        return saved(validate.proximity(sites, centroids, near_km), out)
    disks = centroids if "ring" in centroids.columns else tables.disk_rings(centroids)
    return saved(validate.proximity_totals(sites, disks, near_km, polygons), out)


def validate_per_region(regions: DataFrame, sites: DataFrame, areas: DataFrame, out: str | None = None) -> DataFrame:
    return saved(validate.compliance(regions, sites, areas), out)


def sensitivity(spark: SparkSession, scored: DataFrame, criteria: Sequence[str], centroids: DataFrame, grid: GridSpec, samples: int = 100, n: int = 20, min_distance_m: float = 25_000.0, near_km: float = 25.0, far_km: float = 100.0, seed: int = 42, out: str | None = None, baseline: bool = False) -> DataFrame:
    """Metrics of the top sites for each Latin hypercube sample of the criteria's weights; with baseline also for the default weights, as sample -1."""
    weights = sweep.latin_hypercube(spark, samples, list(criteria), seed)
    if baseline:
        default = aggregate.normalised_weights(list(criteria), {c: aggregate.DEFAULT_WEIGHTS[c] for c in criteria})
        weights = weights.unionByName(spark.createDataFrame([(-1, *(default[c] for c in criteria))], weights.schema))
    every = sweep.sweep_scores(scored, weights, {c: f"score_{c}" for c in criteria})
    sites = sweep.sweep_sites(every, n, min_distance_m, grid.pixel).withColumn("a_id", F.col("sample_id") * 100_000 + F.col("rank"))
    found = sweep.sweep_metrics(sites, centroids, grid.x(F.col("col")), grid.y(F.col("row")), near_km, far_km)
    at = centroids.select(grid.row(F.col("y")).alias("row"), grid.col(F.col("x")).alias("col")).distinct()
    known = sweep.scores_at(scored.join(at, ["row", "col"], "left_semi"), weights, {c: f"score_{c}" for c in criteria})
    return saved(weights.join(found, "sample_id", "left").join(known, "sample_id", "left"), out)


#: Weight of the coupling where the weights have none (fixed value), and criteria that its sweep leaves out.
COUPLING_WEIGHT = 0.20
SWEPT_APART = ("coupling", "eva_psr_access")


def coupling_sweep(
    scored: DataFrame,
    distances_km: Sequence[float] = (1, 2, 3, 5, 7, 10, 15, 20),
    weights: Mapping[str, float] = aggregate.DEFAULT_WEIGHTS,
    psr: str = "psr_km",
    ridge: str = "ridge_km",
    out: str | None = None,
    *,
    grid: GridSpec | None = None,
    disks: DataFrame | None = None,
    n: int = 20,
    min_distance_m: float = 25_000.0,
    near_km: float = 25.0,
    far_km: float = 100.0,
) -> DataFrame:
    """For each coupling distance: cells with a positive coupling, and mean and best score of coupling and the other criteria.

    The scores are weighted anew without the coupling's rivals. With disks (b_id, x, y, radius_km, ring) and the grid, the cells are ranked
    for each distance and the sites held against the disks as in a sweep of weights.
    """
    present = [c.removeprefix("score_") for c in scored.columns if c.startswith("score_") and c.removeprefix("score_") not in SWEPT_APART]
    if not present:
        raise ValueError("no criterion beside the coupling")
    used = {**{c: weights[c] for c in present}, "coupling": weights.get("coupling") or COUPLING_WEIGHT}
    near = lambda c: F.least(F.greatest(1 - F.col(c) / F.col("distance_km"), F.lit(0.0)), F.lit(1.0))
    coupling = F.when(F.col(psr).isNotNull() & F.col(ridge).isNotNull(), near(psr) * near(ridge))
    rows = sweep.sweep_distance(scored, list(distances_km), coupling).withColumnRenamed("score", "coupling")
    rows = rows.withColumn("score", aggregate.weighted_sum({**{c: F.col(f"score_{c}") for c in present}, "coupling": F.col("coupling")}, used))
    found = rows.groupBy("distance_km").agg(F.count_if(F.col("coupling") > 0).alias("n_coupled"), F.avg("score").alias("mean_score"), F.max("score").alias("best_score"))
    if disks is None or grid is None:
        return saved(found, out)
    x, y = grid.x(F.col("col")), grid.y(F.col("row"))
    keyed = rows.withColumn("sample_id", F.rint(F.col("distance_km") * 1000).cast("long"))
    sites = sweep.sweep_sites(keyed.select("sample_id", "row", "col", "score"), n, min_distance_m, grid.pixel)
    sites = sites.withColumn("a_id", F.col("sample_id") * 100_000 + F.col("rank"))
    met = sweep.sweep_metrics(sites, disks, x, y, near_km, far_km).withColumnRenamed("mean_score", "mean_top")
    at = disks.select(grid.row(F.col("y")).alias("row"), grid.col(F.col("x")).alias("col")).distinct()
    centres = keyed.join(at, ["row", "col"], "left_semi").groupBy("sample_id").agg(F.avg("score").alias("mean_at"))
    inside = sweep.sweep_containment(sites, disks, x, y)
    keyed = found.withColumn("sample_id", F.rint(F.col("distance_km") * 1000).cast("long"))
    wide = keyed.join(met, "sample_id", "left").join(centres, "sample_id", "left").join(inside, "sample_id", "left")
    return saved(wide.drop("sample_id").fillna(0, ["n_sites", "sites_near", "sites_far", "regions_near", "sites_inside", "regions_with_site"]), out)


#: Layers of the thermal mesh, and how each is brought onto the grid: depths jump, so they aren't blended (fixed values).
MESH_LAYERS = {"temp_avg": "linear", "temp_max": "linear", "ice_depth": "nearest"}


def thermal_layers(spark: SparkSession, table: str, spec: tables.TableSpec, grid: GridSpec, root: str, size_m: float = 1000.0, overwrite: bool = False) -> DataFrame:
    """(row, col, temp_avg, temp_max, ice_depth) of a fixed-width table of triangle centres (tri_clat, tri_clon).

    Each layer is kept under root for its grid; the table is read only for layers that aren't there.
    """
    cells = grid.cells(spark)
    target = cells.select((F.col("row") * grid.width + F.col("col")).alias("a_id"), grid.x(F.col("col")).alias("x"), grid.y(F.col("row")).alias("y"))

    def build(layer: str, method: str) -> DataFrame:
        lat, lon = F.col("tri_clat"), F.col("tri_clon")
        rows = tables.read_fixed_width(spark, table, spec, ["tri_clat", "tri_clon", layer]).where(F.col(layer).isNotNull())
        points = rows.select(F.monotonically_increasing_id().alias("b_id"), crs.stereo_x(lon, lat).alias("x"), crs.stereo_y(lon, lat).alias("y"), layer)
        found = scattered_linear(target, points, layer, size_m) if method == "linear" else scattered_nearest(target, points, layer)
        return found.select(F.expr(f"a_id div {grid.width}").alias("row"), (F.col("a_id") % grid.width).alias("col"), layer)

    knobs = {"table": table, "size_m": size_m, **vars(grid)}
    for layer, method in MESH_LAYERS.items():
        kept = tables.cached_layer(lambda layer=layer, method=method: build(layer, method), spark, root, layer, overwrite, **knobs)
        cells = cells.select("row", "col", *(c for c in MESH_LAYERS if c in cells.columns)).join(kept, ["row", "col"], "left")
    return cells


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_regions(spark, path)
