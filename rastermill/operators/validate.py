"""Comparison of ranked sites with catalogs and regions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import BROADCAST_ROWS, contains, nearest, ring_edges, signed_edge_distance


def zonal_area(cells: DataFrame, eligible: DataFrame, pixel: float, region: str = "region") -> DataFrame:
    """Each region's area and eligible area in km2, and their ratio; `eligible` holds the rows of cells that pass every filter."""
    km2 = pixel * pixel / 1e6
    all_ = cells.groupBy(region).agg((F.count("*") * km2).alias("area_km2"))
    some = eligible.groupBy(region).agg((F.count("*") * km2).alias("eligible_km2"))
    rows = all_.join(some, region, "left").withColumn("eligible_km2", F.coalesce("eligible_km2", F.lit(0.0)))
    return rows.withColumn("fraction", F.col("eligible_km2") / F.col("area_km2"))


def compliance(regions: DataFrame, sites: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """Every region with its sites' count, best and mean score, best site (0: none; ties to the first) and eligible fraction.

    areas holds (region, eligible_km2) and, where it was counted, area_km2; without that column the published area_km2
    of regions divides. A region without a known area, or that areas lacks, has the fraction 0.
    """
    per = sites.groupBy("region").agg(F.count("*").alias("n_sites"), F.max("score").alias("best"), F.avg("score").alias("mean"), F.min_by("site_id", F.struct(-F.col("score"), F.col("site_id"))).alias("best_site"))
    published = F.col("area_km2").cast("double") if "area_km2" in regions.columns else F.lit(None).cast("double")
    rows = regions.select("region", published.alias("__published")).join(per, "region", "left")
    fraction = F.lit(0.0)
    if areas is not None:
        counted = F.col("area_km2") if "area_km2" in areas.columns else F.lit(None).cast("double")
        rows = rows.join(areas.select("region", "eligible_km2", counted.alias("__counted")), "region", "left")
        area = F.coalesce("__counted", "__published")
        fraction = F.coalesce(F.when(area > 0, F.col("eligible_km2") / area), F.lit(0.0))
    return rows.select("region", F.coalesce("n_sites", F.lit(0)).alias("n_sites"), "best", "mean", F.coalesce("best_site", F.lit(0)).alias("best_site"), fraction.alias("fraction"))


def compliance_totals(per_region: DataFrame) -> DataFrame:
    """One row over compliance(): sites, regions, regions with sites, and the names of those without, in order."""
    none = F.col("n_sites") == 0
    return per_region.agg(
        F.coalesce(F.sum("n_sites"), F.lit(0)).alias("n_sites_total"),
        F.count("*").alias("n_regions_total"),
        F.count_if(~none).alias("n_regions_with_sites"),
        F.count_if(none).alias("n_regions_without"),
        F.array_join(F.sort_array(F.collect_list(F.when(none, F.col("region").cast("string")))), ",").alias("regions_without"),
    )


def matches(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """Nearest of b for each a, matched if within km (inclusive): a_id, b_id, distance_km, matched."""
    return nearest(a, b).select("a_id", "b_id", (F.col("distance_m") / 1000).alias("distance_km"), F.coalesce(F.col("distance_m") <= km * 1000, F.lit(False)).alias("matched"))


def compare(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """One row: sizes, matches of both directions, median and largest distance of the matches of a."""
    forth, back = matches(a, b, km), matches(b.select(F.col("b_id").alias("a_id"), "x", "y"), a.select(F.col("a_id").alias("b_id"), "x", "y"), km)
    left = forth.agg(F.count("*").alias("n_a"), F.count_if("matched").alias("matched_a"), F.median(F.when(F.col("matched"), F.col("distance_km"))).alias("median_km"), F.max(F.when(F.col("matched"), F.col("distance_km"))).alias("max_km"))
    right = back.agg(F.count("*").alias("n_b"), F.count_if("matched").alias("matched_b"))
    return left.withColumn("one", F.lit(1)).join(right.withColumn("one", F.lit(1)), "one").drop("one")


def _swapped(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("a_id", "__id").withColumnRenamed("b_id", "a_id").withColumnRenamed("__id", "b_id")


def compare_by_region(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """(id, region, x, y) on both sides -> each region of either side: counts, matches, median distance, unmatched ids of both.

    A site matches if its nearest partner, wherever that lies, is within km and stands in the same region.
    """
    ids = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col(c)))), ",")

    def sides(one: DataFrame, other: DataFrame) -> DataFrame:
        found = matches(one.select("a_id", "x", "y"), other.select("b_id", "x", "y"), km).join(other.select("b_id", F.col("region").alias("there")), "b_id", "left")
        rows = one.select("a_id", "region").join(found, "a_id", "left")
        return rows.withColumn("ok", F.coalesce(F.col("matched") & (F.col("there") == F.col("region")), F.lit(False)))

    left = sides(a, b).groupBy("region").agg(F.count("*").alias("n_a"), F.count_if("ok").alias("matched"), F.median(F.when(F.col("ok"), F.col("distance_km"))).alias("median_km"), ids("a_id").alias("unmatched_a"))
    right = sides(_swapped(b), _swapped(a)).groupBy("region").agg(F.count("*").alias("n_b"), ids("a_id").alias("unmatched_b"))
    rows = left.join(right, "region", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("region", zero("n_a"), zero("n_b"), zero("matched"), "median_km", F.coalesce("unmatched_a", F.lit("")).alias("unmatched_a"), F.coalesce("unmatched_b", F.lit("")).alias("unmatched_b"))


def disagreements(found: DataFrame, n: int = 3) -> DataFrame:
    """The n unmatched rows farthest from any partner; no distance counts as 0."""
    return found.where(~F.col("matched")).orderBy(F.desc(F.coalesce("distance_km", F.lit(0.0))), "a_id").limit(n)


def _beside(sites: DataFrame, shapes: DataFrame) -> DataFrame:
    """Every site with every shape: few shapes are broadcast after a count, more meet the sites on executors."""
    few = shapes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return sites.crossJoin(F.broadcast(shapes) if few else shapes)


def polygon_distances(sites: DataFrame, polygons: DataFrame) -> DataFrame:
    """(a_id, x, y) x (ordinal, region, ring) -> the containing region (first in order), or the nearest, and the signed distance."""
    rings = polygons.select("ordinal", "region", ring_edges(F.col("ring")).alias("edges"))
    pairs = _beside(sites.select("a_id", "x", "y"), rings).withColumn("inside", contains(F.col("edges"), F.col("x"), F.col("y"))).withColumn("signed", signed_edge_distance(F.col("edges"), F.col("x"), F.col("y")))
    pick = F.struct(F.when(F.col("inside"), 0).otherwise(1), F.when(F.col("inside"), 0.0).otherwise(F.col("signed")), F.col("ordinal"))
    return pairs.groupBy("a_id").agg(F.min_by("region", pick).alias("region"), F.bool_or("inside").alias("inside"), F.min("signed").alias("signed_m"))


def polygons_by_sites(sites: DataFrame, polygons: DataFrame) -> DataFrame:
    """Each polygon's nearest site (the first on ties), the distance to it, 0 inside, and whether it holds any site."""
    rings = polygons.select("ordinal", "region", ring_edges(F.col("ring")).alias("edges"))
    pairs = _beside(sites.select("a_id", "x", "y"), rings).withColumn("inside", contains(F.col("edges"), F.col("x"), F.col("y")))
    pairs = pairs.withColumn("km", F.when(F.col("inside"), 0.0).otherwise(signed_edge_distance(F.col("edges"), F.col("x"), F.col("y")) / 1000))
    return pairs.groupBy("ordinal", "region").agg(F.min_by("a_id", F.struct("km", "a_id")).alias("a_id"), F.min("km").alias("distance_km"), F.bool_or("inside").alias("contains"))


def nearest_names(sites: DataFrame, centroids: DataFrame, name: str = "region") -> DataFrame:
    """(a_id, name, distance_km): the nearest centroid's name for each site; NULLs without centroids."""
    found = nearest(sites.select("a_id", "x", "y"), centroids.select("b_id", "x", "y"))
    return found.join(centroids.select("b_id", name), "b_id", "left").select("a_id", name, (F.col("distance_m") / 1000).alias("distance_km"))


def _to_disks(sites: DataFrame, disks: DataFrame) -> DataFrame:
    shapes = disks.select("b_id", F.col("x").alias("bx"), F.col("y").alias("by"), "radius_km", ring_edges(F.col("ring")).alias("edges"))
    x, y = F.col("x"), F.col("y")
    pairs = _beside(sites.select("a_id", "x", "y"), shapes).withColumn("inside", contains(F.col("edges"), x, y)).withColumn("edge_km", signed_edge_distance(F.col("edges"), x, y) / 1000)
    return pairs.select("a_id", "b_id", "radius_km", "inside", "edge_km", (F.hypot(x - F.col("bx"), y - F.col("by")) / 1000).alias("km"))


def sites_by_disks(sites: DataFrame, disks: DataFrame) -> DataFrame:
    """(a_id, x, y) x (b_id, x, y, radius_km, ring) -> each site's nearest centre, distance to it, signed distance to the nearest rim, and whether a disk holds it."""
    return _to_disks(sites, disks).groupBy("a_id").agg(F.min_by("b_id", F.struct("km", "b_id")).alias("b_id"), F.min("km").alias("distance_km"), F.min("edge_km").alias("edge_km"), F.bool_or("inside").alias("inside"))


def disks_by_sites(sites: DataFrame, disks: DataFrame) -> DataFrame:
    """Each disk's nearest site, the distance of its centre and of its rim (signed) to that site, whether it holds a site, and whether
    the nearest one lies inside or no farther from the rim than the radius."""
    near = F.struct("km", "a_id")
    rows = _to_disks(sites, disks).groupBy("b_id").agg(F.min_by("a_id", near).alias("a_id"), F.min("km").alias("distance_km"), F.min_by("edge_km", near).alias("edge_km"), F.bool_or("inside").alias("contains"), F.first("radius_km").alias("radius_km"))
    return rows.withColumn("within_radius", F.col("edge_km") <= F.col("radius_km")).drop("radius_km")


def proximity(sites: DataFrame, centroids: DataFrame, near_km: float) -> DataFrame:
    """One row: sites, those within near_km of a centroid, centroids with a site within near_km, median distance."""
    forth = matches(sites, centroids, near_km)
    back = matches(centroids.select(F.col("b_id").alias("a_id"), "x", "y"), sites.select(F.col("a_id").alias("b_id"), "x", "y"), near_km)
    left = forth.agg(F.count("*").alias("n_sites"), F.count_if("matched").alias("sites_near"), F.median("distance_km").alias("median_km")).withColumn("one", F.lit(1))
    return left.join(back.agg(F.count("*").alias("n_regions"), F.count_if("matched").alias("regions_near")).withColumn("one", F.lit(1)), "one").drop("one")


def _side_by_side(*rows: DataFrame) -> DataFrame:
    """Tables of one row as one row."""
    out = rows[0].withColumn("__one", F.lit(1))
    for r in rows[1:]:
        out = out.join(r.withColumn("__one", F.lit(1)), "__one")
    return out.drop("__one")


def proximity_totals(sites: DataFrame, disks: DataFrame, near_km: float, polygons: DataFrame | None = None) -> DataFrame:
    """One row over sites_by_disks and disks_by_sites, and over the polygons' both sides if they are given.

    Counts are 0, the median distance NULL, where either side is empty; a distance of exactly near_km is near.
    """
    out = [
        sites.agg(F.count("*").alias("n_sites")),
        disks.agg(F.count("*").alias("n_regions")),
        sites_by_disks(sites, disks).agg(F.count_if(F.col("distance_km") <= near_km).alias("sites_near"), F.count_if("inside").alias("sites_inside")),
        disks_by_sites(sites, disks).agg(F.count_if(F.col("distance_km") <= near_km).alias("regions_near"), F.count_if("contains").alias("regions_with_site"), F.count_if("within_radius").alias("regions_within_radius")),
    ]
    if polygons is not None:
        km = F.when(F.col("inside"), 0.0).otherwise(F.col("signed_m") / 1000)
        out.append(polygons.agg(F.count("*").alias("n_polygons")))
        out.append(polygon_distances(sites, polygons).agg(F.count_if("inside").alias("sites_in_polygons"), F.median(km).alias("median_polygon_km")))
        out.append(polygons_by_sites(sites, polygons).agg(F.count_if("contains").alias("polygons_with_site")))
    return _side_by_side(*out)


def notable(a: DataFrame, b: DataFrame, km: float, n: int = 3) -> DataFrame:
    """The disagreements of both sides: side 'a' or 'b', id, partner, distance_km."""
    forth, back = matches(a, b, km), matches(_swapped(b), _swapped(a), km)
    rows = [disagreements(found, n).select(F.lit(s).alias("side"), F.col("a_id").alias("id"), F.col("b_id").alias("partner"), "distance_km") for s, found in (("a", forth), ("b", back))]
    return rows[0].unionByName(rows[1])


#: Launch years that a catalog's lit days cover, and the headline year (fixed values).
FIRST_YEAR, LAST_YEAR, HEADLINE_YEAR = 2025, 2032, 2028


def launch_year_sites(found: DataFrame, catalog: DataFrame, columns: Mapping[int, str], threshold: int = 10, headline: int = HEADLINE_YEAR) -> DataFrame:
    """matches() x catalog (b_id, lit days a year) -> a row a site: its match, days by year, and whether the headline or any year has enough.

    A site without a match has NULLs and passes nothing; a match without days counts as 0.
    """
    if threshold <= 0:
        raise ValueError(f"the threshold is {threshold!r} days")
    if wrong := [y for y in (*columns, headline) if not FIRST_YEAR <= y <= LAST_YEAR]:
        raise ValueError(f"years {wrong} lie outside {FIRST_YEAR}-{LAST_YEAR}")
    if headline not in columns:
        raise ValueError(f"no column for {headline}")
    days = {y: F.coalesce(F.col(c).cast("long"), F.lit(0)) for y, c in sorted(columns.items())}
    enough = lambda *ys: F.coalesce(F.greatest(F.lit(False), *(F.col("matched") & (days[y] >= threshold) for y in ys)), F.lit(False))
    rows = found.join(catalog.select("b_id", *columns.values()), "b_id", "left")
    by_year = F.create_map(*(x for y, d in days.items() for x in (F.lit(y), d)))
    matched = lambda c: F.when(F.col("matched"), c)
    return rows.select("a_id", "matched", matched(F.col("b_id")).alias("b_id"), matched(F.col("distance_km")).alias("distance_km"), matched(by_year).alias("days"), enough(headline).alias("passes_headline"), enough(*days).alias("passes_any"))


def launch_year_totals(sites: DataFrame) -> DataFrame:
    return sites.agg(F.count("*").alias("n_sites"), F.count_if("matched").alias("n_matched"), F.count_if("passes_headline").alias("passes_headline"), F.count_if("passes_any").alias("passes_any"))


def launch_years(found: DataFrame, catalog: DataFrame, columns: Mapping[int, str], threshold: int = 10) -> DataFrame:
    """matches() x catalog (b_id, one column of lit days a year) -> year, passes: matched sites with at least threshold days."""
    if not columns:
        raise ValueError("no years")
    rows = found.where("matched").join(catalog, "b_id")
    days = F.explode(F.array(*(F.struct(F.lit(y).cast("long").alias("year"), F.col(c).alias("days")) for y, c in sorted(columns.items()))))
    passes = rows.select(days.alias("d")).groupBy("d.year").agg(F.count_if(F.coalesce(F.col("d.days") >= threshold, F.lit(False))).alias("passes"))
    years = found.sparkSession.createDataFrame([(int(y),) for y in sorted(columns)], "year long")
    return years.join(passes, "year", "left").select("year", F.coalesce("passes", F.lit(0)).alias("passes"))


def region_names(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("region").union(b.select("region")).where("region is not null").distinct()
