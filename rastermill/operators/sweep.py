"""Parameter sweeps: Latin hypercube weights, weight sweeps and distance sweeps, all samples in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rank import separated
from .spatial import BROADCAST_ROWS, contains, radius_join, ring_edges


def latin_hypercube(spark: SparkSession, n: int, names: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows of weights that sum to 1: a Latin hypercube of the cuts between them, one stratum a row and dimension."""
    if n <= 0 or not names:
        raise ValueError("need samples and names")
    d, rng = len(names), np.random.default_rng(seed)
    cuts = np.stack([(rng.permutation(n) + rng.random(n)) / n for _ in range(d - 1)], axis=1) if d > 1 else np.zeros((n, 0))
    w = np.diff(np.concatenate([np.zeros((n, 1)), np.sort(cuts, axis=1), np.ones((n, 1))], axis=1), axis=1)
    schema = "sample_id long, " + ", ".join(f"`{x}` double" for x in names)
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(w)], schema)


def sweep_scores(cells: DataFrame, samples: DataFrame, scores: Mapping[str, str]) -> DataFrame:
    """(sample_id, row, col, score) for every sample of weights and cell; up to BROADCAST_ROWS samples are broadcast."""
    if not scores:
        raise ValueError("no criteria")
    weights = samples.select("sample_id", *(F.col(n).alias(f"__w_{n}") for n in scores))
    total = sum((F.col(f"__w_{n}") for n in scores), F.lit(0.0))
    score = sum((F.col(f"__w_{n}") / total * F.col(c) for n, c in scores.items()), F.lit(0.0))
    few = weights.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return cells.crossJoin(F.broadcast(weights) if few else weights).select("sample_id", "row", "col", score.alias("score"))


def sweep_sites(scored: DataFrame, n: int, min_distance_m: float, pixel: float) -> DataFrame:
    """The separated top sites of every sample, samples in parallel."""
    return separated(scored.where("score is not null"), ["sample_id"], n, min_distance_m, pixel)


def sweep_metrics(sites: DataFrame, centroids: DataFrame, x: Column, y: Column, near_km: float, far_km: float | None = None) -> DataFrame:
    """Per sample: n_sites, sites within near_km and within far_km of a centroid, centroids with a site within near_km, mean score.

    Sites and centroids meet in buckets of far_km, so neither side is broadcast.
    """
    far = near_km if far_km is None else max(near_km, far_km)
    named = sites.withColumn("a_id", F.monotonically_increasing_id()) if "a_id" not in sites.columns else sites
    placed = named.withColumn("x", x).withColumn("y", y)
    pairs = radius_join(placed.select("sample_id", "a_id", "x", "y"), centroids.select("b_id", "x", "y"), far * 1000)
    near = F.col("distance_m") <= near_km * 1000
    met = pairs.groupBy("sample_id").agg(F.count_distinct(F.when(near, F.col("a_id"))).alias("sites_near"), F.count_distinct("a_id").alias("sites_far"), F.count_distinct(F.when(near, F.col("b_id"))).alias("regions_near"))
    rows = placed.groupBy("sample_id").agg(F.count("*").alias("n_sites"), F.avg("score").alias("mean_score")).join(met, "sample_id", "left")
    return rows.select("sample_id", "n_sites", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("sites_near", "sites_far", "regions_near")), "mean_score")


def sweep_containment(sites: DataFrame, disks: DataFrame, x: Column, y: Column) -> DataFrame:
    """Per sample: sites that lie in any disk (b_id, x, y, radius_km, ring), and disks that hold one.

    Both meet in buckets of the largest radius; samples none of whose sites lies in a disk have no row.
    """
    widest = disks.agg(F.max("radius_km")).first()[0] or 1.0
    placed = sites.select("sample_id", F.monotonically_increasing_id().alias("a_id"), x.alias("x"), y.alias("y"))
    shapes = disks.select("b_id", "x", "y", ring_edges(F.col("ring")).alias("edges"))
    met = radius_join(placed, shapes, widest * 1000).where(contains(F.col("edges"), F.col("ax"), F.col("ay")))
    return met.groupBy("sample_id").agg(F.count_distinct("a_id").alias("sites_inside"), F.count_distinct("b_id").alias("regions_with_site"))


def sweep_statistics(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: least, median (cut to a whole number) and largest value of each count over the samples."""
    return results.agg(*(x for c in columns for x in (F.min(c).alias(f"{c}_min"), F.floor(F.median(c)).cast("long").alias(f"{c}_median"), F.max(c).alias(f"{c}_max"))))


def scores_at(cells: DataFrame, samples: DataFrame, scores: Mapping[str, str]) -> DataFrame:
    """(sample_id, mean_at): each sample's mean score over some cells, those of the centroids for instance; unknown scores don't count."""
    return sweep_scores(cells, samples, scores).groupBy("sample_id").agg(F.avg("score").alias("mean_at"))


def sweep_distance(cells: DataFrame, distances_km: Sequence[float], score: Column) -> DataFrame:
    """(distance_km, row, col, score): score is a Column of `distance_km` and layers, evaluated for each distance."""
    if any(not d > 0 for d in distances_km):
        raise ValueError("distances must be positive")
    each = F.explode(F.array(*(F.lit(float(d)) for d in distances_km)))
    return cells.withColumn("distance_km", each).withColumn("score", score)
