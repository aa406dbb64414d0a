"""Greedy top-k with a minimum separation, globally, by zone and by tile, and small rankings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import positive
from .distance import clear_of_steep
from .focal import disc_size


#: Parts of a group in which its best cells are sought first.
SALTS = 64
#: More cells than these go through parts of parts.
MERGED_ROWS, MERGED_SALTS = 1_000_000, 8


def _checked(n: int, min_distance_m: float, pixel: float) -> float:
    if n <= 0:
        raise ValueError(f"no sites to choose: n = {n!r}")
    return (positive("min_distance_m", min_distance_m) / positive("pixel", pixel)) ** 2


def separated(candidates: DataFrame, by: list[str], n: int, min_distance_m: float, pixel: float, score: str = "score") -> DataFrame:
    """The n best cells of each group, ties by row and column, none closer than the distance (exactly it is allowed).

    The greedy walk ends within the first n * D cells of a group's order, D being the cells that one chosen cell can
    suppress, itself included. So each group's task takes that many cells at most, picked in steps: within SALTS parts,
    within MERGED_SALTS where the parts hold over MERGED_ROWS cells together, then in the group.
    """
    d2 = _checked(n, min_distance_m, pixel)
    keys = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in by]
    names = [*by, "row", "col", score]

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, "row", "col"], ascending=[False, True, True], kind="stable")
        r, c = pdf["row"].to_numpy(dtype=float), pdf["col"].to_numpy(dtype=float)
        free, chosen, at = np.ones(len(pdf), bool), [], 0
        while len(chosen) < n and at < len(pdf):
            if free[at]:
                chosen.append(at)
                free &= (r - r[at]) ** 2 + (c - c[at]) ** 2 >= d2
            at += 1
        out = pdf.iloc[chosen].copy()
        out["rank"] = np.arange(1, len(chosen) + 1)
        return out

    schema = candidates.select(*names).withColumn("rank", F.lit(0).cast("long")).schema
    most = n * max(1, disc_size(math.ceil(d2) - 1))

    def best(df: DataFrame, *part: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc(score), "row", "col"))
        return df.withColumn("__i", place).where(F.col("__i") <= most).drop("__i")

    salt = lambda m: F.pmod(F.hash("row", "col"), F.lit(m))
    thin = best(candidates.select(*names), *keys, salt(SALTS))
    if most * SALTS > MERGED_ROWS:
        thin = best(thin, *keys, salt(MERGED_SALTS))
    thin = best(thin, *(keys or [F.lit(0)]))
    if not by:
        return thin.withColumn("__g", F.lit(0)).groupBy("__g").applyInPandas(lambda pdf: greedy(pdf.drop(columns="__g")), schema)
    return thin.groupBy(*by).applyInPandas(greedy, schema)


def top_sites(cells: DataFrame, n: int = 20, min_distance_m: float = 5000.0, min_score: float = 0.5, pixel: float = 240.0, score: str = "score") -> DataFrame:
    """The n best cells of the grid: site_id, rank, row, col, score."""
    found = separated(cells.where(F.col(score) >= min_score), [], n, min_distance_m, pixel, score)
    return found.select(F.format_string("site_%02d", "rank").alias("site_id"), "rank", "row", "col", score)


def compliant_cells(cells: DataFrame, pixel: float, max_slope: float = 8.0, buffer_m: float = 100.0, min_illumination: float = 0.33, min_visibility: float = 0.50, slope: str = "slope", illumination: str = "illum", visibility: str = "los", score: str = "score") -> DataFrame:
    """The hard filters: known score, flat, lit and visible enough, and buffer_m away from anything steep."""
    safe = clear_of_steep(cells, slope, max_slope, buffer_m, pixel)
    return safe.where(F.col(score).isNotNull() & (F.col(slope) <= max_slope) & (F.col(illumination) >= min_illumination) & (F.col(visibility) >= min_visibility))


def top_sites_per_region(cells: DataFrame, region: str = "region", n: int = 10, min_distance_m: float = 2000.0, pixel: float = 240.0, score: str = "score") -> DataFrame:
    """Compliant cells (a cell may stand in several regions) -> the n best of each region, site_id numbered over regions in order."""
    found = separated(cells, [region], n, min_distance_m, pixel, score)
    return found.withColumnRenamed("rank", "rank_in_region").withColumn("site_id", F.row_number().over(Window.orderBy(region, "rank_in_region")).cast("long"))


def best_weights(results: DataFrame, keys: list[str]) -> DataFrame:
    """The first result by the keys, all descending; ties by sample_id."""
    return results.orderBy(*(F.desc(k) for k in keys), "sample_id").limit(1)


def nearest_sample(samples: DataFrame, default: dict[str, float]) -> DataFrame:
    """The sample of the smallest L1 distance to the default weights; the first on ties."""
    gap = sum((F.abs(F.col(c) - w) for c, w in default.items()), F.lit(0.0))
    return samples.withColumn("gap", gap).agg(F.min_by("sample_id", F.struct("gap", "sample_id")).alias("sample_id"), F.min("gap").alias("gap"))


def best_distance(results: DataFrame, by: str, distance: str = "distance_km") -> DataFrame:
    """The row of a distance sweep with the most of `by`; the first distance on ties."""
    return results.orderBy(F.desc(by), distance).limit(1)
