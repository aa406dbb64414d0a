"""Distances to masks and features. Thresholds use bounded neighbourhoods; the exact transform has two separable passes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import positive
from .focal import disc_offsets, disc_size, disc_sum, over_tiles
from .spatial import ARRAY_ROWS, nearest

#: Discs of more cells are summed on tiles.
NEAR_OFFSETS = 250


def _envelope(g: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """min over i of (at - rows[i])^2 + g[i], by the lower envelope of parabolas."""
    hull, cut = [0], [-math.inf]
    for i in range(1, len(rows)):
        while True:
            j = hull[-1]
            s = ((g[i] + rows[i] ** 2) - (g[j] + rows[j] ** 2)) / (2 * (rows[i] - rows[j]))
            if s <= cut[-1]:
                hull.pop()
                cut.pop()
            else:
                break
        hull.append(i)
        cut.append(s)
    chosen = np.asarray(hull)[np.searchsorted(np.asarray(cut), at, side="left") - 1]
    return (at - rows[chosen]) ** 2 + g[chosen]


def distance_to_mask(cells: DataFrame, mask: Column, pixel: float, out: str = "distance_m") -> DataFrame:
    """(row, col, out): exact metres to the nearest cell of the mask, 0 on it; NULL everywhere if it is empty.

    Pass 1 finds the nearest mask column of each row by windows; pass 2 takes each column's lower envelope. A group is
    one grid column, of at most the grid's height.
    """
    p = positive("pixel", pixel)
    w = Window.partitionBy("row").orderBy("col")
    at = F.when(mask, F.col("col"))
    left, right = F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    gap = cells.select("row", "col", F.least(F.col("col") - left, right - F.col("col")).cast("double").alias("gap"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        rows = pdf["row"].to_numpy(dtype=float)
        known = pdf["gap"].notna().to_numpy()
        d = np.full(len(pdf), np.nan)
        if known.any():
            d = np.sqrt(_envelope(pdf["gap"].to_numpy(dtype=float)[known] ** 2, rows[known], rows)) * p
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], out: d})

    done = gap.groupBy("col").applyInPandas(run, f"row long, col long, {out} double")
    return done.withColumn(out, F.when(~F.isnan(out), F.col(out)))


def near_mask(cells: DataFrame, mask: Column, radius_m: float, pixel: float, strict: bool = False) -> DataFrame:
    """(row, col) of cells within the radius of a mask cell, or strictly within it.

    Mask cells are spread over the offsets of a small disc and met by key. A disc of more than NEAR_OFFSETS cells is summed
    on tiles with a halo instead, so the plan and the rows do not grow with the disc.
    """
    r2 = (radius_m / positive("pixel", pixel)) ** 2
    offsets_r2 = math.ceil(r2) - 1 if strict else math.floor(r2)
    if radius_m < 0:
        raise ValueError("radius must not be negative")
    if offsets_r2 < 0:
        return cells.select("row", "col").where(F.lit(False))
    if disc_size(offsets_r2) > NEAR_OFFSETS:
        # half a unit more than a whole square keeps the test of a disc's rim exact
        reach = math.sqrt(offsets_r2 + 0.5)
        found = over_tiles(
            cells.select("row", "col", F.when(mask, 1.0).otherwise(0.0).alias("__mask")),
            ["__mask"],
            math.isqrt(offsets_r2),
            lambda a: {"__near": disc_sum(np.nan_to_num(a["__mask"]), reach, 1.0)},
            ["__near"],
        )
        return found.where(F.col("__near") > 0.5).select("row", "col")
    offsets = [(a, b) for a, b in disc_offsets(radius_m, pixel) if a * a + b * b <= offsets_r2]
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets)))
    spread = cells.where(mask).select("row", "col", each.alias("o"))
    hit = spread.select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col")).distinct()
    return cells.select("row", "col").join(hit, ["row", "col"], "left_semi")


def clear_of_steep(cells: DataFrame, slope: str, max_slope: float, buffer_m: float, pixel: float) -> DataFrame:
    """cells at least buffer_m from every cell that is not known to be flat; a NULL slope counts as steep."""
    steep = ~F.coalesce(F.col(slope) <= max_slope, F.lit(False))
    return cells.join(near_mask(cells, steep, buffer_m, pixel, strict=True), ["row", "col"], "left_anti")


def densified(lines: DataFrame, spacing_m: float = 1000.0) -> DataFrame:
    """(line_id, points: array<struct<x, y>>) -> (line_id, k, x, y): max(2, ceil(length / spacing) + 1) even points.

    Lengths are in projected metres. A single vertex gives one point; empty and NULL lines give none.
    """
    s = positive("spacing_m", spacing_m)
    rows = lines.where(F.size("points") > 0).withColumn("segments", F.transform(F.sequence(F.lit(1), F.greatest(F.size("points") - 1, F.lit(1))), lambda i: F.struct(F.get("points", i - 1).alias("a"), F.coalesce(F.get("points", i), F.get("points", i - 1)).alias("b"))))
    rows = rows.withColumn("lengths", F.transform("segments", lambda g: F.hypot(g["b"]["x"] - g["a"]["x"], g["b"]["y"] - g["a"]["y"])))
    rows = rows.withColumn("ends", F.transform("lengths", lambda x, i: F.aggregate(F.slice("lengths", F.lit(1), i + 1), F.lit(0.0), lambda u, v: u + v)))
    rows = rows.withColumn("length", F.element_at("ends", -1)).withColumn("n", F.when(F.size("points") == 1, 1).otherwise(F.greatest(F.lit(2), (F.ceil(F.col("length") / s) + 1).cast("int"))))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("at", F.when(F.col("n") == 1, 0.0).otherwise(F.col("length") * F.col("k") / F.greatest(F.col("n") - 1, F.lit(1))))
    rows = rows.withColumn("i", F.least(F.size(F.filter("ends", lambda e: e < F.col("at"))), F.size("ends") - 1))
    g, length = F.get("segments", F.col("i")), F.get("lengths", F.col("i"))
    share = F.when(length > 0, (F.col("at") - (F.get("ends", F.col("i")) - length)) / length).otherwise(0.0)
    return rows.select("line_id", F.col("k").cast("long").alias("k"), (g["a"]["x"] + share * (g["b"]["x"] - g["a"]["x"])).alias("x"), (g["a"]["y"] + share * (g["b"]["y"] - g["a"]["y"])).alias("y"))


def feature_distance(a: DataFrame, points: DataFrame, array_rows: int = ARRAY_ROWS) -> DataFrame:
    """(a_id, x, y) x (b_id, x, y) of densified features -> a_id, km to the nearest; infinite where there is no feature at all."""
    found = nearest(a, points, array_rows=array_rows)
    return found.select("a_id", F.coalesce(F.col("distance_m") / 1000, F.lit(float("inf"))).alias("km"))
