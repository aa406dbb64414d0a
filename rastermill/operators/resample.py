"""Resampling between grids and from scattered points."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import positive
from .focal import TILE
from .grid import GridSpec
from .spatial import nearest_few

#: Kernels that gather source cells by the target cell they fall into.
GATHERED = {"min": F.min, "max": F.max, "mean": F.avg, "median": F.median}


def _weights(kernel: str, f):
    """(offset, weight) pairs of one axis for a fractional position f from the lower cell."""
    if kernel == "bilinear":
        return [(0, 1 - f), (1, f)]
    a = -0.5  # Catmull-Rom
    near = lambda t: (a + 2) * t * t * t - (a + 3) * t * t + 1
    far = lambda t: a * t * t * t - 5 * a * t * t + 8 * a * t - 4 * a
    return [(-1, far(1 + f)), (0, near(f)), (1, near(1 - f)), (2, far(2 - f))]


def resampled(source: DataFrame, source_grid: GridSpec, target: DataFrame | GridSpec, layer: str | Sequence[str], method: str = "bilinear", target_grid: GridSpec | None = None) -> DataFrame:
    """(row, col, layer or layers) of target cells (row, col, x, y in the source's coordinates), or of all cells of a target grid.

    nearest and the interpolating kernels (bilinear, cubic) renormalise weights over known cells. A grid's cells are made
    on tiles of the source, whose cells are moved once and with a halo; other targets join the needed source cells by key.
    min, max, mean and median gather source cells by target cell (target_grid needed).
    """
    layers = [layer] if isinstance(layer, str) else list(layer)
    if isinstance(target, GridSpec):
        if method in ("nearest", "bilinear", "cubic"):
            return _on_tiles(source, source_grid, target, layers, method)
        x, y = target.x(F.col("col")), target.y(F.col("row"))
        target = target.cells(source.sparkSession).withColumn("x", x).withColumn("y", y)
    if method in GATHERED:
        if target_grid is None:
            raise ValueError(f"{method} needs target_grid")
        at = source.select(target_grid.row(source_grid.y(F.col("row"))).alias("row"), target_grid.col(source_grid.x(F.col("col"))).alias("col"), *layers)
        return target.select("row", "col").join(at.groupBy("row", "col").agg(*(GATHERED[method](x).alias(x) for x in layers)), ["row", "col"], "left")
    u, v = (F.col("x") - source_grid.left) / source_grid.pixel - 0.5, (source_grid.top - F.col("y")) / source_grid.pixel - 0.5
    cells = source.select(F.col("row").alias("sr"), F.col("col").alias("sc"), *layers)
    if method == "nearest":
        return target.select("row", "col", F.rint(v).cast("long").alias("sr"), F.rint(u).cast("long").alias("sc")).join(cells, ["sr", "sc"], "left").select("row", "col", *layers)
    if method not in ("bilinear", "cubic"):
        raise ValueError(f"unknown method {method!r}")
    at = target.select("row", "col", F.floor(v).alias("r0"), F.floor(u).alias("c0"), (v - F.floor(v)).alias("fr"), (u - F.floor(u)).alias("fc"))
    corners = F.array(*(F.struct((F.col("r0") + dr).alias("sr"), (F.col("c0") + dc).alias("sc"), (wr * wc).alias("w")) for dr, wr in _weights(method, F.col("fr")) for dc, wc in _weights(method, F.col("fc"))))
    spread = at.select("row", "col", F.explode(corners).alias("k")).select("row", "col", "k.sr", "k.sc", "k.w")
    mean = lambda x: (F.sum(F.col("w") * F.col(x)) / F.nullif(F.sum(F.when(F.col(x).isNotNull(), F.col("w"))), F.lit(0.0))).alias(x)
    known = spread.where("w <> 0").join(cells, ["sr", "sc"]).groupBy("row", "col").agg(*map(mean, layers))
    return target.select("row", "col").join(known, ["row", "col"], "left")


def _on_tiles(source: DataFrame, source_grid: GridSpec, grid: GridSpec, layers: list[str], method: str) -> DataFrame:
    """The grid's cells by tiles of the source of tile x tile cells, so that a tile holds some TILE x TILE cells of either grid at most."""
    step = grid.pixel / source_grid.pixel
    tile = max(1, min(TILE, round(TILE * step)))
    offsets = [0] if method == "nearest" else [o for o, _ in _weights(method, 0.0)]
    floor = np.rint if method == "nearest" else np.floor
    down = (grid.top, -1, source_grid.top, grid.height)
    right = (grid.left, 1, source_grid.left, grid.width)

    def spots(axis: tuple, i: np.ndarray) -> np.ndarray:
        """Places of target rows or columns on the source, in cells, by the arithmetic of the grids."""
        edge, sign, start, _ = axis
        return (edge + sign * grid.pixel * (i + 0.5) - start) * sign / source_grid.pixel - 0.5

    def span(axis: tuple) -> tuple[int, int]:
        return tuple(int(floor(v)) // tile for v in spots(axis, np.array([0, axis[3] - 1])))

    def cells(axis: tuple, t: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Target rows or columns of a tile, their first places in its array, and the weights of the offsets."""
        first = spots(axis, np.array([0]))[0]
        lo, hi = math.floor((t * tile - 1 - first) / step) - 1, math.ceil(((t + 1) * tile + 1 - first) / step) + 1
        i = np.arange(max(lo, 0), min(hi, axis[3] - 1) + 1)
        v = spots(axis, i)
        i, v = (x[floor(v) // tile == t] for x in (i, v))
        at = floor(v).astype(np.int64)
        weights = [np.ones(len(v))] if method == "nearest" else [w for _, w in _weights(method, v - at)]
        return i, at - t * tile, weights

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tr, tc = (k.as_py() for k in key)
        (rows, r0, down_weights), (cols, c0, right_weights) = cells(down, tr), cells(right, tc)
        real = table.filter(pc.is_valid(table["row"]))
        n = tile + offsets[-1] - offsets[0]
        at = real["row"].to_numpy() - tr * tile - offsets[0], real["col"].to_numpy() - tc * tile - offsets[0]
        out = {"row": np.repeat(rows, len(cols)), "col": np.tile(cols, len(rows))}
        for name in layers:
            a = np.full((n, n), np.nan)
            a[at] = real[name].cast(pa.float64()).to_numpy()
            known = ~np.isnan(a)
            z, total, weight = np.where(known, a, 0.0), np.zeros((len(rows), len(cols))), np.zeros((len(rows), len(cols)))
            for i, wr in enumerate(down_weights):  # row by row, as a join in order would sum
                for j, wc in enumerate(right_weights):
                    at_cell, w = np.ix_(r0 + i, c0 + j), wr[:, None] * wc
                    total += w * z[at_cell]
                    weight += w * known[at_cell]
            none = (weight == 0).ravel()
            out[name] = pa.array(total.ravel() / np.where(none, 1.0, weight.ravel()), mask=none)
        return pa.table(out)

    (r_lo, r_hi), (c_lo, c_hi) = span(down), span(right)
    wide = c_hi - c_lo + 1
    reach = lambda c, lo, hi: F.explode(F.sequence(F.greatest(F.lit(lo), F.expr(f"cast(floor(({c} - {offsets[-1]}) / {tile}) as int)")), F.least(F.lit(hi), F.expr(f"cast(floor(({c} - {offsets[0]}) / {tile}) as int)")), F.lit(1)))
    met = lambda c, lo, hi: F.expr(f"{c} between {lo * tile + offsets[0]} and {(hi + 1) * tile - 1 + offsets[-1]}")
    near = source.select(F.col("row").cast("long"), F.col("col").cast("long"), *layers).where(met("row", r_lo, r_hi) & met("col", c_lo, c_hi))
    spread = near.withColumn("__tr", reach("row", r_lo, r_hi)).withColumn("__tc", reach("col", c_lo, c_hi))
    tiles = source.sparkSession.range((r_hi - r_lo + 1) * wide).select(F.expr(f"cast(id div {wide} as int) + {r_lo}").alias("__tr"), F.expr(f"cast(id % {wide} as int) + {c_lo}").alias("__tc"))
    return spread.unionByName(tiles, allowMissingColumns=True).groupBy("__tr", "__tc").applyInArrow(run, "row long, col long, " + ", ".join(f"`{name}` double" for name in layers))


def scattered_nearest(target: DataFrame, points: DataFrame, layer: str) -> DataFrame:
    """target (a_id, x, y) with the layer of the nearest point (b_id, x, y, layer)."""
    return nearest_few(target, points, 1, carried=[layer]).select("a_id", layer)


def scattered_linear(target: DataFrame, points: DataFrame, layer: str, size_m: float) -> DataFrame:
    """target (a_id, x, y) with inverse-distance weights of the three nearest points within size_m; NULL with fewer than three.

    An approximation of linear interpolation on a triangulation: only the three nearest points of each target are formed.
    """
    known = points.select("b_id", "x", "y", F.col(layer).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    met = nearest_few(target, known, 3, positive("size_m", size_m), ["__v"])
    three = [(F.max(F.when(F.col("place") == i, F.col("distance_m"))), F.max(F.when(F.col("place") == i, F.col("__v")))) for i in (1, 2, 3)]
    sums = met.groupBy("a_id").agg(*(c.alias(f"__{n}{i}") for i, pair in enumerate(three) for n, c in zip("dv", pair, strict=True)))
    d, v = ([F.col(f"__{n}{i}") for i in range(3)] for n in "dv")
    away = [F.nullif(x, F.lit(0.0)) for x in d]
    blend = (v[0] / away[0] + v[1] / away[1] + v[2] / away[2]) / (1 / away[0] + 1 / away[1] + 1 / away[2])
    value = F.when(d[2].isNotNull(), F.when(d[0] == 0, v[0]).otherwise(blend))
    return sums.select("a_id", value.alias(layer))
