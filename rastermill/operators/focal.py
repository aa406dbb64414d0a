"""Neighbourhood operators. Slope uses windows along rows and columns; discs and rays use tiles with a halo.

A tile with its halo is one group of bounded size whatever the grid: cells go to each tile whose halo they lie in, one
shuffle, and numpy works on the tile's dense arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import positive

TILE = 256
#: Rays of a horizon profile, evenly around.
AZIMUTHS = 36


def slope_degrees(cells: DataFrame, pixel: float, z: str = "z", out: str = "slope") -> DataFrame:
    """Add the slope from central differences; NULL at the rim, at NULL cells and beside them (gaps in the table too)."""
    p = positive("pixel", pixel)

    def difference(by: str, along: str) -> Column:
        w = Window.partitionBy(by).orderBy(along)
        near = (F.lag(along).over(w) == F.col(along) - 1) & (F.lead(along).over(w) == F.col(along) + 1)
        return F.when(near, (F.lead(z).over(w) - F.lag(z).over(w)) / (2 * p))

    rows = cells.withColumn("__dx", difference("row", "col")).withColumn("__dy", difference("col", "row"))
    value = F.degrees(F.atan(F.hypot(F.col("__dx"), F.col("__dy"))))
    return rows.withColumn(out, F.when(F.col(z).isNotNull(), value)).drop("__dx", "__dy")


def over_tiles(cells: DataFrame, layers: Sequence[str], halo: int, f: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], outputs: Sequence[str], tile: int = TILE, cut: int = 0) -> DataFrame:
    """(row, col, *outputs) for each cell: f gets dense arrays of a tile and its halo (NaN where nothing is).

    The arrays that f returns may be cut by so many cells on each side, the halo at most.
    """
    tile = max(tile, halo)
    reach = lambda c: F.explode(F.sequence(F.expr(f"floor(({c} - {halo}) / {tile})"), F.expr(f"floor(({c} + {halo}) / {tile})")))
    spread = cells.select("row", "col", *layers).withColumn("__tr", reach("row")).withColumn("__tc", reach("col"))
    names = list(layers)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0, n = key[0] * tile - halo, key[1] * tile - halo, tile + 2 * halo
        r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        arrays = {}
        for name in names:
            a = np.full((n, n), np.nan)
            a[r, c] = pdf[name].to_numpy(dtype=float, na_value=np.nan)
            arrays[name] = a
        core = (r >= halo) & (r < halo + tile) & (c >= halo) & (c < halo + tile)
        if not core.any():
            return pd.DataFrame(columns=["row", "col", *outputs])
        found = f(arrays)
        return pd.DataFrame({"row": r[core] + r0, "col": c[core] + c0, **{k: found[k][r[core] - cut, c[core] - cut] for k in outputs}})

    out = spread.groupBy("__tr", "__tc").applyInPandas(run, "row long, col long, " + ", ".join(f"{k} double" for k in outputs))
    return out.select("row", "col", *(F.when(~F.isnan(k), F.col(k)).alias(k) for k in outputs))


def disc_offsets(radius_m: float, pixel: float) -> list[tuple[int, int]]:
    r = radius_m / positive("pixel", pixel)
    if r < 0:
        raise ValueError("radius must not be negative")
    k = math.floor(r)
    return [(dy, dx) for dy in range(-k, k + 1) for dx in range(-k, k + 1) if dy * dy + dx * dx <= r * r]


def disc_size(r2: int) -> int:
    """Cells whose squared distance from the centre, in cells, is at most r2; 0 where r2 is negative."""
    k = math.isqrt(r2) if r2 >= 0 else -1
    return sum(2 * math.isqrt(r2 - dy * dy) + 1 for dy in range(-k, k + 1))


def disc_sum(a: np.ndarray, radius_m: float, pixel: float) -> np.ndarray:
    """Sums over discs by prefix sums along rows, one chord for each row of the disc; beyond the edge is 0."""
    r = radius_m / pixel
    k = math.floor(r)
    h, w = a.shape
    prefix = np.concatenate([np.zeros((h, 1)), np.cumsum(a, axis=1)], axis=1)
    out = np.zeros((h, w))
    cols = np.arange(w)
    for dy in range(-k, k + 1):
        half = math.floor(math.sqrt(max(0.0, r * r - dy * dy)) + 1e-12)
        chord = prefix[:, np.minimum(cols + half + 1, w)] - prefix[:, np.maximum(cols - half, 0)]
        lo, hi = max(0, -dy), min(h, h - dy)
        out[lo:hi] += chord[lo + dy : hi + dy]
    return out


def volatile_access(cells: DataFrame, pixel: float, layer: str = "tmax", radius_m: float = 2000.0, classes: Sequence[tuple[str, float]] = (("h2o", 110.0), ("co2", 66.0), ("ultracold", 60.0)), weights: Sequence[float] = (1 / 3, 1 / 3, 1 / 3)) -> DataFrame:
    """Shares of cells colder than each class within a disc cut at the border, and their weighted mean `combined`.

    Comparisons are strict; NULL cells don't count, and a NULL centre stays NULL. One pass for all classes.
    """
    limits = [t for _, t in classes]
    if any(a < b for a, b in zip(limits, limits[1:])):
        raise ValueError("class temperatures must not rise")
    if len(weights) != len(classes) or any(w < 0 for w in weights) or not sum(weights) > 0:
        raise ValueError("a non-negative weight for each class, not all zero")
    total = sum(weights)

    def f(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        t = arrays[layer]
        valid = ~np.isnan(t)
        n = disc_sum(valid.astype(float), radius_m, pixel)
        out = {}
        with np.errstate(invalid="ignore", divide="ignore"):
            for name, limit in classes:
                out[name] = np.where(valid, disc_sum((valid & (t < limit)).astype(float), radius_m, pixel) / n, np.nan)
        out["combined"] = sum(w / total * out[name] for w, (name, _) in zip(weights, classes, strict=True))
        return out

    return over_tiles(cells, [layer], math.floor(radius_m / positive("pixel", pixel)), f, [*(name for name, _ in classes), "combined"])


def cold_access(cells: DataFrame, pixel: float, layer: str = "tmax", radius_m: float = 2000.0, cold_k: float = 110.0) -> DataFrame:
    """The share of cells under cold_k within a walking disc."""
    return volatile_access(cells, pixel, layer, radius_m, (("access", cold_k),), (1.0,)).select("row", "col", "access")


def ray_offsets(n_azimuths: int, distances_px: Sequence[float]) -> list[tuple[int, int, float, float]]:
    """(azimuth, step, row offset, column offset); azimuth 0 is +y and turns clockwise. Rounded, so rays on the grid are exact."""
    out = []
    for a in range(n_azimuths):
        t = 2 * math.pi * a / n_azimuths
        for k, d in enumerate(distances_px):
            out.append((a, k, round(-math.cos(t) * d, 9) + 0.0, round(math.sin(t) * d, 9) + 0.0))
    return out


def ray_distances(pixel: float, max_km: float = 100.0, n: int = 50) -> list[float]:
    """Distances along a ray in metres, from a pixel to max_km in even ratios."""
    p, far = positive("pixel", pixel), positive("max_km", max_km) * 1000
    return [p * (far / p) ** (i / max(1, n - 1)) for i in range(n)]


def horizon_profile(cells: DataFrame, pixel: float, n_azimuths: int = AZIMUTHS, max_km: float = 100.0, n_distances: int = 50, radius_m: float = 1737400.0, z: str = "z", distances_m: Sequence[float] | None = None, tile: int = TILE) -> DataFrame:
    """(row, col, azimuth, horizon): the highest elevation angle in degrees over bilinear samples along each ray.

    The curvature drop d^2/2R is taken off; samples off the grid or beside NULL are skipped; -90 where none is left.
    """
    p = positive("pixel", pixel)
    if n_azimuths < 1 or n_distances < 1:
        raise ValueError("azimuths and distances must be at least 1")
    if distances_m is None:
        distances_m = ray_distances(p, max_km, n_distances)
    if any(not d > 0 for d in distances_m):
        raise ValueError("distances must be positive")
    rays = ray_offsets(n_azimuths, [d / p for d in distances_m])
    halo = math.ceil(max(distances_m) / p) + 1

    def f(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The tile without its halo; only the box of its known cells is worked on, the others have no horizon."""
        a = arrays[z]
        side = len(a) - 2 * halo
        out = {f"a{i}": np.full((side, side), -90.0) for i in range(n_azimuths)}
        known = ~np.isnan(a[halo : halo + side, halo : halo + side])
        if not known.any():
            return out
        r, c = np.flatnonzero(known.any(1)), np.flatnonzero(known.any(0))
        top, left, h, w = r[0] + halo, c[0] + halo, r[-1] - r[0] + 1, c[-1] - c[0] + 1
        centre = a[top : top + h, left : left + w]
        steepest = np.full((n_azimuths, h, w), -np.inf)
        for i, k, dr, dc in rays:
            r0, c0 = math.floor(dr), math.floor(dc)
            fr, fc = dr - r0, dc - c0
            value = np.zeros((h, w))
            for y, wy in ((top + r0, 1 - fr), (top + r0 + 1, fr)):
                for x, wx in ((left + c0, 1 - fc), (left + c0 + 1, fc)):
                    if wy * wx != 0:
                        value += wy * wx * a[y : y + h, x : x + w]
            d = distances_m[k]
            np.fmax(steepest[i], (value - centre - d * d / (2 * radius_m)) / d, out=steepest[i])
        box = slice(r[0], r[0] + h), slice(c[0], c[0] + w)
        for i in range(n_azimuths):
            out[f"a{i}"][box] = np.degrees(np.arctan(steepest[i]))
        return out

    names = [f"a{i}" for i in range(n_azimuths)]
    wide = over_tiles(cells, [z], halo, f, names, tile, cut=halo)
    return wide.select("row", "col", F.posexplode(F.array(*names)).alias("azimuth", "horizon")).withColumn("azimuth", F.col("azimuth").cast("long"))


def visibility_fraction(horizon: Column, lat: Column, lon: Column, gamma: Column, n_azimuths: int, amplitude_lat: float = 6.5, amplitude_lon: float = 7.9, samples: int = 24) -> Column:
    """The share of the libration ellipse's points seen above the horizon (an array by azimuth); strictly above."""
    if samples < 1 or n_azimuths < 1:
        raise ValueError("samples and azimuths must be at least 1")
    la, lo = F.radians(lat), F.radians(lon)
    up = (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))
    east = (-F.sin(lo), F.cos(lo), F.lit(0.0))
    north = (-F.sin(la) * F.cos(lo), -F.sin(la) * F.sin(lo), F.cos(la))
    total = F.lit(0)
    for k in range(samples):
        t = 2 * math.pi * k / samples
        p, q = math.radians(amplitude_lat * math.sin(t)), math.radians(amplitude_lon * math.cos(t))
        e = (math.cos(p) * math.cos(q), math.cos(p) * math.sin(q), math.sin(p))
        dot = lambda u, e=e: u[0] * e[0] + u[1] * e[1] + u[2] * e[2]
        elevation = F.degrees(F.asin(F.least(F.greatest(dot(up), F.lit(-1.0)), F.lit(1.0))))
        azimuth = F.pmod(F.atan2(dot(east), dot(north)) - gamma, F.lit(2 * math.pi))
        bucket = F.pmod(F.rint(azimuth / (2 * math.pi / n_azimuths)).cast("int"), F.lit(n_azimuths))
        total = total + F.when(elevation > F.element_at(horizon, bucket + 1), 1).otherwise(0)
    return total / F.lit(float(samples))
