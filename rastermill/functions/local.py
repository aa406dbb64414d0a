"""Per-cell map algebra: scores, masks and flags as Column functions. NULL in, NULL out unless stated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import clip01, positive


def inverse_threshold(x: Column, threshold: float) -> Column:
    """1 at 0, falling to 0 at the threshold."""
    return clip01(1 - x / positive("threshold", threshold))


def optimal_range(x: Column, target: float, sigma: float) -> Column:
    """A Gaussian around the target."""
    s = positive("sigma", sigma)
    return F.exp(-F.pow(x - target, F.lit(2.0)) / (2 * s * s))


def slope_score(slope_deg: Column, max_slope_deg: float = 15.0) -> Column:
    return inverse_threshold(slope_deg, max_slope_deg)


def illumination_score(fraction: Column, target: float = 0.70) -> Column:
    if not 0 < target <= 1:
        raise ValueError(f"target must be in (0, 1], got {target!r}")
    return clip01(fraction / target)


def hazard_score(density: Column, saturation: float = 50.0) -> Column:
    return clip01(1 - density / positive("saturation", saturation))


def thermal_score(kelvin: Column, target: float = 140.0, sigma: float = 30.0) -> Column:
    return optimal_range(kelvin, target, sigma)


def visibility_score(fraction: Column, least: float = 0.20, target: float = 0.50) -> Column:
    if not 0 <= least < target <= 1:
        raise ValueError(f"need 0 <= least < target <= 1, got {least!r} and {target!r}")
    return clip01((fraction - least) / (target - least))


def seismic_score(distance_km: Column, midpoint: float = 25.0, steepness: float = 8.0) -> Column:
    """Logistic in the distance; an infinite one (no scarp at all) scores 1."""
    k = positive("steepness", steepness)
    return F.when(distance_km.isin(float("inf"), float("-inf")), F.lit(1.0)).otherwise(1 / (1 + F.exp(-(distance_km - midpoint) / k)))


def coupling_score(psr_km: Column, ridge_km: Column, reach_km: float = 5.0) -> Column:
    reach = positive("reach_km", reach_km)
    return clip01(1 - psr_km / reach) * clip01(1 - ridge_km / reach)


def psr_mask(illumination: Column, threshold: float = 0.001) -> Column:
    """Permanently shadowed: no data is not shadow."""
    return F.coalesce(illumination < threshold, F.lit(False))


def sunlit_ridge(illumination: Column, slope_deg: Column, least: float = 0.70, low: float = 5.0, high: float = 25.0) -> Column:
    return F.coalesce((illumination >= least) & slope_deg.between(low, high), F.lit(False))


def ice_score(depth_m: Column, near_psr: Column, surface_bonus: float = 0.5, near_bonus: float = 0.2, max_depth: float = 2.87) -> Column:
    """Shallower ice scores higher; no data is no ice (0), which a near shadow may still lift."""
    base = F.coalesce(1 - clip01(depth_m / positive("max_depth", max_depth)), F.lit(0.0))
    bonus = F.when(F.coalesce(F.abs(depth_m) < 1e-9, F.lit(False)), surface_bonus).otherwise(0.0)
    return clip01(base + bonus + F.when(F.coalesce(near_psr, F.lit(False)), near_bonus).otherwise(0.0))


def neutron_ice_score(flux: Column, low: Column, high: Column, near_psr: Column, near_bonus: float = 0.3) -> Column:
    """1 less the min-max position of the flux, with the shadow bonus; no data stays no data."""
    place = F.when(flux.isNotNull() & (high == low), F.lit(0.0)).otherwise((flux - low) / F.nullif(high - low, F.lit(0.0)))
    return clip01(1 - place + F.when(F.coalesce(near_psr, F.lit(False)), near_bonus).otherwise(0.0))


def hls_compliant(slope_deg: Column, illumination: Column, visibility: Column, max_slope: float = 8.0, min_illumination: float = 0.33, min_visibility: float = 0.50) -> Column:
    return F.coalesce((slope_deg <= max_slope) & (illumination >= min_illumination) & (visibility >= min_visibility), F.lit(False))


def dominant(scores: Mapping[str, Column], n: int = 3) -> Column:
    """Names of the n highest non-null scores, ties in the given order."""
    entries = F.array(*(F.struct((-c).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, c) in enumerate(scores.items())))
    return F.transform(F.slice(F.array_sort(F.filter(entries, lambda x: x["s"].isNotNull())), 1, n), lambda x: x["k"])


def lookup(value: Column, mapping: Mapping[str, str | None]) -> Column:
    """A small fixed dictionary as a map literal; an unknown key gives NULL."""
    return F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))[value]


def first_present(columns: Sequence[str], candidates: Sequence[str]) -> str:
    """The first candidate among the columns, by lower case."""
    lower = {c.lower(): c for c in columns}
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    raise ValueError(f"none of {list(candidates)} among {list(columns)}")


def resolve_years(columns: Sequence[str], years: Sequence[int], prefix: str = "sundays") -> dict[int, str]:
    """Columns such as SunDays25 or Sundays32 by their year, whatever the case; missing years are an error."""
    lower = {c.lower(): c for c in columns}
    found = {y: lower[f"{prefix}{y % 100:02d}"] for y in years if f"{prefix}{y % 100:02d}" in lower}
    if missing := [y for y in years if y not in found]:
        raise ValueError(f"no {prefix} column for {missing}")
    return found
