"""Multi-criteria aggregation and statistics."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The eight criteria and their default weights (fixed values).
CRITERIA = ("slope", "illumination", "eva_psr_access", "thermal", "multi_volatile", "hazard", "los_to_earth", "seismic")
DEFAULT_WEIGHTS = {
    "illumination": 0.17,
    "multi_volatile": 0.17,
    "eva_psr_access": 0.17,
    "los_to_earth": 0.14,
    "slope": 0.12,
    "thermal": 0.07,
    "hazard": 0.06,
    "seismic": 0.10,
}


def normalised_weights(criteria: Sequence[str], weights: Mapping[str, float]) -> dict[str, float]:
    """Weights of the present criteria, summing to 1."""
    if not criteria:
        raise ValueError("no criteria")
    if missing := [c for c in criteria if c not in weights]:
        raise KeyError(f"no weight for {missing}")
    if extra := [c for c in weights if c not in criteria]:
        warnings.warn(f"weights without a criterion, left out: {extra}", stacklevel=2)
    used = {c: float(weights[c]) for c in criteria}
    if any(w < 0 for w in used.values()):
        raise ValueError("weights must not be negative")
    total = sum(used.values())
    if not total > 0:
        raise ValueError("weights sum to zero")
    return {c: w / total for c, w in used.items()}


def weighted_sum(scores: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """The weighted mean; NULL if any score is."""
    out = F.lit(0.0)
    for name, w in normalised_weights(list(scores), weights).items():
        out = out + F.lit(w) * scores[name]
    return out


def topsis(cells: DataFrame, scores: Mapping[str, str], weights: Mapping[str, float], out: str = "topsis") -> DataFrame:
    """Closeness to the ideal point. One aggregate gives norms and extremes, of each criterion's own non-null cells."""
    w = normalised_weights(list(scores), weights)
    stats = cells.agg(*(f(F.col(c)).alias(f"{k}_{n}") for n, c in scores.items() for k, f in (("sq", lambda x: F.sum(x * x)), ("hi", F.max), ("lo", F.min)))).first()
    near, far = F.lit(0.0), F.lit(0.0)
    for n, c in scores.items():
        norm = (stats[f"sq_{n}"] or 0.0) ** 0.5
        if not norm > 0:
            raise ValueError(f"criterion {n} has no positive norm")
        v = F.col(c) * (w[n] / norm)
        near = near + F.pow(v - w[n] * stats[f"hi_{n}"] / norm, F.lit(2.0))
        far = far + F.pow(v - w[n] * stats[f"lo_{n}"] / norm, F.lit(2.0))
    near, far = F.sqrt(near), F.sqrt(far)
    return cells.withColumn(out, far / F.nullif(near + far, F.lit(0.0)))


def aggregated(cells: DataFrame, scores: Mapping[str, str], weights: Mapping[str, float], method: str = "weighted_sum", out: str = "score") -> DataFrame:
    if method == "weighted_sum":
        return cells.withColumn(out, weighted_sum({n: F.col(c) for n, c in scores.items()}, weights))
    if method == "topsis":
        return topsis(cells, scores, weights, out)
    raise ValueError(f"unknown method {method!r}")


def min_max(cells: DataFrame, layer: str, out: str) -> DataFrame:
    """The position between least and greatest; a constant layer gives 0, an empty one stays NULL."""
    s = cells.agg(F.min(layer).alias("lo"), F.max(layer).alias("hi")).first()
    if s["lo"] is None:
        return cells.withColumn(out, F.lit(None).cast("double"))
    if s["lo"] == s["hi"]:
        return cells.withColumn(out, F.when(F.col(layer).isNotNull(), F.lit(0.0)))
    return cells.withColumn(out, (F.col(layer) - s["lo"]) / (s["hi"] - s["lo"]))


def summary(cells: DataFrame, layer: str, high: float = 0.7) -> DataFrame:
    """One row: n_finite, min, max, mean, pct_high of the finite cells, pct_missing of all."""
    x = F.col(layer)
    return cells.agg(F.count(x).alias("n_finite"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), (100.0 * F.count_if(x > high) / F.nullif(F.count(x), F.lit(0))).alias("pct_high"), (100.0 * F.count_if(x.isNull()) / F.nullif(F.count("*"), F.lit(0))).alias("pct_missing"))


def medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median, overall): the median of each group, and of all rows in the row where overall holds. For tables of sites."""
    each = rows.groupBy(by).agg(F.median(value).alias("median")).withColumn("overall", F.lit(False))
    whole = rows.agg(F.median(value).alias("median")).select(F.lit(None).cast(rows.schema[by].dataType).alias(by), "median", F.lit(True).alias("overall"))
    return each.unionByName(whole)


def two_sample(samples: DataFrame) -> DataFrame:
    """(criterion, side 'a' or 'b', value) -> n, mean, sd (n - 1) of each side, delta, abs_delta and Welch's t."""
    side = lambda f, s: f(F.when(F.col("side") == s, F.col("value")))
    rows = samples.groupBy("criterion").agg(*(side(f, s).alias(f"{n}_{s}") for s in ("a", "b") for n, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp))))
    spread = F.sqrt(F.pow("sd_a", F.lit(2.0)) / F.nullif(F.col("n_a"), F.lit(0)) + F.pow("sd_b", F.lit(2.0)) / F.nullif(F.col("n_b"), F.lit(0)))
    rows = rows.withColumn("delta", F.col("mean_a") - F.col("mean_b")).withColumn("abs_delta", F.abs("delta"))
    return rows.withColumn("t", F.col("delta") / F.nullif(F.when((F.col("n_a") > 1) & (F.col("n_b") > 1), spread), F.lit(0.0)))


def stretch(cells: DataFrame, layer: str) -> DataFrame:
    """The 1st and 99th percentiles, exact; 0 and 1 without a finite cell."""
    return cells.agg(F.coalesce(F.percentile(layer, 0.01), F.lit(0.0)).alias("p01"), F.coalesce(F.percentile(layer, 0.99), F.lit(1.0)).alias("p99"))
