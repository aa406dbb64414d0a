"""The criteria by name: the layers each needs and its score as a Column."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import local


@dataclass(frozen=True)
class Criterion:
    inputs: tuple[str, ...]
    score: Callable[..., Column]


CRITERIA: dict[str, Criterion] = {
    "slope": Criterion(("slope",), local.slope_score),
    "illumination": Criterion(("illumination",), local.illumination_score),
    "eva_psr_access": Criterion(("cold_access",), lambda x: x),
    "thermal": Criterion(("temp_avg",), local.thermal_score),
    "multi_volatile": Criterion(("volatiles",), lambda x: x),
    "hazard": Criterion(("crater_density",), local.hazard_score),
    "los_to_earth": Criterion(("visibility",), local.visibility_score),
    "seismic": Criterion(("scarp_km",), local.seismic_score),
}


def register(name: str, inputs: tuple[str, ...], score: Callable[..., Column]) -> None:
    CRITERIA[name] = Criterion(inputs, score)


def scores_for(columns: list[str]) -> Mapping[str, Column]:
    """The scores of those criteria whose layers are present; the others are skipped."""
    return {n: c.score(*(F.col(i) for i in c.inputs)) for n, c in CRITERIA.items() if all(i in columns for i in c.inputs)}
