"""Linear scoring and per-feature contributions as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearModel:
    """A logistic model over imputed and standardised features.

    ``weights`` fixes the feature order; ``medians`` fill missing values,
    ``moments`` are the (mean, deviation) the features are scaled with.
    """

    weights: Mapping[str, float]
    intercept: float
    medians: Mapping[str, float] = field(default_factory=dict)
    moments: Mapping[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return list(self.weights)

    def filled(self, feature: str) -> Column:
        x = F.col(feature).cast("double")
        median = self.medians.get(feature)
        return x if median is None else F.coalesce(x, F.lit(float(median)))

    def z(self, feature: str) -> Column:
        mean, std = self.moments.get(feature, (0.0, 1.0))
        return (self.filled(feature) - F.lit(float(mean))) / F.lit(float(std) or 1.0)

    def logit(self, z: Callable[[str], Column] | None = None) -> Column:
        """``z`` may name where the standardised features already are."""
        total = F.lit(float(self.intercept))
        for feature, weight in self.weights.items():
            total = total + F.lit(float(weight)) * (z or self.z)(feature)
        return total

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.logit()))

    def contribution(self, feature: str, background: Column | None = None, z: Column | None = None) -> Column:
        """``weight * (z - background)``; the default background is the training mean, z = 0."""
        z = self.z(feature) if z is None else z
        away = z if background is None else z - background
        return F.lit(float(self.weights[feature])) * away


def hard_label(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p > threshold, 1).when(p <= threshold, 0)
