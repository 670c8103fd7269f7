"""Densities, distribution functions and samples of the exponential and the normal distribution, as Columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import InvalidParametersError
from tessera.functions.linalg import col


@dataclass(frozen=True)
class Exponential:
    rate: float

    def __post_init__(self):
        if not self.rate > 0:
            raise InvalidParametersError("the rate must be positive")

    mean = property(lambda self: 1 / self.rate)
    variance = property(lambda self: 1 / self.rate**2)

    def pdf(self, x: str | Column) -> Column:
        return F.when(col(x) < 0, 0.0).otherwise(self.rate * F.exp(-self.rate * col(x)))

    def cdf(self, x: str | Column) -> Column:
        return F.when(col(x) < 0, 0.0).otherwise(1 - F.exp(-self.rate * col(x)))

    def sample(self, seed: int = 0) -> Column:
        return -F.log(1 - F.rand(seed)) / self.rate


@dataclass(frozen=True)
class Gaussian:
    mean: float = 0.0
    variance: float = 1.0

    def __post_init__(self):
        if not self.variance > 0:
            raise InvalidParametersError("the variance must be positive")

    def pdf(self, x: str | Column) -> Column:
        d = col(x) - self.mean
        return F.exp(-d * d / (2 * self.variance)) / math.sqrt(2 * math.pi * self.variance)

    def cdf(self, x: str | Column) -> Column:
        """By a rational approximation of the error function, within 1.5e-7."""
        z = (col(x) - self.mean) / math.sqrt(2 * self.variance)
        t = 1 / (1 + 0.3275911 * F.abs(z))
        # Coefficients 7.1.26 of Abramowitz and Stegun.
        tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z)
        return F.when(z >= 0, 1 - tail / 2).otherwise(tail / 2)

    def sample(self, seed: int = 0) -> Column:
        return F.randn(seed) * math.sqrt(self.variance) + self.mean
