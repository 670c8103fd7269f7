"""Kernels over rows, as Column expressions and over numpy matrices, with sums and products of kernels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.linalg import col, total
from tessera.functions.scalar import squared_distance


@dataclass(frozen=True)
class Kernel:
    """from_parts(dot, squared distance, module): module is `pyspark.sql.functions` or numpy."""

    name: str
    from_parts: Callable

    def expr(self, x: Sequence, y: Sequence) -> Column:
        dot = total([(col(a) if not isinstance(a, float) else F.lit(a)) * (col(b) if not isinstance(b, float) else F.lit(b)) for a, b in zip(x, y, strict=True)])
        return self.from_parts(dot, squared_distance(x, y), F)

    def matrix(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of all rows of x with all rows of y; distances come from differences, not from the cancelling expanded form."""
        d2 = np.zeros((len(x), len(y)))
        for k in range(x.shape[1]):
            d2 += (x[:, k][:, None] - y[:, k][None, :]) ** 2
        return np.asarray(self.from_parts(x @ y.T, d2, np), dtype=float)

    def __add__(self, other: Kernel) -> Kernel:
        return Kernel(f"({self.name} + {other.name})", lambda d, s, m: self.from_parts(d, s, m) + other.from_parts(d, s, m))

    def __mul__(self, other: Kernel) -> Kernel:
        return Kernel(f"({self.name} * {other.name})", lambda d, s, m: self.from_parts(d, s, m) * other.from_parts(d, s, m))


def _power(x, p: float, m):
    if float(p).is_integer() and 0 <= p <= 8:
        out = x * 0 + 1
        for _ in range(int(p)):
            out = out * x
        return out
    return m.power(x, p) if m is np else F.pow(x, F.lit(p))


def linear(c: float = 0.0) -> Kernel:
    return Kernel("linear", lambda d, s, m: d + c)


def polynomial(alpha: float = 1.0, c: float = 0.0, degree: float = 1.0) -> Kernel:
    return Kernel("polynomial", lambda d, s, m: _power(alpha * d + c, degree, m))


def squared_exponential(length: float = 1.0, amplitude: float = 1.0) -> Kernel:
    return Kernel("squared_exponential", lambda d, s, m: amplitude * m.exp(-s / (2 * length * length)))


def exponential(length: float = 1.0, amplitude: float = 1.0) -> Kernel:
    """The distance is divided by twice the squared length."""
    return Kernel("exponential", lambda d, s, m: amplitude * m.exp(-m.sqrt(s) / (2 * length * length)))


def hyperbolic_tangent(alpha: float = 1.0, c: float = 0.0) -> Kernel:
    return Kernel("hyperbolic_tangent", lambda d, s, m: m.tanh(alpha * d + c))


def multiquadric(c: float = 0.0) -> Kernel:
    return Kernel("multiquadric", lambda d, s, m: m.sqrt(s + c * c))


def rational_quadratic(alpha: float = 1.0, length: float = 1.0) -> Kernel:
    return Kernel("rational_quadratic", lambda d, s, m: (m.power if m is np else F.pow)(1 + s / (2 * alpha * length * length), -alpha if m is np else F.lit(-alpha)))
