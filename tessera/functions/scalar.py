"""Scalar functions: activations, link functions, costs, penalties, distances and densities.

Each works on Columns, staying inside code generation; activations and costs also have numpy forms for driver-side and
Arrow code."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import InvalidParametersError
from tessera.functions.linalg import col, total


@dataclass(frozen=True)
class Activation:
    """f, its derivative at x, its derivative given y = f(x), and its inverse; over Columns, or arrays by `numpy`."""

    name: str
    func: Callable
    grad: Callable
    grad_from_output: Callable
    inverse: Callable
    numpy: tuple[Callable, Callable]


def _tanh_inverse(y: Column) -> Column:
    return F.lit(0.5) * F.log((1 + y) / (1 - y))


SIGMOID = Activation(
    "sigmoid",
    lambda x: 1 / (1 + F.exp(-x)),
    lambda x: (1 / (1 + F.exp(-x))) * (1 - 1 / (1 + F.exp(-x))),
    lambda y: y * (1 - y),
    lambda y: F.log(y / (1 - y)),
    (lambda x: 1 / (1 + np.exp(-np.clip(x, -700, 700))), lambda y: y * (1 - y)),
)
LINEAR = Activation("linear", lambda x: x, lambda x: x * 0 + 1, lambda y: y * 0 + 1, lambda y: y, (lambda x: x, np.ones_like))
EXP = Activation("exp", F.exp, F.exp, lambda y: y, F.log, (np.exp, lambda y: y))
TANH = Activation("tanh", F.tanh, lambda x: 1 - F.tanh(x) * F.tanh(x), lambda y: 1 - y * y, _tanh_inverse, (np.tanh, lambda y: 1 - y * y))
ACTIVATIONS = {a.name: a for a in (SIGMOID, LINEAR, EXP, TANH)}


@dataclass(frozen=True)
class Link:
    """A link function of a generalised linear model: g, its derivative, its inverse."""

    name: str
    func: Callable[[Column], Column]
    grad: Callable[[Column], Column]
    inverse: Callable[[Column], Column]


LOGIT = Link("logit", lambda m: F.log(m / (1 - m)), lambda m: 1 / (m * (1 - m)), lambda x: 1 / (1 + F.exp(-x)))
LOG = Link("log", F.log, lambda m: 1 / m, F.exp)
IDENTITY = Link("identity", lambda m: m, lambda m: m * 0 + 1, lambda x: x)
LINKS = {k.name: k for k in (LOGIT, LOG, IDENTITY)}


@dataclass(frozen=True)
class Cost:
    """An aggregate cost over (output, target) columns, its gradient by the output, and both over arrays."""

    name: str
    aggregate: Callable[[Sequence[Column], Sequence[Column]], Column]
    grad: Callable[[Column, Column], Column]
    numpy: tuple[Callable, Callable]


def _entropy(o, t):
    return t * F.log(o) + (1 - t) * F.log(1 - o)


def _entropy_numpy(o: np.ndarray, t: np.ndarray) -> float:
    o = np.clip(o, 1e-15, 1 - 1e-15)
    return float(-(t * np.log(o) + (1 - t) * np.log(1 - o)).sum() / len(o))


MEAN_SQUARED = Cost(
    "mean_squared",
    lambda o, t: F.sum(total([(a - b) * (a - b) for a, b in zip(o, t, strict=True)])) / (2 * F.count("*")),
    lambda o, t: o - t,
    (lambda o, t: float(((o - t) ** 2).sum() / (2 * len(o))), lambda o, t: o - t),
)
CROSS_ENTROPY = Cost(
    "cross_entropy",
    lambda o, t: -F.sum(total([_entropy(a, b) for a, b in zip(o, t, strict=True)])) / F.count("*"),
    lambda o, t: (o - t) / (o * (1 - o)),
    (_entropy_numpy, lambda o, t: (o - t) / np.clip(o * (1 - o), 1e-15, None)),
)


@dataclass(frozen=True)
class Penalty:
    """Regularisation of a weight matrix of m rows: l1 |w|_1 / 2m + l2 |w|_2 / 2m, with the gradients
    l1 sign(w) / 2m + l2 w / m (the sign of a zero is its sign bit's)."""

    l1: float = 0.0
    l2: float = 0.0

    def cost(self, w: np.ndarray) -> float:
        m = len(w)
        return float(self.l1 * np.abs(w).sum() / (2 * m) + self.l2 * np.sqrt((w**2).sum()) / (2 * m))

    def grad(self, w: np.ndarray) -> np.ndarray:
        m = len(w)
        out = np.zeros_like(w, dtype=float)
        if self.l1:
            out += np.copysign(self.l1 / (2 * m), w)
        if self.l2:
            out += self.l2 * w / m
        return out


def l1(x: float) -> Penalty:
    return Penalty(l1=x)


def l2(x: float) -> Penalty:
    return Penalty(l2=x)


def elastic_net(x: float, y: float) -> Penalty:
    return Penalty(x, y)


NO_PENALTY = Penalty()


def squared_distance(x: Sequence, y: Sequence) -> Column:
    """The squared Euclidean distance of two lists of columns or numbers."""
    as_col = lambda v: F.lit(float(v)) if isinstance(v, (int, float)) else col(v)
    return total([(as_col(a) - as_col(b)) * (as_col(a) - as_col(b)) for a, b in zip(x, y, strict=True)])


def distance(x: Sequence, y: Sequence) -> Column:
    return F.sqrt(squared_distance(x, y))


def array_squared_distance(x: Column, y: Column) -> Column:
    """Of two array columns, added from the left in doubles."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def box_distance(x: Sequence, low: Sequence[float], high: Sequence[float]) -> Column:
    """From a point to an axis-parallel box; 0 inside."""
    out = [F.greatest(F.lit(float(a)) - col(c), F.lit(0.0), col(c) - F.lit(float(b))) for c, a, b in zip(x, low, high, strict=True)]
    return F.sqrt(total([d * d for d in out]))


def ball_distance(x: Sequence, centre: Sequence[float], radius: float) -> Column:
    """From a point to a ball; 0 inside."""
    return F.greatest(distance(x, centre) - F.lit(float(radius)), F.lit(0.0))


def norm(features: Sequence, p: float = 2.0) -> Column:
    """The p-norm of a row; p = inf: the largest absolute value."""
    x = [F.abs(col(c).cast("double")) for c in features]
    if p == math.inf:
        return F.greatest(*x) if len(x) > 1 else x[0]
    if p == 1:
        return total(x)
    if p == 2:
        return F.sqrt(total([v * v for v in x]))
    if p <= 0:
        raise InvalidParametersError("p must be positive")
    return F.pow(total([F.pow(v, F.lit(float(p))) for v in x]), F.lit(1 / p))


def gaussian_log_density(x, mean: float, variance: float) -> Column:
    d = col(x) - F.lit(float(mean))
    return F.lit(-0.5 * math.log(2 * math.pi * variance)) - d * d / F.lit(2 * float(variance))


def bernoulli_log_likelihood(x: Sequence, log_p: Sequence[float]) -> Column:
    """Of features in [0, 1] given the logarithms of the rates of 1."""
    parts = [col(c) * F.lit(lp - math.log1p(-math.exp(lp))) + F.lit(math.log1p(-math.exp(lp))) for c, lp in zip(x, log_p, strict=True)]
    return total(parts)


def multinomial_log_likelihood(x: Sequence, log_p: Sequence[float]) -> Column:
    return total([col(c) * F.lit(float(lp)) for c, lp in zip(x, log_p, strict=True)])


def quadratic_form(x: Sequence, mean: Sequence[float], precision: np.ndarray) -> Column:
    """(x - mean)' precision (x - mean)."""
    d = [col(c) - F.lit(float(m)) for c, m in zip(x, mean, strict=True)]
    n = len(d)
    return total([d[i] * d[j] * F.lit(float(precision[i, j] * (1 if i == j else 2))) for i in range(n) for j in range(i, n) if precision[i, j] or i == j])
