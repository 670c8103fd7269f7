"""Gradient optimisers against an oracle of cost and gradient.

An oracle is a callable (w) -> (cost, gradient) for the batch methods, whose every call may be one distributed
aggregate; the row-wise methods take arrays, since their updates are strictly sequential, and run on the driver over a
bounded number of rows or, per partition, with averaging (see nnet)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from tessera.errors import InvalidDataError, InvalidParametersError

Oracle = Callable[[np.ndarray], tuple[float, np.ndarray]]
RowOracle = Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]]
#: Costs closer than this end a run.
NEAR = 1e-20


def _positive(**values: float) -> None:
    for name, v in values.items():
        if not v > 0:
            raise InvalidParametersError(f"{name} must be positive")


def _finite(w: np.ndarray) -> np.ndarray:
    if not np.isfinite(w).all():
        raise InvalidDataError("the iteration diverged; scale the features or lower the rate")
    return w


@dataclass(frozen=True)
class GradientDescent:
    """Full-batch descent; a change of cost within NEAR ends it before the update."""

    rate: float = 0.3
    iterations: int = 100

    def __post_init__(self):
        _positive(rate=self.rate)

    def minimise(self, oracle: Oracle, start: np.ndarray) -> np.ndarray:
        w, last = np.array(start, dtype=float), 0.0
        for _ in range(self.iterations):
            cost, grad = oracle(w)
            if abs(last - cost) < NEAR:
                break
            w = _finite(w - self.rate * grad)
            last = cost
        return w


class RowWise:
    """Methods that visit rows one after another, in a new order each epoch."""

    iterations: int
    seed: int

    def begin(self, w: np.ndarray) -> dict:
        return {}

    def update(self, w: np.ndarray, grad: np.ndarray, state: dict) -> np.ndarray:
        raise NotImplementedError

    def minimise_rows(self, oracle: RowOracle, start: np.ndarray, n: int) -> np.ndarray:
        """oracle(w, row places) -> (cost, gradient)."""
        w, last, rng = np.array(start, dtype=float), 0.0, np.random.default_rng(self.seed)
        state = self.begin(w)
        for _ in range(self.iterations):
            total = 0.0
            for i in rng.permutation(n):
                cost, grad = oracle(w, np.array([i]))
                total += cost
                w = self.update(w, grad, state)
            _finite(w)
            total /= max(1, n)
            if abs(last - total) < NEAR:
                break
            last = total
        return w

    def minimise(self, oracle: Oracle, start: np.ndarray) -> np.ndarray:
        """With one batch in place of rows."""
        return self.minimise_rows(lambda w, _: oracle(w), start, 1)


@dataclass(frozen=True)
class StochasticDescent(RowWise):
    """With Nesterov's momentum."""

    momentum: float = 0.1
    rate: float = 0.1
    iterations: int = 20
    seed: int = 0

    def __post_init__(self):
        _positive(momentum=self.momentum, rate=self.rate)

    def begin(self, w: np.ndarray) -> dict:
        return {"v": np.zeros_like(w)}

    def update(self, w: np.ndarray, grad: np.ndarray, state: dict) -> np.ndarray:
        before = state["v"]
        state["v"] = after = self.momentum * before + self.rate * grad
        return w - ((1 + self.momentum) * after - self.momentum * before)


@dataclass(frozen=True)
class AdaGrad(RowWise):
    rate: float = 1.0
    tau: float = 3.0
    iterations: int = 100
    seed: int = 0

    def __post_init__(self):
        _positive(rate=self.rate)
        if self.tau < 0:
            raise InvalidParametersError("tau must not be negative")

    def begin(self, w: np.ndarray) -> dict:
        return {"s": np.zeros_like(w)}

    def update(self, w: np.ndarray, grad: np.ndarray, state: dict) -> np.ndarray:
        state["s"] = state["s"] + grad**2
        return w - self.rate * grad / np.maximum(self.tau + np.sqrt(state["s"]), 1e-300)


@dataclass(frozen=True)
class RMSProp(RowWise):
    rate: float = 0.01
    decay: float = 0.9
    epsilon: float = 1e-5
    iterations: int = 50
    seed: int = 0

    def __post_init__(self):
        _positive(rate=self.rate, epsilon=self.epsilon)
        if not 0 < self.decay < 1:
            raise InvalidParametersError("decay must lie between 0 and 1")

    def begin(self, w: np.ndarray) -> dict:
        return {"c": np.zeros_like(w)}

    def update(self, w: np.ndarray, grad: np.ndarray, state: dict) -> np.ndarray:
        state["c"] = self.decay * state["c"] + (1 - self.decay) * grad**2
        return w - self.rate * grad / np.sqrt(state["c"] + self.epsilon)


@dataclass(frozen=True)
class ConjugateGradient:
    """Polak-Ribiere directions with a bracketing line search that meets the strong Wolfe conditions.

    rho and sigma: the conditions' constants (sufficient decrease, curvature); interpolate: how close to the ends of a
    bracket a trial may come; extrapolate: how far beyond the last trial one may go; most: trials in a search; ratio: the
    largest growth of the first step."""

    rho: float = 0.01
    sigma: float = 0.5
    interpolate: float = 0.1
    extrapolate: float = 3.0
    most: int = 20
    ratio: float = 100.0
    iterations: int = 100

    def __post_init__(self):
        if not 0 < self.rho < self.sigma < 1:
            raise InvalidParametersError("0 < rho < sigma < 1 must hold")

    def _search(self, oracle: Oracle, w: np.ndarray, f0: float, direction: np.ndarray, slope0: float, step: float):
        """(step, cost, gradient) of a point meeting the conditions, or the best found below f0, or None."""
        low, high, best = (0.0, f0, slope0), None, None
        for _ in range(self.most):
            f, g = oracle(w + step * direction)
            slope = float(g @ direction) if np.all(np.isfinite(g)) else np.nan
            if np.isfinite(f) and np.isfinite(slope):
                if f < f0 and (best is None or f < best[1]):
                    best = (step, f, g)
                if f > f0 + self.rho * step * slope0 or f >= low[1] and low[0] > 0:
                    high = (step, f, slope)
                elif abs(slope) <= -self.sigma * slope0:
                    return step, f, g
                elif slope > 0:
                    high, low = low if low[0] > step else (step, f, slope), low
                else:
                    low = (step, f, slope)
            else:
                high = (step, np.inf, 0.0)
            if high is None:  # still going down: a secant step on the slope, within bounds
                rise = low[2] - slope0
                ahead = low[0] * low[2] / -rise if rise > 0 else np.inf
                step = low[0] + float(np.clip(ahead, 0.1 * low[0], (self.extrapolate - 1) * low[0]))
            else:  # the minimum of the parabola through the bracket's lower end
                width = high[0] - low[0]
                bend = high[1] - low[1] - low[2] * width
                inner = -low[2] * width * width / (2 * bend) if np.isfinite(bend) and bend > 0 else width / 2
                step = low[0] + float(np.clip(inner, self.interpolate * width, (1 - self.interpolate) * width))
        return best

    def minimise(self, oracle: Oracle, start: np.ndarray) -> np.ndarray:
        w = np.array(start, dtype=float)
        f, g = oracle(w)
        direction = -g
        slope = float(g @ direction)
        step, failed = 1 / (1 - slope), False
        for _ in range(self.iterations):
            if slope == 0 or not np.isfinite(slope):
                break
            found = self._search(oracle, w, f, direction, slope, step)
            if found is None:
                if failed:
                    break
                direction, failed = -g, True
                slope = float(g @ direction)
                step = 1 / (1 - slope)
                continue
            failed = False
            taken, f, after = found
            w = w + taken * direction
            turn = max(0.0, float(after @ (after - g)) / max(float(g @ g), 1e-300))
            before, g = slope, after
            direction = turn * direction - g
            slope = float(g @ direction)
            if slope >= 0:
                direction = -g
                slope = float(g @ direction)
            step = taken * min(self.ratio, before / (slope - 1e-300))
        return w
