"""Feed-forward networks.

Training: full-batch methods evaluate cost and gradient as sums over partitions (weights broadcast, one small row back
from each task); row-wise methods run on the driver over at most MOST_ROWS rows, or with `mode="averaged"` on every
partition at once, whose weights are averaged after each epoch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidParametersError
from tessera.functions import scalar
from tessera.functions.linalg import col, linear
from tessera.operators import joins
from tessera.operators.models.base import Model, need_rows
from tessera.operators.optim import RowWise, StochasticDescent

MOST_ROWS = 100_000


@dataclass(frozen=True)
class Dense:
    """Weights of inputs (with a bias in row 0) by outputs, drawn from N(0, 2 / (inputs + outputs))."""

    inputs: int
    outputs: int
    bias: bool = True

    @property
    def shape(self) -> tuple[int, int]:
        return self.inputs + self.bias, self.outputs

    def start(self, rng: np.random.Generator) -> np.ndarray:
        return rng.normal(0, np.sqrt(2 / sum(self.shape)), self.shape).ravel()

    def forward(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        w = w.reshape(self.shape)
        return x @ w[1:] + w[0] if self.bias else x @ w

    def backward(self, up: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gradient by x, by w)."""
        w = w.reshape(self.shape)
        own = x.T @ up
        if self.bias:
            own, w = np.vstack([up.sum(axis=0), own]), w[1:]
        return up @ w.T, own.ravel()


@dataclass(frozen=True)
class Activate:
    function: scalar.Activation
    shape = (0, 0)

    def start(self, rng: np.random.Generator) -> np.ndarray:
        return np.empty(0)

    def forward(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self.function.numpy[0](x)

    def backward(self, up: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return up * self.function.numpy[1](y), np.empty(0)


@dataclass(frozen=True)
class Criterion:
    cost: scalar.Cost
    penalty: scalar.Penalty = scalar.NO_PENALTY


def binary_cross_entropy(penalty: scalar.Penalty = scalar.NO_PENALTY) -> Criterion:
    return Criterion(scalar.CROSS_ENTROPY, penalty)


def mean_squared(penalty: scalar.Penalty = scalar.NO_PENALTY) -> Criterion:
    return Criterion(scalar.MEAN_SQUARED, penalty)


def split(layers: Sequence, w: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for layer in layers:
        n = layer.shape[0] * layer.shape[1]
        out.append(w[at : at + n])
        at += n
    return out


def forward(layers: Sequence, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    for layer, own in zip(layers, split(layers, w), strict=True):
        x = layer.forward(x, own)
    return x


def cost_and_gradient(layers: Sequence, criterion: Criterion, w: np.ndarray, x: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed over the rows, without penalty: (n times the cost, n times the gradient)."""
    weights, kept = split(layers, w), [x]
    for layer, own in zip(layers, weights, strict=True):
        kept.append(layer.forward(kept[-1], own))
    up, grads = criterion.cost.numpy[1](kept[-1], t), []
    for k in range(len(layers) - 1, -1, -1):
        up, g = layers[k].backward(up, kept[k], kept[k + 1], weights[k])
        grads.append(g)
    return criterion.cost.numpy[0](kept[-1], t) * len(x), np.concatenate(grads[::-1]) if grads else np.empty(0)


@dataclass(frozen=True)
class NetworkModel(Model):
    features: tuple[str, ...]
    layers: tuple
    weights: np.ndarray

    def layer_weights(self, k: int) -> np.ndarray:
        """The weights of layer k (activations count), as a matrix."""
        return split(self.layers, self.weights)[k].reshape(self.layers[k].shape)

    def exprs(self) -> list | None:
        """The outputs as Columns, where all layers are dense or activations of small size."""
        out = [col(c) for c in self.features]
        for layer, w in zip(self.layers, split(self.layers, self.weights), strict=True):
            if isinstance(layer, Activate):
                out = [layer.function.func(x) for x in out]
            elif isinstance(layer, Dense) and layer.outputs * len(out) <= 64:
                m = w.reshape(layer.shape)
                first = m[0] if layer.bias else np.zeros(layer.outputs)
                rest = m[1:] if layer.bias else m
                out = [linear_columns(out, rest[:, j], first[j]) for j in range(layer.outputs)]
            else:
                return None
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction: the outputs' array; an expression for small networks of one hidden layer, else Arrow batches."""
        self._check(df)
        if sum(isinstance(x, Dense) for x in self.layers) <= 2 and (out := self.exprs()) is not None:
            return df.withColumn("prediction", F.array(*out))
        layers, w, features = self.layers, self.weights, list(self.features)
        fields = [f for f in df.schema.fields if f.name != "prediction"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in features])
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(list(forward(layers, w, x)), pa.list_(pa.float64()))], names=[*(f.name for f in fields), "prediction"])

        return df.select(*(col(f.name) for f in fields)).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "prediction array<double>"]))


def linear_columns(x: list, weights: np.ndarray, first: float):
    out = F.lit(float(first))
    for c, w in zip(x, weights, strict=True):
        out = out + c * F.lit(float(w))
    return out


@dataclass(frozen=True)
class NeuralNetwork:
    """layers: Dense, Activate or anything with shape, start, forward and backward; `mlp` builds the usual stack."""

    layers: tuple
    criterion: Criterion = field(default_factory=binary_cross_entropy)
    algorithm: object = field(default_factory=StochasticDescent)
    seed: int = 0
    mode: str = "exact"
    warm_start: np.ndarray | None = None

    def __post_init__(self):
        width = None
        for layer in self.layers:
            if isinstance(layer, Dense):
                if width is not None and layer.inputs != width:
                    raise InvalidParametersError(f"a layer of {layer.inputs} inputs follows {width} outputs")
                width = layer.outputs
        if self.mode not in ("exact", "averaged"):
            raise InvalidParametersError("mode must be exact or averaged")

    def fit(self, df: DataFrame, features: Sequence[str], labels: str | Sequence[str]) -> NetworkModel:
        labels = [labels] if isinstance(labels, str) else list(labels)
        dense = [x for x in self.layers if isinstance(x, Dense)]
        if dense and (dense[0].inputs != len(features) or dense[-1].outputs != len(labels)):
            raise InvalidParametersError("the layers don't fit the features and labels")
        rng = np.random.default_rng(self.seed)
        w = self.warm_start if self.warm_start is not None else np.concatenate([x.start(rng) for x in self.layers] or [np.empty(0)])
        if not len(w):
            return NetworkModel(tuple(features), tuple(self.layers), w)
        data = df.select(*(col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), *(col(c).cast("double").alias(f"t{i}") for i, c in enumerate(labels)))
        if isinstance(self.algorithm, RowWise):
            w = self._averaged(data, len(features), w) if self.mode == "averaged" else self._rows(data, len(features), w)
        else:
            w = self._batch(data, len(features), w)
        return NetworkModel(tuple(features), tuple(self.layers), w)

    def _rows(self, data: DataFrame, d: int, w: np.ndarray) -> np.ndarray:
        pdf = joins.collect_matrix(data, data.columns, most=MOST_ROWS).sort_values(list(data.columns), kind="stable").to_numpy(float)
        need_rows(len(pdf))
        return _descend(self.layers, self.criterion, self.algorithm, w, pdf, d)

    def _averaged(self, data: DataFrame, d: int, w: np.ndarray) -> np.ndarray:
        from dataclasses import replace

        once, layers, criterion = replace(self.algorithm, iterations=1), self.layers, self.criterion
        data = data.cache()
        try:
            for epoch in range(self.algorithm.iterations):
                now, algorithm = w, replace(once, seed=self.seed + epoch)

                def run(batches: Iterator[pd.DataFrame], now=now, algorithm=algorithm) -> Iterator[pd.DataFrame]:
                    own, n = now, 0
                    for pdf in batches:
                        own, n = _descend(layers, criterion, algorithm, own, pdf.to_numpy(float), d), n + len(pdf)
                    if n:
                        yield pd.DataFrame({"k": range(len(own)), "s": own * n, "n": [n] * len(own)})

                rows = data.mapInPandas(run, "k int, s double, n long").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("w")).collect()
                need_rows(len(rows))
                w = np.array([r["w"] for r in sorted(rows, key=lambda r: r["k"])])
        finally:
            data.unpersist()
        return w

    def _batch(self, data: DataFrame, d: int, w: np.ndarray) -> np.ndarray:
        layers, criterion = self.layers, self.criterion
        data = data.cache()

        def oracle(now: np.ndarray) -> tuple[float, np.ndarray]:
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                sums = np.zeros(len(now) + 2)
                for pdf in batches:
                    x = pdf.to_numpy(float)
                    cost, grad = cost_and_gradient(layers, criterion, now, x[:, :d], x[:, d:])
                    sums += np.concatenate([[len(x), cost], grad])
                yield pd.DataFrame({"k": range(len(sums)), "s": sums})

            rows = data.mapInPandas(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
            sums = np.array([r["s"] for r in sorted(rows, key=lambda r: r["k"])])
            need_rows(int(sums[0]))
            return sums[1] / sums[0] + criterion.penalty.cost(now), sums[2:] / sums[0] + criterion.penalty.grad(now)

        try:
            return self.algorithm.minimise(oracle, w)
        finally:
            data.unpersist()


def _descend(layers: Sequence, criterion: Criterion, algorithm: RowWise, w: np.ndarray, rows: np.ndarray, d: int) -> np.ndarray:
    def oracle(now: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray]:
        cost, grad = cost_and_gradient(layers, criterion, now, rows[at, :d], rows[at, d:])
        return cost + criterion.penalty.cost(now), grad + criterion.penalty.grad(now)

    return algorithm.minimise_rows(oracle, w, len(rows))


def mlp(sizes: Sequence[int], activation: scalar.Activation = scalar.SIGMOID, **kwargs) -> NeuralNetwork:
    """Dense layers of the sizes, each followed by the activation."""
    if len(sizes) < 2 or min(sizes) < 1:
        raise InvalidParametersError("at least two positive sizes are needed")
    layers = [x for a, b in zip(sizes, sizes[1:], strict=False) for x in (Dense(a, b), Activate(activation))]
    return NeuralNetwork(tuple(layers), **kwargs)


__all__ = ["Activate", "Criterion", "Dense", "NeuralNetwork", "binary_cross_entropy", "linear", "mean_squared", "mlp"]
