"""Kernel support vector machines and Gaussian processes. A machine holds the rows that its iterations draw, whatever the
table's size. A process holds all its training rows, so its fit is bounded: an error, not a sample, beyond MOST_ROWS.
Scoring is one pass that sends the support to every task."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import InvalidDataError, InvalidParametersError
from tessera.functions import kernels
from tessera.functions.linalg import cholesky, col
from tessera.operators import joins
from tessera.operators.models.base import Model, need_rows

MOST_ROWS = 10_000


@dataclass(frozen=True)
class SVMModel(Model):
    features: tuple[str, ...]
    kernel: kernels.Kernel
    support: np.ndarray
    alpha: np.ndarray
    targets: np.ndarray
    penalty: float

    def decision(self, df: DataFrame, name: str = "decision") -> DataFrame:
        self._check(df)
        return joins.kernel_sums(df, self.features, self.kernel, self.support, self.alpha * self.targets / self.penalty, name, intercept=True)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction: the decision's sign, 1 for zero."""
        return self.decision(df, "_d").withColumn("prediction", F.when(F.isnan("_d"), None).when(F.col("_d") >= 0, 1.0).otherwise(-1.0)).drop("_d")


def row_sums(df: DataFrame, features: Sequence[str], kernel: kernels.Kernel, id: str = "id", intercept: bool = True) -> DataFrame:
    """(id, s): the sum of the kernel of each row with all rows. Equal rows are taken as one, and rows are dealt to block pairs, of
    which a task holds a few at once, so there is no limit to them."""
    rows = df.select(col(id), joins.as_array(df, features).alias("_x")).groupBy(f"`{id}`", "_x").agg(F.count("*").alias("_n"))
    rows = joins.cut(rows.withColumn("_key", F.xxhash64("_x")))
    points = joins.cut(rows.groupBy("_key", "_x").agg(F.sum("_n").alias("_n")))
    blocks = max(1, -(-points.count() // joins.BLOCK))
    own, every = F.pmod(F.xxhash64("_key"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sides = points.select("_key", "_x", "_n", F.lit(True).alias("asks"), own.alias("qb"), every.alias("pb")).unionByName(points.select("_key", "_x", "_n", F.lit(False).alias("asks"), every.alias("qb"), own.alias("pb")))

    def group(table: pa.Table) -> pa.Table:
        asks, keys, n = (table[c].to_numpy() for c in ("asks", "_key", "_n"))
        x = table["_x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
        x = np.hstack([np.ones((len(x), 1)), x]) if intercept else x
        a, b, weights = x[asks], x[~asks], n[~asks].astype(float)
        sums = np.zeros(len(a))
        for at in range(0, len(a), 256):
            for to in range(0, len(b), 1024):
                sums[at : at + 256] += kernel.matrix(a[at : at + 256], b[to : to + 1024]) @ weights[to : to + 1024]
        return pa.table({"_key": pa.array(keys[asks], pa.int64()), "s": pa.array(sums, pa.float64())})

    # A number of partitions of its own, since adaptive execution would join small ones whose pairs are many.
    sums = sides.repartition(min(2000, blocks * blocks), "qb", "pb").groupBy("qb", "pb").applyInArrow(group, "_key long, s double").groupBy("_key").agg(F.sum("s").alias("s"))
    return rows.join(sums, "_key").select(F.col(f"`{id}`"), "s", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select(F.col(f"`{id}`"), "s")


def rows_at(df: DataFrame, columns: Sequence[str], id: str, places: Sequence[int]) -> np.ndarray:
    """The rows at the distinct places, counted from 0 in order of id, as doubles in that order; equal ids are in order of
    their values. Rows are dealt to ranges of id and only those asked for reach the driver."""
    order = [f"_c{i}" for i in range(len(columns) + 1)]
    named = df.select(col(id).alias("_c0"), *(col(c).cast("double").alias(n) for c, n in zip(columns, order[1:], strict=True)))
    ranged = joins.cut(named.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").count().orderBy("_part").collect()
    ends, wanted = np.cumsum([r["count"] for r in sizes]), np.array(sorted(set(places)))
    own = np.searchsorted(ends, wanted, side="right")
    here = {r["_part"]: wanted[own == i] - (ends[i] - r["count"]) for i, r in enumerate(sizes)}
    here = {k: list(map(int, v)) for k, v in here.items() if len(v)}
    if not here:
        return np.empty((0, len(columns)))
    asked = df.sparkSession.createDataFrame([(k, i + 1) for k, v in here.items() for i in v], "_part int, _rank int")
    ranks = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    found = ranged.where(F.col("_part").isin(list(here))).withColumn("_rank", ranks).join(F.broadcast(asked), ["_part", "_rank"]).select("_part", "_rank", *order[1:]).toPandas()
    return found.sort_values(["_part", "_rank"])[order[1:]].to_numpy(float)


def _sums_with_all(df: DataFrame, features: Sequence[str], kernel: kernels.Kernel, x: np.ndarray) -> np.ndarray:
    """The sum of the kernel of each row of x, which begins with a one, with all rows of df: one pass."""
    if x.nbytes > joins.BROADCAST_BYTES:
        raise InvalidDataError("the drawn rows are too large to send to every task")
    sent = df.sparkSession.sparkContext.broadcast(x)

    def run(batches):
        sums = np.zeros(len(sent.value))
        for pdf in batches:
            rows = np.hstack([np.ones((len(pdf), 1)), pdf.to_numpy(float)])
            for at in range(0, len(rows), 1024):
                for part in range(0, len(sums), 1024):
                    sums[part : part + 1024] += kernel.matrix(sent.value[part : part + 1024], rows[at : at + 1024]).sum(axis=1)
        yield pd.DataFrame({"i": np.arange(len(sums)), "s": sums})

    found = df.select(*(col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features))).mapInPandas(run, "i long, s double")
    return found.groupBy("i").agg(F.sum("s").alias("s")).toPandas().sort_values("i")["s"].to_numpy(float)


@dataclass(frozen=True)
class SVM:
    """Targets are -1 and 1. variant "pegasos": the kernelised stochastic subgradient method. "rowsum": a row's
    coefficient rises when y_i s_i / (penalty t) < 1, with s_i the sum of the kernel over all rows; t starts at 0, where the
    quotient is infinite with the sign of s_i y_i. The draws don't depend on the fit: only their rows are fetched, by their
    places in order of id, and no others have coefficients."""

    kernel: kernels.Kernel = field(default_factory=kernels.squared_exponential)
    penalty: float = 0.3
    iterations: int = 100
    variant: str = "pegasos"
    seed: int = 0

    def fit(self, df: DataFrame, features: Sequence[str], label: str, id: str = "id") -> SVMModel:
        if not self.penalty > 0 or self.variant not in ("pegasos", "rowsum"):
            raise InvalidParametersError("the penalty must be positive, the variant pegasos or rowsum")
        n, wrong = df.agg(F.count("*"), F.count_if(F.coalesce(~col(label).cast("double").isin(-1.0, 1.0), F.lit(True)))).first()
        need_rows(n)
        if wrong:
            raise InvalidDataError("targets must be -1 or 1")
        rng = np.random.default_rng(self.seed)
        drawn = [int(rng.integers(n)) for _ in range(self.iterations)]
        rows = rows_at(df, [*features, label], id, drawn)
        x, y = np.hstack([np.ones((len(rows), 1)), rows[:, :-1]]), rows[:, -1]
        alpha, places = np.zeros(len(rows)), np.searchsorted(sorted(set(drawn)), drawn)
        if self.variant == "rowsum":
            s = _sums_with_all(df, features, self.kernel, x)
            for t, i in enumerate(places):
                margin = s[i] * y[i]
                if margin / (self.penalty * t) < 1 if t else margin < 0:
                    alpha[i] += 1
        else:
            for t, i in enumerate(places, 1):
                if y[i] * float(self.kernel.matrix(x[i : i + 1], x)[0] @ (alpha * y)) / (self.penalty * t) < 1:
                    alpha[i] += 1
        return SVMModel(tuple(features), self.kernel, x, alpha / self.iterations, y, self.penalty)


@dataclass(frozen=True)
class GaussianProcessModel(Model):
    features: tuple[str, ...]
    kernel: kernels.Kernel
    mean: Callable[[np.ndarray], np.ndarray]
    points: np.ndarray
    factor: np.ndarray
    alpha: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction: the posterior mean."""
        self._check(df)
        constant = float(self.mean(np.zeros((1, len(self.features))))[0])
        return joins.kernel_sums(df, self.features, self.kernel, self.points, self.alpha, "prediction").withColumn("prediction", F.col("prediction") + constant)

    def posterior(self, df: DataFrame, id: str = "id", most: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """(means, covariance matrix) of the rows of df in order of id, `most` at most."""
        x = joins.collect_matrix(df, self.features, id, most, "rows of a joint posterior")[list(self.features)].to_numpy(float)
        cross = self.kernel.matrix(x, self.points)
        v = np.linalg.solve(self.factor, cross.T)
        return self.mean(x) + cross @ self.alpha, self.kernel.matrix(x, x) - v.T @ v

    def variances(self, df: DataFrame, name: str = "variance") -> DataFrame:
        """df with each row's own posterior variance, in one pass."""
        inverse = np.linalg.solve(self.factor.T, np.linalg.solve(self.factor, np.eye(len(self.points))))
        kernel, points, columns = self.kernel, self.points, list(self.features)
        sent = df.sparkSession.sparkContext.broadcast((points, inverse))
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != name), f"`{name}` double"])

        def run(batches):
            for pdf in batches:
                x = pdf[columns].to_numpy(float)
                cross = kernel.matrix(x, sent.value[0])
                own = np.array([kernel.matrix(r[None], r[None])[0, 0] for r in x])
                yield pdf.drop(columns=[name], errors="ignore").assign(**{name: own - ((cross @ sent.value[1]) * cross).sum(axis=1)})

        return df.mapInPandas(run, schema)


@dataclass(frozen=True)
class ConstantMean:
    value: float = 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


@dataclass(frozen=True)
class GaussianProcess:
    """Regression with a prior mean and noise variance on the diagonal."""

    kernel: kernels.Kernel = field(default_factory=kernels.squared_exponential)
    mean: Callable = field(default_factory=ConstantMean)
    noise: float = 0.0

    def fit(self, df: DataFrame, features: Sequence[str], label: str, id: str = "id") -> GaussianProcessModel:
        pdf = joins.collect_matrix(df.select(id, *features, label), [*features, label], id, MOST_ROWS)
        need_rows(len(pdf))
        x, y = pdf[list(features)].to_numpy(float), pdf[label].to_numpy(float)
        factor = cholesky(self.kernel.matrix(x, x) + self.noise * np.eye(len(x)))
        alpha = np.linalg.solve(factor.T, np.linalg.solve(factor, y - self.mean(x)))
        return GaussianProcessModel(tuple(features), self.kernel, self.mean, x, factor, alpha)


__all__ = ["SVM", "ConstantMean", "GaussianProcess", "col", "row_sums"]
