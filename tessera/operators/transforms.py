"""Row and column transforms: a fitter makes one aggregate, its transformer is a lazy projection with an inverse."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import InvalidDataError, InvalidParametersError, InvalidStateError
from tessera.functions.linalg import bad, col
from tessera.functions.scalar import norm


class Affine:
    """A fitted transformer that multiplies and adds per column; works on batch and streaming frames."""

    def __init__(self, features: Sequence[str]):
        self.features = tuple(features)

    def _apply(self, df: DataFrame, change) -> DataFrame:
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise InvalidStateError(f"missing columns {missing}")
        return df.withColumns({c: change(i, col(c)) for i, c in enumerate(self.features)})


@dataclass(frozen=True)
class MinMaxFitter:
    """Scales each column linearly so that its smallest value becomes low, its largest high."""

    low: float = 0.0
    high: float = 1.0

    def fit(self, df: DataFrame, features: Sequence[str]) -> MinMaxScaler:
        if not features:
            raise InvalidParametersError("no features")
        aggs = [a.alias(f"{k}{i}") for i, c in enumerate(features) for k, a in (("lo", F.min(col(c).cast("double"))), ("hi", F.max(col(c).cast("double"))), ("bad", F.count_if(bad(c))))]
        row = df.agg(*aggs).first()
        pairs = []
        for i, c in enumerate(features):
            lo, hi = row[f"lo{i}"], row[f"hi{i}"]
            if row[f"bad{i}"] or lo is None:
                raise InvalidDataError(f"{c} has null or non-finite values, or no rows")
            if lo == hi:
                raise InvalidDataError(f"{c} is constant")
            a = (self.high - self.low) / (hi - lo)
            pairs.append((a, self.high - hi * a))
        return MinMaxScaler(features, pairs)


class MinMaxScaler(Affine):
    def __init__(self, features: Sequence[str], pairs: Sequence[tuple[float, float]]):
        super().__init__(features)
        self.pairs = list(pairs)

    def transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, lambda i, x: x * self.pairs[i][0] + self.pairs[i][1])

    def inverse(self, df: DataFrame) -> DataFrame:
        return self._apply(df, lambda i, x: (x - self.pairs[i][1]) / self.pairs[i][0])


@dataclass(frozen=True)
class StandardizerFitter:
    """Shifts and scales each column to the given mean and standard deviation (sample variance)."""

    mean: float = 0.0
    deviation: float = 1.0

    def fit(self, df: DataFrame, features: Sequence[str]) -> Standardizer:
        if not features:
            raise InvalidParametersError("no features")
        aggs = [F.count("*").alias("n")]
        aggs += [a.alias(f"{k}{i}") for i, c in enumerate(features) for k, a in (("m", F.avg(col(c))), ("v", F.var_samp(col(c))), ("bad", F.count_if(bad(c))))]
        row = df.agg(*aggs).first()
        if row["n"] <= 1:
            raise InvalidDataError("at least two rows are needed")
        for i, c in enumerate(features):
            if row[f"bad{i}"]:
                raise InvalidDataError(f"{c} has null or non-finite values")
            if row[f"v{i}"] == 0:
                raise InvalidDataError(f"{c} is constant")
        return Standardizer(features, [row[f"m{i}"] for i in range(len(features))], [row[f"v{i}"] for i in range(len(features))], self.mean, self.deviation)


class Standardizer(Affine):
    def __init__(self, features: Sequence[str], means: Sequence[float], variances: Sequence[float], mean: float = 0.0, deviation: float = 1.0):
        super().__init__(features)
        self.means, self.variances, self.mean, self.deviation = list(means), list(variances), mean, deviation

    def transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, lambda i, x: (x - self.means[i]) * (self.deviation / self.variances[i] ** 0.5) + self.mean)

    def inverse(self, df: DataFrame) -> DataFrame:
        return self._apply(df, lambda i, x: (x - self.mean) * (self.variances[i] ** 0.5 / self.deviation) + self.means[i])


@dataclass(frozen=True)
class Normalizer:
    """Divides each row by its p-norm; rows of norm zero stay. strict: a row with a null or non-finite value raises at run
    time; otherwise its values become null."""

    p: float = 2.0
    strict: bool = True

    def transform(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        size = norm(features, self.p)
        finite = F.coalesce(~F.isnan(size) & (size < float("inf")), F.lit(False))
        if self.strict:
            size = F.when(finite, size).otherwise(F.raise_error(F.lit("a row has a null or non-finite norm")).cast("double"))
        else:
            size = F.when(finite, size)
        return df.withColumns({c: F.when(size == 0, col(c)).otherwise(col(c) / size) for c in features})

    def transform_array(self, df: DataFrame, column: str) -> DataFrame:
        """The same for one packed array column."""
        x = F.transform(col(column), lambda v: v.cast("double"))
        size = F.array_max(F.transform(x, F.abs)) if self.p == float("inf") else F.aggregate(x, F.lit(0.0), lambda s, v: s + (F.abs(v) if self.p == 1 else v * v if self.p == 2 else F.pow(F.abs(v), F.lit(self.p))))
        if self.p not in (1, float("inf")):
            size = F.sqrt(size) if self.p == 2 else F.pow(size, F.lit(1 / self.p))
        held = F.struct(x.alias("x"), size.alias("s"))
        return df.withColumn(column, F.transform(F.array(held), lambda h: F.when(h["s"] == 0, h["x"]).otherwise(F.transform(h["x"], lambda v: v / h["s"])))[0])


@dataclass(frozen=True)
class Shuffler:
    """A permutation of the rows, fixed by the seed: rows sort by the MD5 of their id and the seed."""

    seed: int = 0

    def key(self, id: str) -> Column:
        return F.md5(F.concat(col(id).cast("string"), F.lit(f":{self.seed}")))

    def transform(self, df: DataFrame, id: str) -> DataFrame:
        return df.orderBy(self.key(id), col(id))

    def positions(self, df: DataFrame, id: str, name: str = "pos") -> DataFrame:
        """df with each row's place (from 0). Rows are ranked within ranges of the key and the ranges' sizes added up, so
        no task sorts all rows."""
        part = F.substring(self.key(id), 1, 3)
        keyed = df.withColumn("_part", part).withColumn("_key", self.key(id))
        counts = keyed.groupBy("_part").agg(F.count("*").alias("_n"))  # 4096 rows at most
        before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
        ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_key", col(id))))
        return ranked.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_part", "_key", "_rank", "_before")


def with_intercept(df: DataFrame, name: str = "intercept") -> DataFrame:
    return df.withColumn(name, F.lit(1.0))


def centre(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The columns less their means."""
    means = df.agg(*(F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(features))).first()
    return df.withColumns({c: col(c) - F.lit(means[f"m{i}"]) for i, c in enumerate(features)})


def select_rows(df: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """The rows of df whose id is in ids."""
    return df.join(ids.select(id).distinct(), id, "left_semi")


def one_hot(df: DataFrame, label: str, classes: Sequence, name: str = "target") -> DataFrame:
    return df.withColumn(name, F.array(*(F.when(col(label) == F.lit(c), 1.0).otherwise(0.0) for c in classes)))


def from_one_hot(df: DataFrame, target: str, name: str = "label") -> DataFrame:
    """The place of the first entry equal to one; null if there is none."""
    place = F.array_position(col(target), 1.0)
    return df.withColumn(name, F.when(place > 0, (place - 1).cast("int")))


@dataclass
class Pipeline:
    """Fitters one after the other over the same features."""

    fitters: Sequence
    fitted: list = field(default_factory=list)

    def fit(self, df: DataFrame, features: Sequence[str]) -> Pipeline:
        out = Pipeline(self.fitters)
        for f in self.fitters:
            t = f.fit(df, features)
            df = t.transform(df)
            out.fitted.append(t)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        for t in self.fitted:
            df = t.transform(df)
        return df

    def inverse(self, df: DataFrame) -> DataFrame:
        for t in reversed(self.fitted):
            df = t.inverse(df)
        return df
