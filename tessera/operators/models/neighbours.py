"""k nearest neighbours: an exact join, then a vote."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidDataError, InvalidParametersError
from tessera.functions.linalg import col
from tessera.operators import joins
from tessera.operators.models.base import Model


@dataclass(frozen=True)
class KNNModel(Model):
    features: tuple[str, ...]
    points: DataFrame
    label: str
    id: str
    k: int
    algorithm: str

    def neighbours(self, df: DataFrame, query_id: str = "id", not_self: bool = False) -> DataFrame:
        """(qid, id, distance, rank) of each query's k nearest."""
        queries = df.select(col(query_id).alias("qid"), *self.features)
        return joins.knn_join(queries, self.points, self.features, self.k, "qid", self.id, not_self, self.algorithm)

    def transform(self, df: DataFrame, query_id: str = "id", not_self: bool = False) -> DataFrame:
        """Adds prediction: the most frequent label of the neighbours, the smallest of equals."""
        self._check(df)
        near = self.neighbours(df, query_id, not_self).join(self.points.select(self.id, F.col(self.label).alias("_label")), self.id)
        votes = near.groupBy("qid", "_label").agg(F.count("*").alias("_n"))
        best = votes.groupBy("qid").agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_label").alias("label")))["label"].alias("prediction"))
        return df.join(best.withColumnRenamed("qid", query_id), query_id, "left")


@dataclass(frozen=True)
class KNNClassifier:
    """algorithm: see knn_join; all give the same neighbours."""

    k: int = 5
    algorithm: str = "blocked"

    def fit(self, df: DataFrame, features: Sequence[str], label: str, id: str = "id") -> KNNModel:
        if self.k < 1:
            raise InvalidParametersError("k must be at least 1")
        if df.limit(self.k).count() < self.k:
            raise InvalidDataError("k exceeds the number of rows")
        return KNNModel(tuple(features), df.select(id, *features, label), label, id, self.k, self.algorithm)
