"""Scores, confusion matrices and k-fold validation, over frames that hold predictions beside targets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidDataError, InvalidParametersError
from tessera.functions.linalg import col, total
from tessera.operators.transforms import Shuffler


def _ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def accuracy_expr(prediction: str = "prediction", label: str = "label") -> Column:
    """Share of equal values; null over no rows."""
    return _ratio(F.count_if(col(prediction) == col(label)), F.count("*"))


def row_accuracy_expr(predictions: Sequence[str], labels: Sequence[str]) -> Column:
    """Share of rows equal in every column."""
    same = [col(p) == col(t) for p, t in zip(predictions, labels, strict=True)]
    out = same[0]
    for s in same[1:]:
        out = out & s
    return _ratio(F.count_if(out), F.count("*"))


def _counts(p: str, t: str) -> tuple[Column, Column, Column, Column]:
    p, t = col(p), col(t)
    other = F.count_if(~(p.isin(0, 1) & t.isin(0, 1)))
    return F.count_if((p == 1) & (t == 1)), F.count_if((p == 1) & (t == 0)), F.count_if((p == 0) & (t == 1)), other


def _guarded(value: Column, other: Column) -> Column:
    return F.when(other > 0, F.raise_error(F.lit("labels other than 0 and 1")).cast("double")).otherwise(value)


def precision_expr(prediction: str = "prediction", label: str = "label") -> Column:
    """True positives among predicted ones; null if none is predicted; labels must be 0 or 1."""
    tp, fp, _, other = _counts(prediction, label)
    return _guarded(_ratio(tp, tp + fp), other)


def recall_expr(prediction: str = "prediction", label: str = "label") -> Column:
    tp, _, fn, other = _counts(prediction, label)
    return _guarded(_ratio(tp, tp + fn), other)


def f1_expr(prediction: str = "prediction", label: str = "label") -> Column:
    tp, fp, fn, other = _counts(prediction, label)
    return _guarded(_ratio(2 * tp, 2 * tp + fp + fn), other)


def neg_mean_squared_error_expr(predictions: Sequence[str], labels: Sequence[str]) -> Column:
    """Minus the squared errors of all columns, by the number of rows."""
    return -_ratio(F.sum(total([(col(p) - col(t)) * (col(p) - col(t)) for p, t in zip(predictions, labels, strict=True)])), F.count("*"))


def _first(df: DataFrame, expr: Column) -> float:
    value = df.agg(expr.alias("s")).first()["s"]
    return float("nan") if value is None else value


def accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label") -> float:
    return _first(df, accuracy_expr(prediction, label))


def precision(df: DataFrame, prediction: str = "prediction", label: str = "label") -> float:
    return _first(df, precision_expr(prediction, label))


def recall(df: DataFrame, prediction: str = "prediction", label: str = "label") -> float:
    return _first(df, recall_expr(prediction, label))


def f1(df: DataFrame, prediction: str = "prediction", label: str = "label") -> float:
    return _first(df, f1_expr(prediction, label))


def neg_mean_squared_error(df: DataFrame, prediction: str = "prediction", label: str = "label") -> float:
    return _first(df, neg_mean_squared_error_expr([prediction], [label]))


def confusion_matrix(df: DataFrame, prediction: str = "prediction", label: str = "label", labels: Sequence | None = None, most: int = 1000) -> DataFrame:
    """One row per label (column `truth`, in the order of `labels` or ascending), one column c_<label> per prediction.

    Pairs with a label outside the list are left out. Without a list, the distinct values of both columns are it, `most`
    at most."""
    if labels is None:
        seen = df.select(col(prediction).alias("v")).union(df.select(col(label).alias("v"))).where("v is not null").distinct().orderBy("v").limit(most + 1).collect()
        if len(seen) > most:
            raise InvalidDataError(f"more than {most} labels")
        labels = [r.v for r in seen]
    if len(set(labels)) != len(labels):
        raise InvalidParametersError("labels repeat")
    if not labels:
        raise InvalidDataError("no labels")
    kept = df.where(col(prediction).isin(*labels) & col(label).isin(*labels))
    counts = kept.groupBy(col(label).alias("truth")).agg(*(F.count_if(col(prediction) == F.lit(v)).alias(f"c_{v}") for v in labels))
    order = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(labels)], f"truth {df.schema[label].dataType.simpleString()}, place int")
    filled = order.join(counts, "truth", "left").orderBy("place")
    return filled.select("truth", *(F.coalesce(F.col(f"`c_{v}`"), F.lit(0).cast("long")).alias(f"c_{v}") for v in labels))


def with_folds(df: DataFrame, k: int, id: str = "id", seed: int = 0, name: str = "fold") -> DataFrame:
    """df with each row's fold, 0 to k - 1: the shuffled rows in runs, the first n % k of which have one row more."""
    n = df.count()
    if k <= 1 or n < k:
        raise InvalidParametersError("k must be over 1 and not over the number of rows")
    q, r = divmod(n, k)
    pos = F.col("_pos")
    fold = F.when(pos < r * (q + 1), F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - r * (q + 1)) / q))
    return Shuffler(seed).positions(df, id, "_pos").withColumn(name, fold.cast("int")).drop("_pos")


def k_fold_validate(estimator, df: DataFrame, features: Sequence[str], label: str, k: int, score: Callable[[DataFrame], float], id: str = "id", seed: int = 0) -> list[float]:
    """The score on each fold of a model fitted on the others. score: takes the fold's frame with `prediction` beside
    the label. Estimators with a `fit_folds(df, features, label, fold, k)` fit all folds from sums gathered once."""
    folded = with_folds(df.select(id, *features, label), k, id, seed).cache()
    try:
        models = estimator.fit_folds(folded, features, label, "fold", k) if hasattr(estimator, "fit_folds") else [estimator.fit(folded.where(F.col("fold") != i), features, label) for i in range(k)]
        return [score(m.transform(folded.where(F.col("fold") == i))) for i, m in enumerate(models)]
    finally:
        folded.unpersist()
