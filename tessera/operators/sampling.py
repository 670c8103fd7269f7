"""Samples of fixed size and weighted draws, repeatable by their seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import InvalidParametersError
from tessera.functions.linalg import col
from tessera.operators.joins import cut
from tessera.operators.transforms import Shuffler


def free_column(df: DataFrame, wanted: str) -> str:
    """wanted after as many underscores as set it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in ("_" * k + wanted for k in range(1, len(taken) + 2)) if n.lower() not in taken)


def reservoir(df: DataFrame, k: int, id: str, seed: int = 0, check: bool = True) -> DataFrame:
    """k rows, each set of k being equally likely: the first k by hashed id, each task keeping k at most."""
    if check and df.limit(k).count() < k:
        raise InvalidParametersError("k exceeds the number of rows")
    return df.orderBy(Shuffler(seed).key(id), col(id)).limit(k)


def permutation(df: DataFrame, id: str, seed: int = 0) -> DataFrame:
    """df with each row's new place in `pos`."""
    return Shuffler(seed).positions(df, id)


def weighted_draw(df: DataFrame, weight: str | Column, k: int = 1, seed: int = 0) -> DataFrame:
    """k rows without replacement, drawn in proportion to their weight, by exponential keys: no running sum over all
    rows. Rows of zero weight are never drawn."""
    w = col(weight)
    return df.where(w > 0).orderBy(-F.log(1 - F.rand(seed)) / w).limit(k)


def draw_by_prefix(df: DataFrame, weight: str, id: str, at: float) -> DataFrame:
    """The first row, in order of id, whose running share of weight exceeds `at`. Rows are dealt to ranges of id, the ranges'
    sums added up on the driver, and only the range that the draw falls into is summed row by row. Null weights count as zero;
    without weight, or for `at` of one and over, there is no row."""
    order, run, part, end = col(id), free_column(df, "run"), free_column(df, "part"), free_column(df, "end")
    w = F.coalesce(col(weight), F.lit(0)).cast("double")
    ranged = cut(df.where(w > 0).repartitionByRange(order).withColumn(part, F.spark_partition_id()))
    sums = ranged.groupBy(part).agg(F.sum(w).alias("s")).orderBy(part).collect()  # one row a partition
    target, before = at * sum(r["s"] for r in sums), 0.0
    for r in sums:
        if before + r["s"] > target:
            break
        before += r["s"]
    else:
        return df.limit(0)
    here = ranged.where(F.col(part) == r[part])
    running = F.lit(before) + F.sum(w).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    # The range's last row has the range's sum, whatever the rounding of its running sum is.
    last = F.row_number().over(Window.partitionBy(part).orderBy(order.desc())) == 1
    summed = here.withColumns({run: running, end: last})
    return summed.where((F.col(run) > target) | F.col(end)).orderBy(F.col(run) <= target, order).limit(1).drop(run, part, end)
