"""Scoring and evaluation of unbounded inputs with Structured Streaming.

Fitted models whose scoring is a projection work on streaming frames as they are; what is here counts scores by event
time windows and keeps the counts in a table that every trigger replaces whole (its size is the number of windows)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.joins import shared_folder


def read_files(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A stream of the Parquet files that match path; the schema is read from them if it isn't given."""
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(f"{path}*")


def windowed_scores(events: DataFrame, transform: Callable[[DataFrame], DataFrame], time: str, window: str, positive: Column, delay: str | None = None) -> DataFrame:
    """(window_start, n, n_positive) of scored events; delay: a watermark, after which late events are dropped."""
    timed = events.withColumn("_time", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("_time", delay) if delay else timed
    grouped = transform(timed).groupBy(F.window("_time", window).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.count_if(positive).alias("n_positive")).select(F.col("w.start").alias("window_start"), "n", "n_positive")


def windowed_accuracy(events: DataFrame, time: str, window: str, prediction: str = "prediction", label: str = "label") -> DataFrame:
    timed = events.groupBy(F.window(F.col(time).cast("timestamp"), window).alias("w"))
    return timed.agg(F.count("*").alias("n"), F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy")).select(F.col("w.start").alias("window_start"), "n", "accuracy")


def run_available(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs an aggregated stream over all that is available now; returns its last table, kept in a shared folder."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table")

    query = stream.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{folder}/log").foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def refit(stream: DataFrame, fit: Callable[[DataFrame], None], folder: str | None = None):
    """Calls fit on each micro-batch that holds rows; returns the running query."""
    folder = folder or f"{shared_folder(stream.sparkSession)}/refit-{uuid.uuid4().hex}"

    def run(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            fit(batch)

    return stream.writeStream.option("checkpointLocation", folder).foreachBatch(run).trigger(availableNow=True).start()
