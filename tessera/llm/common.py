"""What the operators share: reliable cuts of lineage, row batches for Arrow functions, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder of spark.checkpoint.dir; a folder of our own serves only where that is unset and all
    tasks run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, with its lineage cut; lost executors don't lose it."""
    use_checkpoint_dir(df.sparkSession)
    # The new aliases keep constraints on columns that are gone from reaching a later union, which can't map them.
    out = df.checkpoint()
    return out.select(*(F.col(f"`{c}`").alias(c) for c in out.columns))


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written as a table to the shared folder, and the table's own folder, for discard once all that reads it is cut."""
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes the folder, and has the shuffles of plans that nothing holds any longer deleted as well."""
    gc.collect()
    spark._jvm.System.gc()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of the batch that hold at most most_bytes of the column's text, or one row."""
    if batch.num_rows <= 1 or batch.column(column).nbytes <= most_bytes:
        yield batch
        return
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function for mapInArrow or mapInPandas, that gives back to the system what it has freed: Python workers are
    kept for later tasks, and would hold the most that any earlier one took."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    """Returns freed memory of Arrow and the C library to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with underscores before it until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
