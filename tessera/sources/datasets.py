"""Sources and sinks: literal rows, files, small known data sets and synthetic generators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import InvalidParametersError


@dataclass(frozen=True)
class Dataset:
    """A frame with a row id, feature columns and a target column."""

    frame: DataFrame
    features: tuple[str, ...]
    label: str
    id: str = "id"

    def data(self) -> DataFrame:
        return self.frame.select(self.id, *self.features)

    def target(self) -> DataFrame:
        return self.frame.select(self.id, self.label)


def from_rows(spark: SparkSession, rows: Iterable[Sequence[float]], names: Sequence[str], id: str = "id") -> DataFrame:
    """Literal rows as double columns, with their positions as ids."""
    data = [(i, *map(float, r)) for i, r in enumerate(rows)]
    if any(len(r) != len(names) + 1 for r in data):
        raise InvalidParametersError("rows differ in length from names")
    return spark.createDataFrame(data, ", ".join([f"{id} long", *(f"`{c}` double" for c in names)]))


#: 31 felled cherry trees, (diameter, height, volume).
TREES = """
8.3 70 10.3, 8.6 65 10.3, 8.8 63 10.2, 10.5 72 16.4, 10.7 81 18.8, 10.8 83 19.7, 11.0 66 15.6, 11.0 75 18.2,
11.1 80 22.6, 11.2 75 19.9, 11.3 79 24.2, 11.4 76 21.0, 11.4 76 21.4, 11.7 69 21.3, 12.0 75 19.1, 12.9 74 22.2,
12.9 85 33.8, 13.3 86 27.4, 13.7 71 25.7, 13.8 64 24.9, 14.0 78 34.5, 14.2 80 31.7, 14.5 74 36.3, 16.0 72 38.3,
16.3 77 42.6, 17.3 81 55.4, 17.5 82 55.7, 17.9 80 58.3, 18.0 80 51.5, 18.0 80 51.0, 20.6 87 77.0
"""


def trees(spark: SparkSession) -> Dataset:
    rows = [tuple(map(float, r.split())) for r in TREES.split(",")]
    return Dataset(from_rows(spark, rows, ("diameter", "height", "volume")), ("diameter", "height"), "volume")


IRIS_FEATURES = ("sepal_length", "sepal_width", "petal_length", "petal_width")


def iris(spark: SparkSession, path: str, species: Sequence[str] = ("setosa", "versicolor", "virginica")) -> Dataset:
    """Iris from a CSV file of four measures and a species on each line, without a header; the target is the place in
    species that the name ends with. The table is a parameter, since it is not bundled."""
    lines = spark.read.schema(", ".join([*(f"{c} double" for c in IRIS_FEATURES), "species string"])).csv(path)
    target = F.coalesce(*(F.when(F.lower("species").endswith(s), F.lit(i)) for i, s in enumerate(species)))
    rows = lines.where("species is not null").withColumn("target", target).select(*IRIS_FEATURES, "target").collect()  # 150 rows
    schema = ", ".join(["id long", *(f"{c} double" for c in IRIS_FEATURES), "target int"])
    return Dataset(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema), IRIS_FEATURES, "target")


def clusters(spark: SparkSession, centres: Sequence[Sequence[float]], each: int, noise: float, seed: int = 0) -> Dataset:
    """`each` points around each centre with Gaussian noise; the target is the centre's place."""
    n = len(centres)
    place = (F.col("id") % n).cast("int")
    coordinates = [F.element_at(F.lit([float(c[k]) for c in centres]), place + 1) + F.randn(seed + k) * noise for k in range(len(centres[0]))]
    names = tuple(f"x{k}" for k in range(len(centres[0])))
    return Dataset(spark.range(n * each).select("id", *(c.alias(x) for c, x in zip(coordinates, names, strict=True)), place.alias("target")), names, "target")


def and_gate(spark: SparkSession, n: int, threshold: float = 0.7, seed: int = 0) -> Dataset:
    """Two uniform inputs; the target is 1 if both exceed the threshold."""
    frame = spark.range(n).select("id", F.rand(seed).alias("x0"), F.rand(seed + 1).alias("x1"))
    return Dataset(frame.withColumn("target", F.when((F.col("x0") > threshold) & (F.col("x1") > threshold), 1.0).otherwise(0.0)), ("x0", "x1"), "target")


def two_breeds(spark: SparkSession, n: int, seed: int = 0) -> Dataset:
    """Two classes at random, three unit-variance measures with means (0, 0, 0) and (1, 1, -1)."""
    frame = spark.range(n).withColumn("target", (F.rand(seed) < 0.5).cast("int"))
    shift = [1.0, 1.0, -1.0]
    names = ("friendliness", "furriness", "speed")
    return Dataset(frame.select("id", *((F.col("target") * s + F.randn(seed + 1 + k)).alias(c) for k, (s, c) in enumerate(zip(shift, names, strict=True))), "target"), names, "target")


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), **options) -> None:
    df.write.format(format).mode(mode).options(**options).partitionBy(*partition_by).save(path)
