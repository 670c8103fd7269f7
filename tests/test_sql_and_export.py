import json

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.functions.sql import FUNCTIONS, register
from tessera.operators.models.clustering import KMeans
from tessera.operators.models.naive_bayes import NaiveBayes
from tessera.operators.models.regression import LinearRegression
from tessera.sources import datasets
from tessera.streaming import scoring


def test_sql_functions_match_kernels(spark):
    assert len(register(spark)) == len(FUNCTIONS)
    x, y = np.array([[0.2, 0.5]]), np.array([[1.0, -0.3]])
    args = "array(0.2D, 0.5D), array(1D, -0.3D)"
    got = spark.sql(f"SELECT ts_kernel_squared_exponential({args}, 0.7D, 2D), ts_kernel_polynomial({args}, 0.5D, 1D, 3D), ts_kernel_rational_quadratic({args}, 1.5D, 0.8D), ts_logit(ts_sigmoid(0.3D)), ts_step_sign(-0D), ts_logit(1D)").first()
    want = [k.matrix(x, y)[0, 0] for k in (kernels.squared_exponential(0.7, 2), kernels.polynomial(0.5, 1, 3), kernels.rational_quadratic(1.5, 0.8))]
    assert np.allclose(got[:3], want) and abs(got[3] - 0.3) < 1e-12 and got[4] == 1.0 and got[5] is None


def test_models_export_their_values(spark):
    d = datasets.trees(spark)
    row = LinearRegression().fit(d.frame, d.features, d.label).to_frame(spark).first()
    assert row.kind == "LinearModel" and len(json.loads(row.parameters)["parameters"]) == 3
    assert len(json.loads(KMeans(2).fit(d.frame, d.features).parameters_json())["centroids"]) == 2
    labelled = d.frame.withColumn("y", (F.col("volume") > 25).cast("int"))
    assert set(json.loads(NaiveBayes().fit(labelled, d.features, "y").parameters_json())["parameters"]) == {"mean", "variance"}


def test_sources_and_sinks(spark, tmp_path):
    d = datasets.trees(spark)
    assert d.data().columns == ["id", "diameter", "height"] and d.target().count() == 31
    for kind in ("parquet", "json", "orc"):
        datasets.write(d.frame, str(tmp_path / kind), kind)
        assert datasets.read(spark, str(tmp_path / kind), kind).agg(F.round(F.sum("volume"), 1)).first()[0] == 935.3
    (tmp_path / "iris.csv").write_text("5.1,3.5,1.4,0.2,Iris-setosa\n7.0,3.2,4.7,1.4,Iris-versicolor\n")
    assert [r.target for r in datasets.iris(spark, str(tmp_path / "iris.csv")).target().orderBy("id").collect()] == [0, 1]


def test_models_score_streams(spark, tmp_path):
    d = datasets.trees(spark)
    model = LinearRegression().fit(d.frame, d.features, d.label)
    events = d.frame.withColumn("ts", F.timestamp_seconds(F.col("id") * 600))
    events.write.parquet(str(tmp_path / "in"))
    stream = scoring.read_files(spark, str(tmp_path / "in"))
    out = scoring.run_available(scoring.windowed_scores(stream, model.transform, "ts", "1 hour", F.col("prediction") > 25))
    assert sum(r.n for r in out.collect()) == 31
    seen = []
    scoring.refit(stream, lambda batch: seen.append(batch.count())).awaitTermination()
    assert sum(seen) == 31
