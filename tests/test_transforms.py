import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import errors
from tessera.functions import scalar
from tessera.operators import evaluation, sampling, stats, transforms
from tessera.sources import datasets


def frame(spark, rows, names=("a", "b")):
    return datasets.from_rows(spark, rows, names)


def values(df, *names):
    return [tuple(r[n] for n in names or ("a", "b")) for r in df.orderBy("id").collect()]


def test_min_max(spark):
    df = frame(spark, [(-1, 2), (0, 3)])
    scaler = transforms.MinMaxFitter().fit(df, ["a", "b"])
    assert values(scaler.transform(df)) == [(0, 0), (1, 1)]
    assert values(scaler.inverse(scaler.transform(df))) == [(-1, 2), (0, 3)]
    assert values(transforms.MinMaxFitter(1, 3).fit(df, ["a", "b"]).transform(df)) == [(1, 1), (3, 3)]
    for rows in ([(math.nan, 2), (0, 3)], [(math.inf, 2), (0, 3)], [(1, 2), (1, 3)], []):
        with pytest.raises(errors.InvalidDataError):
            transforms.MinMaxFitter().fit(frame(spark, rows), ["a", "b"])
    with pytest.raises(errors.InvalidStateError):
        scaler.transform(df.drop("b"))


def test_standardize(spark):
    df = frame(spark, [(-1, 2), (0, 3), (4, 1)])
    z = transforms.StandardizerFitter(5, 2).fit(df, ["a", "b"])
    row = z.transform(df).agg(F.avg("a"), F.stddev_samp("a")).first()
    assert abs(row[0] - 5) < 1e-12 and abs(row[1] - 2) < 1e-12
    assert all(abs(x - y) < 1e-12 for p, q in zip(values(z.inverse(z.transform(df))), values(df), strict=True) for x, y in zip(p, q, strict=True))
    for rows in ([(1, 2)], [(math.nan, 2), (1, 2)], [(1, 2), (1, 3)]):
        with pytest.raises(errors.InvalidDataError):
            transforms.StandardizerFitter().fit(frame(spark, rows), ["a", "b"])


def test_normalize(spark):
    df = frame(spark, [(1, 2, 10), (0, 10, 20), (100, 10, 200), (0, 0, 0)], ("a", "b", "c"))
    want = [(0.0975900073, 0.1951800146, 0.9759000729), (0, 0.4472135955, 0.8944271910), (0.4467670516, 0.0446767052, 0.8935341032), (0, 0, 0)]
    got = values(transforms.Normalizer().transform(df, ["a", "b", "c"]), "a", "b", "c")
    assert all(abs(x - y) < 1e-9 for p, q in zip(got, want, strict=True) for x, y in zip(p, q, strict=True))
    packed = df.select("id", F.array("a", "b", "c").alias("v"))
    for p in (1, 2, 3, math.inf):
        wide = values(transforms.Normalizer(p).transform(df, ["a", "b", "c"]), "a", "b", "c")
        assert all(abs(x - y) < 1e-12 for r, q in zip(transforms.Normalizer(p).transform_array(packed, "v").orderBy("id").collect(), wide, strict=True) for x, y in zip(r.v, q, strict=True))
    with pytest.raises(Exception, match="norm"):
        transforms.Normalizer().transform(frame(spark, [(math.nan, 1)]), ["a", "b"]).collect()


def test_shuffle_is_a_permutation(spark):
    df = spark.range(500).withColumn("x", F.lit(1))
    pos = {r.id: r.pos for r in transforms.Shuffler(3).positions(df, "id").collect()}
    assert sorted(pos.values()) == list(range(500)) and [pos[i] for i in range(500)] != list(range(500))
    order = [r.id for r in transforms.Shuffler(3).transform(df, "id").collect()]
    assert order == sorted(pos, key=pos.get)


def test_one_hot(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "z")], "id long, label string")
    back = transforms.from_one_hot(transforms.one_hot(df, "label", ["a", "b"]), "target", "k")
    assert values(back, "k") == [(0,), (1,), (None,)]


def test_scores(spark):
    df = spark.createDataFrame(list(zip([1, 1, 1, 0, 0, 0], [1, 1, 0, 0, 1, 1], strict=True)), "prediction int, label int")
    assert evaluation.accuracy(df) == 0.5 and abs(evaluation.precision(df) - 2 / 3) < 1e-15
    assert evaluation.recall(df) == 0.5 and abs(evaluation.f1(df) - 0.5714285714285714) < 1e-15
    assert math.isnan(evaluation.precision(df.withColumn("prediction", F.lit(0)))) and math.isnan(evaluation.accuracy(df.limit(0)))
    with pytest.raises(Exception, match="labels other"):
        evaluation.precision(df.withColumn("label", F.lit(2)))


def test_confusion_matrix(spark):
    df = spark.createDataFrame(list(zip([0, 0, 2, 2, 0, 2], [2, 0, 2, 2, 0, 1], strict=True)), "prediction int, label int")
    rows = [tuple(r) for r in evaluation.confusion_matrix(df).collect()]
    assert rows == [(0, 2, 0, 0), (1, 0, 0, 1), (2, 1, 0, 2)]
    assert [tuple(r)[1:] for r in evaluation.confusion_matrix(df, labels=[2, 1, 0]).collect()] == [(2, 0, 1), (1, 0, 0), (0, 0, 2)]
    assert [tuple(r)[1:] for r in evaluation.confusion_matrix(df, labels=[7, 8]).collect()] == [(0, 0), (0, 0)]
    with pytest.raises(errors.InvalidParametersError):
        evaluation.confusion_matrix(df, labels=[1, 1])


@pytest.mark.parametrize(("n", "k", "want"), [(6, 3, [2, 2, 2]), (5, 2, [3, 2]), (6, 4, [2, 2, 1, 1]), (4, 4, [1] * 4)])
def test_folds(spark, n, k, want):
    sizes = Counter(r.fold for r in evaluation.with_folds(spark.range(n), k).collect())
    assert [sizes[i] for i in range(k)] == want


def test_folds_are_refused(spark):
    with pytest.raises(errors.InvalidParametersError):
        evaluation.with_folds(spark.range(3), 4)


def test_samples(spark):
    assert sampling.reservoir(spark.range(100), 7, "id").count() == 7
    with pytest.raises(errors.InvalidParametersError):
        sampling.reservoir(spark.range(3), 7, "id")
    df = spark.createDataFrame([(0, 0.0), (1, 2.0), (2, 6.0)], "id long, w double")
    assert sampling.draw_by_prefix(df, "w", "id", 0.1).first().id == 1 and sampling.draw_by_prefix(df, "w", "id", 0.9).first().id == 2
    assert sampling.draw_by_prefix(df, "w", "id", 1.0).count() == 0 == sampling.draw_by_prefix(df.limit(0), "w", "id", 0.5).count()
    many = spark.range(400).select("id", F.when(F.col("id") % 7 > 0, (F.col("id") * 37) % 11).alias("_run")).repartition(5)
    weights = {r.id: r._run or 0 for r in many.collect()}
    for at in (0.0, 0.31, 0.77, 0.999):
        total, running = sum(weights.values()), 0
        wanted = next(i for i in range(400) if (running := running + weights[i]) > at * total)
        assert [r.id for r in sampling.draw_by_prefix(many, "_run", "id", at).collect()] == [wanted]
    assert {sampling.weighted_draw(df, "w", 1, s).first().id for s in range(8)} <= {1, 2}


def test_activations_and_links(spark):
    df = spark.createDataFrame([(0.3,), (0.7,)], "x double")
    for a in scalar.ACTIVATIONS.values():
        r = df.select("x", a.inverse(a.func(F.col("x"))).alias("back"), a.grad(F.col("x")).alias("g"), a.grad_from_output(a.func(F.col("x"))).alias("h")).collect()
        assert all(abs(x.back - x.x) < 1e-12 and abs(x.g - x.h) < 1e-12 for x in r)
    for link in scalar.LINKS.values():
        r = df.select("x", link.inverse(link.func(F.col("x"))).alias("back"), ((link.func(F.col("x") + 1e-6) - link.func(F.col("x"))) / 1e-6 - link.grad(F.col("x"))).alias("e")).collect()
        assert all(abs(x.back - x.x) < 1e-12 and abs(x.e) < 1e-4 for x in r)


def test_distributions(spark):
    df = spark.range(4000)
    r = df.select(stats.Exponential(2.0).sample(1).alias("e"), stats.Gaussian(3, 4).sample(2).alias("g")).agg(F.avg("e").alias("e"), F.avg("g").alias("g"), F.var_samp("g").alias("v")).first()
    assert abs(r.e - 0.5) < 0.05 and abs(r.g - 3) < 0.15 and abs(r.v - 4) < 0.4
    x = spark.createDataFrame([(3.0,), (5.0,)], "x double").select(stats.Gaussian(3, 4).cdf("x").alias("c"), stats.Gaussian(3, 4).pdf("x").alias("p"), stats.Exponential(2.0).cdf("x").alias("f")).collect()
    assert abs(x[0].c - 0.5) < 1e-6 and abs(x[1].c - 0.8413447) < 1e-6 and abs(x[0].p - 0.19947114) < 1e-8 and abs(x[1].f - (1 - math.exp(-10))) < 1e-12


def test_distances(spark):
    df = spark.createDataFrame([(3.0, 4.0)], "x double, y double")
    r = df.select(scalar.distance(["x", "y"], [0.0, 0.0]).alias("d"), scalar.box_distance(["x", "y"], [0, 0], [1, 4]).alias("b"), scalar.ball_distance(["x", "y"], [0.0, 0.0], 2).alias("o"), scalar.norm(["x", "y"], 1).alias("n")).first()
    assert (r.d, r.b, r.o, r.n) == (5, 2, 3, 7)
