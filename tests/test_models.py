import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import errors
from tessera.functions import kernels, scalar
from tessera.operators import evaluation, joins, optim
from tessera.operators.models.base import Trainable
from tessera.operators.models.clustering import DBSCAN, GaussianMixture, KMeans
from tessera.operators.models.kernel_models import SVM, GaussianProcess
from tessera.operators.models.naive_bayes import NaiveBayes
from tessera.operators.models.neighbours import KNNClassifier
from tessera.operators.models.neural import Dense, NeuralNetwork, mlp
from tessera.operators.models.pca import PCA
from tessera.operators.models.regression import BERNOULLI, NORMAL, POISSON, GeneralizedLinearRegression, LinearRegression, LinearRegressionGD, LogisticRegression, binomial
from tessera.sources import datasets


def frame(spark, rows, names):
    return datasets.from_rows(spark, rows, names)


def predictions(df, column="prediction"):
    return [r[column] for r in df.orderBy("id").collect()]


def test_least_squares_on_trees(spark):
    d = datasets.trees(spark)
    model = LinearRegression().fit(d.frame, d.features, d.label)
    assert np.allclose(model.parameters, [-57.98765891838409, 4.708160503017506, 0.3392512342447438], rtol=0, atol=1e-8)
    line = frame(spark, [(2, 5), (3, 6), (4, 7)], ("x", "y"))
    assert np.allclose(LinearRegression().fit(line, ["x"], "y").parameters, [3, 1], atol=1e-8)
    with pytest.raises(errors.LinearAlgebraError):
        LinearRegression().fit(line.withColumn("x", F.lit(1.0)), ["x"], "y")
    with pytest.raises(errors.InvalidDataError):
        LinearRegression().fit(line.limit(0), ["x"], "y")


def test_gradient_descent_and_logistic(spark):
    logit = frame(spark, [(1, 0), (3, 0), (5, 1), (7, 1)], ("x", "y"))
    assert np.allclose(LogisticRegression().fit(logit, ["x"], "y").parameters, [-2.970987866676504, 0.8584021322528853], atol=1e-8)
    small = frame(spark, [(x / 10, 2 * x / 10 + 1) for x in range(10)], ("x", "y"))
    assert np.allclose(LinearRegressionGD(optim.GradientDescent(0.5, 3000)).fit(small, ["x"], "y").parameters, [1, 2], atol=1e-4)


@pytest.mark.parametrize(
    ("family", "lagged", "x", "y", "want"),
    [
        (NORMAL, False, [1, 3, 5, 7], [1, 5, 9, 13], [-1, 2]),
        (BERNOULLI, True, range(8), [0, 0, 1, 0, 1, 0, 1, 1], [-1.471093440871473, 0.594180526851822]),
        (POISSON, True, [1, 3, 5, 7], [1, 2, 4, 9], [-2.65116279, 1.60465116]),
        (BERNOULLI, False, range(8), [0, 0, 1, 0, 1, 0, 1, 1], [-2.079295260695023, 0.594084360198578]),
        (POISSON, False, [1, 3, 5, 7], [1, 2, 4, 9], [-0.4343896643867564, 0.37387931582820166]),
    ],
)
def test_generalised_linear_models(spark, family, lagged, x, y, want):
    df = frame(spark, list(zip(x, y, strict=True)), ("x", "y"))
    assert np.allclose(GeneralizedLinearRegression(family, lagged=lagged).fit(df, ["x"], "y").parameters, want, atol=1e-6)


def test_naive_bayes(spark):
    gauss = frame(spark, [(1, 1.1, 0), (1.2, 0.9, 0), (2.9, 3.1, 1), (3.2, 3, 1), (6, 7.1, 2), (6.3, 7, 2)], ("a", "b", "y")).withColumn("y", F.col("y").cast("int"))
    assert predictions(NaiveBayes("gaussian").fit(gauss, ["a", "b"], "y").transform(gauss)) == [0, 0, 1, 1, 2, 2]
    bern = frame(spark, [(1, 1, 0, 0), (1, 0, 0, 0), (0, 0, 1, 1), (0, 0, 1, 1)], ("a", "b", "c", "y"))
    assert predictions(NaiveBayes("bernoulli").fit(bern, ["a", "b", "c"], "y").transform(bern)) == [0, 0, 1, 1]
    multi = frame(spark, [(1, 0, 5, 0), (0, 0, 11, 0), (13, 1, 0, 1), (12, 3, 0, 1)], ("a", "b", "c", "y"))
    assert predictions(NaiveBayes("multinomial").fit(multi, ["a", "b", "c"], "y").transform(multi)) == [0, 0, 1, 1]
    with pytest.raises(errors.InvalidDataError):
        NaiveBayes().fit(gauss.limit(1), ["a", "b"], "y")


class Triangles:
    """A distribution of the caller's own: distance from the class mean."""

    def aggregates(self, features):
        return [F.avg(c).alias(f"m_{c}") for c in features]

    def parameters(self, row):
        return {k: v for k, v in row.asDict().items() if k.startswith("m_")}

    def log_likelihood(self, features, parameters):
        return -F.abs(F.col(features[0]) - parameters[f"m_{features[0]}"])


def test_own_distribution_searcher_and_weights(spark):
    df = frame(spark, [(1, 0), (2, 0), (8, 1), (9, 1)], ("a", "y"))
    assert predictions(NaiveBayes(Triangles()).fit(df, ["a"], "y").transform(df)) == [0, 0, 1, 1]

    def search(q, p, features, k, not_self):
        return q.crossJoin(p).select("q", "p", F.abs(F.col("x")[0] - F.col("y")[0]).alias("d"))

    q = df.withColumnRenamed("id", "qid")
    got = [sorted(map(tuple, joins.knn_join(q, df, ["a"], 2, algorithm=a).collect())) for a in (search, "blocked")]
    assert got[0] == got[1]
    rates = frame(spark, [(0, 0.1, 0.2), (1, 0.3, 0.1), (2, 0.8, 0.2), (3, 0.7, 0.5)], ("x", "y", "w"))
    tries = GeneralizedLinearRegression(binomial("w")).fit(rates, ["x"], "y").parameters
    same = GeneralizedLinearRegression(BERNOULLI).fit(rates, ["x"], "y").parameters
    assert np.isfinite(tries).all() and not np.allclose(tries, same)


def test_k_means(spark):
    df = frame(spark, [(0, 0), (0, 1), (1, 0), (90, 90), (91, 90), (90, 91)], ("x", "y"))
    for init in ("forgy", "random_partition", "k_means++"):
        model = KMeans(2, init=init, seed=4).fit(df, ["x", "y"])
        p = predictions(model.transform(df))
        assert len(set(p[:3])) == 1 and len(set(p[3:])) == 1 and p[0] != p[3], init
    with pytest.raises(errors.InvalidDataError):
        KMeans(7).fit(df, ["x", "y"])
    with pytest.raises(errors.UntrainedModelError):
        Trainable(KMeans(2)).predict(df)


def test_dbscan(spark):
    df = frame(spark, [(1, 2), (1.1, 2.2), (0.9, 1.9), (1, 2.1), (-2, 3), (-2.2, 3.1)], ("x", "y"))
    model = DBSCAN(0.5, 2).fit(df, ["x", "y"])
    assert [r.cluster for r in model.clusters.orderBy("id").collect()] == [0, 0, 0, 0, 1, 1]
    assert predictions(model.transform(frame(spark, [(1, 2), (4, 4)], ("x", "y")))) == [0, None]
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(120, 2)).round(3)
    one, two = (DBSCAN(0.3, 4).fit(frame(spark, rows, ("x", "y")).repartition(n), ["x", "y"]).clusters for n in (1, 5))
    assert [r.cluster for r in one.orderBy("id").collect()] == [r.cluster for r in two.orderBy("id").collect()]


@pytest.mark.parametrize("dims", [2, 4])
def test_dbscan_shuffles_no_pairs(spark, monkeypatch, dims):
    rng = np.random.default_rng(dims)
    x = np.concatenate([np.zeros((300, dims)), rng.normal(size=(300, dims)) * 0.01, rng.normal(size=(150, dims)).round(1) * 2])  # equal, close and spread points
    rows = [(i * 7 % 750, *map(float, v)) for i, v in enumerate(x)]
    names, eps = [f"x{i}" for i in range(dims)], 0.5
    df = spark.createDataFrame(rows, ["id", *names])
    edges, components = [], joins.connected_components
    monkeypatch.setattr(joins, "connected_components", lambda e, nodes: edges.append(e.count()) or components(e, nodes))
    model = DBSCAN(eps, 4).fit(df, names)
    assert edges[0] < 5 * 750  # all pairs are more than 100,000
    x = x[np.argsort([r[0] for r in rows])]
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) < eps
    assert {r.id: r.n for r in DBSCAN(eps, 4).neighbours(df, names).collect()} == dict(enumerate(near.sum(axis=1)))
    core, label = near.sum(axis=1) >= 4, np.arange(750)
    while True:
        new = np.where(near & core, label, 750).min(axis=1)
        if np.array_equal(new[core], label[core]):
            break
        label = new
    roots = sorted(set(label[core]))
    want = [roots.index(label[i]) if core[i] else None for i in range(750)]
    assert [r.cluster for r in model.clusters.orderBy("id").collect()] == want
    asked = x[:90] + 0.1
    d2 = ((asked[:, None] - x[None]) ** 2).sum(axis=2)
    best = [want[i] if d < eps else None for i, d in zip(d2.argmin(axis=1), np.sqrt(d2.min(axis=1)), strict=True)]
    q = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(asked)] + [(90, *[float("nan")] * dims)], ["id", *names])
    assert predictions(model.transform(q)) == [*best, None]


def test_dbscan_predicts_by_squared_distance(spark):
    """Two squares differ whose roots are equal: SQL orders by the squares."""
    rng = np.random.default_rng(0)
    while True:
        a, b = 0.3 + 0.01 * rng.random(2), 0.1 * rng.random()
        c = np.sqrt(max(0.0, a[0] * a[0] + b * b - a[1] * a[1])) * (1 - 2e-15)
        first, second = a[0] * a[0] + b * b, a[1] * a[1] + c * c
        if second < first and np.sqrt(first) == np.sqrt(second):
            break
    df = frame(spark, [(float(a[0]), float(b)), (-float(a[1]), float(c))], ("x", "y"))
    asked = frame(spark, [(0.0, 0.0)], ("x", "y"))
    assert predictions(DBSCAN(0.5, 1).fit(df, ["x", "y"]).transform(asked)) == [1]


def test_gaussian_mixture_improves(spark):
    d = datasets.clusters(spark, [(-0.5, -0.5), (0, 0.5)], 150, 0.2, 3)
    for covariance in ("full", "regularized", "diagonal"):
        em = GaussianMixture(2, covariance=covariance, epsilon=0.1, means=np.array([[-0.4, -0.3], [0.1, 0.3]]))
        model, likelihoods = em.start(d.frame, d.features), []
        for _ in range(4):
            model = em.step(d.frame, model)
            likelihoods.append(model.log_likelihood)
        assert covariance != "full" or all(b >= a - 1e-9 for a, b in zip(likelihoods, likelihoods[1:], strict=False))
        row = model.transform(d.frame).select(F.sum(F.aggregate("prediction", F.lit(0.0), lambda s, x: s + x)).alias("s")).first()
        assert abs(row.s - 300) < 1e-6
    with pytest.raises(errors.InvalidParametersError):
        GaussianMixture(2, weights=[1, -1])


def test_nearest_neighbours(spark):
    df = frame(spark, [(1, 2), (8, 0), (6, 10), (3, 6), (0, 3)], ("x", "y"))
    q = frame(spark, [(3, 4.9)], ("x", "y")).withColumnRenamed("id", "qid")
    for algorithm in ("blocked", "brute", "kd_tree", "ball_tree"):
        near = joins.knn_join(q, df, ["x", "y"], 3, algorithm=algorithm).orderBy("rank").collect()
        assert [r.id for r in near] == [3, 0, 4]
        assert np.allclose([r.distance for r in near], [1.0999999999999996, 3.5227829907617076, 3.551056180912941], atol=1e-12)
    k4 = frame(spark, [(2, 3, 4, 0), (2, 3, 0, 1), (1, 1, 1, 0), (2, 2.5, 0.5, 1)], ("a", "b", "c", "y"))
    model = KNNClassifier(2).fit(k4, ["a", "b", "c"], "y")
    assert predictions(model.transform(frame(spark, [(2, 3, 0), (1, 1, 1.2)], ("a", "b", "c")))) == [1, 0]
    with pytest.raises(errors.InvalidDataError):
        KNNClassifier(9).fit(k4, ["a", "b", "c"], "y")


@pytest.mark.parametrize("kind", ["plain", "grid", "far", "equal", "odd", "close"])
def test_nearest_by_products_of_blocks(kind):
    import time

    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(6000, 9)), rng.normal(size=(300, 9))
    if kind == "grid":
        x, q = x.round(), q.round()
    elif kind == "far":
        x, q = x + 1e6, q + 1e6
    elif kind == "equal":
        x[:3000] = q[:100] = x[0]
    elif kind == "odd":
        x[7], x[8], q[5], q[6] = np.nan, x[8] * 1e200, np.inf, q[6] * 1e160
    elif kind == "close":
        x[:900] = x[0] * (1 + 1e-9 * rng.normal(size=(900, 1)))
    ids, own = rng.permutation(6000), rng.integers(0, 6000, 300)
    for not_self in (False, True):
        i, near, d = joins._nearest(q, own, x, ids, 5, not_self)
        for row in range(len(q)):
            with np.errstate(over="ignore", invalid="ignore"):
                all_d = np.sqrt(sum((q[row, c] - x[:, c]) ** 2 for c in range(9)))
            usable = np.flatnonzero(ids != own[row]) if not_self else np.arange(len(x))
            best = usable[np.lexsort((ids[usable], all_d[usable]))[:5]]
            assert near[i == row].tolist() == ids[best].tolist()
            assert np.array_equal(d[i == row], all_d[best], equal_nan=True)
    if kind == "plain":
        x = rng.normal(size=(8192, 64))
        began = time.process_time()
        joins._nearest(x[:2048], np.arange(2048), x, np.arange(8192), 5, True)
        assert (time.process_time() - began) / 2048 / 8192 < 80e-9  # 176 ns a pair with a product for each query


def test_components_in_one_task_and_in_rounds(spark):
    edges = spark.createDataFrame([(3, 4), (4, 9), (1, 2), (7, 7), *((20 + i, 21 + i) for i in range(30))], "u long, v long")
    want = {3: 3, 4: 3, 9: 3, 1: 1, 2: 1, 5: 5} | {20 + i: 20 for i in range(31)}
    nodes, old = spark.createDataFrame([(5,), (3,)], "id long"), joins.ONE_TASK
    for joins.ONE_TASK in (old, 0):
        assert {r.node: r.component for r in joins.connected_components(edges, nodes).collect()} == want
    joins.ONE_TASK = old


def test_epsilon_join_is_strict_and_counts_self(spark):
    df = frame(spark, [(0, 0), (1, 0), (0.5, 0)], ("x", "y"))
    got = {(r.a, r.b) for r in joins.epsilon_join(df, df, ["x", "y"], 1.0).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (0, 2), (2, 0), (1, 2), (2, 1)}


def test_gaussian_process(spark):
    df = frame(spark, list(zip(range(10), [0, 1, 2, 3, 4, 4, 3, 2, 1, 0], strict=True)), ("x", "y"))
    q = frame(spark, [(2.3,), (4.4,), (5.1,), (6.2,), (7.1,)], ("x",))
    model = GaussianProcess(noise=10.0).fit(df, ["x"], "y")
    mean = [0.46067480079444173, 0.7472709514172396, 0.7200079942901982, 0.5573116278342435, 0.38102197972858665]
    variance = [0.8526000368316621, 0.8526080474339389, 0.85257881503149, 0.8525881931896948, 0.852579050086853]
    assert np.allclose(predictions(model.transform(q)), mean, atol=1e-10)
    assert np.allclose(np.diag(model.posterior(q)[1]), variance, atol=1e-10)
    assert np.allclose(predictions(model.variances(q), "variance"), variance, atol=1e-10)


def test_svm(spark):
    x = [-0.1, -2, -9, -101, -666.7, 0, 0.1, 1, 11, 99, 456.7]
    df = frame(spark, [(v, -1 if v < 0 else 1) for v in x], ("x", "y"))
    test = frame(spark, [(v,) for v in range(-1000, 1000, 100)], ("x",))
    for variant in ("pegasos", "rowsum"):
        p = predictions(SVM(kernels.hyperbolic_tangent(100, 0), variant=variant).fit(df, ["x"], "y").transform(test))
        if variant == "pegasos":
            assert p[:10] == [-1.0] * 10 and p[11:] == [1.0] * 9
    with pytest.raises(errors.InvalidDataError):
        SVM().fit(df.withColumn("y", F.lit(3)), ["x"], "y")


def test_pca(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3)) @ rng.normal(size=(3, 3))
    df = frame(spark, x, ("a", "b", "c"))
    for centre in (True, False):
        model = PCA(centre=centre).fit(df, ["a", "b", "c"])
        z = x - x.mean(axis=0) if centre else x
        v = np.linalg.svd(z, full_matrices=False)[2].T
        assert np.allclose(np.abs(model.components), np.abs(v), atol=1e-8)
        got = np.array([[r.pc0, r.pc1, r.pc2] for r in model.transform(df).orderBy("id").collect()])
        assert np.allclose(np.abs(got), np.abs(z @ v), atol=1e-8)
    with pytest.raises(errors.InvalidDataError):
        PCA(4).fit(df, ["a", "b", "c"])
    wide = PCA(1).fit(frame(spark, [(1, 2, 3, 5), (2, 1, 9, 4)], ("a", "b", "c", "d")), ["a", "b", "c", "d"])
    assert wide.components.shape == (4, 1)


def test_networks(spark):
    d = datasets.and_gate(spark, 600, seed=2)
    for algorithm in (optim.StochasticDescent(0.1, 0.5, 30), optim.AdaGrad(iterations=20), optim.RMSProp(0.05, iterations=20)):
        model = mlp([2, 1], algorithm=algorithm).fit(d.frame, d.features, d.label)
        corner = predictions(model.transform(frame(spark, [(0, 0), (0, 1), (1, 0), (1, 1)], d.features)))
        assert [c[0] > 0.5 for c in corner] == [False, False, False, True], algorithm
    averaged = mlp([2, 1], algorithm=optim.StochasticDescent(0.1, 0.5, 15), mode="averaged").fit(d.frame.repartition(3, "id"), d.features, d.label)
    assert averaged.layer_weights(0).shape == (3, 1)
    batch = mlp([2, 3, 1], algorithm=optim.ConjugateGradient(iterations=5)).fit(d.frame, d.features, d.label)
    assert len(batch.transform(d.frame).first().prediction) == 1
    with pytest.raises(errors.InvalidParametersError):
        NeuralNetwork((Dense(2, 3), Dense(4, 1)))


@pytest.mark.parametrize("algorithm", [optim.GradientDescent(), optim.StochasticDescent(iterations=200), optim.AdaGrad(5, 1, 3000), optim.RMSProp(0.5, iterations=2000), optim.ConjugateGradient()])
def test_optimisers_find_a_parabola_minimum(algorithm):
    out = algorithm.minimise(lambda w: (float((w[0] - 20) ** 2), 2 * (w - 20)), np.array([100.0]))
    assert abs(out[0] - 20) < 0.5


def test_conjugate_gradient_on_a_valley():
    f = lambda w: (float(100 * (w[1] - w[0] ** 2) ** 2 + (1 - w[0]) ** 2), np.array([-400 * w[0] * (w[1] - w[0] ** 2) - 2 * (1 - w[0]), 200 * (w[1] - w[0] ** 2)]))
    assert np.allclose(optim.ConjugateGradient(iterations=300).minimise(f, np.array([-1.2, 1.0])), [1, 1], atol=1e-3)


def test_folds_by_subtraction_match_refits(spark):
    d = datasets.trees(spark)

    class Plain:
        fit = staticmethod(LinearRegression().fit)

    score = lambda df: evaluation.neg_mean_squared_error(df, "prediction", "volume")
    fast, slow = (evaluation.k_fold_validate(e, d.frame, d.features, d.label, 4, score) for e in (LinearRegression(), Plain()))
    assert np.allclose(fast, slow, rtol=1e-8)


def test_kernel_forms_agree(spark):
    df = frame(spark, [(0.1, 0.4), (0.7, -0.2), (1.5, 0.3)], ("x", "y"))
    x = np.array([(0.1, 0.4), (0.7, -0.2), (1.5, 0.3)])
    base = [kernels.linear(1), kernels.polynomial(2, 1, 3), kernels.squared_exponential(0.5, 2), kernels.exponential(0.7), kernels.hyperbolic_tangent(0.5, 1), kernels.multiquadric(2), kernels.rational_quadratic(2, 0.5)]
    for k in [*base, base[0] + base[2], base[1] * base[3]]:
        pairs = df.alias("a").crossJoin(df.select(F.col("id").alias("j"), F.col("x").alias("u"), F.col("y").alias("v")))
        want = [r.k for r in pairs.select("id", "j", k.expr(["x", "y"], ["u", "v"]).alias("k")).orderBy("id", "j").collect()]
        assert np.allclose(k.matrix(x, x).ravel(), want, atol=1e-12), k.name
        assert np.allclose([r.k for r in joins.kernel_matrix(df, df, ["x", "y"], k).orderBy("i", "j").collect()], want, atol=1e-12)


def test_penalties():
    w = (np.arange(12.0) - 3).reshape(3, 4)
    assert abs(scalar.l1(0.5).cost(w) - 42 / 12) < 1e-12 and set(np.abs(scalar.l1(0.5).grad(w)).ravel()) == {1 / 12}
    assert abs(scalar.l2(0.5).cost(w) - np.linalg.norm(w) / 12) < 1e-12 and np.allclose(scalar.l2(0.5).grad(w), w / 6)
    both = scalar.elastic_net(0.5, 0.25)
    assert np.allclose(both.grad(w), scalar.l1(0.5).grad(w) + scalar.l2(0.25).grad(w)) and scalar.NO_PENALTY.cost(w) == 0


def test_row_sums_have_no_limit_of_rows(spark):
    from tessera.functions import kernels
    from tessera.operators.models import kernel_models

    n = kernel_models.MOST_ROWS + 50
    frame = spark.range(n).selectExpr("id", "CAST(id % 7 AS double) AS x").union(spark.createDataFrame([(3, 3.0)], "id long, x double"))
    got = kernel_models.row_sums(frame, ["x"], kernels.squared_exponential()).collect()
    assert len(got) == n + 1
    counts = np.bincount(np.r_[np.arange(n) % 7, 3])
    want = [float(counts @ np.exp(-((k - np.arange(7.0)) ** 2) / 2)) for k in range(7)]
    assert all(abs(r.s - want[r.id % 7]) < 1e-6 for r in got)


def test_row_sums_hold_few_pairs_at_once(spark):
    from tessera.functions.kernels import Kernel
    from tessera.operators.models import kernel_models

    def parts(dot, d2, m):
        assert dot.size <= 1 << 20
        return m.exp(-d2 / 2)

    got = kernel_models.row_sums(spark.range(3000).selectExpr("id", "CAST(id AS double) AS x"), ["x"], Kernel("checked", parts)).collect()
    near = np.exp(-(np.arange(-60.0, 61.0) ** 2) / 2)
    assert len(got) == 3000 and all(abs(r.s - near[max(0, 60 - r.id) : 61 + min(60, 2999 - r.id)].sum()) < 1e-9 for r in got)


def test_svm_training_has_no_limit_of_rows(spark, monkeypatch):
    from tessera.operators.models import kernel_models

    rng = np.random.default_rng(3)
    x = rng.normal(size=(70, 2))
    df = spark.createDataFrame([(int(i * 3 % 211), float(a), float(b), 1.0 if a > 0 else -1.0) for i, (a, b) in enumerate(x)], "id long, x double, y double, t double").repartition(5)
    rows = np.array(sorted(map(tuple, df.collect())))
    got = kernel_models.rows_at(df, ["x", "y", "t"], "id", [69, 0, 33, 33])
    assert np.array_equal(got, rows[[0, 33, 69], 1:])
    full, y, kernel = np.hstack([np.ones((70, 1)), rows[:, 1:3]]), rows[:, 3], kernels.squared_exponential()
    monkeypatch.setattr(kernel_models, "MOST_ROWS", 50)
    for variant in ("pegasos", "rowsum"):
        draws, alpha, k = np.random.default_rng(0), np.zeros(70), kernel.matrix(full, full)
        for t in range(100):
            i = draws.integers(70)
            if variant == "pegasos":
                alpha[i] += y[i] * (k[i] @ (alpha * y)) / (0.3 * (t + 1)) < 1
            else:
                alpha[i] += y[i] * k[i].sum() / (0.3 * t) < 1 if t else y[i] * k[i].sum() < 0
        out = SVM(variant=variant).fit(df, ["x", "y"], "t").decision(df).orderBy("id").collect()
        assert np.allclose([r.decision for r in out], k @ (alpha / 100 * y) / 0.3, atol=1e-12)


def test_kernel_matrix_of_two_large_sides_is_dealt_to_blocks(spark, monkeypatch):

    frame = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(60)], "id long, a double, b double")
    want = sorted(joins.kernel_matrix(frame, frame, ["a", "b"], kernels.squared_exponential()).collect())
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(joins, "PAIRED", 16)
    dealt = joins.kernel_matrix(frame, frame, ["a", "b"], kernels.squared_exponential())
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    got = sorted(dealt.collect())
    assert len(got) == 3600 and [r[:2] for r in got] == [r[:2] for r in want]
    assert all(abs(x.k - y.k) < 1e-12 for x, y in zip(got, want, strict=True))
    with pytest.raises(errors.InvalidParametersError):
        joins.knn_join(frame, frame, ["a", "b"], 2, "id", "id", algorithm="brute")
