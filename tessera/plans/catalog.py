"""All registered queries of the engine, each beside the SQL that states its result.

Real results are rounded by floor(x * scale + 0.5) / scale in both languages, since sums of doubles depend on their
order; integers are longs."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import kernels, scalar
from tessera.functions.linalg import moments
from tessera.operators import evaluation, joins, optim, sampling, stats, transforms
from tessera.operators.models import clustering, kernel_models, naive_bayes, neighbours, neural, pca, regression
from tessera.sources import datasets
from tessera.streaming import scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column | str, digits: int = 6) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def q(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

# ---------------------------------------------------------------- scaling


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, {", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in LINE)} FROM lineitem)
SELECT l_orderkey, l_linenumber, {", ".join(f"{q(c)} AS {c}" for c in LINE)} FROM s""")
def minmax_scale(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    out = transforms.MinMaxFitter().fit(df, LINE).transform(df)
    return out.select("l_orderkey", "l_linenumber", *(r(c).alias(c) for c in LINE))


def part_scaler(df):
    return transforms.MinMaxFitter(-1.0, 3.0).fit(df, ["p_size", "p_retailprice"])


@query(f"""WITH s AS (SELECT p_partkey, {", ".join(f"-1 + 4 * ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in ("p_size", "p_retailprice"))} FROM part)
SELECT p_partkey, {q("p_size")} AS size, {q("p_retailprice")} AS price FROM s""")
def minmax_custom_range(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return part_scaler(df).transform(df).select("p_partkey", r("p_size").alias("size"), r("p_retailprice").alias("price"))


@query(f"SELECT p_partkey, {q('p_size', 4)} AS size, {q('p_retailprice', 4)} AS price FROM part")
def minmax_inverse(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    scaler = part_scaler(df)
    return scaler.inverse(scaler.transform(df)).select("p_partkey", r("p_size", 4).alias("size"), r("p_retailprice", 4).alias("price"))


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, {", ".join(f"({c} - avg({c}) OVER ()) / sqrt(var_samp({c}) OVER ()) AS {c}" for c in LINE)} FROM lineitem)
SELECT l_orderkey, l_linenumber, {", ".join(f"{q(c)} AS {c}" for c in LINE)} FROM s""")
def standardize(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    out = transforms.StandardizerFitter().fit(df, LINE).transform(df)
    return out.select("l_orderkey", "l_linenumber", *(r(c).alias(c) for c in LINE))


@query(f"""WITH s AS (SELECT c_custkey, 10 + 2.5 * (c_acctbal - avg(c_acctbal) OVER ()) / sqrt(var_samp(c_acctbal) OVER ()) AS z FROM customer)
SELECT c_custkey, {q("z")} AS z FROM s""")
def standardize_custom(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return transforms.StandardizerFitter(10.0, 2.5).fit(df, ["c_acctbal"]).transform(df).select("c_custkey", r("c_acctbal").alias("z"))


@query(f"SELECT c_custkey, {q('c_acctbal', 4)} AS balance FROM customer")
def standardize_inverse(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    z = transforms.StandardizerFitter(10.0, 2.5).fit(df, ["c_acctbal"])
    return z.inverse(z.transform(df)).select("c_custkey", r("c_acctbal", 4).alias("balance"))


def _normalize(p: float, size: str, name: str):
    sql = f"""WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
n AS (SELECT vec_id, {size} AS s FROM v GROUP BY vec_id)
SELECT vec_id, CAST(pos - 1 AS BIGINT) AS pos, {q("CASE WHEN s = 0 THEN x ELSE x / s END")} AS v FROM v JOIN n USING (vec_id)"""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        out = transforms.Normalizer(p).transform_array(df, "embedding").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
        return out.select("vec_id", F.col("pos").cast("long").alias("pos"), r("v").alias("v"))

    run.__name__ = name
    query(sql)(run)


_normalize(2.0, "sqrt(sum(x * x))", "normalize_l2")
_normalize(1.0, "sum(abs(x))", "normalize_l1")
_normalize(math.inf, "max(abs(x))", "normalize_max")


@query("SELECT n_nationkey, CAST(row_number() OVER (ORDER BY md5(concat(CAST(n_nationkey AS VARCHAR), ':7')), n_nationkey) - 1 AS BIGINT) AS pos FROM nation")
def shuffle_md5(spark, sf_dir):
    return transforms.Shuffler(7).positions(table(spark, sf_dir, "nation"), "n_nationkey").select("n_nationkey", "pos")


@query("SELECT p_partkey, CAST(list_position(['1', '2', '3'], right(p_brand, 1)) - 1 AS BIGINT) AS brand FROM part")
def one_hot_round_trip(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.right("p_brand", F.lit(1)).alias("brand"))
    out = transforms.from_one_hot(transforms.one_hot(df, "brand", ["1", "2", "3"]), "target", "k")
    return out.select("p_partkey", F.col("k").cast("long").alias("brand"))


# ---------------------------------------------------------------- scalar functions


@query(f"""WITH x AS (SELECT event_id, 0.01 + value / 500 AS x FROM events), y AS (SELECT *, 1 / (1 + exp(-x)) AS s, exp(x) AS e, tanh(x) AS t FROM x)
SELECT event_id, {q("s")} AS sigmoid, {q("s * (1 - s)")} AS sigmoid_grad, {q("ln(x / (1 - x))")} AS sigmoid_inverse, {q("e")} AS exp, {q("e")} AS exp_grad, {q("ln(x)")} AS exp_inverse,
{q("t")} AS tanh, {q("1 - t * t")} AS tanh_grad, {q("0.5 * ln((1 + x) / (1 - x))")} AS tanh_inverse, {q("x")} AS linear, 1.0::DOUBLE AS linear_grad, {q("x")} AS linear_inverse FROM y""")
def activation_table(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("event_id", (0.01 + F.col("value") / 500).alias("x"))
    out = [v for a in scalar.ACTIVATIONS.values() for v in (r(a.func(F.col("x"))).alias(a.name), r(a.grad(F.col("x"))).alias(f"{a.name}_grad"), r(a.inverse(F.col("x"))).alias(f"{a.name}_inverse"))]
    return x.select("event_id", *out)


@query(f"""WITH x AS (SELECT event_id, 0.01 + value / 500 AS x FROM events)
SELECT event_id, {q("ln(x / (1 - x))")} AS logit, {q("1 / (x * (1 - x))", 4)} AS logit_grad, {q("1 / (1 + exp(-x))")} AS logit_inverse, {q("ln(x)")} AS log, {q("1 / x", 4)} AS log_grad, {q("exp(x)")} AS log_inverse,
{q("x")} AS identity, {q("x * 0 + 1", 4)} AS identity_grad, {q("x")} AS identity_inverse FROM x""")
def link_table(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("event_id", (0.01 + F.col("value") / 500).alias("x"))
    out = [v for k in scalar.LINKS.values() for v in (r(k.func(F.col("x"))).alias(k.name), r(k.grad(F.col("x")), 4).alias(f"{k.name}_grad"), r(k.inverse(F.col("x"))).alias(f"{k.name}_inverse"))]
    return x.select("event_id", *out)


_DOT, _D2 = "(a.x * b.x + a.y * b.y)", "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_KERNELS = {
    "linear": (kernels.linear(0.5), f"{_DOT} + 0.5"),
    "poly": (kernels.polynomial(0.5, 1.0, 3.0), f"pow(0.5 * {_DOT} + 1, 3)"),
    "sqexp": (kernels.squared_exponential(0.7, 2.0), f"2 * exp(-{_D2} / (2 * 0.7 * 0.7))"),
    "exp": (kernels.exponential(0.7, 2.0), f"2 * exp(-sqrt({_D2}) / (2 * 0.7 * 0.7))"),
    "tanh": (kernels.hyperbolic_tangent(0.5, 0.1), f"tanh(0.5 * {_DOT} + 0.1)"),
    "multiquadric": (kernels.multiquadric(0.3), f"sqrt({_D2} + 0.3 * 0.3)"),
    "ratquad": (kernels.rational_quadratic(1.5, 0.8), f"pow(1 + {_D2} / (2 * 1.5 * 0.8 * 0.8), -1.5)"),
    "sum": (kernels.linear(0.5) + kernels.squared_exponential(0.7, 2.0), f"{_DOT} + 0.5 + 2 * exp(-{_D2} / (2 * 0.7 * 0.7))"),
    "prod": (kernels.linear(0.5) * kernels.squared_exponential(0.7, 2.0), f"({_DOT} + 0.5) * 2 * exp(-{_D2} / (2 * 0.7 * 0.7))"),
}


def _suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10000).alias("x"), (F.col("s_nationkey") / 25).alias("y"))


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") / 25).alias("x"), (F.col("n_regionkey") / 5).alias("y"))


_SUPPLIERS = "(SELECT s_suppkey AS id, s_acctbal / 10000 AS x, s_nationkey / 25 AS y FROM supplier)"
_NATIONS = "(SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey / 25 AS x, n_regionkey / 5 AS y FROM nation)"

for _name, (_kernel, _sql) in _KERNELS.items():

    def _gram(spark, sf_dir, kernel=_kernel):
        out = joins.kernel_matrix(_suppliers(spark, sf_dir), _nations(spark, sf_dir), ["x", "y"], kernel)
        return out.select("i", "j", r("k").alias("k"))

    _gram.__name__ = f"kernel_gram_{_name}"
    query(f"SELECT a.id AS i, b.id AS j, {q(_sql)} AS k FROM {_SUPPLIERS} a, {_NATIONS} b")(_gram)


@query(f"SELECT {q('sum((l_discount - l_tax) * (l_discount - l_tax)) / (2 * count(*))', 8)} AS cost, {q('sum(l_discount - l_tax)')} AS grad FROM lineitem")
def cost_mse(spark, sf_dir):
    o, t = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").agg(r(scalar.MEAN_SQUARED.aggregate([o], [t]), 8).alias("cost"), r(F.sum(scalar.MEAN_SQUARED.grad(o, t))).alias("grad"))


@query(f"""WITH p AS (SELECT 0.1 + 0.8 * ((doc_id * 7919) % 1000) / 1000 AS o, quality AS t FROM labels)
SELECT {q("-sum(t * ln(o) + (1 - t) * ln(1 - o)) / count(*)")} AS cost, {q("sum((o - t) / (o * (1 - o)))", 4)} AS grad FROM p""")
def cost_cross_entropy(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select((0.1 + 0.8 * ((F.col("doc_id") * 7919) % 1000) / 1000).alias("o"), F.col("quality").cast("double").alias("t"))
    o, t = F.col("o"), F.col("t")
    return df.agg(r(scalar.CROSS_ENTROPY.aggregate([o], [t])).alias("cost"), r(F.sum(scalar.CROSS_ENTROPY.grad(o, t)), 4).alias("grad"))


@query(f"""WITH w AS (SELECT s_suppkey, s_acctbal / 1000 AS w FROM supplier), s AS (SELECT count(*) AS m, sum(abs(w)) AS l1, sqrt(sum(w * w)) AS l2 FROM w)
SELECT s_suppkey, {q("0.5 * l1 / (2 * m)")} AS l1_cost, {q("0.25 * l2 / (2 * m)")} AS l2_cost, {q("0.5 * l1 / (2 * m) + 0.25 * l2 / (2 * m)")} AS elastic_cost,
{q("CASE WHEN w < 0 THEN -1 ELSE 1 END * 0.5 / (2 * m)", 8)} AS l1_grad, {q("0.25 * w / m", 8)} AS l2_grad, {q("CASE WHEN w < 0 THEN -1 ELSE 1 END * 0.5 / (2 * m) + 0.25 * w / m", 8)} AS elastic_grad FROM w, s""")
def reg_l1_l2_elastic(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("w"))
    s = F.broadcast(df.agg(F.count("*").alias("m"), scalar_norm("w", 1).alias("l1"), scalar_norm("w", 2).alias("l2")))  # one row
    sign = F.when(F.col("w") < 0, -1.0).otherwise(1.0)
    m = F.col("m")
    c1, c2, g1, g2 = 0.5 * F.col("l1") / (2 * m), 0.25 * F.col("l2") / (2 * m), sign * 0.5 / (2 * m), 0.25 * F.col("w") / m
    return df.crossJoin(s).select("s_suppkey", r(c1).alias("l1_cost"), r(c2).alias("l2_cost"), r(c1 + c2).alias("elastic_cost"), r(g1, 8).alias("l1_grad"), r(g2, 8).alias("l2_grad"), r(g1 + g2, 8).alias("elastic_grad"))


def scalar_norm(c: str, p: int) -> Column:
    return F.sum(F.abs(c)) if p == 1 else F.sqrt(F.sum(F.col(c) * F.col(c)))


@query(f"SELECT c_custkey, {q('greatest(0, 0 - c_acctbal, c_acctbal - 5000)', 4)} AS to_box, {q('greatest(0, abs(c_acctbal - 2000) - 1000)', 4)} AS to_ball FROM customer")
def region_distances(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", r(scalar.box_distance(["c_acctbal"], [0.0], [5000.0]), 4).alias("to_box"), r(scalar.ball_distance(["c_acctbal"], [2000.0], 1000.0), 4).alias("to_ball"))


@query(f"SELECT event_id, {q('0.01 * exp(-0.01 * value)', 8)} AS exponential, {q('1 - exp(-0.01 * value)')} AS exponential_cdf, {q('exp(-(value - 100) * (value - 100) / 5000) / sqrt(2 * pi() * 2500)', 8)} AS gaussian FROM events")
def distribution_densities(spark, sf_dir):
    e, g = stats.Exponential(0.01), stats.Gaussian(100.0, 2500.0)
    return table(spark, sf_dir, "events").select("event_id", r(e.pdf("value"), 8).alias("exponential"), r(e.cdf("value")).alias("exponential_cdf"), r(g.pdf("value"), 8).alias("gaussian"))


# ---------------------------------------------------------------- regression


def _parameters(spark, model, digits: int = 4) -> DataFrame:
    return spark.createDataFrame([tuple(float(p) for p in model.parameters)], ", ".join(f"b{i} double" for i in range(len(model.parameters)))).select(*(r(f"b{i}", digits).alias(f"b{i}") for i in range(len(model.parameters))))


@query(f"SELECT {q('regr_intercept(l_extendedprice, l_quantity)', 4)} AS b0, {q('regr_slope(l_extendedprice, l_quantity)', 4)} AS b1 FROM lineitem")
def linreg_ols(spark, sf_dir):
    return _parameters(spark, regression.LinearRegression().fit(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice"))


@query(f"""WITH f AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS b0, regr_slope(l_extendedprice, l_quantity) AS b1 FROM lineitem)
SELECT l_orderkey, l_linenumber, {q("b0 + b1 * l_quantity", 4)} AS prediction FROM lineitem, f""")
def linreg_ols_predict(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return regression.LinearRegression().fit(df, ["l_quantity"], "l_extendedprice").transform(df).select("l_orderkey", "l_linenumber", r("prediction", 4).alias("prediction"))


def _det3(m: list[list[str]]) -> str:
    return f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"


def _multi_sql() -> str:
    x = ["l_quantity", "l_discount", "l_tax"]
    sums = [f"covar_pop({a}, {b}) AS s{i}{j}" for i, a in enumerate(x) for j, b in enumerate(x)] + [f"covar_pop({a}, l_extendedprice) AS t{i}" for i, a in enumerate(x)]
    base = [[f"s{i}{j}" for j in range(3)] for i in range(3)]
    beta = [f"{_det3([[f't{i}' if j == k else base[i][j] for j in range(3)] for i in range(3)])} / {_det3(base)}" for k in range(3)]
    means = [f"avg({c}) AS m{i}" for i, c in enumerate([*x, "l_extendedprice"])]
    return f"WITH s AS (SELECT {', '.join(sums + means)} FROM lineitem), b AS (SELECT *, {', '.join(f'{v} AS c{k}' for k, v in enumerate(beta))} FROM s) SELECT {q('m3 - c0 * m0 - c1 * m1 - c2 * m2', 4)} AS b0, {q('c0', 4)} AS b1, {q('c1', 4)} AS b2, {q('c2', 4)} AS b3 FROM b"


@query(_multi_sql())
def linreg_ols_multi(spark, sf_dir):
    return _parameters(spark, regression.LinearRegression().fit(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))


@query(f"""WITH RECURSIVE d AS (SELECT count(*) AS n, avg(l_quantity / 50) AS mx, avg(l_extendedprice / 100000) AS my, avg(l_quantity / 50 * l_quantity / 50) AS xx, avg(l_quantity / 50 * l_extendedprice / 100000) AS xy FROM lineitem),
it(k, b0, b1) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT k + 1, b0 - 0.3 * (b0 + b1 * mx - my), b1 - 0.3 * (b0 * mx + b1 * xx - xy) FROM it, d WHERE k < 20)
SELECT {q("b0")} AS b0, {q("b1")} AS b1 FROM it WHERE k = 20""")
def linreg_gd(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 100000).alias("y"))
    return _parameters(spark, regression.LinearRegressionGD(optim.GradientDescent(0.3, 20)).fit(df, ["x"], "y"), 6)


_GRADED = "(SELECT doc_id, n_chars / 10000 AS x, quality AS y FROM labels JOIN documents USING (doc_id))"
_LOGIT_SQL = f"""WITH RECURSIVE d AS MATERIALIZED {_GRADED}, it(k, b0, b1) AS (SELECT 0, 0.5::DOUBLE, 0.5::DOUBLE UNION ALL
SELECT k + 1, any_value(b0) - 0.3 * avg(1 / (1 + exp(-(b0 + b1 * x))) - y), any_value(b1) - 0.3 * avg((1 / (1 + exp(-(b0 + b1 * x))) - y) * x) FROM it, d WHERE k < 10 GROUP BY k)"""


def _graded(spark, sf_dir) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return labels.join(docs.select("doc_id", "n_chars"), "doc_id").select("doc_id", (F.col("n_chars") / 10000).alias("x"), F.col("quality").cast("double").alias("y"))


@query(f"{_LOGIT_SQL} SELECT {q('b0')} AS b0, {q('b1')} AS b1 FROM it WHERE k = 10")
def logreg_gd(spark, sf_dir):
    return _parameters(spark, regression.LogisticRegression(optim.GradientDescent(0.3, 10)).fit(_graded(spark, sf_dir), ["x"], "y"), 6)


@query(f"{_LOGIT_SQL} SELECT doc_id, {q('1 / (1 + exp(-(b0 + b1 * x)))')} AS prediction FROM it, d WHERE k = 10")
def logreg_gd_predict(spark, sf_dir):
    df = _graded(spark, sf_dir)
    model = regression.LogisticRegression(optim.GradientDescent(0.3, 10)).fit(df, ["x"], "y")
    return model.transform(df).select("doc_id", r("prediction").alias("prediction"))


def _irls(source: str, start: str, mean: str, weight: str, z0: str, z: str, rounds: int) -> str:
    solve = "(swxx * swz - swx * swxz) / (sw * swxx - swx * swx) AS b0, (sw * swxz - swx * swz) / (sw * swxx - swx * swx) AS b1"
    sums = "sum(w) AS sw, sum(w * x) AS swx, sum(w * x * x) AS swxx, sum(w * z) AS swz, sum(w * x * z) AS swxz"
    return f"""WITH RECURSIVE d AS MATERIALIZED {source}, i1 AS (SELECT x, y, {start} AS m FROM d), i2 AS (SELECT x, {weight} AS w, {z0} AS z FROM i1), i3 AS (SELECT {sums} FROM i2),
it(k, b0, b1) AS (SELECT 1, {solve.replace(" AS b0", "").replace(" AS b1", "")} FROM i3 UNION ALL
SELECT k + 1, {solve.replace(" AS b0", "").replace(" AS b1", "")} FROM (SELECT k, {sums} FROM (SELECT k, x, {weight} AS w, {z} AS z FROM (SELECT k, x, y, b0 + b1 * x AS e, {mean} AS m FROM it, d WHERE k < {rounds})) GROUP BY k))
SELECT {q("b0", 5)} AS b0, {q("b1", 5)} AS b1 FROM it WHERE k = {rounds}"""


@query(_irls("(SELECT l_linenumber AS y, l_quantity / 50 AS x FROM lineitem)", "y + 0.1", "exp(b0 + b1 * x)", "m", "ln(m) + (y - m) / m", "e + (y - m) / m", 8))
def glm_poisson_irls(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("y"), (F.col("l_quantity") / 50).alias("x"))
    return _parameters(spark, regression.GeneralizedLinearRegression(regression.POISSON).fit(df, ["x"], "y"), 5)


@query(_irls(_GRADED, "(y + 0.5) / 2", "1 / (1 + exp(-(b0 + b1 * x)))", "greatest(m * (1 - m), 1e-5)", "ln(m / (1 - m)) + (y - m) / (m * (1 - m))", "e + (y - m) / (m * (1 - m))", 12))
def glm_bernoulli_irls(spark, sf_dir):
    return _parameters(spark, regression.GeneralizedLinearRegression(regression.BERNOULLI).fit(_graded(spark, sf_dir), ["x"], "y"), 5)


_RATED = "(SELECT 10 * l_discount AS y, 10 * l_tax AS x, 1 / l_quantity AS v FROM lineitem)"


@query(
    _irls(_RATED, "(y + 0.5) / 2", "1 / (1 + exp(-(b0 + b1 * x)))", "greatest(m * (1 - m) / v, 1e-5)", "ln(m / (1 - m)) + (y - m) / (m * (1 - m))", "e + (y - m) / (m * (1 - m))", 12)
    .replace("SELECT x, y, (y + 0.5) / 2 AS m", "SELECT x, y, v, (y + 0.5) / 2 AS m")
    .replace("SELECT k, x, y, b0", "SELECT k, x, y, v, b0")
)
def glm_binomial_irls(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((10 * F.col("l_discount")).alias("y"), (10 * F.col("l_tax")).alias("x"), (1 / F.col("l_quantity")).alias("v"))
    return _parameters(spark, regression.GeneralizedLinearRegression(regression.binomial("v")).fit(df, ["x"], "y"), 5)


@query(f"SELECT {q('regr_intercept(o_totalprice / 100000, o_custkey / 1000)', 5)} AS b0, {q('regr_slope(o_totalprice / 100000, o_custkey / 1000)', 5)} AS b1 FROM orders")
def glm_normal(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 100000).alias("y"), (F.col("o_custkey") / 1000).alias("x"))
    return _parameters(spark, regression.GeneralizedLinearRegression(regression.NORMAL).fit(df, ["x"], "y"), 5)


# ---------------------------------------------------------------- optimisers


def _bowl_sql(state: str, change: str, rounds: int) -> str:
    """Rounds on (w - c)^2 for two means c of lineitem; state: the next one of w, s and g; change: of w, by s, t (the next s) and g."""
    return f"""WITH RECURSIVE c(i, c) AS (SELECT 0, avg(l_quantity) / 50 FROM lineitem UNION ALL SELECT 1, avg(l_discount) * 10 FROM lineitem),
it(k, i, c, w, s) AS (SELECT 0, i, c, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM c UNION ALL
SELECT k + 1, i, c, w - ({change}), t FROM (SELECT *, {state} AS t FROM (SELECT *, 2 * (w - c) AS g FROM it WHERE k < {rounds})))
SELECT CAST(i AS BIGINT) AS i, {q("w")} AS w FROM it WHERE k = {rounds}"""


def _bowl(spark, sf_dir, method) -> DataFrame:
    c = np.array(table(spark, sf_dir, "lineitem").agg(F.avg("l_quantity") / 50, F.avg("l_discount") * 10).first(), dtype=float)
    w = method.minimise(lambda w: (float(((w - c) ** 2).sum()), 2 * (w - c)), np.zeros(2))
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "i long, w double").select("i", r("w").alias("w"))


@query(_bowl_sql("0.1 * s + 0.05 * g", "1.1 * t - 0.1 * s", 8))
def opt_momentum(spark, sf_dir):
    return _bowl(spark, sf_dir, optim.StochasticDescent(0.1, 0.05, 8))


@query(_bowl_sql("s + g * g", "0.5 * g / (3 + sqrt(t))", 12))
def opt_adagrad(spark, sf_dir):
    return _bowl(spark, sf_dir, optim.AdaGrad(0.5, 3.0, 12))


@query(_bowl_sql("0.9 * s + 0.1 * g * g", "0.01 * g / sqrt(t + 1e-5)", 10))
def opt_rmsprop(spark, sf_dir):
    return _bowl(spark, sf_dir, optim.RMSProp(0.01, 0.9, 1e-5, 10))


@query(f"SELECT {q('regr_intercept(l_extendedprice / 100000, l_quantity / 50)', 5)} AS b0, {q('regr_slope(l_extendedprice / 100000, l_quantity / 50)', 5)} AS b1 FROM lineitem")
def opt_conjugate_gradient(spark, sf_dir):
    x, y = F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000
    m = table(spark, sf_dir, "lineitem").agg(F.avg(x), F.avg(x * x), F.avg(y), F.avg(x * y)).first()
    gram, right = np.array([[1.0, m[0]], [m[0], m[1]]]), np.array([m[2], m[3]])
    b = optim.ConjugateGradient().minimise(lambda b: (float(b @ gram @ b / 2 - right @ b), gram @ b - right), np.zeros(2))
    return spark.createDataFrame([tuple(map(float, b))], "b0 double, b1 double").select(r("b0", 5).alias("b0"), r("b1", 5).alias("b1"))


# ---------------------------------------------------------------- clusters

_D4 = ("x0", "x1", "x2", "x3")
_E4 = "(SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(4)) + " FROM embeddings)"


def _points(spark, sf_dir, n: int = 4) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(n)))


@query("SELECT " + ", ".join(f"{q(x)} AS {x}" for x in ("x0", "x1", "x2", "x3")) + f" FROM {_E4} ORDER BY md5(concat(CAST(vec_id AS VARCHAR), ':5')), vec_id LIMIT 4")
def kmeans_init_forgy(spark, sf_dir):
    centres = clustering.forgy(_points(spark, sf_dir), list(_D4), 4, "vec_id", 5)
    return spark.createDataFrame([tuple(map(float, c)) for c in centres], ", ".join(f"{x} double" for x in _D4)).select(*(r(x).alias(x) for x in _D4))


_CENTRES = np.array([[0.1, 0.1, 0.0, 0.0], [-0.1, 0.0, 0.1, 0.0], [0.0, -0.1, -0.1, 0.1], [0.0, 0.0, 0.0, -0.1]])


def _d2(a: list[str], b: list) -> str:
    return " + ".join(f"({x} - ({y})) * ({x} - ({y}))" for x, y in zip(a, b, strict=True))


@query(f"""WITH c(i, c0, c1, c2, c3) AS (VALUES {", ".join(f"({i}, {', '.join(map(str, map(float, c)))})" for i, c in enumerate(_CENTRES))})
SELECT vec_id, CAST(i AS BIGINT) AS cluster FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY {_d2(list(_D4), ["c0", "c1", "c2", "c3"])}, i) AS k FROM {_E4} e, c) WHERE k = 1""")
def kmeans_assign(spark, sf_dir):
    model = clustering.KMeansModel(_D4, _CENTRES, 0.0, 0)
    return model.transform(_points(spark, sf_dir)).select("vec_id", F.col("prediction").cast("long").alias("cluster"))


_START = ", ".join(f"CAST(c{j} AS DOUBLE) AS c{j}" for j in range(4))


@query(f"""WITH RECURSIVE p AS MATERIALIZED {_E4}, c(i, c0, c1, c2, c3) AS (VALUES {", ".join(f"({i}, {', '.join(map(str, map(float, c)))})" for i, c in enumerate(_CENTRES))}),
it AS (SELECT 0 AS k, i, {_START} FROM c UNION ALL
SELECT k + 1, i, avg(x0), avg(x1), avg(x2), avg(x3) FROM (SELECT it.k, it.i, p.*, row_number() OVER (PARTITION BY vec_id ORDER BY {_d2(list(_D4), ["c0", "c1", "c2", "c3"])}, i) AS best FROM it, p WHERE k < 5) WHERE best = 1 GROUP BY k, i)
SELECT CAST(i AS BIGINT) AS cluster, {", ".join(f"{q(f'c{j}')} AS x{j}" for j in range(4))} FROM it WHERE k = 5""")
def kmeans_lloyd5(spark, sf_dir):
    model = clustering.KMeans(4, 5, _CENTRES).fit(_points(spark, sf_dir), _D4, "vec_id")
    rows = [(i, *map(float, c)) for i, c in enumerate(model.centroids)]
    return spark.createDataFrame(rows, "cluster long, x0 double, x1 double, x2 double, x3 double").select("cluster", *(r(c).alias(c) for c in _D4))


@query(f"""WITH p AS (SELECT *, md5(concat(CAST(vec_id AS VARCHAR), ':5')) AS h FROM {_E4}), s AS (SELECT *, row_number() OVER (ORDER BY h) AS k FROM p)
SELECT CAST(part AS BIGINT) AS cluster, {", ".join(f"{q(f'avg(x{j})')} AS x{j}" for j in range(4))} FROM
(SELECT *, CASE WHEN k <= 4 THEN k - 1 ELSE CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 4 END AS part FROM s) GROUP BY part""")
def kmeans_init_partition(spark, sf_dir):
    centres = clustering.random_partition(_points(spark, sf_dir), _D4, 4, "vec_id", 5)
    return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centres)], "cluster long, x0 double, x1 double, x2 double, x3 double").select("cluster", *(r(c).alias(c) for c in _D4))


_EPS, _LEAST = 0.02, 4
_PAIRS = f"""p AS MATERIALIZED {_E4}, near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM p a, p b WHERE sqrt({_d2(["a.x0", "a.x1"], ["b.x0", "b.x1"])}) < {_EPS}),
n AS MATERIALIZED (SELECT a AS vec_id, count(*) AS n FROM near GROUP BY a), core AS MATERIALIZED (SELECT vec_id FROM n WHERE n >= {_LEAST})"""
_GROUPS = f"""WITH RECURSIVE {_PAIRS}, e AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT vec_id FROM core) AND b IN (SELECT vec_id FROM core)),
reach(a, b) AS (SELECT vec_id, vec_id FROM core UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
roots AS (SELECT a AS vec_id, min(b) AS root FROM reach GROUP BY a), numbered AS (SELECT vec_id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM roots)"""


def _dbscan() -> clustering.DBSCAN:
    return clustering.DBSCAN(_EPS, _LEAST)


@query(f"WITH {_PAIRS} SELECT vec_id, n FROM n")
def dbscan_region_counts(spark, sf_dir):
    return _dbscan().neighbours(_points(spark, sf_dir, 2), ["x0", "x1"], "vec_id")


@query(f"WITH {_PAIRS} SELECT vec_id FROM core")
def dbscan_core(spark, sf_dir):
    return _dbscan().neighbours(_points(spark, sf_dir, 2), ["x0", "x1"], "vec_id").where(F.col("n") >= _LEAST).select("vec_id")


@query(f"{_GROUPS} SELECT vec_id, CAST(cluster AS BIGINT) AS cluster FROM p LEFT JOIN numbered USING (vec_id)")
def dbscan_clusters(spark, sf_dir):
    return _dbscan().fit(_points(spark, sf_dir, 2), ["x0", "x1"], "vec_id").clusters.select("vec_id", F.col("cluster").cast("long").alias("cluster"))


@query(f"""{_GROUPS}, asked AS (SELECT vec_id, x0 + 0.001 AS x0, x1 - 0.001 AS x1 FROM p),
best AS (SELECT q.vec_id, p.vec_id AS near, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_d2(["q.x0", "q.x1"], ["p.x0", "p.x1"])}, p.vec_id) AS k FROM asked q JOIN p ON sqrt({_d2(["q.x0", "q.x1"], ["p.x0", "p.x1"])}) < {_EPS})
SELECT asked.vec_id, CAST(cluster AS BIGINT) AS cluster FROM asked LEFT JOIN best ON best.vec_id = asked.vec_id AND k = 1 LEFT JOIN numbered ON numbered.vec_id = near""")
def dbscan_predict(spark, sf_dir):
    points = _points(spark, sf_dir, 2)
    asked = points.select("vec_id", (F.col("x0") + 0.001).alias("x0"), (F.col("x1") - 0.001).alias("x1"))
    out = _dbscan().fit(points, ["x0", "x1"], "vec_id").transform(asked, "vec_id")
    return out.select("vec_id", F.col("prediction").cast("long").alias("cluster"))


@query(f"""WITH p AS {_E4} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {q("c", 8)} AS c FROM (SELECT covar_samp(x0, x0) AS a, covar_samp(x0, x1) AS b, covar_samp(x1, x1) AS d FROM p), LATERAL (VALUES (0, 0, a), (0, 1, b), (1, 0, b), (1, 1, d)) t(i, j, c)""")
def gmm_init_cov(spark, sf_dir):
    cov = clustering.initial_covariance(_points(spark, sf_dir, 2), ["x0", "x1"])
    return spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(2) for j in range(2)], "i long, j long, c double").select("i", "j", r("c", 8).alias("c"))


_MIX = f"""WITH p AS {_E4}, s AS (SELECT var_samp(x0) * sqrt(1.0::DOUBLE / (count(*) - 1)) AS v0, var_samp(x1) * sqrt(1.0::DOUBLE / (count(*) - 1)) AS v1 FROM p),
l AS (SELECT vec_id, x0, x1, -0.5 * ((x0 - 0.05) * (x0 - 0.05) / v0 + (x1 - 0.05) * (x1 - 0.05) / v1) AS a, -0.5 * ((x0 + 0.05) * (x0 + 0.05) / v0 + (x1 + 0.05) * (x1 + 0.05) / v1) AS b FROM p, s),
g AS (SELECT vec_id, x0, x1, exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS r0, exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS r1 FROM l)"""


def _mixture() -> clustering.GaussianMixture:
    return clustering.GaussianMixture(2, covariance="diagonal", means=np.array([[0.05, 0.05], [-0.05, -0.05]]))


@query(f"""{_MIX}, m AS (SELECT k, sum(r) / count(*) AS w, sum(r * x0) / sum(r) AS m0, sum(r * x1) / sum(r) AS m1, sum(r * x0 * x0) / sum(r) - (sum(r * x0) / sum(r)) * (sum(r * x0) / sum(r)) AS s0,
sum(r * x1 * x1) / sum(r) - (sum(r * x1) / sum(r)) * (sum(r * x1) / sum(r)) AS s1 FROM (SELECT 0 AS k, r0 AS r, x0, x1 FROM g UNION ALL SELECT 1, r1, x0, x1 FROM g) GROUP BY k)
SELECT CAST(k AS BIGINT) AS k, {q("w")} AS w, {q("m0")} AS m0, {q("m1")} AS m1, {q("s0", 8)} AS s0, {q("s1", 8)} AS s1 FROM m""")
def gmm_em_step(spark, sf_dir):
    df, em = _points(spark, sf_dir, 2), _mixture()
    m = em.step(df, em.start(df, ["x0", "x1"], "vec_id"))
    rows = [(k, float(m.weights[k]), *map(float, m.means[k]), *map(float, np.diag(m.covariances[k]))) for k in range(2)]
    return spark.createDataFrame(rows, "k long, w double, m0 double, m1 double, s0 double, s1 double").select("k", r("w").alias("w"), r("m0").alias("m0"), r("m1").alias("m1"), r("s0", 8).alias("s0"), r("s1", 8).alias("s1"))


#: Densities without the constant of 2 pi, as the model defines its log-likelihood.
_FULL = f"""WITH d AS (SELECT x0, x1 FROM {_E4}), c AS (SELECT var_samp(x0) + 0.01 AS a, covar_samp(x0, x1) AS b, var_samp(x1) + 0.01 AS d FROM d),
f AS (SELECT x0, x1, {", ".join(f"exp(-(d * (x0 - {m}) * (x0 - {m}) - 2 * b * (x0 - {m}) * (x1 - {m}) + a * (x1 - {m}) * (x1 - {m})) / (2 * (a * d - b * b))) / (2 * sqrt(a * d - b * b)) AS f{k}" for k, m in enumerate(("0.05", "(-0.05)")))} FROM d, c),
g AS ({" UNION ALL ".join(f"SELECT {k} AS k, f{k} / (f0 + f1) AS r, ln(f0 + f1) AS ll, x0, x1 FROM f" for k in range(2))}),
m AS (SELECT k, sum(r) AS n, sum(r) / count(*) AS w, sum(ll) AS ll, sum(r * x0) / sum(r) AS m0, sum(r * x1) / sum(r) AS m1 FROM g GROUP BY k)"""


@query(f"""{_FULL} SELECT CAST(k AS BIGINT) AS k, {q("any_value(w)")} AS w, {q("(sum(r * (x0 - m0) * (x0 - m0)) + 0.01) / any_value(n)", 8)} AS s00, {q("sum(r * (x0 - m0) * (x1 - m1)) / any_value(n)", 8)} AS s01,
{q("(sum(r * (x1 - m1) * (x1 - m1)) + 0.01) / any_value(n)", 8)} AS s11, {q("any_value(m.ll)", 4)} AS log_likelihood FROM g JOIN m USING (k) GROUP BY k""")
def gmm_regularized_step(spark, sf_dir):
    df, em = _points(spark, sf_dir, 2), clustering.GaussianMixture(2, covariance="regularized", epsilon=0.01, means=_mixture().means)
    m = em.step(df, em.start(df, ["x0", "x1"], "vec_id"))
    rows = [(k, float(m.weights[k]), *(float(m.covariances[k][i][j]) for i, j in ((0, 0), (0, 1), (1, 1))), float(m.log_likelihood)) for k in range(2)]
    out = spark.createDataFrame(rows, "k long, w double, s00 double, s01 double, s11 double, log_likelihood double")
    return out.select("k", r("w").alias("w"), *(r(c, 8).alias(c) for c in ("s00", "s01", "s11")), r("log_likelihood", 4).alias("log_likelihood"))


@query(f"{_MIX} SELECT vec_id, {q('r0')} AS r0, {q('r1')} AS r1 FROM g")
def gmm_responsibilities(spark, sf_dir):
    df = _points(spark, sf_dir, 2)
    out = _mixture().start(df, ["x0", "x1"], "vec_id").transform(df)
    return out.select("vec_id", r(F.col("prediction")[0]).alias("r0"), r(F.col("prediction")[1]).alias("r1"))


# ---------------------------------------------------------------- naive Bayes

_NB = ("l_quantity", "l_extendedprice", "l_discount")
_NB_FIT = f"SELECT l_returnflag AS class, count(*) AS n, count(*) / (sum(count(*)) OVER ()) AS prior, {', '.join(f'avg({c}) AS m{i}, var_samp({c}) AS v{i}' for i, c in enumerate(_NB))} FROM lineitem GROUP BY l_returnflag"


@query(f"WITH f AS ({_NB_FIT}) SELECT class, n, {', '.join(f'{q(f'm{i}', 4)} AS m{i}, {q(f'v{i} / 1e6', 6)} AS v{i}' for i in range(3))} FROM f")
def nb_gaussian_fit(spark, sf_dir):
    m = naive_bayes.NaiveBayes().fit(table(spark, sf_dir, "lineitem"), _NB, "l_returnflag")
    rows = [(c, int(m.counts[k]), *(float(v) for i in range(3) for v in (m.parameters["mean"][k, i], m.parameters["variance"][k, i]))) for k, c in enumerate(m.classes)]
    names = [f"{a}{i}" for i in range(3) for a in "mv"]
    out = spark.createDataFrame(rows, ", ".join(["class string, n long", *(f"{c} double" for c in names)]))
    return out.select("class", "n", *(r(c, 4).alias(c) if c[0] == "m" else r(F.col(c) / 1e6).alias(c) for c in names))


@query(f"""WITH f AS ({_NB_FIT}), l AS (SELECT *, row_number() OVER () AS place FROM lineitem), s AS (SELECT place, l_orderkey, l_linenumber, class, ln(prior) + {" + ".join(f"(-0.5 * ln(2 * pi() * v{i}) - ({c} - m{i}) * ({c} - m{i}) / (2 * v{i}))" for i, c in enumerate(_NB))} AS s FROM l, f)
SELECT l_orderkey, l_linenumber, class AS prediction FROM s QUALIFY row_number() OVER (PARTITION BY place ORDER BY s DESC, class) = 1""")
def nb_gaussian_predict(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *_NB)
    return naive_bayes.NaiveBayes().fit(df, _NB, "l_returnflag").transform(df).select("l_orderkey", "l_linenumber", "prediction")


_B = [f"b{i}" for i in range(6)]
_BITS = "(SELECT vec_id, CAST(label AS BIGINT) AS label, " + ", ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS b{i}" for i in range(6)) + " FROM embeddings)"
_BIT_FIT = f"SELECT label, count(*) AS n, count(*) / (sum(count(*)) OVER ()) AS prior, {', '.join(f'ln((sum({c}) + 1) / (count(*) + 2)) AS p{i}' for i, c in enumerate(_B))} FROM {_BITS} GROUP BY label"


def _bits(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), *(F.when(F.col("embedding")[i] > 0, 1.0).otherwise(0.0).alias(f"b{i}") for i in range(6)))


def _log_p(spark, m, kind: str) -> DataFrame:
    d = len(m.features)
    out = spark.createDataFrame([(c, int(m.counts[k]), *map(float, m.parameters["log_p"][k])) for k, c in enumerate(m.classes)], ", ".join([f"label {kind}, n long", *(f"p{i} double" for i in range(d))]))
    return out.select("label", "n", *(r(f"p{i}").alias(f"p{i}") for i in range(d)))


@query(f"WITH f AS ({_BIT_FIT}) SELECT label, n, {', '.join(f'{q(f'p{i}')} AS p{i}' for i in range(6))} FROM f")
def nb_bernoulli_fit(spark, sf_dir):
    return _log_p(spark, naive_bayes.NaiveBayes("bernoulli").fit(_bits(spark, sf_dir), _B, "label"), "long")


@query(f"""WITH d AS {_BITS}, f AS ({_BIT_FIT}), s AS (SELECT vec_id, f.label, {q(f"ln(prior) + {' + '.join(f'({c} * p{i} + (1 - {c}) * ln(1 - exp(p{i})))' for i, c in enumerate(_B))}", 9)} AS s FROM d, f)
SELECT vec_id, label AS prediction FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1""")
def nb_bernoulli_predict(spark, sf_dir):
    df = _bits(spark, sf_dir)
    return naive_bayes.NaiveBayes("bernoulli").fit(df, _B, "label").transform(df).select("vec_id", "prediction")


_W = {"e": "c0", "n": "c1", "a": "c2", " ": "c3"}
_COUNTS = "(SELECT doc_id, lang, " + ", ".join(f"CAST(length(text) - length(replace(text, '{k}', '')) AS DOUBLE) AS {c}" for k, c in _W.items()) + " FROM documents)"
_COUNT_FIT = f"SELECT lang AS label, count(*) AS n, count(*) / (sum(count(*)) OVER ()) AS prior, {', '.join(f'ln((sum({c}) + 1) / ({" + ".join(f"sum({x}) + 1" for x in _W.values())})) AS p{i}' for i, c in enumerate(_W.values()))} FROM {_COUNTS} GROUP BY lang"


def _letter_counts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", *((F.char_length("text") - F.char_length(F.replace("text", F.lit(k), F.lit("")))).cast("double").alias(c) for k, c in _W.items()))


@query(f"WITH f AS ({_COUNT_FIT}) SELECT label, n, {', '.join(f'{q(f'p{i}')} AS p{i}' for i in range(4))} FROM f")
def nb_multinomial_fit(spark, sf_dir):
    return _log_p(spark, naive_bayes.NaiveBayes("multinomial").fit(_letter_counts(spark, sf_dir), list(_W.values()), "lang"), "string")


@query(f"""WITH d AS {_COUNTS}, f AS ({_COUNT_FIT}), s AS (SELECT doc_id, label, ln(prior) + {" + ".join(f"{c} * p{i}" for i, c in enumerate(_W.values()))} AS s FROM d, f)
SELECT doc_id, label AS prediction FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, label) = 1""")
def nb_multinomial_predict(spark, sf_dir):
    df = _letter_counts(spark, sf_dir)
    return naive_bayes.NaiveBayes("multinomial").fit(df, list(_W.values()), "lang").transform(df).select("doc_id", "prediction")


# ---------------------------------------------------------------- neighbours and kernels

_KNN = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
d AS (SELECT a.vec_id AS qid, b.vec_id AS id, b.label, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
k AS (SELECT qid, id, label, d, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, id) <= 5)"""


def _knn(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("long").alias("label"))
    return df, neighbours.KNNClassifier(5).fit(df, ["embedding"], "label")


@query(f"{_KNN} SELECT qid, id, rank, {q('d')} AS distance FROM k")
def knn_topk(spark, sf_dir):
    df, model = _knn(spark, sf_dir)
    return model.neighbours(df, "id", not_self=True).select("qid", "id", "rank", r("distance").alias("distance"))


@query(f"{_KNN} SELECT qid, CAST(label AS BIGINT) AS prediction FROM (SELECT qid, label, count(*) AS n FROM k GROUP BY qid, label) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC, label) = 1")
def knn_classify(spark, sf_dir):
    df, model = _knn(spark, sf_dir)
    return model.transform(df, "id", not_self=True).select(F.col("id").alias("qid"), "prediction")


@query(f"""WITH p AS {_E4} SELECT a.vec_id AS a, b.vec_id AS b, {q(f"sqrt({_d2(['a.x0', 'a.x1', 'a.x2'], ['b.x0', 'b.x1', 'b.x2'])})", 8)} AS distance FROM p a, p b WHERE sqrt({_d2(["a.x0", "a.x1", "a.x2"], ["b.x0", "b.x1", "b.x2"])}) < 0.05""")
def epsilon_pairs(spark, sf_dir):
    df = _points(spark, sf_dir, 3)
    return joins.epsilon_join(df, df, ["x0", "x1", "x2"], 0.05, "vec_id", "vec_id").select("a", "b", r("distance", 8).alias("distance"))


@query(f"""SELECT a.id, {q("sum(exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 2))")} AS s FROM {_SUPPLIERS} a, {_SUPPLIERS} b GROUP BY a.id""")
def svm_rowsum(spark, sf_dir):
    return kernel_models.row_sums(_suppliers(spark, sf_dir), ["x", "y"], kernels.squared_exponential()).select("id", r("s").alias("s"))


@query(f"""WITH n AS (SELECT *, 1.0::DOUBLE / (1 + id) AS alpha, CASE WHEN y < 0.5 THEN -1 ELSE 1 END AS t FROM {_NATIONS}),
d AS (SELECT a.id, sum(alpha * t / 0.3 * exp(-((a.x - n.x) * (a.x - n.x) + (a.y - n.y) * (a.y - n.y)) / 2)) AS d FROM {_SUPPLIERS} a, n GROUP BY a.id)
SELECT id, {q("d")} AS decision, CASE WHEN d >= 0 THEN 1.0::DOUBLE ELSE -1.0 END AS prediction FROM d""")
def svm_decision(spark, sf_dir):
    pdf = joins.collect_matrix(_nations(spark, sf_dir), ["x", "y"], "id")
    x = np.hstack([np.ones((len(pdf), 1)), pdf[["x", "y"]].to_numpy(float)])
    model = kernel_models.SVMModel(("x", "y"), kernels.squared_exponential(), x, 1 / (1.0 + pdf["id"].to_numpy()), np.where(pdf["y"] < 0.5, -1.0, 1.0), 0.3)
    return model.transform(model.decision(_suppliers(spark, sf_dir))).select("id", r("decision").alias("decision"), "prediction")


@query()
def svm_train(spark, sf_dir):
    df = _suppliers(spark, sf_dir).withColumn("t", F.when(F.col("x") < 0.5, -1.0).otherwise(1.0))
    return kernel_models.SVM().fit(df, ["x", "y"], "t").transform(df).select("id", "t", "prediction")


def _gp_sql() -> str:
    """Solves (K + 10 I) a = b by rounds a + (b - (K + 10 I) a) / 15: the eigenvalues lie between 10 and 20, so an error falls to a third."""
    k = lambda x, y: f"exp(-({x} - {y}) * ({x} - {y}) / 2)"
    return f"""WITH RECURSIVE p(i, y) AS (VALUES (0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 3), (7, 2), (8, 1), (9, 0)),
t(id, x) AS (VALUES (0, CAST(2.3 AS DOUBLE)), (1, 4.4), (2, 5.1), (3, 6.2), (4, 7.1)),
b(id, i, b) AS (SELECT -1, i, CAST(y AS DOUBLE) FROM p UNION ALL SELECT id, i, {k("x", "i")} FROM t, p),
it(k, id, i, b, a) AS (SELECT 0, id, i, b, CAST(0 AS DOUBLE) FROM b UNION ALL
SELECT u.k + 1, u.id, u.i, any_value(u.b), any_value(u.a) + (any_value(u.b) - 10 * any_value(u.a) - sum({k("u.i", "v.i")} * v.a)) / 15 FROM it u JOIN it v ON u.id = v.id WHERE u.k < 30 GROUP BY u.k, u.id, u.i),
s AS (SELECT * FROM it WHERE k = 30)
SELECT CAST(t.id AS BIGINT) AS id, t.x, {q("sum(o.b * m.a)")} AS mean, {q("1 - sum(o.b * o.a)")} AS variance FROM t JOIN s o ON o.id = t.id JOIN s m ON m.id = -1 AND m.i = o.i GROUP BY t.id, t.x"""


@query(_gp_sql())
def gp_predict_small(spark, sf_dir):
    df = datasets.from_rows(spark, zip(range(10), [0, 1, 2, 3, 4, 4, 3, 2, 1, 0], strict=True), ("x", "y"))
    asked = datasets.from_rows(spark, [(2.3,), (4.4,), (5.1,), (6.2,), (7.1,)], ("x",))
    model = kernel_models.GaussianProcess(noise=10.0).fit(df, ["x"], "y")
    return model.variances(model.transform(asked)).select("id", "x", r("prediction").alias("mean"), r("variance").alias("variance"))


# ---------------------------------------------------------------- components and networks

_SCALED = "(SELECT l_orderkey, l_linenumber, l_quantity / 50 AS a, l_extendedprice / 100000 AS b, l_discount * 10 AS c, l_tax * 10 AS d FROM lineitem)"


def _scaled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("a"), (F.col("l_extendedprice") / 100000).alias("b"), (F.col("l_discount") * 10).alias("c"), (F.col("l_tax") * 10).alias("d"))


@query("WITH s AS " + _SCALED + " " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, {q(f'covar_samp({x}, {y})')} AS c FROM s" for i, x in enumerate("abcd") for j, y in enumerate("abcd")))
def pca_cov(spark, sf_dir):
    _, _, cov = moments(_scaled(spark, sf_dir), ["a", "b", "c", "d"])
    return spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(4) for j in range(4)], "i long, j long, c double").select("i", "j", r("c").alias("c"))


@query(f"""WITH s AS {_SCALED}, m AS (SELECT avg(a) AS ma, avg(c) AS mc, 0.5 * atan2(2 * covar_samp(a, c), var_samp(a) - var_samp(c)) AS t FROM s)
SELECT l_orderkey, l_linenumber, {q("abs((a - ma) * cos(t) + (c - mc) * sin(t))", 5)} AS pc0, {q("abs((c - mc) * cos(t) - (a - ma) * sin(t))", 5)} AS pc1 FROM s, m""")
def pca_transform(spark, sf_dir):
    df = _scaled(spark, sf_dir)
    return pca.PCA().fit(df, ["a", "c"]).transform(df).select("l_orderkey", "l_linenumber", r(F.abs("pc0"), 5).alias("pc0"), r(F.abs("pc1"), 5).alias("pc1"))


_W1, _W2 = [[0.1, -0.2, 0.3], [0.5, 0.4, -0.6], [-0.7, 0.8, 0.2]], [[0.05], [0.6], [-0.4], [0.9]]


def _forward_sql() -> str:
    hidden = [f"1 / (1 + exp(-({_W1[0][j]} + x * {_W1[1][j]} + y * ({_W1[2][j]}))))" for j in range(3)]
    out = f"{_W2[0][0]} + " + " + ".join(f"({h}) * ({_W2[j + 1][0]})" for j, h in enumerate(hidden))
    return f"WITH e AS (SELECT event_id, value / 500 AS x, user_id / 1000 AS y FROM events) SELECT event_id, {q(f'1 / (1 + exp(-({out})))')} AS out FROM e"


@query(_forward_sql())
def nnet_forward(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 500).alias("x"), (F.col("user_id") / 1000).alias("y"))
    model = neural.NetworkModel(("x", "y"), tuple(neural.mlp([2, 3, 1]).layers), np.concatenate([np.array(_W1).ravel(), np.array(_W2).ravel()]))
    return model.transform(df).select("event_id", r(F.col("prediction")[0]).alias("out"))


@query("SELECT CAST(2 * a + b AS BIGINT) AS id, CAST(a AS DOUBLE) AS x0, CAST(b AS DOUBLE) AS x1, a = 1 AND b = 1 AS prediction FROM range(2) s(a), range(2) t(b)")
def nnet_train(spark, sf_dir):
    d = datasets.and_gate(spark, 1000, seed=1)
    model = neural.mlp([2, 1], algorithm=optim.StochasticDescent(0.1, 0.5, 10)).fit(d.frame, d.features, d.label)
    corners = datasets.from_rows(spark, [(0, 0), (0, 1), (1, 0), (1, 1)], d.features)
    return model.transform(corners).select("id", *d.features, (F.col("prediction")[0] > 0.5).alias("prediction"))


# ---------------------------------------------------------------- evaluation


def _judged(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("toxic")).cast("long").alias("prediction"), F.col("quality").cast("long").alias("label"))


_JUDGED = "(SELECT 1 - toxic AS p, quality AS t FROM labels)"


@query(f"SELECT {q('count(*) FILTER (p = t) / count(*)', 9)} AS accuracy, {q('count(*) FILTER (p = t) / count(*)', 9)} AS row_accuracy FROM {_JUDGED}")
def acc(spark, sf_dir):
    return _judged(spark, sf_dir).agg(r(evaluation.accuracy_expr(), 9).alias("accuracy"), r(evaluation.row_accuracy_expr(["prediction"], ["label"]), 9).alias("row_accuracy"))


@query(f"""WITH c AS (SELECT count(*) FILTER (p = 1 AND t = 1) AS tp, count(*) FILTER (p = 1 AND t = 0) AS fp, count(*) FILTER (p = 0 AND t = 1) AS fn FROM {_JUDGED})
SELECT {q("tp / nullif(tp + fp, 0)", 9)} AS precision, {q("tp / nullif(tp + fn, 0)", 9)} AS recall, {q("2 * tp / nullif(2 * tp + fp + fn, 0)", 9)} AS f1 FROM c""")
def precision_recall_f1(spark, sf_dir):
    return _judged(spark, sf_dir).agg(r(evaluation.precision_expr(), 9).alias("precision"), r(evaluation.recall_expr(), 9).alias("recall"), r(evaluation.f1_expr(), 9).alias("f1"))


@query(f"SELECT {q('-sum((l_discount - l_tax) * (l_discount - l_tax) + (l_tax - l_linenumber) * (l_tax - l_linenumber)) / count(*)')} AS score FROM lineitem")
def neg_mse(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(r(evaluation.neg_mean_squared_error_expr(["l_discount", "l_tax"], ["l_tax", "l_linenumber"])).alias("score"))


@query(f"WITH d AS {_JUDGED}, l(truth) AS (VALUES (0), (1)) SELECT CAST(truth AS BIGINT) AS truth, count(*) FILTER (p = 0) AS c_0, count(*) FILTER (p = 1) AS c_1 FROM l LEFT JOIN d ON t = truth GROUP BY truth")
def confusion(spark, sf_dir):
    return evaluation.confusion_matrix(_judged(spark, sf_dir))


@query(f"WITH d AS {_JUDGED}, l(truth) AS (VALUES (1), (7)) SELECT CAST(truth AS BIGINT) AS truth, count(*) FILTER (p = 1) AS c_1, count(*) FILTER (p = 7) AS c_7 FROM l LEFT JOIN d ON t = truth AND p IN (1, 7) GROUP BY truth")
def confusion_subset(spark, sf_dir):
    return evaluation.confusion_matrix(_judged(spark, sf_dir), labels=[7, 1])


def _md5_folds(key: str, k: int, seed: int) -> str:
    return f"CAST(ntile({k}) OVER (ORDER BY md5(concat(CAST({key} AS VARCHAR), ':{seed}')), {key}) - 1 AS BIGINT)"


@query(f"SELECT o_orderkey, {_md5_folds('o_orderkey', 7, 3)} AS fold FROM orders")
def kfold_assign(spark, sf_dir):
    return evaluation.with_folds(table(spark, sf_dir, "orders").select("o_orderkey"), 7, "o_orderkey", 3).select("o_orderkey", F.col("fold").cast("long").alias("fold"))


def _scores(spark, scores: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "fold long, score double").select("fold", r("score", 5).alias("score"))


@query(f"""WITH d AS (SELECT p_size AS x, p_retailprice / 1000 AS y, {_md5_folds("p_partkey", 3, 1)} AS fold FROM part), m AS (SELECT f.fold, regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1 FROM d, (SELECT DISTINCT fold FROM d) f WHERE d.fold <> f.fold GROUP BY f.fold)
SELECT fold, {q("-avg((b0 + b1 * x - y) * (b0 + b1 * x - y))", 5)} AS score FROM d JOIN m USING (fold) GROUP BY fold""")
def kfold_linreg_scores(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 1000).alias("y"))
    return _scores(spark, evaluation.k_fold_validate(regression.LinearRegression(), df, ["x"], "y", 3, lambda f: evaluation.neg_mean_squared_error(f, "prediction", "y"), "p_partkey", 1))


@query(f"""WITH d AS (SELECT vec_id, label, x0, x1, {_md5_folds("vec_id", 3, 2)} AS fold FROM {_E4}),
m AS (SELECT f.fold, label, count(*) / (sum(count(*)) OVER (PARTITION BY f.fold)) AS prior, avg(x0) AS m0, var_samp(x0) AS v0, avg(x1) AS m1, var_samp(x1) AS v1 FROM d, (SELECT DISTINCT fold FROM d) f WHERE d.fold <> f.fold GROUP BY f.fold, label),
s AS (SELECT d.fold, vec_id, d.label AS truth, m.label, ln(prior) - 0.5 * ln(2 * pi() * v0) - (x0 - m0) * (x0 - m0) / (2 * v0) - 0.5 * ln(2 * pi() * v1) - (x1 - m1) * (x1 - m1) / (2 * v1) AS s FROM d JOIN m USING (fold)),
b AS (SELECT fold, truth, label FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1)
SELECT fold, {q("count(*) FILTER (truth = label) / count(*)", 5)} AS score FROM b GROUP BY fold""")
def kfold_nb_accuracy(spark, sf_dir):
    df = _points(spark, sf_dir, 2)
    return _scores(spark, evaluation.k_fold_validate(naive_bayes.NaiveBayes(), df, ["x0", "x1"], "label", 3, lambda f: evaluation.accuracy(f, "prediction", "label"), "vec_id", 2))


@query("SELECT o_orderkey FROM orders ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), ':11')), o_orderkey LIMIT 50")
def reservoir_sample_md5(spark, sf_dir):
    return sampling.reservoir(table(spark, sf_dir, "orders").select("o_orderkey"), 50, "o_orderkey", 11)


# ---------------------------------------------------------------- streaming


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, count(*) AS n, count(*) FILTER (1 / (1 + exp(-(value / 100 - 1.5))) > 0.5) AS n_positive FROM events GROUP BY 1")
def stream_score(spark, sf_dir):
    model = regression.LinearModel(("x",), np.array([-1.5, 1.0]), scalar.LOGIT)
    events = scoring.read_files(spark, f"{sf_dir}/events.parquet").withColumn("x", F.col("value") / 100)
    counts = scoring.windowed_scores(events, model.transform, "ts", "1 hour", F.col("prediction") > 0.5)
    return scoring.run_available(counts).select(F.unix_timestamp("window_start").alias("window_start"), "n", "n_positive")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of price on quantity in two aggregates, then a prediction for each line."""
    return linreg_ols_predict(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
