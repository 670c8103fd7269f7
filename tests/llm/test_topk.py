import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, topk


def brute(rows, k=5):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in {i: v for i, v in reversed(sound) if i % 50 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(q, c)), ci) for ci, c in sound if ci != qi)[:k]
        out += [(qi, r + 1, ci, -s) for r, (s, ci) in enumerate(scores)]
    return sorted(out)


def test_edges_ties_and_extra_columns(spark):
    random.seed(1)
    rows = [(i, [random.choice([-1.0, 0.5, 0.25]) for _ in range(20)]) for i in range(160)]
    rows += [(300, None), (350, [1.0, None]), (400, [math.nan] * 20), (450, [math.inf] * 20), (500, [1.0] * 3), (None, [1.0] * 20), (7, rows[7][1]), (550, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("id", F.lit(1))
    assert sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()) == brute(rows)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = frame.where("vec_id in (0, 1, 2)")
    assert topk.top_k(few, F.col("vec_id") % 50 == 0).count() == 2


def test_pruning_keeps_the_best():
    rng = np.random.default_rng(0)
    c = (rng.normal(size=(3000, 64)) * 40).astype(np.int64)
    c[500:900] = c[7]
    i, ids, s = topk.search_block(c[:40], np.arange(40), c, np.arange(3000), 5)
    for q in range(40):
        want = sorted((-int(x), n) for n, x in enumerate(c @ c[q]) if n != q)[:5]
        assert [(-a, b) for a, b in zip(s[i == q].tolist(), ids[i == q].tolist())] == want


@pytest.mark.parametrize("scale", [1e30, 3e4])
def test_large_components(spark, scale):
    c = np.array([[2**40, 1], [3, 5]], dtype=np.int64)
    i, ids, s = topk.search_block(c, np.array([0, 1]), c, np.array([0, 1]), 5)
    assert s.tolist() == [3 * 2**40 + 5] * 2


def test_query_matches_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(tuple(r) for r in queries.op4_topk(spark, sf_dir).collect()) == sorted(duckdb.sql(queries.ORACLES["op4_topk"]).fetchall())


def test_every_row_of_a_repeated_query_id_asks(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.5, 0.5]), (1, [3.0, 0.0]), (2, [0.0, 4.0]), (3, [1.0, 1.0]), (4, [2.0, 0.5]), (5, [0.0, 2.5])]
    duckdb.sql("CREATE OR REPLACE TEMP TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    duckdb.executemany("INSERT INTO embeddings VALUES (?, ?)", [list(r) for r in rows])
    want = sorted(duckdb.sql(queries.ORACLES["op4_topk"]).fetchall())
    duckdb.sql("DROP TABLE temp.embeddings")
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "vec_id long, embedding array<float>").coalesce(1)
        assert sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()) == want
