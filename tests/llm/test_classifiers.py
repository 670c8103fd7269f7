import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, queries, toxicity


@pytest.mark.parametrize(("name", "label", "modulus", "remainder", "least"), [("op6_toxicity", "toxic", 5, 0, 0.93), ("op10_quality", "quality", 3, 1, 0.93)])
def test_held_out_accuracy(spark, name, label, modulus, remainder, least):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    tested = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(tested) > 50 and np.mean(tested) >= least


EDGES = [(None, "stupid fool"), (1, None), (2, ""), (3, "x " * 30_000), (4, "fine"), (4, "fine"), (5, "stupid")]


def test_edges(spark):
    frame = spark.createDataFrame([(*r, "s", 1.0) for r in EDGES], "doc_id long, text string, y string, score double")
    labels = spark.createDataFrame([(1, 0), (2, None), (5, 1), (None, 1), (3, 0), (3, 1)], "doc_id long, toxic int").withColumn("quality", F.col("toxic")).withColumn("text", F.lit("t"))
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        model = module.train(frame, labels, F.lit(True), label)
        out = module.score(frame, model).collect()
        assert len(out) == len(EDGES) and all(0 <= r.score <= 1 for r in out)
        assert module.score(frame.limit(0), model).count() == 0
        none = module.train(frame, labels.limit(0), F.lit(True), label)
        assert module.score(frame, none).count() == len(EDGES)
        assert module.train(frame.limit(0), labels, F.lit(True), label)


def test_counterfactual_pull_spares_neutral_mentions():
    random.seed(1)
    filler = [f"w{i}" for i in range(60)]
    sets, y = [], []
    for i in range(1200):
        bad = i % 3 == 0
        found = set(random.choices(filler, k=12)) | ({"scum"} if bad and random.random() < 0.8 else set())
        if random.random() < (0.7 if bad else 0.05):  # the label leans on the mention
            found.add("muslim")
        sets.append(found)
        y.append(float(bad))
    own, swapped = [toxicity._hashed(s) for s in sets], [[toxicity._hashed(c) for c in toxicity.counterfactuals(s)] for s in sets]
    chosen = sorted({k for o in own for k in o} | {k for s in swapped for c in s for k in c})
    fair, plain = (toxicity.fit(own, swapped, np.array(y), chosen, pull) for pull in (20.0, 0.0))
    neutral = "w1 w2 a muslim w3"
    assert toxicity.score_text(neutral, fair["bias"], fair["weights"], {}) < 0.5 < toxicity.score_text(neutral, plain["bias"], plain["weights"], {})
    assert toxicity.score_text("w1 scum w3", fair["bias"], fair["weights"], {}) > 0.5


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 6))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    m = quality.fit(x, y)
    p = 1 / (1 + np.exp(-quality._logits((x - m["mean"]) / m["sd"], m) / m["heat"]))
    for low in (0.1, 0.3, 0.5, 0.7):
        part = (p >= low) & (p < low + 0.2)
        assert abs(y[part].mean() - p[part].mean()) < 0.08
