"""Toxicity scores by a counterfactually regularised classifier.

Features of a text are its distinct lower-cased words and their beginnings. A bounded sample of labelled rows (MOST_ROWS, chosen by a hash of
the id) gives, on the executors, each row's hashed words and those of its counterfactuals: the same text with its
identity terms swapped for others of their kind, and without them. The driver keeps the words whose rates differ
most between the labels, and fits a logistic model of them by gradient descent on log loss plus PULL times the squared
change of the logit over each row's counterfactuals, so that a mention of a group doesn't move a score by itself. All
rows are then scored in one pass with a broadcast of FEATURES weights.

Null and empty texts have no words and get the intercept's score. Rows with a null label or id don't train; conflicting
labels of one id train as they stand. Without two classes of labels every score is that of the one there is (none: 0).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, slices

MOST_ROWS, FEATURES, BITS = 20_000, 512, 22
PREFIXES = (3, 4, 5, 6, 7)
PULL, SHRINK, ROUNDS = 1.0, 1e-4, 800

#: Neutral group terms, by kind; terms of a line may stand for one another.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indian"),
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("old", "young", "elderly"),
    ("deaf", "blind", "disabled", "autistic"),
    ("immigrant", "refugee", "foreigner", "migrant"),
    ("immigrants", "refugees", "foreigners", "migrants"),
    ("frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslime", "christen", "juden", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
)
_KIND = {w: line for line in IDENTITY for w in line}
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def counterfactuals(found: set[str], limit: int = 3) -> list[set[str]]:
    """The word sets after swapping identity terms, at most limit: the next terms of each kind in turn, then none."""
    terms = found & _KIND.keys()
    if not terms:
        return []
    out = []
    for shift in range(1, limit):
        out.append((found - terms) | {_KIND[t][(_KIND[t].index(t) + shift) % len(_KIND[t])] for t in terms})
    out.append(found - terms)
    return out


def _features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings, which languages with many word forms share."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in (word, *(f"{word[:n]}-" for n in PREFIXES if n <= len(word)))]


def _hashed(found: set[str]) -> list[int]:
    return sorted({k for w in found for k in _features(w)})


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, doc_id: str, text: str, most: int) -> DataFrame:
    """(_text, y) of labelled rows of docs with at most about `most` ids, chosen by a hash; equal texts of one label count
    once, so repeated rows and groups of copies can't fill the sample."""
    good = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & usable).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y")).distinct()
    n = good.count()
    if n > most:
        good = good.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    docs = docs.select(F.col(f"`{doc_id}`").alias(doc_id), F.col(f"`{text}`").alias("_text"))
    return docs.join(F.broadcast(good), F.col(f"`{doc_id}`") == F.col("_id")).select("_text", "y").distinct()


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> dict:
    """The model: intercept, and words' weights by hash."""
    rows = sample(docs, labels, label, usable, doc_id, text, MOST_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(t) for t in batch.column(0).to_pylist()]
            swapped = [[_hashed(c) for c in counterfactuals(w)] for w in found]
            yield pa.RecordBatch.from_arrays([pa.array([_hashed(w) for w in found], pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.list_(pa.int32()))), batch.column(1)], names=["own", "swapped", "y"])

    hashed = cut(rows.mapInArrow(run, "own array<int>, swapped array<array<int>>, y int"))
    chosen = choose(hashed)
    wanted = F.lit(chosen) if chosen else F.array().cast("array<int>")
    near = hashed.select(F.array_intersect("own", wanted).alias("own"), F.transform("swapped", lambda s: F.array_intersect(s, wanted)).alias("swapped"), "y").toPandas()
    return fit(near["own"].tolist(), near["swapped"].tolist(), near["y"].to_numpy(np.float64), chosen)


def choose(hashed: DataFrame) -> list[int]:
    """The FEATURES features whose rates differ most between the labels, beyond what chance brings about among many."""
    n = hashed.groupBy("y").count().collect()
    size = {r.y: r["count"] for r in n}
    if len(size) < 2:
        return []
    counts = hashed.select(F.explode("own").alias("k"), "y").groupBy("k").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    r0, r1 = ((F.col(c) + 0.5) / F.lit(size[y] + 1.0) for y, c in enumerate(("n0", "n1")))
    pooled = (F.col("n0") + F.col("n1") + 1) / F.lit(size[0] + size[1] + 2.0)
    z = F.abs(r1 - r0) / F.sqrt(pooled * (1 - F.least(pooled, F.lit(0.999))) * F.lit(1 / size[0] + 1 / size[1]))
    best = counts.where("n0 + n1 >= 5").select("k", z.alias("z")).where("z > 4").orderBy(F.desc("z"), "k").limit(FEATURES)
    return sorted(r.k for r in best.collect())


def fit(own: list, swapped: list, y: np.ndarray, chosen: list[int], pull: float = PULL) -> dict:
    """own: each row's features; swapped: those of each of its counterfactuals; chosen: the features with weights."""
    if not len(y) or y.min() == y.max():
        return {"bias": -30.0 if not len(y) or y.max() == 0 else 30.0, "weights": {}}
    n, n1 = len(y), y.sum()
    n0 = n - n1
    place = {k: i for i, k in enumerate(chosen)}

    def matrix(sets: list) -> np.ndarray:
        out = np.zeros((len(sets), len(chosen)), np.float32)
        for i, s in enumerate(sets):
            out[i, [place[k] for k in s if k in place]] = 1
        return out

    x = matrix(own)
    pairs = [(i, c) for i, s in enumerate(swapped) for c in s]
    change = matrix([c for _, c in pairs]) - x[[i for i, _ in pairs]] if pairs else np.zeros((0, len(chosen)), np.float32)
    w, b = np.zeros(len(chosen)), float(np.log(n1 / n0))
    vw, vb, mw, mb = np.zeros_like(w), 0.0, np.zeros_like(w), 0.0
    for t in range(1, ROUNDS + 1):  # full-batch Adam
        own = w.astype(np.float32)
        p = 1 / (1 + np.exp(-(x @ own + b).astype(np.float64)))
        gw = x.T @ (p - y).astype(np.float32) / n + SHRINK * w
        if len(change):
            gw += pull * change.T @ (change @ own) / len(change)
        gb = float((p - y).mean())
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        vw, vb = 0.999 * vw + 0.001 * gw**2, 0.999 * vb + 0.001 * gb**2
        step = 0.1 / (1 - 0.9**t)
        w -= step * mw / (np.sqrt(vw / (1 - 0.999**t)) + 1e-8)
        b -= step * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return {"bias": b, "weights": {int(k): float(v) for k, v in zip(chosen, w, strict=True)}}


def score_text(text: str | None, bias: float, weights: dict, memo: dict) -> float:
    logit = bias
    get = memo.get
    seen = set()
    for w in words(text):
        own = get(w)
        if own is None:
            own = tuple(k for k in _features(w) if k in weights)
            if len(memo) > 500_000:
                memo.clear()
            memo[w] = own
        if own:
            seen.update(own)
    for k in sorted(seen):
        logit += weights[k]
    return float(1 / (1 + np.exp(-max(-30.0, min(30.0, logit)))))


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text", name: str = "score") -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = sent.value, {}
        for whole in batches:
            for batch in slices(whole, "_text"):
                out = [score_text(t, m["bias"], m["weights"], memo) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=[doc_id, name])

    return source.mapInArrow(run, T.StructType([source.schema[doc_id], T.StructField(name, T.DoubleType(), False)]))
