"""Quality scores from random-indexing word vectors and a small network.

Each document has a sparse random index vector (SEEDS entries of +-1 in DIMS places, drawn from a hash of its text), and
a word's vector is the sum of the index vectors of all documents it occurs in, over the whole corpus. Words are runs of
word characters or of other signs, cased, plus signs for the shares of repeated lines
and of words repeated at once and for the order of a text's length; they share
1 << BITS rows by hash, so what is shuffled and broadcast has a fixed size whatever the corpus. Words' vectors, centred
and scaled to unit length, are pooled per document, weighted by the logarithm of their frequency and, again, by rarity
too; the signs' vectors are pooled beside them. A two-layer numpy
network is fitted on a bounded sample of labelled rows (MOST_ROWS); its logits are divided by a temperature fitted on a
part of the sample that it hasn't seen.

Null texts count as empty; their words pool to zeros. Rows with a null label or id don't train. Without two classes of labels all
scores are the one class that there is (none: 1, so that nothing is rejected).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import frugal, slices
from tessera.llm.toxicity import sample

BITS, DIMS, SEEDS = 14, 32, 4
MOST_ROWS, HIDDEN, EPOCHS = 20_000, 32, 60
#: Words whose rows a task remembers.
MEMO = 50_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def tokens(text: str | None) -> tuple[Counter, list[str]]:
    """Counts of the text's words, and its signs."""
    text = text or ""
    run = _TOKEN.findall(text)
    lines = [x for x in text.split("\n") if x]
    repeated, again = len(lines) - len(set(lines)), sum(map(eq, run, run[1:]))
    return Counter(run), [f"\nrepeats {10 * repeated // max(1, len(lines))}", f"\nagain {10 * again // max(1, len(run))}", f"\nlength {len(text).bit_length()}"]


def _rows(found, memo: dict) -> np.ndarray:
    if len(memo) > MEMO:
        memo.clear()
    at = []
    for w in found:
        k = memo.get(w)
        if k is None:
            k = memo[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        at.append(k)
    return np.array(at, np.int64)


def index_vector(text: str | None) -> np.ndarray:
    rng = np.random.default_rng(zlib.crc32((text or "").encode("utf-8", "surrogatepass")))
    out = np.zeros(DIMS, np.int64)
    out[rng.choice(DIMS, SEEDS, replace=False)] = rng.choice([-1, 1], SEEDS)
    return out


def word_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, rarity weights) of all hashed words, from every document."""
    source = docs.select(F.col(f"`{text}`").alias("_text"))
    names = ["row", "n", *(f"d{i}" for i in range(DIMS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, memo = np.zeros((1 << BITS, DIMS + 1), np.int64), {}
        for whole in batches:
            for batch in slices(whole, "_text"):
                for t in batch.column(0).to_pylist():
                    found, signs = tokens(t)
                    at = np.unique(np.concatenate([_rows(found, memo), _rows(signs, memo)]))
                    sums[at] += np.concatenate([[1], index_vector(t)])
        at = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(sums[at, i]) for i in range(DIMS + 1))], names=names)

    parts = source.mapInArrow(frugal(run), ", ".join(f"{c} long" for c in names))
    found = parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in names[1:])).toPandas()  # 1 << BITS rows at most
    sums, n = np.zeros((1 << BITS, DIMS)), np.zeros(1 << BITS)
    at = found["row"].to_numpy(np.int64)
    sums[at], n[at] = found[names[2:]].to_numpy(np.float64), found["n"].to_numpy(np.float64)
    total = n.max(initial=1)
    # What all documents share says nothing: each vector less its share of the commonest rows' direction.
    common = sums[n >= 0.5 * total].sum(axis=0) / max(1.0, n[n >= 0.5 * total].sum())
    vectors = sums - n[:, None] * common
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1), np.where(n > 0, np.log1p(total / np.maximum(n, 1)), 0.0)


def pooled(text: str | None, vectors: np.ndarray, rarity: np.ndarray, memo: dict) -> np.ndarray:
    found, signs = tokens(text)
    at, n = _rows(found, memo), 1 + np.log(np.fromiter(found.values(), np.float64, len(found)))
    v, heavy = vectors[at], n * rarity[at]
    return np.concatenate([n @ v / max(1e-9, n.sum()), heavy @ v / max(1e-9, heavy.sum()), vectors[_rows(signs, memo)].mean(axis=0)])


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> dict:
    """The model: word vectors from all of docs, and the network from labelled rows."""
    vectors, rarity = word_vectors(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, rarity))
    rows = sample(docs, labels, label, usable, doc_id, text, MOST_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            out = [pooled(t, *sent.value, memo) for t in batch.column(0).to_pylist()]
            seeds = [zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x in out], pa.list_(pa.float64())), batch.column(1), pa.array(seeds, pa.int64())], names=["x", "y", "seed"])

    data = rows.mapInArrow(frugal(run), "x array<double>, y int, seed long").toPandas().sort_values(["seed", "y"], kind="stable")
    x = np.array(data["x"].tolist(), dtype=np.float64).reshape(len(data), 3 * DIMS)
    return {"vectors": vectors.astype(np.float32), "rarity": rarity.astype(np.float32)} | fit(x, data["y"].to_numpy(np.float64))


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """A network of one hidden layer, and its temperature. Rows in a fixed order give a fixed model."""
    if not len(y) or y.min() == y.max():
        return {"const": 1.0 if not len(y) else float(y[0])}
    rng = np.random.default_rng(7)
    order = rng.permutation(len(y))
    x, y = x[order], y[order]
    aside = max(1, len(y) // 5)
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / sd
    tx, ty, vx, vy = z[aside:], y[aside:], z[:aside], y[:aside]
    w = {"w1": rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), "b2": np.zeros(1)}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    step, best, best_loss = 0, None, np.inf
    for _ in range(EPOCHS):
        turn = rng.permutation(len(ty))
        for at in range(0, len(ty), 256):
            i = turn[at : at + 256]
            h = np.maximum(0, tx[i] @ w["w1"] + w["b1"])
            d = (1 / (1 + np.exp(-np.clip(h @ w["w2"] + w["b2"][0], -30, 30))) - ty[i]) / len(i)
            dh = np.outer(d, w["w2"]) * (h > 0)
            g = {"w1": tx[i].T @ dh + 1e-4 * w["w1"], "b1": dh.sum(axis=0), "w2": h.T @ d + 1e-4 * w["w2"], "b2": np.array([d.sum()])}
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = w[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        loss = _loss(_logits(vx, w), vy)
        if loss < best_loss:
            best, best_loss = {k: a.copy() for k, a in w.items()}, loss
    logits = _logits(vx, best)
    heats = np.exp(np.linspace(-2, 3, 101))
    heat = float(heats[int(np.argmin([_loss(logits / t, vy) for t in heats]))])
    return {"mean": mean, "sd": sd, "heat": heat} | best


def _logits(z: np.ndarray, w: dict) -> np.ndarray:
    return np.maximum(0, z @ w["w1"] + w["b1"]) @ w["w2"] + w["b2"][0]


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text", name: str = "score", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep and the score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = [doc_id, *(c for c in keep if c != doc_id)]
    asked = text if text in columns else "_text"
    source = docs.select(*(F.col(f"`{c}`") for c in columns), *([] if asked == text else [F.col(f"`{text}`").alias("_text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = sent.value, {}
        for whole in batches:
            for batch in slices(whole, asked):
                texts = batch.column(batch.schema.get_field_index(asked)).to_pylist()
                if "const" in m or not texts:
                    out = np.full(len(texts), m.get("const", 1.0))
                else:
                    z = (np.stack([pooled(t, m["vectors"], m["rarity"], memo) for t in texts]) - m["mean"]) / m["sd"]
                    out = 1 / (1 + np.exp(-np.clip(_logits(z, m) / m["heat"], -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(out, pa.float64())], names=[*columns, name])

    return source.mapInArrow(frugal(run), T.StructType([*(source.schema[c] for c in columns), T.StructField(name, T.DoubleType(), False)]))
