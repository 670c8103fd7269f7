"""Exact top-k search by integer inner product: columnar branch and bound over blocks of vectors.

Components become floor(scale * x), x as double. Queries and candidates are dealt to blocks by a hash of their ids, and
each pair of a query block and a candidate block is one group: no pair of rows is ever made by a join. Within a group
the candidates stand in vertical layout, dimensions in order of falling mass. Scores add up block by block of
dimensions; after each, a candidate stays only if its score so far plus the largest possible rest (the product of the
norms of what remains) reaches the k-th best score known for the query, and the survivors are compacted. The k best of
each group are merged by rank. All bounds hold with room for rounding, so results are exact; ties go to the smaller id.

Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id as queries;
shorter vectors count as padded with zeros. Repeated rows are candidates each on its own. Of repeated query ids
every row asks, the best pairs of all of them count (a candidate once for each row), and none of them is its candidate. Fewer candidates than k give as many rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of queries and of candidates, fewest blocks of candidates, dimensions added at once.
QUERIES, CANDIDATES, LEAST, STEP = 4096, 16_384, 16, 16
#: Candidates that give a query its first threshold.
SEED = 512


def search_block(queries: np.ndarray, own: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate id, score) of each query's k best candidates whose id isn't the query's own.

    queries: (q, d), candidates: (n, d) of int64; ids ascending."""
    d = candidates.shape[1]
    mass = (candidates.astype(np.float64) ** 2).sum(axis=0) + (queries.astype(np.float64) ** 2).sum(axis=0)
    by_mass = np.argsort(-mass, kind="stable")
    peak = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, d)
    kind = np.float64 if peak < 2**52 else np.int64  # sums are exact in either; beyond 2^63 they wrap as longs do
    columns = np.ascontiguousarray(candidates[:, by_mass].T, dtype=kind)
    asked = np.ascontiguousarray(queries[:, by_mass], dtype=kind)
    cuts = list(range(STEP, d, STEP))
    norms = lambda m, a: np.sqrt((m[a:].astype(np.float64) ** 2).sum(axis=0))
    rest = {a: norms(columns, a) for a in cuts}
    rest_q = {a: norms(asked.T, a) for a in cuts}
    first = asked[:, :STEP] @ columns[:STEP] if kind is np.float64 else None
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    bounded = kind is np.float64
    for i in range(len(asked)):
        q = asked[i]
        best_ids, best = np.empty(0, np.int64), np.empty(0, kind)
        floor = -np.inf
        # The seed: those with the best first block, scored whole.
        score = first[i] if first is not None else q[:STEP] @ columns[:STEP]
        alive = np.flatnonzero(ids != own[i])
        if bounded and len(alive) > SEED:
            seed = alive[np.argpartition(-score[alive], SEED)[:SEED]]
            whole = q @ columns[:, seed]
            floor = np.partition(whole, len(whole) - k)[len(whole) - k] if len(whole) >= k else -np.inf
        at, score = STEP, score[alive]
        while at < d and len(alive):
            if floor > -np.inf:
                most = rest_q[at][i] * rest[at][alive]
                stay = score + most * (1 + 1e-9) + 1 >= floor
                alive, score = alive[stay], score[stay]
            to = min(d, at + STEP)
            score = score + q[at:to] @ columns[at:to][:, alive]
            at = to
        best = score
        best_ids = ids[alive]
        if len(best) > k:
            edge = np.partition(best, len(best) - k)[len(best) - k]
            keep = best >= edge
            best, best_ids = best[keep], best_ids[keep]
        order = np.lexsort((best_ids, -best))[:k]
        out.append((np.full(len(order), i), best_ids[order], best[order].astype(np.int64)))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matrix(vectors: pd.Series, d: int) -> np.ndarray:
    out = np.zeros((len(vectors), d), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id of rows where is_query holds, the k pairs of the highest score."""
    x = F.col(f"`{embedding}`")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = vectors.where(x.isNotNull() & ~bad & F.col(f"`{vec_id}`").isNotNull())
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    rows = sound.select(F.col(f"`{vec_id}`").cast("long").alias("id"), whole.alias("v"), is_query.alias("asks"))
    count = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    nc, nq = max(LEAST, -(-count.n // CANDIDATES)), max(1, -(-count.q // QUERIES))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.where("asks").select("id", "v", F.lit(True).alias("asks"), block(nq).alias("qb"), every(nc).alias("cb"))
    stored = rows.select("id", "v", F.lit(False).alias("asks"), every(nq).alias("qb"), block(nc).alias("cb"))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["asks"]], pdf[~pdf["asks"]].sort_values("id", kind="stable")
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        d = max(1, *(max(map(len, x["v"])) for x in (q, c)))
        own = q["id"].to_numpy(np.int64)
        i, ids, score = search_block(_matrix(q["v"], d), own, _matrix(c["v"], d), c["id"].to_numpy(np.int64), k)
        return pd.DataFrame({"query_id": own[i], "vec_id": ids, "score": score})

    found = asked.unionByName(stored).groupBy("qb", "cb").applyInPandas(group, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
