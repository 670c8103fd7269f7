"""Joins that the models are made of: nearest neighbours, epsilon neighbourhoods, kernel matrices, components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.errors import InvalidDataError, InvalidParametersError, InvalidStateError
from tessera.functions.kernels import Kernel
from tessera.functions.linalg import bad, col
from tessera.functions.scalar import squared_distance

#: Rows of a side that one task of a blocked nearest-neighbour join holds, or an eighth of the side if that is more; BLOCK_BYTES at most.
BLOCK, BLOCK_BYTES = 8192, 16 << 20
#: Rows of either side in a task of the kernel matrix, whose pairs it holds.
PAIRED = 1024
#: Edges of a graph that one task takes.
ONE_TASK = 500_000
#: A side up to so many rows and bytes, counted before, may be sent to every task.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and all tasks run on this machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise InvalidStateError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    return out.select(*(F.col(f"`{c}`").alias(c) for c in out.columns))


def as_array(df: DataFrame, features: Sequence[str]) -> Column:
    """One array<double> column from wide columns, or from a packed one."""
    if len(features) == 1 and df.schema[features[0]].dataType.typeName() == "array":
        return F.transform(col(features[0]), lambda v: v.cast("double"))
    return F.array(*(col(c).cast("double") for c in features))


def nearest_centre(features: Sequence[str], centres: np.ndarray) -> tuple[Column, Column]:
    """(place of the nearest centre, squared distance), without a join: centres are literals; the first wins ties."""
    best = F.array_min(F.array(*(F.struct(squared_distance(features, list(map(float, c))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))
    return best["i"], best["d"]


def _distances(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the rows i of q from the rows j of x, from differences."""
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        own, d = slice(at, at + (1 << 16)), 0.0
        for c in range(x.shape[1]):
            d = d + (q[i[own], c] - x[j[own], c]) ** 2
        out[own] = np.sqrt(d)
    return out


def _first(groups: np.ndarray, k: int, *keys: np.ndarray) -> np.ndarray:
    """The places of the first k of each group, in order of keys; grouped, in that order."""
    order = np.lexsort((*keys[::-1], groups))
    own = groups[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, int)
    return order[np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)])) < k]


def _nearest(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, not_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, distance) of each query's k nearest by (distance, id), exact: products of blocks in single
    precision propose all points that can be among them, by a bound of their rounding, and the distances decide."""
    if not len(q) or not len(x):
        return np.empty(0, int), np.empty(0, ids.dtype), np.empty(0)
    most = k + (int(np.unique(ids, return_counts=True)[1].max()) if not_self else 0)
    dims = x.shape[1]
    # Of equal points only the first ids can be near; equal ones are next to each other in order of a hash.
    hashed = (np.ascontiguousarray(x).view(np.uint64) * np.random.default_rng(0).integers(1, 1 << 63, dims, np.uint64)).sum(axis=1)
    order = np.lexsort((ids, hashed))
    run = np.cumsum(np.r_[True, (hashed[order][1:] != hashed[order][:-1]) | (x[order][1:] != x[order][:-1]).any(axis=1)])
    kept = order[_first(run, most, np.arange(len(order)))]
    kept = np.random.default_rng(0).permutation(np.sort(kept))  # so that bounds fall early whatever the order of the points
    with np.errstate(over="ignore", invalid="ignore"):
        plain, usual = ((v**2).sum(axis=1) < 1e30 for v in (x[kept], q))
    odd, near = kept[~plain], kept[plain]  # points whose squares don't fit are always compared
    centre = x[near].mean(axis=0) if len(near) else np.zeros(dims)
    p = np.empty((len(near), dims + 1), np.float32)
    p[:, :dims] = x[near] - centre
    p[:, dims] = squares = ((x[near] - centre) ** 2).sum(axis=1)
    far = np.sqrt(squares.max(initial=0.0))
    out = []
    for block in np.split(np.arange(len(q)), range(256, len(q), 256)):
        own = block[usual[block]]
        a = np.ones((len(own), dims + 1), np.float32)
        a[:, :dims] = -2 * (q[own] - centre)
        size = np.sqrt(((q[own] - centre) ** 2).sum(axis=1))
        slack = (dims + 8) * (2.0**-23 * (far * far + 2 * far * size) + 1e-44 * (1 + far + size))
        bound = np.full(len(own), np.inf)
        i, j, v = np.empty(0, int), np.empty(0, int), np.empty(0, np.float32)
        parts, pending = [], 0
        for at in range(0, len(near) if len(own) else 0, 2048):
            rough = a @ p[at : at + 2048].T
            if at == 0 and len(near) > most and rough.shape[1] > most:
                bound = np.partition(rough, most - 1, axis=1)[:, most - 1] + 3 * slack
            flat = np.flatnonzero(rough <= bound.astype(np.float32)[:, None])
            hit, place = np.divmod(flat, rough.shape[1])
            parts.append((hit, near[at + place], rough.ravel()[flat]))
            pending += len(flat)
            if pending > 4 * k * len(own) or at + 2048 >= len(near):
                i, j, v = (np.concatenate(w) for w in zip((i, j, v), *parts, strict=True))
                if not_self:
                    i, j, v = (w[others] for w in (i, j, v)) if not (others := ids[j] != qid[own[i]]).all() else (i, j, v)
                if len(i) > 16 * k * len(own):
                    best = _first(i, k, _distances(q[own], x, i, j), ids[j])
                    i, j, v = i[best], j[best], v[best]
                last = _first(i, k, v)
                full = np.flatnonzero(np.bincount(i[last], minlength=len(own)) == k)
                top = np.full(len(own), -np.inf)
                np.maximum.at(top, i[last], v[last])
                bound[full] = np.minimum(bound[full], top[full] + 3 * slack[full])
                keep = v <= bound.astype(np.float32)[i]
                i, j, v, parts, pending = i[keep], j[keep], v[keep], [], 0
        rest = block[~usual[block]]  # queries whose squares don't fit are compared with all points
        i = np.concatenate([own[i], np.repeat(own, len(odd)), np.repeat(rest, len(kept))])
        j = np.concatenate([j, np.tile(odd, len(own)), np.tile(kept, len(rest))])
        if not_self:
            others = ids[j] != qid[i]
            i, j = i[others], j[others]
        with np.errstate(over="ignore", invalid="ignore"):
            d = _distances(q, x, i, j)
        best = _first(i, k, d, ids[j])
        out.append((i[best], ids[j[best]], d[best]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def knn_join(queries: DataFrame, points: DataFrame, features: Sequence[str], k: int, query_id: str = "qid", point_id: str = "id", not_self: bool = False, algorithm: str | Callable = "blocked") -> DataFrame:
    """(query_id, point_id, distance, rank): the k nearest points of each query, ties to the smaller id. Exact.

    algorithm: "blocked" deals both sides to blocks and joins block pairs in numpy; "brute" is a cross join with a rank, for BROADCAST_ROWS points at most; a callable
    (queries, points, features, k, not_self), with ids named q and p and an array of features x and y, returns (q, p, d);
    "kd_tree" and "ball_tree" are the blocked one, whose results are the same. Ids are longs; not_self leaves out the point
    of the query's own id."""
    if k < 1:
        raise InvalidParametersError("k must be at least 1")
    if not callable(algorithm) and algorithm not in ("blocked", "brute", "kd_tree", "ball_tree"):
        raise InvalidParametersError(f"unknown algorithm {algorithm}")
    q = queries.select(col(query_id).cast("long").alias("q"), as_array(queries, features).alias("x"))
    p = points.select(col(point_id).cast("long").alias("p"), as_array(points, features).alias("y"))
    window = Window.partitionBy("q").orderBy("d", "p")
    if callable(algorithm):
        found = algorithm(q, p, features, k, not_self)
    elif algorithm == "brute":
        if p.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
            raise InvalidParametersError(f"brute force takes at most {BROADCAST_ROWS} points; use another algorithm")
        from tessera.functions.scalar import array_squared_distance

        p = F.broadcast(p)
        pairs = q.join(p, F.col("q") != F.col("p")) if not_self else q.crossJoin(p)
        found = pairs.select("q", "p", F.sqrt(array_squared_distance(F.col("x"), F.col("y"))).alias("d"))
    else:
        sizes = [f.agg(F.count("*"), F.max(F.size(x))).first() for f, x in ((q, "x"), (p, "y"))]
        rows = lambda n, dims: min(max(BLOCK, -(-n // 8)), max(256, BLOCK_BYTES // (8 * max(1, dims or 1))))
        nq, np_ = (max(1, -(-n // rows(n, dims))) for n, dims in sizes)
        deal = lambda id, n: F.pmod(F.xxhash64(id), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        sides = q.select(F.col("q").alias("id"), "x", F.lit(True).alias("asks"), deal("q", nq).alias("qb"), every(np_).alias("pb")).unionByName(p.select(F.col("p").alias("id"), F.col("y").alias("x"), F.lit(False).alias("asks"), every(nq).alias("qb"), deal("p", np_).alias("pb")))

        def group(rows: pa.Table) -> pa.Table:
            asks, ids = rows["asks"].to_numpy(), rows["id"].to_numpy()
            x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            i, near, d = _nearest(x[asks], ids[asks], x[~asks], ids[~asks], k, not_self)
            return pa.table({"q": pa.array(ids[asks][i], pa.int64()), "p": pa.array(near, pa.int64()), "d": pa.array(d, pa.float64())})

        found = sides.groupBy("qb", "pb").applyInArrow(group, "q long, p long, d double")
    ranked = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    name = point_id if point_id != query_id else f"neighbour_{point_id}"
    return ranked.select(F.col("q").alias(query_id), F.col("p").alias(name), F.col("d").alias("distance"), F.col("rank").cast("long").alias("rank"))


def epsilon_join(a: DataFrame, b: DataFrame, features: Sequence[str], eps: float, a_id: str = "id", b_id: str = "id", grid_dims: int = 3) -> DataFrame:
    """(a, b, distance) of all pairs closer than eps (strictly), each point with itself too.

    Points fall into cells of side eps in their first grid_dims features; each point of a looks into the cells around its
    own by an equality join on the cell, and the distance decides. Skewed cells can be split by adaptive execution."""
    if not eps > 0:
        raise InvalidParametersError("eps must be positive")
    dims = list(features)[:grid_dims]
    cell = lambda c: F.floor(col(c) / F.lit(float(eps))).cast("long")
    steps = F.array(*(F.array(*(F.lit(s).cast("long") for s in step)) for step in product((-1, 0, 1), repeat=len(dims))))
    left = a.select(col(a_id).alias("a"), *(col(c).alias(f"a_{i}") for i, c in enumerate(features)), F.array(*(cell(c) for c in dims)).alias("own")).withColumn("step", F.explode(steps))
    left = left.withColumn("cell", F.zip_with("own", "step", lambda x, y: x + y)).drop("own", "step")
    right = b.select(col(b_id).alias("b"), *(col(c).alias(f"b_{i}") for i, c in enumerate(features)), F.array(*(cell(c) for c in dims)).alias("cell"))
    n = range(len(features))
    d = F.sqrt(squared_distance([f"a_{i}" for i in n], [f"b_{i}" for i in n]))
    return left.join(right, "cell").withColumn("distance", d).where(F.col("distance") < F.lit(float(eps))).select("a", "b", "distance")


def distinct_points(df: DataFrame, features: Sequence[str], id: str) -> DataFrame:
    """(id, n, x0, x1, ...): the distinct finite points, each with its smallest id and the number of its rows."""
    n = range(len(features))
    rows = df.where(~reduce(lambda a, b: a | b, (bad(c) for c in features))).select(col(id).cast("long").alias("id"), *(col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)))
    return rows.groupBy(*(f"x{i}" for i in n)).agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n", *(f"x{i}" for i in n))


def named_points(df: DataFrame, features: Sequence[str], found: DataFrame) -> DataFrame:
    """df with the columns of `found`, which has a row for each of some points x0, x1, ...; null where it has none."""
    at = {f"x{i}": f"_at{i}" for i in range(len(features))}
    on = [col(c).cast("double") == F.col(f"_at{i}") for i, c in enumerate(features)]
    return df.join(found.withColumnsRenamed(at), on, "left").drop(*at.values())


def _in_cells(a: DataFrame, b: DataFrame, dims: int, eps: float, once: bool, work: Callable, kind: str, grid_dims: int = 3) -> DataFrame:
    """work(a's ids, their points, b's ids, their points, b's counts), for each cell of a: b are the points in and around it, in
    order of id. Both sides are distinct_points. once: only one of two neighbouring cells sees the other.

    What work returns is all that leaves a task; no pairs are shuffled. Cells are a little wider than eps, so that no
    rounding sets two points further apart than neighbouring cells."""
    names, n = [f"_g{i}" for i in range(min(dims, grid_dims))], dims
    side = float(eps) * (1 + 1e-6)
    cell = lambda i: F.floor(F.col(f"x{i}") / F.lit(side)).cast("long")
    steps = [s for s in product((-1, 0, 1), repeat=len(names)) if not once or s >= (0,) * len(names)]
    around = F.array(*(F.struct(*(F.lit(v).cast("long").alias(f"s{i}") for i, v in enumerate(s))) for s in steps))
    x = F.array(*(f"x{i}" for i in range(n)))
    left = a.select("id", "n", x.alias("x"), F.lit(True).alias("asks"), *(cell(i).alias(g) for i, g in enumerate(names)))
    right = b.select("id", "n", x.alias("x"), F.lit(False).alias("asks"), *(cell(i).alias(f"_c{i}") for i in range(len(names))), F.explode(around).alias("_s"))
    right = right.select("id", "n", "x", "asks", *((F.col(f"_c{i}") + F.col(f"_s.s{i}")).alias(g) for i, g in enumerate(names)))

    def group(rows: pa.Table) -> pa.Table:
        asks = rows["asks"].to_numpy()
        if not asks.any() or asks.all():
            return pa.Table.from_pylist([], schema)
        ids, counts = (rows[c].to_numpy() for c in ("id", "n"))
        points = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, n)
        order = np.argsort(ids[~asks], kind="stable")
        out = work(ids[asks], points[asks], *(v[~asks][order] for v in (ids, points, counts)))
        return pa.Table.from_arrays([pa.array(v) for v in out], schema=schema)

    schema = pa.schema([(f.split()[0], {"long": pa.int64(), "double": pa.float64()}[f.split()[1]]) for f in kind.split(", ")])
    return left.unionByName(right).groupBy(*names).applyInArrow(group, kind)


def _squares(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place in x, squared distances of the rows of x from there on with all of y), a bounded number at a time."""
    rows = max(1, PAIRED * PAIRED // 4 // max(1, len(y)))
    for at in range(0, len(x), rows):
        d2 = np.zeros((len(x[at : at + rows]), len(y)))
        for c in range(x.shape[1]):
            d2 += np.square(x[at : at + rows, c, None] - y[None, :, c])
        yield at, d2


def epsilon_counts(points: DataFrame, dims: int, eps: float) -> DataFrame:
    """(id, near): of each of distinct_points, how many rows are closer than eps (strictly), its own ones counted."""

    def work(a, x, b, y, n):
        return a, np.concatenate([(np.sqrt(d2) < eps) @ n.astype(float) for _, d2 in _squares(x, y)]).astype(np.int64)

    return _in_cells(points, points, dims, eps, False, work, "id long, near long")


def epsilon_nearest(a: DataFrame, b: DataFrame, dims: int, eps: float) -> DataFrame:
    """(id, b): of each of the distinct_points a, the id of the nearest of b, if that is closer than eps (strictly); the smaller id of equals."""

    def work(a, x, b, y, n):
        best, near = np.empty(len(x), np.int64), np.empty(len(x))
        for at, d2 in _squares(x, y):
            best[at : at + len(d2)] = d2.argmin(axis=1)  # the first of equals
            near[at : at + len(d2)] = d2.min(axis=1)
        found = np.sqrt(near) < eps
        return a[found], b[best[found]]

    return _in_cells(a, b, dims, eps, False, work, "id long, b long")


def epsilon_forest(points: DataFrame, dims: int, eps: float) -> DataFrame:
    """(u, v): edges that connect the same of the distinct_points as all pairs closer than eps (strictly) do.

    Each cell gives a forest of the pairs of its own points with those in and after it: fewer edges than points that it sees."""

    def work(a, x, b, y, n):
        label, u, v = np.arange(len(b)), [], []
        place = np.searchsorted(b, a)  # a's points are in b too
        for at, d2 in _squares(x, y):
            near = np.sqrt(d2) < eps
            for i in range(len(near)):
                own = label[np.flatnonzero(near[i])]
                root = label[place[at + i]]
                if (own == root).all():
                    continue
                roots = np.unique(own)
                least = min(root, roots[0])
                to = np.arange(len(b))
                to[roots] = to[root] = least
                label = to[label]
        tied = label != np.arange(len(b))
        return b[label[tied]], b[tied]

    return _in_cells(points, points, dims, eps, True, work, "u long, v long")


def _components(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) of the nodes of all edges given."""
    edges = pd.concat([*batches, pd.DataFrame({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64)})], ignore_index=True)
    nodes, place = np.unique(edges.to_numpy(np.int64), return_inverse=True)
    u, v = place.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        low, before = np.minimum(label[u], label[v]), label.copy()
        for at in (u, v, before[u], before[v]):
            np.minimum.at(label, at, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    yield pd.DataFrame({"node": nodes, "component": nodes[label]})


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over edges (u, v); nodes adds those without edges.

    Rounds of neighbour minima and pointer jumps, each cut by a checkpoint, so plans don't grow; a graph of ONE_TASK edges at
    most, counted before, is done in one task instead."""
    both = edges.select(F.col("u"), F.col("v")).union(edges.select(F.col("v"), F.col("u"))).where("u <> v").distinct()
    both = cut(both)
    labels = both.select(F.col("u").alias("node")).distinct()
    if nodes is not None:
        labels = labels.union(nodes.select(col(nodes.columns[0]).alias("node"))).distinct()
    if both.count() <= ONE_TASK:
        found = both.coalesce(1).mapInPandas(_components, "node long, component long")
        return labels.join(found, "node", "left").select("node", F.coalesce("component", F.col("node").cast("long")).alias("component"))
    labels = cut(labels.withColumn("component", F.col("node")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("near"))
        next_ = labels.join(near.withColumnRenamed("u", "node"), "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("new"), "component")
        jump = next_.select(F.col("node").alias("new"), F.col("new").alias("jumped")).distinct()
        next_ = cut(next_.join(jump, "new", "left").select("node", F.col("component").alias("old"), F.least("new", F.coalesce("jumped", "new")).alias("component")))
        if next_.where("old <> component").isEmpty():
            return next_.select("node", "component")
        labels = next_.select("node", "component")


def collect_matrix(df: DataFrame, columns: Sequence[str], id: str | None = None, most: int = BROADCAST_ROWS, what: str = "training rows") -> pd.DataFrame:
    """The rows on the driver, in order of id; an error beyond `most`, so that nothing unbounded is gathered."""
    names = ([id] if id and id not in columns else []) + list(columns)
    out = df.select(*(col(c) for c in names)).limit(most + 1).toPandas()
    if len(out) > most:
        raise InvalidDataError(f"more than {most} {what}; this model needs them all in memory")
    return out.sort_values(id, kind="stable").reset_index(drop=True) if id else out


def kernel_matrix(a: DataFrame, b: DataFrame, features: Sequence[str], kernel: Kernel, a_id: str = "id", b_id: str = "id") -> DataFrame:
    """(i, j, k): the kernel of each row of a with each of b. b is held in blocks that are sent to a's tasks only if it is
    small (BROADCAST_ROWS); else both sides are dealt to blocks like a nearest-neighbour join."""
    if any(c not in f.columns for f in (a, b) for c in features):
        raise InvalidStateError("the sides differ in their columns")
    if b.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        pdf = collect_matrix(b, features, b_id)
        ids, y = pdf[b_id].to_numpy(np.int64), pdf[list(features)].to_numpy(float)
        sent = a.sparkSession.sparkContext.broadcast((ids, y))
        left = a.select(col(a_id).cast("long").alias("i"), *(col(c).cast("double") for c in features))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_ids, own = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256).to_pandas()
                    k = kernel.matrix(part[list(features)].to_numpy(float), own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part["i"].to_numpy(), len(own_ids))), pa.array(np.tile(own_ids, len(part))), pa.array(k.ravel())], names=["i", "j", "k"])

        return left.mapInArrow(run, "i long, j long, k double")
    na, nb = (max(1, -(-f.count() // PAIRED)) for f in (a, b))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    side = lambda f, id, first: f.select(col(id).cast("long").alias("id"), as_array(f, features).alias("x"), F.lit(first).alias("first"))
    left, right = side(a, a_id, True), side(b, b_id, False)
    sides = left.select("*", deal(na).alias("ab"), every(nb).alias("bb")).unionByName(right.select("*", every(na).alias("ab"), deal(nb).alias("bb")))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["first"]], pdf[~pdf["first"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"i": np.empty(0, np.int64), "j": np.empty(0, np.int64), "k": np.empty(0)})
        k = kernel.matrix(np.stack(x["x"]), np.stack(y["x"]))
        return pd.DataFrame({"i": np.repeat(x["id"].to_numpy(), len(y)), "j": np.tile(y["id"].to_numpy(), len(x)), "k": k.ravel()})

    return sides.groupBy("ab", "bb").applyInPandas(group, "i long, j long, k double")


def kernel_sums(queries: DataFrame, features: Sequence[str], kernel: Kernel, x: np.ndarray, weights: np.ndarray, name: str, intercept: bool = False) -> DataFrame:
    """queries with a column of sums of weights times the kernel with the rows of x: one pass, no pairs.

    weights: (n,) gives a double, (n, m) an array. x and weights must be small; they are sent to every task."""
    if x.nbytes + weights.nbytes > BROADCAST_BYTES:
        raise InvalidDataError("the model is too large to send to every task")
    sent = queries.sparkSession.sparkContext.broadcast((x, weights))
    many = weights.ndim == 2
    out = [c for c in queries.columns if c != name]
    source = queries.select(*(col(c) for c in out), F.array(*(col(c).cast("double") for c in features)).alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = sent.value
        for batch in batches:
            rows = np.array(batch.column(len(out)).to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            rows = np.hstack([np.ones((len(rows), 1)), rows]) if intercept else rows
            sums = np.concatenate([kernel.matrix(rows[at : at + 1024], own) @ w for at in range(0, len(rows), 1024)]) if len(rows) else np.zeros((0, *w.shape[1:]))
            values = pa.array(list(sums), pa.list_(pa.float64())) if many else pa.array(sums, pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(out))), values], names=[*out, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), f"`{name}` {'array<double>' if many else 'double'}"])
    return source.mapInArrow(run, schema)


__all__ = ["as_array", "collect_matrix", "connected_components", "cut", "distinct_points", "epsilon_counts", "epsilon_forest", "epsilon_join", "epsilon_nearest", "kernel_matrix", "kernel_sums", "knn_join", "named_points", "nearest_centre"]
