"""SimHash fingerprints of word shingles, and near-duplicate groups by a binary-trie self-join.

Fingerprints: a text's A-Z are lower-cased, its words are runs of bytes outside 0x20 and 0x09-0x0D, its shingles
`words` consecutive words joined by one space, repeats included (fewer words: the whole sequence; no word: none). A
bit is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42); no shingle gives fingerprint zero, which
links like any other. Null texts count as empty.

Links: fingerprints at `errors` or fewer differing bits. The 64 bits fall into errors + 1 blocks; two linked
fingerprints agree in one block at least, so for each block the fingerprints are turned to begin with it, and a binary
trie with all its agreeing heads as roots is joined with itself: pairs of nodes go down together, their differing bits
add up, and a pair ends when the budget is exceeded. Rounds of Spark jobs walk down from heads with many fingerprints,
so no task ever gets more than LEAF of one node. Within a task only the links of a spanning forest are kept, since
groups are what follows. Groups are then found by rounds of star contraction, each cut by a checkpoint.

Rows with equal text share a fingerprint and are joined back by it, so copies cost nothing but their own rows.
A null doc_id takes part in no group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, frugal, slices

#: Most fingerprints of one trie node that a task joins at once, and most in one task's batch.
LEAF, BATCH = 2048, 20_000
#: Fingerprints of more than 1 / HOT of all rows are salted with SALTS values.
HOT, SALTS = 200, 32
#: So many heads at most, counted before, are sent to every task.
FEW = 20_000
#: A graph of so many edges at most, counted before, is taken apart by one task.
SMALL = 200_000
#: Levels that a round of splitting goes down.
STEP = 4

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _shingles(text: str | None, words: int) -> Iterator[np.ndarray]:
    """Hashes of the text's shingles, in runs of bounded length."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return
    joined = b" ".join(found)
    n = len(found)
    if n <= words:
        yield np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
        return
    lengths = np.fromiter(map(len, found), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    total = n - words + 1
    for at in range(0, total, 1 << 16):
        to = min(total, at + (1 << 16))
        spans = zip(starts[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist(), strict=True)
        yield np.array([digest(joined[a:b], 42) for a, b in spans], dtype=np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of one text, by the module's rules."""
    return majority(_shingles(text, words))


def majority(runs: Iterable[np.ndarray]) -> int:
    """The 64-bit fingerprint of shingle hashes, given in runs."""
    counts, total = np.zeros(64, np.int64), 0
    for h in runs:
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(h)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "fp", words: int = 3) -> DataFrame:
    """The columns of keep, and the fingerprint as a signed long."""
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField(name, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                out = pa.array(np.array([fingerprint(t, words) for t in batch.column("_text").to_pylist()], dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*keep, name])

    return source.mapInArrow(frugal(run), schema)


def join_tries(prints: np.ndarray, first: np.ndarray, second: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of prints at errors or fewer differing bits, for root pairs of index ranges.

    prints: uint64, ascending within each range. first, second: (k, 2) index ranges; equal ranges are joined with
    themselves. Node pairs of all roots go down level by level together."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    a0, a1, b0, b1 = first[:, 0], first[:, 1], second[:, 0], second[:, 1]
    spent = np.zeros(len(a0), np.int64)
    for level in range(64):
        small = (a1 - a0 == 1) & (b1 - b0 == 1)
        if small.any():  # two single leaves: the rest of their paths at once
            x, y = a0[small], b0[small]
            near = (np.bitwise_count(prints[x] ^ prints[y]) <= errors) & (x != y)
            out.append((x[near], y[near]))
            a0, a1, b0, b1, spent = (v[~small] for v in (a0, a1, b0, b1, spent))
        if not len(a0):
            break
        bit = np.uint64(63 - level)
        ones = np.concatenate([[0], np.cumsum((prints >> bit) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # within a node the ones stand last
        same = (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, spent), (am, a1, bm, b1, spent), (a0, am, bm, b1, spent + 1), (am[~same], a1[~same], b0[~same], bm[~same], spent[~same] + 1)]
        a0, a1, b0, b1, spent = (np.concatenate(v) for v in zip(*parts, strict=True))
        alive = (a1 > a0) & (b1 > b0) & (spent <= errors)
        alive &= ~((a0 == b0) & (a1 == b1) & (a1 - a0 == 1))
        a0, a1, b0, b1, spent = (v[alive] for v in (a0, a1, b0, b1, spent))
    else:  # equal prints to the last bit
        out += [(np.array([i]), np.array([j])) for w in zip(a0, a1, b0, b1, strict=True) for i in range(w[0], w[1]) for j in range(w[2], w[3]) if i != j]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x, y = (np.concatenate(v) for v in zip(*out, strict=True))
    return x, y


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that edges x-y reach from it."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _turned(value, block: int, size: int):
    """The bits turned left so that the block stands first."""
    k = block * size
    return value if k == 0 else F.shiftleft(value, k).bitwiseOR(F.shiftrightunsigned(value, 64 - k))


def links(prints: DataFrame, errors: int = 3, leaf: int = LEAF, partners: int = 0) -> DataFrame:
    """Pairs (a, b) of different fingerprints that join all linked ones into groups. prints: distinct, column fp.

    partners: for callers who verify links by other means, each task keeps real links only, for each fingerprint those to
    at most so many smaller ones, instead of the stars of a forest (whose ends needn't link)."""
    size = 64 // (errors + 1)
    turned = prints.select("fp", F.posexplode(F.array(*(_turned(F.col("fp"), b, size) for b in range(errors + 1)))).alias("block", "t"))
    head = lambda bits: F.shiftrightunsigned("t", 64 - bits)
    # Node pairs (x, y at `depth` bits, spent): first each head with itself, then pairs below the heads that are too full.
    full = cut(turned.groupBy("block", head(size).alias("x")).count().where(F.col("count") > leaf).select("block", "x"))
    crowded = full.select(F.col("block").alias("_block"), F.col("x").alias("_x"))
    n_full = full.count()
    if n_full <= FEW:
        crowded = F.broadcast(crowded)
    within = (F.col("block") == F.col("_block")) & (head(size) == F.col("_x"))
    ready, depth = None, size
    dense = cut(turned.join(crowded, within, "left_semi")) if n_full else None
    nodes = full.select("block", "x", F.col("x").alias("y"), F.lit(0).alias("spent")) if n_full else None
    while nodes is not None and depth + STEP <= 64:
        deeper = depth + STEP
        # Only what stands in crowded heads is counted, and of that only what stands below a waiting node.
        wanted = cut(nodes.select("block", F.explode(F.array("x", "y")).alias("up")).distinct())
        below = dense.select("block", head(depth).alias("up"), head(deeper).alias("node")).join(wanted, ["block", "up"], "left_semi").groupBy("block", "up", "node").count()
        left = below.select("block", F.col("up").alias("x"), F.col("node").alias("x2"), F.col("count").alias("nx"))
        right = below.select("block", F.col("up").alias("y"), F.col("node").alias("y2"), F.col("count").alias("ny"))
        pairs = (
            nodes.join(left, ["block", "x"])
            .join(right, ["block", "y"])
            .where((F.col("x") != F.col("y")) | (F.col("x2") <= F.col("y2")))
            .withColumn("spent", F.col("spent") + F.bit_count(F.col("x2").bitwiseXOR(F.col("y2")).bitwiseAND((1 << STEP) - 1)))
            .where(F.col("spent") <= errors)
        )
        pairs = cut(pairs.select("block", F.col("x2").alias("x"), F.col("y2").alias("y"), "spent", "nx", "ny"))
        small = (F.col("nx") <= leaf) & (F.col("ny") <= leaf)
        if deeper == 64:
            small = F.lit(True)
        done = pairs.where(small).select("block", "x", "y", F.lit(deeper).alias("depth"))
        ready = done if ready is None else ready.unionByName(done)
        rest = pairs.where(~small).select("block", "x", "y", "spent")
        nodes = None if rest.isEmpty() else rest
        depth = deeper
    # Units of work: (block, key) with the fingerprints of one side or both.
    light = (turned.join(crowded, within, "left_anti") if n_full else turned).select("fp", "t", F.xxhash64("block", head(size)).alias("unit"), F.lit(0).alias("side"))
    units = light
    if ready is not None:
        work = ready.select("*", F.xxhash64("block", "depth", "x", "y").alias("unit"))
        sides = work.select("block", "depth", "unit", F.explode(F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("node"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("x").alias("node"), F.lit(1).alias("side")), F.struct(F.col("y").alias("node"), F.lit(2).alias("side"))))).alias("s")).select("block", "depth", "unit", "s.*")
        depths = [r.depth for r in ready.select("depth").distinct().collect()]  # sixteen at most
        rows = dense.select("*", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), head(d).alias("node")) for d in depths))).alias("n")).select("fp", "block", "t", "n.*")
        units = units.unionByName(rows.join(sides, ["block", "depth", "node"]).select("fp", "t", "unit", "side"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= BATCH:
                whole = pd.concat(held, ignore_index=True)
                last = whole["unit"].iloc[-1]
                done = whole["unit"].to_numpy() != last
                if done.any():  # the last unit may go on in the next batch
                    yield _joined(whole[done], errors, partners)
                    whole = whole[~done]
                held, rows = [whole], len(whole)
        if rows:
            yield _joined(pd.concat(held, ignore_index=True), errors, partners)

    dealt = units.repartition("unit").sortWithinPartitions("unit", "side", F.col("t") < 0, "t")
    return dealt.mapInPandas(frugal(run), "a long, b long").distinct()


def _joined(pdf: pd.DataFrame, errors: int, partners: int = 0) -> pd.DataFrame:
    """Links of whole units, as stars of a spanning forest in each batch or, with partners, as links' own ends."""
    prints, fps = pdf["t"].to_numpy(np.int64).view(np.uint64), pdf["fp"].to_numpy(np.int64)
    unit, side = pdf["unit"].to_numpy(), pdf["side"].to_numpy()
    new = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (side[1:] != side[:-1])])
    ranges = np.stack([new, np.r_[new[1:], len(pdf)]], axis=1)
    kind = side[new]
    alone = ranges[(kind == 0) & (ranges[:, 1] - ranges[:, 0] > 1)]
    one = np.flatnonzero(kind == 1)
    one = one[(one + 1 < len(new)) & (unit[new[np.minimum(one + 1, len(new) - 1)]] == unit[new[one]])]
    x, y = join_tries(prints, np.concatenate([alone, ranges[one]]), np.concatenate([alone, ranges[one + 1]]), errors)
    if not len(x):
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    values, place = np.unique(fps, return_inverse=True)
    if partners:
        low, high = np.minimum(place[x], place[y]), np.maximum(place[x], place[y])
        order = np.lexsort((low, high))
        low, high = low[order], high[order]
        first = np.flatnonzero(np.r_[True, high[1:] != high[:-1]])
        kept = np.arange(len(high)) - np.repeat(first, np.diff(np.r_[first, len(high)])) < partners
        return pd.DataFrame({"a": values[low[kept]], "b": values[high[kept]]})
    label = forest(len(values), place[x], place[y])
    far = np.flatnonzero(label != np.arange(len(values)))
    return pd.DataFrame({"a": values[label[far]], "b": values[far]})


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    whole = pd.concat([pd.DataFrame({"u": [], "v": []}, dtype=np.int64), *batches], ignore_index=True)
    values, place = np.unique(whole[["u", "v"]].to_numpy(np.int64), return_inverse=True)
    place = place.reshape(-1, 2)
    label = forest(len(values), place[:, 0], place[:, 1])
    far = np.flatnonzero(label != np.arange(len(values)))
    yield pd.DataFrame({"node": values[far], "root": values[label[far]]})


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the edges (u, v, longs) the smallest node reachable, root excluded. Alternates large
    and small stars until the edges are stars already; each round is cut by a checkpoint. Up to SMALL edges one task does it."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.count() <= SMALL:
        return cut(edges.coalesce(1).mapInPandas(frugal(_stars), "node long, root long"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = cut(small.where("u <> v").distinct())
        # done when every node has one parent and no parent has a parent
        tops = after.select(F.col("v").alias("u")).distinct().join(after.select("u"), "u", "left_semi")
        if tops.isEmpty() and after.groupBy("u").count().where("count > 1").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = after


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, errors: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns of keep, fp, component_id, root) for each row of docs; component_id is the smallest doc_id of the
    row's group, root the group's smallest fingerprint. An id of several texts joins no groups: each row is in its text's."""
    prints = cut(fingerprints(docs, text, (doc_id, *keep), "fp", words))
    heads = cut(prints.groupBy("fp").agg(F.min(f"`{doc_id}`").alias("head"), F.count("*").alias("n")))
    return named(prints, heads, links(heads.where("head is not null").select("fp"), errors), doc_id)


def named(prints: DataFrame, heads: DataFrame, pairs: DataFrame, doc_id: str) -> DataFrame:
    """prints with (component_id, root). heads: each fp's smallest doc_id (head) and rows (n); pairs: links (a, b) of fps."""
    roots = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("fp"), "root")
    rooted = cut(heads.join(roots, "fp", "left").select("fp", "head", "n", F.coalesce("root", "fp").alias("root")))
    lows = cut(rooted.groupBy("root").agg(F.min("head").alias("component_id"), F.count("*").alias("size")))
    known = _salted_join(rooted, lows, "root", "size", "fp").select("fp", "component_id", "root", "n")
    found = _salted_join(prints, known, "fp", "n", f"`{doc_id}`")
    return found.select(*(F.col(f"`{c}`") for c in prints.columns), F.when(F.col(f"`{doc_id}`").isNotNull(), F.col("component_id")).alias("component_id"), "root")


def _salted_join(rows: DataFrame, known: DataFrame, key: str, size: str, by: str) -> DataFrame:
    """rows joined to the one row of known of their key. Keys whose size is over 1 / HOT of all rows (at most HOT such) are
    dealt out under SALTS keys."""
    most = F.lit(max(1, rows.count() // HOT))
    hot = [r[0] for r in known.where(F.col(size) > most).select(key).collect()]
    salted = rows.withColumn("_salt", F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0))
    spread = known.withColumn("_salt", F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(spread.drop(*({*rows.columns} & {*known.columns} - {key})), [key, "_salt"]).drop("_salt")


def distinct(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, errors: int = 3) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest doc_id. Rows with a null doc_id stay.

    Of rows that share the kept doc_id within a group, the one with the smallest hash of its text stays, and of rows equal in
    both the one with the smallest hash of all columns."""
    keyed = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), F.xxhash64(f"`{text}`").alias("key"))
    return firsts(docs, near_duplicates(keyed, doc_id, text, words, errors, ("key",)), doc_id, text)


def firsts(docs: DataFrame, groups: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of docs that distinct keeps, by (doc_id, key, component_id, root); key: XXH64 of the text."""
    heads = groups.where(F.col(f"`{doc_id}`") == F.col("component_id")).groupBy(F.col(f"`{doc_id}`").alias("_kept"), "root")
    kept = cut(heads.agg(F.min("key").alias("_key"), F.count("*").alias("rows")))
    same = (F.col(f"`{doc_id}`") == F.col("_kept")) & (F.xxhash64(f"`{text}`") == F.col("_key"))
    out = docs.join(kept.select("_kept", "_key").hint("shuffle_hash"), same, "left_semi")
    repeated = kept.where("rows > 1").select("_kept", "_key")
    if not repeated.isEmpty():
        whole, by = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind))
        one = out.join(repeated, same, "left_semi").groupBy(F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(f"`{text}`").alias("_key")).agg(F.min_by(whole, by).alias("_row"))
        out = out.join(repeated, same, "left_anti").unionByName(one.select(*(F.col("_row")[c].alias(c) for c in docs.columns)))
    return out.unionByName(docs.where(F.col(f"`{doc_id}`").isNull()))
