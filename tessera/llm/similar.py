"""Near-duplicate groups: SimHash candidates, then every link of the exact Jaccard similarity of word shingles.

Texts are cut into shingles as in simhash; a text's set holds the XXH64 hashes of its distinct shingles. Two texts link at
a similarity of LEAST and over. Links come from three sources, and each is verified on the whole sets:

1. SimHash: pairs whose 64-bit fingerprints differ by 3 bits at most, by simhash's trie self-join. They hold large families
   of near copies together at little cost, but of pairs at 0.8 hardly one in a hundred differs so little.
2. Shared rare shingles: in any fixed order of shingles, two linked sets of m and n share one of the first
   n - ceil(LEAST n) + 1 of each. The order is by counts in a fixed number of buckets, rare ones first, so that templates
   come last; collisions there change the work, never the result. Each set is compared with the shortest of its sharers.
3. All sharers that are in different groups still, if sizes, the place of their common shingle and the counts of their
   shingles by byte leave them a chance: no link is missed.

A shingle that all of a large family share isn't gathered: shingles of crowded buckets are dealt out under SALTS keys, groups
of sharers that are one group by then are dropped by their least and largest root, and what is left of large ones is
compared in blocks of BLOCK sets: those of the commonest root with the others only, and the others among themselves.

Rows of equal sets share a fingerprint, so copies cost nothing but their own rows; texts without a shingle form one group.
Null texts count as empty; a null doc_id takes part in no group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import simhash
from tessera.llm.common import cut, discard, frugal, slices, stored

#: The least similarity as a fraction, so that every comparison is of whole numbers.
LEAST = (4, 5)
#: Buckets of counts are 1 << BITS.
BITS = 18
#: Rows of a batch, fingerprints of a task that are known to be sent already, and sharers that a task knows as a whole.
BATCH, SEEN, LIMIT = 20_000, 200_000, 4096
#: A bucket is crowded with so many shingles, and so many times the mean; its shingles are dealt out under SALTS keys.
CROWD, TIMES, SALTS = 10_000, 64, 64
#: Sets of a block of a large group of sharers.
BLOCK = 128
#: Links of a fingerprint that the trie join hands on.
PARTNERS = 4
#: Likeliest partners of a set that are tried before all others.
LIKELY = 2
#: So many fingerprints, counted before, are sent to every task.
FEW = 200_000


def _set(runs: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(runs)) if runs else np.empty(0, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return _set(list(simhash._shingles(text, words)))


def _print(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def _bucket(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - BITS)).astype(np.int64)


def counts(source: DataFrame, words: int) -> np.ndarray:
    """Shingles by bucket. source: column _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BITS, np.int64)
        for whole in batches:
            for batch in slices(whole, "_text"):
                sets = [shingle_set(t, words) for t in batch.column(0).to_pylist()]
                n += np.bincount(_bucket(np.concatenate([*sets, np.empty(0, np.uint64)])), minlength=1 << BITS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])

    found = source.select("_text").mapInArrow(frugal(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # 1 << BITS rows at most
    out = np.zeros(1 << BITS, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


_PREFIX = pa.list_(pa.struct([("token", pa.int64()), ("rest", pa.int32()), ("salt", pa.int8())]))


def prefixes(source: DataFrame, words: int, doc_id: str) -> DataFrame:
    """(doc_id, key, fp, n, sim, tokens): the set's fingerprint and size, the text's SimHash, and the set's first shingles in
    order with the number of those from there on; tokens once for each fp of a task."""
    n = counts(source, words)
    sent = source.sparkSession.sparkContext.broadcast((n, n > max(CROWD, TIMES * int(n.mean()))))
    a, b = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        n_of, crowded = sent.value
        for whole in batches:
            for batch in slices(whole, "_text"):
                fps, sizes, sims, offsets, tokens, rests, salts = [], [], [], [0], [], [], []
                for t in batch.column(2).to_pylist():
                    runs = list(simhash._shingles(t, words))
                    found = _set(runs)
                    n, fp = len(found), _print(found)
                    fps.append(fp)
                    sizes.append(n)
                    sims.append(simhash.majority(runs))
                    if n and fp not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(fp)
                        bucket = _bucket(found)
                        order = np.lexsort((found, n_of[bucket]))[: n + 1 - -(-a * n // b)]
                        tokens.append(found[order].view(np.int64))
                        rests.append(np.arange(n, n - len(order), -1, dtype=np.int32))
                        salts.append(np.where(crowded[bucket[order]], 1 + fp % SALTS, 0).astype(np.int8))
                        offsets.append(offsets[-1] + len(order))
                    else:
                        offsets.append(offsets[-1])
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate([*x, np.empty(0, k)])) for x, k in ((tokens, np.int64), (rests, np.int32), (salts, np.int8))], fields=list(_PREFIX.value_type))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(sims, np.uint64).view(np.int64)), lists], names=[doc_id, "key", "fp", "n", "sim", "tokens"])

    kind = source.schema[doc_id].dataType
    rest = T._parse_datatype_string("key long, fp long, n int, sim long, tokens array<struct<token: long, rest: int, salt: tinyint>>")
    return source.select(doc_id, "key", "_text").mapInArrow(frugal(run), T.StructType([T.StructField(doc_id, kind), *rest]))


def _mixed(x: np.ndarray) -> np.ndarray:
    out = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def sharers(prints: DataFrame) -> DataFrame:
    """(sharing, fp, n, rest): sets of fingerprints that share a token, each once however many tokens they share. rest: the
    shingles from the first such token on. Tokens that are salted or have over LIMIT sharers are sets of their own."""
    tokens = prints.select("fp", "n", F.explode("tokens").alias("x")).select("x.token", "x.salt", "fp", "n", "x.rest")

    def emit(pdf: pd.DataFrame, long: int | None) -> pd.DataFrame:
        token, fp = pdf["token"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64)
        pdf = pdf[np.r_[True, (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])]]  # the same set from several tasks
        token, fp = pdf["token"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64)
        new = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[new, len(pdf)])
        alone = (size > LIMIT) | (pdf["salt"].to_numpy()[new] > 0) | (token[new] == long if long is not None else False)
        sharing = np.where(alone, _mixed(token[new]), np.add.reduceat(_mixed(fp), new)).view(np.int64)
        wanted = np.repeat(alone | (size > 1), size)
        out = pdf[wanted].assign(sharing=np.repeat(sharing, size)[wanted])
        return out.groupby(["sharing", "fp", "n"], as_index=False)["rest"].max()[["sharing", "fp", "n", "rest"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows, long = 0, None  # long: a token whose first sharers are gone already
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= BATCH:
                whole = pd.concat(held, ignore_index=True)
                last = int(whole["token"].iloc[-1])
                done = whole["token"].to_numpy() != last
                if (~done).sum() > LIMIT:
                    yield emit(whole[done], long) if done.any() else whole.iloc[:0].assign(sharing=0)[["sharing", "fp", "n", "rest"]]
                    long = last
                    yield emit(whole[~done], long)
                    held, rows = [], 0
                elif done.any():
                    yield emit(whole[done], long)
                    held, rows = [whole[~done]], int((~done).sum())
        if rows:
            yield emit(pd.concat(held, ignore_index=True), long)

    found = tokens.repartition("token", "salt").sortWithinPartitions("token", "salt", "fp").mapInPandas(frugal(run), "sharing long, fp long, n int, rest int")
    return found.groupBy("sharing", "fp", "n").agg(F.max("rest").alias("rest"))


def _similar(shared: Column, a: Column, b: Column) -> Column:
    """Whether sets of a and b that share so many reach the least similarity."""
    return shared * F.lit(sum(LEAST)) >= (a + b) * F.lit(LEAST[0])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the least similarity."""
    pairs = cut(pairs)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    if pairs.count() <= FEW:  # then only their sets move
        sets = sets.join(F.broadcast(asked), "fp", "left_semi")
    side = lambda name: sets.select(F.col("fp").alias(name), F.col("shingles").alias(f"s{name}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.where(_similar(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"))).select("a", "b")


def _units(batches: Iterator[pd.DataFrame], unit: str) -> Iterator[pd.DataFrame]:
    """Frames of whole units, from rows in order of unit."""
    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows >= BATCH:
            whole = pd.concat(held, ignore_index=True)
            done = whole[unit].to_numpy() != whole[unit].iloc[-1]
            if done.any():  # the last unit may go on in the next batch
                yield whole[done].reset_index(drop=True)
                whole = whole[~done]
            held, rows = [whole], 0
    if held:
        whole = pd.concat(held, ignore_index=True)
        if len(whole):
            yield whole


def units(rooted: DataFrame, counts: DataFrame) -> DataFrame:
    """(unit, side, fp, n, rest, root, counts) of sharers of several roots. Rows of side 0 are to be compared with each other,
    those of side 1 with those of side 2; no unit has more than 2 BLOCK sets or so. rooted: sharing, fp, n, rest, root; counts: fp,
    counts."""
    per = rooted.groupBy("sharing").agg(F.count("*").alias("total"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("sharing", "total")
    left = cut(rooted.join(per, "sharing").join(counts, "fp"))
    columns = [F.col(c) for c in ("fp", "n", "rest", "root", "counts")]
    small = left.where(F.col("total") <= 2 * BLOCK).select(F.xxhash64("sharing").alias("unit"), F.lit(0).alias("side"), *columns)
    large = left.where(F.col("total") > 2 * BLOCK)
    of = large.groupBy("sharing", "root").count().groupBy("sharing").agg(F.max(F.struct("count", "root")).alias("most"), F.sum("count").alias("total"))
    pieces = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    of = of.select("sharing", F.col("most.root").alias("main"), pieces(F.col("most.count")).alias("np"), pieces(F.col("total") - F.col("most.count")).alias("nb"))
    large = large.drop("total").join(of, "sharing").withColumn("place", F.xxhash64("fp"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    unit = lambda kind, i, j, side: F.struct(F.xxhash64("sharing", F.lit(kind), i, j).alias("unit"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    own_p, own_b = F.pmod("place", "np").cast("int"), F.pmod("place", "nb").cast("int")
    of_main = F.transform(every(F.col("nb")), lambda j: unit(1, own_p, j, 1))
    others = F.transform(every(F.col("np")), lambda i: unit(1, i, own_b, 2))
    among = F.transform(every(F.col("nb")), lambda j: unit(2, F.least(own_b, j), F.greatest(own_b, j), F.when(own_b == j, 0).when(own_b < j, 1).otherwise(2)))
    dealt = large.withColumn("u", F.explode(F.when(F.col("root") == F.col("main"), of_main).otherwise(F.concat(others, among))))
    return small.unionByName(dealt.select("u.unit", "u.side", *columns))


def apart(rooted: DataFrame, counts: DataFrame, partners: int = 0) -> DataFrame:
    """Pairs (a, b) of different roots that may be similar by their sizes, their common shingle and their counts by byte.
    partners: of each set in a unit only the pairs with so many likeliest partners."""
    low, high = LEAST

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _units(batches, "unit"):
            unit, side, fp, n, rest, root = (pdf[c].to_numpy(np.int64) for c in ("unit", "side", "fp", "n", "rest", "root"))
            sized = pdf["counts"].map(len).to_numpy() > 0
            counts = np.frombuffer(b"".join(x or bytes(256) for x in pdf["counts"]), np.uint8).reshape(len(pdf), 256).astype(np.int16)
            new = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            for start, end in zip(new.tolist(), [*new[1:].tolist(), len(pdf)], strict=True):
                out, chance = [], []
                for i in range(start, end - 1):
                    if side[i] == 2:
                        break
                    at = i + 1 if side[i] == 0 else start + int(np.searchsorted(side[start:end], 2))
                    j = np.arange(at, end)
                    both = (n[i] + n[j]) * low
                    j = j[(root[j] != root[i]) & (np.minimum(n[i], n[j]) * high >= np.maximum(n[i], n[j]) * low) & (np.minimum(rest[i], rest[j]) * (low + high) >= both)]
                    if len(j):
                        most = np.where(sized[i] & sized[j], np.minimum(counts[j], counts[i]).sum(axis=1, dtype=np.int64), np.minimum(n[i], n[j]))
                        may = most * (low + high) >= (n[i] + n[j]) * low
                        j = j[may]
                        out.append((np.full(len(j), i), j))
                        chance.append(most[may] / (n[i] + n[j]))
                if out:
                    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                    if partners:
                        of = np.concatenate(chance)
                        kept = _first(a, -of, partners) | _first(b, -of, partners)
                        a, b = a[kept], b[kept]
                    yield pd.DataFrame({"a": np.minimum(fp[a], fp[b]), "b": np.maximum(fp[a], fp[b])})

    dealt = units(rooted, counts).repartition("unit").sortWithinPartitions("unit", "side")
    return dealt.mapInPandas(frugal(run), "a long, b long").distinct()


def _first(key: np.ndarray, by: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k first of their key, in order of `by`."""
    order = np.lexsort((by, key))
    new = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.empty(0, np.int64)
    out = np.zeros(len(key), bool)
    out[order] = np.arange(len(key)) - np.repeat(new, np.diff(np.r_[new, len(key)])) < k
    return out


def _counts(found: np.ndarray) -> bytes:
    """How many shingles have each last byte; empty if any count is beyond a byte."""
    n = np.bincount((found & np.uint64(255)).astype(np.int64), minlength=256)
    return b"" if n.max(initial=0) > 255 else n.astype(np.uint8).tobytes()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """(doc_id, key, fp, component_id, root) for each row of docs with a doc_id, as simhash.near_duplicates; key: XXH64 of the text."""
    asked = F.col(f"`{text}`")
    source = docs.where(F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`"), F.xxhash64(asked).alias("key"), asked.alias("_text"))
    # The wide tables live in the shared folder as long as they are read, and no longer: they are most of what this takes.
    wide, tokens = stored(prefixes(source, words, doc_id))
    prints = cut(wide.drop("tokens"))
    groups = cut(sharers(wide))
    discard(docs.sparkSession, tokens)
    one = prints.groupBy("fp", doc_id, "key").agg(F.count("*").alias("rows"), F.min("sim").alias("sim"))
    heads = one.groupBy("fp").agg(F.min(F.struct(F.col(f"`{doc_id}`").alias("id"), "key", "rows")).alias("h"), F.sum("rows").alias("n"), F.min("sim").alias("sim"))
    heads = cut(heads.select("fp", F.col("h.id").alias("head"), "n", F.col("h.key").alias("key"), F.col("h.rows").alias("rows"), "sim"))
    sims = cut(heads.groupBy("sim").agg(F.min("fp").alias("fp")))
    equal = heads.join(sims.withColumnRenamed("fp", "a"), "sim").where("fp <> a").select("a", F.col("fp").alias("b"))
    of = lambda sim, name: sims.select(F.col("sim").alias(sim), F.col("fp").alias(name))
    near = simhash.links(sims.select(F.col("sim").alias("fp")), partners=PARTNERS).withColumnsRenamed({"a": "sa", "b": "sb"})
    near = cut(equal.unionByName(near.join(of("sa", "a"), "sa").join(of("sb", "b"), "sb").select("a", "b")))
    wanted = groups.select("fp").union(near.select("a")).union(near.select("b")).distinct()
    wanted = cut(heads.join(wanted, "fp", "left_semi").select(F.col("head").alias(doc_id), "key", "rows"))
    few = F.broadcast(wanted) if wanted.count() <= FEW else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, "_text"):
                sets = {}
                for t in batch.column(0).to_pylist():
                    found = shingle_set(t, words)
                    fp = _print(found)
                    if fp not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(fp)
                        sets[fp] = found
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array([x.view(np.int64) for x in sets.values()], pa.list_(pa.int64())), pa.array(map(_counts, sets.values()), pa.binary())], names=["fp", "shingles", "counts"])

    sets = source.join(few, [doc_id, "key"], "left_semi").select("_text").mapInArrow(frugal(run), "fp long, shingles array<long>, counts binary")
    if not wanted.where("rows > 1").isEmpty():  # else each set comes from one row, and need not move
        sets = sets.groupBy("fp").agg(F.first("shingles").alias("shingles"), F.first("counts").alias("counts"))
    sets, shingles = stored(sets)
    top = groups.groupBy("sharing").agg(F.min(F.struct("n", "fp")).alias("top"))
    first = groups.join(top, "sharing").where("fp <> top.fp").where(_similar(F.col("top.n"), F.col("top.n"), F.col("n")))
    first = first.select(F.col("top.fp").alias("a"), F.col("fp").alias("b")).unionByName(near)
    edges = cut(verified(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets))
    for partners in (LIKELY, 0):  # first what is likely, so that groups are whole when every pair is looked at
        roots = simhash.components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        edges = edges.unionByName(cut(verified(apart(rooted, sets.select("fp", "counts"), partners), sets)))
    discard(docs.sparkSession, shingles)
    return simhash.named(prints.select(doc_id, "key", "fp"), heads, edges, doc_id)


def distinct(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """docs with one row of each group, as simhash.distinct."""
    return simhash.firsts(docs, near_duplicates(docs, doc_id, text, words), doc_id, text)
