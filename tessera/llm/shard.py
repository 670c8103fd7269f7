"""Histogram sort: rows dealt to shards in key order, with near-equal bytes, by exact counts and one exchange.

The key is two longs (a hash of the text, then the row's id). The rows' bytes below candidate boundaries are counted
exactly by partial aggregates: first for FIRST bits of the key, then, round by round, for STEP more bits below the
candidates next to a wanted splitter that isn't met within the tolerance, and below any with more rows than a
cell has. A boundary between different first keys is taken where the tolerance allows, so rows of equal text stay
together unless their group is too large. What reaches the driver is bounded by CELLS and STEP, whatever the input.

Rows of equal keys take any order among themselves but each its own slot. A null weight counts as 0, a null key as the
smallest; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_name

FIRST, STEP = 12, 8
#: Rows are ranked in cells, each sorted by one task: of CELL_ROWS rows, but so many cells at least and at most.
CELL_ROWS, CELLS = 500_000, (512, 16_384)
LOWEST = -(1 << 63)


def _prefix(high: Column, low: Column, bits: int) -> tuple[Column, Column]:
    """The first bits of the 128-bit key, as two longs."""
    flip = F.lit(LOWEST)
    if bits <= 64:
        return F.shiftrightunsigned(high.bitwiseXOR(flip), 64 - bits), F.lit(0).cast("long")
    return high.bitwiseXOR(flip), F.shiftrightunsigned(low.bitwiseXOR(flip), 128 - bits)


def _value(prefix: tuple[int, int], bits: int) -> tuple[int, int]:
    """The smallest key of that prefix, as the two signed longs that rows hold."""
    a, b = (x % (1 << 64) for x in prefix)
    a, b = (a << (64 - bits), 0) if bits <= 64 else (a, b << (128 - bits))
    return a + LOWEST, b + LOWEST


def boundaries(keyed: DataFrame, shards: int, tolerance: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Lower keys of all cells but the first; each cell's shard; each cell's first slot. keyed: columns h, l, w."""
    total = keyed.agg(F.count("*").alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("b")).first()
    targets = [total.b * k / shards for k in range(1, shards)]
    slack, most = tolerance * total.b / shards, max(1, total.n // min(CELLS[1], max(CELLS[0], total.n // CELL_ROWS)))
    # leaves: (smallest key, rows, bytes, bits, prefix), in key order
    leaves = [((LOWEST, LOWEST), total.n, total.b, 0, (0, 0))]
    while True:
        edges, sums = [], 0
        for leaf in leaves:
            edges.append(sums)
            sums += leaf[2]
        wanted = set()
        for t in targets:
            i = max(0, bisect_left(edges, t) - 1)  # the last leaf that begins before t
            if i < len(leaves) and min(t - edges[i], edges[i] + leaves[i][2] - t) > slack:
                wanted.add(i)
        wanted |= {i for i, x in enumerate(leaves) if x[1] > most}
        wanted = {i for i in wanted if leaves[i][1] > 1 and leaves[i][3] < 128}
        if not wanted:
            break
        after, by_bits = {}, {}
        for i in wanted:
            by_bits.setdefault(leaves[i][3], []).append(i)
        for bits, each in by_bits.items():
            down = FIRST if bits == 0 else 64 if bits < 64 < bits + STEP else min(128, bits + STEP)
            up = _prefix(F.col("h"), F.col("l"), bits) if bits else (F.lit(0).cast("long"), F.lit(0).cast("long"))
            a, b = _prefix(F.col("h"), F.col("l"), down)
            rows = keyed
            if bits:
                firsts = sorted({leaves[i][4][0] for i in each})
                rows = rows.where(up[0].isin(firsts))
                if bits > 64:
                    rows = rows.where(up[1].isin(sorted({leaves[i][4][1] for i in each})))
            found = rows.groupBy(up[0].alias("ua"), up[1].alias("ub"), a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"), F.sum("w").alias("s")).collect()
            at = {leaves[i][4]: i for i in each}
            for r in found:
                if (r.ua, r.ub) in at:
                    after.setdefault(at[r.ua, r.ub], []).append((_value((r.a, r.b), down), r.n, r.s, down, (r.a, r.b)))
        leaves = [y for i, x in enumerate(leaves) for y in (sorted(after[i]) if i in after else [x])]
    edges.append(sums)
    between = [x[0][1] == LOWEST for x in leaves] + [True]  # not within the rows of one first key
    cuts = []
    for t in targets:
        near = range(bisect_left(edges, t - slack), bisect_right(edges, t + slack))
        near = [i for i in near if between[i]] or near or range(max(0, bisect_left(edges, t) - 1), min(len(edges), bisect_left(edges, t) + 1))
        cuts.append(min(near, key=lambda i: abs(edges[i] - t)))
    starts, shard_of, slot_of = [], [], []
    shard = slot = rows = 0
    for i, leaf in enumerate(leaves):
        own = sum(c <= i for c in cuts)
        if i == 0 or own != shard or rows + leaf[1] > most:
            if i:
                starts.append(leaf[0])
            slot = 0 if own != shard else slot
            shard, rows = own, 0
            shard_of.append(shard)
            slot_of.append(slot)
        rows += leaf[1]
        slot += leaf[1]
    return starts, shard_of, slot_of


def _cell(high: Column, low: Column, starts: list[tuple[int, int]]) -> Column:
    """How many of the starts are at or below the key: a binary search in two literal arrays."""
    if not starts:
        return F.lit(0)
    hs, ls, n = F.lit([x for x, _ in starts]), F.lit([y for _, y in starts]), len(starts)

    def step(at: Column, jump: Column) -> Column:
        to = at + jump
        place = F.least(to, F.lit(n))
        h = F.element_at(hs, place)
        return F.when((to <= n) & ((h < high) | ((h == high) & (F.element_at(ls, place) <= low))), to).otherwise(at)

    return F.aggregate(F.lit([1 << i for i in reversed(range(n.bit_length()))]), F.lit(0), step)


def histogram_sort(rows: DataFrame, keys: tuple[str, str], weight: str, shards: int, tolerance: float = 0.01, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """rows with int column shard and long column slot (gapless from 0 in each shard) added, replacing those of that
    name. Each shard's sum of weight is within tolerance of the mean, or within one row if rows are larger than that.

    rows are read several times, whole only once: give a written table or a checkpoint."""
    rest = [c for c in rows.columns if c not in (shard, slot)]
    high, low = (F.coalesce(F.col(f"`{k}`"), F.lit(LOWEST)) for k in keys)
    keyed = rows.select(high.alias("h"), low.alias("l"), F.coalesce(F.col(f"`{weight}`"), F.lit(0)).alias("w"))
    starts, shard_of, slot_of = boundaries(keyed, shards, tolerance)
    cell = free_name(rows, "cell")
    placed = rows.select(*(F.col(f"`{c}`") for c in rest)).withColumn(cell, _cell(high, low, starts))
    order = Window.partitionBy(cell).orderBy(high, low)
    at = F.col(cell) + 1
    rank = F.row_number().over(order) - 1
    return placed.select("*", F.element_at(F.lit(shard_of or [0]), at).alias(shard), (F.element_at(F.lit(slot_of or [0]), at).cast("long") + rank).alias(slot)).drop(cell)
