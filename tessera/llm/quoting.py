"""Quotation linking: conversations without quotes, in reply order, by DataFrame operations only.

A line's quote level is the number of `>` at its start (each may be followed by spaces). Neighbouring lines of one level
are a passage. Passages of level 0 are the message's own text. Each own text as a whole, each of its passages, and the
paragraphs (parts between blank lines) and lines of both are normalised (lower case, runs of white space to one space,
trimmed) and hashed. A quoted passage links to the latest earlier message of its conversation that has its hash; if none
has, to the latest that has the hash of one of its paragraphs, and if none has, of one of its lines. Level n quotes what a
message at depth n wrote. A message replies to the latest message that any of its level-1 passages links to, else to the
message before it. n_linked counts passages that link, equal ones of one level once.

Result: one row per message row, with the columns conv_id, turn, role, text (own text, without quotes and blank lines
at its ends), reply_to (turn; null for a first message), depth (replies up to the first message), n_quotes, n_linked,
and place: within a conversation, messages sorted by it (from 0) stand in reply order, each followed by all replies to it
in order of turn. Null texts count as empty. Rows that repeat a (conv_id, turn) share one place; rows in which either is
null stand alone (reply_to, depth and place null).

A conversation may hold a third of all rows, so every order within one (of turns, of a passage's sources, of the replies to
a turn) is made in buckets and over buckets. Depth and place come from a list of where each stretch of plain replies begins
and ends in reply order: its members add up what follows them by pointer jumping, in as many rounds as the logarithm of its
length, however deep the replies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Turns that are numbered by one task.
BUCKET = 1024
MARKER = r"^(?:[ \t]{0,3}>)+[ ]?"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _hash(text: Column) -> Column:
    return F.xxhash64(_normal(text))


def _bare(text: Column) -> Column:
    """Without blank lines at the start and white space at the end."""
    return F.rtrim(F.regexp_replace(text, r"^\s*\n", ""), F.lit(" \t\r\n\x0b\x0c"))


def _split(text: Column, by: str) -> Column:
    return F.filter(F.split(text, by), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")


def _pieces(text: Column) -> Column:
    """Hashes of the own text, its paragraphs and its lines."""
    return F.transform(F.filter(F.concat(F.array(_bare(text)), _split(text, r"\n\s*\n"), _split(text, r"\n")), lambda p: F.trim(p) != ""), _hash)


def _asked(text: Column) -> Column:
    """array<struct<part, h>>: the hashes that a quoted passage is sought by."""
    part = lambda pieces, k: F.transform(pieces, lambda p: F.struct(F.lit(k).alias("part"), _hash(p).alias("h")))
    return F.concat(part(F.array(text), 0), part(_split(text, r"\n\s*\n"), 1), part(_split(text, r"\n"), 2))


def _lines(text: Column) -> Column:
    """array<struct<level, line>> of the text's lines, markers removed."""
    level = lambda line: F.char_length(F.regexp_replace(F.regexp_extract(line, MARKER, 0), "[^>]", ""))
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1), lambda line: F.struct(level(line).alias("level"), F.regexp_replace(line, MARKER, "").alias("line")))


def _passages(lines: Column) -> Column:
    """array<struct<level, text>>: neighbouring lines of one level joined by line feeds."""
    # A line's passage begins where the level changes; each passage is cut out between two such places.
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(lines)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(lines, a)["level"].alias("level"), F.array_join(F.transform(F.slice(lines, a + 1, b - a), lambda x: x["line"]), "\n").alias("text")))


def link(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The conversations of messages in reply order without quotes; see the module's notes."""
    c = lambda name: F.col(f"`{name}`")
    lines = messages.select(c(conv_id).alias("conv"), c(turn).alias("turn"), c(role).alias("role"), c(text).alias("text"), _lines(c(text)).alias("lines"))
    quoted = F.exists("lines", lambda x: x["level"] > 0)
    plain = F.array(F.struct(F.lit(0).alias("level"), F.coalesce("text", F.lit("")).alias("text")))
    parts = lines.withColumn("passages", F.when(quoted, _passages(F.col("lines"))).otherwise(plain))
    own = F.array_join(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: _bare(p["text"])), "\n")
    quotes = F.filter(F.transform(F.filter("passages", lambda p: p["level"] > 0), lambda p: F.struct(p["level"].alias("level"), _hash(p["text"]).alias("h"), _normal(p["text"]).alias("t"), _asked(p["text"]).alias("asked"))), lambda q: q["t"] != "")
    pieces = F.array_distinct(F.concat(_pieces(own), F.flatten(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: _pieces(p["text"])))))
    each = cut(parts.select("conv", "turn", "role", _bare(own).alias("body"), F.transform(quotes, lambda q: F.struct(q["level"].alias("level"), q["h"].alias("h"), q["asked"].alias("asked"))).alias("quotes"), F.when(F.col("conv").isNotNull() & F.col("turn").isNotNull(), pieces).alias("pieces")))

    # Hashed originals are needed only where a conversation has quotes at all.
    # passage: the whole's hash; part: 0 for the whole, 1 for a paragraph, 2 for a line.
    asks = each.where("size(quotes) > 0 and conv is not null and turn is not null").select("conv", "turn", F.explode("quotes").alias("q"))
    asks = cut(asks.select("conv", "turn", "q.level", F.col("q.h").alias("passage"), F.explode("q.asked").alias("x")).select("conv", "turn", "level", "passage", "x.*").distinct())
    wanted = asks.select("conv", "h").distinct()
    there = each.where("conv is not null and turn is not null").select("conv", F.col("turn").alias("source"), F.explode("pieces").alias("h")).join(wanted, ["conv", "h"], "left_semi")
    # The sources of one hash as a sorted list would be unbounded: the latest before each quoting turn comes from a range of turns in order.
    events = there.select("conv", "h", F.col("source").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("passage"), F.lit(None).cast("int").alias("part")).union(asks.select("conv", "h", F.col("turn"), F.lit(0), "level", "passage", "part"))
    events = events.withColumn("bucket", F.floor(F.col("at") / BUCKET))
    source = F.when(F.col("kind") == 1, F.col("at"))
    before = Window.partitionBy("conv", "h", "bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv", "h").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy("conv", "h", "bucket").agg(F.max(source).alias("last")).withColumn("last", F.max("last").over(earlier))
    linked = events.withColumn("source", F.max(source).over(before)).where("kind = 0").join(carried, ["conv", "h", "bucket"]).withColumn("source", F.coalesce("source", "last"))
    linked = linked.where("source is not null").groupBy("conv", "at", "level", "passage").agg(F.min(F.struct("part", (-F.col("source")).alias("back"))).alias("best")).select("conv", "at", "level", (-F.col("best.back")).alias("source"))
    told = linked.groupBy("conv", F.col("at").alias("turn")).agg(F.max(F.when(F.col("level") == 1, F.col("source"))).alias("to"), F.count("source").alias("n_linked"))

    # Turns are numbered in two steps, within buckets of turns and over the buckets, so no window holds a conversation.
    turns = each.where("conv is not null and turn is not null").select("conv", "turn", F.floor(F.col("turn") / BUCKET).alias("bucket")).distinct()
    inside, over = Window.partitionBy("conv", "bucket").orderBy("turn"), Window.partitionBy("conv").orderBy("bucket")
    so_far = over.rowsBetween(Window.unboundedPreceding, -1)
    buckets = turns.groupBy("conv", "bucket").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    buckets = buckets.select("conv", "bucket", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"), F.lag("last").over(over).alias("last_before"))
    numbered = turns.withColumn("rank", F.row_number().over(inside)).withColumn("lag", F.lag("turn").over(inside)).join(buckets, ["conv", "bucket"])
    numbered = numbered.select("conv", "turn", "bucket", (F.col("before") + F.col("rank")).alias("rank"), F.coalesce("lag", "last_before").alias("prev"))
    edges = numbered.join(told, ["conv", "turn"], "left").select("conv", "turn", "bucket", "rank", F.coalesce("to", "prev").alias("reply_to"), F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "prev")

    # A run is a stretch of turns each replying to the one before; its first turn is a joint.
    joint = F.when(F.col("reply_to").isNull() | (F.col("reply_to") != F.col("prev")), F.struct("turn", "rank"))
    jointed = cut(edges.withColumn("joint", joint))
    last = jointed.groupBy("conv", "bucket").agg(F.max("joint").alias("joint"))
    last = last.select("conv", "bucket", F.max("joint").over(so_far).alias("carried"))
    runs = jointed.withColumn("joint", F.last("joint", True).over(inside)).join(last, ["conv", "bucket"]).withColumn("joint", F.coalesce("joint", "carried"))
    runs = cut(runs.select("conv", "turn", "reply_to", "n_linked", F.col("joint.turn").alias("run"), (F.col("rank") - F.col("joint.rank")).alias("step")))
    heads = runs.where("step = 0").select("conv", F.col("run"), F.col("reply_to").alias("parent"))
    at = runs.select("conv", F.col("turn").alias("parent"), F.col("run").alias("up"), F.col("step").alias("up_step"))
    size = runs.groupBy("conv", "run").agg(F.count("*").alias("size"))
    tree = cut(heads.join(at, ["conv", "parent"], "left").join(size, ["conv", "run"]).select("conv", "run", "up", "up_step", "parent", "size"))
    found = ranked(tree)
    placed = runs.join(found, ["conv", "run"]).select(F.col("conv").alias("_conv"), F.col("turn").alias("_turn"), "reply_to", "n_linked", (F.col("base") + F.col("step")).alias("depth"), (F.col("first") + F.col("step")).alias("place"))
    out = each.join(placed, F.col("conv").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")), "left")
    n = F.coalesce("n_linked", F.lit(0).cast("long"))
    return out.select(F.col("conv").alias(conv_id), F.col("turn").alias(turn), F.col("role").alias(role), F.col("body").alias(text), "reply_to", "depth", F.size("quotes").cast("long").alias("n_quotes"), n.alias("n_linked"), "place")


def following(rows: DataFrame, group: list[str], by: str, out: str) -> DataFrame:
    """rows with the next larger value of by (a long, different within a group) in column out, in buckets and over buckets."""
    cell = F.floor(F.col(by) / BUCKET)
    inside = Window.partitionBy(*group, "cell").orderBy(by)
    rows = rows.withColumn("cell", cell).withColumn(out, F.lead(by).over(inside))
    cells = rows.groupBy(*group, "cell").agg(F.min(by).alias("least"))
    cells = cells.select(*(F.col(g).alias(f"_{g}") for g in group), F.col("cell").alias("_cell"), F.lead("least").over(Window.partitionBy(*group).orderBy("cell")).alias("later"))
    same = reduce(lambda a, b: a & b, (F.col(g) == F.col(f"_{g}") for g in (*group, "cell")))
    return rows.join(cells, same).select(*(c for c in rows.columns if c not in ("cell", out)), F.coalesce(out, "later").alias(out))


def ranked(tree: DataFrame) -> DataFrame:
    """(conv, run, first, base): the place and the depth of each run's first turn. tree: conv, run, up (its parent's run), up_step
    (the parent's step there), parent (turn), size; one root a conversation.

    A run stands whole before its branches: what goes straight on has the smallest turn of all replies to a turn. So those off
    later turns come first, and of one turn the smallest."""
    branches = tree.where("up is not null")
    sisters = following(branches, ["conv", "parent"], "run", "next_same")
    joints = branches.groupBy("conv", "up", "parent").agg(F.min("run").alias("eldest"), F.first("up_step").alias("up_step"))
    joints = cut(following(joints.withColumn("back", -F.col("up_step").cast("long")), ["conv", "up"], "back", "next_back"))
    eldest = joints.select("conv", "up", F.col("back").alias("next_back"), F.col("eldest").alias("next_joint"))
    after = joints.select("conv", "up", "parent", "next_back").join(eldest, ["conv", "up", "next_back"], "left").select("conv", "parent", "next_joint")
    sisters = sisters.join(after, ["conv", "parent"]).select("conv", "run", F.coalesce("next_same", "next_joint").alias("sister"))
    child = joints.groupBy("conv", F.col("up").alias("run")).agg(F.min(F.struct("back", "eldest"))["eldest"].alias("child"))
    runs = tree.join(sisters, ["conv", "run"], "left").join(child, ["conv", "run"], "left")
    # Each run enters the list and leaves it: turn * 2 and turn * 2 + 1. weight: its turns; fall: levels down, then up again.
    enter, leave = F.col("run") * 2, F.col("run") * 2 + 1
    down = F.coalesce(F.col("up_step") + 1, F.lit(0)).cast("long")
    ends = F.array(
        F.struct(enter.alias("e"), F.coalesce(F.col("child") * 2, leave).alias("to"), F.col("size").alias("weight"), down.alias("fall")),
        F.struct(leave.alias("e"), F.coalesce(F.col("sister") * 2, F.col("up") * 2 + 1).alias("to"), F.lit(0).cast("long").alias("weight"), (-down).alias("fall")),
    )
    links = cut(runs.select("conv", "run", F.explode(ends).alias("x")).select("conv", "x.*"))
    longest = links.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(0, longest - 1).bit_length()):  # to: the first member not yet in the sums; null at the end
        ahead = links.select("conv", F.col("e").alias("to"), F.col("to").alias("far"), F.col("weight").alias("w"), F.col("fall").alias("f"))
        moved = links.where("to is not null").join(ahead, ["conv", "to"]).select("conv", "e", F.col("far").alias("to"), (F.col("weight") + F.col("w")).alias("weight"), (F.col("fall") + F.col("f")).alias("fall"))
        links = cut(moved.unionByName(links.where("to is null")))
    total = tree.groupBy("conv").agg(F.sum("size").alias("total"))
    entered = tree.withColumn("e", enter).join(links.drop("to"), ["conv", "e"]).join(total, "conv")
    return entered.select("conv", "run", (F.col("total") - F.col("weight")).alias("first"), (down - F.col("fall")).alias("base"))
