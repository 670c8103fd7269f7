"""Secret scans over a ledger of content-addressed blobs, in DataFrame operations only.

Every version of a text is addressed by the SHA-256 of its UTF-8. The ledger is a Parquet folder of (blob, rule,
version, spans), partitioned by rule and version: which have seen which blob, and what they found. A scan reads from it the
blobs under the rules and versions asked for, scans only the blobs that one of them lacks, each once however many rows
hold it, appends to the ledger, and joins all findings back to all paths.

A rule's matches are leftmost and non-overlapping; those whose group is shorter than `least` are dropped after they
have consumed their text. Positions are code points, ends exclusive. Null texts count as empty; repeated rows are
each reported; an empty table gives an empty one. A third of all rows may hold one blob: texts are combined by blob
before they move, and the paths of blobs with findings are dealt out under SALTS keys.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, free_name, use_checkpoint_dir

#: Stands around matches; texts that hold it get U+FFFD in its place, which no rule matches either.
MARK = "\ufdd0"
SALTS = 32
CHUNK = 1024


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


#: The base rules.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # same as runs of any length of which shorter ones are dropped
)


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start: long, end: long>> of the rule's findings in the text.

    Matches are set apart by marks, so that pieces alternate; their lengths add up to positions, in chunks so that
    many matches cost little more than in proportion."""
    marked = F.regexp_replace(F.translate(text, MARK, "\ufffd"), rule.pattern, f"{MARK}$0{MARK}")
    pieces = F.split(marked, MARK, -1)
    found = lambda p: F.char_length(p if rule.group == 0 else F.regexp_extract(p, rule.pattern, rule.group)) >= rule.least
    sized = F.transform(pieces, lambda p, i: F.struct(F.char_length(p).cast("long").alias("n"), F.when(i % 2 == 1, found(p)).otherwise(False).alias("hit")))
    none = "array<struct<start:bigint,end:bigint>>"

    def add(state: Column, piece: Column) -> Column:
        end = state["at"] + piece["n"]
        return F.struct(end.alias("at"), F.when(piece["hit"], F.concat(state["out"], F.array(F.struct(state["at"].alias("start"), end.alias("end"))))).otherwise(state["out"]).alias("out"))

    def chunk(state: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(state["at"].alias("at"), F.array().cast(none).alias("out")), add)
        return F.struct(own["at"].alias("at"), F.concat(state["outs"], F.array(own["out"])).alias("outs"))

    def whole(all_pieces: Column) -> Column:
        n = F.size(all_pieces)
        parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda i: F.slice(all_pieces, i * CHUNK + 1, CHUNK))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{none}>").alias("outs"))
        return F.flatten(F.aggregate(parts, start, chunk)["outs"])

    return F.when(F.size(pieces) > 1, whole(sized)).otherwise(F.array().cast(none))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan(docs: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE) -> DataFrame:
    """(path, blob, findings) for every row of docs; findings: array<struct<start, kind, end, rule>> in order of start,
    then of the rules. ledger: a shared folder, which this appends to; None: a new one beside the checkpoints."""
    spark = docs.sparkSession
    use_checkpoint_dir(spark)
    ledger = ledger or f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}"
    body = docs.select(F.col(f"`{path}`").alias("path"), F.col(f"`{text}`").alias("text"))
    versions = cut(body.select("path", blob_of(F.col("text")).alias("blob")))
    asked = F.broadcast(spark.createDataFrame([(r.name, r.version, i) for i, r in enumerate(rules)], "rule string, version int, kind int"))
    schema = "blob binary, spans array<struct<start:bigint,end:bigint>>, rule string, version int"
    of_rules = reduce(lambda a, b: a | b, ((F.col("rule") == r.name) & (F.col("version") == r.version) for r in rules))
    todo = versions.select("blob").distinct()
    if exists(spark, ledger):
        known = spark.read.schema(schema).parquet(ledger).where(of_rules).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        lacking = F.array_except(F.array(*(F.lit(r.name) for r in rules)), F.coalesce("seen", F.array().cast("array<string>")))
        todo = todo.join(known, "blob", "left").select("blob", lacking.alias("rules")).where("size(rules) > 0")
    else:
        todo = todo.select("blob", F.array(*(F.lit(r.name) for r in rules)).alias("rules"))
    todo = cut(todo)
    # Each text once: combined within tasks, so that copies don't meet in one.
    held = body.select(blob_of(F.col("text")).alias("blob"), "text")
    unseen = held.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
    entries = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.when(F.array_contains("rules", r.name), spans(F.coalesce("text", F.lit("")), r)).alias("spans")) for r in rules))
    new = unseen.select("blob", F.explode(entries).alias("e")).select("blob", "e.*").where("spans is not null")
    new.select("blob", "spans", "rule", "version").write.mode("append").partitionBy("rule", "version").parquet(ledger)

    known = spark.read.schema(schema).parquet(ledger).where(of_rules)
    current = known.where("size(spans) > 0").join(asked, ["rule", "version"])
    each = current.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("kind").alias("kind"), s["end"].alias("end"), F.col("rule").alias("rule"))).alias("own"))
    found = each.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("findings"))
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = versions.withColumn("salt", F.pmod(F.xxhash64(F.col("path")), F.lit(SALTS)).cast("int"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,rule:string>>")
    return salted.join(spread, ["blob", "salt"], "left").select(F.col("path").alias(path), "blob", F.coalesce("findings", empty).alias("findings"))


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def redact(docs: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE, mark: str = "[SECRET]") -> DataFrame:
    """docs with every finding in text replaced by mark; overlapping findings by one. Rows without findings stay as
    they are, and every row stays."""
    found = scan(docs, ledger, path, text, rules).where("size(findings) > 0").select("blob", "findings").dropDuplicates(["blob"])
    blob, findings = free_name(docs, "blob"), free_name(docs, "findings")
    found = found.withColumnRenamed("blob", blob).withColumnRenamed("findings", findings)
    merge = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    merged = F.aggregate(F.col(findings), F.array().cast("array<struct<start:bigint,end:bigint>>"), merge)
    body = F.col(f"`{text}`")
    cuts = F.aggregate(
        merged,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(body, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))).alias("out")),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(body, (a["at"] + 1).cast("int"), F.char_length(body))),
    )
    salt = free_name(docs, "salt")
    spread = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = docs.withColumn(blob, blob_of(body)).withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{path}`")), F.lit(SALTS)).cast("int")).join(spread, [blob, salt], "left")
    return joined.withColumn(text, F.when(F.col(findings).isNotNull(), cuts).otherwise(body)).select(*docs.columns)
