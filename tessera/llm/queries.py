"""The registered queries of this subpackage, each over its whole table, and the SQL that states their results."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, decontam, ledger, quality, quoting, shard, simhash, sitetree, topk, toxicity
from tessera.llm.common import cut, use_checkpoint_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + F.lit(8).cast("long")).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key")))
    dealt = shard.histogram_sort(rows, ("key", "doc_id"), "size", 24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}"
    ledger.scan(docs.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 0), folder)  # half the rows' blobs first
    found = ledger.scan(docs, folder)  # all rows; only blobs that are new are scanned
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
    count = lambda rule: F.size(F.filter("findings", lambda s: s["rule"] == rule)).cast("long").alias(f"n_{rule}")
    base = [r.name for r in ledger.BASE]
    return found.select("doc_id", *(count(r) for r in base), F.sha2(listed(F.filter("findings", lambda s: s["rule"].isin(base))), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


@query
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


ORACLES["op4_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


@query
def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quoting.link(table(spark, sf_dir, "conversations"))


def held_out(modulus: int, remainder: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder


def scored(found: DataFrame, out) -> DataFrame:
    """The contract's columns; a null doc_id is nobody's training row, so it counts as held out."""
    return found.select("doc_id", F.coalesce(out, F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(5, 0)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~out)
    return scored(toxicity.score(docs, model), out)


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(3, 1)
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~out)
    return scored(quality.score(docs, model), out)


@query
def op2_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sitetree.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
