import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ROWS = [(1, "Hello  world\n"), (2, None), (3, ""), (4, "déjà vu " * 30_000), (5, " " * 5_000 + "x"), (5, " " * 5_000 + "x"), (6, "日本語" * 2_000)]


def library():
    with open(RANKS, "rb") as f:
        return bpe.codec(f.read(), public_tokenizers.PATTERN)._library


def test_random_texts_match_the_library():
    codec = bpe.Codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    pieces = [" ", "  ", "\n", "\t", "\x1c", "\xa0", "a", "é", "1", "²", "'s", "'", "!", "日", "​", ".", "\r\n", "　"]
    random.seed(3)
    for _ in range(5_000):
        text = "".join(random.choices(pieces, k=random.randint(0, 14)))
        ids = codec.encode(text)
        assert ids.tolist() == codec._library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_edges_and_round_trip(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("ids", F.lit("taken"))
    rows = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded="raw").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert bytes(r.raw) == (r.text or "").encode()
        if len(r.text or "") != 5_001:
            assert r.ids == library().encode_ordinary(r.text or "")
    again = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in again.collect())
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_query_against_the_library(spark, sf_dir):
    own = {r.doc_id: r for r in queries.op1_bpe(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library().encode_ordinary(r.text)
        assert own[r.doc_id].n_tokens == len(ids)
        assert own[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert own[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
