import re

import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from tessera.llm import bpe, decontam, quality, queries, similar

DIR = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR).cache()
        counts.append(out.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            docs = out
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] == counts[5] > 0
    codec = bpe.codec(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: codec.decode(bpe.np.array(r.ids)).decode() for r in out.collect()} == texts
    items = [" ".join(decontam.words(r.text)) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert not any(i in " ".join(decontam.words(t)) for i in items for t in texts.values())


def test_empty_and_odd_rows(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(3)
    odd = docs.union(spark.createDataFrame([(None, "token=abcdef12", None, None, None), (7_000, None, "en", "s", 1), (7_001, "", "en", "s", 0), (7_001, "", "en", "s", 0)], docs.schema))
    for frame in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, DIR).count() <= frame.count()
    assert "token=abcdef12" not in {r.text for r in corpus_pipeline.secrets_stage(spark, odd, DIR).collect()}
    assert corpus_pipeline.dedup_stage(spark, odd, DIR).where("doc_id = 7001 or doc_id = 7000").count() == 1


def test_run_is_registered(spark):
    assert queries.QUERIES["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, DIR).columns == ["doc_id", "n_tokens", "ids"]


def test_ended_tasks_leave_no_memory_taken(spark, monkeypatch):
    """Workers are kept for the stages to come, and share an executor's memory with its JVM."""
    frame = spark.createDataFrame([(1, 1, "a b c")], "doc_id long, key long, _text string")
    ran, kind = [], type(frame)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: ran.append((self.columns, f)) or real(self, f, *a, **b))
    quality.word_vectors(frame, "_text")
    similar.prefixes(frame, 5, "doc_id")
    bpe.encode(frame, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "_text")
    assert len(ran) == 4
    anonymous = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
    taken = []
    for rows in (10, 5_000):  # the first time for what stays for good
        for columns, f in ran:
            before = anonymous()
            texts = (" ".join(f"w{i:x}{k:x}" for k in range(250)) for i in range(rows))
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "_text" else pa.array(range(rows), pa.int64()) for c in columns], names=columns)
            for _ in f(iter([batch])):
                pass
            del batch, _
            taken.append(anonymous() - before)
    assert max(taken[4:]) < 40, taken
