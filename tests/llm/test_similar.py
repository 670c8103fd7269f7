import random

import corpus_pipeline
from tessera.llm import simhash, similar


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_links_are_exactly_those_of_four_fifths(spark):
    random.seed(4)
    texts = []
    for _ in range(12):  # edits around the limit, short texts too
        base = [f"w{random.randrange(3_000)}" for _ in range(random.choice([9, 12, 40, 200]))]
        for edits in (0, 1, 1, 2, 3, 4, 5):
            words = list(base)
            for at in random.sample(range(len(words)), min(edits, len(words))):
                words[at] = f"x{random.randrange(9_000)}"
            texts += [words, words[: -random.randint(1, 4)]]
    label = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert 20 < len(set(label)) < len(texts) - 20
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar.near_duplicates(frame).collect()} == dict(enumerate(label))


def test_a_family_of_a_third_of_all_rows_in_small_blocks(spark, monkeypatch):
    """Chains of edits, so that the family's ends don't link; blocks, batches and crowds so small that each way is taken."""
    random.seed(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(180):
        words = list(base)
        for at in random.sample(range(150), random.choice([0, 1, 2, 3, 4, 6])):
            words[at] = f"x{k}y{at}"
        texts.append(words)
    texts += [[f"v{random.randrange(5_000)}" for _ in range(60)] for _ in range(360)]
    random.shuffle(texts)
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] & sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert 380 < len(set(label)) < 480
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    emitted = []
    whole = similar.apart
    for block, batch, limit, crowd in ((128, 20_000, 4096, 10_000), (8, 64, 16, 10_000), (8, 64, 16, 20)):
        for name, value in (("BLOCK", block), ("BATCH", batch), ("LIMIT", limit), ("CROWD", crowd), ("TIMES", 1)):
            monkeypatch.setattr(similar, name, value)
        monkeypatch.setattr(simhash, "SMALL", 200_000 if block > 8 else 0)  # both ways to components
        monkeypatch.setattr(similar, "FEW", 200_000 if block > 8 else 0)
        monkeypatch.setattr(similar, "apart", lambda *a: emitted.append(similar.cut(whole(*a))) or emitted[-1])
        assert {r.doc_id: r.component_id for r in similar.near_duplicates(frame).collect()} == dict(enumerate(label))
        assert emitted[-1].count() < 180 * 8  # far fewer than the family's 16,110 pairs


def test_documents_that_share_a_long_template_stay(spark):
    """Pairs of similarity 0.57: links of fingerprints merged them through each other."""
    template = [f"t{i}" for i in range(220)]
    rows = [(i, " ".join([*template, *(f"d{i}x{k}" for k in range(80))])) for i in range(150)]
    frame = spark.createDataFrame([*rows, (900, rows[0][1].upper()), (901, rows[0][1] + " end"), (902, None), (903, ""), (None, rows[0][1])], "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, frame, "").collect() if r.doc_id is not None)
    assert kept == [*range(150), 902]


def test_repeated_rows_and_ids_and_no_table_stays(spark):
    """Rows that repeat both id and text; the wide tables are gone afterwards."""
    base = [f"w{i}" for i in range(60)]
    near, other = " ".join([*base[:-1], "x"]), " ".join(f"v{i}" for i in range(60))
    rows = [(1, " ".join(base))] * 3 + [(2, near)] * 2 + [(3, other), (6, other), (4, None), (4, None), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {(r.doc_id, r.component_id) for r in similar.near_duplicates(frame).collect()}
    assert found == {(1, 1), (2, 1), (3, 3), (6, 3), (4, 4), (5, 4)}
    folder = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir() + "/table-*")
    assert not len(folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder))


def test_an_id_of_several_texts_merges_no_groups(spark):
    """Id 1 holds two unlike texts and a near copy of one; each group keeps one row of its own."""
    one, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "wvu")
    rows = [(1, one, "a"), (1, other, "b"), (1, one + " end", "c"), (2, one, "d"), (3, other + " end", "e"), (4, third, "f"), (4, third, "g"), (None, one, "h")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, rows string").repartition(3)
    assert {(r.doc_id, r.component_id) for r in similar.near_duplicates(frame).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    for kept in (similar.distinct(frame).collect(), simhash.distinct(frame, words=1).collect()):
        assert sum(r.text.startswith("w0") for r in kept if r.doc_id) == 1 == sum(r.text == third for r in kept)
        assert sum(r.text.startswith("v0") for r in kept) == 1 and len(kept) == 4
