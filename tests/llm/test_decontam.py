import random

from pyspark.sql import functions as F

from tessera.llm import decontam, queries

random.seed(8)
VOCABULARY = [f"word{i}" for i in range(300)]
ITEMS = [(i, " ".join(random.choices(VOCABULARY, k=20)).capitalize() + ". " + " ".join(random.choices(VOCABULARY, k=10)) + ".") for i in range(60)]


def brute(index, terms):
    scores = {}
    for t in terms:
        for d, x in index.postings[t]:
            scores[d] = scores.get(d, 0) + x
    return {d for d, x in scores.items() if x >= decontam.RETRIEVE - 1e-9}


def test_wand_finds_every_item_above_the_threshold():
    index = decontam.Index(ITEMS)
    for _ in range(300):
        terms = sorted(random.sample(range(len(index.terms)), random.randint(1, 400)))
        for d in random.sample(range(60), 3):
            own = [t for t, p in enumerate(index.postings) if any(x == d for x, _ in p)]
            terms = sorted({*terms, *random.sample(own, random.randint(0, len(own)))})
        assert {d for d, _ in index.search(terms)} == brute(index, terms)


def test_hits_and_edges(spark):
    noise = lambda n: " ".join(random.choices(VOCABULARY, k=n))
    changed = ITEMS[3][1].split()
    changed[4], changed[25] = "other", "thing"
    rows = [
        (1, noise(900) + " " + ITEMS[1][1].upper().replace(" ", "\n  ") + " " + noise(500)), (2, noise(2_000)), (3, " ".join(changed)), (4, None), (5, ""), (6, ITEMS[5][1]), (6, ITEMS[5][1]),
        (None, ITEMS[7][1] + noise(300) + ITEMS[8][1]), (9, " ".join(ITEMS[9][1].split()[:18])), (10, " ".join(sorted(ITEMS[10][1].split()))),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("score", F.lit(1))
    items = spark.createDataFrame([*ITEMS, ITEMS[1], (70, None), (71, "one"), (72, "")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontam.matches(frame, items).collect()), key=str)
    assert got == sorted([(1, 1), (3, 3), (6, 5), (6, 5), (None, 7), (None, 8)], key=str)
    assert sorted(r.doc_id for r in decontam.clean(frame, items).collect()) == [2, 4, 5, 9, 10]
    assert decontam.matches(frame.limit(0), items).count() == 0 and decontam.matches(frame, items.limit(0)).count() == 0


def test_parts_change_no_row(spark, monkeypatch):
    rows = [(i, " ".join(random.choices(VOCABULARY, k=300)) + " " + ITEMS[i][1] + " tail") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([*ITEMS, ITEMS[1], (70, None), (71, "one"), (72, ITEMS[2][1])], "item_id long, text string")
    whole = sorted(decontam.matches(frame, items).collect())
    assert len(whole) == 61
    monkeypatch.setattr(decontam, "PART_BYTES", 6_000)
    assert sorted(decontam.matches(frame, items).collect()) == whole
    assert decontam.clean(frame, items).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    items = {r.item_id: decontam.words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        text = f" {' '.join(decontam.words(r.text))} "
        want |= {(r.doc_id, i) for i, w in items.items() if f" {' '.join(w)} " in text}
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, sf_dir).collect()}
    assert want and got == want
