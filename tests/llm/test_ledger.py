import hashlib
import random
import re

from tessera.llm import ledger, queries

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = [("assign", ASSIGN, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def brute(text):
    found = sorted((m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m[g]) >= least)
    return [f"{name}:{a}:{b}" for a, _, b, name in found]


SAMPLES = [
    None, "", "no secrets", "é😀 password = 'abcdef' secret:token: abcdef12", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 9 + "\ufdd0AKIA" + "9" * 30,
    "x" * 9_000 + " token=" + "0af" * 9, "API_KEY: " + "f" * 40 + " apikey=abc.def", "0123456789abcdef0123456789api_key=zzzzzz", "passwd=ab " * 3_000 + "Secret=longenough " * 2_000,
]


def test_samples_and_repeats(spark):
    rows = [(i, s, "n") for i, s in enumerate(SAMPLES)] + [(0, None, "n"), (3, SAMPLES[3], "n"), (None, SAMPLES[4], "n"), (99, SAMPLES[3], "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, blob string")
    got = sorted((str(r.doc_id), [f"{s.rule}:{s.start}:{s.end}" for s in r.findings]) for r in ledger.scan(frame).collect())
    assert got == sorted((str(i), brute(s)) for i, s, _ in rows)
    assert ledger.scan(frame.limit(0)).count() == 0


def test_random_texts(spark):
    random.seed(4)
    bits = ["token", "=", ":", " ", "'", '"', "abc", "AKIA", "Z9", "f00d", "secret", "é", "api_key", "\n", "-"]
    rows = [(i, "".join(random.choices(bits, k=random.randint(1, 60)))) for i in range(400)]
    got = {r.doc_id: [f"{s.rule}:{s.start}:{s.end}" for s in r.findings] for r in ledger.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_only_unseen_blobs_and_rules_are_scanned(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    first = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "x")], "doc_id long, text string")
    ledger.scan(first, folder).collect()
    assert spark.read.parquet(folder).count() == 2 * 3
    more = first.union(spark.createDataFrame([(1, "secret: newone1")], "doc_id long, text string"))
    assert sum(len(r.findings) for r in ledger.scan(more, folder).collect()) == 3
    assert spark.read.parquet(folder).count() == 3 * 3
    again = more.union(more).union(spark.createDataFrame([(7, "new text"), (7, "new text"), (None, "new text")], "doc_id long, text string"))
    assert ledger.scan(again, folder).count() == 11
    assert spark.read.parquet(folder).count() == 4 * 3  # repeats are scanned once
    rules = (*ledger.BASE, ledger.Rule("x", "x+"))
    assert sum(len(r.findings) for r in ledger.scan(more, folder, rules=rules).collect()) == 4
    assert spark.read.parquet(folder).where("rule = 'x'").count() == 3
    rules = (*ledger.BASE[:2], ledger.Rule("hex", "f+", version=2))
    assert sum(len(r.findings) for r in ledger.scan(more, folder, rules=rules).collect()) == 5  # the old version's findings are gone
    assert spark.read.parquet(folder).where("rule = 'hex' and version = 2").count() == 3


def test_redaction(spark):
    rows = [(1, "a token=abcdef z"), (2, None), (3, "clean"), (4, "0123456789abcdef0123456789api_key=zzzzzz é" + " AKIA" + "Q" * 16), (4, "clean")]
    out = ledger.redact(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS findings")).collect()
    assert sorted((r.doc_id, str(r.text), r.findings) for r in out) == [(1, "a [SECRET] z", "k"), (2, "None", "k"), (3, "clean", "k"), (4, "[SECRET] é [SECRET]", "k"), (4, "clean", "k")]


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op7_secret_ledger(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        want = brute(r.text)
        assert got[r.doc_id].spans == ",".join(want) and got[r.doc_id].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[r.doc_id].n_hex == sum(w.startswith("hex") for w in want) and got[r.doc_id].n_assign == sum(w.startswith("assign") for w in want)
