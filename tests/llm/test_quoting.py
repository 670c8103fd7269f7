import random

from tessera.llm import queries, quoting


def test_levels_links_and_order(spark):
    rows = [
        (1, 0, "u", "First question?\n\nAnd a second one."),
        (1, 1, "a", "> First question?\nAnswer one."),
        (1, 2, "u", ">> first   QUESTION?\n> Answer one.\nThanks"),
        (1, 3, "a", "> And a second one.\n\nAnswer two.\n> unknown words"),
        (1, 4, "u", "plain"),
        (1, 5, "a", "> answer one.\nlate"),
        (2, 7, None, None), (2, 9, "u", "> \n"), (2, 9, "u", "again"), (None, 1, "u", "> x"), (3, None, "u", "y"),
    ]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, bucket int")
    out = quoting.link(frame).collect()
    assert len(out) == len(rows)
    one = {r.turn: r for r in out if r.conv_id == 1}
    assert [one[t].reply_to for t in range(6)] == [None, 0, 1, 0, 3, 1]
    assert [one[t].text for t in range(6)] == ["First question?\n\nAnd a second one.", "Answer one.", "Thanks", "Answer two.", "plain", "late"]
    assert [one[t].n_quotes for t in range(6)] == [0, 1, 2, 2, 0, 1] and [one[t].n_linked for t in range(6)] == [0, 1, 2, 1, 0, 1]
    assert [one[t].depth for t in range(6)] == [0, 1, 2, 1, 2, 2]
    assert order(spark, out, 1) == [0, 1, 2, 5, 3, 4]
    assert {(r.turn, r.text, r.reply_to) for r in out if r.conv_id == 2} == {(7, "", None), (9, "", 7), (9, "again", 7)}
    assert all(r.depth is None for r in out if r.conv_id is None or r.turn is None)
    assert quoting.link(frame.limit(0)).count() == 0


def order(spark, rows, conv):
    return [r.turn for r in sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.place)]


def test_random_trees_in_preorder(spark):
    random.seed(6)
    rows, parents = [], {}
    for t in range(60):
        to = random.randrange(t) if t and random.random() < 0.4 else t - 1 if t else None
        parents[t] = to
        rows.append((1, 100 * t, "u", f"words {t}" if to is None or to == t - 1 else f"> words {to}\nwords {t}"))
    old, quoting.BUCKET = quoting.BUCKET, 700
    rows += [(2, t, "u", x) for _, t, _, x in rows[:30]]
    out = quoting.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    quoting.BUCKET = old
    assert {r.turn // 100: r.reply_to // 100 for r in out if r.conv_id == 1 and r.reply_to is not None} == {t: p for t, p in parents.items() if p is not None}

    def walk(t):
        return [t, *(x for c in range(60) if parents[c] == t for x in walk(c))]

    assert [t // 100 for t in order(spark, out, 1)] == walk(0)
    assert sorted(r.place for r in out if r.conv_id == 1) == list(range(60))
    depth = lambda t: 0 if parents[t] is None else 1 + depth(parents[t])
    assert all(r.depth == depth(r.turn // 100) for r in out)


def test_a_deep_chain_takes_few_jobs(spark):
    """Each turn quotes the turn two before, so that replies are 1,000 deep and no stretch is longer than one."""
    rows = [(1, t, "u", f"words {t}" if t < 2 else f"> words {t - 2}\nwords {t}") for t in range(2_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.sparkContext.setJobGroup("deep", "deep")
    out = {r.turn: r for r in quoting.link(frame).collect()}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("deep")) < 150  # AQE runs a job for each exchange
    assert all(out[t].reply_to == t - 2 and out[t].depth == out[t - 2].depth + 1 for t in range(2, 2_000))
    assert [out[t].place for t in (0, 1, 3, 1_999, 2, 4)] == [0, 1, 2, 1_000, 1_001, 1_002]


def test_one_passage_quoted_throughout_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(quoting, "BUCKET", 16)
    rows = [(1, t, "u", f"> same words\nown {t}\n\nsame words" if t % 3 else "same words") for t in range(300)]
    out = {r.turn: r for r in quoting.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(out[t].reply_to == t - 1 and out[t].n_linked == (t % 3 > 0) and out[t].place == t == out[t].depth for t in range(1, 300))


def test_query(spark, sf_dir):
    """No message of the tables quotes: each replies to the one before and keeps its text."""
    want, before = [], {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        assert ">" not in r.text
        want.append((r.conv_id, r.turn, r.role, r.text.rstrip(), before.get(r.conv_id), len([w for w in want if w[0] == r.conv_id])))
        before[r.conv_id] = r.turn
    got = sorted(((r.conv_id, r.turn, r.role, r.text.rstrip(), r.reply_to, r.place) for r in queries.op8_quotation_linking(spark, sf_dir).collect()), key=lambda x: x[:2])
    assert got == want


def test_own_passages_and_parts_of_quotes_link(spark):
    rows = [
        (0, "First point\nSecond point\n\nMiddle part\n\nLast part"),
        (1, "> First point\nOwn one\nOwn two\n> Second point\nOwn three\nOwn four"),
        (2, "plain"),
        (3, "> Own three\n> Own four\nto a passage"),
        (4, "plain too"),
        (5, "> Middle part\n>\n> Last part\nto two of three paragraphs"),
        (6, "> First point\n> Second point\n> never said\nto two lines of a passage"),
        (7, "> never said either\nto nobody"),
    ]
    out = {r.turn: r for r in quoting.link(spark.createDataFrame([(1, t, "u", x) for t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert [out[t].reply_to for t in range(8)] == [None, 0, 1, 1, 3, 0, 0, 6]
    assert [out[t].n_linked for t in range(8)] == [0, 2, 0, 1, 0, 1, 1, 0]
