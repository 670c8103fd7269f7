import html
import math
import random
import re
import time
from collections import Counter

import pytest

from tessera.llm import queries, sitetree


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
    <nav><ul><li>Home</li></ul></nav><header>Site</header><div class="ad-box big ad">Buy</div><!-- <p>no</p> -->
    <article><header><h1>Head &amp;  line</h1></header><p>One<br>two &lt;b&gt; <b>bold</b>
    text<p>Second &copy; a < b</p><ul><li>x<li>y</ul><div class=share>Share</div><aside>side</aside><form>f <p>q</p></form>
    <section id="comments"><p>Nice!</p></section><p hidden>h</p></article><div id="sidebar">s</div><footer>F</footer></body>"""
    assert sitetree.main_text(page) == "Head & line\nOne two <b> bold text\nSecond © a < b\nx\ny"
    assert sitetree.main_text(None) == "" and sitetree.main_text("plain &amp; simple") == "plain & simple"
    assert sitetree.main_text("<p>a<table><tr><td>b<td>c</table>d") == "a\nb\nc\nd"
    assert sitetree.main_text("<div>" * 5_000 + "deep" + "</div>" * 5_000) == "deep"
    assert sitetree.main_text("<article><p>x</p></article><article class='comment odd'><p>y</p></article>") == "x"
    assert sitetree.main_text("<a href=\"x>q</a> z") == "q z"
    assert sitetree.main_text("a < b <3 <") == "a < b <3 <"


@pytest.mark.parametrize("piece", ["<b>", "</i>", "<a x='", "<a \">\"", "<p><select><b>", "<h2>", "<!--", "<td>", "< ", "<script", "<script>", "<ul><li>", "<a '\">"])
def test_the_parser_is_linear(piece):
    began = time.perf_counter()
    for page in (piece * (300_000 // len(piece)), "<b>" * 30_000 + piece * 20_000, piece * 30_000 + "'", piece * 30_000 + "'>x", "<p><select>" + "<b>" * 30_000 + "<h2></h2>" * 20_000):
        sitetree.parse(page)
    assert time.perf_counter() - began < 20  # quadratic ones took minutes


def test_unmarked_template_is_found_by_importance(spark):
    page = lambda i, n: f"<html><body><div><span>Acme portal</span><span>All rights</span></div><div><p>{' '.join(f'w{i}x{k}' for k in range(20))}</p>{'<p>more %d</p>' % i * (n % 4)}</div><div><i>Call now</i></div></body></html>"
    rows = [(i, f"http://a.example/{i}", page(i, i), 1) for i in range(30)] + [(100, "http://b.example/", page(100, 1), 1), (101, None, None, 1), (None, "http://a.example/x", "", 1), (5, "http://a.example/5", page(5, 5), 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = sitetree.extract(frame).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.page_id is not None and r.page_id < 30:
            assert r.text == "\n".join([" ".join(f"w{r.page_id}x{k}" for k in range(20)), *[f"more {r.page_id}"] * (r.page_id % 4)])
        elif r.page_id == 100:
            assert r.text.startswith("Acme portal")
        else:
            assert r.text == ""
    assert sitetree.extract(frame.limit(0)).count() == 0


def importances(pages):
    """Plain recomputation over whole trees: (host, key) of the topmost low nodes."""
    info, kids = {}, {}
    for host, page in pages:
        for node, up, style, features in sitetree.number(sitetree.parse(page or "")):
            entry = info.setdefault((host, node.key), {"kind": node.kind, "firm": not sitetree.removable(node), "up": up, "styles": Counter(), "features": Counter(), "long": 0})
            entry["styles"][style] += 1
            entry["features"].update(set(features) - {0})
            entry["long"] += 0 in features
            kids.setdefault((host, up), set()).add((host, node.key))
    memo = {}

    def value(k):
        if k not in memo:
            e = info[k]
            m = sum(e["styles"].values())
            total = m + sitetree.OWN
            shares = [n / total for n in e["styles"].values()] + [1 / total] * sitetree.OWN
            presentation = -sum(p * math.log(p) for p in shares) / math.log(total)
            n = len(e["features"]) + e["long"]
            content = 1 - sum(math.log(c) for c in e["features"].values()) / n / math.log(total) if n else None
            below = [c for c in kids.get(k, ()) if info[c]["kind"] != "m"]
            if below:
                weights = [sum(info[c]["styles"].values()) for c in below]
                mean = sum(w * value(c) for w, c in zip(weights, below, strict=True)) / sum(weights)
                memo[k] = 0.5 * (presentation if content is None else content) + 0.5 * mean
            else:
                memo[k] = content or 0.0
        return memo[k]

    low = {k for k, e in info.items() if e["kind"] == "m" or not e["firm"] and value(k) < sitetree.LOW}
    return {k for k in low if (k[0], info[k]["up"]) not in low}


def random_page(rng, i, templates):
    words = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    parts = [rng.choice([f"<p>{words(9)}</p>", f"<p>{words(60)}</p>", f"<div><span>{rng.choice(templates)}</span><i>{words(2)}</i></div>", f"<div>{rng.choice(templates)}</div>", f"<ul><li>{words(3)}<li>{templates[0]}</ul>"]) for _ in range(rng.randrange(1, 5))]
    body = "".join(parts)
    return f"<html><body><nav>{words(2)}</nav><div><b>{templates[1]}</b></div>" + (f"<article><h1>{words(4)}</h1>{body}<div>{templates[2]}</div></article>" if i % 3 else f"<div>{body}</div>") + "<footer>f</footer></body></html>"


def test_importances_match_a_plain_recomputation(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for h, n in (("a", 60), ("b", 25), ("c", 3), ("d", 1)):
        templates = [f"{h} share this", f"{h} all rights", f"{h} subscribe now"]
        rows += [(len(rows) + i, f"http://{h}.example/{i}", random_page(rng, i, templates)) for i in range(n)]
    fixed = "<body><article><h1>w{0}</h1><p>x{0} y{0}</p><div><b>subscribe now</b></div></article></body>"
    rows += [(len(rows) + i, f"http://e.example/{i}", fixed.format(i)) for i in range(40)]
    rows.append((len(rows), None, "<div>" * 40 + "x" + "</div>" * 40))
    want = importances([((u or "//").split("/")[2], p) for _, u, p in rows])
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sitetree.noise(frame.select(sitetree._host(frame.url).alias("host"), "html"))
    assert {(r.host, r.node) for r in got.collect()} == want
    out = {r.page_id: r.text for r in sitetree.extract(frame).collect()}
    inside = [i for i, u, p in rows if u and "//e." in u]
    assert inside and not any("subscribe" in out[i] for i in inside)  # importance decides inside articles
    assert all("subscribe" in sitetree.main_text(rows[i][2]) for i in inside)
    monkeypatch.setattr(sitetree, "FEW", 0)  # each page's nodes by a join
    assert {r.page_id: r.text for r in sitetree.extract(frame).collect()} == out


def test_copies_of_an_article_stay(spark):
    long = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(4)]
    page = lambda i: f"<body><nav>n{i}</nav><article><h1>t{i % 2}</h1>{''.join(f'<p>{x}</p>' for x in long)}<p>end {i % 5}</p></article></body>"
    frame = spark.createDataFrame([(i, f"http://a/{i}", page(i)) for i in range(40)], "page_id long, url string, html string")
    assert all(r.text.count("\n") >= 3 and all(x in r.text for x in long) for r in sitetree.extract(frame).collect())


def test_without_noise_the_tables_texts_change(spark, sf_dir):
    """The tree's low nodes decide what goes from the pages of the tables."""
    got = {r.page_id: r.text for r in queries.op2_site_tree(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        assert sitetree.main_text(r.html, {0}) != got[r.page_id]


def test_query_on_the_tables(spark, sf_dir):
    """These pages keep their article in one element of h1 and p, which a few substitutions take apart."""
    got = {r.page_id: r for r in queries.op2_site_tree(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        inner = re.sub(r"</?b>", "", re.search("<article>(.*)</article>", r.html, re.S)[1]).replace("<br>", " ")
        want = [" ".join(html.unescape(x).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(x for x in want if x) and got[r.page_id].n_chars == len(got[r.page_id].text)
