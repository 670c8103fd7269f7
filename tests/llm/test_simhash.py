import random

import numpy as np
import xxhash

from tessera.llm import queries, simhash


def brute(text, words=3):
    found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(prints, errors=3):
    """Smallest index of each index's group."""
    label = list(range(len(prints)))
    changed = True
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= errors]
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return label


def test_fingerprints():
    for t in [None, "", " \n", "One", "one TWO", "Ünder a b C d\x0be f\x85g " * 9, "x y z"]:
        assert simhash.fingerprint(t) == brute(t)


def planted(n, seed):
    random.seed(seed)
    out = []
    for _ in range(n):
        p = random.getrandbits(64) if not out or random.random() < 0.4 else random.choice(out)
        for _ in range(random.randint(0, 4)):
            p ^= 1 << random.randrange(64)
        out.append(p)
    return out


def test_trie_join_finds_every_link():
    prints = np.unique(np.array(planted(300, 1), dtype=np.uint64))
    x, y = simhash.join_tries(prints, np.array([[0, len(prints)]]), np.array([[0, len(prints)]]), 3)
    own = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    v = prints.tolist()
    assert own == {(i, j) for j in range(len(v)) for i in range(j) if (v[i] ^ v[j]).bit_count() <= 3}


def test_groups_with_and_without_splitting(spark):
    base = planted(150, 5)
    prints = list(dict.fromkeys([*base, *((base[0] & ~0xFFFF) | random.getrandbits(16) for _ in range(120)), 0, 1]))
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for leaf in (512, 8):
        edges = [(r.a, r.b) for r in simhash.links(frame, 3, leaf).collect()]
        place = {p: i for i, p in enumerate(signed)}
        label = simhash.forest(len(prints), np.array([place[a] for a, _ in edges]), np.array([place[b] for _, b in edges]))
        assert label.tolist() == groups(prints)


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(80), random.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 201 + i) for i in range(20)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = simhash.forest(300, np.array([u for u, _ in edges]), np.array([v for _, v in edges]))
    assert got == {n: label[n] for n in range(300) if label[n] != n}


def test_edges(spark):
    rows = [(3, "a b c d"), (1, "A B\nC D"), (9, None), (7, ""), (7, ""), (None, "a b c d"), (12, "q " * 9_000)]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (9, 7), (7, 7), (7, 7), (None, None), (12, 12)], key=str)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id)
    prints = [brute(r.text) for r in rows]
    label = groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, sf_dir).collect()}
    assert got == {r.doc_id: (f"{p:016x}", rows[g].doc_id) for r, p, g in zip(rows, prints, label, strict=True)}


def test_partners_are_real_links(spark):
    random.seed(11)
    bases = [random.getrandbits(64) for _ in range(40)]
    values = sorted({b ^ sum(1 << k for k in random.sample(range(64), random.randint(0, 5))) for b in bases for _ in range(40)})
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    near = lambda a, b: 0 < ((a ^ b) % (1 << 64)).bit_count() <= 3
    linked = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), leaf=8, partners=3).collect()}
    assert linked and all(a < b and near(a, b) for a, b in linked)
    assert {b for _, b in linked} == {b for b in signed if any(a < b and near(a, b) for a in signed)}
