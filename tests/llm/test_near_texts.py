"""The pipeline's near-duplicates: planted copies from 0.8 on go, those below stay."""

import random

from pagemill.llm import near_texts, simhash


def alike(a, b):
    a, b = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def changed(rnd, text, times):
    words = text.split()
    for at in rnd.sample(range(0, len(words), 6), times):
        words[at] = f"new{rnd.random()}"
    return " ".join(words)


def test_copies_from_the_limit_on_go(spark):
    rnd = random.Random(5)
    rows, goes = [], set()
    for k in range(120):
        text = " ".join(f"w{rnd.randrange(5000)}" for _ in range(300))
        copy = changed(rnd, text, rnd.randint(1, 12))
        rows += [(2 * k, text), (2 * k + 1, copy)]
        if alike(text, copy) >= 0.8:
            goes.add(2 * k + 1)
    assert any(0.8 <= alike(rows[i - 1][1], rows[i][1]) < 0.85 for i in goes) and len(goes) < 110
    left = {r["doc_id"] for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {i for i, _ in rows} - goes


def brute(rows):
    """The ids that stay: the smallest of each component of texts alike by 0.8."""
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids, by_size = sorted(sets), sorted(sets, key=lambda i: len(sets[i]))
    for at, i in enumerate(by_size):
        for j in by_size[at + 1 :]:
            if len(sets[i]) < 0.8 * len(sets[j]) - 1e-9:
                break
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or common + 1e-9 >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in ids if find(i) == i}


def kept(spark, rows):
    judged = near_texts.near_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(judged) == len(rows)
    return {r["doc_id"] for r in judged if r["kept"]}


def count_pairs(monkeypatch):
    """How many pairs each round of checks gets."""
    counts, plain = [], near_texts.alike
    monkeypatch.setattr(near_texts, "alike", lambda pairs, *rest: counts.append(pairs.count()) or plain(pairs, *rest))
    return counts


def test_a_hot_group_meets_at_pivots(spark, monkeypatch):
    rnd = random.Random(6)
    text = " ".join(f"w{rnd.randrange(5000)}" for _ in range(400))
    rows = [(i, changed(rnd, text, 2)) for i in range(300)]
    counts = count_pairs(monkeypatch)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()] == [0]
    assert sum(counts) < 300 * 3


def test_copies_inside_a_template_family(spark, monkeypatch):
    """Texts of one template are alike by some 0.75 and stay; each has one copy at 0.80 to 0.83, which goes."""
    rnd = random.Random(11)
    template, rows, at = [f"t{k}" for k in range(252)], [], []
    for k in range(350):
        text = template + [f"own{k}x{i}" for i in range(40)]
        copy = list(text)
        for i in rnd.sample(range(256, 292), rnd.choice([7, 8])):
            copy[i] = f"new{k}x{i}"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
        at.append(alike(rows[-2][1], rows[-1][1]))
    assert min(at) < 0.9 and alike(rows[0][1], rows[2][1]) < 0.8
    counts = count_pairs(monkeypatch)
    assert kept(spark, rows) == brute(rows)
    assert counts[-1] < 350 * 20  # of 244,000 pairs of the family


def test_families_copies_and_chains_against_all_pairs(spark, monkeypatch):
    rnd = random.Random(12)
    rows = []
    for family in range(8):
        template = [f"f{family}t{k}" for k in range(60)]
        for _ in range(25):
            rows.append(template[: rnd.randint(40, 60)] + [f"own{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 25))])
    for _ in range(150):  # chains: copies of copies
        words = list(rnd.choice(rows))
        for at in rnd.sample(range(len(words)), rnd.randint(0, 2)):
            words[at] = f"new{rnd.randrange(10**6)}"
        rows.append(words)
    lines = [[f"line{k}w{i}" for i in range(12)] for k in range(8)]
    rows += [sum(rnd.sample(lines, rnd.randint(3, 6)), []) for _ in range(150)]  # put together from lines that all share
    rows = list(enumerate(" ".join(words) for words in rows))
    monkeypatch.setattr(near_texts, "MEMBERS", 5)
    monkeypatch.setattr(near_texts, "BLOCKED", 900)
    assert kept(spark, rows) == brute(rows)


def test_a_hot_family_around_the_limit_gives_links_only(spark, monkeypatch):
    """Copies of one text with so many changes that two of them are alike by 0.4 to 0.95."""
    rnd = random.Random(14)
    text = " ".join(f"w{k}" for k in range(150))
    rows = [(i, changed(rnd, text, rnd.randint(0, 9))) for i in range(500)]
    made, plain = [], near_texts.family_links
    monkeypatch.setattr(near_texts, "family_links", lambda *a: made.append(plain(*a)) or made[0])
    counts = count_pairs(monkeypatch)
    assert kept(spark, rows) == brute(rows)
    assert made[0].count() < 500 and sum(counts) < 500 * 10


def test_odd_texts(spark):
    long = " ".join(f"v{k}" for k in range(150_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d e"), (8, "a b c d e f"),
        (9, long), (10, long + " and more"), (11, long[: len(long) // 2]), (12, "a b c d  e"),
    ]
    assert kept(spark, rows) == brute(rows) == {1, 4, 6, 7, 8, 9, 11}
    repeated = [(1, "same text here"), (1, "same text here"), (None, "same text here"), (None, "another"), (0, "same text here")]
    df = spark.createDataFrame([(*r, 1, "x", [2]) for r in repeated], "doc_id long, text string, size int, node string, cells array<int>")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one_of_each(df).collect()), key=str)
    assert got == [(0, "same text here"), (None, "another")]
    assert near_texts.near_texts(df.limit(0)).collect() == []


def test_repeated_rows_of_texts_with_partners(spark):
    rnd = random.Random(13)
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(1, text)] * 40 + [(2, changed(rnd, text, 1))] * 40 + [(3, changed(rnd, text, 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(df).collect()) == [1, 3]


def test_near_fingerprints_give_the_first_links(spark):
    """SimHash pairs join what plain comparison of all fingerprints joins, and link without any cell of hash minima."""
    rnd = random.Random(8)
    rows = []
    for k in range(60):
        text = " ".join(f"w{rnd.randrange(5000)}" for _ in range(400))
        rows += [(3 * k, text), (3 * k + 1, changed(rnd, text, 1)), (3 * k + 2, changed(rnd, text, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = near_texts.sketches(docs).selectExpr("node", "size", "fp", "cells", "low", "struct(doc_id, text_hash) first")
    nodes = {r["node"]: r for r in known.collect()}
    names = {r["first"]["doc_id"]: n for n, r in nodes.items()}

    def components(pairs):
        root = {n: n for n in nodes}
        for a, b in pairs:
            low, high = sorted((root[a], root[b]))
            root = {n: low if r == high else r for n, r in root.items()}
        return root

    near = [(a, b) for a in nodes for b in nodes if a < b and bin((nodes[a]["fp"] ^ nodes[b]["fp"]) & (1 << 64) - 1).count("1") <= 2]
    pairs = [(r["a"], r["b"]) for r in near_texts.near_fingerprint_pairs(known).collect()]
    assert len(near) > 20 and components(pairs) == components(near)
    texts = dict(rows)
    back = {n: i for i, n in names.items()}
    found = near_texts.links(docs, known.selectExpr("node", "size", "fp", "cast(array() as array<long>) cells", "low", "first"))
    assert {(r["a"], r["b"]) for r in found.collect()} == {(a, b) for a, b in pairs if alike(texts[back[a]], texts[back[b]]) >= 0.8}
