"""Source divergence against plain sums over all kept terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagemill.llm import source_divergence as sd

SCHEMA = "text string, lang string, source string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows, min_docs=10, top=10):
    used, of_lang, in_docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        used[lang or "", source or ""].update(found)
        of_lang[lang or ""].update(found)
        in_docs[lang or ""].update(set(found))
    out = set()
    for lang, source in used:
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]

        def share(counts, term, kept=kept):
            return 1 + 10**9 * (counts[term] + 2) // (sum(counts[t] for t in kept) + 2 * len(kept))

        def ranked(part, items, limit, lang=lang, source=source):
            for k, (value, _, item) in enumerate(sorted((-v, i.encode(), i) for i, v in items)[:limit]):
                out.add((lang, source, part, item, -value, k + 1))

        p = {t: share(used[lang, source], t) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        others = [s for known, s in used if known == lang and s != source]
        ranked("pair", [(s, sum(f(p[t], share(used[lang, s], t)) for t in kept)) for s in others], None)
        q = {t: share(of_lang[lang], t) for t in kept}
        ranked("term", [(t, f(p[t], q[t])) for t in kept if used[lang, source][t] and p[t] > q[t]], top)
    return out


def corpus(seed, n=160):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdeÀé日Z", k=rnd.randint(1, 4))) for _ in range(60)]
    rows = []
    for _ in range(n):
        source = rnd.choice(["s1", "s1", "s1", "s2", "s3", "ß", None])
        lean = [rnd.random() + (hash((source, w)) % 3) for w in words]
        text = rnd.choice(["", None, " ".join(rnd.choices(words, lean, k=rnd.randint(1, 60)))]) if rnd.random() < 0.2 else ", ".join(rnd.choices(words, lean, k=40))
        rows.append((text, rnd.choice(["en", "en", "de", None]), source))
    return [*rows, ("", "xx", "lone"), (None, "xx", "other"), ("rare words", "xx", "third"), ("a", "yy", "lone")]


@pytest.mark.parametrize(("seed", "min_docs"), [(1, 10), (2, 1), (3, 25)])
def test_random_corpora(spark, seed, min_docs):
    rows = corpus(seed)
    got = {tuple(r) for r in sd.divergence(spark.createDataFrame(rows, SCHEMA), min_docs).collect()}
    assert got == slow(rows, min_docs)


def test_blocks_of_peers_and_parts_of_terms(spark, monkeypatch):
    rnd = random.Random(4)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(10)]
    rows = [(" ".join(rnd.choices(words, k=rnd.choice([0, 5, 200]))), rnd.choice(["a", "b"]), f"s{rnd.randrange(23)}") for _ in range(200)]
    monkeypatch.setattr(sd, "PEERS", 5)
    monkeypatch.setattr(sd, "POSTINGS", 100)
    assert {tuple(r) for r in sd.divergence(spark.createDataFrame(rows, SCHEMA), 3).collect()} == slow(rows, 3)


def test_one_source_holds_nearly_everything(spark):
    rows = [("the same words again and again", "en", "hot")] * 3000 + [("the other words", "en", f"s{k % 7}") for k in range(70)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", n int, term string, place int").repartition(7)
    assert {tuple(r) for r in sd.divergence(df).collect()} == slow(rows)


def test_shares_and_distances_do_not_round(spark):
    cases = [(0, 0, 1), (0, 3, 2), (10**13, 10**13, 10**6), (123_456_789_012, 9 * 10**17, 10**9), (7, 7, 1), (1, 10**18, 1)]
    df = spark.createDataFrame(cases, "n long, total long, v long")
    got = [r[0] for r in df.select(sd.share(df["n"], df["total"], df["v"])).collect()]
    assert got == [1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in cases]
    pairs = [(1, 10**9 + 1), (10**9 + 1, 1), (5, 5), (3, 8), (999_999_937, 2)]
    df = spark.createDataFrame(pairs, "p long, q long")
    want = [(p - q) ** 2 // (p + q) for p, q in pairs]
    assert [r[0] for r in df.select(sd.distance(df["p"], df["q"])).collect()] == want
    assert sd._distance(*np.array(pairs).T).tolist() == want


def test_one_very_long_text_and_empty_tables(spark):
    text = " ".join(f"{chr(97 + k % 26)}{'x' * (k % 50)}" for k in range(400_000))
    rows = [(text, "en", "long")] + [("b c d", "en", "short")] * 10
    assert {tuple(r) for r in sd.divergence(spark.createDataFrame(rows, SCHEMA)).collect()} == slow(rows)
    assert sd.divergence(spark.createDataFrame([], SCHEMA)).collect() == []
