"""SimHash components against brute force, with planted neighbours and odd rows."""

import random
import re

import pytest
import xxhash

from pagemill.llm import simhash
from pagemill.llm.components import component_roots


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(shingles))


def slow_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_rows_match_brute_force(spark):
    rnd = random.Random(3)
    base = [rnd.choice("abcdefghij") * rnd.randint(1, 4) for _ in range(400)]
    texts = [None, "", " \t\x0b ", "one", "Two  words", "É ÀB c d\x1ce f", "long " * 70000]
    for k in range(40):
        words = list(base)
        words[k] = f"x{k % 25}"
        texts += [" ".join(words), " ".join(words).upper()]
    texts += [" ".join(rnd.sample(base, 30)) for _ in range(20)]
    rows = [(3 * i, t, f"other {i}") for i, t in enumerate(texts)] + [(6, " \t\x0b ", ""), (None, "one", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    fps = [(i, slow_fingerprint(t)) for i, t, _ in rows]
    known = sorted({f for _, f in fps})
    near = [(a, b) for a in known for b in known if a < b and (a ^ b).bit_count() <= 2]
    assert near
    roots = slow_components(near, known)
    first = {}
    for i, f in fps:
        if i is not None:
            first[roots[f]] = min(first.get(roots[f], i), i)
    want = [(i, f"{f:016x}", first.get(roots[f])) for i, f in fps]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_links_of_planted_fingerprints_are_complete(spark):
    rnd = random.Random(5)
    known = {rnd.getrandbits(64) for _ in range(60)}
    for f in list(known):
        for _ in range(6):
            known.add(f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
            known.add(f ^ (1 << 63) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in known]
    links = simhash.near_fingerprints(spark.createDataFrame(signed, "fp long"))
    got = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    want = [(a, b) for a in known for b in known if a < b and (a ^ b).bit_count() <= 2]
    groups = [slow_components(p, known) for p in (got, want)]
    assert groups[0] == groups[1]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)]])
def test_components(spark, edges):
    df = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    got = {r["node"]: r["root"] for r in component_roots(df).collect()}
    assert got == {n: min(x for e in edges for x in e) for e in edges for n in e if n != min(map(min, edges))}
