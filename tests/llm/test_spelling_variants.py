"""Spelling variants against comparing every word with every other."""

import random
import re
import zlib
from collections import Counter

import pytest

from pagemill.llm import spelling_variants as sv


def edit(a, b):
    """Whether exactly one character is replaced, added or lost."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_words(docs, every):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5}


def slow_variants(words):
    out, forms = {}, {}
    for w, n in words.items():
        near = [v for v in words if edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = len(near)
    rows = set()
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.add((w, forms[w], root, n, out[w], words.get(forms[w])))
    return rows


def test_words_of_texts(spark):
    docs = [(1, "Straße straße, ÀÉÿ×÷ab don't x" * 3), (2, None), (None, "Straße"), (2, ""), (2, "日本hellohello日本 Ünder_score"), (1, "Strasse")]
    for every in (None, 1, 2):
        got = sv.count_words(spark.createDataFrame(docs, "doc_id long, text string"), drop_every=every).collect()
        assert {r["word"]: r["n"] for r in got} == slow_words(docs, every)


@pytest.mark.parametrize("seed", range(3))
def test_random_words(spark, seed):
    rnd = random.Random(seed)
    letters = "aab" if seed == 0 else "abcé"
    words = {"".join(rnd.choices(letters, k=rnd.randint(1, 8))): rnd.choice([1, 2, 2, 4, 9, 40, 300]) for _ in range(250)}
    got = sv.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {tuple(r) for r in got.collect()} == slow_variants(words)


def test_whole_texts_with_slips(spark):
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choices("abcdeo", k=rnd.randint(4, 9))) for _ in range(60)]
    docs = [(i, " ".join(rnd.choices(vocabulary, k=300))) for i in range(40)] * 2
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], "doc_id long, text string, word string, n long, key string")
    got = sv.spelling_variants(df, drop_every=5).collect()
    want = {w: n for w, n in slow_words(docs, 5).items() if n >= 3}
    assert {tuple(r) for r in got} == slow_variants(want) and any(r["form"] for r in got)


def test_chains_of_forms(spark):
    words = {"a" * k + "bcdef": 2**k for k in range(24)} | {"zbcdef": 1, "lonely": 3, "lonelz": 2}
    got = sv.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    rows = {tuple(r) for r in got.collect()}
    assert rows == slow_variants(words) and {r[2] for r in rows} == {"a" * 23 + "bcdef", "lonely", "lonelz"}


def test_very_long_words_meet_by_digest(spark):
    rnd = random.Random(8)
    word = "".join(rnd.choices("abc", k=400))
    edited = [word[:i] + x + word[j:] for i, j, x in ((0, 1, "z"), (399, 400, ""), (200, 200, "q"), (200, 201, "z"), (126, 127, "zz"))]
    short = [w[:n] for w in (word, edited[0]) for n in (126, 127, 128, 129)]
    words = {w: 2**k for k, w in enumerate([*edited, word, *short, word[:50] + word[50:] * 2])}
    got = sv.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {tuple(r) for r in got.collect()} == slow_variants(words)


def test_digests_are_those_of_the_whole_rotation():
    word = "".join(random.Random(9).choices("ab", k=300))
    plain = lambda s: [sum(ord(c) * pow(sv._BASE, k, p) for k, c in enumerate(s)) % p for p in sv._PRIMES]
    for skip in (0, 1):
        got = sv.rotation_keys(word, skip)
        assert len(got) == 301 - skip == len(set(got))
        for i in (0, 1, 7, 150, 299):
            assert got[i] == "".join(f"{d:08x}" for d in plain(word[i + skip :] + "$" + word[:i]))


def test_a_word_of_a_million_letters(spark):
    word = "".join(random.Random(10).choices("abcdefgh", k=1_000_000))
    texts = [word, word[:77] + "z" + word[78:], word] * 2
    got = sv.spelling_variants(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), least=2)
    rows = {r["word"]: (r["form"], r["n"], r["n_near"]) for r in got.collect()}
    assert rows == {texts[0]: (None, 4, 1), texts[1]: (texts[0], 2, 1)}


def test_a_word_with_very_many_neighbours(spark):
    """Every letter of a common word replaced by every other: no range is wider than the alphabet."""
    base, letters = "abcdefghij", "abcdefghijklmnopqrstuvwxyz"
    words = {base[:i] + x + base[i + 1 :] for i in range(10) for x in letters}
    df = spark.createDataFrame([(w, 1_000 if w == base else 3) for w in words], "word string, n long")
    got = {r["word"]: r for r in sv.group_variants(df).collect()}
    assert got[base]["n_near"] == len(words) - 1 and all(r["root"] == base for r in got.values())
    ranked = df.withColumn("rank", df["n"] * 0 + 1)
    assert sv.rotations(ranked).groupBy("key").count().filter("count > 27").isEmpty()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sv.spelling_variants(docs).collect() == []
    assert sv.spelling_variants(spark.createDataFrame([(1, None), (2, "")], docs.schema)).collect() == []
