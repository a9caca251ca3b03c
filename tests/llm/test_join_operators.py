"""Repeated strings, decontamination, order MinHash and revisits against plain versions, with odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, order_minhash, suffix_array, suffix_dedup, warc_revisits
from pagemill.llm.batches import prepare

# --- suffix arrays and repeated strings ------------------------------------------------------------------


def test_suffix_arrays_match_sorting():
    rnd = random.Random(2)
    for _ in range(800):
        s = [rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(rnd.randint(1, 60))]
        s = np.array(s * rnd.choice([1, 3]), np.int32)
        t = s.tolist()
        sa = suffix_array.suffix_array(s, 1000, small=rnd.choice([2, 1000]))
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        common = suffix_array.common_prefixes(s, sa, np.arange(len(t)), 1000)
        for a, b in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
            n = next((k for k, (x, y) in enumerate(zip(t[a:], t[b:], strict=False)) if x != y), len(t) - max(a, b))
            assert common[a] == n


def slow_repeats(rows, length):
    seen, out = set(), {}
    for key, raw in rows:
        covered = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                covered[i : i + length] = b"\x01" * length
            seen.add(raw[i : i + length])
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        runs = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out[key] = (len(raw), len(raw) - len(kept), runs, kept)
    return out


@pytest.mark.parametrize("limits", [{}, {"shard_bytes": 300}, {"most": 1}])
def test_repeated_strings(spark, limits):
    rnd = random.Random(11)
    passage = "".join(rnd.choices("abcdé ", k=60))
    texts = [None, "", "short", passage, passage, "x" * 90, "ab" * 60]
    for _ in range(40):
        own = "".join(rnd.choices("abcdefgh", k=rnd.randint(0, 80)))
        a, b = sorted(rnd.sample(range(61), 2))
        texts.append(own + passage[a:b] + own[::-1] + rnd.choice(["", passage, own]))
    rows = [(7 * i, t, "clash") for i, t in enumerate(texts)]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string, spans string").repartition(4)
    got = suffix_dedup.remove_repeats(df, length=20, anchor=8, **limits).collect()
    want = slow_repeats([(i, (t or "").encode()) for i, t, _ in rows], 20)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == want
    assert len(got) == len(rows)


def test_repeated_strings_of_odd_rows(spark):
    text = "the same text of more than twenty bytes"
    rows = [(1, text), (1, text), (2, text), (None, text), (1, "another text under the same id, " + text), (None, None)]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(df, 20, 8).collect())
    n = len(text)
    first = got[(1, 0)]
    assert first in (1, 2)  # either of the two texts of id 1 may come first, by hash
    assert got[(2, n)] == 1 and got[(None, n)] == 1 and got[(None, 0)] == 1 and sum(got.values()) == 6
    assert suffix_dedup.remove_repeats(df.limit(0), 20, 8).count() == 0


# --- decontamination ----------------------------------------------------------------------------------------

ITEM = "If Tom Miller buys 12 apples and 30 pears for 4 kg of sugar then how many fruits does Tom Miller hold at the end of day 12 exactly"
RENAMED = "Today. If anna Schmidt buys 7 apples and 99 pears for 5 kg of sugar then how many fruits does anna Schmidt hold at the end of day 7 exactly, they ask."


def test_decontamination(spark):
    renamed = RENAMED.replace("anna", "Anna")
    mixed = renamed.replace("day 7", "day 8").replace("does Anna Schmidt", "does Paul Meier").replace("99 pears", "7 pears")
    half = " ".join(ITEM.split()[:8])
    rows = [
        (1, f"before {ITEM} after"), (2, renamed), (3, mixed), (4, None), (5, ""), (6, "12 13 14 15 16 17 18 19 20"),
        (7, ITEM.upper()), (8, half + " and nothing more of it at all"), (9, "two words"), (9, "two words more"), (None, ITEM), (2, renamed),
    ]
    rows = [(*r, "clash") for r in rows]
    items = [(100, ITEM), (101, "two words"), (102, None), (103, ""), (104, "1 2 3 4 5 6 7 8 9"), (100, ITEM)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, items string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs, benchmark).collect()
    assert len(got) == len(rows)
    held = Counter((r["doc_id"], *r["items"]) for r in got if r["contaminated"])
    assert held == Counter({(1, 100): 1, (2, 100): 2, (7, 100): 1, (9, 101): 1, (None, 100): 1})
    left = decontaminate.keep_clean(docs, benchmark)
    assert left.columns == docs.columns and left.count() == len(rows) - 6
    for a, b in ((docs.limit(0), benchmark), (docs, benchmark.limit(0))):
        assert decontaminate.decontaminate(a, b).filter("contaminated").count() == 0


def test_a_repeated_window_counts_once(spark):
    part = " ".join(ITEM.split()[9:17])
    rows = [(1, " so it goes ".join([part] * 40)), (2, part + " or else " + ITEM)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(100, ITEM)], "item_id long, text string")
    got = {r["doc_id"]: (r["items"], r["share"]) for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert got[1] == ([], 0.0) and got[2][0] == [100]


def test_items_of_values_and_first_words(spark):
    sums, short = "12 + 30 = 42 and 17 + 25 = 42 and 3 + 4 = 7", "Name three rivers that cross Europe"
    rows = [(1, f"see {sums} here"), (2, sums.replace("17 + 25", "18 + 24")), (3, f"they asked: {short}, and left"), (4, "1 + 2 = 3 and 4 + 5 = 9 and 6 + 7 = 13")]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(100, sums), (101, short)], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert got == {1: [100], 2: [], 3: [101], 4: []}


def test_decontamination_matches_all_windows(spark, monkeypatch):
    rnd = random.Random(12)
    words = [f"w{chr(97 + i)}" for i in range(20)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(5, 30)))) for i in range(30)]
    texts = []
    for i in range(120):
        own = " ".join(rnd.choices(words, k=rnd.randint(0, 60)))
        texts.append((i, own + " " + rnd.choice(items)[1] + " " + own if i % 3 == 0 else own))
    docs, benchmark = (prepare(spark).createDataFrame(r, s) for r, s in ((texts, "doc_id long, text string"), (items, "item_id long, text string")))

    def grams(text, n):
        w = text.split()
        return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]

    want = {}
    for i, text in texts:
        held = []
        for j, item in items:
            n = min(8, len(item.split()))
            own, there = grams(item, n), set(grams(text, n))
            aligned = sum(g in there for g in own)
            if aligned and aligned / len(own) >= 0.25:
                held.append(j)
        want[i] = held
    for most in (decontaminate.SCREEN_ROWS, 0):  # with and without the screen
        monkeypatch.setattr(decontaminate, "SCREEN_ROWS", most)
        assert {r["doc_id"]: r["items"] for r in decontaminate.decontaminate(docs, benchmark).collect()} == want


def test_windows_are_hashed_once_and_screened(monkeypatch):
    """Words and names are worked out only where they are asked; a screen gives what it has of all windows."""
    hashed = []
    whole = decontaminate.window_hashes
    monkeypatch.setattr(decontaminate, "window_hashes", lambda *a: hashed.append(1) or whole(*a))
    text = " ".join([RENAMED, "Sum. Seven 1 2 3 4 5 6 kg 8 9. Tom Miller buys", ITEM, "It's 3.5 kg, \u00c9t\u00e9 caf\u00e9s. An Old End"])
    known, sizes = decontaminate.Tokens(), [1, 5, 8]
    every = list(decontaminate.windows(text, known, [5, 8], None))
    assert len(hashed) == 2 and {w[4] for w in every} == {True, False}
    words, slots = (decontaminate.template(text, known)[i] for i in (4, 1))
    plain = whole(words, 8) ^ decontaminate._EXACT
    exact = {w[2]: w[1] for w in every if w[0] == 8 and w[4]}
    assert exact == {i: int(plain.view(np.int64)[i]) for i in exact} and slots.any()
    for part in ([], every[::7], every):
        wanted = np.unique(np.array([w[1] for w in part], np.int64).view(np.uint64))
        got = list(decontaminate.windows(text, known, sizes, decontaminate.Screen(wanted)))
        assert got == [w for w in every if np.uint64(w[1] & 0xFFFFFFFFFFFFFFFF) in wanted]


# --- order MinHash -------------------------------------------------------------------------------------------


def slow_sketches(text):
    import re

    chunks = [(m[0], m.start()) for m in re.finditer(r"[^ \t\n\x0b\f\r]{1,16}", text)]
    ends = [p + len(c) for c, p in chunks]
    kmers = []
    for i, (_, start) in enumerate(chunks):
        j = i
        while j + 1 < len(chunks) and j - i < 2 and chunks[j + 1][1] > ends[j]:
            j += 1
        kmers.append(text[start : ends[j]])
    seen, numbered = Counter(), []
    for place, kmer in enumerate(kmers):
        h = xxhash.xxh64_intdigest(kmer.encode(), 42) & ~((1 << 28) - 1)
        g = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)
        g = xxhash.xxh64_intdigest(seen[h].to_bytes(4, "little"), g)
        seen[h] += 1
        numbered.append((g >> 28, place))
    out = []
    for sketch in range(64):
        chosen = sorted(x for x in numbered if x[0] >> 30 == sketch)[:2]
        codes = [g & ((1 << 30) - 1) for g, _ in sorted(chosen, key=lambda x: x[1])]
        if codes:
            h = 42
            for c in codes:
                h = xxhash.xxh64_intdigest(c.to_bytes(8, "little"), h)
            out.append(sketch << 24 | h & 0xFFFFFF)
    return out


def test_sketches_and_neighbours(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "ROWS_PER_BUCKET", 4)
    rnd = random.Random(13)
    texts = [None, "", " \n", "one", "same line\n" * 30, "x" * 100, "é ü ß ñ", "a b a b a b a b"]
    texts += [" ".join(rnd.choices(["alpha", "beta", "gamma", "delta", "longword" * 3], k=rnd.randint(1, 200))) for _ in range(30)]
    rows = [(i * i * 1000 - 50, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sketches string").repartition(4)
    pairs = order_minhash.edited_pairs(df)
    assert "Python" not in (plan := pairs._jdf.queryExecution().toString()) and "Arrow" not in plan
    got = {r["doc_id"]: r for r in pairs.collect()}
    ordered = sorted(((i, t or "") for i, t, _ in rows), reverse=True)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert got[i]["edited"] == edited
        assert sorted(got[i]["sketches"]) == slow_sketches(text)
        assert sorted(got[i]["edited_sketches"]) == slow_sketches(edited)
        assert sorted(got[i]["next_sketches"]) == slow_sketches(after)


def test_neighbours_of_odd_rows(spark):
    rows = [(5, "five"), (5, "five"), (5, "other five"), (None, "no id"), (None, None), (9, "nine")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert order_minhash.edited_pairs(df).count() == 6
    assert order_minhash.edited_pairs(df.limit(0)).count() == 0
    one = order_minhash.edited_pairs(df.filter("doc_id = 9")).first()
    assert one["next_sketches"] == one["sketches"]


def test_likeness(spark):
    cases = [([], [], 1.0), ([], [1], 0.0), ([1, 2], [1, 2], 1.0), ([1, 2, 3, 4], [1, 9], 0.25)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a array<long>, b array<long>")
    got = [r[0] for r in df.select(order_minhash.likeness(F.col("a"), F.col("b"))).collect()]
    assert got == [c for _, _, c in cases]


# --- revisits ----------------------------------------------------------------------------------------------------


def slow_revisits(rows):
    out = []
    for rid, url, kind, status, at, headers, digest in rows:
        headers = headers or {}
        role = "full" if kind == "response" and status == 200 else "revisit" if kind == "revisit" else "other"
        if role != "revisit":
            out.append((rid, role, None, headers, digest))
            continue
        earlier = [r for r in rows if r[2] == "response" and r[3] == 200 and None not in (r[0], r[4], r[1], rid, at, url) and r[1] == url and (r[4], r[0]) < (at, rid)]
        if not earlier:
            out.append((rid, "no_response", None, headers, digest))
            continue
        ref = max(earlier, key=lambda r: (r[4], r[0]))
        stored = ref[5] or {}
        if "etag" in headers and "etag" in stored:
            fits = headers["etag"].removeprefix("W/") == stored["etag"].removeprefix("W/")
        elif "last-modified" in headers and "last-modified" in stored:
            fits = headers["last-modified"] == stored["last-modified"]
        else:
            out.append((rid, "no_validator", None, headers, digest))
            continue
        if not fits:
            out.append((rid, "mismatch", None, headers, digest))
            continue
        fresh = {k: v for k, v in headers.items() if k not in warc_revisits.KEPT_HEADERS}
        out.append((rid, "resolved", ref[0], {**stored, **fresh}, ref[6]))
    return out


@pytest.mark.parametrize("slice_rows", [50_000, 7])
def test_revisits(spark, slice_rows):
    rnd = random.Random(14)
    rows = []
    for i in range(400):
        url = "http://hot.org/a" if i % 3 else rnd.choice([f"http://s{k}.org/p" for k in range(20)] + [None])
        kind, status = rnd.choice([("response", 200), ("revisit", 304), ("revisit", 304), ("response", 404), (None, None)])
        headers = {"etag": rnd.choice(["W/", ""]) + rnd.choice("ab")} if rnd.random() < 0.7 else {}
        headers |= {"last-modified": rnd.choice("xy")} if rnd.random() < 0.5 else {}
        headers |= {"content-length": str(i), "age": str(i)} if rnd.random() < 0.5 else {}
        at = rnd.choice([None, *range(0, 4000, 40)]) if i else 10**9
        rows.append((i if i != 7 else None, url, kind, status, at, headers if rnd.random() < 0.9 else None, f"d{i}" if kind == "response" else None))
    names = "record_id long, url string, kind string, status int, seconds long, headers map<string,string>, digest string"
    df = spark.createDataFrame(rows, names).withColumn("date", F.timestamp_seconds("seconds")).withColumn("outcome", F.lit("clash"))
    got = warc_revisits.resolve_revisits(df.repartition(4), slice_rows).collect()
    want = slow_revisits(rows)
    assert {x[1] for x in want} >= {"resolved", "mismatch", "no_validator", "no_response", "full", "other"}
    got = [(r["record_id"], r["outcome"], r["ref_id"], r["headers"], r["digest"]) for r in got]
    assert sorted(got, key=lambda r: str(r[0])) == sorted(want, key=lambda r: str(r[0]))
    assert warc_revisits.resolve_revisits(df.limit(0)).count() == 0


def test_urls_and_header_blocks(one):
    url = lambda u: one(warc_revisits.canonical_url(F.col("u")), u=u)
    assert url("https://WWW.A.org:443/P/?q=1#f") == "a.org/P?q=1" and url("http://a.org/") == "a.org" and url(None) is None
    block = "ETag: x\r\nCACHE-control: a\r\nno colon\r\ncache-control:b:c\n"
    assert one(warc_revisits.parse_headers(F.col("b")), b=block) == {"etag": "x", "cache-control": "a, b:c"}
    assert one(warc_revisits.parse_headers(F.col("b")), b="") == {}


