"""Secret formats: candidates, scores and spans against plain versions, and texts full of spans."""

import math
import random
import re
import time
from fractions import Fraction

import pytest

from pagemill.llm import secret_scan as ss


def slow_candidates(text, base):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text):
        spans = {m.span()}
        for separators in ("=", "=/", "=/."):
            at = m.start()
            for part in re.split(f"[{separators}]", m[0]):
                spans.add((at, at + len(part)))
                at += len(part) + 1
        out += sorted((s for s in spans if s[1] - s[0] >= 12 and not any(c <= s[0] and s[1] <= d for c, d, _, _ in base)), key=lambda s: (s[0] - s[1], s))
    return out


def slow_spans(text, base, formats):
    out = []
    for a, b in slow_candidates(text, base):
        if not any(c <= a and b <= d for c, d in out) and any(f.gain(ss.classes_of(text[a:b])) >= least for f, least in formats):
            out.append((a, b))
    return [(a, b, "format", text[a:b]) for a, b in sorted(out)]


def texts(seed, n):
    rnd = random.Random(seed)
    parts = ["=", "/", ".", " ", "\n", "token: ", "PASSWORD=", "AKIA", "x", "+", "-", "_", "é"]
    for _ in range(n):
        pieces = []
        for _ in range(rnd.randint(0, 40)):
            alphabet = rnd.choice(["0123456789abcdef", "ABCXYZ019", "abcdefghijkl", "aZ9+"])
            pieces.append(rnd.choice(parts) if rnd.random() < 0.4 else "".join(rnd.choices(alphabet, k=rnd.randint(1, 30))))
        yield "".join(pieces)


@pytest.fixture(scope="module")
def formats():
    rnd = random.Random(3)
    make = lambda alphabet, k: ["".join(rnd.choices(alphabet, k=k)) for _ in range(60)]
    return ss.fit({"hex": make("0123456789abcdef", 24), "access": ["AKIA" + v for v in make("ABCXYZ019", 16)], "assign": make("abc123XYZ", 14)})


def test_candidates_and_spans_of_random_texts(formats):
    found = 0
    for text in texts(4, 1500):
        base = ss.base_spans(text)
        assert ss.candidates(text, base) == slow_candidates(text, base)
        got = ss.format_spans(text, base, formats)
        assert got == slow_spans(text, base, formats)
        found += len(got)
    assert found > 20


def test_gain_is_the_likelihood_of_the_way_through_the_automaton(formats):
    rnd = random.Random(5)
    for automaton, _ in formats:
        for _ in range(200):
            value = [rnd.randrange(ss.CLASSES) for _ in range(rnd.randint(1, 20))]
            state, ways = 0, Fraction(1)
            for c in [*value, None]:
                seen = automaton.ended[state] if c is None else automaton.counts[state].get(c, 0)
                total = automaton.passed[state]
                assert total == automaton.ended[state] + sum(automaton.counts[state].values())
                ways *= (seen + Fraction(1, 10)) / (total + Fraction(7, 10)) * 7
                state = automaton.next[state].get(c) if c is not None else state
                if state is None:
                    break
            got = automaton.gain(value)
            assert got == -math.inf if state is None else got == pytest.approx(math.log2(ways) / (len(value) + 1))


def test_merged_states_keep_the_sample_s_counts(formats):
    for automaton, _ in formats:
        assert automaton.passed[0] >= 60 and len(automaton.passed) < 200
        for state, ways in enumerate(automaton.next):
            assert ways.keys() == automaton.counts[state].keys()


def test_a_text_full_of_hashes_takes_linear_time(formats):
    rnd = random.Random(6)

    def seconds(n):
        text = "\n".join(f"{rnd.getrandbits(128):032x} file{i}.bin=AB{rnd.getrandbits(60):x}Zq" for i in range(n))
        start = time.process_time()
        base = ss.base_spans(text)
        spans = ss.format_spans(text, base, formats)
        return time.process_time() - start, len(base), len(text), spans

    took, n, size, _ = seconds(40_000)
    assert n >= 40_000 and size > 2_000_000 and took < 20
    one_run = "=".join(f"{rnd.getrandbits(96):024x}" + "Q" for _ in range(30_000))
    start = time.process_time()
    ss.format_spans(one_run, ss.base_spans(one_run), formats)
    assert time.process_time() - start < 20


def test_the_sample_is_drawn_in_one_pass(spark):
    rows = [(i, f"token={'ab12' * 3}{i:04d} and {'0123456789abcdef'[: 16]}{i:04x}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    formats = ss.learn_formats(docs, sample=20)
    assert len(formats) == 2 and all(f.passed[0] >= 20 for f, _ in formats)
    assert ss.learn_formats(docs.limit(0)) == []
