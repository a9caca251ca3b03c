"""Secret scans: fixed patterns, and formats learned from the credentials that those patterns find.

The base patterns give labelled credentials (the value of an assignment, an access key, a run of hex
digits).  From at most ``sample`` distinct ones per kind (those with the smallest hash, a documented
bound on the fit alone) a probabilistic automaton is inferred by state merging: the prefix tree of the
strings, character by character in classes, is folded from the root outwards, and two states are merged
when a Hoeffding test finds their ends and next classes compatible, recursively.

Then every candidate of every text is scored: runs of ``LEAST`` or more credential characters, and their parts
between ``=``, between these and ``/``, and between these and ``.``, unless a base span holds them whole.  It is scored by its log-likelihood per character under each automaton, less that under
a model in which all classes are equally likely to follow.  It is reported as ``format`` when the best
score reaches what all but a hundredth of the sample of that kind reach, and is at least ``LEAST_GAIN``.
The automata are what is broadcast: a few states each.

Defined results: a null text is empty and has no spans; base spans always stay, in code points with
exclusive end; repeated rows and null ids stay; without any credential nothing is learned and no span is
added; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.batches import map_columns, texts

# Fixed patterns: kind, expression, group that is measured, its least length, in the order of kinds
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]+", re.ASCII)
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
KINDS = {"assign": 0, "access": 1, "hex": 2, "format": 3}
_HINT = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_LONG_HEX = re.compile(r"[0-9a-f]{16,}", re.ASCII)
LEAST = 12  # characters of a candidate, as of the shortest credential
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}", re.ASCII)
_PLAIN = frozenset("=/.")
_PARTS = [re.compile(rf"[A-Za-z0-9{c}_-]{{{LEAST},}}", re.ASCII) for c in ("+/.", "+.", "+")]

SAMPLE = 500
ALPHA = 0.05  # of the Hoeffding test
LEAST_COUNT = 8  # states seen less often are compatible with any
LEAST_GAIN = 0.35  # bits per character above the model without a format
CLASSES = 6


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """``start, end, kind, value`` of the base patterns, ordered by start and kind."""
    found = []
    for kind, pattern, group, least in BASE:
        if (kind == "assign" and not _HINT.search(text)) or (kind == "access" and "AKIA" not in text):
            continue
        if kind == "hex":  # a run of hex digits is maximal, so short runs can be skipped at once
            pattern = _LONG_HEX
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), m.end(), kind, m[group]))
    return sorted(found, key=lambda s: (s[0], KINDS[s[2]]))


def candidates(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int]]:
    """Runs and their parts that no base span holds whole, the longest of a run first; linear in spans but for a search."""
    starts, ends = [s[0] for s in base], list(accumulate((s[1] for s in base), max))
    out = []
    for m in _CANDIDATE.finditer(text):
        spans = {m.span()}
        if not _PLAIN.isdisjoint(m[0]):
            spans.update(p.span() for part in _PARTS for p in part.finditer(text, *m.span()))
        for a, b in sorted(spans, key=lambda s: (s[0] - s[1], s)):
            before = bisect_right(starts, a)
            if not before or ends[before - 1] < b:
                out.append((a, b))
    return out


# --- grammar inference --------------------------------------------------------------------------------


def classes_of(value: str) -> list[int]:
    """Digit, a-f, g-z, A-F, G-Z, other."""
    return [
        0 if "0" <= c <= "9" else 1 if "a" <= c <= "f" else 2 if "g" <= c <= "z" else
        3 if "A" <= c <= "F" else 4 if "G" <= c <= "Z" else 5
        for c in value
    ]


class Automaton:
    """A probabilistic automaton: per state how often strings pass it, end in it and leave it by a class."""

    def __init__(self) -> None:
        self.passed, self.ended, self.next = [0], [0], [{}]
        self.counts: list[dict[int, int]] = [{}]

    def add(self, value: list[int]) -> None:
        state = 0
        self.passed[0] += 1
        for c in value:
            self.counts[state][c] = self.counts[state].get(c, 0) + 1
            if c not in self.next[state]:
                self.next[state][c] = len(self.next)
                self.passed.append(0)
                self.ended.append(0)
                self.next.append({})
                self.counts.append({})
            state = self.next[state][c]
            self.passed[state] += 1
        self.ended[state] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (n1**-0.5 + n2**-0.5)
        return abs(f1 / n1 - f2 / n2) > bound

    def compatible(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            n, m = self.passed[a], self.passed[b]
            if min(n, m) < LEAST_COUNT:
                continue
            if self._differ(self.ended[a], n, self.ended[b], m):
                return False
            for c in self.counts[a].keys() | self.counts[b].keys():
                if self._differ(self.counts[a].get(c, 0), n, self.counts[b].get(c, 0), m):
                    return False
            pairs += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def fold(self, into: int, state: int) -> None:
        """Add the tree below ``state`` to ``into``."""
        pairs = [(into, state)]
        while pairs:
            a, b = pairs.pop()
            self.passed[a] += self.passed[b]
            self.ended[a] += self.ended[b]
            for c, n in self.counts[b].items():
                self.counts[a][c] = self.counts[a].get(c, 0) + n
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    pairs.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def infer(self) -> Automaton:
        """Merge states from the root outwards; red states stay, blue ones are their other successors."""
        red = [0]
        while True:
            known = set(red)
            blue = next(((s, c) for s in red for c in sorted(self.next[s]) if self.next[s][c] not in known), None)
            if blue is None:
                break
            state = self.next[blue[0]][blue[1]]
            into = next((r for r in red if self.compatible(r, state)), None)
            if into is None:
                red.append(state)
            else:
                self.next[blue[0]][blue[1]] = into
                self.fold(into, state)
        place = {s: i for i, s in enumerate(red)}
        small = Automaton()
        small.passed = [self.passed[s] for s in red]
        small.ended = [self.ended[s] for s in red]
        small.counts = [self.counts[s] for s in red]
        small.next = [{c: place[t] for c, t in self.next[s].items()} for s in red]
        return small

    def gain(self, value: list[int]) -> float:
        """Bits per class over the model without a format, by add-one estimates; a missing way ends it."""
        state, bits = 0, 0.0
        for c in value:
            seen = self.counts[state].get(c, 0)
            bits += math.log2((seen + 0.1) / (self.passed[state] + 0.1 * (CLASSES + 1)) * (CLASSES + 1))
            if c not in self.next[state]:
                return -math.inf
            state = self.next[state][c]
        bits += math.log2((self.ended[state] + 0.1) / (self.passed[state] + 0.1 * (CLASSES + 1)) * (CLASSES + 1))
        return bits / (len(value) + 1)


def fit(values: dict[str, list[str]]) -> list[tuple[Automaton, float]]:
    """An automaton and its least score per kind of credential."""
    out = []
    for kind in sorted(values):
        split = [classes_of(v) for v in values[kind]]
        automaton = Automaton()
        for v in split:
            automaton.add(v)
        automaton = automaton.infer()
        gains = sorted(automaton.gain(v) for v in split)
        out.append((automaton, max(LEAST_GAIN, gains[len(gains) // 100])))
    return out


def format_spans(
    text: str, base: list[tuple[int, int, str, str]], formats: list[tuple[Automaton, float]]
) -> list[tuple[int, int, str, str]]:
    """The candidates that one of the formats explains; none inside another."""
    found: list[tuple[int, int]] = []  # by start, and as none lies in another also by end
    for a, b in candidates(text, base):
        before = bisect_right(found, (a, math.inf))
        if before and found[before - 1][1] >= b:
            continue
        value = classes_of(text[a:b])
        if any(automaton.gain(value) >= least for automaton, least in formats):
            found.insert(before, (a, b))
    return [(a, b, "format", text[a:b]) for a, b in found]


# --- Spark ----------------------------------------------------------------------------------------------


def credentials(docs: DataFrame) -> DataFrame:
    """Labelled credentials of all texts: ``kind, value``, each value at most once per Arrow batch."""

    def work(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for batch in batches:
            found = sorted({(kind, v) for t in texts(batch["text"]) for _, _, kind, v in base_spans(t)})
            yield {"kind": [k for k, _ in found], "value": [v for _, v in found]}

    return map_columns(docs.select("text"), "kind string, value string", work)


def learn_formats(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[Automaton, float]]:
    """Fit on the ``sample`` distinct credentials of each kind whose hash is smallest; long ones are not formats."""
    found = credentials(docs).filter("length(value) <= 256").distinct()
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value"))
    drawn = found.withColumn("place", place).filter(F.col("place") <= sample)
    values: dict[str, list[str]] = defaultdict(list)
    for row in sorted(drawn.collect(), key=lambda r: (r["kind"], r["place"])):
        values[row["kind"]].append(row["value"])
    return fit(values)


def scan(docs: DataFrame, formats: list[tuple[Automaton, float]]) -> DataFrame:
    """``doc_id, text`` to counts and spans per kind, row for row."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def work(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for batch in batches:
            found = [(t, base_spans(t)) for t in texts(batch["text"])]
            base = [s for _, s in found]
            full = [
                sorted(s + format_spans(t, s, shared.value), key=lambda x: (x[0], KINDS[x[2]]))
                for t, s in found
            ]
            yield {
                "doc_id": batch["doc_id"],
                "base": [[{"start": a, "end": b, "kind": k} for a, b, k, _ in s] for s in base],
                "spans": [[{"start": a, "end": b, "kind": k} for a, b, k, _ in s] for s in full],
            }

    span = "array<struct<start:int,end:int,kind:string>>"
    schema = f"doc_id long, base {span}, spans {span}"
    return map_columns(docs.selectExpr("cast(doc_id as long) doc_id", "text"), schema, work)


def redact(docs: DataFrame, formats: list[tuple[Automaton, float]], mark: str = "[secret]") -> DataFrame:
    """The same columns with every span in ``text`` replaced by ``mark``; overlapping spans become one mark."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    @F.pandas_udf("string")
    def clean(column):
        def one(text):
            if not text:
                return text
            base = base_spans(text)
            out, at = [], 0
            for a, b, _, _ in sorted(base + format_spans(text, base, shared.value)):
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return column.map(one, na_action="ignore")

    return docs.withColumn("text", clean("text"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
