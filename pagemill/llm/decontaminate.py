"""Benchmark decontamination by templates.

Numbers, names (capitalised words inside a sentence) and units behind a number become typed
placeholders; other words are compared in lower case and punctuation is not compared.  Windows of
``window`` tokens of the documents meet the windows of the benchmark on equal hashes.  A match is then
checked for its slots: over all windows of one item that lie on one alignment, the values of the item
must map to the values of the document one to one, so a question with other names and numbers is caught
and an accidental mix of values is not.

An item of fewer than ``window`` tokens has one window as long as itself; with fewer than ``SHORTEST``
tokens it is found only as a document of its own.  A window of more placeholders than words is matched
exactly, with its values, and needs no mapping.  The first word of a sentence is met as a word and, behind
other text, as a name.  A document holds an item if the windows that match on consistent alignments, each
counted once however often the document repeats it, are at least ``min_share`` of the item's windows, or of those that are templates.

The benchmark's window hashes are broadcast as a screen while they are at most ``SCREEN_ROWS`` (counted
first); beyond that all windows of the documents go to the shuffle.  Either way the join decides.

Defined results: null and empty texts hold no item; null or empty items are never found; rows with the
same id and text get the same answer, row for row; null ids stay; empty tables are allowed on both
sides; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.batches import map_columns, texts, without_rows

WINDOW, SHORTEST, MIN_SHARE = 8, 5, 0.25
SCREEN_ROWS = 2_000_000  # 16 MB
KEPT_SURFACES = 400_000  # a worker's memory of tokens; it is emptied when full
_TOKEN = re.compile(r"[a-zA-Z]++[^\W\d_]*+|[.!?\n]|\d++(?:[.,]\d+)*+|[^\W\d_]++|[%€$£]")  # runs of letters, the most common first

# Units that count as one behind a number
UNITS = frozenset(
    "mm cm m km in inch inches ft feet yd yards mile miles mg g kg t lb lbs oz ounces pounds ml cl l liter liters "
    "litre litres gallon gallons s sec seconds min minutes h hr hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur gbp percent degrees celsius fahrenheit kmh mph w kw v hz % € $ £".split()
)
_LITERAL, _END, _NUMBER, _CAPITAL, _UNIT = range(5)
_SLOTS = np.array([0, 0, 11, 22, 33], np.uint64)  # what placeholders hash as, by kind
_EXACT = np.uint64(0xA5A5A5A5A5A5A5A5)  # sets hashes of exact windows apart


class Tokens(dict):
    """Surface form to a 64-bit hash whose last three bits say the kind; computed once per form."""

    def __missing__(self, surface: str) -> int:
        low = surface.lower()
        if surface in ".!?\n":
            kind = _END
        elif surface[0].isdigit():
            kind = _NUMBER
        elif low in UNITS:
            kind = _UNIT
        elif surface[0].isupper() and surface[1:].islower():
            kind = _CAPITAL
        else:
            kind = _LITERAL
        self[surface] = code = xxhash.xxh64_intdigest(low) & ~7 | kind
        return code


def template(text: str, known: Tokens) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the template's tokens, which of them are placeholders, all tokens, and where the template's are among these.

    Then the codes of the tokens as words, and which tokens begin a sentence with a capital.
    """
    if len(known) > KEPT_SURFACES:
        known.clear()
    found = _TOKEN.findall(text)
    codes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    kinds = (codes & np.uint64(7)).astype(np.int8)
    begins = np.concatenate([[True], kinds[:-1] == _END])[: len(kinds)]
    opening = (kinds == _CAPITAL) & begins
    kinds[opening] = _LITERAL
    kept = np.nonzero(kinds != _END)[0]
    codes, kinds, opening = codes[kept], kinds[kept], opening[kept]
    kinds[1:][(kinds[1:] == _UNIT) & (kinds[:-1] != _NUMBER)] = _LITERAL
    if len(kinds) and kinds[0] == _UNIT:
        kinds[0] = _LITERAL
    slots = kinds != _LITERAL
    words = codes | np.uint64(7)
    return np.where(slots, _SLOTS[kinds], words), slots, found, kept, words, opening


def _mixed(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ (mixed >> np.uint64(31))) + codes


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows."""
    out = codes[: max(0, len(codes) - size + 1)].copy()
    for k in range(1, size):
        out = _mixed(out, codes[k : k + len(out)])
    return out


def hashes_at(places: np.ndarray, codes: np.ndarray, size: int, first: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the windows at ``places``; ``first`` has other codes for their first tokens."""
    out = codes[places] if first is None else first
    for k in range(1, size):
        out = _mixed(out, codes[places + k])
    return out


class Screen:
    """Sorted hashes; a table of their first bits turns most others away before the search."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        bits = min(24, max(16, len(hashes).bit_length() + 4))
        self.shift, self.table = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.table[hashes >> self.shift] = True

    def places(self, values: np.ndarray) -> np.ndarray:
        """Where ``values`` are among the hashes."""
        likely = np.nonzero(self.table[values >> self.shift])[0]
        if not len(likely):
            return likely
        wanted = values[likely]
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return likely[self.hashes[at] == wanted]


def windows(text: str, known: Tokens, sizes: list[int], screen: Screen | None) -> Iterator[tuple]:
    """``size, hash, position, slot values, exact`` of the windows that could match.

    A window of more placeholders than words is ``exact``: its hash is that of its tokens with their values.  One that
    begins a sentence with a capital comes as a word and as a name, since inside a sentence it would be a name.
    """
    codes, slots, found, kept, words, opening = template(text, known)
    before = np.concatenate([[0], np.cumsum(slots)])
    for size in sizes:
        if len(codes) < size or (size < SHORTEST and len(codes) != size):
            continue
        n_slots = before[size:] - before[:-size]
        heavy = n_slots * 2 > size
        hashes = window_hashes(codes, size)
        full = np.nonzero(heavy)[0]
        if len(full):
            hashes[full] = hashes_at(full, words, size) ^ _EXACT
        kinds = [(np.arange(len(hashes)), hashes, heavy, False)]
        starts = np.nonzero(opening[: len(hashes)] & ~heavy)[0]
        if len(starts):
            crowded = (n_slots[starts] + 1) * 2 > size
            named = hashes_at(starts, codes, size, np.full(len(starts), _SLOTS[_CAPITAL]))
            named[crowded] = hashes_at(starts[crowded], words, size) ^ _EXACT
            kinds.append((starts, named, crowded, True))
        for places, hashes, exact, as_name in kinds:
            for i in (range(len(hashes)) if screen is None else screen.places(hashes).tolist()):
                at = int(places[i])
                values = [found[kept[j]].lower() for j in range(at, at + size) if slots[j] or (as_name and j == at)]
                yield size, int(hashes[i].astype(np.int64)), at, values, bool(exact[i])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, text`` to ``item_id, n_windows, n_templates, size, hash, at, item_values, exact``."""

    def work(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        known = Tokens()
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"].to_pylist(), texts(batch["text"]), strict=True):
                n = len(template(text, known)[0])
                if n:
                    found = list(windows(text, known, [min(n, window)], None))
                    n_windows, n_templates = (len({w[2] for w in found if all or not w[4]}) for all in (True, False))
                    rows += [(item, n_windows, n_templates, *w) for w in found]
            names = ("item_id", "n_windows", "n_templates", "size", "hash", "at", "item_values", "exact")
            yield {name: [r[i] for r in rows] for i, name in enumerate(names)}

    schema = "item_id long, n_windows int, n_templates int, size int, hash long, at int, item_values array<string>, exact boolean"
    return map_columns(benchmark.selectExpr("cast(item_id as long) item_id", "text"), schema, work)


def document_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_hash, text`` to ``doc_id, text_hash, size, hash, position, values``."""
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most `window` sizes
    screen = None
    if items.select("hash").distinct().count() <= SCREEN_ROWS:
        hashes = items.select("hash").distinct().toArrow().column("hash").to_numpy()
        screen = docs.sparkSession.sparkContext.broadcast(np.sort(hashes.view(np.uint64)))

    def work(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        known, sought = Tokens(), screen and Screen(screen.value)
        for batch in batches:
            rows, ids, hashes = [], batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist()
            for i, text in enumerate(texts(batch["text"])):
                for found in windows(text, known, sizes, sought):
                    rows.append((ids[i], hashes[i], *found[:4]))
            names = ("doc_id", "text_hash", "size", "hash", "position", "values")
            yield {name: [r[k] for r in rows] for k, name in enumerate(names)}

    schema = "doc_id long, text_hash long, size int, hash long, position int, values array<string>"
    return map_columns(docs, schema, work)


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """Documents with the items they hold: ``doc_id, text_hash, item_id, share``."""
    items = benchmark_windows(benchmark, window)
    found = document_windows(docs, items, window).join(items, ["size", "hash"])
    line = ["doc_id", "text_hash", "item_id", F.col("position") - F.col("at")]
    aligned = found.groupBy(*[c if isinstance(c, str) else c.alias("shift") for c in line]).agg(
        F.collect_set(F.when(F.col("exact"), F.col("at"))).alias("exact"),
        F.collect_set(F.when(~F.col("exact"), F.col("at"))).alias("alike"),
        F.first("n_windows").alias("n_windows"),
        F.first("n_templates").alias("n_templates"),
        F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("exact"), F.arrays_zip("item_values", "values"))))).alias("pairs"),
    )
    pairs = F.size("pairs")
    one_to_one = (F.size(F.array_distinct("pairs.item_values")) == pairs) & (
        F.size(F.array_distinct("pairs.values")) == pairs
    )
    alike = F.when(one_to_one, F.col("alike")).otherwise(F.array().cast("array<int>"))  # exact windows need no mapping
    held = aligned.withColumn("alike", alike).groupBy("doc_id", "text_hash", "item_id")
    distinct = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    share = F.size(F.array_union(distinct("alike"), distinct("exact"))) / F.first("n_windows")
    of_templates = F.size(distinct("alike")) / F.nullif(F.first("n_templates"), F.lit(0))
    share = F.greatest(share, F.least(F.lit(1.0), of_templates))  # values of other windows may be new
    return held.agg(share.alias("share")).filter(F.col("share") >= min_share)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows that hold no item, with all their columns."""
    found = find_items(_keyed(docs), benchmark, window, min_share).select("doc_id", "text_hash").distinct()
    return without_rows(docs, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """``doc_id, text`` to ``doc_id, text_hash, contaminated, items, share``, row for row.

    ``text_hash`` is ``xxhash64(text)``, by which a caller can join the answer to the rows.
    """
    rows = _keyed(docs)
    found = find_items(rows, benchmark, window, min_share)
    held = found.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max("share").alias("share")
    )
    held = held.withColumnsRenamed({"doc_id": "h_doc", "text_hash": "h_text"})
    same = F.col("doc_id").eqNullSafe(F.col("h_doc")) & (F.col("text_hash") == F.col("h_text"))
    return rows.drop("text").join(held, same, "left").select(
        "doc_id",
        "text_hash",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("share", F.lit(0.0)).alias("share"),
    )
