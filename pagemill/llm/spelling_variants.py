"""Spelling variants: words one edit apart, found by their permuterm rotations and led to their usual form.

A word is marked with an end sign and rotated: ``b$a`` is the word ``ab`` cut before ``b``.  A replaced, added or lost
character at the cut is the last character of a rotation, so words that differ there share the range of one prefix:
``b$a`` itself is the word without the character, ``b$a`` and one more character are the words with some character
there.  Every word gives its whole rotations and its rotations without the last character; rows are sorted by that
prefix and each range is scanned once.  A range holds at most one word for each letter and one without, so it is
bounded by the alphabet whatever the corpus; it gives each word the number of its neighbours there and the best of
them, never pairs.  Where a lost character stands in a run of equal ones, only the first cut counts.

Words are numbered by falling count and code-point order, so the smallest number is the best neighbour, and rows carry
a number instead of a word.  Prefixes of over ``LONG`` characters are met by a 124-bit digest that all rotations of a
word get in linear time.

Defined results: a null text has no words; a null id hashes as the empty text; repeated rows count as often as they
come; ties go to the smallest word; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.batches import map_columns, texts
from pagemill.session import cut_lineage

SHORTEST, LEAST, RATIO = 5, 3, 2
MARK, LONG = "$", 128
HELD_WORDS, HELD_CHARS = 200_000, 64_000_000  # a worker's counts are handed on beyond either
BATCH = 65_536
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_PRIMES, _BASE = (2_147_483_647, 2_147_483_629, 2_147_483_587, 2_147_483_579), 1_000_003


def runs(text: str) -> list[bytes]:
    """The runs of letters A-Z (lower-cased), a-z and U+00C0 to U+00FF, one byte a code point (Latin-1)."""
    return text.encode("latin-1", "replace").translate(_LOWER).split()


def count_words(docs: DataFrame, shortest: int = SHORTEST, drop_every: int | None = None) -> DataFrame:
    """``doc_id, text`` to ``word, n``: the occurrences of each word of at least ``shortest`` characters.

    ``drop_every`` plants slips: where it divides the CRC-32 ``h`` of ``<doc_id>:<word>``, the word loses the character
    at ``h`` modulo its length in that document.
    """

    def rows(held: Counter) -> dict:
        return {"word": [w.decode("latin-1") for w in held], "n": list(held.values())}

    def work(columns: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        held, read = Counter(), 0
        for c in columns:
            for name, text in zip(c["name"].to_pylist(), texts(c["text"]), strict=True):
                start = zlib.crc32(f"{name or ''}:".encode())
                for run, times in Counter(runs(text)).items():
                    if len(run) < shortest:
                        continue
                    if drop_every:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                        if h % drop_every == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                    if len(run) >= shortest:
                        held[run] += times
                read += len(text)
                if len(held) > HELD_WORDS or read > HELD_CHARS:
                    yield rows(held)
                    held, read = Counter(), 0
        yield rows(held)

    named = docs.select(F.col("doc_id").cast("string").alias("name"), "text")
    return map_columns(named, "word string, n long", work).groupBy("word").agg(F.sum("n").alias("n"))


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out, done = np.ones(n, np.uint64), 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += more
    return out


def _digests(codes: np.ndarray, prime: int, skip: int) -> np.ndarray:
    """Polynomial digests of ``word[i + skip:] + MARK + word[:i]`` at every cut ``i``."""
    n, p = len(codes), np.uint64(prime)
    up, down = _powers(_BASE, n + 2, prime), _powers(pow(_BASE, -1, prime), n + 2, prime)
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[:n] % p) % p])
    cuts = np.arange(n + 1 - skip)
    after = (before[n] + p - before[cuts + skip]) % p * down[cuts + skip] % p
    left = n - skip - cuts
    return (after + np.uint64(ord(MARK)) * up[left] % p + before[cuts] * up[left + 1] % p) % p


def rotation_keys(word: str, skip: int) -> list[str]:
    """The rotations at every cut: whole (``skip`` 0), or without the character after the cut, their last (1)."""
    n = len(word)
    if n + 1 - skip <= LONG:
        return [word[i + skip :] + MARK + word[:i] for i in range(n + 1 - skip)]
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    parts = (_digests(codes, prime, skip).tolist() for prime in _PRIMES)
    return [f"{a:08x}{b:08x}{c:08x}{d:08x}" for a, b, c, d in zip(*parts, strict=True)]


def rotations(ranked: DataFrame) -> DataFrame:
    """``word, rank`` to ``key, rank, edited, first``: ``edited`` where a character was skipped, ``first`` of its run."""

    def work(columns: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for c in columns:
            out: list[list] = [[], [], [], []]
            for word, rank in zip(c["word"].to_pylist(), c["rank"].to_pylist(), strict=True):
                whole, open_ = rotation_keys(word, 0), rotation_keys(word, 1)
                out[0] += whole + open_
                out[1] += [rank] * (len(whole) + len(open_))
                out[2] += [False] * len(whole) + [True] * len(open_)
                out[3] += [False] * len(whole) + [i == 0 or word[i] != word[i - 1] for i in range(len(word))]
                while len(out[0]) >= BATCH:
                    yield dict(zip(("key", "rank", "edited", "first"), (x[:BATCH] for x in out), strict=True))
                    out = [x[BATCH:] for x in out]
            yield dict(zip(("key", "rank", "edited", "first"), out, strict=True))

    return map_columns(ranked.select("word", "rank"), "key string, rank long, edited boolean, first boolean", work)


def neighbours(ranked: DataFrame) -> DataFrame:
    """``word, rank`` of distinct words to ``rank, n_near, best`` for words with a word one edit away.

    ``best`` is the smallest rank among them.  Each range of a prefix is sorted by rank and scanned once.
    """
    scan = Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = rotations(ranked).withColumns(
        {
            "least": F.first("rank").over(scan),
            "second": F.nth_value("rank", 2).over(scan),
            "others": F.count_if("edited").over(scan) - 1,
            "longer": F.count_if("first").over(scan),
            "whole": F.bool_or(~F.col("edited")).over(scan),
        }
    )
    near = F.when(F.col("edited"), F.col("others") + (F.col("whole") & F.col("first")).cast("long")).otherwise(F.col("longer"))
    best = F.when(F.col("rank") == F.col("least"), F.col("second")).otherwise(F.col("least"))
    met = ranges.filter("second is not null").select("rank", near.alias("near"), best.alias("best"))
    return met.groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def chain_ends(links: DataFrame) -> DataFrame:
    """``rank, up`` with ``up`` below ``rank`` to ``rank, end``: where following ``up`` ends, by doubling the jumps."""
    jumps = cut_lineage(links.select("rank", F.col("up").alias("end")), "spelling-jumps")
    while True:
        onward = jumps.withColumnsRenamed({"rank": "middle", "end": "beyond"})
        longer = jumps.join(onward, F.col("end") == F.col("middle"), "left")
        longer = longer.select("rank", F.coalesce("beyond", "end").alias("end"), F.col("beyond").isNotNull().alias("moved"))
        longer = cut_lineage(longer, "spelling-jumps")
        if longer.filter("moved").isEmpty():
            return longer.drop("moved")
        jumps = longer.drop("moved")


def group_variants(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Distinct ``word, n`` to ``word, form, root, n, n_near, form_n``, row for row.

    ``form`` is the near word of largest ``n`` where that is at least ``ratio`` times the word's own, ``root`` the last
    form of the chain.
    """
    numbered = counted.select("word", "n").orderBy(F.desc("n"), "word").withColumn("rank", F.monotonically_increasing_id())
    ranked = cut_lineage(numbered, "spelling-words")
    best = ranked.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    known = ranked.join(neighbours(ranked), "rank", "left").join(best, "best", "left")
    usual = F.col("form_n") >= F.col("n") * ratio
    columns = [F.when(usual, F.col(c)).alias(c) for c in ("best", "form", "form_n")]
    variants = cut_lineage(known.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *columns), "spelling-forms")
    ends = chain_ends(variants.filter("best is not null").select("rank", F.col("best").alias("up")))
    roots = ends.join(ranked.select(F.col("rank").alias("end"), F.col("word").alias("root")), "end").select("rank", "root")
    return variants.join(roots, "rank", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, ratio: int = RATIO, drop_every: int | None = None) -> DataFrame:
    """``doc_id, text`` to one row for each word of at least ``shortest`` characters and ``least`` occurrences."""
    return group_variants(count_words(docs, shortest, drop_every).filter(F.col("n") >= least), ratio)
