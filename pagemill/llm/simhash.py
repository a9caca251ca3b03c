"""SimHash near-duplicates: fingerprints that differ in at most two bits, joined into components.

A fingerprint is embedded by the counts of set bits in its 32 two-bit segments, which bitwise arithmetic
packs into one long.  The Manhattan distance of two such vectors never exceeds the number of differing
bits.  Vectors within distance 2 have a grid cell within distance 1 of both, so every distinct vector is
put into the cells at distance 0 and 1 (at most 65) and cells are met on equality.  A cell cannot hold more
than 65 vectors, however large the corpus, since it is itself within distance 1 of all of them.

What shares a cell is verified exactly in the same way on whole fingerprints: two of them differ in at
most two bits if and only if some 64-bit word is within one bit of both, and a word has 65 such
neighbours.  All fingerprints around one word are linked, so a star per word says all links and no group
is expanded into pairs.  Copies with one fingerprint count once in all of this.

Defined results: a null or wordless text has the fingerprint zero and is linked like any other; repeated
rows stay; a row with a null id has a fingerprint and its component's smallest id, or null if the
component has no id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm import near_texts
from pagemill.llm.batches import raw_texts, without_rows
from pagemill.llm.components import component_roots
from pagemill.session import cut_lineage

WORDS, SEED, BITS = 3, 42, 64
_LOW = 0x5555555555555555  # the lower bit of each two-bit segment
BLOCK = 65_536  # shingles hashed at a time


def _bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit; bit 63 first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of shingles by their hashes, as a signed long; without any it is zero."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), BLOCK):
        counts += _bits_set(hashes[start : start + BLOCK])
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of UTF-8 text as a signed long: words split at ASCII white space, A-Z lower-cased."""
    found = text.lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    counts = np.zeros(BITS, np.int64)
    for start in range(0, n, BLOCK):
        part = [found[k + start : min(k + start + BLOCK, n + k)] for k in range(min(words, len(found)))]
        hashes = (xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*part, strict=True)))
        counts += _bits_set(np.fromiter(hashes, np.uint64, len(part[0])))
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, text`` to ``doc_id, text_hash, fp``, row for row; ``text_hash`` is ``xxhash64(text)``."""

    @F.arrow_udf("long")
    def fingerprint_of(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, words) for t in raw_texts(column)], pa.int64())

    key = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")]
    return docs.select(*key, fingerprint_of("text").alias("fp"))


def _word(bits: int) -> Column:
    """A 64-bit word as a signed long."""
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def segment_counts(fp: Column) -> Column:
    """Counts of set bits in two-bit segments (0, 1 or 2), two bits each, in one long."""
    low, high = fp.bitwiseAND(_word(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(_word(_LOW))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def grid_cells(vector: Column) -> Column:
    """The cells within Manhattan distance 1: one count more or less by one.

    0 and 1 change into each other by the lower bit of a segment, 1 and 2 by both bits.
    """
    moves = []
    for k in range(0, BITS, 2):
        upper, both = _word(2 << k), _word(3 << k)
        moves.append(F.when(vector.bitwiseAND(upper) == 0, vector.bitwiseXOR(_word(1 << k))))
        moves.append(F.when(vector.bitwiseAND(both) != 0, vector.bitwiseXOR(both)))
    return F.array(vector, *moves)


def bit_neighbours(fp: Column) -> Column:
    """The words within one bit."""
    return F.array(fp, *(fp.bitwiseXOR(_word(1 << k)) for k in range(BITS)))


def _meeting(rows: DataFrame, key: str, cells: Column) -> DataFrame:
    """Rows ``key, least``: what shares a cell with others, and the smallest there.

    Keys are distinct, so a cell's window has at most 65 rows.
    """
    placed = rows.select(key, F.explode(cells).alias("cell")).filter("cell is not null")
    cell = Window.partitionBy("cell")
    met = placed.withColumns({"least": F.min(key).over(cell), "n": F.count("*").over(cell)})
    return met.filter("n > 1").select(key, "least")


def near_fingerprints(distinct: DataFrame) -> DataFrame:
    """Distinct ``fp`` to links ``a, b``: a star over each set of fingerprints around one word."""
    vectors = distinct.select("fp", segment_counts(F.col("fp")).alias("vector"))
    counted = vectors.groupBy("vector").agg(F.count("*").alias("n"))
    crowded = _meeting(counted, "vector", grid_cells(F.col("vector"))).select("vector")
    shared = counted.filter("n > 1").select("vector")
    candidates = vectors.join(crowded.unionByName(shared).distinct(), "vector").select("fp")
    star = _meeting(candidates, "fp", bit_neighbours(F.col("fp")))
    return star.filter("least <> fp").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, text`` to ``doc_id, text_hash, fingerprint, component_id, kept``, row for row.

    ``kept`` marks the row that stays of its component: smallest id first, null last, then smallest
    hash; several equal rows can be marked.
    """
    marked = cut_lineage(fingerprints(docs, words), "simhash")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    known = cut_lineage(marked.groupBy("fp").agg(F.min(key).alias("first")), "simhash-distinct")
    roots = component_roots(near_fingerprints(known.select("fp")))
    root = F.coalesce("root", "fp").alias("root")
    rooted = known.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", root)
    named = rooted.groupBy("root").agg(F.min("first").alias("first"))
    classes = rooted.select("fp", "root").join(named, "root").drop("root")
    return marked.join(classes, "fp").select(
        "doc_id",
        "text_hash",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, words: int = near_texts.WORDS, similarity: float = near_texts.SIMILARITY) -> DataFrame:
    """One row of each component of texts that are alike with all its columns; of equal rows one stays.

    SimHash fingerprints give the first links, ``near_texts`` checks them and adds what they do not reach.
    """
    judged = cut_lineage(near_texts.near_texts(docs, words, similarity), "simhash-judged")
    dropped = judged.filter(~F.col("kept")).select("doc_id", "text_hash")
    staying = without_rows(docs, dropped)
    again = judged.filter("kept").groupBy("doc_id", "text_hash").count().filter("count > 1").drop("count")
    again = cut_lineage(again, "simhash-equal")
    once = without_rows(docs, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return without_rows(staying, again).unionByName(once)
