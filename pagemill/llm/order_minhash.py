"""Document fingerprints by order MinHash, in DataFrame operations only.

The k-mers of a text are runs of ``WORDS`` words (a word of more than ``WORD_CHARS`` characters counts as
several).  Each k-mer is numbered by its occurrence, so repeats count, and (k-mer, number) is hashed.  The
upper bits of the hash deal it into one of ``SKETCHES`` sketches; a sketch selects its ``PICKED`` smallest,
puts them back into text order and hashes the tuple.  Two texts agree in a sketch only if they share the
selected k-mers in the same order, so the share of agreeing sketches falls with edit distance and not
only with the set of k-mers.

All of it are array expressions inside the document's row, so fingerprints shuffle nothing.  Hash and place
of a k-mer travel in one long, which makes the sorts primitive; a text may have 2^28 words.

Defined results: a null text is empty; a text without words has an empty fingerprint, which is like
another empty one (1.0) and unlike any other (0.0); equal texts have equal fingerprints.  The next
document of ``with_next`` is the one before it by ``doc_id``; null ids come below all others in an order of
their own, repeated ids are ordered by the hash of their text; of one document alone it is itself; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import cut_lineage

WORDS, WORD_CHARS = 3, 16
SKETCH_BITS, PICKED = 6, 2
PLACE_BITS = 28
ROWS_PER_BUCKET, MOST_ROWS = 2_048, 65_536

_PLACE = (1 << PLACE_BITS) - 1
_CODE_BITS = 64 - SKETCH_BITS - PLACE_BITS


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def _hash_part(x: Column) -> Column:
    return x.bitwiseAND(_long((1 << 64) - 1 - _PLACE))


def _sketch(x: Column) -> Column:
    return F.shiftright(x, 64 - SKETCH_BITS)


def _kmers(text: Column) -> Column:
    word = f"\\S{{1,{WORD_CHARS}}}"
    return F.regexp_extract_all(text, F.lit(f"(?=({word}(?:\\s+{word}){{0,{WORDS - 1}}})){word}"), F.lit(1))


def _occurrence(sorted_: Column, x: Column, i: Column) -> Column:
    """How many equal hashes stand before place ``i`` of the sorted array; by halving steps if any do."""

    def equal(back: Column) -> Column:
        return _hash_part(F.get(sorted_, i - back)) == _hash_part(x)

    steps = F.array(*[F.lit(1 << k) for k in range(PLACE_BITS - 1, -1, -1)])
    count = F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= i) & equal(n + step), n + step).otherwise(n))
    return F.when((i > 0) & equal(F.lit(1)), count).otherwise(F.lit(0))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """The sketches of a text as an array of numbers: sketch in the upper bits, hash of its tuple below."""
    placed = lambda h, i: _hash_part(h).bitwiseOR(i.cast("long"))
    by_kmer, by_sketch, in_order = (f"_{name}_{k}" for k in ("kmers", "sketches", "order"))
    df = df.withColumn(by_kmer, F.sort_array(F.transform(_kmers(F.col(text)), lambda k, i: placed(F.xxhash64(k), i))))
    s = F.col(by_kmer)
    numbered = F.transform(
        s,
        lambda x, i: placed(F.xxhash64(_hash_part(x), _occurrence(s, x, i)), x.bitwiseAND(_long(_PLACE))),
    )
    df = df.withColumn(by_sketch, F.sort_array(numbered)).drop(by_kmer)
    t = F.col(by_sketch)
    smallest = F.filter(t, lambda x, i: (i < PICKED) | (_sketch(F.get(t, i - PICKED)) != _sketch(x)))
    text_order = F.transform(
        smallest,
        lambda x: F.shiftleft(_sketch(x), 64 - SKETCH_BITS)
        .bitwiseOR(F.shiftleft(x.bitwiseAND(_long(_PLACE)), _CODE_BITS))
        .bitwiseOR(F.shiftrightunsigned(x, PLACE_BITS).bitwiseAND(_long((1 << _CODE_BITS) - 1))),
    )
    df = df.withColumn(in_order, F.sort_array(text_order)).drop(by_sketch)
    u = F.col(in_order)
    code = lambda x: x.bitwiseAND(_long((1 << _CODE_BITS) - 1))

    def tuple_hash(x: Column, i: Column) -> Column:
        rest = [F.when(_sketch(F.get(u, i + k)) == _sketch(x), code(F.get(u, i + k))) for k in range(1, PICKED)]
        low = F.xxhash64(code(x), *rest).bitwiseAND(_long((1 << 24) - 1))
        number = F.shiftrightunsigned(x, 64 - SKETCH_BITS)
        first = (i == 0) | (_sketch(F.get(u, i - 1)) != _sketch(x))
        return F.when(first, F.shiftleft(number, 24).bitwiseOR(low))

    found = F.filter(F.transform(u, tuple_hash), lambda x: x.isNotNull())
    return df.withColumn(name, found).drop(in_order)


def fingerprint_text(sketches: Column) -> Column:
    """Eight hex digits per sketch."""
    return F.array_join(F.transform(sketches, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of sketches that agree."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(most, F.lit(1)))


def _bucket_width(ids: DataFrame) -> tuple[int, int, int]:
    """Smallest id, width of a bucket of ids, and number of buckets for rows without one.

    Ids may be sparse: buckets get narrower until none holds more than ``MOST_ROWS`` different ids.
    """
    low, high, rows = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    buckets = max(1, math.ceil(rows / ROWS_PER_BUCKET))
    if low is None:
        return 0, 1, buckets
    width = max(1, -(-(high - low + 1) // buckets))
    while width > 1:
        bucket = F.floor((F.col("doc_id").cast("decimal(38,0)") - low) / width)
        most = ids.groupBy(bucket).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if most <= MOST_ROWS:
            break
        width = max(1, width // 16)
    return low, width, buckets


def with_next(docs: DataFrame, text: str, derive: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """``doc_id``, ``text`` and what ``derive`` adds, with the next document's as ``next_<column>``.

    ``derive`` works on rows; it runs once per document, and once more for each guest.

    Documents are dealt into buckets of neighbouring ids.  The largest of a bucket is also sent, as a
    guest, to the bucket above, and the largest of all to the lowest, so each bucket is a window of its
    own and texts are shuffled once.  The list of guests has one narrow row per bucket; it is written, so
    that Spark knows its size before it chooses how to join.
    """
    low, width, buckets = _bucket_width(docs.select("doc_id"))
    known = F.floor((F.col("doc_id").cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)")) / F.lit(width)).cast("long")
    order_hash = F.xxhash64(F.col(text))
    unnamed = -1 - F.pmod(order_hash, F.lit(buckets))
    rows = docs.select("doc_id", text, order_hash.alias("_tie"), F.coalesce(known, unnamed).alias("_bucket"))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_tie")
    last = docs.select("doc_id", order_hash.alias("_tie"), F.coalesce(known, unnamed).alias("_bucket"))
    last = last.groupBy("_bucket").agg(F.max(key).alias("last"))
    above = F.lead("_bucket").over(Window.orderBy("_bucket"))  # one narrow row per bucket
    lowest = F.min("_bucket").over(Window.partitionBy())
    guests = last.select(
        F.col("last.doc_id").alias("_guest"), F.col("last._tie").alias("_guest_tie"), F.coalesce(above, lowest).alias("_to")
    )
    guests = cut_lineage(guests, "neighbours")
    same = F.col("doc_id").eqNullSafe(F.col("_guest")) & (F.col("_tie") == F.col("_guest_tie"))
    sent = rows.join(guests, same).drop("_bucket", "_guest", "_guest_tie").withColumnRenamed("_to", "_bucket")
    both = derive(rows.withColumn("_sent", F.lit(0)).unionByName(sent.withColumn("_sent", F.lit(1))))
    order = Window.partitionBy("_bucket").orderBy(F.desc("_sent"), "doc_id", "_tie")
    met = both.select("*", *[F.lag(c).over(order).alias(f"next_{c}") for c in columns])
    return met.filter("_sent = 0").drop("_sent", "_bucket", "_tie")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the sketches of the text, of its edited text and of the next text.

    The edited text has its last third replaced by the first as many characters of the next text.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    met = with_next(plain, "text", lambda df: with_fingerprint(df, "text", "sketches"), ["text", "sketches"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    return with_fingerprint(met.withColumn("edited", edited).drop("next_text"), "edited", "edited_sketches")
