"""Keep-first de-duplication that survives a key holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import salt_buckets

SKETCH_BITS = 1 << 20  # of each of the two sketches of `mark_first`, an eighth of a megabyte


def with_first(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    carry: list[str] | None = None,
    where: Column | None = None,
    salts: int | None = None,
) -> DataFrame:
    """Add ``_first`` (the smallest ``order``+``carry`` of the row's key) and ``_n`` (key count).

    ``order`` must identify a row, so that ``is_first`` can tell the winner.  Rows outside
    ``where`` take no part and get nulls.  Each key is spread over salt buckets: partial minima
    per (key, salt) are combined on the map side, then at most ``salts`` of them meet per key, and
    rows are joined back on (key, salt).  No task ever sees all rows of a hot key.
    """
    buckets = salts or salt_buckets(df.sparkSession)
    fields = order + [c for c in carry or [] if c not in order]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    if where is not None:
        salted = salted.withColumn("_salt", F.when(where, F.col("_salt")))
    partial = (
        salted.filter(F.col("_salt").isNotNull())
        .groupBy(*keys, "_salt")
        .agg(F.min(F.struct(*fields)).alias("_first"), F.count("*").alias("_n"))
    )
    per_key = Window.partitionBy(*keys)
    winners = partial.withColumns(
        {"_first": F.min("_first").over(per_key), "_n": F.sum("_n").over(per_key)}
    )
    # a null key is a key like any other
    named = {k: f"_key_{i}" for i, k in enumerate([*keys, "_salt"])}
    same = F.lit(True)
    for k, other in named.items():
        same = same & F.col(k).eqNullSafe(F.col(other))
    taken = salted.filter(F.col("_salt").isNotNull()).join(winners.withColumnsRenamed(named), same, "left")
    out = taken.select(*df.columns, "_first", "_n")
    if where is None:
        return out
    none = {c: F.lit(None).cast(out.schema[c].dataType) for c in ("_first", "_n")}
    return out.unionByName(salted.filter(F.col("_salt").isNull()).withColumns(none).drop("_salt"))


def is_first(order: list[str]) -> Column:
    """True on the row that holds its key's first place."""
    out = F.lit(True)
    for c in order:
        out = out & F.col(c).eqNullSafe(F.col(f"_first.{c}"))
    return out


def repeats(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    carry: list[str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """(order, _first) of the rows that are not their key's first.

    Only these narrow columns are shuffled.  Wide rows then take the result by ``order``, which is
    unique and so never skewed, and which Spark broadcasts when there are few repeats.
    """
    narrow = df if where is None else df.filter(where)
    narrow = narrow.select(*dict.fromkeys([*keys, *order, *(carry or [])]))
    marked = with_first(narrow, keys, order, carry)
    return marked.filter(~is_first(order)).select(*order, "_first")


def keep_first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of every key in ``order``; whole rows travel once, combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    fields = order + [c for c in rest if c not in order]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def _bit(slots: Column, words: Column) -> Column:
    """Whether a sketch, an array of longs, has the bit of a slot."""
    return F.getbit(F.get(words, F.shiftright(slots, 6).cast("int")), F.pmod(slots, F.lit(64)).cast("int")) == 1


def mark_first(
    df: DataFrame, keys: list[str], order: list[str], where: Column | None = None, bits: int = SKETCH_BITS
) -> DataFrame:
    """Add ``_is_first``: whether the row is the first of its key in ``order``; null outside ``where``.

    ``order`` must identify a row.  A first pass over keys and order alone finds the keys that come more than once and
    all first rows, combined on the map side.  Two sketches of fixed size travel with the plan: one of those keys,
    one of all first rows.  A row whose key is not in the one is first, a row that is not in the other is a repeat;
    only rows in both, the first rows of repeated keys and a few taken for such, are shuffled and looked up, by their
    ``order``, which no two rows share.  Full sketches send more rows to the look-up and change no result.
    """
    slot = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(bits))
    narrow = (df if where is None else df.filter(where)).select(*dict.fromkeys([*keys, *order]))
    firsts = narrow.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_n"))
    place = slot([F.col("_first")[c] for c in order]) + F.lit(bits)
    taken = F.explode(F.when(F.col("_n") > 1, F.array(slot(keys), place)).otherwise(F.array(place)))
    held = firsts.select(taken.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    held = held.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("slot", F.lit(64)).cast("int"))).alias("bits"))
    every = df.sparkSession.range(2 * bits // 64).withColumnRenamed("id", "word").join(held, "word", "left")
    words = every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("s"))
    words = words.select(F.col("s")["bits"]).scalar()
    repeated, leading = _bit(slot(keys), words), _bit(slot(order) + F.lit(bits), words)
    sure = F.when(~repeated, True).when(~leading, False)
    marked = df.withColumn("_is_first", sure if where is None else F.when(F.coalesce(where, F.lit(False)), sure))
    doubtful = F.coalesce(F.lit(True) if where is None else where, F.lit(False)) & repeated & leading
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_f.{c}"))
    asked = firsts.filter(repeated).select(F.col("_first").alias("_f"))
    looked_up = df.filter(doubtful).join(asked, same, "left")
    looked_up = looked_up.select(*df.columns, F.col("_f").isNotNull().alias("_is_first"))
    return marked.filter(~doubtful).unionByName(looked_up)
