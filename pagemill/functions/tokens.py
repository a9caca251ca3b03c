"""Token counts and token windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import fixed_values as fv
from pagemill.functions.slices import ROWS
from pagemill.functions.text import estimate_tokens


def char_tokens(c: Column, width: int = fv.CHARS_PER_TOKEN) -> Column:
    """Fixed-width pieces: the tokens that the length-based estimate counts."""
    return F.regexp_extract_all(c, F.lit(rf"(?s)(.{{1,{width}}})"), F.lit(1))


def explode_windows(df: DataFrame, tokens: Column, size: int, overlap: int) -> DataFrame:
    """One row per sliding window: ``start`` (0-based), ``tokens`` and ``piece``."""
    step = max(size - overlap, 1)
    held = df.withColumn("_tokens", tokens)
    starts = F.when(
        F.size("_tokens") > 0, F.sequence(F.lit(0), F.size("_tokens") - 1, F.lit(step))
    ).otherwise(F.array().cast("array<int>"))
    windows = F.transform(
        starts,
        lambda s: F.struct(
            s.alias("start"),
            F.least(F.lit(size), F.size("_tokens") - s).alias("tokens"),
            F.array_join(F.slice("_tokens", s + 1, size), "").alias("piece"),
        ),
    )
    return held.select(*df.columns, F.inline(windows))


def bpe_counter(load: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Callable[[Column], Column]:
    """Token counter from a loader of a batch encoder, e.g. of a byte-pair file on the workers.

    The loader runs once per Python worker; texts arrive in Arrow batches and are encoded a few hundred at a time.
    """
    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for batch in batches:
            parts = (batch.iloc[at : at + ROWS].fillna("").tolist() for at in range(0, len(batch), ROWS))
            yield pd.Series([len(ids) for part in parts for ids in encode(part)], dtype="int32")

    return count


def token_count(c: Column, counter: Callable[[Column], Column] | None = None) -> Column:
    return (counter or estimate_tokens)(c)
