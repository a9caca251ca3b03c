"""Recursive splitting of long texts: the one part of chunking that needs Python."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagemill import fixed_values as fv
from pagemill.functions.slices import small_batches


def _cut(text: str, separator: str) -> list[str]:
    """Parts of ``text``; every part but the first starts with the separator."""
    if not separator:
        return list(text)
    head, *tail = text.split(separator)
    return [p for p in (head, *(separator + t for t in tail)) if p]


def _pack(parts: list[str], limit: int, overlap: int) -> Iterator[str]:
    """Join neighbours up to ``limit`` characters, carrying up to ``overlap`` into the next."""
    window: deque[str] = deque()
    size = 0
    for part in parts:
        if window and size + len(part) > limit:
            yield "".join(window)
            while size > overlap or (size > 0 and size + len(part) > limit):
                size -= len(window.popleft())
        window.append(part)
        size += len(part)
    if window:
        yield "".join(window)


def split_text(text: str, limit: int, overlap: int, separators: list[str] | None = None) -> list[str]:
    """Split at the coarsest separator present; parts still too long go one level finer."""
    names = fv.SPLIT_SEPARATORS if separators is None else separators
    level = next(i for i, s in enumerate(names) if not s or s in text)
    finer = names[level + 1 :]
    out: list[str] = []
    small: list[str] = []
    for part in _cut(text, names[level]):
        if len(part) < limit:
            small.append(part)
            continue
        out.extend(_pack(small, limit, overlap))
        small = []
        out.extend(split_text(part, limit, overlap, finer) if finer else [part])
    out.extend(_pack(small, limit, overlap))
    return [t for chunk in out if (t := chunk.strip())]


def _token_windows(piece: str, size: int, overlap: int, tokenizer) -> list[str]:
    ids = tokenizer.encode(piece)
    if len(ids) <= size:
        return [piece]
    step = max(size - overlap, 1)
    cut = (tokenizer.decode(ids[i : i + size]).strip() for i in range(0, len(ids), step))
    return [c for c in cut if c]


def split_by_tokens(
    df: DataFrame, text: str, size: int, overlap: int, load_tokenizer: Callable[[], object], into: str = "pieces"
) -> DataFrame:
    """Add ``into``: the text itself if it has at most ``size`` tokens, else its sliding windows of so many, decoded.

    The tokenizer, with ``encode`` and ``decode``, is loaded once per task.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer()
        for batch in small_batches(batches, [text]):
            rows = [_token_windows(t or "", size, overlap, tokenizer) for t in batch.column(text).to_pylist()]
            columns = [*batch.columns, pa.array(rows, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, into])

    return df.mapInArrow(run, schema)


def split_texts(
    df: DataFrame,
    texts: str,
    size: str,
    overlap: str,
    into: str = "pieces",
    load_tokenizer: Callable[[], object] | None = None,
) -> DataFrame:
    """Add ``into``: for every text of the array ``texts`` the array of its pieces.

    Sizes are in tokens at four characters each.  A tokenizer with ``encode`` and ``decode``, loaded
    once per task, re-splits pieces over the token budget by sliding token windows; the
    length-based estimate never exceeds the budget.
    """
    nested = T.ArrayType(T.ArrayType(T.StringType()))
    schema = T.StructType([*df.schema.fields, T.StructField(into, nested)])
    arrow = to_arrow_type(nested)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer() if load_tokenizer else None
        width = fv.CHARS_PER_TOKEN
        for batch in small_batches(batches, [texts]):
            rows = []
            columns = [batch.column(c).to_pylist() for c in (texts, size, overlap)]
            for items, n, m in zip(*columns):
                pieces = [split_text(t or "", n * width, m * width) for t in items or []]
                if tokenizer is not None:
                    pieces = [
                        [w for p in ps for w in _token_windows(p, n, m, tokenizer)] for ps in pieces
                    ]
                rows.append(pieces)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, arrow)], names=[*batch.schema.names, into]
            )

    return df.mapInArrow(run, schema)
