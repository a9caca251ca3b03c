"""Arrow batches in slices, so that a worker holds the Python objects and results of a few rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS, BYTES = 256, 1 << 20


def small_batches(
    batches: Iterator[pa.RecordBatch], columns: list[str], rows: int = ROWS, size: int = BYTES
) -> Iterator[pa.RecordBatch]:
    """Every row once, in order: slices of at most ``rows`` rows and, by their mean, ``size`` bytes of ``columns``.

    A slice shares the memory of its batch.  A batch without rows passes as it is.
    """
    for batch in batches:
        held = sum(batch.column(c).nbytes for c in columns)
        step = max(1, min(rows, len(batch) * size // max(1, held)))
        for at in range(0, max(1, len(batch)), step):
            yield batch.slice(at, step)
