"""Cells of vectors: which of them can hold one of the nearest, by the triangle inequality.

Vectors are compared within a space, a collection and a width.  A space is cut into cells around some of its own
vectors; a cell knows its centre, its radius and how many vectors it holds.  A question at distance ``d`` from a centre
is at least ``d - radius`` and at most ``d + radius`` from every vector of the cell.  The nearest cells that together
hold ``k`` vectors bound the ``k``-th distance, and only cells that can undercut it are visited: exact, however the
centres were chosen.

Spaces, cells and questions are dealt into slices of bounded size, so a collection, a cell (many equal vectors) or a
question set may hold any share of the rows.  All of this is one lazy plan; nothing is collected or broadcast by hand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS, MOST_CELLS = 1_024, 4_096  # vectors of a cell on average, cells of a space at most
SLICE_ROWS, QUESTIONS, TILE_ROWS = 8_192, 8_192, 1_024  # vectors and questions that meet in one task, questions at a time
MARGIN = 1e-4  # above what rounding squared distances to nine decimals can hide
SPACE = ["collection", "width"]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(rows, -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)


def _sliced(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """``rows`` dealt by hash into slices of about ``size`` rows of a space; ``name`` numbers them, ``<name>s`` counts."""
    counted = rows.groupBy(*SPACE).agg(F.ceil(F.count("*") / size).cast("int").alias(f"{name}s"))
    return rows.join(counted, SPACE).withColumn(name, F.pmod(F.xxhash64(key), f"{name}s").cast("int"))


def _fresh(rows: DataFrame) -> DataFrame:
    """The same rows under columns of their own, to be met with what they were worked out from."""
    return rows.select(*(F.col(c).alias(c) for c in rows.columns))


def _each(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), count - 1))


def centres(vectors: DataFrame, cell_rows: int = CELL_ROWS, most: int = MOST_CELLS) -> DataFrame:
    """``collection, width, id, embedding`` to ``collection, width, cell, centre``.

    A space gets one cell for ``cell_rows`` vectors, ``most`` at most; the centres are its vectors with the smallest
    hashes of their ids, a sample of bounded size that repeats.
    """
    wanted = vectors.groupBy(*SPACE).agg(F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.count("*") / cell_rows))).alias("cells"))
    place = F.row_number().over(Window.partitionBy(*SPACE).orderBy(F.xxhash64("id"), "id"))
    first = vectors.select(*SPACE, F.col("embedding").alias("centre"), place.alias("place")).filter(F.col("place") <= most)
    chosen = first.join(wanted, SPACE).filter("place <= cells")
    return chosen.select(*SPACE, (F.col("place") - 1).cast("int").alias("cell"), "centre")


def _nearest_centre(vectors: pa.Table, cells: pa.Table) -> pa.Table:
    if not len(vectors):
        return vectors.select([*SPACE, "id", "embedding"]).append_column("cell", pa.array([], pa.int32())).append_column("gap", pa.array([], pa.float64()))
    own, centre = _matrix(vectors["embedding"], len(vectors)), _matrix(cells["centre"], len(cells))
    cell, gap = np.zeros(len(own), np.int64), np.zeros(len(own))
    for start in range(0, len(own), TILE_ROWS):
        part = slice(start, start + TILE_ROWS)
        cell[part] = _squares(own[part], centre).argmin(1)
        gap[part] = np.sqrt(((own[part] - centre[cell[part]]) ** 2).sum(1))
    placed = vectors.select([*SPACE, "id", "embedding"])
    return placed.append_column("cell", pa.array(cells["cell"].to_numpy()[cell], pa.int32())).append_column("gap", pa.array(gap))


def place_vectors(vectors: DataFrame, cells: DataFrame) -> DataFrame:
    """Each vector with its nearest ``cell`` and the ``gap`` between it and the centre."""
    dealt = _sliced(vectors, "id", SLICE_ROWS, "slice")
    slices = dealt.groupBy(*SPACE).agg(F.max("slices").alias("slices"))
    spread = cells.join(slices, SPACE).withColumn("slice", _each(F.col("slices"))).drop("slices")
    kind = vectors.schema["embedding"].dataType.simpleString()
    schema = f"collection string, width int, id string, embedding {kind}, cell int, gap double"
    key = [*SPACE, "slice"]
    return dealt.groupBy(*key).cogroup(_fresh(spread).groupBy(*key)).applyInArrow(_nearest_centre, schema)


def summaries(placed: DataFrame) -> DataFrame:
    """``collection, width, cell, radius, n`` of cells with vectors."""
    return placed.groupBy(*SPACE, "cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n"))


def route(asked: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """``key`` and ``embedding`` of questions to one row for each cell that can hold one of its ``k`` nearest.

    ``reach`` bounds the distance of the ``k``-th nearest, ``n`` is how many vectors the cell holds.
    """
    dealt = _sliced(asked, "key", QUESTIONS, "portion")
    portions = dealt.groupBy(*SPACE).agg(F.max("portions").alias("portions"))
    spread = cells.join(portions, SPACE).withColumn("portion", _each(F.col("portions"))).drop("portions")
    kind = asked.schema["embedding"].dataType.simpleString()
    schema = f"collection string, width int, portion int, key string, embedding {kind}, cell int, n long, reach double"

    def visits(questions: pa.Table, known: pa.Table) -> pa.Table:
        columns = [*SPACE, "portion", "key", "embedding"]
        if not len(questions) or not len(known):
            rows, cell, reach = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            radius, held = known["radius"].to_numpy(), known["n"].to_numpy()
            centre, own = _matrix(known["centre"], len(known)), _matrix(questions["embedding"], len(questions))
            met, limits = [], []
            for start in range(0, len(own), TILE_ROWS):
                d = np.sqrt(np.maximum(_squares(own[start : start + TILE_ROWS], centre), 0.0))
                order = np.argsort(d + radius, axis=1)
                enough = held[order].cumsum(1) >= k
                last = np.where(enough.any(1), enough.argmax(1), len(radius) - 1)
                at = order[np.arange(len(d)), last]
                bound = np.where(enough.any(1), (d + radius)[np.arange(len(d)), at], np.inf)
                q, c = np.nonzero(d - radius <= (bound * (1 + 1e-6) + MARGIN)[:, None])
                met.append((q + start, c))
                limits.append(bound[q])
            rows, cell = (np.concatenate(x) for x in zip(*met, strict=True))
            reach = np.concatenate(limits)
        out = questions.select(columns).take(pa.array(rows))
        for name, values in (("cell", known["cell"]), ("n", known["n"])):
            out = out.append_column(name, values.take(pa.array(cell)))
        return out.append_column("reach", pa.array(reach))

    key = [*SPACE, "portion"]
    return dealt.groupBy(*key).cogroup(_fresh(spread).groupBy(*key)).applyInArrow(visits, schema)


class _Best:
    """The ``k`` nearest vectors of each question of a tile."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int) -> None:
        self.vectors, self.ids, self.k = vectors, ids, k

    def of(self, questions: np.ndarray, reach: np.ndarray) -> pd.DataFrame:
        # equal vectors must tie whatever their place in a group, hence the rounding
        d = np.round(_squares(questions, self.vectors), 9)
        limit = (reach * (1 + 1e-6) + MARGIN) ** 2
        if len(self.ids) > self.k:
            limit = np.minimum(limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        q, v = np.nonzero(d <= limit[:, None])
        frame = pd.DataFrame({"q": q, "id": self.ids[v], "distance": d[q, v]})
        frame = frame.sort_values(["q", "distance", "id"], kind="stable")
        return frame[frame.groupby("q").cumcount() < self.k]


def search(placed: DataFrame, held: DataFrame, routed: DataFrame, portions: DataFrame, k: int) -> DataFrame:
    """Vectors in cells and routed questions to ``question, id, distance`` (squared), at most ``k`` of each meeting.

    A cell is dealt into slices, the questions of a space come in ``portions``, and each slice meets each portion.
    """
    slices = F.ceil(F.col("n") / SLICE_ROWS).cast("int")
    dealt = placed.join(held, [*SPACE, "cell"]).withColumn("slice", F.pmod(F.xxhash64("id"), slices).cast("int"))
    spread = dealt.join(portions, SPACE).withColumn("portion", _each(F.col("portions")))
    asked = routed.withColumn("slice", _each(slices))
    key = [*SPACE, "cell", "slice", "portion"]
    spread = spread.select(*key, "id", "embedding")
    asked = asked.select(*key, "key", "embedding", "reach")

    def meet(vectors: pa.Table, questions: pa.Table) -> pa.Table:
        frames = [pd.DataFrame({"question": [], "id": [], "distance": []})]
        if len(vectors) and len(questions):
            ids = np.array(vectors["id"].to_pylist(), dtype=object)
            best = _Best(_matrix(vectors["embedding"], len(ids)), ids, k)
            names = np.array(questions["key"].to_pylist(), dtype=object)
            own, reach = _matrix(questions["embedding"], len(names)), questions["reach"].to_numpy()
            for start in range(0, len(names), TILE_ROWS):
                part = slice(start, start + TILE_ROWS)
                found = best.of(own[part], reach[part])
                frames.append(found.assign(question=names[part][found["q"].to_numpy(dtype=int)])[["question", "id", "distance"]])
        hits = pd.concat(frames[1:] or frames)
        columns = [pa.array(hits["question"], pa.string()), pa.array(hits["id"], pa.string()), pa.array(hits["distance"], pa.float64())]
        return pa.Table.from_arrays(columns, ["question", "id", "distance"])

    return spread.groupBy(*key).cogroup(_fresh(asked).groupBy(*key)).applyInArrow(meet, "question string, id string, distance double")


def nearest(asked: DataFrame, stored: DataFrame, k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``collection, key, embedding`` and ``collection, id, embedding`` to candidates that hold the ``k`` nearest.

    ``question, id, distance``: at most ``k`` for each slice of a cell that a question visits.
    """
    asked, stored = (df.withColumn("width", F.size("embedding")) for df in (asked, stored))
    cells = centres(stored, cell_rows)
    placed = place_vectors(stored, cells)
    held = summaries(placed)
    routed = route(asked, held.join(cells, [*SPACE, "cell"]), k)
    portions = asked.groupBy(*SPACE).agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("portions"))
    return search(placed, held, routed, portions, k)
