"""Embedding near-duplicates: cosines of quantised tiles, with bounds that say which pairs need full precision.

Equal vectors of one label are one class and count once in all comparisons.  The classes of a label are dealt into
blocks of bounded size and every two blocks meet in one task, so a label may hold any share of the rows.  In the task
unit vectors are rounded to 8-bit integers times a scale of their own; the products of a tile of integers are exact.
With ``e`` the length of what rounding took from a vector, the true cosine lies within ``e + f + e f`` of the product
times both scales.  Pairs whose upper bound stays below the threshold are done, those whose lower bound reaches it are
linked, and only the others are worked out in double precision.

A task gives each class the number of rows it is linked to and the smallest class that it reaches inside the task: no
pairs leave it.  The components are those of these stars.

Defined results: vectors that are null, empty, all zero or hold a null or non-finite component, and rows without a
label, are linked with nothing; so are vectors of different widths; repeated rows are other vectors; a row with a null
id has its component's smallest id, or null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.components import component_roots
from pagemill.session import cut_lineage

THRESHOLD = 0.98
BLOCK, NUMBERS, FEWEST = 8_192, 1 << 22, 64  # vectors of a block at most; fewer of wide ones, by their numbers
TILE, PAIRS = 1_024, 65_536
SLACK = 1e-5  # above all rounding of the bounds, which are worked out in single precision


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; the largest component goes first, so no square overflows."""
    rows = vectors.astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit rows, their scales, and the length of what rounding took from each row."""
    scale = np.abs(unit).max(1) / 127
    small = np.rint(unit / scale[:, None])
    return small.astype(np.int8), scale, np.sqrt(((unit - small * scale[:, None]) ** 2).sum(1))


def tile_links(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Which rows of ``a`` and ``b``, each ``(unit, int8 rows, scales, errors)``, have a cosine of ``threshold`` or more."""
    kind = np.float32 if a[1].shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of integers stay exact
    near = (a[1].astype(kind) @ b[1].astype(kind).T) * a[2].astype(kind)[:, None] * b[2].astype(kind)
    width = ((1 + a[3])[:, None] * (1 + b[3]) - 1 + SLACK).astype(kind)
    linked = near - width >= threshold
    rows, columns = np.nonzero((near + width >= threshold) & ~linked)
    for start in range(0, len(rows), PAIRS):
        i, j = rows[start : start + PAIRS], columns[start : start + PAIRS]
        linked[i, j] = np.einsum("ij,ij->i", a[0][i], b[0][j]) >= threshold
    return linked


class _Sets:
    """Which rows reach each other; a set goes by its smallest row."""

    def __init__(self, n: int):
        self.least = np.arange(n)

    def add(self, linked: np.ndarray, at: int, other: int) -> None:
        """Join the sets that a tile links, whose first rows are ``at`` and ``other``."""
        height, width = linked.shape
        while True:
            a, b = self.least[at : at + height], self.least[other : other + width]
            apart = linked & (a[:, None] != b)
            rows = np.nonzero(apart.any(1))[0]
            if not len(rows):
                return
            parent: dict[int, int] = {}

            def find(x: int, parent: dict[int, int] = parent) -> int:
                while x in parent:
                    x = parent[x]
                return x

            for x, y in zip(a[rows].tolist(), b[apart[rows].argmax(1)].tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            moved = np.arange(len(self.least))
            moved[list(parent)] = [find(x) for x in parent]
            self.least = moved[self.least]


def link_blocks(vectors: np.ndarray, copies: np.ndarray, first: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows linked to each vector, counted by ``copies``, and the smallest row of those it reaches.

    The first ``first`` vectors are one block, the others a second one and only met with it; where there are no others,
    the vectors of the one block meet each other.
    """
    n = len(vectors)
    unit = unit_rows(vectors)
    parts = (unit, *quantise(unit))
    links, sets = np.zeros(n, np.int64), _Sets(n)
    for i in range(0, first, TILE):
        rows = slice(i, min(i + TILE, first))
        for j in range(i if first == n else first, n, TILE):
            columns = slice(j, min(j + TILE, n))
            linked = tile_links([p[rows] for p in parts], [p[columns] for p in parts], threshold)
            if i == j:
                np.fill_diagonal(linked, False)
            if linked.any():
                links[rows] += linked @ copies[columns]
                if i != j:
                    links[columns] += copies[rows] @ linked
                sets.add(linked, i, j)
    return links, sets.least


def class_links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct ``node, label, width, embedding, copies`` to ``node, links, least`` of each pair of blocks.

    ``least`` is the smallest node that the node reaches among the two blocks; nodes without a link do not appear.
    """
    per_block = F.least(F.lit(BLOCK), F.greatest(F.lit(FEWEST), F.floor(F.lit(NUMBERS) / F.col("width"))))
    sizes = classes.groupBy("label", "width").agg(F.ceil(F.count("*") / F.first(per_block)).cast("int").alias("blocks"))
    dealt = classes.join(sizes, ["label", "width"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        "label",
        "width",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).alias("second"),
        "node",
        "copies",
        "embedding",
    )

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by([("second", "ascending"), ("node", "ascending")])
        nodes = group["node"].to_numpy()
        values = group["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        second = int(group["second"].to_numpy().sum())
        vectors, copies = values.reshape(len(nodes), -1), group["copies"].to_numpy().astype(np.int64)
        split = group["i"][0].as_py() != group["j"][0].as_py()
        first = len(nodes) - second
        if split and not (first and second):  # a block without vectors
            links, least = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        else:
            links, least = link_blocks(vectors, copies, first, threshold)
        found = np.nonzero(links)[0]
        return pa.table({"node": nodes[found], "links": links[found], "least": nodes[least[found]]})

    return met.groupBy("label", "width", "i", "j").applyInArrow(work, "node long, links long, least long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, embedding, label`` to ``vec_id, n_links, component_id, kept``, row for row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    valid = F.col("label").isNotNull() & usable(F.col("embedding"))
    grouped = rows.filter(valid).groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    numbered = grouped.withColumns({"node": F.monotonically_increasing_id(), "width": F.size("embedding")})
    classes = cut_lineage(numbered, "vector-classes")
    met = cut_lineage(class_links(classes, threshold), "vector-tiles")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    edges = met.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    roots = component_roots(edges)
    known = classes.join(links, "node", "left").join(roots, "node", "left")
    known = known.withColumns({"root": F.coalesce("root", "node"), "n_links": F.coalesce("links", F.lit(0)) + F.col("copies") - 1})
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(least, "root").select("label", "embedding", "n_links", "component_id")
    linked = rows.filter(valid).join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", kept)
