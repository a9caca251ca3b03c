"""Connected components of a graph given as edges, by alternating star contraction.

Every round writes its edges to the shared folder, so lineage stays short and a lost executor costs one
round; what the round before wrote is removed.  Nothing is collected but two counts per round.  A node with
very many neighbours is met by aggregates that combine on the map side (its smallest neighbour), never as
one list.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import delete_paths, scratch_dir, shuffles_dropped, stored


def _linked_to_smallest(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step on edges ``u > v``: link neighbours of a node to the smallest of them and itself."""
    if larger_only:  # each node's larger neighbours
        rows = edges.select(F.col("v").alias("node"), F.col("u").alias("other")).unionByName(
            edges.select(F.col("u").alias("node"), F.col("v").alias("other"))
        )
    else:  # each node's smaller neighbours
        rows = edges.select(F.col("u").alias("node"), F.col("v").alias("other"))
    least = rows.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    if larger_only:
        met = rows.filter("other > node").join(least, "node")
        out = met.select(F.col("other").alias("u"), F.col("least").alias("v"))
    else:
        met = rows.join(least, "node").select(F.col("other").alias("u"), F.col("least").alias("v"))
        out = met.unionByName(least.select(F.col("node").alias("u"), F.col("least").alias("v")))
    return out.filter("u > v").distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """Undirected edges ``a, b`` (longs) to ``node, root``: the smallest node that can be reached.

    Nodes without an edge to another node do not appear.  Edges with a null end are ignored.
    """
    a, b = F.col("a"), F.col("b")
    current = edges.filter("a <> b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    spark, home = edges.sparkSession, scratch_dir(edges.sparkSession, "components")
    current = stored(current, f"{home}/0")
    before = None
    for turn in count(1):
        after = stored(_linked_to_smallest(_linked_to_smallest(current, True), False), f"{home}/{turn}")
        delete_paths(spark, f"{home}/{turn - 1}")
        with shuffles_dropped(spark):
            state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        current, before = after, state
