"""Near-duplicate texts of the pipeline: five-word shingles that are alike by 0.8 or more, joined into components.

Texts with one set of shingles are one class and count once in all of this.

0. Each class has a SimHash fingerprint over its shingles.  Fingerprints that differ in at most two bits are found by
   op2's grid of segment counts; every pair found is checked on whole sets, and what is alike is linked before all else.
   Texts alike by 0.8 differ in some 8 bits, so the steps below look for what this one cannot reach.
1. Classes that may have a partner meet in cells, the equal ones of ``BANDS`` bands of ``ROWS`` minima of hash
   functions.  A pair alike by 0.8 shares a cell with probability 0.9993, and nothing below lowers that.
2. Stars: each class is checked against the pivot that most of its cells name; later rounds draw other pivots and check
   one member of every component that still shares a cell with another.  A group of near copies of any size becomes one
   component at the cost of one check a class.
3. Classes that still share a cell with another component meet exactly.  Their shingles are counted, and each class
   gives its rarest ones, so many that two sets alike by 0.8 have one of them in common: ``size - ceil(0.8 size) + 1``.
   The place of the first common one bounds what two sets can share, so texts of one template, whose rare shingles are
   their own, drop out before pairs are made.  What is left is compared by one byte of each minimum, which a pair alike
   by 0.8 fails with a probability below 10^-7, and then on the whole sets.

Only pairs of different components are looked at, and every link is checked on whole sets.  A pivot's partners pass
through a task one by one.  Classes whose rare shingles many others share (near copies that are alike by 0.7 to 0.9, all of
one family) are dealt into blocks; two blocks add up what their classes have in common, and only links leave the task.

Defined results: words are split at ASCII white space, A-Z lower-cased; a text of fewer words is one shingle; null
and wordless texts are alike; repeated rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.batches import map_columns, raw_texts
from pagemill.llm.components import component_roots
from pagemill.session import cut_lineage

WORDS, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 24, 6
STARS = 2  # rounds of pivots
EQUAL_BYTES = 86  # of 144; 115 are expected of a pair alike by 0.8, with a deviation of 4.8
PARTNERS, MEMBERS, BLOCKED = 256, 32, 400_000  # of a pivot in one task; of a shingle met by a join; shingles of a block beyond
BLOCK = 2_048  # shingles that meet all hash functions at a time
_random = np.random.Generator(np.random.PCG64(SEED))
_FLIP = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the shingles, sorted."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    n = max(1, len(found) - words + 1)
    parts = (found[k : n + k] for k in range(min(words, len(found))))
    hashes = (xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*parts, strict=True)))
    return np.unique(np.fromiter(hashes, np.uint64, n))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), BLOCK):
        least = np.minimum(least, ((hashes[start : start + BLOCK, None] ^ _FLIP) * _TIMES).min(0))
    return least


def cells_of(least: np.ndarray) -> np.ndarray:
    """The cells of a set of shingles, one for each band of its minima."""
    bands, cells = least.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        mixed = cells * _MIX
        cells = (mixed ^ (mixed >> np.uint64(31))) + bands[:, k]
    return cells.view(np.int64)


def _key() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")]


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, text`` to ``doc_id, text_hash, node, size, fp, cells, low``, row for row.

    ``node`` names the set of shingles, ``fp`` is its SimHash, ``low`` has one byte of each minimum; a wordless text has
    neither cells nor bytes.
    """
    from pagemill.llm.simhash import fingerprint_of

    @F.arrow_udf("node long, size int, fp long, cells array<long>, low binary")
    def sketch(column: pa.Array) -> pa.Array:
        sets = [shingles(t, words) for t in raw_texts(column)]
        nodes = [xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets]
        least = [minima(s) if len(s) else None for s in sets]
        columns = [
            pa.array(np.array(nodes, np.uint64).view(np.int64), pa.int64()),
            pa.array([len(s) for s in sets], pa.int32()),
            pa.array([fingerprint_of(s) for s in sets], pa.int64()),
            pa.array([[] if m is None else cells_of(m) for m in least], pa.list_(pa.int64())),
            pa.array([b"" if m is None else (m >> np.uint64(20)).astype(np.uint8).tobytes() for m in least], pa.binary()),
        ]
        return pa.StructArray.from_arrays(columns, ["node", "size", "fp", "cells", "low"])

    return docs.select(*_key(), sketch("text").alias("s")).select("doc_id", "text_hash", "s.*")


def _as(df: DataFrame, end: str, *columns: str) -> DataFrame:
    """``node`` and other columns under the name of an end of a pair: ``node`` as ``a``, ``size`` as ``a_size``."""
    return df.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns))


def _sizes_fit(similarity: float) -> Column:
    n, m = F.col("a_size"), F.col("b_size")
    return F.least(n, m) >= F.greatest(n, m) * similarity - 1e-9


def crowded_cells(known: DataFrame) -> DataFrame:
    """Distinct ``node, size, cells`` to ``cell, node, size`` of cells that several classes share."""
    placed = known.select(F.explode("cells").alias("cell"), "node", "size")
    crowd = placed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    return placed.join(crowd.select("cell"), "cell")


def contested(met: DataFrame, components: DataFrame) -> DataFrame:
    """``cell, node, size`` with the node's ``component``, in cells that hold more than one."""
    known = met.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = known.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return known.join(several.filter("low <> high").select("cell"), "cell")


def stars(held: DataFrame, seed: int, similarity: float) -> DataFrame:
    """Cells with components to pairs ``a, b``: one member of each component beside the pivot most of its cells name."""
    member = F.struct(F.xxhash64("node", F.lit(seed)).alias("draw"), "node", "size", "component")
    drawn = held.groupBy("cell", "component").agg(F.min(member).alias("m"))
    pivots = drawn.groupBy("cell").agg(F.min("m").alias("p"))
    met = drawn.join(pivots, "cell").filter("m.component <> p.component")
    met = met.select(F.col("p.node").alias("a"), F.col("p.size").alias("a_size"), F.col("m.node").alias("b"), F.col("m.size").alias("b_size"), "component")
    votes = met.filter(_sizes_fit(similarity)).groupBy("component", "a", "b").agg(F.count("*").alias("votes"))
    return votes.groupBy("component").agg(F.max(F.struct("votes", "a", "b")).alias("v")).select("v.a", "v.b")


def alike(pairs: DataFrame, texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The distinct pairs ``a, b`` whose texts (``node, text``) have sets alike by ``similarity`` or more."""
    counted = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    salts = F.sequence(F.lit(0), F.col("salts") - 1)
    heads = counted.join(texts.withColumnRenamed("node", "a"), "a")
    heads = heads.select("a", F.explode(salts).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    rest = pairs.join(counted, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts").cast("int"))
    rest = rest.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
    rows = heads.unionByName(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")

    def work(columns: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        own, last = np.zeros(0, np.uint64), None
        for c in columns:
            found = []
            for a, b, text in zip(c["a"].to_pylist(), c["b"].to_pylist(), raw_texts(c["text"]), strict=True):
                if b is None:
                    own = shingles(text, words) if last != (a, None) else own
                elif last != (a, b):
                    other = shingles(text, words)
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    if common + 1e-9 >= (len(own) + len(other) - common) * similarity:
                        found.append((a, b))
                last = (a, b)
            yield {"a": [a for a, _ in found], "b": [b for _, b in found]}

    return map_columns(rows.select("a", "b", "text"), "a long, b long", work)


def equal_bytes(a: str, b: str) -> Column:
    """In how many places two columns of bytes agree."""

    @F.arrow_udf("int")
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), BANDS * ROWS) for x in (a, b))
        return pa.array((a == b).sum(1), pa.int32())

    return count(a, b)


def _can_meet(similarity: float) -> Column:
    """Whether a class ``a`` and one not larger, ``b``, can be alike, by what is left of both from a common shingle on."""
    fits = (F.col("b_size") <= F.col("a_size")) & (F.col("b_size") >= F.col("a_size") * similarity - 1e-9)
    return fits & (F.col("b_size") <= F.col("a_most")) & (F.col("a_size") <= F.col("b_most")) & (F.col("a_component") != F.col("b_component"))


def _linked_rows(sets: list[np.ndarray], component: np.ndarray, second: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Rows that join different components: as many pairs as it takes, of sets alike by ``similarity`` or more.

    Rows of two blocks, or of one where ``second`` is nowhere set.  A row walks through its shingles in the index of the
    other rows and adds up what it shares with each; rows of the largest component are met by the others only.
    """
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    owner, starts = np.repeat(np.arange(len(sets)), sizes), np.append(0, np.cumsum(sizes))
    split = bool(second.any())
    index = []
    for side in (False, True) if split else (False,):
        there = second[owner] != side if split else np.ones(len(owner), bool)  # what this side meets
        order = np.argsort(codes[there], kind="stable")
        index.append((codes[there][order], owner[there][order]))
    names, label, counts = np.unique(component, return_inverse=True, return_counts=True)
    left, right = [], []
    for row in np.nonzero(label != counts.argmax())[0]:
        known, owners = index[int(second[row])]
        own = codes[starts[row] : starts[row + 1]]
        low = np.searchsorted(known, own, "left")
        times = np.searchsorted(known, own, "right") - low
        at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        common = np.bincount(owners[at], minlength=len(sets))
        alike = (common + 1e-9 >= (sizes + sizes[row] - common) * similarity) & (label != label[row])
        for other in np.nonzero(alike)[0]:
            if label[other] != label[row]:  # one pair joins the two components
                left.append(row)
                right.append(other)
                label[label == label[other]] = label[row]
    return left, right


def family_links(crowd: DataFrame, rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Members ``shingle, node, size, component`` of shingles that many share to links ``a, b`` between components.

    Classes that such shingles connect are a family.  A family is dealt into blocks of some ``BLOCKED`` shingles, and
    every two blocks meet once in a task, with their whole sets (``rows`` has ``node, shingle``); only links leave it.
    """
    edges = crowd.select(F.col("node").alias("a"), F.xxhash64("shingle", F.lit("shingle")).alias("b"))
    members = crowd.groupBy("node").agg(F.first("size").alias("size"), F.first("component").alias("component"))
    families = members.join(component_roots(edges), "node", "left").withColumn("family", F.coalesce("root", "node")).drop("root")
    placed = cut_lineage(families, "near-families")
    blocks = placed.groupBy("family").agg(F.ceil(F.sum("size") / BLOCKED).cast("int").alias("blocks"))
    sets = rows.join(placed.select("node"), "node").groupBy("node").agg(F.collect_set("shingle").alias("set"))
    dealt = placed.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).join(sets, "node")
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second")]

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        node, component, second = (group[c].to_numpy() for c in ("node", "component", "second"))
        left, right = [], []
        if group["i"][0].as_py() == group["j"][0].as_py() or 0 < second.sum() < len(second):
            found = [np.array(x, np.int64) for x in group["set"].to_pylist()]
            left, right = _linked_rows(found, component, second, similarity)
        return pa.table({"a": node[np.array(left, np.int64)], "b": node[np.array(right, np.int64)]})

    return met.select("family", *sides, "node", "component", "set").groupBy("family", "i", "j").applyInArrow(work, "a long, b long")


def rare_meetings(members: DataFrame, known: DataFrame, texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``node, size, component`` to distinct pairs ``a, b`` of different components that may be alike, and to links.

    None is missed: what a shingle of many classes has in common is settled at once by ``family_links``.
    Shingles of one class alone come first in its order and meet nobody: they are counted and not shipped.  From its
    shingle at place ``i`` on a class can share ``size - i``, so no partner larger than ``most`` comes into question.
    """

    def work(columns: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for c in columns:
            for node, text in zip(c["node"].to_pylist(), raw_texts(c["text"]), strict=True):
                hashes = shingles(text, words).view(np.int64)
                yield {"node": np.full(len(hashes), node), "shingle": hashes}

    rows = cut_lineage(map_columns(texts.join(members.select("node"), "node", "left_semi"), "node long, shingle long", work), "near-shingles")
    counts = rows.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    shared = rows.join(counts, "shingle").groupBy("node").agg(F.array_sort(F.collect_set(F.struct("n", "shingle"))).alias("shared"))
    alone, size = F.col("size") - F.size("shared"), F.col("size")
    wanted = (size - F.ceil(size * similarity - 1e-9) + 1 - alone).cast("int")
    first = members.join(shared, "node").filter(wanted > 0)
    first = first.select("node", "size", "component", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), wanted)["shingle"]).alias("i", "shingle"))
    most = F.floor((size - F.col("alone") - F.col("i")) * ((1 + similarity) / similarity) + 1e-6) - size
    first = cut_lineage(first.select("shingle", "node", "size", "component", most.alias("most")), "near-rare")
    cells = first.groupBy("shingle").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("size").alias("least"), F.max("most").alias("reach")
    )
    held = first.join(cells.filter("low <> high").drop("low", "high"), "shingle")
    roles = {"as_larger": F.col("most") >= F.greatest("least", size * similarity - 1e-9), "as_smaller": size <= F.col("reach")}
    held = held.withColumns(roles).filter("as_larger or as_smaller").drop("least", "reach")
    sizes = held.groupBy("shingle").agg(F.count_if("as_larger").alias("n"), F.count_if("as_smaller").alias("m"))
    met = cut_lineage(held.join(sizes.filter("n > 0 and m > 0"), "shingle").withColumn("n", F.greatest("n", "m")), "near-met")
    small = met.filter(F.col("n") <= MEMBERS)
    a, b = (small.select("shingle", role, *(F.col(c).alias(f"{end}_{c}") for c in ("node", "size", "most", "component"))) for end, role in (("a", "as_larger"), ("b", "as_smaller")))
    pairs = a.filter("as_larger").join(b.filter("as_smaller"), "shingle").filter(_can_meet(similarity))
    pairs = pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
    pairs = pairs.join(_as(known, "a", "low"), "a").join(_as(known, "b", "low"), "b")
    pairs = pairs.filter(equal_bytes("a_low", "b_low") >= EQUAL_BYTES).select("a", "b")
    return pairs, family_links(met.filter(F.col("n") > MEMBERS), rows, similarity)


def near_fingerprint_pairs(known: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct ``node, size, fp`` to pairs ``a, b`` of classes with fingerprints at most two bits apart.

    Classes of one fingerprint meet the smallest of them; near fingerprints meet by their smallest classes.
    """
    from pagemill.llm.simhash import near_fingerprints

    heads = cut_lineage(known.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("head")), "near-fingerprints")
    a, b = (heads.select(F.col("fp").alias(f"{x}_fp"), F.col("head.node").alias(x), F.col("head.size").alias(f"{x}_size")) for x in "ab")
    near = near_fingerprints(heads.select("fp")).select(F.col("a").alias("a_fp"), F.col("b").alias("b_fp"))
    near = near.join(a, "a_fp").join(b, "b_fp").select("a", "a_size", "b", "b_size")
    same = known.withColumnRenamed("fp", "a_fp").join(a, "a_fp").filter("node <> a")
    same = same.select("a", "a_size", F.col("node").alias("b"), F.col("size").alias("b_size"))
    return near.unionByName(same).filter(_sizes_fit(similarity)).select("a", "b").distinct()


def links(docs: DataFrame, known: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs ``a, b`` of classes whose sets are alike by ``similarity`` or more, enough to join every component."""
    met = cut_lineage(crowded_cells(known), "near-cells")
    near = cut_lineage(near_fingerprint_pairs(known.filter("size > 0"), similarity), "near-simhash")
    asked = met.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = known.join(asked, "node", "left_semi").select("node", "first.*")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    texts = cut_lineage(rows.join(wanted, same).select("node", "text"), "near-wanted")
    found = cut_lineage(alike(near, texts, words, similarity), "near-links")
    for seed in range(STARS + 1):
        components = component_roots(found).withColumnRenamed("root", "component")
        held = cut_lineage(contested(met, components), "near-contested")
        if seed < STARS:
            pairs = cut_lineage(stars(held, seed, similarity), "near-stars")
        else:
            members = cut_lineage(held.select("node", "size", "component").distinct(), "near-members")
            pairs, settled = rare_meetings(members, known, texts, words, similarity)
            pairs, found = cut_lineage(pairs, "near-pairs"), found.unionByName(cut_lineage(settled, "near-settled"))
        found = cut_lineage(alike(pairs, texts, words, similarity).unionByName(found), "near-links")
    return found


def near_texts(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, text`` to ``doc_id, text_hash, kept``, row for row.

    ``kept`` marks the row that stays of its component: smallest id first, null last, then smallest hash; several
    equal rows can be marked.
    """
    marked = cut_lineage(sketches(docs, words), "near-sketches")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    grouped = marked.groupBy("node").agg(F.min(key).alias("first"), *(F.first(c).alias(c) for c in ("size", "fp", "cells", "low")))
    known = cut_lineage(grouped, "near-distinct")
    roots = component_roots(links(docs, known, words, similarity)).withColumnRenamed("node", "linked")
    rooted = known.join(roots, F.col("node") == F.col("linked"), "left")
    rooted = rooted.select("node", "first", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("first"))
    classes = rooted.select("node", "root").join(named, "root").drop("root")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return marked.select("doc_id", "text_hash", "node").join(classes, "node").select("doc_id", "text_hash", stays.alias("kept"))
