"""Source divergence audit: how far the terms of each source of a language lie from those of every other source.

All shares are whole billionths, so every figure is exact.  A language keeps the terms of at least ``MIN_DOCS`` of its
documents.  A group (a source of a language) has the share ``p = 1 + floor(10^9 (n + 2) / (N + 2 V))`` of a kept term
that it uses ``n`` times.  Two groups differ by the sum of ``floor((p - q)^2 / (p + q))`` over all kept terms.

The sums are a product of the groups' rows with a term-major index, accumulated row by row.  A task holds the index of
some terms; each group walks through its own terms there and scatters into a dense row of one number a peer.  A term
that a group does not use has the group's zero share, so a row starts as if no term were used by both, which takes one
step for each distinct share, and every posting of a peer that is met corrects what was assumed.  Terms that neither
uses are counted, never visited.  A task gives one number a pair of groups; pairs of postings are never rows.  Groups
are dealt into blocks of ``PEERS``, and terms so that a task has some ``POSTINGS``.

Defined results: null text, lang and source are empty texts; repeated rows count as often as they come; ties go to the
smaller item in code-point order; a language without kept terms has pairs of value 0; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.batches import map_columns, raw_texts, texts
from pagemill.session import cut_lineage

MIN_DOCS, TOP = 10, 10
BILLION = 1_000_000_000
PEERS, POSTINGS = 512, 400_000
HELD_TERMS, HELD_BYTES = 300_000, 64_000_000  # a worker's counts are handed on beyond either
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of all beyond ASCII in UTF-8 text, A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """``text, lang, source`` to ``lang, source, term, n, docs``: occurrences and documents; one row may come several times."""

    def rows(held: dict) -> dict:
        out: dict[str, list] = {name: [] for name in ("lang", "source", "term", "n", "docs")}
        for (lang, source), (times, seen) in held.items():
            out["lang"] += [lang] * len(times)
            out["source"] += [source] * len(times)
            out["term"] += [t.decode() for t in times]
            out["n"] += times.values()
            out["docs"] += [seen[t] for t in times]
        return out

    def work(columns: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        held, read, distinct = {}, 0, 0
        for c in columns:
            for text, lang, source in zip(raw_texts(c["text"]), texts(c["lang"]), texts(c["source"]), strict=True):
                times, seen = held.setdefault((lang, source), (Counter(), Counter()))
                before, found = len(times), terms(text)
                times.update(found)
                seen.update(set(found))
                read, distinct = read + len(text), distinct + len(times) - before
                if distinct > HELD_TERMS or read > HELD_BYTES:
                    yield rows(held)
                    held, read, distinct = {}, 0, 0
        yield rows(held)

    return map_columns(docs.select("text", "lang", "source"), "lang string, source string, term string, n long, docs long", work)


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, n, lang_n, leads`` of kept terms; ``leads`` on one row of each term of a language."""
    counted = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    counted = counted.withColumns(
        {"lang_n": F.sum("n").over(whole), "in_docs": F.sum("docs").over(whole), "least": F.min("source").over(whole)}
    )
    return counted.filter(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("least")).alias("leads"))


def share(n: Column, total: Column, vocabulary: Column) -> Column:
    """``1 + floor(10^9 (n + 2) / (total + 2 vocabulary))`` without rounding; null where nothing is kept."""
    top = F.lit(BILLION).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")
    bottom = (total + vocabulary * 2).cast("decimal(19,0)")
    return F.when(bottom > 0, F.lit(1).cast("long") + F.call_function("div", top, bottom))


def distance(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``; a share is at most 10^9 + 1, so its square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Each occurring ``lang, source`` with ``total, zero, lang_total, vocabulary, postings, place, groups``.

    ``zero`` is the group's share of a term that it does not use, ``postings`` counts the language's kept
    ``(source, term)``, ``place`` numbers its groups.
    """
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("used"), F.count_if("leads").alias("led"))
    own = named.join(sums, ["lang", "source"], "left").na.fill(0, ["total", "used", "led"])
    of_lang = Window.partitionBy("lang")
    placed = own.select(
        "lang",
        "source",
        "total",
        F.sum("total").over(of_lang).alias("lang_total"),
        F.sum("led").over(of_lang).alias("vocabulary"),
        F.sum("used").over(of_lang).alias("postings"),
        (F.row_number().over(of_lang.orderBy("source")) - 1).alias("place"),
        F.count("*").over(of_lang).alias("groups"),
    )
    return placed.withColumn("zero", share(F.lit(0).cast("long"), F.col("total"), F.col("vocabulary")))


class Block(NamedTuple):
    """Postings of some groups, by group: those of group ``k`` lie from ``starts[k]`` to ``starts[k + 1]``."""

    places: np.ndarray
    zeros: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    shares: np.ndarray


def block_of(place: np.ndarray, term: np.ndarray, value: np.ndarray) -> Block:
    """Rows of postings, and of each group's zero share under the term -1, to a block."""
    order = np.argsort(place, kind="stable")
    place, term, value = place[order], term[order], value[order]
    group, posting = term < 0, term >= 0
    starts = np.append(np.searchsorted(place[posting], place[group]), posting.sum())
    return Block(place[group], value[group], starts, term[posting], value[posting])


def _unmet(own: Block, zeros: np.ndarray) -> np.ndarray:
    """What the terms of each group add to its distance from peers that do not use them, over two zero shares."""
    out = np.zeros((len(own.places), len(zeros)), np.int64)
    for k, acc in enumerate(out):
        shares, times = np.unique(own.shares[own.starts[k] : own.starts[k + 1]], return_counts=True)
        for p, n in zip(shares, times, strict=True):
            acc += n * _distance(p, zeros)
        acc -= times.sum() * _distance(own.zeros[k], zeros)
    return out


def accumulate(own: Block, peers: Block) -> np.ndarray:
    """One row a group and one column a peer: what the terms that either uses add to the distance of two zero shares."""
    out = _unmet(own, peers.zeros) + _unmet(peers, own.zeros).T
    order = np.argsort(peers.terms, kind="stable")  # the term-major index: by term, then peer
    index, shares = peers.terms[order], peers.shares[order]
    column = np.repeat(np.arange(len(peers.places)), np.diff(peers.starts))[order]
    for k, acc in enumerate(out):
        mine = slice(own.starts[k], own.starts[k + 1])
        low = np.searchsorted(index, own.terms[mine], "left")
        sizes = np.searchsorted(index, own.terms[mine], "right") - low
        met = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        p, q, peer, zero = np.repeat(own.shares[mine], sizes), shares[met], column[met], own.zeros[k]
        other = peers.zeros[peer]
        assumed = _distance(p, other) + _distance(zero, q) - _distance(zero, other)
        np.add.at(acc, peer, _distance(p, q) - assumed)
    return out


def _pair_sums(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, term, place, p`` and the groups to ``lang, place, other, value``: sums over terms that either uses."""
    blocks = F.ceil(F.col("groups") / PEERS).cast("int")
    parts = F.greatest(F.lit(1), F.ceil(F.col("postings") * 2 / (blocks * POSTINGS))).cast("int")
    sizes = groups.select("lang", "place", "zero", blocks.alias("blocks"), parts.alias("parts"))
    used = postings.join(sizes.drop("zero"), ["lang", "place"]).withColumn("part", F.pmod(F.xxhash64("term"), "parts").cast("int"))
    zeros = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    zeros = zeros.select("lang", F.lit(None).cast("string").alias("term"), "place", F.col("zero").alias("p"), "blocks", "part")
    rows = used.select(zeros.columns).unionByName(zeros).withColumn("block", F.floor(F.col("place") / PEERS).cast("int"))
    met = rows.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        "lang",
        "part",
        F.least("block", "against").alias("i"),
        F.greatest("block", "against").alias("j"),
        (F.col("block") > F.col("against")).alias("second"),
        "place",
        "term",
        "p",
    )

    def work(group: pa.Table) -> pa.Table:
        codes = group["term"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        columns = [group["place"].to_numpy(), codes, group["p"].to_numpy()]
        second = group["second"].to_numpy()
        own = block_of(*(c[~second] for c in columns))
        peers = block_of(*(c[second] for c in columns)) if second.any() else own
        sums = accumulate(own, peers)
        place = np.repeat(own.places, len(peers.places))
        other, value = np.tile(peers.places, len(own.places)), sums.ravel()
        if peers is not own:  # distances are the same both ways
            place, other, value = np.append(place, other), np.append(other, place), np.append(value, value)
        lang = pa.array([group["lang"][0].as_py()] * len(place), pa.string())
        return pa.table({"lang": lang, "place": place, "other": other, "value": value})

    found = met.groupBy("lang", "i", "j", "part").applyInArrow(work, "lang string, place int, other int, value long")
    return found.groupBy("lang", "place", "other").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``text, lang, source`` to ``lang, source, part, item, value, rank``.

    Part ``pair`` has every other source of the language; part ``term`` the ``top`` kept terms that the group uses more
    than its language does, by their distance from the language's share.
    """
    kept = cut_lineage(kept_counts(docs, min_docs), "divergence-kept")
    groups = cut_lineage(group_totals(docs, kept), "divergence-groups")
    of_group = groups.select("lang", "source", "place", "total", "lang_total", "vocabulary")
    p = share(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p")
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary")).alias("q")
    shares = kept.join(of_group, ["lang", "source"]).select("lang", "source", "place", "term", p, q)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    used = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    best = used.select("*", rank).filter(F.col("rank") <= top)
    sums = _pair_sums(shares.select("lang", "term", "place", "p"), groups.filter("vocabulary > 0"))
    peers = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("other"), F.col("zero").alias("other_zero"))
    pairs = groups.join(peers, "lang").filter("place <> other").join(sums, ["lang", "place", "other"], "left")
    value = F.coalesce(F.col("vocabulary") * distance(F.col("zero"), F.col("other_zero")) + F.col("value"), F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return pairs.select("*", rank).unionByName(best)
