"""Removal of repeated byte strings: each byte in a ``length``-byte string that also starts earlier goes.

Texts are UTF-8 bytes.  Every ``length``-byte window is named by its anchor, the ``ANCHOR`` bytes in it
whose hash is smallest, leftmost first.  Equal windows have equal anchors, so they meet in one shard.
Consecutive windows of one text with the same anchor form a region, about 130 bytes.  Then:

1. Regions with the same anchor and content are repeats as a whole: all but the earliest go.  Equal ones
   within a batch of a task are settled before the shuffle, so a text copied a million times sends one
   row per batch.  Rows are numbers: anchor, content hash, document, place.
2. Where one anchor has several contents, the earliest of each is cut out of its text and shards of such
   regions are sorted as suffix arrays (``suffix_array``): windows whose permuted common prefix with the
   predecessor reaches ``length`` are equal, and all but the earliest of a run go.  Both 64-bit hashes must
   collide for a false repeat in step 1; step 2 compares bytes.
3. Anchors with more than ``MOST_REGIONS`` contents would not fit into one task.  Their windows are grouped
   by SHA-256 in Spark instead, which combines on the map side; the result is the same.

Earlier means smaller doc_id (null last; documents that share an id by the hash of their text), then the
earlier start.  Rows with equal id and text count as one document and get the same answer.

Defined results: null texts are empty; texts shorter than ``length`` lose nothing; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.batches import map_columns, raw_texts
from pagemill.llm.suffix_array import common_prefixes, suffix_array
from pagemill.session import cut_lineage

LENGTH, ANCHOR = 100, 24
SHARD_BYTES = 1_000_000  # of regions that are sorted together
MOST_REGIONS = 20_000  # contents of one anchor in one shard, some 3 MB
_PLACE_BITS = 31  # a text has less than 2 GB


def _hash_runs(text: bytes, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` bytes."""
    out = (np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    size = 1
    while size < width:
        step = min(size, width - size)  # the last step may overlap
        mixed = out[:-step] * np.uint64(0xBF58476D1CE4E5B9)
        out = (mixed ^ (mixed >> np.uint64(29))) + out[step:]
        size += step
    return out


def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def regions(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchor hash, first and last window start, and place of the anchor, of each region of a text."""
    hashes = _hash_runs(text, anchor)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    keyed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    place = (_least_in_windows(keyed, length - anchor + 1) & low).astype(np.int64)
    first = np.nonzero(np.concatenate([[True], place[1:] != place[:-1]]))[0]
    last = np.append(first[1:], len(place)) - 1
    return hashes[place[first]].view(np.int64), first, last, place[first]


REGION = "anchor long, content long, doc long, row long, place long, gone boolean"


def text_regions(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """``doc, row, text`` to rows of ``REGION``; ``place`` is 128 x first window + number of others.

    ``gone`` rows have an earlier equal region in the same batch; a number of their own takes the place of
    the anchor, so they go to any shard.
    """

    def work(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for batch in batches:
            parts = []
            rows = zip(batch["doc"].to_pylist(), batch["row"].to_pylist(), raw_texts(batch["text"]), strict=True)
            ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            for n, (_, _, text) in enumerate(ordered):
                if len(text) < length:
                    continue
                found, first, last, at = regions(text, length, anchor)
                content = np.fromiter(
                    (
                        xxhash.xxh3_64_intdigest(text[a : b + length], p - a)
                        for a, b, p in zip(first.tolist(), last.tolist(), at.tolist(), strict=True)
                    ),
                    np.uint64,
                    len(first),
                ).view(np.int64)
                parts.append((found, content, np.full(len(first), n), first * 128 + last - first))
            found, content, n, place = map(np.concatenate, zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
            order = np.lexsort((content, found))  # stable: equal regions stay in order of document and place
            same = np.zeros(len(found), bool)
            same[order[1:]] = (found[order[1:]] == found[order[:-1]]) & (content[order[1:]] == content[order[:-1]])
            yield {
                "anchor": np.where(same, content ^ place, found),
                "content": np.where(same, 0, content),
                "doc": [ordered[i][0] for i in n.tolist()],
                "row": [ordered[i][1] for i in n.tolist()],
                "place": place,
                "gone": same,
            }

    return map_columns(docs, REGION, work)


JUDGED = "doc long, row long, place long, anchor long, gone boolean"


def judge_regions(found: DataFrame) -> DataFrame:
    """Regions that go, and the earliest of each content where an anchor has several, with its anchor.

    A shard's rows come sorted and are read as a stream; one row is held back.
    """

    def work(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        held, last = None, (None, None)  # the anchor's first row while it may still be alone; the previous row
        for batch in batches:
            anchor, content = batch["anchor"].to_numpy(), batch["content"].to_numpy()
            gone = batch["gone"].to_numpy(zero_copy_only=False).copy()
            known = ~gone
            if not len(anchor):
                continue
            same_anchor = known & np.concatenate([[anchor[0] == last[0]], anchor[1:] == anchor[:-1]])
            same_anchor[1:] &= known[:-1]
            same = same_anchor & np.concatenate([[content[0] == last[1]], content[1:] == content[:-1]])
            gone |= same
            another = same_anchor & ~same  # a further content of the same anchor
            group = np.cumsum(~same_anchor)  # 0: the anchor of the batch before
            several = np.zeros(group[-1] + 1, bool)
            several[group[another]] = True
            first = ~same_anchor & known
            check = (another | (first & several[group])) & known
            keep = np.nonzero(gone | check)[0]
            out = {k: batch[k].take(pa.array(keep)) for k in ("doc", "row", "place")}
            out |= {"anchor": pa.array(anchor[keep], mask=gone[keep]), "gone": gone[keep]}
            if held is not None and several[0]:
                yield held
                held = None
            if len(keep):
                yield out
            if group[-1]:  # the last anchor began here
                at = np.nonzero(~same_anchor)[0][-1]
                one = pa.array([at])
                held = {k: batch[k].take(one) for k in ("doc", "row", "place", "anchor")} | {"gone": [False]}
                if not known[at] or several[group[-1]]:
                    held = None
            last = (anchor[-1], content[-1]) if known[-1] else (None, None)

    placed = found.repartition("anchor").sortWithinPartitions(
        "gone", "anchor", "content", F.asc_nulls_last("doc"), "row", "place"
    )
    return map_columns(placed, JUDGED, work)


def _with_texts(docs: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """``doc, row, text`` with what is listed for a document.

    Both uses shuffle the texts in the same way, so Spark does it once and reuses the exchange.
    """
    named = listed.withColumnsRenamed({"doc": "l_doc", "row": "l_row"})
    same = F.col("doc").eqNullSafe(F.col("l_doc")) & F.col("row").eqNullSafe(F.col("l_row"))
    return docs.select("doc", "row", "text").join(named, same, how).drop("l_doc", "l_row")


def cut_out(docs: DataFrame, checks: DataFrame, length: int) -> DataFrame:
    """``anchor, doc, row, first, piece``: the bytes of the regions to be compared."""
    wanted = checks.groupBy("doc", "row").agg(F.collect_list(F.struct("anchor", "place")).alias("wanted"))
    met = _with_texts(docs, wanted, "inner")

    def work(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for batch in batches:
            out = {k: [] for k in ("anchor", "doc", "row", "first", "piece")}
            rows = zip(*(batch[k].to_pylist() for k in ("doc", "row", "wanted")), raw_texts(batch["text"]), strict=True)
            for doc, row, wanted_, text in rows:
                for w in wanted_:
                    first, more = divmod(w["place"], 128)
                    values = (w["anchor"], doc, row, first, text[first : first + more + length])
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
            yield out

    return map_columns(met, "anchor long, doc long, row long, first long, piece binary", work)


def _repeats(rows: list[tuple], length: int) -> Iterator[tuple]:
    """``doc, row, start, end`` of repeated windows in regions ``doc, row, first, piece``, joined to runs."""
    rows = list({r[:3]: r for r in rows}.values())  # a document given twice counts once
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    joined = b"\x00".join(r[3] for r in rows)
    starts = np.cumsum([0, *(len(r[3]) + 1 for r in rows[:-1])])
    s = np.frombuffer(joined, np.uint8).astype(np.int32) + 1
    s[starts[1:] - 1] = 0  # a separator below all bytes
    counts = np.array([len(r[3]) - length + 1 for r in rows])
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    windows = np.repeat(starts, counts) + offset  # in order: earlier windows first
    sa = suffix_array(s, length)
    # of windows only: the prefix common with the previous window is the least of those on the way
    is_window = np.zeros(len(s), bool)
    is_window[windows] = True
    reach = np.zeros(len(s), np.int32)
    reach[sa] = common_prefixes(s, sa, sa, length)
    ordered = reach[sa] < length  # a new run of equal windows begins
    run = np.cumsum(ordered)
    kept = is_window[sa]
    run_of, place = run[kept], sa[kept]
    least = np.full(run[-1] + 1, len(s), np.int64)
    np.minimum.at(least, run_of, place)
    repeated = np.zeros(len(s), bool)
    repeated[place[place > least[run_of]]] = True
    flags = repeated[windows]
    owner = np.repeat(np.arange(len(rows)), counts)
    begins = flags & ~np.concatenate([[False], flags[:-1] & (owner[1:] == owner[:-1])])
    ends = flags & ~np.concatenate([flags[1:] & (owner[1:] == owner[:-1]), [False]])
    for a, b in zip(np.nonzero(begins)[0].tolist(), np.nonzero(ends)[0].tolist(), strict=True):
        doc, row, first, _ = rows[owner[a]]
        yield doc, row, first + int(offset[a]), first + int(offset[b]) + length


SPAN = "doc long, row long, start long, end long"


def compare_regions(pieces: DataFrame, length: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Suffix arrays over shards; regions of one anchor lie in one shard."""

    def work(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        rows, size, last = [], 0, None

        def spans() -> dict:
            found = list(zip(*_repeats(rows, length), strict=True)) or [()] * 4
            return dict(zip(("doc", "row", "start", "end"), map(list, found), strict=True))

        for batch in batches:
            for anchor, *row in zip(*(batch[k].to_pylist() for k in ("anchor", "doc", "row", "first", "piece")), strict=True):
                if size >= shard_bytes and anchor != last:
                    yield spans()
                    rows, size = [], 0
                rows.append(tuple(row))
                size, last = size + len(row[3]) + 1, anchor
        if rows:
            yield spans()

    return map_columns(pieces.repartition("anchor").sortWithinPartitions("anchor"), SPAN, work)


def compare_windows(pieces: DataFrame, length: int) -> DataFrame:
    """The same by grouping whole windows, for anchors with very many contents."""

    def work(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for batch in batches:
            out = {k: [] for k in ("doc", "row", "start", "window")}
            for doc, row, first, piece in zip(*(batch[k].to_pylist() for k in ("doc", "row", "first", "piece")), strict=True):
                for i in range(len(piece) - length + 1):
                    for column, value in zip(out.values(), (doc, row, first + i, hashlib.sha256(piece[i : i + length]).digest()), strict=True):
                        column.append(value)
            yield out

    windows = map_columns(pieces.drop("anchor"), "doc long, row long, start long, window binary", work).distinct()
    order = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "row", "start")
    first = windows.groupBy("window").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = windows.withColumn("own", order).join(first, "window").filter(F.col("own") > F.col("first"))
    return later.select("doc", "row", "start", (F.col("start") + length).alias("end"))


def repeated_spans(
    keyed: DataFrame, rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES, most: int = MOST_REGIONS
) -> DataFrame:
    """``doc, row, text`` to ``doc, row, start, end`` of repeated bytes; spans overlap.

    ``rows`` may hold a document more than once, ``keyed`` has each once.
    """
    judged = cut_lineage(judge_regions(text_regions(keyed, length, anchor)), "suffix-judged")
    first = F.floor(F.col("place") / 128)
    gone = judged.filter("gone").select(
        "doc", "row", first.alias("start"), (first + F.col("place") % 128 + length).alias("end")
    )
    checks = judged.filter(~F.col("gone"))
    crowded = checks.groupBy("anchor").count().filter(F.col("count") > most).select("anchor")
    crowded = cut_lineage(crowded, "suffix-crowded")
    pieces = cut_out(rows, checks, length)
    spans = gone.unionByName(compare_regions(pieces.join(crowded, "anchor", "left_anti"), length, shard_bytes))
    if crowded.isEmpty():
        return spans
    return spans.unionByName(compare_windows(pieces.join(crowded, "anchor", "left_semi"), length))


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, **limits: int) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``, row for row.

    ``kept`` is the remaining bytes; a caller that needs only their digest leaves the column out.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    again = plain.filter("doc is not null").groupBy("doc").count().filter("count > 1").select(F.col("doc").alias("shared"))
    again = cut_lineage(again, "suffix-shared-ids")  # rows are told apart by their text only where ids do not do so
    rows = plain.join(again, plain["doc"] == again["shared"], "left").select(
        "doc",
        F.when(F.col("doc").isNull() | F.col("shared").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("row"),
        "text",
    )
    one = rows.filter("row = 0").unionByName(rows.filter("row <> 0").dropDuplicates(["doc", "row"]))
    spans = repeated_spans(one, rows, length, anchor, **limits)
    found = spans.groupBy("doc", "row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    cut = F.arrow_udf(_cut, "n_bytes long, n_removed long, n_spans long, kept binary")("text", "spans").alias("cut")
    return _with_texts(rows, found, "left").select("doc", cut).select(F.col("doc").alias("doc_id"), "cut.*")


def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for raw, found in zip(raw_texts(text), spans.to_pylist(), strict=True):
        runs: list[list[int]] = []
        for s in found or []:
            if runs and s["start"] <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], s["end"])
            else:
                runs.append([s["start"], s["end"]])
        edges = [0, *(x for r in runs for x in r), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        rows.append({"n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(runs), "kept": kept})
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    return pa.array(rows, kind)
