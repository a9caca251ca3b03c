"""WARC: resolution of "not modified" revisit records.

A revisit is joined as of its date to the latest earlier full response of the same canonical URL.  Its
validators must fit that response: entity tags are compared weakly when both have one, else dates of last
modification when both have one.  A resolved revisit gets the response's payload digest and headers,
updated by those headers of its own that a "not modified" answer may change.

The as-of join is a window per URL.  A URL with more than ``SLICE_ROWS`` records is cut into slices of its
time, each a window of its own; what a slice knows at its end is handed to the next ones by a second,
narrow window over slices.  The list of such URLs is written before it is joined, so Spark knows its size.

Defined results: records with a null URL, date or id stay and are not joined; of several records with one
date the smaller id is earlier; repeated records of one id are not earlier than each other; a revisit
without an earlier response is ``no_response``, with contradicting validators ``mismatch``, with none to
compare ``no_validator``; all other records are ``full`` (status 200 response) or ``other``; header names
are compared in lower case, repeated headers are joined by commas; null headers are none; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import cut_lineage

SLICE_ROWS = 50_000
# Headers of a stored response that a "not modified" answer doesn't change
KEPT_HEADERS = (
    "connection content-encoding content-length content-range content-type keep-alive proxy-authenticate "
    "proxy-authentication-info proxy-connection te trailer transfer-encoding upgrade"
).split()


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and usual ports, path without closing slash, no scheme or fragment."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"(?s)#.*$", "")
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    tail = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1), r"/+(\?|$)", "$1")
    return F.concat(F.regexp_replace(F.lower(host), r"^www\.|:(80|443)$", ""), tail)


def parse_headers(block: Column) -> Column:
    """``Name: value`` lines to a map with names in lower case."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: F.instr(x, ":") > 0)
    name = lambda x: F.lower(F.trim(F.substring_index(x, ":", 1)))
    value = lambda x: F.trim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1))
    return F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform(lines, name)),
            lambda n: F.struct(n, F.array_join(F.transform(F.filter(lines, lambda x: name(x) == n), value), ", ")),
        )
    )


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.trim(headers["etag"]), "^W/", "")


def merge_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, updated by the fresh ones that may change; in order of names."""
    permitted = F.map_filter(fresh, lambda k, v: ~k.isin(KEPT_HEADERS))
    older = F.map_filter(stored, lambda k, v: ~F.map_contains_key(permitted, k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(older, permitted))))


def _slices(rows: DataFrame, slice_rows: int) -> DataFrame:
    """``slice`` of each row: 0, or the part of its URL's time for URLs with many records."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
    hot = counts.filter((F.col("n") > slice_rows) & F.col("key").isNotNull())
    wide = F.greatest((F.col("high") - F.col("low") + 1) / F.ceil(F.col("n") / slice_rows), F.lit(1.0))
    hot = cut_lineage(hot.select(F.col("key").alias("hot_key"), "low", wide.alias("wide")), "hot-urls")
    part = F.coalesce(F.floor((F.col("at") - F.col("low")) / F.col("wide")), F.lit(0))
    return rows.join(hot, rows["key"] == hot["hot_key"], "left").withColumn("slice", part).drop("hot_key", "low", "wide")


def resolve_revisits(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``record_id, url, kind, status, date, headers, digest`` to the same rows with their outcome.

    ``kind`` is the WARC type, ``date`` a timestamp, ``headers`` a map as ``parse_headers`` makes it.  Result:
    ``record_id, canonical, outcome, ref_id, headers, digest``.
    """
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"),
        canonical_url(F.col("url")).alias("canonical"),
        F.unix_micros("date").alias("at"),
        headers.alias("own"),
        "digest",
        F.when(full, "full").when(F.col("kind") == "revisit", "revisit").otherwise("other").alias("role"),
    )
    joinable = F.col("canonical").isNotNull() & F.col("at").isNotNull() & F.col("record_id").isNotNull()
    rows = rows.withColumn("key", F.when(joinable & (F.col("role") != "other"), F.col("canonical")))
    asked = _slices(rows.filter("key is not null"), slice_rows)
    stored = F.when(F.col("role") == "full", F.struct("at", "record_id", F.col("own").alias("headers"), "digest"))
    before = Window.partitionBy("key", "slice").orderBy("at", "record_id").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # a revisit's own row holds no response, so equal ids do not meet themselves
    near = asked.withColumn("near", F.last(stored, ignorenulls=True).over(before))
    ends = asked.filter("role = 'full' and slice is not null").groupBy("key", "slice").agg(
        F.max_by(stored, F.struct("at", "record_id")).alias("end")
    )
    slices = asked.select("key", "slice").distinct().join(ends, ["key", "slice"], "left")
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("carried", F.last("end", ignorenulls=True).over(earlier)).filter("carried is not null")
    met = near.join(carried.select("key", "slice", "carried"), ["key", "slice"], "left")
    met = met.withColumn("ref", F.when(F.col("role") == "revisit", F.coalesce("near", "carried")))
    tags = _tag(F.col("own")), _tag(F.col("ref.headers"))
    dates = F.trim(F.col("own")["last-modified"]), F.trim(F.col("ref.headers")["last-modified"])
    fits = F.when(tags[0].isNotNull() & tags[1].isNotNull(), tags[0] == tags[1]).when(
        dates[0].isNotNull() & dates[1].isNotNull(), dates[0] == dates[1]
    )
    outcome = (
        F.when(F.col("role") != "revisit", F.col("role"))
        .when(F.col("ref").isNull(), "no_response")
        .when(fits, "resolved")
        .when(~fits, "mismatch")
        .otherwise("no_validator")
    )
    resolved = F.col("outcome") == "resolved"
    done = met.withColumn("outcome", outcome).select(
        "record_id",
        "canonical",
        "outcome",
        F.when(resolved, F.col("ref.record_id")).alias("ref_id"),
        F.when(resolved, merge_headers(F.col("ref.headers"), F.col("own"))).otherwise(F.col("own")).alias("headers"),
        F.when(resolved, F.col("ref.digest")).otherwise(F.col("digest")).alias("digest"),
    )
    rest = rows.filter("key is null").select(
        "record_id",
        "canonical",
        F.when(F.col("role") == "revisit", "no_response").otherwise(F.col("role")).alias("outcome"),
        F.lit(None).cast("long").alias("ref_id"),
        F.col("own").alias("headers"),
        "digest",
    )
    return done.unionByName(rest)


def header_lines(headers: Column) -> Column:
    """A map as ``name: value`` lines in order of names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
