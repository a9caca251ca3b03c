"""Sitemap XML as rows, with nested indexes followed level by level.

Files are read entry by entry: the text reader ends a record at the closing tag, so Spark cuts a large file into as many
tasks as any other text, and one broken entry spoils no other.  Bodies that lie in a column are read by the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.text import strip, text_or_empty
from pagemill.session import cut_lineage

_URLSET = "url array<struct<loc:string,lastmod:string,priority:string>>"
_INDEX = "sitemap array<struct<loc:string>>"


def read_bodies(spark, path: str) -> DataFrame:
    """Stored sitemap files: one row per file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.input_file_name().alias("url"), F.col("value").alias("body"))


def _entries(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Stored files to one row per ``<tag>`` element, as ``entry``; other columns come from folders, or ``source_sitemap`` is the file."""
    rows = spark.read.option("lineSep", f"</{tag}>").text(path)
    if "source_sitemap" not in rows.columns:
        rows = rows.withColumn("source_sitemap", F.col("_metadata.file_path"))
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    opened = F.regexp_extract("value", rf"(?s)^.*(<{tag}(?:\s[^>]*)?>.*)$", 1)
    found = rows.select("source_sitemap", place.alias("pos"), opened.alias("entry"))
    return found.filter("entry <> ''").withColumn("entry", F.concat("entry", F.lit(f"</{tag}>")))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Stored urlsets to ``source_sitemap, pos, loc, lastmod, priority, corrupt``; ``corrupt`` holds what is no XML."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    parsed = F.from_xml("entry", "loc string, lastmod string, priority string, corrupt string", options)
    return _entries(spark, path, "url").select("source_sitemap", "pos", parsed.alias("x")).select("source_sitemap", "pos", "x.*")


def entry_urls(entries: DataFrame) -> DataFrame:
    """Entries with a location as URLs; those that are no XML are left out."""
    canonical = urls.normalize_url(F.col("loc"))
    return entries.filter(strip(text_or_empty(F.col("loc"))) != "").select(
        canonical.alias("url"),
        canonical.alias("canonical_url"),
        strip(text_or_empty(F.col("lastmod"))).alias("last_modified"),
        urls.sitemap_priority(F.col("priority")).alias("priority"),
        urls.normalize_url(F.col("source_sitemap")).alias("source_sitemap"),
        "pos",
    )


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """``sitemaps(url, body)``: one row per ``<url>`` entry with a location, in file order."""
    parsed = sitemaps.filter(F.contains(F.col("body"), F.lit("urlset"))).select(
        F.col("url").alias("source_sitemap"), F.from_xml("body", _URLSET).alias("x")
    )
    return entry_urls(parsed.select("source_sitemap", F.posexplode("x.url").alias("pos", "u")).select("source_sitemap", "pos", "u.*"))


def _children(located: DataFrame) -> DataFrame:
    """``parent, loc`` to distinct ``parent, url`` of locations that pass the locale filter."""
    named = located.select("parent", strip(text_or_empty(F.col("loc"))).alias("loc"))
    kept = named.filter((F.col("loc") != "") & urls.should_index_sitemap(F.col("loc")))
    return kept.select("parent", urls.normalize_url(F.col("loc")).alias("url")).distinct()


def read_children(spark: SparkSession, path: str) -> DataFrame:
    """Stored indexes to ``parent, url``: the sitemaps that each of them names."""
    parsed = _entries(spark, path, "sitemap").select("source_sitemap", F.from_xml("entry", "loc string").alias("x"))
    return _children(parsed.select(urls.normalize_url(F.col("source_sitemap")).alias("parent"), "x.loc"))


def child_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """``sitemaps(url, body)``: ``parent, url`` of the sitemaps that indexes name."""
    parsed = sitemaps.filter(F.contains(F.col("body"), F.lit("sitemapindex"))).select(
        F.col("url").alias("parent"), F.from_xml("body", _INDEX).alias("x")
    )
    return _children(parsed.select("parent", F.explode("x.sitemap").alias("s")).select("parent", "s.loc"))


def follow_children(children: DataFrame, roots: DataFrame) -> DataFrame:
    """Sitemaps reached from ``roots(url)`` by ``children(parent, url)``, until a level names no new one.

    Each level is written, so it is worked out once.
    """
    named = cut_lineage(children.select(F.col("parent").alias("url"), F.col("url").alias("child")), "sitemap-children")
    reached = roots.select("url").distinct().withColumn("level", F.lit(0))
    level, depth = reached, 0
    while True:
        depth += 1
        found = named.join(level.select("url"), "url", "left_semi").select(F.col("child").alias("url")).distinct()
        fresh = found.join(reached.select("url"), "url", "left_anti")
        level = cut_lineage(fresh.withColumn("level", F.lit(depth)), "sitemap-level")
        if level.isEmpty():
            return reached
        reached = reached.unionByName(level)


def follow_indexes(bodies: DataFrame, roots: DataFrame) -> DataFrame:
    """``follow_children`` of ``bodies(url, body)``, the stored sitemaps under normalized URLs; each is read once."""
    return follow_children(child_sitemaps(bodies), roots)
