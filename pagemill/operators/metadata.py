"""Cleaned documents to metadata documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text, urls
from pagemill.functions.text import let, text_or_empty


def document_key(canonical_url: Column, content_hash: Column) -> Column:
    return text.sha256(F.concat(canonical_url, F.lit("|"), content_hash))


def add_metadata(documents: DataFrame, collection: Column, crawled_at: Column) -> DataFrame:
    """``documents(pos, url, title, cleaned_content, language)`` to the metadata columns."""
    def found(kept: Column) -> Column:
        return F.struct(text.lines_hash(kept).alias("content_hash"), text.first_line(kept).alias("section_heading"))

    # a generator's columns are worked out once; the hash is used twice below
    told = F.inline(F.array(let(text.kept_lines(F.col("cleaned_content")), found)))
    keyed = documents.withColumn("canonical_url", urls.canonicalize_url(F.col("url"))).select("*", told)
    return keyed.select(
        "pos",
        document_key(F.col("canonical_url"), F.col("content_hash")).alias("document_id"),
        F.col("url").alias("source_url"),
        "canonical_url",
        "title",
        "section_heading",
        urls.url_category(F.col("canonical_url")).alias("category"),
        F.coalesce(F.nullif("language", F.lit("")), F.lit("en")).alias("language"),
        F.lit("website").alias("source_type"),
        collection.alias("collection"),
        crawled_at.alias("crawl_timestamp"),
        "content_hash",
        F.col("cleaned_content").alias("content"),
    )


def duplicate_hashes(documents: DataFrame) -> DataFrame:
    return documents.agg(
        (F.count("*") - F.count_distinct("content_hash")).alias("duplicate_hashes")
    )


def metadata_summary(documents: DataFrame) -> DataFrame:
    return documents.agg(
        F.count("*").alias("total_documents"),
        (F.count("*") - F.count_distinct("content_hash")).alias("duplicate_hashes"),
        F.count_if(text_or_empty(F.col("title")) == "").alias("missing_titles"),
        F.count_if(F.col("category") != "general").alias("categorized_documents"),
    )
