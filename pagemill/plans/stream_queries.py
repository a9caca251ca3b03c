"""Structured Streaming over the page and event tables, drained and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.plans import query, sql
from pagemill.plans.corpus_queries import PARSED
from pagemill.plans.url_queries import CANON, NORMAL
from pagemill.session import scratch_dir
from pagemill.streaming import usage as stream_usage
from pagemill.streaming.indexer import SiteIndexer


def page_files(t, parts: int = 2) -> tuple[str, int]:
    """The page table in parts that arrive in id order, and the number of files that make a part.

    A batch of so many files is one part, however many tasks have written it: the number of batches and the
    order of ids between them do not follow the size of the table.
    """
    path = scratch_dir(t.spark, "page-files")
    return path, write_page_files(t, path, parts)


def files_of(t, path: str) -> int:
    return len(t.spark.read.parquet(path).inputFiles())


def write_page_files(t, path: str, parts: int, between=lambda files: None) -> int:
    """Parts are ranges of ids; Spark writes the first with as many tasks as it reads, the others in no more files.

    ``between`` is called after each part with the number of files of the first, which is returned.
    """
    pages, files = t.plain("pages"), 0
    low, high = pages.agg(F.min("page_id"), F.max("page_id")).first()
    part = F.floor((F.col("page_id") - F.lit(low)) * parts / F.lit(high - low + 1))
    for i in range(parts):
        rows = pages.filter(part == i)
        (rows.coalesce(files) if files else rows).write.mode("append").parquet(path)
        files = files or files_of(t, path)
        between(files)
    return files


def indexer(t, name: str = "index") -> SiteIndexer:
    return SiteIndexer(t.spark, scratch_dir(t.spark, name), "website_pages")


_DECLARED = """starts_with(lower(regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1)), 'en')"""
_GATED = f"""WITH {PARSED}, probed AS (SELECT page_id, url, content, {_DECLARED} AS declared,
      array_to_string(list_filter([title, heading, content], lambda x: x <> ''), chr(10)) AS probe FROM parsed),
    keyed AS (SELECT *, {NORMAL} AS url_key FROM probed),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS rn FROM keyed) WHERE rn = 1),
    gated AS (SELECT *, declared OR {sql.reads_english('probe')} AS english FROM once)"""


@query("stream_index", f"{_GATED} SELECT DISTINCT {CANON} AS source_url FROM gated WHERE english")
def _(t):
    done = indexer(t).run(*page_files(t))
    return done.vectors().read().select(F.col("metadata.source_url").alias("source_url")).distinct()


@query("stream_resume", f"{_GATED} SELECT DISTINCT {CANON} AS source_url FROM gated WHERE english")
def _(t):
    """A run after each of two parts, and one more that finds nothing new."""
    path = scratch_dir(t.spark, "page-files")
    job = indexer(t, "resume")
    write_page_files(t, path, 2, between=lambda files: job.run(path, files))
    job.run(path)
    return job.vectors().read().select(F.col("metadata.source_url").alias("source_url")).distinct()


@query("stream_force", f"{_GATED} SELECT count(*) FILTER (english) AS english, 1 AS runs FROM gated")
def _(t):
    (path, files), job = page_files(t, 1), indexer(t, "force")
    job.run(path, files)
    job.run(path, files, force=True)  # the same folder, filled anew
    return job.run(path, files).summary().select("english", F.col("batches").cast("int").alias("runs"))


@query("stream_url_dedup", f"{_GATED} SELECT url_key FROM once")
def _(t):
    """Pages arrive in two parts, the second of which repeats the first."""
    path = scratch_dir(t.spark, "page-files")
    t.plain("pages").write.parquet(path)
    files = files_of(t, path)
    t.plain("pages").write.mode("append").parquet(path)
    done = indexer(t, "dedup").run(path, files)
    return done.processed_urls().select("url_key")


@query("stream_embed_flush")
def _(t):
    """Calls of the encoder, counted as they happen, and the texts that it was given."""
    calls, texts = t.spark.sparkContext.accumulator(0), t.spark.sparkContext.accumulator(0)
    job = indexer(t, "flush")
    load = job.load_encoder

    def counting():
        encoder = load()

        def encode(batch):
            calls.add(1)
            texts.add(len(batch))
            return encoder(batch)

        return encode

    job.load_encoder = counting
    done = job.run(*page_files(t, 2))
    return done.summary().select(
        "chunks", "embeddings", "cached", F.lit(calls.value).alias("encoder_calls"), F.lit(texts.value).alias("encoded_texts")
    )


@query("stream_pause", f"{_GATED} SELECT count(*) AS pages, 2 AS batches FROM once")
def _(t):
    """A timed trigger instead of draining: the stream stays up and takes what arrives meanwhile."""
    path, job, running = scratch_dir(t.spark, "page-files"), indexer(t, "pause"), []

    def go_on(files):
        if not running:
            running.append(job.start(path, files, pause="1 second"))
        running[0].processAllAvailable()

    write_page_files(t, path, 2, between=go_on)
    running[0].stop()
    return job.summary().select("pages", F.col("batches").cast("int").alias("batches"))


@query(
    "stream_batch_stats",
    f"""{_GATED} SELECT count(*) AS pages, count(*) FILTER (english) AS english, count(*) FILTER (NOT english) AS non_english, 0 AS failed, 0 AS batch FROM gated""",
)
def _(t):
    done = indexer(t, "stats").run(*page_files(t, 1))
    return done.stats().select("pages", "english", "non_english", "failed", "batch")


@query(
    "stream_progress",
    f"""{_GATED} SELECT 'done' AS status, 'website_pages' AS collection_name, count(*) AS crawled_pages, '' AS message FROM gated""",
)
def _(t):
    done = indexer(t, "progress").run(*page_files(t, 2))
    return done.progress().select("status", "collection_name", "crawled_pages", "message")


@query(
    "stream_summary",
    f"""{_GATED} SELECT count(*) AS pages, count(*) FILTER (english) AS english, count(*) FILTER (NOT english) AS non_english, 0 AS failed FROM gated""",
)
def _(t):
    done = indexer(t, "summary").run(*page_files(t))
    return done.summary().select("pages", "english", "non_english", "failed")


@query(
    "stream_use_daily",
    """SELECT user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, count(*) AS queries, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2""",
)
def _(t):
    path, out = scratch_dir(t.spark, "event-files"), scratch_dir(t.spark, "daily")
    t.events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    stream_usage.start_daily(t.spark, path, out).awaitTermination()
    rows = stream_usage.read_daily(t.spark, out)
    return rows.select("user_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "queries", "tokens")
