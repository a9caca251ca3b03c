"""Incremental indexing: page files in, vectors out, one micro-batch at a time.

Which URLs have been read is keyed state of the stream itself, kept by RocksDB beside the checkpoint: a batch looks
up its own URLs and nothing else, however many came before.  Every output of a micro-batch lives in a folder of its
batch number and is overwritten when the batch is replayed, so a restart after any failure gives the same tables as a
run without one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagemill import fixed_values as fv
from pagemill.functions.language import declares_english, reads_english
from pagemill.functions.urls import canonicalize_url, normalize_url
from pagemill.operators import chunk, clean, embed, metadata, pages as page_ops
from pagemill.operators.vectors import VectorTable
from pagemill.session import cut_lineage, delete_paths
from pagemill.sources.bucketed import BucketedTable
from pagemill.streaming.progress import RunListener

PAGES = T.StructType().add("page_id", "long").add("url", "string").add("html", "string")
_URLS = T.StructType().add("url_key", "string").add("batch", "long")
_CACHE = (
    T.StructType()
    .add("model", "string")
    .add("content_hash", "string")
    .add("embedding", embed.VECTOR)
    .add("metadata", T.StructType().add("chunk_id", "string"))
)
_COUNTS = ["pages", "english", "non_english", "failed", "chunks", "embeddings", "cached"]
_STATS = T.StructType([*[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("batch", T.LongType())])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstReadable(StatefulProcessor):
    """Per URL: the batch's first page, unless an earlier batch could read one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._read = handle.getValueState("read", "read boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        first = min(rows, key=lambda r: r["page_id"])
        if not self._read.exists():
            if first["error"] is None and first["present"]:
                self._read.update((True,))
            yield first

    def close(self) -> None:
        """Nothing is held outside the state."""


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def _write(rows: DataFrame, path: str, batch: int) -> None:
    delete_paths(rows.sparkSession, f"{path}/batch={batch}")  # of an earlier try
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").partitionBy("batch").parquet(path)


@dataclass
class SiteIndexer:
    """Index of one collection under ``root`` (shared storage).

    ``crawled_at`` is written to every document; pass it on a restart, so that a replay changes nothing.
    ``gates`` adds the batch path's quality gates; the incremental path has none by default.
    """

    spark: SparkSession
    root: str
    collection: str
    model: str = "hashing-64"
    dim: int = 64
    gates: bool = False
    chunk_size: int = fv.DEFAULT_CHUNK_SIZE
    overlap: int = fv.DEFAULT_CHUNK_OVERLAP
    load_encoder: Callable[[], embed.Encoder] = field(default=embed.hashing_encoder)
    crawled_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat(timespec="seconds"))
    listener: RunListener | None = field(default=None, init=False)

    @property
    def home(self) -> str:
        # checkpoint and tables belong to one collection: another one starts anew
        return f"{self.root.rstrip('/')}/{self.collection}"

    def vectors(self) -> VectorTable:
        return VectorTable(self.spark, f"{self.home}/vectors")

    def stats(self) -> DataFrame:
        return _read(self.spark, f"{self.home}/stats", _STATS)

    def processed_urls(self) -> DataFrame:
        return _read(self.spark, f"{self.home}/urls", _URLS)

    def cache(self) -> BucketedTable:
        return BucketedTable(self.spark, f"{self.home}/cache", _CACHE, "content_hash")

    # --- one micro-batch -------------------------------------------------------------------

    def parsed_pages(self, pages: DataFrame) -> DataFrame:
        """Pages parsed, with their normalized URL and what the HTML declares."""
        present = F.coalesce(F.length(F.trim("html")), F.lit(0)) > 0
        declared = {"url_key": normalize_url(F.col("url")), "declared": declares_english(F.col("html")), "present": present}
        return page_ops.parse_pages(pages.withColumns(declared), strip_boilerplate=self.gates)

    def fresh_pages(self, pages: DataFrame) -> DataFrame:
        """The stream's pages, parsed, whose URL no earlier batch could read: once each in a batch, by ``page_id``."""
        parsed = self.parsed_pages(pages)
        return parsed.groupBy("url_key").transformWithState(FirstReadable(), parsed.schema, "append", "none")

    def index_batch(self, pages: DataFrame, batch: int) -> None:
        """Index given pages, each URL once, as one batch."""
        self.index_parsed(self.parsed_pages(pages), batch)

    def index_parsed(self, parsed: DataFrame, batch: int) -> None:
        failed, seen, stored = F.col("error").isNotNull(), Observation(), Observation()
        english = ~failed & (F.col("declared") | reads_english(page_ops.language_probe()))
        judged = parsed.withColumn("english", english).observe(
            seen,
            F.count(F.lit(1)).alias("pages"),
            F.count_if("english").alias("english"),
            F.count_if(~failed & ~F.col("english")).alias("non_english"),
            F.count_if(failed).alias("failed"),
        )
        judged = cut_lineage(judged, "judged")
        pages = judged.filter("english").withColumn("pos", F.col("page_id"))
        cleaned = clean.clean_documents(pages, gates=self.gates)
        kept = clean.accepted(cleaned).withColumn("url", canonicalize_url(F.col("url")))
        documents = metadata.add_metadata(
            kept, F.lit(self.collection), F.lit(self.crawled_at)
        )
        chunks = chunk.chunk_documents(documents, self.chunk_size, self.overlap, gates=self.gates)
        # written once: what comes next reads the chunks four times
        chunks = cut_lineage(chunks.filter(F.col("reason") == ""), "chunks")
        cache = self.cache().before(batch)
        embedded = embed.embed_chunks(chunks, cache, self.model, self.dim, load=self.load_encoder).observe(
            stored,
            F.count(F.lit(1)).alias("chunks"),
            F.count_if(F.col("state").isin("embedded", "cached")).alias("embeddings"),
            F.count_if(F.col("state") == "cached").alias("cached"),
        )
        rows = cut_lineage(embedded, "embedded")
        self.vectors().write(embed.embedding_records(rows), batch)
        cache.write(cut_lineage(embed.cache_additions(rows, cache, self.model), "cache-additions"), batch)
        counts = {**seen.get, **stored.get}  # counted while the rows above were written
        row = self.spark.createDataFrame([tuple(counts[c] for c in _COUNTS)], T.StructType(_STATS.fields[:-1]))
        _write(row, f"{self.home}/stats", batch)
        # pages without HTML or that failed are tried again when they come again
        done = judged.filter("error is null and present").select("url_key")
        _write(done, f"{self.home}/urls", batch)

    # --- the stream ------------------------------------------------------------------------

    def start(
        self, path: str, files_per_batch: int = 100, pause: str | None = None
    ) -> StreamingQuery:
        """Stream page files; ``pause`` (such as ``5 seconds``) keeps running, None drains and stops."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        if self.listener is None:
            self.listener = RunListener(f"index-{self.collection}-{uuid.uuid4().hex}")
            self.spark.streams.addListener(self.listener)
        pages = self.spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        writer = self.fresh_pages(pages).writeStream.queryName(self.listener.name).outputMode("append")
        writer = writer.foreachBatch(self.index_parsed).option("checkpointLocation", f"{self.home}/checkpoint")
        writer = writer.trigger(processingTime=pause) if pause else writer.trigger(availableNow=True)
        return writer.start()

    def run(self, path: str, files_per_batch: int = 100, force: bool = False) -> "SiteIndexer":
        """Index everything that is new; ``force`` removes tables and checkpoint and starts over."""
        if force:
            self.cache().clear()
            self.vectors().stored.clear()
            delete_paths(self.spark, self.home)
        query = self.start(path, files_per_batch)
        try:
            query.awaitTermination()
        finally:
            self.listener.ended()
        return self

    # --- reports ---------------------------------------------------------------------------

    def progress(self, total_batches: int | None = None) -> DataFrame:
        """One status row: counts so far, and whether the run goes on, is done or failed.

        What runs or ran here is told by its listener; a run of another session by what it has stored.
        """
        state = self.listener.state if self.listener else None
        done = self.stats().agg(
            (F.coalesce(F.max("batch"), F.lit(-1)) + 1).alias("current_batch"),
            F.coalesce(F.sum("embeddings"), F.lit(0)).alias("stored_chunks"),
            F.coalesce(F.sum("pages") - F.sum("failed"), F.lit(0)).alias("crawled_pages"),
        )
        total = F.lit(total_batches) if total_batches is not None else F.col("current_batch")
        status = F.when(F.col("current_batch") >= total, "done").otherwise("indexing")
        return done.select(
            (F.lit(state.status) if state else status).alias("status"),
            F.lit(self.collection).alias("collection_name"),
            "current_batch",
            total.cast("long").alias("total_batches"),
            "stored_chunks",
            "crawled_pages",
            F.lit(state.message if state else "").alias("message"),
        )

    def summary(self) -> DataFrame:
        return self.stats().agg(
            F.count("*").alias("batches"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS]
        )
