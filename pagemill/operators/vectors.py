"""The vector table: validation, insert, upsert, and a parquet layout that replays safely."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import fixed_values as fv
from pagemill.functions.text import strip, text_or_empty
from pagemill.operators.dedup import mark_first
from pagemill.operators.embed import VECTOR
from pagemill.session import scratch_dir
from pagemill.sources.bucketed import BUCKETS, BucketedTable

METADATA = T.StructType([T.StructField(f, T.StringType()) for f in fv.METADATA_FIELDS])
TABLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("embedding", VECTOR),
        T.StructField("document", T.StringType()),
        T.StructField("metadata", METADATA),
        T.StructField("collection", T.StringType()),
        T.StructField("batch", T.LongType()),
    ]
)


def record_problem() -> Column:
    """The first rule a record breaks, or an empty string."""
    v, m = F.col("embedding"), F.col("metadata")
    missing = F.filter(
        F.array(*[F.when(m[f].isNull(), F.lit(f)) for f in fv.METADATA_FIELDS]),
        lambda x: x.isNotNull(),
    )
    return (
        F.when(text_or_empty(F.col("id")) == "", "missing id")
        .when(strip(text_or_empty(F.col("document"))) == "", "empty document")
        .when(v.isNull() | (F.size(v) == 0), "missing embedding")
        .when(F.exists(v, lambda x: x.isNull()), "embedding contains non-numeric values")
        .when(m.isNull(), "missing metadata")
        .when(F.size(missing) > 0, F.concat(F.lit("missing metadata fields: "), F.array_join(missing, ", ")))
        .otherwise("")
    )


def coerce_metadata() -> Column:
    return F.struct(*[text_or_empty(F.col(f"metadata.{f}")).alias(f) for f in fv.METADATA_FIELDS])


def existing_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(table.select("id"), "id", "left_semi")


def plan_insert(records: DataFrame, table: DataFrame, order: list[str]) -> DataFrame:
    """Records with ``outcome``: insert, duplicate (stored already or seen earlier), or failure."""
    judged = records.withColumn("problem", record_problem())
    marked = mark_first(judged, ["id"], order, where=F.col("problem") == "")
    stored = table.select("id").distinct().withColumn("_stored", F.lit(True))
    joined = marked.join(stored, "id", "left")
    outcome = (
        F.when(F.col("problem") != "", "failure")
        .when(F.col("_stored").isNotNull() | ~F.col("_is_first"), "duplicate")
        .otherwise("insert")
    )
    return joined.withColumn("outcome", outcome).drop("_is_first", "_stored")


def rows_to_insert(planned: DataFrame) -> DataFrame:
    return planned.filter(F.col("outcome") == "insert").select(
        "id", "embedding", strip(F.col("document")).alias("document"), coerce_metadata().alias("metadata")
    )


def insert_summary(planned: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return planned.agg(
        F.count_if(o == "insert").alias("vectors_inserted"),
        F.count_if(o == "duplicate").alias("duplicates_skipped"),
        F.count_if(o == "failure").alias("insert_failures"),
    )


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of ``existing`` with the same id."""
    return existing.join(new.select("id"), "id", "left_anti").unionByName(new)


def collection_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("collection").agg(F.count("*").alias("vectors"))


def resolve_collection(requests: DataFrame, counts: DataFrame, legacy: str = fv.LEGACY_COLLECTION) -> DataFrame:
    """The asked collection, else the legacy default when it holds rows, else null (rejected)."""
    default = counts.filter((F.col("collection") == legacy) & (F.col("vectors") > 0))
    holds = F.coalesce(default.agg(F.count("*")).scalar(), F.lit(0)) > 0
    asked = strip(text_or_empty(F.col("collection")))
    resolved = F.when(asked != "", asked).when(holds, F.lit(legacy))
    return requests.withColumn("resolved", resolved)


class VectorTable:
    """Vectors in parquet, bucketed by the hash of their id, in folders by batch and collection.

    Writing a batch replaces what an earlier try of it left, so replaying a batch changes nothing; reading takes
    the newest batch of every id, within a batch the last document.  Files are stored by id, so neither reading nor
    an upsert moves what is stored.  ``compact`` folds batches into one, bucket by bucket.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.path = path
        self.stored = BucketedTable(spark, path, T.StructType(TABLE.fields[:-1]), "id", buckets, ("collection",))

    def write(self, records: DataFrame, batch: int) -> None:
        rows = records.select("id", "embedding", "document", "metadata", F.col("metadata.collection").alias("collection"))
        self.stored.write(rows, batch)

    def read(self, collection: str | None = None) -> DataFrame:
        rows = self.stored.read()
        if collection is not None:
            rows = rows.filter(F.col("collection") == collection)
        newest = rows.groupBy("collection", "id").agg(
            F.max_by(F.struct("embedding", "document", "metadata"), F.struct("batch", "document")).alias("r")
        )
        return newest.select("id", "r.embedding", "r.document", "r.metadata", "collection")

    def counts(self) -> DataFrame:
        """Vectors per collection; only ids and partition values are read."""
        ids = self.stored.read().groupBy("collection", "id").agg(F.count("*").alias("n"))
        return ids.groupBy("collection").agg(F.count("*").alias("vectors"))

    def collections(self) -> DataFrame:
        """Names of the collections, from the folders alone."""
        return self.stored.read().select("collection").distinct()

    def drop(self, collection: str) -> "VectorTable":
        """Remove one collection's folders; the same name can be filled anew."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", collection):
            raise ValueError(f"no name of a collection: {collection!r}")
        self.stored.drop("collection", collection)
        return self

    def compact(self) -> "VectorTable":
        folded = VectorTable(self.spark, scratch_dir(self.spark, "vectors"), self.stored.buckets)
        folded.stored.write(self.read(), 0)
        return folded
