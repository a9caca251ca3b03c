"""Stage datasets: JSON and parquet in, accepted and rejected rows out."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import text_or_empty
from pagemill.session import delete_paths, move_folder, salt_buckets


def read_stage_json(
    spark: SparkSession, path: str, schema: T.StructType, lines: bool = False
) -> DataFrame:
    """JSON arrays, or with ``lines`` one object per line; malformed input fails the job."""
    reader = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST")
    return reader.json(path)


def read_lenient_table(
    spark: SparkSession, path: str, schema: T.StructType, lines: bool = False
) -> DataFrame:
    """A table that is empty when its file is missing and skips records it cannot read.

    ``lines`` reads one record per line, which splits large files over tasks.
    """
    marked = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    reader = (
        spark.read.schema(marked)
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
    )
    try:
        rows = reader.json(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)
    return rows.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def raw_pages(results: DataFrame, files: DataFrame) -> DataFrame:
    """HTML of successful crawl results; a missing file leaves ``html`` null and an ``error``.

    ``results(url, status, saved_file)``, ``files(saved_file, html)``; names of files do not repeat.
    """
    wanted = results.filter(
        (F.col("status") == "success") & (text_or_empty(F.col("saved_file")) != "")
    )
    joined = wanted.join(files, "saved_file", "left")
    return joined.withColumn("error", F.when(F.col("html").isNull(), F.lit("missing raw HTML file")))


def write_stage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_split(df: DataFrame, reason: str, accepted_path: str, rejected_path: str) -> None:
    """Accepted and rejected rows of one stage, told apart by ``reason``.

    The stage runs once: one write deals the rows into a folder a side, beside the accepted path, and the folders take
    their places when all tasks are done.  A failed stage shows nothing new, and what was there before stays.  Both
    sides have the stage's columns; ``reason`` is null in accepted rows.
    """
    spark, staged = df.sparkSession, f"{accepted_path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    is_accepted = text_or_empty(F.col(reason)) == ""
    sides = {"_side": F.when(is_accepted, "accepted").otherwise("rejected"), reason: F.when(~is_accepted, F.col(reason))}
    try:
        df.withColumns(sides).write.partitionBy("_side").parquet(staged)
        for name, path in (("accepted", accepted_path), ("rejected", rejected_path)):
            if not move_folder(spark, f"{staged}/_side={name}", path):  # no row of this side
                df.limit(0).write.mode("overwrite").parquet(path)
    finally:
        delete_paths(spark, staged)


def write_by_key(df: DataFrame, key: Column, path: str, buckets: int = 256) -> None:
    """Rows filed under the sha256 of their key; ``bucket`` folders replace one file per row.

    A bucket is written by as many tasks as a shuffle has, told apart by further digits of the digest.
    """
    filed = df.withColumn("file_stem", F.sha2(key, 256))
    bucket = F.conv(F.substring("file_stem", 1, 8), 16, 10).cast("long") % buckets
    salt = F.conv(F.substring("file_stem", 9, 8), 16, 10).cast("long") % salt_buckets(df.sparkSession)
    spread = filed.withColumn("bucket", bucket).repartition(F.col("bucket"), salt)
    spread.write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_sets(sets: dict[str, DataFrame], path: str) -> None:
    """Named row sets of one run, each in its own folder."""
    for name, rows in sets.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
