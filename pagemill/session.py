"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("pagemill")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        home = Path(__file__).resolve().parent
        context.addPyFile(shutil.make_archive(f"{folder}/{home.name}", "zip", home.parent, home.name))
        _shipped.add(context.applicationId)
    return spark


_local_scratch: list[str] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder, ``spark.checkpoint.dir``.

    Where that is unset, a cluster is refused; only on one machine a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local_scratch:
            _local_scratch.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = _local_scratch[0]
    return f"{base.rstrip('/')}/pagemill/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action go when it ends; else they stay until the driver happens to collect its garbage.

    For rows that are not asked for again by the same DataFrame.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write to a new folder and read back."""
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write to shared storage and read back: survives the loss of executors."""
    return stored(df, scratch_dir(df.sparkSession, name))


def delete_paths(spark: SparkSession, pattern: str) -> None:
    """Remove the files and folders that match, wherever Spark's file systems reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in system.globStatus(path) or []:
        system.delete(found.getPath(), True)


def make_folder(spark: SparkSession, path: str) -> None:
    """Make a folder where it is missing, wherever Spark's file systems reach."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)


def move_folder(spark: SparkSession, source: str, target: str) -> bool:
    """Put a folder in the place of another; False where there is none to move."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(source), hadoop.Path(target)
    system = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(old):
        return False
    system.delete(new, True)
    system.mkdirs(new.getParent())
    if not system.rename(old, new):
        raise OSError(f"cannot move {source} to {target}")
    return True


def salt_buckets(spark: SparkSession) -> int:
    """How many ways a hot group is spread: as wide as a shuffle."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
