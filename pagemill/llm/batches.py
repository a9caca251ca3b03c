"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagemill.session import cut_lineage, ship_package

BYTES_PER_BATCH = "2m"  # texts may be long, and a worker holds a batch many times over while it works


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to the workers and keep Arrow batches of texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)
    return ship_package(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def map_columns(
    df: DataFrame, schema: str, work: Callable[[Iterator[dict[str, pa.Array]]], Iterator[dict]]
) -> DataFrame:
    """``mapInArrow`` on named columns: ``work`` takes and gives dicts of columns, once per task."""
    wanted = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(wanted)
        columns = ({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches)
        for out in work(columns):
            arrays = [
                out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type)
                for f in arrow
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, wanted)


def texts(column: pa.Array) -> list[str]:
    """Python strings, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes, null as no bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def without_rows(docs: DataFrame, listed: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of ``docs`` that ``doc_id, text_hash`` (of ``xxhash64(text)``) does not list.

    The list is written first: Spark then knows its size, broadcasts it only below its own threshold and
    shuffles otherwise.
    """
    names = {"doc_id": "_listed_id", "text_hash": "_listed_text"}
    small = cut_lineage(listed.withColumnsRenamed(names), "listed")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_listed_id"))
    return docs.join(small, same & (F.xxhash64("text") == F.col("_listed_text")), how)
