"""Tables of batches that are stored by a hash of their key, so that joins and groups by the key read them in place."""

from __future__ import annotations

import copy
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.session import delete_paths, make_folder

BUCKETS = 16


class BucketedTable:
    """Parquet files of ``path``, in ``buckets`` by the hash of ``key`` and in folders by ``batch`` and ``folders``.

    The bucket stands in the file names and the table's definition comes from the arguments, so a new session only
    has to name them again.  A batch is written with one file a bucket and folder; writing it again replaces it.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS, folders: tuple[str, ...] = ()
    ) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets, self.folders = spark, path, schema, key, buckets, folders
        self.limit: int | None = None

    @property
    def name(self) -> str:
        return f"pagemill_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"

    def table(self) -> str:
        """The table's name in the catalog of this session, with the batches that the folder has."""
        if not self.spark.catalog.tableExists(self.name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
            self.spark.sql(
                f"CREATE TABLE {self.name} ({columns}, batch BIGINT) USING parquet PARTITIONED BY ({', '.join(('batch', *self.folders))}) "
                f"CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )
            make_folder(self.spark, self.path)
            self.spark.catalog.recoverPartitions(self.name)
        return self.name

    def aligned(self, rows: DataFrame, key: str | None = None) -> DataFrame:
        """``rows`` dealt by ``key`` as the table's files are: a join with its key then moves neither side."""
        return rows.repartition(self.buckets, key or self.key)

    def write(self, rows: DataFrame, batch: int) -> None:
        """Put ``rows`` as ``batch``, in place of what an earlier try of it left."""
        own = [f for f in self.schema if f.name not in self.folders] + [self.schema[f] for f in self.folders]
        put = self.aligned(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in own)))
        put = put.sortWithinPartitions(*self.folders, self.key)
        place = ", ".join((f"batch = {batch:d}", *self.folders))
        self.spark.sql(f"ALTER TABLE {self.table()} DROP IF EXISTS PARTITION (batch = {batch:d})")
        delete_paths(self.spark, f"{self.path}/batch={batch:d}")
        # in the session of the rows, which in a stream's batch is another one of the same catalog
        put.sparkSession.sql(f"INSERT OVERWRITE TABLE {self.table()} PARTITION ({place}) SELECT * FROM {{put}}", put=put)

    def before(self, batch: int) -> BucketedTable:
        """The same table without ``batch`` and later ones."""
        earlier = copy.copy(self)
        earlier.limit = batch
        return earlier

    def read(self) -> DataFrame:
        """All rows with their ``batch``."""
        rows = self.spark.table(self.table())
        return rows if self.limit is None else rows.filter(F.col("batch") < self.limit)

    def drop(self, folder: str, value: str) -> None:
        """Remove one value of a folder from all batches."""
        delete_paths(self.spark, f"{self.path}/batch=*/{folder}={value}")
        self.spark.sql(f"ALTER TABLE {self.table()} DROP IF EXISTS PARTITION ({folder} = '{value}')")

    def clear(self) -> None:
        """Remove all rows."""
        delete_paths(self.spark, self.path)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
