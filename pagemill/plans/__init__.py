"""Registered queries: one per operator, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pagemill.session import ship_package

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


# little data, much work per row: on one machine a caller may split these, as they sit in one file each
TEXT_TABLES = {"documents", "pages", "conversations", "embeddings"}


class Tables:
    """Attribute access to the given parquet tables of one folder.

    ``splits`` deals the text tables out anew, for benches on files of a single row group.
    """

    def __init__(self, spark: SparkSession, folder: str, splits: int | None = None) -> None:
        self.spark = ship_package(spark)
        self.folder = folder
        self.splits = splits

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        table = self.plain(name)
        return table.repartition(self.splits) if self.splits and name in TEXT_TABLES else table

    def plain(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register


def load_all() -> dict[str, Query]:
    from pagemill.plans import (  # noqa: F401
        chunk_queries,
        corpus_queries,
        retrieval_queries,
        stream_queries,
        text_queries,
        tenant_queries,
        url_queries,
        usage_queries,
        vector_queries,
    )

    return REGISTRY
