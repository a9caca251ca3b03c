"""Chunks to embedding records, with a reusable cache keyed by model and content hash."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagemill import fixed_values as fv
from pagemill.functions.text import sha256, strip, text_or_empty
from pagemill.operators.dedup import mark_first
from pagemill.sources.bucketed import BucketedTable

Encoder = Callable[[list[str]], list]
VECTOR = T.ArrayType(T.FloatType())


def content_key(content: Column) -> Column:
    return sha256(strip(text_or_empty(content)))


def query_text(question: Column, model: str) -> Column:
    """Questions get a fixed instruction in front for the models that expect it."""
    return F.concat(F.lit(fv.QUERY_PREFIX if fv.QUERY_PREFIX_MODELS in model else ""), question)


def hashing_encoder(dim: int = 64, normalize: bool = True) -> Encoder:
    """Deterministic stand-in for a hosted model: signed hashed word counts."""
    @lru_cache(maxsize=200_000)
    def slot(word: str) -> tuple[int, float]:
        h = int.from_bytes(hashlib.sha256(word.encode()).digest()[:4], "big")
        return (h >> 1) % dim, 1.0 if h & 1 else -1.0

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for word in re.findall(r"[a-z0-9]+", t.lower()):
                i, sign = slot(word)
                v[i] += sign
            norm = np.sqrt((v * v).sum())
            out.append((v / norm if normalize and norm > 0 else v).astype("float32"))
        return out

    return encode


def encode_texts(
    df: DataFrame,
    text: str = "content",
    load: Callable[[], Encoder] = hashing_encoder,
    batch: int = fv.EMBED_BATCH,
    where: Column | None = None,
) -> DataFrame:
    """Add ``embedding`` and ``error``; rows outside ``where`` pass by with nulls.

    The model is loaded once per task and called on ``batch`` texts; an exception or a wrong number
    of vectors fails the texts of that call and no others.
    """
    asked = df.withColumn("_asked", F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", VECTOR), T.StructField("error", T.StringType())])
    vector_type, kept = to_arrow_type(VECTOR), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for records in batches:
            rows = [i for i, yes in enumerate(records.column("_asked").to_pylist()) if yes]
            texts = records.column(text).take(pa.array(rows, pa.int64())).to_pylist()
            vectors: list = [None] * len(records)
            errors: list = [None] * len(records)
            for at in range(0, len(rows), batch):
                part = [t or "" for t in texts[at : at + batch]]
                try:
                    found, error = list(encode(part)), None
                    if len(found) != len(part):
                        error = f"embedding count mismatch: expected {len(part)}, got {len(found)}"
                except Exception as exc:  # noqa: BLE001 - reported per row
                    found, error = [], str(exc)
                for k, i in enumerate(rows[at : at + batch]):
                    vectors[i], errors[i] = (None, error) if error else (found[k], None)
            yield pa.RecordBatch.from_arrays(
                [*(records.column(c) for c in kept), pa.array(vectors, vector_type), pa.array(errors, pa.string())],
                names=[*kept, "embedding", "error"],
            )

    return asked.mapInArrow(run, schema)


def valid_vector(vector: Column, dim: Column) -> Column:
    return F.coalesce(
        (F.size(vector) == dim) & (dim > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)),
        F.lit(False),
    )


Cache = DataFrame | BucketedTable  # stored by ``content_hash`` it is read where it lies


def _held(keyed: DataFrame, cache: Cache, key: str) -> tuple[DataFrame, DataFrame]:
    if isinstance(cache, BucketedTable):
        return cache.aligned(keyed, key), cache.read()
    return keyed, cache


def lookup_cache(keyed: DataFrame, cache: Cache, model: str, key: str = "content_hash") -> DataFrame:
    """Add ``cached`` (null on a miss) by the content hash in ``key``."""
    keyed, cache = _held(keyed, cache, key)
    held = cache.filter(F.col("model") == model).select(F.col("content_hash").alias(key), F.col("embedding").alias("cached"))
    return keyed.join(held, key, "left")


def partition_inputs(
    chunks: DataFrame, cache: Cache, model: str, dim: int, order: list[str]
) -> DataFrame:
    """Add ``content_hash``, ``cached`` and ``state``.

    ``state`` is ``failed`` (empty content, or a cached vector of the wrong shape), ``duplicate``
    (content seen earlier in ``order``), ``cached`` or ``pending``.
    """
    present = strip(text_or_empty(F.col("content"))) != ""
    keyed = chunks.withColumn("content_hash", content_key(F.col("content")))
    marked = mark_first(keyed, ["content_hash"], order, where=present)
    # only first rows are looked up: other keys match nothing and spread over all tasks
    lookup = F.when(F.col("_is_first"), F.col("content_hash")).otherwise(F.concat_ws("-", F.lit(""), *order))
    looked_up = lookup_cache(marked.withColumn("_lookup", lookup), cache, model, "_lookup")
    state = (
        F.when(~present, "failed")
        .when(~F.col("_is_first"), "duplicate")
        .when(F.col("cached").isNull(), "pending")
        .when(valid_vector(F.col("cached"), F.lit(dim)), "cached")
        .otherwise("failed")
    )
    reason = F.when(~present, "empty content").when(state == "failed", "invalid cached embedding")
    return looked_up.withColumns({"state": state, "reason": reason}).drop("_is_first", "_lookup")


def embedding_metadata() -> Column:
    """The metadata fields with their defaults."""
    m = "metadata."

    def field(name: str) -> Column:
        return text_or_empty(F.col(m + name)).alias(name)

    kind = F.coalesce(F.nullif(text_or_empty(F.col(m + "source_type")), F.lit("")), F.lit("website"))
    return F.struct(
        text_or_empty(F.col("chunk_id")).alias("chunk_id"),
        text_or_empty(F.col("document_id")).alias("document_id"),
        field("source_url"),
        field("title"),
        field("category"),
        field("heading"),
        kind.alias("source_type"),
        field("collection"),
    )


def embed_chunks(
    chunks: DataFrame,
    cache: Cache,
    model: str = "hashing-64",
    dim: int = 64,
    order: list[str] | None = None,
    load: Callable[[], Encoder] = hashing_encoder,
) -> DataFrame:
    """All chunks with ``state`` (embedded, cached, duplicate, failed), record columns and ``error``.

    Only pending rows reach the encoder; the others pass by.
    """
    order = order or ["pos", "index"]
    pending, state = F.col("state") == "pending", F.col("state")
    inputs = partition_inputs(chunks, cache, model, dim, order)
    encoded = encode_texts(inputs, "content", load, where=pending)
    ok = valid_vector(F.col("embedding"), F.lit(dim))
    rows = encoded.withColumns(
        {
            "state": F.when(~pending, state).when(F.col("error").isNull() & ok, "embedded").otherwise("failed"),
            "error": F.when(~pending, F.col("reason")).otherwise(F.coalesce("error", F.when(~ok, F.lit("invalid embedding vector")))),
            "embedding": F.when(pending, F.col("embedding")).when(state == "cached", F.col("cached")),
        }
    )
    return rows.select(
        F.coalesce(F.nullif(text_or_empty(F.col("chunk_id")), F.lit("")), "content_hash").alias("id"),
        "embedding",
        strip(text_or_empty(F.col("content"))).alias("document"),
        embedding_metadata().alias("metadata"),
        "content_hash",
        "state",
        "error",
        *order,
    )


def embedding_records(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("state").isin("embedded", "cached")).select(
        "id", "embedding", "document", "metadata"
    )


def embedding_failures(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("state") == "failed").select("id", "document", "metadata", "error")


def cache_additions(rows: DataFrame, cache: Cache, model: str) -> DataFrame:
    """Rows to append to the cache: vectors it does not hold yet, one per content hash."""
    fresh = rows.filter(F.col("state") == "embedded").select(
        F.lit(model).alias("model"),
        "content_hash",
        "embedding",
        F.struct(F.col("metadata.chunk_id").alias("chunk_id")).alias("metadata"),
    )
    fresh, cache = _held(fresh, cache, "content_hash")
    return fresh.join(cache.select("model", "content_hash"), ["model", "content_hash"], "left_anti")


def embedding_summary(rows: DataFrame) -> DataFrame:
    s = F.col("state")
    return rows.agg(
        F.count("*").alias("total_chunks"),
        F.count_if(s.isin("embedded", "cached")).alias("embedded"),
        F.count_if(s == "cached").alias("cached"),
        F.count_if(s == "failed").alias("failed"),
        F.count_if(s == "duplicate").alias("duplicates"),
    )
