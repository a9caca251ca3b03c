"""The corpus pipeline: language ID, near-duplicates, decontamination, secrets, SentencePiece.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns
of ``documents``.  ``run`` writes each stage's rows to the shared folder and reads them again, so a lost
executor costs no more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, language_models, pieces, secret_scan, simhash
from pagemill.llm.batches import prepare, table
from pagemill.llm.queries import tokenizer_file
from pagemill.session import cut_lineage

PIECE_MODEL = "piece_bpe_32k.model"
PIECE_WORDS = 40_000_000  # bytes of words that a worker keeps: it lives on, and the other stages need the memory


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; rejected ones go."""
    prepare(spark)
    return language_models.keep_known(docs, language_models.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    prepare(spark)
    return simhash.keep_one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes.  ``n_chars`` follows the new text."""
    prepare(spark)
    clean = secret_scan.redact(docs, secret_scan.learn_formats(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids and whether decoding gives the text back."""
    prepare(spark)
    found = pieces.encode_and_decode("text", tokenizer_file(PIECE_MODEL), PIECE_WORDS)
    pieced = docs.withColumn("_pieces", found)
    columns = {"piece_ids": F.col("_pieces.ids"), "round_trip": F.col("_pieces.decoded").eqNullSafe(F.col("text"))}
    return pieced.withColumns(columns).drop("_pieces")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_free),
    ("secrets", secrets_out),
    ("sentencepiece", sentence_pieces),
]

ORACLE_SQL = None  # SQL can express neither the language models nor the piece ids


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
