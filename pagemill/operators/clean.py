"""Parsed documents to cleaned documents: compose, normalize, reject, drop duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import fixed_values as fv
from pagemill.functions import text
from pagemill.functions.repair import normalize_text
from pagemill.functions.text import let, strip, strip_text, text_or_empty
from pagemill.operators.dedup import repeats
from pagemill.session import cut_lineage


def compose_text() -> Column:
    """Title, headings, content, list blocks and table blocks, blank lines between them."""
    none = F.array().cast("array<string>")
    headings = F.transform(F.col("headings"), lambda h: strip(text_or_empty(h["text"])))

    def trimmed(items: Column) -> Column:
        return F.filter(F.transform(items, lambda x: strip(text_or_empty(x))), lambda x: x != "")

    def list_block(items: Column) -> Column:
        return F.array_join(F.transform(trimmed(items), lambda x: F.concat(F.lit("- "), x)), "\n")

    def table_block(table: Column) -> Column:
        rows = F.transform(table["rows"], lambda row: F.array_join(trimmed(row), " | "))
        return F.array_join(F.filter(rows, lambda r: r != ""), "\n")

    blocks = F.concat(
        F.array(strip(text_or_empty(F.col("title")))),
        F.coalesce(headings, none),
        F.array(strip_text(text_or_empty(F.col("content")))),
        F.coalesce(F.transform(F.col("lists"), list_block), none),
        F.coalesce(F.transform(F.col("tables"), table_block), none),
    )
    return let(blocks, lambda bs: F.array_join(F.filter(bs, lambda b: b != ""), "\n\n"))


def add_clean_text(documents: DataFrame) -> DataFrame:
    """Add ``cleaned_content`` and what the cleaning changed."""
    steps = documents.withColumn("_raw", compose_text())
    steps = steps.withColumn("_normal", normalize_text(F.col("_raw")))

    def found(lines: Column, paras: Column) -> Column:
        return F.struct(
            # the text was repaired to a fixed point above; only white space can need another pass
            text.normalize_whitespace(paras["text"]).alias("cleaned_content"),
            (F.col("_normal") != F.col("_raw")).alias("encoding_fixed"),
            lines["removed"].alias("repeated_lines_removed"),
            paras["removed"].alias("duplicate_paragraphs_removed"),
        )

    done = let(
        text.drop_repeated_lines(text.strip_boilerplate_lines(F.col("_normal"))),
        lambda lines: let(text.drop_duplicate_paragraphs(lines["text"]), lambda paras: found(lines, paras)),
    )
    # a generator's columns are worked out once; plain ones would be written out wherever they are used
    return steps.select(*documents.columns, F.inline(F.array(done)))


def reject_reason(cleaned: Column) -> Column:
    return let(
        F.length(strip_text(text_or_empty(cleaned))),
        lambda n: F.when(n == 0, fv.REJECT_EMPTY_DOCUMENT).when(n < fv.MIN_CONTENT_CHARS, fv.REJECT_SHORT_DOCUMENT).otherwise(""),
    )


def document_id(position: Column) -> Column:
    return F.format_string("doc-%05d", position)


def drop_duplicates(documents: DataFrame, order: str = "pos") -> DataFrame:
    """Mark repeats of an accepted text as rejected, naming the URL that came first.

    Needs ``cleaned_content``, ``reason``, ``url`` and the unique ``order`` key.
    """
    known = "fingerprint" in documents.columns
    keyed = documents if known else documents.withColumn("fingerprint", text.fingerprint(F.col("cleaned_content")))
    later = repeats(keyed, ["fingerprint"], [order], carry=["url"], where=F.col("reason") == "")
    marked = documents.drop("fingerprint").join(later, order, "left")
    repeat = F.col("_first").isNotNull()
    return marked.withColumns(
        {
            "duplicate_of": F.when(repeat, F.col("_first.url")).otherwise(F.lit("")),
            "reason": F.when(repeat, F.lit(fv.REJECT_DUPLICATE_DOCUMENT)).otherwise(F.col("reason")),
        }
    ).drop("_first")


def clean_documents(
    parsed: DataFrame, gates: bool = True, materialize: bool = True, keep_content: bool = True
) -> DataFrame:
    """Parsed documents (with 1-based ``pos``) to accepted and rejected ones, told by ``reason``.

    ``gates`` switches the length and duplicate rejects (off on the incremental path).  The cleaned
    text is written once, before the rejects and the duplicate check read it several times; ``keep_content``
    tells whether the text as parsed is kept beside it.
    """
    cleaned = add_clean_text(parsed).select(
        "pos",
        document_id(F.col("pos")).alias("document_id"),
        "url",
        normalize_text(text_or_empty(F.col("title"))).alias("title"),
        text_or_empty(F.col("content")).alias("content"),
        "cleaned_content",
        F.lit("en").alias("language"),
        "encoding_fixed",
        "repeated_lines_removed",
        "duplicate_paragraphs_removed",
    )
    cleaned = cleaned if keep_content else cleaned.drop("content")
    reason = reject_reason(F.col("cleaned_content"))
    if not gates:
        empty = strip(F.col("cleaned_content")) == ""
        reason = F.when(empty, F.lit(fv.REJECT_EMPTY_DOCUMENT)).otherwise("")
    cleaned = cleaned.withColumns({"content_length": F.length("cleaned_content"), "reason": reason})
    if materialize:
        # the text is written with all that is told from it, so that later steps read no more than they need
        mark = text.fingerprint(F.col("cleaned_content"))
        cleaned = cut_lineage(cleaned.withColumn("fingerprint", mark) if gates else cleaned, "cleaned")
    return drop_duplicates(cleaned) if gates else cleaned.withColumn("duplicate_of", F.lit(""))


def accepted(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("reason") == "")


def rejected(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("reason") != "").select(
        "url", "title", "reason", "content_length", "duplicate_of"
    )


def clean_summary(documents: DataFrame) -> DataFrame:
    ok = F.col("reason") == ""
    return documents.agg(
        F.count("*").alias("total_documents"),
        F.count_if(ok).alias("cleaned_documents"),
        F.count_if(~ok).alias("rejected_documents"),
        F.count_if(F.col("reason") == fv.REJECT_DUPLICATE_DOCUMENT).alias("duplicates_removed"),
        F.coalesce(F.avg(F.when(ok, F.col("content_length"))), F.lit(0.0)).alias("mean_length"),
    )
