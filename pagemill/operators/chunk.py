"""Metadata documents to chunks.

Everything that belongs to one document stays in that document's row as arrays, so the stage has no
shuffle before the cross-document duplicate check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import fixed_values as fv
from pagemill.functions import text
from pagemill.functions.repair import fix_encoding
from pagemill.functions.split import split_texts
from pagemill.functions.text import WS, estimate_tokens, let, lines, strip, text_or_empty
from pagemill.operators.dedup import repeats
from pagemill.session import cut_lineage

_SECTION = "array<struct<heading:string,content:string>>"


def chunk_settings(
    category: Column, size: int = fv.DEFAULT_CHUNK_SIZE, overlap: int = fv.DEFAULT_CHUNK_OVERLAP
) -> Column:
    """struct(size, overlap) in tokens."""
    kind = F.lower(text_or_empty(category))

    def pair(a: int, cap: int) -> Column:
        return F.struct(F.lit(a).alias("size"), F.lit(min(overlap, cap)).alias("overlap"))

    return (
        F.when(kind == "blog", pair(900, 180))
        .when(kind.isin("faq", "faqs"), pair(450, 100))
        .when(kind == "services", pair(650, 140))
        .otherwise(pair(max(size, 700), 160))
    )


def is_heading(paragraph: Column) -> Column:
    return (
        ~F.contains(paragraph, F.lit("\n"))
        & ~paragraph.startswith("- ")
        & (F.size(F.split(paragraph, WS + "+")) <= 10)
        & (F.length(paragraph) <= 90)
    )


def sections(paragraphs: Column, fallback: Column) -> Column:
    """Paragraph array to section array: a heading starts a section and stays in its content."""
    def build(ps: Column) -> Column:
        starts = F.filter(
            F.transform(ps, lambda p, i: F.when((i == 0) | is_heading(p), i)),
            lambda i: i.isNotNull(),
        )

        def cut(ss: Column) -> Column:
            def section(s: Column, k: Column) -> Column:
                first = F.get(ps, s)
                end = F.coalesce(F.get(ss, k + 1), F.size(ps))
                initial = F.coalesce(F.nullif(fallback, F.lit("")), F.substring(first, 1, 160))
                heading = F.when(is_heading(first), F.substring(first, 1, 240)).otherwise(initial)
                return F.struct(
                    heading.alias("heading"),
                    F.array_join(F.slice(ps, s + 1, end - s), "\n\n").alias("content"),
                )

            return F.transform(ss, section)

        return let(starts, cut)

    return let(paragraphs, build)


def merge_small(
    section_array: Column, count: Callable[[Column], Column] = estimate_tokens
) -> Column:
    """Hold sections under the minimum and merge them into the next big one.

    The first non-empty heading of a merged run names it; small sections at the end form one.
    """
    def build(ss: Column) -> Column:
        last = F.size(ss) - 1
        ends = F.filter(
            F.transform(
                ss,
                lambda s, i: F.when(
                    (count(s["content"]) >= fv.MIN_CHUNK_TOKENS) | (i == last), i
                ),
            ),
            lambda i: i.isNotNull(),
        )

        def join(es: Column) -> Column:
            def run(e: Column, k: Column) -> Column:
                start = F.coalesce(F.get(es, k - 1) + 1, F.lit(0))
                members = F.slice(ss, start + 1, e - start + 1)
                named = F.filter(members["heading"], lambda h: h != "")
                return F.struct(
                    F.coalesce(F.get(named, F.lit(0)), F.lit("")).alias("heading"),
                    strip(F.array_join(members["content"], "\n\n")).alias("content"),
                )

            return F.transform(es, run)

        return let(ends, join)

    return let(section_array, build)


def is_person_name(paragraph: Column) -> Column:
    return paragraph.rlike(rf"\A[A-Z][a-z]+(?:(?!\n){WS}+[A-Z][a-z]+){{1,3}}\z") & ~F.contains(
        paragraph, F.lit("\n")
    )


def is_role(paragraph: Column) -> Column:
    return (
        ~F.contains(paragraph, F.lit("\n"))
        & (F.length(paragraph) <= 90)
        & paragraph.rlike("|".join(fv.ROLE_TERMS))
    )


def _person_at(ps: Column, p: Column, i: Column) -> Column:
    parts = F.filter(F.slice(ps, i + 1, 3), lambda x: x != "")
    found = is_person_name(p) & F.coalesce(is_role(F.get(ps, i + 1)), F.lit(False))
    return F.when(
        found, F.struct(p.alias("heading"), F.array_join(parts, "\n\n").alias("content"))
    )


def person_facts(paragraphs: Column) -> Column:
    """A name followed by a role: name, role and the next paragraph make a section."""
    return let(
        paragraphs,
        lambda ps: F.filter(
            F.transform(ps, lambda p, i: _person_at(ps, p, i)), lambda f: f.isNotNull()
        ),
    )


def _bullets(paragraph: Column) -> Column:
    items = F.filter(
        F.transform(lines(paragraph), strip),
        lambda x: x.startswith("- ") & (F.length(x) >= fv.MIN_BULLET_CHARS),
    )
    found = F.transform(
        items,
        lambda x: F.struct(
            F.substring(F.substring_index(F.substring(x, 3, 2**30), "  ", 1), 1, 120).alias("heading"),
            x.alias("content"),
        ),
    )
    return F.when(paragraph.startswith("- "), found).otherwise(F.array().cast(_SECTION))


def bullet_facts(paragraphs: Column) -> Column:
    """Every long bullet line of a bullet paragraph is a section of its own."""
    return F.flatten(F.transform(paragraphs, _bullets))


def facts(paragraphs: Column) -> Column:
    """Person and bullet facts in paragraph order."""
    def build(ps: Column) -> Column:
        def of(p: Column, i: Column) -> Column:
            person = F.filter(F.array(_person_at(ps, p, i)), lambda f: f.isNotNull())
            return F.concat(person, _bullets(p))

        return F.flatten(F.transform(ps, of))

    return let(paragraphs, build)


def with_context(title: Column, source_url: Column, heading: Column, content: Column) -> Column:
    """Context header lines in front of a chunk's content."""
    parts = F.array(
        strip(F.concat(F.lit("Page title: "), title)),
        strip(F.concat(F.lit("Source URL: "), source_url)),
        strip(F.concat(F.lit("Section: "), heading)),
        strip(content),
    )
    return strip(F.array_join(F.filter(parts, lambda p: p != ""), "\n"))


def stable_chunk_id(document_id: Column, index: Column, content: Column) -> Column:
    seed = F.concat(
        document_id, F.lit("|"), index.cast("string"), F.lit("|"), text.collapse_ws(text_or_empty(content))
    )
    return text.sha256(seed)


def reject_reason(content: Column, tokens: Column) -> Column:
    return (
        F.when(strip(text_or_empty(content)) == "", fv.REJECT_EMPTY_CHUNK)
        .when(tokens < fv.MIN_CHUNK_TOKENS, fv.REJECT_SMALL_CHUNK)
        .otherwise("")
    )


def dedup_in_document(fact_array: Column, section_chunks: Column) -> Column:
    """Facts, then the section chunks whose fingerprint is new; facts may repeat one another."""
    def tag(c: Column, fact: bool) -> Column:
        return F.struct(
            c["heading"].alias("heading"), c["content"].alias("content"), F.lit(fact).alias("fact")
        )

    tagged = F.concat(
        F.transform(fact_array, lambda c: tag(c, True)),
        F.transform(section_chunks, lambda c: tag(c, False)),
    )

    def merge(cs: Column) -> Column:
        fresh = text.keep_first(cs, lambda c: text.fingerprint(c["content"]))
        return F.concat(F.filter(cs, lambda c: c["fact"]), F.filter(fresh, lambda c: ~c["fact"]))

    return let(tagged, merge)


def repair_documents(documents: DataFrame) -> DataFrame:
    """Encoding repair for documents that did not come from the cleaning stage, which repairs them."""
    fixed = documents.withColumns(
        {c: fix_encoding(F.col(c)) for c in ("content", "title", "section_heading")}
    )
    return cut_lineage(fixed.select(documents.columns), "repaired")


def split_documents(
    documents: DataFrame,
    size: int = fv.DEFAULT_CHUNK_SIZE,
    overlap: int = fv.DEFAULT_CHUNK_OVERLAP,
    count_tokens: Callable[[Column], Column] = estimate_tokens,
    load_tokenizer: Callable[[], object] | None = None,
) -> DataFrame:
    """One row per chunk of every document, before rejection, with its 1-based ``index``."""
    fallback = F.coalesce(F.nullif("section_heading", F.lit("")), text_or_empty(F.col("title")))
    step = documents.withColumns(
        {
            "_text": text_or_empty(F.col("content")),
            "_fallback": fallback,
            "_title": F.coalesce(F.nullif(text_or_empty(F.col("title")), F.lit("")), fallback),
            "_settings": chunk_settings(F.col("category"), size, overlap),
        }
    )

    def contextual(items: Column) -> Column:
        return F.transform(
            items,
            lambda s: F.struct(
                s["heading"].alias("heading"),
                with_context(F.col("_title"), F.col("source_url"), s["heading"], s["content"]).alias("content"),
            ),
        )

    def found(ps: Column) -> Column:
        merged = contextual(merge_small(sections(ps, F.col("_fallback"))))
        return let(
            merged,
            lambda ss: F.struct(
                contextual(facts(ps)).alias("_facts"), ss["heading"].alias("_headings"), ss["content"].alias("_texts")
            ),
        )

    columns = [c for c in documents.columns if c != "content"]
    prepared = step.select(
        *columns,
        # a generator's columns are worked out once; plain ones would be written out wherever they are used
        F.inline(F.array(let(text.paragraphs(F.col("_text")), found))),
        F.col("_settings.size").alias("chunk_size"),
        F.col("_settings.overlap").alias("_overlap"),
    )
    pieces = split_texts(prepared, "_texts", "chunk_size", "_overlap", "_pieces", load_tokenizer)
    headed = F.flatten(
        F.transform(
            F.arrays_zip(F.col("_headings").alias("heading"), F.col("_pieces").alias("pieces")),
            lambda z: F.transform(
                z["pieces"], lambda c: F.struct(z["heading"].alias("heading"), c.alias("content"))
            ),
        )
    )
    chunks = dedup_in_document(F.col("_facts"), headed)
    exploded = pieces.select(*columns, "chunk_size", F.posexplode(chunks).alias("_i", "_c"))
    rows = exploded.select(
        *columns,
        "chunk_size",
        (F.col("_i") + 1).alias("index"),
        F.col("_c.heading").alias("heading"),
        F.col("_c.content").alias("content"),
    )
    return rows.withColumn("token_count", count_tokens(F.col("content")))


def chunk_documents(
    documents: DataFrame,
    size: int = fv.DEFAULT_CHUNK_SIZE,
    overlap: int = fv.DEFAULT_CHUNK_OVERLAP,
    gates: bool = True,
    materialize: bool = True,
    **options,
) -> DataFrame:
    """Chunks with ``reason`` (empty when accepted), in the shape of the chunk dataset.

    ``gates`` switches the small-chunk and cross-document duplicate rejects.
    """
    rows = split_documents(documents, size, overlap, **options)
    chunks = rows.select(
        stable_chunk_id(F.col("document_id"), F.col("index"), F.col("content")).alias("chunk_id"),
        "document_id",
        "content",
        "token_count",
        F.struct(
            "source_url", "title", "category", "heading", "source_type", "collection"
        ).alias("metadata"),
        "pos",
        "index",
        (F.col("token_count") > F.col("chunk_size")).alias("overflow"),
        reject_reason(F.col("content"), F.col("token_count")).alias("reason"),
    )
    if not gates:
        return chunks.withColumn("reason", F.lit(""))
    chunks = chunks.withColumn("fingerprint", text.fingerprint(F.col("content")))
    if materialize:
        chunks = cut_lineage(chunks, "chunks")
    return drop_duplicate_chunks(chunks)


def drop_duplicate_chunks(chunks: DataFrame, order: list[str] | None = None) -> DataFrame:
    """First chunk of every fingerprint stays; later ones are rejected."""
    order = order or ["pos", "index"]
    known = "fingerprint" in chunks.columns
    keyed = chunks if known else chunks.withColumn("fingerprint", text.fingerprint(F.col("content")))
    later = repeats(keyed, ["fingerprint"], order, where=F.col("reason") == "")
    marked = chunks.drop("fingerprint").join(later, order, "left")
    reason = F.when(F.col("_first").isNotNull(), fv.REJECT_DUPLICATE_CHUNK).otherwise(F.col("reason"))
    return marked.withColumn("reason", reason).drop("_first")


def chunk_summary(chunks: DataFrame) -> DataFrame:
    ok = F.col("reason") == ""
    return chunks.agg(
        F.count_if(ok).alias("total_chunks"),
        F.count_if(~ok).alias("rejected_chunks"),
        F.coalesce(F.avg(F.when(ok, F.length("content"))), F.lit(0.0)).alias("mean_chars"),
        F.coalesce(F.avg(F.when(ok, F.col("token_count"))), F.lit(0.0)).alias("mean_tokens"),
    )
