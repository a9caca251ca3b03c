"""HTML pages to structured documents, links and page facts in one pass over the page table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.functions import dom
from pagemill.functions.slices import small_batches
from pagemill.functions.text import let, strip
from pagemill.functions.urls import normalize_url

S = T.StringType()
DOCUMENT_FIELDS = [
    T.StructField("title", S),
    T.StructField("meta_description", S),
    T.StructField("headings", T.ArrayType(T.StructType().add("level", "integer").add("text", S))),
    T.StructField("content", S),
    T.StructField("lists", T.ArrayType(T.ArrayType(S))),
    T.StructField("tables", T.ArrayType(T.StructType().add("rows", T.ArrayType(T.ArrayType(S))))),
]
EXTRA_FIELDS = {
    "visible_text": T.StructField("visible_text", S),
    "body_text": T.StructField("body_text", S),
    "links": T.StructField("links", T.ArrayType(S)),
    "needs_render": T.StructField("needs_render", T.BooleanType()),
}


def read_pages(
    pages: DataFrame,
    extras: list[str] | None = None,
    documents: bool = True,
    strip_boilerplate: bool = True,
) -> DataFrame:
    """Parse ``html`` of every row (``url`` gives the base for links).

    Keeps the other columns, drops ``html``, adds the document fields and the asked extras.  A page
    that cannot be parsed keeps nulls and its ``error``.
    """
    extras = extras or []
    kept = [f for f in pages.schema.fields if f.name != "html"]
    added = (DOCUMENT_FIELDS if documents else []) + [EXTRA_FIELDS[e] for e in extras]
    added = [*added, T.StructField("error", S)]
    arrow = {f.name: to_arrow_type(f.dataType) for f in added}

    def read(html: str | None, url: str | None) -> dict:
        try:
            found: dict = {"error": None}
            html = html or ""
            if "links" in extras:
                found["links"] = dom.links(dom.build(html), url or "")
            if "needs_render" in extras:
                found["needs_render"] = not html.strip() or dom.needs_render(dom.build(html))
            if documents:
                found.update(dom.document(dom.build(html), strip_boilerplate))
            if "body_text" in extras:
                root = dom.build(html)
                dom.drop_boilerplate(root)
                found["body_text"] = dom.body_of(root).text()
            if "visible_text" in extras:
                found["visible_text"] = dom.visible_text(dom.build(html))
            return found
        except Exception as exc:  # noqa: BLE001 - one bad page must not fail the job
            return {"error": f"{type(exc).__name__}: {exc}"}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, ["html"]):
            urls = batch.column("url").to_pylist() if "url" in batch.schema.names else [None] * len(batch)
            rows = [read(h, u) for h, u in zip(batch.column("html").to_pylist(), urls)]
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array([r.get(f.name) for r in rows], arrow[f.name]) for f in added]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept + added])

    return pages.mapInArrow(parse, T.StructType(kept + added))


def parse_pages(pages: DataFrame, strip_boilerplate: bool = True) -> DataFrame:
    return read_pages(pages, strip_boilerplate=strip_boilerplate)


def parse_summary(parsed: DataFrame) -> DataFrame:
    """One row: pages read, parsed, failed, with empty content, mean text length."""
    ok = F.col("error").isNull()
    return parsed.agg(
        F.count("*").alias("total_pages"),
        F.count_if(ok).alias("parsed_pages"),
        F.count_if(~ok).alias("failed_pages"),
        F.count_if(ok & (F.col("content") == "")).alias("empty_content_pages"),
        F.coalesce(F.avg(F.when(ok, F.length("content"))), F.lit(0.0)).alias("mean_text_length"),
    )


def extract_links(pages: DataFrame) -> DataFrame:
    """(page columns, pos, link): absolute normalized links in page order."""
    found = read_pages(pages, ["links"], documents=False)
    columns = [c for c in pages.columns if c != "html"]
    exploded = found.select(*columns, F.posexplode("links").alias("pos", "_link"))
    return exploded.select(*columns, "pos", normalize_url(F.col("_link")).alias("link"))


def language_probe() -> Column:
    """Every text part of a parsed document, one per line."""
    headings = F.transform("headings", lambda h: h["text"])
    cells = F.flatten(F.flatten(F.transform("tables", lambda t: t["rows"])))
    empty = F.array().cast("array<string>")
    parts = F.concat(
        F.array("title", "meta_description"),
        F.coalesce(headings, empty),
        F.array("content"),
        F.coalesce(F.flatten("lists"), empty),
        F.coalesce(cells, empty),
    )
    trimmed = F.transform(parts, lambda p: strip(F.coalesce(p, F.lit(""))))
    return let(trimmed, lambda ps: F.array_join(F.filter(ps, lambda p: p != ""), "\n"))
