"""Chunking rules over the document table, and the whole stage from documents to chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text
from pagemill.functions.split import split_texts
from pagemill.operators import chunk
from pagemill.plans import query, sql
from pagemill.plans.corpus_queries import enriched


def spaced(t):
    """Documents with every line as a paragraph."""
    wide = F.replace(F.col("text"), F.lit("\n"), F.lit("\n \n"))
    return t.documents.select("doc_id", "source", "lang", text.paragraphs(wide).alias("ps"))


_PS = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {sql.strip('l')}), lambda p: p <> '')"
PARAS = f"""ps AS (SELECT doc_id, source, lang, {_PS} AS ps FROM documents),
    paras AS (SELECT doc_id, source, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM ps)"""
_HEAD = r"(NOT contains(p, chr(10)) AND NOT starts_with(p, '- ') AND len(string_split_regex(p, '[\s\v]+')) <= 10 AND length(p) <= 90)"
SECTIONS = f"""{PARAS}, marked AS (SELECT *, {_HEAD} AS h FROM paras),
    numbered AS (SELECT *, sum(CASE WHEN h OR i = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS s FROM marked),
    sections AS (SELECT doc_id, CAST(s AS INT) AS s, CASE WHEN arg_min(h, i) THEN left(arg_min(p, i), 240) ELSE any_value(source) END AS heading,
      string_agg(p, chr(10) || chr(10) ORDER BY i) AS content FROM numbered GROUP BY doc_id, s)"""
MERGED = f"""{SECTIONS}, sized AS (SELECT *, CASE WHEN {sql.tok_estimate('content')} >= 12 THEN 1 ELSE 0 END AS big FROM sections),
    grouped AS (SELECT *, coalesce(sum(big) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM sized),
    merged AS (SELECT doc_id, CAST(g AS INT) AS s, arg_min(heading, s) FILTER (heading <> '') AS heading, string_agg(content, chr(10) || chr(10) ORDER BY s) AS content FROM grouped GROUP BY doc_id, g)"""


@query(
    "chunk_settings",
    """SELECT o_orderkey, CASE c WHEN 'blog' THEN 900 WHEN 'faqs' THEN 450 WHEN 'services' THEN 650 ELSE 700 END AS size,
      CASE c WHEN 'blog' THEN 180 WHEN 'faqs' THEN 100 WHEN 'services' THEN 140 ELSE 160 END AS overlap FROM (
      SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'blog' WHEN '2-HIGH' THEN 'faqs' WHEN '3-MEDIUM' THEN 'services' ELSE 'x' END AS c FROM orders)""",
)
def _(t):
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "Blog").when(p == "2-HIGH", "faqs").when(p == "3-MEDIUM", "SERVICES")
    return t.orders.select("o_orderkey", chunk.chunk_settings(kind, 500, 200).alias("s")).select("o_orderkey", "s.*")


@query("chunk_paragraphs", f"WITH {PARAS} SELECT doc_id, CAST(i AS INT) AS pos, p AS paragraph FROM paras")
def _(t):
    return spaced(t).select("doc_id", F.posexplode("ps").alias("pos", "paragraph"))


@query("chunk_is_heading", f"WITH {PARAS} SELECT doc_id, CAST(i AS INT) AS pos, {_HEAD} AS heading FROM paras")
def _(t):
    rows = spaced(t).select("doc_id", F.posexplode("ps").alias("pos", "p"))
    return rows.select("doc_id", "pos", chunk.is_heading(F.col("p")).alias("heading"))


@query("chunk_sections", f"WITH {SECTIONS} SELECT doc_id, s AS pos, heading, content FROM sections")
def _(t):
    found = spaced(t).select("doc_id", F.posexplode(chunk.sections(F.col("ps"), F.col("source"))).alias("pos", "x"))
    return found.select("doc_id", "pos", "x.heading", "x.content")


@query("chunk_merge_small", f"WITH {MERGED} SELECT doc_id, s AS pos, heading, content FROM merged")
def _(t):
    merged = chunk.merge_small(chunk.sections(F.col("ps"), F.col("source")))
    found = spaced(t).select("doc_id", F.posexplode(merged).alias("pos", "x"))
    return found.select("doc_id", "pos", "x.heading", "x.content")


@query(
    "chunk_facts_person",
    """SELECT p_partkey, n AS heading, n || chr(10) || chr(10) || 'Lead of ' || p_type || chr(10) || chr(10) || p_brand AS content FROM (
      SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS n FROM part) WHERE p_type = 'ECONOMY'""",
)
def _(t):
    role = F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("Lead of "), F.col("p_type"))).otherwise(F.col("p_type"))
    ps = F.array(F.initcap("p_name"), role, F.col("p_brand"))
    return t.part.select("p_partkey", F.inline(chunk.person_facts(ps)))


@query(
    "chunk_facts_bullets",
    """SELECT o_orderkey, o_orderpriority AS heading, '- ' || o_orderpriority || '  customer ' || o_custkey AS content FROM orders
    WHERE length('- ' || o_orderpriority || '  customer ' || o_custkey) >= 25""",
)
def _(t):
    line = F.concat(F.lit("- "), F.col("o_orderpriority"), F.lit("  customer "), F.col("o_custkey"))
    ps = F.array(F.lit("Intro"), F.concat(line, F.lit("\n- short one\nplain line that is long enough to count")))
    return t.orders.select("o_orderkey", F.inline(chunk.bullet_facts(ps)))


@query(
    "chunk_context_header",
    f"SELECT doc_id, 'Page title: ' || source || chr(10) || 'Source URL: ' || chr(10) || 'Section: ' || lang || chr(10) || {sql.strip('text')} AS content FROM documents".replace("'Source URL: ' ||", "'Source URL:' ||"),
)
def _(t):
    made = chunk.with_context(F.col("source"), F.lit(""), F.col("lang"), F.col("text"))
    return t.documents.select("doc_id", made.alias("content"))


@query("chunk_recursive_split")
def _(t):
    texts = t.documents.select("doc_id", F.array("text").alias("texts"), F.lit(100).alias("n"), F.lit(20).alias("m"))
    rows = split_texts(texts, "texts", "n", "m")
    return rows.select("doc_id", F.posexplode(F.flatten("pieces")).alias("pos", "piece"))


@query("chunk_token_count", f"SELECT conv_id, turn, {sql.tok_estimate('text')} AS tokens FROM conversations")
def _(t):
    from pagemill.functions.tokens import token_count

    return t.conversations.select("conv_id", "turn", token_count(F.col("text")).alias("tokens"))


_FP = sql.fingerprint("p")


@query(
    "chunk_dedup_in_doc",
    f"""WITH {PARAS}, f AS (SELECT doc_id, i, p, {_FP} AS fp, true AS fact FROM paras WHERE i < 2 UNION ALL SELECT doc_id, i + 2, p, {_FP}, false FROM paras),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, fp ORDER BY fact DESC, i) AS rn FROM f)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY fact DESC, i) - 1 AS INT) AS pos, p AS content, fact FROM r WHERE fact OR rn = 1""",
)
def _(t):
    """The first two lines of a document are its facts, all lines its section chunks."""
    def as_chunks(ps):
        return F.transform(ps, lambda p: F.struct(F.lit("").alias("heading"), p.alias("content")))

    kept = chunk.dedup_in_document(as_chunks(F.slice("ps", 1, 2)), as_chunks(F.col("ps")))
    rows = spaced(t).select("doc_id", F.posexplode(kept).alias("pos", "c"))
    return rows.select("doc_id", "pos", "c.content", "c.fact")


@query(
    "chunk_reject_reason",
    f"""SELECT doc_id, i AS pos, CASE WHEN {sql.tok_estimate('p')} < 12 THEN 'extremely small chunk' ELSE '' END AS reason FROM (
      WITH {PARAS} SELECT doc_id, CAST(i AS INT) AS i, p FROM paras)""",
)
def _(t):
    rows = spaced(t).select("doc_id", F.posexplode("ps").alias("pos", "p"))
    return rows.select("doc_id", "pos", chunk.reject_reason(F.col("p"), text.estimate_tokens(F.col("p"))).alias("reason"))


def line_chunks(t):
    rows = spaced(t).select(F.col("doc_id").alias("pos"), F.posexplode("ps").alias("index", "content"))
    reason = chunk.reject_reason(F.col("content"), text.estimate_tokens(F.col("content")))
    return rows.withColumn("reason", reason)


@query(
    "chunk_dedup_cross_doc",
    f"""WITH {PARAS}, c AS (SELECT doc_id, i, {_FP} AS fp, CASE WHEN {sql.tok_estimate('p')} < 12 THEN 'extremely small chunk' ELSE '' END AS r FROM paras)
    SELECT doc_id AS pos, CAST(i AS INT) AS index, CASE WHEN r = '' AND row_number() OVER (PARTITION BY fp, r = '' ORDER BY doc_id, i) > 1 THEN 'duplicate chunk' ELSE r END AS reason FROM c""",
)
def _(t):
    return chunk.drop_duplicate_chunks(line_chunks(t)).select("pos", "index", "reason")


@query(
    "chunk_stable_id",
    f"WITH {PARAS} SELECT doc_id, CAST(i AS INT) AS pos, sha256(doc_id || '|' || (i + 1) || '|' || {sql.collapse('p')}) AS chunk_id FROM paras",
)
def _(t):
    rows = spaced(t).select("doc_id", F.posexplode("ps").alias("pos", "p"))
    key = chunk.stable_chunk_id(F.col("doc_id").cast("string"), F.col("pos") + 1, F.col("p"))
    return rows.select("doc_id", "pos", key.alias("chunk_id"))


@query("chunk_overflow_flag", f"SELECT doc_id, {sql.tok_estimate('text')} > CASE lang WHEN 'de' THEN 900 WHEN 'fr' THEN 450 ELSE 700 END AS overflow FROM documents")
def _(t):
    kind = F.when(F.col("lang") == "de", "blog").when(F.col("lang") == "fr", "faq").otherwise("general")
    size = chunk.chunk_settings(kind)["size"]
    return t.documents.select("doc_id", (text.estimate_tokens(F.col("text")) > size).alias("overflow"))


def chunked(t):
    return chunk.chunk_documents(enriched(t))


@query("chunk_documents")
def _(t):
    rows = chunked(t)
    return rows.select("chunk_id", "document_id", "content", "token_count", "metadata.heading", "index", "overflow", "reason")


@query("chunk_summary")
def _(t):
    return chunk.chunk_summary(chunked(t))
