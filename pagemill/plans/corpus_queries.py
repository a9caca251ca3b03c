"""Parsing, cleaning and metadata over the page and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import fixed_values as fv
from pagemill.functions import text, urls
from pagemill.functions.language import reads_english
from pagemill.operators import clean, crawl, metadata, pages as page_ops
from pagemill.plans import query, sql
from pagemill.plans.url_queries import CANON, NORMAL, fetched_pages
from pagemill.plans.url_queries import _FETCHED as FETCHED
from pagemill.plans.url_queries import _HOST as HOST
from pagemill.session import cut_lineage

# --- parse ----------------------------------------------------------------------------


def _decode(x: str) -> str:
    for entity, char in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        x = f"regexp_replace({x}, '{entity}', '{char}', 'g')"
    return x


def _clean(x: str) -> str:
    return sql.collapse(_decode(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"))


_ART = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_MARKED = f"regexp_replace(regexp_replace({_ART}, '</(p|h1)>', '', 'g'), '<(p|h1)>', chr(1), 'g')"
_BLOCKS = f"list_filter(list_transform(string_split({_MARKED}, chr(1))[2:], lambda b: {_clean('b')}), lambda b: b <> '')"
_TITLE = _clean("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
PARSED = f"""blocks AS (SELECT page_id, url, html, {_TITLE} AS title, {_BLOCKS} AS bs,
      {_clean("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS heading FROM pages),
    parsed AS (SELECT page_id, url, html, title, heading, array_to_string({sql.first_wins('bs')}, chr(10) || chr(10)) AS content FROM blocks)"""


def parsed(t):
    return page_ops.parse_pages(t.pages.select("page_id", "url", "html"))


@query(
    "parse_pages",
    f"WITH {PARSED} SELECT page_id, url, title, '' AS meta_description, content, 0 AS n_lists, 0 AS n_tables, CAST(NULL AS VARCHAR) AS error FROM parsed",
)
def _(t):
    return parsed(t).select(
        "page_id", "url", "title", "meta_description", "content",
        F.size("lists").alias("n_lists"), F.size("tables").alias("n_tables"), "error",
    )


@query("html_title", f"SELECT page_id, {_TITLE} AS title FROM pages")
def _(t):
    return parsed(t).select("page_id", "title")


@query("html_headings", f"WITH {PARSED} SELECT page_id, 1 AS level, heading AS text FROM parsed WHERE heading <> ''")
def _(t):
    return parsed(t).select("page_id", F.inline("headings"))


@query("html_hierarchical_text", f"WITH {PARSED} SELECT page_id, content FROM parsed")
def _(t):
    return parsed(t).select("page_id", "content")


def chat_pages(t):
    """Every turn as a page: description, two lists, two tables, and two candidates for the main part.

    The words fill the lists, what is left of them the article.
    """
    words = F.split(text.collapse_ws(F.col("text")), " ")
    half = F.floor(F.size(words) / 3).cast("int")
    def esc(c):
        return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def items(ws):
        return F.array_join(F.transform(ws, lambda w: F.concat(F.lit("<li>"), esc(w), F.lit("</li>"))), "")

    html = F.concat(
        F.lit('<html><head><meta name="description" content="turn '), F.col("turn"),
        F.lit('"></head><body class="page"><div class="cookie-note">we use cookies</div><article><p>'),
        esc(F.array_join(F.slice(words, 2 * half + 1, F.size(words)), " ")),
        F.lit("</p></article><main role=x><h2>"), F.col("role"), F.lit("</h2><ul>"),
        items(F.slice(words, 1, half)), F.lit("<li> </li></ul><ol>"), items(F.slice(words, half + 1, half)),
        F.lit("</ol><table><tr><th>conv</th><td>"), F.col("conv_id"), F.lit("</td></tr><tr><td> </td></tr><tr><td>"),
        F.col("role"), F.lit("</td><td>"), F.col("turn"), F.lit("</td></tr></table><table><tr><td>words</td><td>"),
        F.size(words), F.lit("</td></tr></table></main></body></html>"),
    )
    return t.conversations.select("conv_id", "turn", html.alias("html"))


_WORDS = f"string_split({sql.collapse('text')}, ' ')"
_CHAT = f"chat AS (SELECT conv_id, turn, role, {_WORDS} AS ws, CAST(floor(len({_WORDS}) / 3.0) AS INT) AS half FROM conversations)"


@query("html_meta_description", "SELECT conv_id, turn, 'turn ' || turn AS meta_description FROM conversations")
def _(t):
    return page_ops.parse_pages(chat_pages(t)).select("conv_id", "turn", "meta_description")


@query(
    "html_lists",
    f"""WITH {_CHAT}, l AS (SELECT conv_id, turn, ws[1:half] AS xs, 1 AS o FROM chat UNION ALL SELECT conv_id, turn, ws[half + 1:2 * half], 2 FROM chat)
    SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) - 1 AS INT) AS pos, array_to_string(xs, '|') AS items FROM l
    WHERE len(list_filter(xs, lambda x: x <> '')) > 0 AND (SELECT 1) = 1""",
)
def _(t):
    chosen = page_ops.parse_pages(chat_pages(t))
    return chosen.select("conv_id", "turn", F.posexplode("lists").alias("pos", "l")).select(
        "conv_id", "turn", "pos", F.array_join("l", "|").alias("items")
    )


@query(
    "html_tables",
    f"""WITH {_CHAT} SELECT conv_id, turn, 0 AS tab, 0 AS pos, 'conv|' || conv_id AS cells FROM chat
    UNION ALL SELECT conv_id, turn, 0, 1, role || '|' || turn FROM chat UNION ALL SELECT conv_id, turn, 1, 0, 'words|' || len(ws) FROM chat""",
)
def _(t):
    chosen = page_ops.parse_pages(chat_pages(t))
    each = chosen.select("conv_id", "turn", F.posexplode("tables").alias("tab", "found"))
    rows = each.select("conv_id", "turn", "tab", F.posexplode("found.rows").alias("pos", "row"))
    return rows.select("conv_id", "turn", "tab", "pos", F.array_join("row", "|").alias("cells"))


_MAIN_TEXT = """array_to_string(list_concat(list_concat(list_concat([role], ws[1:half]), ws[half + 1:2 * half]),
      ['conv', CAST(conv_id AS VARCHAR), role, CAST(turn AS VARCHAR), 'words', CAST(len(ws) AS VARCHAR)]), ' ')"""


@query(
    "html_main_container",
    f"""WITH {_CHAT}, r AS (SELECT *, array_to_string(ws[2 * half + 1:], ' ') AS rest FROM chat)
      SELECT conv_id, turn, CASE WHEN length({_MAIN_TEXT}) > length(rest) THEN role ELSE rest END AS content FROM r""",
)
def _(t):
    return page_ops.parse_pages(chat_pages(t)).select("conv_id", "turn", "content")


_BODY = "regexp_extract(html, '(?s)<body>(.*)$', 1)"
_STRIPPED = f"""regexp_replace(regexp_replace(regexp_replace({_BODY}, '(?s)<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->', ' ', 'g'),
  '(?s)<div class="ad">.*?</div>', ' ', 'g'), '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"""


@query("html_strip_boilerplate", f"SELECT page_id, {_clean(_STRIPPED)} AS kept FROM pages")
def _(t):
    found = page_ops.read_pages(t.pages.select("page_id", "html"), ["body_text"], documents=False)
    return found.select("page_id", text.collapse_ws(F.col("body_text")).alias("kept"))


_VISIBLE = "regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"


@query("html_visible_text", f"SELECT page_id, {_clean(_VISIBLE)} AS visible FROM pages")
def _(t):
    found = page_ops.read_pages(t.pages.select("page_id", "html"), ["visible_text"], documents=False)
    return found.select("page_id", text.collapse_ws(F.col("visible_text")).alias("visible"))


@query(
    "parse_summary",
    f"""WITH {PARSED} SELECT count(*) AS total_pages, count(*) AS parsed_pages, 0 AS failed_pages,
      count(*) FILTER (content = '') AS empty_content_pages, round(avg(length(content)), 4) AS mean_text_length FROM parsed""",
)
def _(t):
    done = page_ops.parse_summary(parsed(t))
    return done.withColumn("mean_text_length", F.round("mean_text_length", 4))


_PROBE = f"""WITH {PARSED} SELECT page_id, array_to_string(list_filter([title, heading, content], lambda x: x <> ''), chr(10)) AS probe FROM parsed"""


@query("lang_probe_text", _PROBE)
def _(t):
    return parsed(t).select("page_id", page_ops.language_probe().alias("probe"))


# --- clean: the documents stand in for parsed pages, their source as title ----------------------


def as_parsed(t):
    none = F.array().cast("array<struct<level:int,text:string>>")
    return t.documents.select(
        (F.col("doc_id") + 1).alias("pos"),
        F.concat(F.lit("https://docs.example.com/"), F.col("source"), F.lit("/"), F.col("doc_id")).alias("url"),
        F.col("source").alias("title"),
        none.alias("headings"),
        F.col("text").alias("content"),
        F.array().cast("array<array<string>>").alias("lists"),
        F.array().cast("array<struct<rows:array<array<string>>>>").alias("tables"),
    )


def cleaned(t):
    return clean.clean_documents(as_parsed(t), keep_content=False)


_LINE = sql.strip("l")
# title, blank line, body lines: the composed text, cleaned line by line, then by paragraph
CLEANED = f"""composed AS (SELECT doc_id, source, text, list_concat([source, ''], list_transform(string_split({sql.strip('text')}, chr(10)),
        lambda l: trim(regexp_replace(regexp_replace(l, '[ \\t\\f\\v]+', ' ', 'g'), '^ ?(?i:{"|".join(fv.BOILERPLATE_LINES)}) ?$', '')))) AS ls FROM documents),
    flat AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM composed),
    once AS (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN x = '' THEN CAST(i AS VARCHAR) || chr(10) ELSE lower(x) END ORDER BY i) AS rn FROM flat),
    glued AS (SELECT doc_id, trim(regexp_replace(string_agg(x, chr(10) ORDER BY i) FILTER (rn = 1), chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS t,
      CAST(count(*) FILTER (rn > 1) AS INT) AS repeated FROM once GROUP BY doc_id),
    paras AS (SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS p, unnest(range(len(string_split(t, chr(10) || chr(10))))) AS j FROM glued),
    ponce AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower({sql.collapse('p')}) ORDER BY j) AS rn FROM paras WHERE p <> ''),
    cleaned AS (SELECT g.doc_id, d.source, d.text, repeated, coalesce(string_agg(p, chr(10) || chr(10) ORDER BY j) FILTER (rn = 1), '') AS clean,
      CAST(count(*) FILTER (rn > 1) AS INT) AS dup_paras FROM glued g JOIN documents d USING (doc_id) LEFT JOIN ponce USING (doc_id) GROUP BY ALL)"""
JUDGED = f"""{CLEANED}, fp AS (SELECT *, {sql.fingerprint('clean')} AS f,
      CASE WHEN clean = '' THEN 'empty document' WHEN length(clean) < 100 THEN 'extremely short page' ELSE '' END AS r FROM cleaned),
    ranked AS (SELECT *, min(doc_id) FILTER (r = '') OVER (PARTITION BY f) AS first_doc FROM fp),
    judged AS (SELECT r2.doc_id, r2.source, r2.clean, r2.repeated, 'https://docs.example.com/' || r2.source || '/' || r2.doc_id AS url,
      CASE WHEN r = '' AND first_doc <> r2.doc_id THEN 'duplicate document' ELSE r END AS reason,
      CASE WHEN r = '' AND first_doc <> r2.doc_id THEN 'https://docs.example.com/' || d.source || '/' || d.doc_id ELSE '' END AS duplicate_of
      FROM ranked r2 LEFT JOIN documents d ON d.doc_id = first_doc)"""


@query(
    "doc_compose",
    f"SELECT doc_id + 1 AS pos, source || chr(10) || chr(10) || {sql.strip('text')} AS composed FROM documents",
)
def _(t):
    return as_parsed(t).select("pos", clean.compose_text().alias("composed"))


@query("doc_clean", f"WITH {CLEANED} SELECT doc_id + 1 AS pos, clean, repeated, dup_paras FROM cleaned")
def _(t):
    done = clean.add_clean_text(as_parsed(t))
    return done.select(
        "pos",
        F.col("cleaned_content").alias("clean"),
        F.col("repeated_lines_removed").alias("repeated"),
        F.col("duplicate_paragraphs_removed").alias("dup_paras"),
    )


@query(
    "doc_reject_reason",
    f"""SELECT conv_id, turn, CASE WHEN length({sql.strip('text')}) = 0 THEN 'empty document'
      WHEN length({sql.strip('text')}) < 100 THEN 'extremely short page' ELSE '' END AS reason FROM conversations""",
)
def _(t):
    return t.conversations.select("conv_id", "turn", clean.reject_reason(F.col("text")).alias("reason"))


@query("doc_dedup", f"WITH {JUDGED} SELECT url, reason, duplicate_of FROM judged")
def _(t):
    return cleaned(t).select("url", "reason", "duplicate_of")


@query("doc_sequence_id", "SELECT doc_id, format('doc-{:05d}', doc_id + 1) AS document_id FROM documents")
def _(t):
    return t.documents.select("doc_id", clean.document_id(F.col("doc_id") + 1).alias("document_id"))


@query(
    "clean_summary",
    f"""WITH {JUDGED} SELECT count(*) AS total_documents, count(*) FILTER (reason = '') AS cleaned_documents, count(*) FILTER (reason <> '') AS rejected_documents,
      count(*) FILTER (reason = 'duplicate document') AS duplicates_removed, round(avg(length(clean)) FILTER (reason = ''), 4) AS mean_length FROM judged""",
)
def _(t):
    done = clean.clean_summary(cleaned(t))
    return done.withColumn("mean_length", F.round("mean_length", 4))


# --- metadata -----------------------------------------------------------------------------


def enriched(t):
    kept = clean.accepted(cleaned(t))
    return metadata.add_metadata(kept, urls.collection_name(F.col("url")), F.lit("2024-01-01T00:00:00+00:00"))


_HASH = f"sha256(array_to_string(list_filter(list_transform(string_split(clean, chr(10)), lambda l: {_LINE}), lambda l: l <> ''), chr(10)))"
META = f"""{JUDGED}, hashed AS (SELECT *, {_HASH} AS content_hash FROM judged WHERE reason = ''),
    meta AS (SELECT doc_id + 1 AS pos, sha256(url || '|' || content_hash) AS document_id, url AS source_url, url AS canonical_url, source AS title,
      left(split_part(clean, chr(10), 1), 240) AS section_heading, 'general' AS category, 'en' AS language, 'website' AS source_type,
      'website_docs_example_com' AS collection, '2024-01-01T00:00:00+00:00' AS crawl_timestamp, content_hash, clean AS content FROM hashed)"""


@query("meta_enrich", f"WITH {META} SELECT * FROM meta")
def _(t):
    return enriched(t)


@query(
    "meta_document_id",
    f"SELECT page_id, sha256(url || '|' || sha256(html)) AS document_id FROM (SELECT page_id, {CANON} AS url, html FROM pages)",
)
def _(t):
    return t.pages.select(
        "page_id",
        metadata.document_key(urls.canonicalize_url(F.col("url")), F.sha2("html", 256)).alias("document_id"),
    )


_DOC_HASH = f"sha256(coalesce(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {_LINE}), lambda l: l <> ''), chr(10)), ''))"


@query("meta_duplicate_hashes", f"SELECT count(*) - count(DISTINCT {_DOC_HASH}) AS duplicate_hashes FROM documents")
def _(t):
    hashed = t.documents.select(text.content_hash(F.col("text")).alias("content_hash"))
    return metadata.duplicate_hashes(hashed)


@query(
    "meta_summary",
    f"""WITH {META} SELECT count(*) AS total_documents, count(*) - count(DISTINCT content_hash) AS duplicate_hashes,
      count(*) FILTER (title = '') AS missing_titles, count(*) FILTER (category <> 'general') AS categorized_documents FROM meta""",
)
def _(t):
    return metadata.metadata_summary(enriched(t))


# --- links: every host has a home page that names its pages --------------------------------------

_CAP = fv.CRAWL_PAGES


@query(
    "link_reachability",
    f"""{FETCHED}, {PARSED}, probed AS (SELECT page_id, array_to_string(list_filter([title, heading, content], lambda x: x <> ''), chr(10)) AS probe FROM parsed),
    p AS (SELECT page_id, {HOST} AS host, {NORMAL} AS url, html, url AS raw, allowed AND status_code = 200 AND contains(lower(content_type), 'text/html') AND
      (english OR {sql.reads_english('probe')}) AS usable FROM f JOIN probed USING (page_id)),
    u AS (SELECT url, bool_or(usable) AS usable FROM p GROUP BY url),
    c1 AS (SELECT host, url, min(page_id) AS pos FROM p GROUP BY ALL),
    l1 AS (SELECT * FROM (SELECT c1.*, usable, row_number() OVER (PARTITION BY host ORDER BY pos) AS r FROM c1 JOIN u USING (url)) WHERE r < {_CAP}),
    h AS (SELECT page_id, url, regexp_extract(raw, '^(https?://[^/?#]+)', 1) AS origin, unnest(hs) AS href, generate_subscripts(hs, 1) AS i
      FROM (SELECT *, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM p)),
    e AS (SELECT url, rtrim(lower(CASE WHEN starts_with(href, '/') THEN origin || href ELSE href END), '/') AS link, i FROM h),
    c2 AS (SELECT host, link, min(struct_pack(r := r, i := i)) AS place FROM l1 JOIN e USING (url) WHERE usable AND
      NOT EXISTS (FROM l1 x WHERE x.host = l1.host AND x.url = e.link) AND link <> 'https://' || host GROUP BY ALL),
    l2 AS (SELECT * FROM (SELECT c2.*, row_number() OVER (PARTITION BY host ORDER BY place) AS r FROM c2)
      JOIN (SELECT host, count(*) + 1 AS spent FROM l1 GROUP BY host) USING (host) WHERE r + spent <= {_CAP})
    SELECT host AS seed, 0 AS depth, 1 AS urls, 1 AS discovered FROM l1 GROUP BY host
    UNION ALL SELECT host, 1, count(*), count(*) FILTER (usable) FROM l1 GROUP BY host
    UNION ALL SELECT host, 2, count(*), 0 FROM l2 GROUP BY host""",
)
def _(t):
    """From each host's home page over its pages to their own links, with all gates of a crawl."""
    fetched = fetched_pages(t, F.col("html")).withColumn("url", urls.normalize_url(F.col("url")))
    read = page_ops.parse_pages(fetched).withColumn(
        "english", F.col("english") | reads_english(page_ops.language_probe())
    )
    judged = crawl.validate_targets(read).select("url", (F.col("reason") == "").alias("usable"))
    known = t.pages.select("page_id", urls.host_of(F.col("url")).alias("seed_id"), urls.normalize_url(F.col("url")).alias("link"))
    home = F.concat(F.lit("https://"), F.col("seed_id"))
    homes = known.select("seed_id", home.alias("url")).distinct()
    usable = judged.groupBy("url").agg(F.bool_or("usable").alias("usable")).unionByName(
        homes.select("url", F.lit(True).alias("usable"))
    )
    named = page_ops.extract_links(t.pages.select("url", "html")).select(
        urls.normalize_url(F.col("url")).alias("url"), F.col("pos").cast("long").alias("pos"), "link"
    )
    links = known.select(home.alias("url"), F.col("page_id").alias("pos"), "link").unionByName(named)
    seeds = homes.select("seed_id", F.col("url").alias("target"))
    found = crawl.reachable_pages(seeds, cut_lineage(usable, "usable"), cut_lineage(links, "links"))
    return found.groupBy(F.col("seed_id").alias("seed"), "depth").agg(
        F.count("*").alias("urls"), F.count_if("discovered").alias("discovered")
    )
