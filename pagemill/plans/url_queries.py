"""URL rules, sitemaps, robots and crawl operators over the page table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import fixed_values as fv
from pagemill.functions import urls
from pagemill.functions.language import declares_english
from pagemill.operators import crawl, pages as page_ops
from pagemill.plans import query, sql
from pagemill.session import cut_lineage, scratch_dir
from pagemill.sources import robots as robots_source
from pagemill.sources import sitemaps as sitemap_source
from pagemill.sources import stage

# --- SQL pieces ------------------------------------------------------------------

_PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
_HOST = "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"
_BASE = "rtrim(regexp_replace(url, '[?#].*$', ''), '/')"
_ITEMS = r"string_split(regexp_extract(url, '\?([^#]*)', 1), '&')"
_TRACKING = sql.strings(fv.TRACKING_PARAMS)
_KEPT = (
    f"array_to_string(list_filter({_ITEMS}, lambda q: regexp_matches(q, '=.') AND "
    f"NOT starts_with(q, 'utm_') AND NOT list_contains({_TRACKING}, split_part(q, '=', 1))), '&')"
)
NORMAL = f"lower({_BASE} || CASE WHEN coalesce({_KEPT}, '') = '' THEN '' ELSE '?' || {_KEPT} END)"
_SORTED = f"array_to_string(list_sort(list_filter({_ITEMS}, lambda q: regexp_matches(q, '=.'))), '&')"
CANON = f"{_BASE} || CASE WHEN coalesce({_SORTED}, '') = '' THEN '' ELSE '?' || {_SORTED} END"
_SITE = "rtrim(regexp_replace(url, '[?#].*$', ''), '/')"
_DOMAIN = f"regexp_replace({_HOST}, '^www\\.', '')"
_SLUG = f"trim(regexp_replace({_DOMAIN}, '[^a-z0-9]+', '_', 'g'), '_')"
_BLOCKED = (
    rf"(regexp_matches(lower({_PATH}), '[^/]\.(?:{'|'.join(fv.MEDIA_EXTENSIONS)})/*$') OR "
    rf"regexp_matches(lower({_PATH}), '{'|'.join(fv.BLOCKED_PATH_TERMS)}'))"
)


def url_col():
    return F.col("url")


@query("url_normalize", f"SELECT page_id, {NORMAL} AS normal FROM pages")
def _(t):
    return t.pages.select("page_id", urls.normalize_url(url_col()).alias("normal"))


@query("url_canonicalize", f"SELECT page_id, {CANON} AS canonical FROM pages")
def _(t):
    return t.pages.select("page_id", urls.canonicalize_url(url_col()).alias("canonical"))


@query("url_normalize_site", f"SELECT page_id, {_SITE} AS site FROM pages")
def _(t):
    return t.pages.select("page_id", urls.normalize_site_url(url_col()).alias("site"))


@query("url_domain", f"SELECT {_DOMAIN} AS domain, count(*) AS pages FROM pages GROUP BY 1")
def _(t):
    domains = t.pages.select(urls.site_domain(url_col()).alias("domain"))
    return domains.groupBy("domain").agg(F.count("*").alias("pages"))


@query("url_slug", f"SELECT page_id, {_SLUG} AS slug FROM pages")
def _(t):
    return t.pages.select("page_id", urls.site_slug(url_col()).alias("slug"))


_TENANT = "trim(regexp_replace(trim(regexp_replace(lower(c_name), '[^a-z0-9]', '_', 'g'), '_'), '_+', '_', 'g'), '_')"
_TENANT = f"trim(left({_TENANT}, 20), '_')"


@query("tenant_slug", f"SELECT c_custkey, {_TENANT} AS slug FROM customer")
def _(t):
    return t.customer.select("c_custkey", urls.tenant_slug(F.col("c_name")).alias("slug"))


@query(
    "collection_name",
    f"""SELECT page_id, 'website_' || {_SLUG} AS shared,
      'website_' || {_SLUG} || '_u_' || CAST(page_id AS VARCHAR) AS scoped FROM pages""",
)
def _(t):
    return t.pages.select(
        "page_id",
        urls.collection_name(url_col()).alias("shared"),
        urls.collection_name(url_col(), F.col("page_id")).alias("scoped"),
    )


_SEGMENTS = f"list_filter(string_split({_PATH}, '/'), lambda s: s <> '' AND s NOT IN ('en', 'hi'))"
_CATEGORY_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fv.CATEGORY_BY_SEGMENT.items()) + "}"
_KNOWN = f"list_filter({_SEGMENTS}, lambda s: s IN ({', '.join(sql.lit(k) for k in fv.CATEGORY_BY_SEGMENT)}))"
# pages of the given hosts are filed under a section so that the table of sections is exercised
_SECTIONS = list(fv.CATEGORY_BY_SEGMENT)
_SECTION_URL = f"""(SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' ||
  coalesce({sql.strings(_SECTIONS)}[CAST(page_id % 21 AS INT)], '') || {_PATH} AS url FROM pages)"""


def section_url():
    section = F.element_at(F.array(F.lit(""), *[F.lit(s) for s in _SECTIONS]), (F.col("page_id") % 21 + 1).cast("int"))
    return F.concat(urls.origin_of(url_col()), F.lit("/"), section, urls.path_of(url_col()))


@query(
    "url_category",
    f"""SELECT page_id, CASE WHEN len({_SEGMENTS}) = 0 THEN 'home' WHEN len({_KNOWN}) = 0 THEN 'general'
      ELSE {_CATEGORY_MAP}[{_KNOWN}[1]] END AS category FROM {_SECTION_URL} p""",
)
def _(t):
    return t.pages.select("page_id", urls.url_category(section_url()).alias("category"))


@query(
    "url_blocked",
    f"""SELECT pos, url, {_BLOCKED} AS blocked FROM (SELECT l_orderkey * 10 + l_linenumber AS pos,
      'https://shop.example.com/' || CASE l_linenumber WHEN 1 THEN 'privacy/' WHEN 2 THEN 'img/' ELSE '' END || l_partkey ||
      CASE l_linenumber WHEN 2 THEN '.png' WHEN 3 THEN '.html?f=a.pdf' ELSE '' END AS url FROM lineitem)""",
)
def _(t):
    n = F.col("l_linenumber")
    built = F.concat(
        F.lit("https://shop.example.com/"),
        F.when(n == 1, "privacy/").when(n == 2, "img/").otherwise(""),
        F.col("l_partkey"),
        F.when(n == 2, ".png").when(n == 3, ".html?f=a.pdf").otherwise(""),
    )
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + n).alias("pos"), built.alias("url"))
    return rows.select("pos", "url", urls.is_blocked_url(url_col()).alias("blocked"))


def shop_urls(t):
    """One URL per order line: many repeats of few URLs, some of them blocked."""
    kind = F.when(F.col("l_shipmode_") == 0, "legal/").otherwise("item/")
    rows = t.lineitem.withColumn("l_shipmode_", F.col("l_suppkey") % 7)
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.concat(F.lit("https://shop.example.com/"), kind, F.col("l_suppkey")).alias("url"),
    )


_SHOP = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'https://shop.example.com/' ||
  CASE WHEN l_suppkey % 7 = 0 THEN 'legal/' ELSE 'item/' END || l_suppkey AS url FROM lineitem)"""
SHOP_ORDER = ["l_orderkey", "l_linenumber", "l_partkey"]
_ORDER = ", ".join(SHOP_ORDER)


@query(
    "url_filter_set",
    f"""SELECT {_ORDER}, url, CASE WHEN rn > 1 THEN 'duplicate' WHEN {_BLOCKED} THEN 'blocked' ELSE 'accepted' END AS outcome
    FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {_ORDER}) AS rn FROM {_SHOP} s)""",
)
def _(t):
    return crawl.filter_urls(shop_urls(t).select(*SHOP_ORDER, "url"), SHOP_ORDER)


@query(
    "url_apply_filters",
    f"""WITH s AS (SELECT *, l_orderkey * 10 + l_linenumber AS o FROM {_SHOP} s),
    g AS (SELECT url, arg_max(l_partkey, (o, l_partkey)) AS last_part, min(o) AS first_pos, count(*) - 1 AS duplicates FROM s GROUP BY url)
    SELECT url, last_part, first_pos, duplicates, CASE WHEN {_BLOCKED} THEN 'blocked'
      WHEN {_PATH} = '/item' OR starts_with({_PATH}, '/item/') THEN 'accepted' ELSE 'out_of_scope' END AS outcome FROM g""",
)
def _(t):
    rows = shop_urls(t).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"),
        "l_partkey",
        F.col("url").alias("canonical_url"),
    )
    placed = rows.withColumn("pos", F.struct("o", "l_partkey"))
    kept = crawl.apply_filters(placed, F.lit("https://shop.example.com/item"))
    return kept.select(
        F.col("canonical_url").alias("url"),
        F.col("l_partkey").alias("last_part"),
        F.col("first_pos.o").alias("first_pos"),
        "duplicates",
        "outcome",
    )


@query(
    "url_in_scope",
    f"""SELECT page_id, {_PATH} = '/en' OR starts_with({_PATH}, '/en/') AS inside FROM pages""",
)
def _(t):
    target = F.concat(urls.origin_of(url_col()), F.lit("/en/"))
    return t.pages.select("page_id", urls.in_scope(url_col(), target).alias("inside"))


# --- robots: each host forbids the page folders it names ------------------------------

def robots_bodies(t):
    """One robots.txt per host of the page table, written from its own pages."""
    folder = F.regexp_extract(urls.path_of(url_col()), r"^(/[^/]+/\d)", 1)
    rule = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Disallow: "), folder)).otherwise(
        F.concat(F.lit("Allow: "), folder)
    )
    lines = t.pages.select(urls.host_of(url_col()).alias("host"), "page_id", rule.alias("rule"))
    # a rule counts where it stands first, so a host's file has at most two lines per folder
    once = lines.groupBy("host", "rule").agg(F.min("page_id").alias("page_id"))
    listed = once.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("page_id", "rule"))).alias("r"))
    return listed.select(
        "host",
        F.concat(
            F.lit("User-agent: otherbot\nDisallow: /\n\nUser-agent: *\n"),
            F.array_join(F.col("r.rule"), "\n"),
            F.lit("\nSitemap: https://"),
            F.col("host"),
            F.lit("/sitemap.xml\n"),
        ).alias("body"),
    )


_RULES = rf"""rules AS (SELECT {_HOST} AS host, min(page_id) AS page_id, page_id % 3 <> 0 AS allow,
    regexp_extract({_PATH}, '^(/[^/]+/\d)', 1) AS rule FROM pages GROUP BY ALL)"""


@query(
    "src_robots_rules",
    f"""WITH {_RULES} SELECT host, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS pos,
      rule AS path, allow, 'https://' || host || '/sitemap.xml' AS sitemap FROM rules""",
)
def _(t):
    lines = robots_source.body_lines(robots_bodies(t))
    first = robots_source.sitemaps_of(lines).filter("pos = 0").select("host", "sitemap")
    return robots_source.rules_of(lines).join(first, "host", "left")


@query(
    "robots_allowed",
    f"""WITH {_RULES}, m AS (
      SELECT p.page_id, arg_min(r.allow, r.page_id) AS allow FROM (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages) p
      JOIN rules r ON p.host = r.host AND starts_with(p.path, r.rule) GROUP BY p.page_id)
    SELECT page_id, coalesce(allow, true) AS allowed FROM pages LEFT JOIN m USING (page_id)""",
)
def _(t):
    rules = robots_source.rules_of(robots_source.body_lines(robots_bodies(t)))
    return crawl.robots_allowed(t.pages.select("page_id", "url"), rules).select("page_id", "allowed")


# --- sitemaps ------------------------------------------------------------------------

SITEMAP_ENTRIES = 50_000  # of one file, by the sitemap protocol


def sitemap_bodies(t):
    """Urlsets per host and language folder, one index per host, all from the page table.

    A urlset takes one range of ids, so it has no more entries than the protocol allows.
    """
    pages = t.pages.select(
        "page_id",
        "url",
        urls.host_of(url_col()).alias("host"),
        F.regexp_extract(urls.path_of(url_col()), "^/([^/]+)/", 1).alias("folder"),
        F.floor(F.col("page_id") / SITEMAP_ENTRIES).alias("part"),
    )
    entry = F.concat(
        F.lit("<url><loc>"),
        F.replace(url_col(), F.lit("&"), F.lit("&amp;")),
        F.lit("</loc><lastmod>2024-01-01</lastmod><priority>"),
        (F.col("page_id") % 4) / 2.0,
        F.lit("</priority></url>"),
    )
    sets = pages.groupBy("host", "folder", "part").agg(
        F.sort_array(F.collect_list(F.struct("page_id", entry.alias("e")))).alias("es")
    )
    part = F.when(F.col("part") == 0, "").otherwise(F.concat(F.lit("-"), F.col("part")))
    leaf_url = F.concat(F.lit("https://"), F.col("host"), F.lit("/"), F.col("folder"), F.lit("/sitemap"), part, F.lit(".xml"))
    leaves = sets.select(
        leaf_url.alias("url"),
        F.concat(
            F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
            F.array_join(F.col("es.e"), ""),
            F.lit("</urlset>"),
        ).alias("body"),
    )
    named = sets.groupBy("host").agg(F.sort_array(F.collect_set(leaf_url)).alias("ls"))
    indexes = named.select(
        F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap_index.xml")).alias("url"),
        F.concat(
            F.lit("<sitemapindex>"),
            F.array_join(
                F.transform("ls", lambda x: F.concat(F.lit("<sitemap><loc>"), x, F.lit("</loc></sitemap>"))), ""
            ),
            F.lit("<sitemap><loc>https://x.example.com/ar/sitemap.xml</loc></sitemap></sitemapindex>"),
        ).alias("body"),
    )
    return leaves, indexes


_FOLDER = f"regexp_extract({_PATH}, '^/([^/]+)/', 1)"
_LEAF = f"""'https://' || {_HOST} || '/' || {_FOLDER} || '/sitemap' || CASE WHEN page_id < {SITEMAP_ENTRIES} THEN '' ELSE '-' || (page_id // {SITEMAP_ENTRIES}) END || '.xml'"""


@query(
    "src_sitemap_xml",
    f"""SELECT {NORMAL} AS url, '2024-01-01' AS last_modified, least(1.0, (page_id % 4) / 2.0) AS priority,
      {_LEAF} AS source_sitemap FROM pages""",
)
def _(t):
    """Written as files and read again by entries, whatever the files' sizes."""
    path = scratch_dir(t.spark, "sitemap-files")
    leaves, _ = sitemap_bodies(t)
    leaves.select(F.col("url").alias("source_sitemap"), "body").write.partitionBy("source_sitemap").text(path)
    entries = sitemap_source.read_entries(t.spark, path)
    return sitemap_source.entry_urls(entries).select("url", "last_modified", "priority", "source_sitemap")


@query(
    "src_sitemap_index",
    f"""SELECT DISTINCT 'https://' || {_HOST} || '/sitemap_index.xml' AS url, 0 AS level FROM pages
    UNION ALL SELECT DISTINCT {_LEAF}, 1 FROM pages""",
)
def _(t):
    path = scratch_dir(t.spark, "sitemap-files")
    leaves, indexes = sitemap_bodies(t)
    leaves.unionByName(indexes).select(F.col("url").alias("source_sitemap"), "body").write.partitionBy("source_sitemap").text(path)
    named = sitemap_source.read_children(t.spark, path)
    return sitemap_source.follow_children(named, indexes.select("url"))


@query(
    "sitemap_locale_filter",
    f"""SELECT page_id, NOT regexp_matches(lower({_PATH}), '^(?:{'|'.join(fv.SKIPPED_SITEMAP_PREFIXES)})') AND
      NOT contains({_PATH}, 'agentic_discovery') AS kept FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) ||
      CASE page_id % 5 WHEN 0 THEN '/ar-sa' WHEN 1 THEN '/en-kw' WHEN 2 THEN '/agentic_discovery' ELSE '' END || {_PATH} AS url FROM pages)""",
)
def _(t):
    n = F.col("page_id") % 5
    prefix = F.when(n == 0, "/ar-sa").when(n == 1, "/en-kw").when(n == 2, "/agentic_discovery").otherwise("")
    built = F.concat(urls.origin_of(url_col()), prefix, urls.path_of(url_col()))
    return t.pages.select("page_id", urls.should_index_sitemap(built).alias("kept"))


@query(
    "sitemap_priority",
    """SELECT o_orderkey, least(1.0, greatest(0.0, coalesce(TRY_CAST(
      CASE WHEN o_orderstatus = 'F' THEN 'n/a' ELSE CAST(o_totalprice / 250000 - 0.25 AS VARCHAR) END AS DOUBLE), 0.5))) AS priority FROM orders""",
)
def _(t):
    raw = F.when(F.col("o_orderstatus") == "F", "n/a").otherwise((F.col("o_totalprice") / 250000 - 0.25).cast("string"))
    return t.orders.select("o_orderkey", urls.sitemap_priority(raw).alias("priority"))


@query("sitemap_looks_like", "SELECT page_id, regexp_matches(html, '<(urlset|sitemapindex)[ />]') AS sitemap, true AS leaf FROM pages")
def _(t):
    as_leaf = F.concat(F.lit("<urlset><loc>"), url_col(), F.lit("</loc></urlset>"))
    return t.pages.select(
        "page_id",
        urls.looks_like_sitemap(F.col("html")).alias("sitemap"),
        urls.looks_like_sitemap(as_leaf).alias("leaf"),
    )


@query(
    "sitemap_merge",
    f"""SELECT url, arg_min(source, o) AS source FROM (
      SELECT 'https://' || {_HOST} || '/sitemap.xml' AS url, 'page ' || page_id AS source, page_id AS o FROM pages) GROUP BY url""",
)
def _(t):
    records = t.pages.select(
        F.concat(F.lit("HTTPS://"), urls.host_of(url_col()), F.lit("/sitemap.xml?utm_source=x")).alias("url"),
        F.concat(F.lit("page "), F.col("page_id")).alias("source"),
        F.col("page_id").alias("o"),
    )
    return crawl.merge_sitemaps(records, ["o"]).select("url", "source")


# --- crawl ------------------------------------------------------------------------------

def fetched_pages(t, *more):
    """The page table seen as a fetch log: every 11th answer is an error, every 13th is no HTML."""
    n = F.col("page_id")
    rules = robots_source.rules_of(robots_source.body_lines(robots_bodies(t)))
    log = t.pages.select(
        "page_id",
        "url",
        F.when(n % 11 == 0, 503).otherwise(200).alias("status_code"),
        F.when(n % 13 == 0, "application/json").otherwise("Text/HTML; charset=utf-8").alias("content_type"),
        declares_english(F.col("html")).alias("english"),
        *more,
    )
    return crawl.robots_allowed(log, rules)


_FETCHED = rf"""WITH {_RULES}, m AS (
      SELECT p.page_id, arg_min(r.allow, r.page_id) AS allow FROM (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages) p
      JOIN rules r ON p.host = r.host AND starts_with(p.path, r.rule) GROUP BY p.page_id),
    f AS (SELECT page_id, url, html, coalesce(allow, true) AS allowed, CASE WHEN page_id % 11 = 0 THEN 503 ELSE 200 END AS status_code,
      CASE WHEN page_id % 13 = 0 THEN 'application/json' ELSE 'Text/HTML; charset=utf-8' END AS content_type,
      starts_with(regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1), 'en') AS english FROM pages LEFT JOIN m USING (page_id))"""


@query(
    "crawl_target_validate",
    f"""{_FETCHED} SELECT page_id, CASE WHEN NOT allowed THEN 'robots' WHEN status_code <> 200 THEN 'status'
      WHEN NOT contains(lower(content_type), 'text/html') THEN 'content type' WHEN NOT english THEN 'language' ELSE '' END AS reason FROM f""",
)
def _(t):
    return crawl.validate_targets(fetched_pages(t)).select("page_id", "reason")


def fetch_log(t):
    n = F.col("page_id")
    pages = fetched_pages(t, F.col("html"), F.length("html").alias("content_length"))
    return (
        page_ops.read_pages(pages, ["needs_render"], documents=False)
        .withColumns(
            {
                "fetch_error": F.when(n % 17 == 0, F.lit("timeout")),
                "rendered_status_code": F.when(n % 2 == 0, 200).otherwise(404),
                "rendered_content_type": F.when(n % 7 == 0, "text/plain").otherwise("text/html"),
                "rendered_content_length": F.col("content_length") + 1,
            }
        )
    )


_VISIBLE = r"""regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '<[^>]+>', chr(10), 'g')"""
_BODY_LEN = rf"""length(trim(regexp_replace(replace(replace(replace(replace(replace({_VISIBLE}, '&copy;', '_'), '&middot;', '_'), '&nbsp;', ' '), '&amp;', '_'), '&eacute;', '_'), '\s*\n\s*', ' ', 'g')))"""
_CLASSIFIED = f"""{_FETCHED}, l AS (SELECT *, {_BODY_LEN} < 250 AS needs_render, page_id % 17 = 0 AS broken,
      CASE WHEN page_id % 2 = 0 THEN 200 ELSE 404 END AS rs, CASE WHEN page_id % 7 = 0 THEN 'text/plain' ELSE 'text/html' END AS rc FROM f),
    k AS (SELECT *, status_code = 200 AND contains(lower(content_type), 'text/html') AND NOT needs_render AS plain, rs = 200 AND rc = 'text/html' AS rendered FROM l),
    c AS (SELECT url, CASE WHEN NOT allowed THEN 'skipped' WHEN broken THEN 'failed' WHEN plain OR rendered THEN 'success' ELSE 'failed' END AS status,
      CAST(CASE WHEN NOT allowed OR broken THEN 0 WHEN plain THEN status_code ELSE rs END AS INT) AS status_code,
      CASE WHEN NOT allowed OR broken THEN 'none' WHEN plain THEN 'requests' ELSE 'playwright' END AS crawler,
      CASE WHEN NOT allowed OR broken THEN 0 WHEN plain THEN length(html) ELSE length(html) + 1 END AS content_length,
      CASE WHEN NOT allowed THEN 'blocked by robots.txt' WHEN broken THEN 'timeout' WHEN plain OR rendered THEN '' ELSE 'invalid response content-type: ' || rc END AS error,
      CASE WHEN allowed AND NOT broken AND (plain OR rendered) THEN sha256(url) || '.html' ELSE '' END AS saved_file FROM k)"""


@query("crawl_result_classify", f"{_CLASSIFIED} SELECT * FROM c")
def _(t):
    return crawl.classify_fetches(fetch_log(t))


@query(
    "crawl_summary",
    f"""{_CLASSIFIED} SELECT count(*) AS total_urls, count(*) FILTER (status = 'success') AS successful_crawls,
      count(*) FILTER (status = 'failed') AS failed_crawls, count(*) FILTER (crawler = 'playwright') AS playwright_pages,
      count(*) FILTER (status = 'skipped') AS skipped_pages FROM c""",
)
def _(t):
    return crawl.crawl_summary(crawl.classify_fetches(fetch_log(t)))


@query("page_needs_render", f"SELECT page_id, {_BODY_LEN} < 250 AS needs_render FROM pages")
def _(t):
    found = page_ops.read_pages(t.pages.select("page_id", "html"), ["needs_render"], documents=False)
    return found.select("page_id", "needs_render")


_HREFS = """SELECT page_id, url AS page, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages"""


@query(
    "link_extract",
    f"""WITH h AS ({_HREFS}), a AS (SELECT page_id, CASE WHEN starts_with(href, '/') THEN regexp_extract(page, '^(https?://[^/?#]+)', 1) || href ELSE href END AS url FROM h),
    r AS (SELECT page_id, rtrim(lower(url), '/') AS link FROM a)
    SELECT page_id, count(*) AS links, count(DISTINCT link) AS targets FROM r GROUP BY page_id""",
)
def _(t):
    found = page_ops.extract_links(t.pages.select("page_id", "url", "html"))
    return found.groupBy("page_id").agg(
        F.count("*").alias("links"), F.countDistinct("link").alias("targets")
    )


@query(
    "sitemap_fallback",
    f"""WITH s AS (SELECT {_HOST} AS host, {NORMAL} AS url, page_id FROM pages),
    listed AS (SELECT DISTINCT host FROM s WHERE starts_with(url, 'https'))
    SELECT url, 'sitemap' AS origin FROM s WHERE starts_with(url, 'https')
    UNION ALL SELECT url, 'links' FROM s WHERE host NOT IN (SELECT host FROM listed)""",
)
def _(t):
    found = t.pages.select(
        urls.host_of(url_col()).alias("site"), urls.normalize_url(url_col()).alias("url"), "page_id"
    )
    listed = found.filter(url_col().startswith("https")).select("site", "url", F.lit("sitemap").alias("origin"))
    reached = found.select("site", "url", F.lit("links").alias("origin"))
    return crawl.with_fallback(listed, reached).select("url", "origin")


# --- stage files ----------------------------------------------------------------------

@query("src_raw_pages", "SELECT url, sha256(url) AS stem, CASE WHEN NOT contains(url, '#top') THEN length(html) END AS chars, CASE WHEN contains(url, '#top') THEN 'missing raw HTML file' END AS error FROM pages WHERE NOT starts_with(url, 'http://')")
def _(t):
    """A URL may have been fetched for several pages; each fetch has its own file."""
    saved = F.concat(F.sha2("url", 256), F.lit("-"), "page_id", F.lit(".html"))
    status = F.when(url_col().startswith("http://"), "failed").otherwise("success")
    results = t.pages.select("url", status.alias("status"), saved.alias("saved_file"))
    files = t.pages.filter(~F.contains("url", F.lit("#top"))).select(saved.alias("saved_file"), "html")
    return stage.raw_pages(results, files).select(
        "url", F.sha2("url", 256).alias("stem"), F.length("html").alias("chars"), "error"
    )


@query("src_stage_json", "SELECT conv_id, turn, role, text, kind FROM conversations, (SELECT unnest(['lines', 'arrays']) AS kind)")
def _(t):
    """The turns as JSON lines and as files that hold one JSON array each, of a range of conversations."""
    lines, arrays = scratch_dir(t.spark, "stage-json"), scratch_dir(t.spark, "stage-arrays")
    t.conversations.write.json(lines)
    row = F.struct("conv_id", "turn", "role", "text")
    part = F.concat_ws("-", F.floor(F.col("conv_id") / 1000), F.floor(F.col("turn") / 100))
    grouped = t.conversations.groupBy(part.alias("part")).agg(F.to_json(F.collect_list(row)).alias("value"))
    grouped.write.partitionBy("part").text(arrays)
    schema = T.StructType().add("conv_id", "long").add("turn", "long").add("role", "string").add("text", "string")
    read = stage.read_stage_json(t.spark, lines, schema, lines=True).withColumn("kind", F.lit("lines"))
    return read.unionByName(stage.read_stage_json(t.spark, arrays, schema).drop("part").withColumn("kind", F.lit("arrays")))


@query("src_lenient_table", "SELECT c_custkey, c_name FROM customer")
def _(t):
    path = scratch_dir(t.spark, "lenient")
    t.customer.select("c_custkey", "c_name").write.json(path)
    schema = T.StructType().add("c_custkey", "long").add("c_name", "string")
    rows = stage.read_lenient_table(t.spark, path, schema, lines=True)
    missing = stage.read_lenient_table(t.spark, path + "-missing", schema)
    return rows.unionByName(missing)


@query("sink_stage", "SELECT doc_id, text, lang FROM documents")
def _(t):
    path = scratch_dir(t.spark, "stage")
    stage.write_stage(t.documents.select("doc_id", "text", "lang"), path)
    return t.spark.read.parquet(path)


@query(
    "sink_rejects",
    "SELECT doc_id, 'rejected' AS side FROM documents WHERE length(text) < 400 UNION ALL SELECT doc_id, 'accepted' FROM documents WHERE length(text) >= 400",
)
def _(t):
    path = scratch_dir(t.spark, "split")
    marked = t.documents.withColumn("reason", F.when(F.length("text") < 400, "short").otherwise(""))
    stage.write_split(marked, "reason", f"{path}/accepted", f"{path}/rejected")
    sides = [t.spark.read.parquet(f"{path}/{s}").select("doc_id", F.lit(s).alias("side")) for s in ("accepted", "rejected")]
    return sides[0].unionByName(sides[1])


@query("sink_per_key_file", "SELECT page_id, sha256(url) AS file_stem FROM pages")
def _(t):
    path = scratch_dir(t.spark, "by-key")
    stage.write_by_key(t.pages, url_col(), path, buckets=8)
    return t.spark.read.parquet(path).select("page_id", "file_stem")


@query(
    "sink_sitemap_sets",
    f"""SELECT 'discovered' AS kind, {_LEAF} AS url FROM pages GROUP BY 2
    UNION ALL SELECT 'extracted', {NORMAL} FROM pages
    UNION ALL SELECT 'filtered', url FROM (SELECT DISTINCT {NORMAL} AS url FROM pages) WHERE NOT {_BLOCKED}""",
)
def _(t):
    path = scratch_dir(t.spark, "sets")
    leaves, _ = sitemap_bodies(t)
    extracted = cut_lineage(sitemap_source.sitemap_urls(leaves), "extracted")
    filtered = extracted.select("url").distinct().filter(~urls.is_blocked_url(url_col()))
    sets = {"discovered": leaves.select("url"), "extracted": extracted.select("url"), "filtered": filtered}
    stage.write_sets(sets, path)
    read = [t.spark.read.parquet(f"{path}/{k}").select(F.lit(k).alias("kind"), "url") for k in sets]
    return read[0].unionByName(read[1]).unionByName(read[2])
