"""URL sets, crawl targets, fetch logs and link reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import fixed_values as fv
from pagemill.functions import urls
from pagemill.functions.text import text_or_empty
from pagemill.operators.dedup import keep_first_rows, mark_first
from pagemill.session import cut_lineage


def filter_urls(df: DataFrame, order: list[str], url: str = "url", keys: list[str] | None = None) -> DataFrame:
    """Add ``outcome``: ``duplicate`` before ``blocked`` before ``accepted``, in ``order``."""
    keyed = mark_first(df, [*(keys or []), url], order)
    outcome = (
        F.when(~F.col("_is_first"), "duplicate")
        .when(urls.is_blocked_url(F.col(url)), "blocked")
        .otherwise("accepted")
    )
    return keyed.withColumn("outcome", outcome).drop("_is_first")


def apply_filters(extracted: DataFrame, target: Column, order: str = "pos") -> DataFrame:
    """One row per canonical URL with ``outcome`` and the number of ``duplicates`` dropped.

    The record kept for a URL is its **last** one, its place is the first one.
    """
    fields = [c for c in extracted.columns if c != "canonical_url"]
    grouped = extracted.groupBy("canonical_url").agg(
        F.max_by(F.struct(*fields), F.col(order)).alias("_last"),
        F.min(order).alias("first_pos"),
        (F.count("*") - 1).alias("duplicates"),
    )
    rows = grouped.select(
        "canonical_url", *[F.col(f"_last.{c}").alias(c) for c in fields], "first_pos", "duplicates"
    )
    outcome = (
        F.when(urls.is_blocked_url(F.col("canonical_url")), "blocked")
        .when(~urls.in_scope(F.col("canonical_url"), target), "out_of_scope")
        .otherwise("accepted")
    )
    return rows.withColumn("outcome", outcome)


def filter_counts(filtered: DataFrame) -> DataFrame:
    return filtered.agg(
        F.count_if(F.col("outcome") == "accepted").alias("accepted"),
        F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"),
        F.count_if(F.col("outcome") != "accepted").alias("blocked"),
    )


def merge_sitemaps(records: DataFrame, order: list[str]) -> DataFrame:
    """First record of every normalized sitemap URL."""
    return keep_first_rows(records.withColumn("url", urls.normalize_url(F.col("url"))), ["url"], order)


def robots_allowed(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Add ``allowed``: the first rule of the host whose path starts the URL's path decides.

    ``rules`` has ``host, pos, path, allow``, or one row per host with its ``rules`` as an array.  Each distinct
    path is expanded into the prefixes whose length some rule has, and these are joined on equality, so
    no path is compared with all rules of its host.
    """
    request = F.concat(
        urls.path_of(F.col(url)),
        F.when(urls.query_of(F.col(url)) == "", "").otherwise(
            F.concat(F.lit("?"), urls.query_of(F.col(url)))
        ),
    )
    path = F.when(request == "", "/").otherwise(request)
    keyed = df.withColumns({"_host": urls.host_of(F.col(url)), "_path": path})
    if "rules" in rules.columns:
        rules = rules.select("host", F.posexplode("rules").alias("pos", "r")).select("host", "pos", "r.*")
    prefix = F.when(F.col("path") == "*", "").otherwise(F.col("path"))
    flat = rules.select(F.col("host").alias("_host"), prefix.alias("_prefix"), F.col("pos").alias("_pos"), F.col("allow").alias("_allow"))
    lengths = flat.agg(F.collect_set(F.length("_prefix"))).scalar()
    asked = keyed.select("_host", "_path").distinct().withColumn("_lengths", lengths)
    fitting = F.filter("_lengths", lambda n: n <= F.length("_path"))
    prefixes = F.transform(fitting, lambda n: F.substring("_path", F.lit(1), n))
    met = asked.select("_host", "_path", F.explode(prefixes).alias("_prefix")).join(flat, ["_host", "_prefix"])
    decided = met.groupBy("_host", "_path").agg(F.min_by("_allow", "_pos").alias("_allow"))
    joined = keyed.join(decided, ["_host", "_path"], "left")
    return joined.withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_host", "_path", "_allow")


def is_html(status: Column, content_type: Column) -> Column:
    return (status == 200) & F.contains(F.lower(text_or_empty(content_type)), F.lit("text/html"))


def validate_targets(fetched: DataFrame) -> DataFrame:
    """Add ``reason``: empty for a crawl target, else why it is blocked.

    Needs ``allowed``, ``status_code``, ``content_type`` and ``english``.
    """
    reason = (
        F.when(~F.col("allowed"), "robots")
        .when(F.col("status_code") != 200, "status")
        .when(~is_html(F.lit(200), F.col("content_type")), "content type")
        .when(~F.col("english"), "language")
        .otherwise("")
    )
    return fetched.withColumn("reason", reason)


def classify_fetches(log: DataFrame) -> DataFrame:
    """A fetch log to crawl results.

    Needs ``url``, ``allowed``, ``fetch_error``, ``status_code``, ``content_type``,
    ``needs_render``, ``content_length`` and the ``rendered_*`` columns of the second fetch.
    """
    plain_ok = is_html(F.col("status_code"), F.col("content_type")) & ~F.col("needs_render")
    rendered_ok = is_html(F.col("rendered_status_code"), F.col("rendered_content_type"))
    blocked = ~F.col("allowed")
    broken = F.col("fetch_error").isNotNull()
    skipped_or_broken = blocked | broken
    return log.select(
        "url",
        F.when(blocked, "skipped")
        .when(broken, "failed")
        .when(plain_ok | rendered_ok, "success")
        .otherwise("failed")
        .alias("status"),
        F.when(skipped_or_broken, 0)
        .when(plain_ok, F.col("status_code"))
        .otherwise(F.col("rendered_status_code"))
        .alias("status_code"),
        F.when(skipped_or_broken, "none").when(plain_ok, "requests").otherwise("playwright").alias("crawler"),
        F.when(skipped_or_broken, 0)
        .when(plain_ok, F.col("content_length"))
        .otherwise(F.col("rendered_content_length"))
        .alias("content_length"),
        F.when(blocked, "blocked by robots.txt")
        .when(broken, F.col("fetch_error"))
        .when(plain_ok | rendered_ok, "")
        .otherwise(
            F.concat(
                F.lit("invalid response content-type: "),
                text_or_empty(F.col("rendered_content_type")),
            )
        )
        .alias("error"),
        F.when(
            ~skipped_or_broken & (plain_ok | rendered_ok),
            F.concat(F.sha2("url", 256), F.lit(".html")),
        )
        .otherwise("")
        .alias("saved_file"),
    )


def crawl_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("total_urls"),
        F.count_if(F.col("status") == "success").alias("successful_crawls"),
        F.count_if(F.col("status") == "failed").alias("failed_crawls"),
        F.count_if(F.col("crawler") == "playwright").alias("playwright_pages"),
        F.count_if(F.col("status") == "skipped").alias("skipped_pages"),
    )


def with_fallback(primary: DataFrame, fallback: DataFrame, site: str = "site") -> DataFrame:
    """Rows of ``primary``, and of ``fallback`` for the sites that ``primary`` does not cover."""
    uncovered = fallback.join(primary.select(site).distinct(), site, "left_anti")
    return primary.unionByName(uncovered)


def reachable_pages(
    seeds: DataFrame,
    pages: DataFrame,
    links: DataFrame,
    max_depth: int = fv.CRAWL_DEPTH,
    max_pages: int = fv.CRAWL_PAGES,
) -> DataFrame:
    """Breadth-first discovery for many seeds at once.

    ``seeds(seed_id, target)``, ``pages(url, usable)`` with normalized URLs, ``links(url, pos,
    link)``.  Every visited URL counts towards ``max_pages`` of its seed; only usable pages in the
    seed's scope are discovered and, above ``max_depth``, expanded.  At most ``max_pages`` rows per
    seed are ever kept between levels; the loop runs ``max_depth + 1`` times and writes each level once.
    Depth and number of pages are features of a crawl: what lies beyond them is left out.
    """
    seed = ["seed_id", "target"]
    page_flags = pages.select("url", "usable")
    frontier = seeds.select(
        *seed, F.col("target").alias("url"), F.array(F.lit(0).cast("long")).alias("place")
    )
    visited: DataFrame | None = None
    for depth in range(max(1, max_depth) + 1):
        fresh = frontier
        if visited is not None:
            seen = visited.select("seed_id", "url")
            fresh = frontier.join(seen, ["seed_id", "url"], "left_anti")
        first = fresh.groupBy(*seed, "url").agg(F.min("place").alias("place"))
        if visited is not None:
            spent = visited.groupBy("seed_id").agg(F.count("*").alias("_spent"))
            first = first.join(spent, "seed_id")
        else:
            first = first.withColumn("_spent", F.lit(0).cast("long"))
        rank = F.row_number().over(Window.partitionBy("seed_id").orderBy("place"))
        admitted = first.withColumn("_rank", rank).filter(
            (F.col("_rank") <= max_pages) & (F.col("_rank") + F.col("_spent") <= max_pages)
        )
        level = (
            admitted.join(page_flags, "url", "left")
            .select(
                *seed,
                "url",
                F.array(F.lit(depth).cast("long"), F.col("_rank").cast("long")).alias("place"),
                F.lit(depth).alias("depth"),
                (
                    F.coalesce(F.col("usable"), F.lit(False))
                    & urls.in_scope(F.col("url"), F.col("target"))
                ).alias("discovered"),
            )
        )
        level = cut_lineage(level, "reached")
        visited = level if visited is None else visited.unionByName(level)
        if depth < max_depth:
            frontier = (
                level.filter("discovered")
                .join(links, "url")
                .select(*seed, F.col("link").alias("url"), F.concat("place", F.array(F.col("pos").cast("long"))).alias("place"))
            )
    return visited.withColumn("blocked", urls.is_blocked_url(F.col("url")))
