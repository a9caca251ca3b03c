"""The given tables seen as users, sites, widgets, chats and usage rows; with the SQL of each view."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.operators import usage

# --- usage -----------------------------------------------------------------------------


def usage_events(t):
    return t.events.select("user_id", "ts", F.floor("value").alias("tokens"))


def as_of(t):
    return t.events.agg(F.max(F.to_date("ts"))).scalar()


def daily(t):
    return usage.daily_usage(usage_events(t))


def monthly(t):
    return usage.monthly_usage(usage_events(t))


def stats(t):
    """Lifetime counters kept by another path: clicks only, so that some lag behind the days."""
    clicks = t.events.filter(F.col("event_type") == "click")
    return clicks.groupBy("user_id").agg(
        (F.count("*") * 6).alias("total_queries"),
        (F.sum(F.floor("value")) * 4).alias("total_tokens"),
    )


SQL_DAILY = """daily AS (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS queries, count(*) AS chats,
    CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens, strftime(CAST(ts AS DATE), '%a, %b %-d') AS label FROM events GROUP BY ALL)"""
SQL_MONTHLY = """monthly AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS queries, count(*) AS chats,
    CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens, strftime(ts, '%b %Y') AS label FROM events GROUP BY ALL)"""
SQL_AS_OF = "(SELECT max(CAST(ts AS DATE)) FROM events)"
SQL_STATS = """stats AS (SELECT user_id, count(*) * 6 AS total_queries, CAST(sum(CAST(floor(value) AS BIGINT)) * 4 AS BIGINT) AS total_tokens
    FROM events WHERE event_type = 'click' GROUP BY user_id)"""

# --- users: customers, with their order dates as logins ---------------------------------------


def users(t):
    logins = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.to_date(F.max("o_orderdate")).alias("last_login_at")
    )
    named = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower(F.translate("c_name", "#", ".")), F.lit("@Example.com")).alias("email"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "role_admin").otherwise("role_user").alias("role_id"),
        F.when(F.col("c_acctbal") < 0, "disabled").otherwise("active").alias("status"),
        "c_nationkey",
    )
    return named.join(logins, "id", "left")


def login_as_of(t):
    return t.orders.agg(F.max(F.to_date("o_orderdate"))).scalar()


SQL_USERS = """users AS (SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', '.')) || '@Example.com' AS email,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'role_admin' ELSE 'role_user' END AS role_id,
    CASE WHEN c_acctbal < 0 THEN 'disabled' ELSE 'active' END AS status, c_nationkey, last_login_at
    FROM customer LEFT JOIN (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS last_login_at FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""
SQL_LOGIN_AS_OF = "(SELECT CAST(max(o_orderdate) AS DATE) FROM orders)"

# --- sites: suppliers; claims on them: order lines ---------------------------------------------

CLAIM_ORDER = ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey"]


def claims(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    joined = lines.join(orders, "l_orderkey")
    site = F.concat(F.lit("site_"), F.col("l_suppkey")).alias("website_id")
    return joined.select(site, F.col("o_custkey").alias("owner_id"), *CLAIM_ORDER)


def owners(t):
    from pagemill.operators.dedup import keep_first_rows

    return keep_first_rows(claims(t), ["website_id"], CLAIM_ORDER).select("website_id", "owner_id")


def sites(t, with_owner: bool = False):
    pages = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("page_count"))
    url = F.concat(F.lit("https://www."), F.lower(F.translate("s_name", "#", "-")), F.lit(".example.com/"))
    kind = F.col("s_nationkey") % 5
    out = t.supplier.join(pages, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(
        F.concat(F.lit("site_"), F.col("s_suppkey")).alias("id"),
        url.alias("url"),
        urls.site_domain(url).alias("domain"),
        urls.collection_name(url).alias("collection_name"),
        F.when(kind == 0, "pending")
        .when(kind == 1, "indexing")
        .when(kind == 2, "indexed")
        .when(kind == 4, "failed")
        .alias("status"),
        "page_count",
    )
    if with_owner:
        held = owners(t).select(F.col("website_id").alias("id"), F.col("owner_id").alias("owner_user_id"))
        out = out.join(held, "id", "left")
    return out


SQL_CLAIMS = """claims AS (SELECT 'site_' || l_suppkey AS website_id, o_custkey AS owner_id, o_orderdate, l_orderkey, l_linenumber, l_partkey
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
SQL_OWNERS = f"""{SQL_CLAIMS}, owners AS (SELECT website_id, owner_id FROM (SELECT *, row_number() OVER (
    PARTITION BY website_id ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey) AS rn FROM claims) WHERE rn = 1)"""
SQL_SITES = """sites AS (SELECT 'site_' || s_suppkey AS id, 'https://www.' || lower(replace(s_name, '#', '-')) || '.example.com/' AS url,
    lower(replace(s_name, '#', '-')) || '.example.com' AS domain,
    'website_' || lower(replace(s_name, '#', '_')) || '_example_com' AS collection_name,
    CASE s_nationkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'indexing' WHEN 2 THEN 'indexed' WHEN 4 THEN 'failed' END AS status, page_count
    FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS page_count FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)"""

# --- widgets: parts, owned by the customer of the same key ---------------------------------------


def widgets(t):
    shipped = t.lineitem.groupBy("l_partkey").agg(
        F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("created_at"),
        F.date_format(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))), "yyyy-MM-dd").alias("updated_at"),
    )
    small = F.col("p_size") <= 5
    return t.part.join(shipped, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        F.concat(F.lit("widget_"), F.col("p_partkey")).alias("widget_id"),
        F.when(small, "").otherwise(F.col("p_partkey").cast("string")).alias("owner_id"),
        F.concat(F.lit("website_supplier_"), F.lpad(F.col("p_size").cast("string"), 9, "0"), F.lit("_example_com")).alias("collection"),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_name")).alias("display_name"),
        F.when(F.col("p_size") > 25, "active").when(F.col("p_size") > 10, "inactive").alias("status"),
        "created_at",
        "updated_at",
    )


SQL_WIDGETS = """raw_widgets AS (SELECT 'widget_' || p_partkey AS widget_id, CASE WHEN p_size <= 5 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS owner_id,
    'website_supplier_' || lpad(CAST(p_size AS VARCHAR), 9, '0') || '_example_com' AS collection,
    CASE WHEN p_type <> 'ECONOMY' THEN p_name END AS display_name,
    CASE WHEN p_size > 25 THEN 'active' WHEN p_size > 10 THEN 'inactive' END AS status, created_at, updated_at FROM part LEFT JOIN (
      SELECT l_partkey, strftime(min(l_shipdate), '%Y-%m-%d') AS created_at, strftime(max(l_shipdate) FILTER (l_returnflag = 'R'), '%Y-%m-%d') AS updated_at
      FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
  widgets AS (SELECT widget_id, owner_id, collection, coalesce(display_name, 'Supplier ' || lpad(split_part(collection, '_', 3), 9, '0') || ' Example Com') AS display_name,
    coalesce(status, 'active') AS status, coalesce(created_at, '') AS created_at, coalesce(updated_at, '') AS updated_at,
    coalesce(updated_at, created_at, '') AS mapping_version FROM raw_widgets)"""

# --- chats: orders as conversations, order lines as their messages -----------------------------


def chats(t):
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("title"),
        F.to_date("o_orderdate").alias("created_at"),
        F.to_date("o_orderdate").alias("updated_at"),
    )


def chat_messages(t):
    flag = F.col("l_returnflag")
    return t.lineitem.select(
        F.col("l_orderkey").alias("conversation_id"),
        "l_linenumber",
        "l_partkey",
        F.when(flag == "A", "user").when(flag == "N", "assistant").otherwise("system").alias("role"),
        F.when(F.col("l_quantity") > 45, "  ").otherwise(F.concat(F.lit(" part "), F.col("l_partkey"))).alias("content"),
        F.to_date("l_shipdate").alias("created_at"),
    )


SQL_CHATS = """chats AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS title, CAST(o_orderdate AS DATE) AS created_at FROM orders)"""
SQL_MESSAGES = """messages AS (SELECT l_orderkey AS conversation_id, l_linenumber, l_partkey,
    CASE l_returnflag WHEN 'A' THEN 'user' WHEN 'N' THEN 'assistant' ELSE 'system' END AS role,
    CASE WHEN l_quantity > 45 THEN '  ' ELSE ' part ' || l_partkey END AS content, CAST(l_shipdate AS DATE) AS created_at FROM lineitem)"""
