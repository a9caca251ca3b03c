"""Usage rollups and admin reports over the event and star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import usage
from pagemill.plans import base, query
from pagemill.session import scratch_dir

D, M, S, U = base.SQL_DAILY, base.SQL_MONTHLY, base.SQL_STATS, base.SQL_USERS
A = base.SQL_AS_OF


def _dated(df):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


_DATE = "strftime(date, '%Y-%m-%d') AS date"


@query("use_daily", f"WITH {D} SELECT user_id, {_DATE}, queries, chats, tokens, label FROM daily")
def _(t):
    return _dated(base.daily(t)).select("user_id", "date", "queries", "chats", "tokens", "label")


@query("use_monthly", f"WITH {M} SELECT user_id, month, queries, chats, tokens, label FROM monthly")
def _(t):
    return base.monthly(t).select("user_id", "month", "queries", "chats", "tokens", "label")


def kept_totals(t):
    """Events in three batches, days mixed over all of them, the second one sent again."""
    kept = usage.UsageTotals(t.spark, scratch_dir(t.spark, "usage-totals"))
    events = t.events.select("event_id", "user_id", "ts", F.floor("value").alias("tokens"))
    for batch in (0, 1, 1, 2):
        kept.add(events.filter(F.pmod("event_id", F.lit(3)) == batch), batch)
    return kept


@query("use_daily_kept", f"WITH {D} SELECT user_id, {_DATE}, queries, chats, tokens, label FROM daily")
def _(t):
    return _dated(kept_totals(t).daily()).select("user_id", "date", "queries", "chats", "tokens", "label")


@query("use_monthly_kept", f"WITH {M} SELECT user_id, month, queries, chats, tokens, label FROM monthly")
def _(t):
    return kept_totals(t).monthly().select("user_id", "month", "queries", "chats", "tokens", "label")


@query(
    "use_labels",
    "SELECT o_orderkey, strftime(o_orderdate, '%a, %b %-d') AS day_label, strftime(o_orderdate, '%b %Y') AS month_label FROM orders",
)
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", usage.day_label(d).alias("day_label"), usage.month_label(d).alias("month_label")
    )


_LAST = f"""{D}, recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS recency FROM daily) WHERE recency <= 14)"""


@query("use_last14", f"WITH {_LAST} SELECT user_id, {_DATE}, queries, tokens, recency FROM recent")
def _(t):
    recent = usage.last_rows(base.daily(t), "date", 14)
    return _dated(recent).select("user_id", "date", "queries", "tokens", "recency")


@query(
    "use_weekly",
    f"""WITH {_LAST}, w AS (SELECT *, CAST(floor((max(recency) OVER (PARTITION BY user_id) - recency) / 7) AS INT) + 1 AS week FROM recent)
    SELECT user_id, week, CAST(sum(queries) AS BIGINT) AS queries, CAST(sum(chats) AS BIGINT) AS chats, CAST(sum(tokens) AS BIGINT) AS tokens,
      'Week ' || week AS label FROM w GROUP BY user_id, week""",
)
def _(t):
    return usage.weekly_usage(base.daily(t)).select("user_id", "week", "queries", "chats", "tokens", "label")


@query(
    "use_last6_months",
    """WITH m AS (SELECT o_custkey AS user_id, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS queries FROM orders GROUP BY ALL)
    SELECT user_id, month, queries, recency FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month DESC) AS recency FROM m) WHERE recency <= 6""",
)
def _(t):
    orders = t.orders.select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.lit(0).alias("tokens")
    )
    recent = usage.last_rows(usage.monthly_usage(orders), "month", 6)
    return recent.select("user_id", "month", "queries", "recency")


@query(
    "use_today",
    f"""WITH {D} SELECT c_custkey AS user_id, coalesce(queries, 0) AS queries_today, coalesce(tokens, 0) AS tokens_today
    FROM customer LEFT JOIN (SELECT * FROM daily WHERE date = {A}) ON user_id = c_custkey""",
)
def _(t):
    people = t.customer.select(F.col("c_custkey").alias("user_id"))
    return usage.today_usage(people, base.daily(t), base.as_of(t))


@query(
    "use_lifetime",
    f"""WITH {S}, i AS (SELECT user_id, 1 AS q, CAST(floor(value) AS BIGINT) AS k FROM events)
    SELECT user_id, CAST(sum(q) AS BIGINT) AS total_queries, CAST(sum(k) AS BIGINT) AS total_tokens FROM (
      SELECT user_id, total_queries AS q, total_tokens AS k FROM stats UNION ALL SELECT * FROM i) GROUP BY user_id""",
)
def _(t):
    one = base.usage_events(t).select(
        "user_id", F.lit(1).cast("long").alias("total_queries"), F.col("tokens").alias("total_tokens")
    )
    return usage.lifetime_usage(base.stats(t), one)


_HEALED = f"""{D}, {S}, sums AS (SELECT user_id, sum(queries) AS q, sum(tokens) AS k FROM daily GROUP BY user_id),
  healed AS (SELECT user_id, CAST(greatest(coalesce(total_queries, 0), coalesce(q, 0)) AS BIGINT) AS total_queries,
    CAST(greatest(coalesce(total_tokens, 0), coalesce(k, 0)) AS BIGINT) AS total_tokens FROM stats FULL JOIN sums USING (user_id))"""


@query("use_self_heal", f"WITH {_HEALED} SELECT * FROM healed")
def _(t):
    return usage.healed_stats(base.stats(t), base.daily(t))


@query(
    "use_period_totals",
    f"""WITH {D} SELECT CAST(sum(queries) AS BIGINT) AS total_queries, CAST(sum(chats) AS BIGINT) AS total_chats, CAST(sum(tokens) AS BIGINT) AS total_tokens,
      max(queries) AS peak_queries, max(chats) AS peak_chats, max(tokens) AS peak_tokens FROM daily""",
)
def _(t):
    return usage.period_totals(base.daily(t))


@query(
    "adm_user_counts",
    f"""WITH {U} SELECT count(*) AS total_users, count(*) FILTER (status = 'active' AND last_login_at >= {base.SQL_LOGIN_AS_OF} - 30) AS active_users
    FROM users WHERE role_id <> 'role_admin'""",
)
def _(t):
    return usage.user_counts(base.users(t), base.login_as_of(t))


@query(
    "adm_active_widgets",
    f"""WITH {U}, {base.SQL_WIDGETS} SELECT widget_id, collection FROM widgets WHERE status = 'active' AND owner_id IN (
      SELECT CAST(id AS VARCHAR) FROM users WHERE role_id <> 'role_admin' AND status = 'active')""",
)
def _(t):
    from pagemill.operators.tenants import stored_widgets

    people = base.users(t).withColumn("id", F.col("id").cast("string"))
    return usage.active_widgets(stored_widgets(base.widgets(t)), people).select("widget_id", "collection")


@query(
    "adm_today_totals",
    f"WITH {D} SELECT CAST(sum(tokens) AS BIGINT) AS tokens_today, CAST(sum(queries) AS BIGINT) AS queries_today FROM daily WHERE date = {A}",
)
def _(t):
    return usage.today_totals(base.daily(t), base.as_of(t))


@query(
    "adm_alltime_totals",
    f"WITH {S} SELECT CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(sum(total_queries) AS BIGINT) AS queries FROM stats",
)
def _(t):
    return usage.alltime_totals(base.stats(t))


def _platform(cte: str, period: str, n: int) -> str:
    table = "daily" if period == "date" else "monthly"
    shown = _DATE if period == "date" else "month"
    return f"""WITH {cte} SELECT {shown}, min(label) AS label, CAST(sum(queries) AS BIGINT) AS queries, CAST(sum(chats) AS BIGINT) AS chats,
      CAST(sum(tokens) AS BIGINT) AS tokens FROM {table} GROUP BY {table}.{period} ORDER BY {table}.{period} DESC LIMIT {n}"""


@query("adm_daily_platform", _platform(D, "date", 14))
def _(t):
    return _dated(usage.platform_rollup(base.daily(t), "date", 14))


@query("adm_monthly_platform", _platform(M, "month", 6))
def _(t):
    return usage.platform_rollup(base.monthly(t), "month", 6)


@query(
    "adm_site_summary",
    f"""WITH {base.SQL_SITES} SELECT id, domain, coalesce(page_count, 0) AS page_count, coalesce(status, 'active') AS status FROM sites""",
)
def _(t):
    return usage.site_summary(base.sites(t))


@query(
    "adm_overview_counts",
    """SELECT (SELECT count(*) FROM customer) AS total_users, (SELECT count(*) FROM supplier) AS total_websites,
      (SELECT count(DISTINCT conv_id) FROM conversations) AS total_chats, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS active_jobs""",
)
def _(t):
    jobs = t.orders.select(F.when(F.col("o_orderstatus") == "P", "active").otherwise("done").alias("status"))
    return usage.overview_counts(t.customer, t.supplier, t.conversations.select("conv_id").distinct(), jobs)


@query(
    "dash_metrics",
    f"""WITH {_HEALED}, {U}, {base.SQL_OWNERS}, {base.SQL_WIDGETS},
    s AS (SELECT owner_id, count(*) AS n FROM owners GROUP BY 1), d AS (SELECT * FROM daily WHERE date = {A}),
    a AS (SELECT owner_id, count(*) AS n FROM widgets WHERE status = 'active' GROUP BY 1),
    r AS (SELECT owner_id, string_agg(display_name, '|' ORDER BY rn) AS names FROM (SELECT *, row_number() OVER (
      PARTITION BY owner_id ORDER BY mapping_version DESC, widget_id) AS rn FROM widgets) WHERE rn <= 2 GROUP BY 1)
    SELECT u.id AS user_id, coalesce(s.n, 0) AS total_websites, coalesce(h.total_queries, 0) AS total_queries, coalesce(h.total_tokens, 0) AS total_tokens,
      coalesce(d.queries, 0) AS queries_today, coalesce(d.tokens, 0) AS tokens_today, coalesce(a.n, 0) AS active_widgets, coalesce(r.names, '') AS recent_activity
    FROM users u LEFT JOIN s ON s.owner_id = u.id LEFT JOIN healed h ON h.user_id = u.id LEFT JOIN d ON d.user_id = u.id
      LEFT JOIN a ON a.owner_id = CAST(u.id AS VARCHAR) LEFT JOIN r ON r.owner_id = CAST(u.id AS VARCHAR)""",
)
def _(t):
    from pagemill.operators.tenants import stored_widgets

    held = stored_widgets(base.widgets(t)).filter(F.col("owner_id") != "")
    widgets = held.withColumns(
        {
            "owner_id": F.col("owner_id").cast("long"),
            "updated_at": F.nullif("updated_at", F.lit("")),
            "created_at": F.nullif("created_at", F.lit("")),
        }
    )
    return usage.dashboard(
        base.users(t), base.owners(t), widgets, base.stats(t), base.daily(t), base.as_of(t)
    )
