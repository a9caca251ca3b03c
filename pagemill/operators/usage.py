"""Usage rollups and admin reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import fixed_values as fv
from pagemill.sources.bucketed import BUCKETS, BucketedTable

COUNTERS = ["queries", "chats", "tokens"]


def _count(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def day_label(d: Column) -> Column:
    return F.date_format(d, "EEE, MMM d")


def month_label(d: Column) -> Column:
    return F.date_format(d, "MMM yyyy")


def daily_usage(events: DataFrame) -> DataFrame:
    """``events(user_id, ts, tokens)``: one row per user and day, combined on the map side."""
    day = F.to_date("ts").alias("date")
    grouped = events.filter(F.col("user_id").isNotNull()).groupBy("user_id", day)
    return grouped.agg(
        F.count("*").alias("queries"),
        F.count("*").alias("chats"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    ).withColumn("label", day_label(F.col("date")))


def monthly_usage(events: DataFrame) -> DataFrame:
    month = F.trunc(F.to_date("ts"), "month").alias("_month")
    grouped = events.filter(F.col("user_id").isNotNull()).groupBy("user_id", month)
    counted = grouped.agg(
        F.count("*").alias("queries"),
        F.count("*").alias("chats"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    )
    return counted.withColumns(
        {"month": F.date_format("_month", "yyyy-MM"), "label": month_label(F.col("_month"))}
    ).drop("_month")


TOTALS = T.StructType(
    [T.StructField("user_id", T.LongType()), T.StructField("date", T.DateType()), *[T.StructField(c, T.LongType()) for c in COUNTERS]]
)


class UsageTotals:
    """Stored counters by user and day that events are added to, batch by batch.

    A batch adds one row for each user and day that it has events of, however late they come, and replaces what an
    earlier try of it added.  Rows are bucketed by user, so days, months and periods are summed where they lie, and no
    event is read again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.stored = BucketedTable(spark, path, TOTALS, "user_id", buckets)

    def add(self, events: DataFrame, batch: int) -> None:
        """``events(user_id, ts, tokens)`` of one batch."""
        self.stored.write(daily_usage(events), batch)

    def daily(self) -> DataFrame:
        """As ``daily_usage`` of all events."""
        summed = self.stored.read().groupBy("user_id", "date").agg(*[F.sum(c).alias(c) for c in COUNTERS])
        return summed.withColumn("label", day_label(F.col("date")))

    def monthly(self) -> DataFrame:
        """As ``monthly_usage`` of all events."""
        rows = self.stored.read().withColumn("_month", F.trunc("date", "month"))
        summed = rows.groupBy("user_id", "_month").agg(*[F.sum(c).alias(c) for c in COUNTERS])
        names = {"month": F.date_format("_month", "yyyy-MM"), "label": month_label(F.col("_month"))}
        return summed.withColumns(names).drop("_month")

    def fold(self, path: str) -> UsageTotals:
        """The same counters with one row a user and day, at another path."""
        folded = UsageTotals(self.stored.spark, path, self.stored.buckets)
        folded.stored.write(self.daily(), 0)
        return folded


def last_rows(rollup: DataFrame, period: str, n: int) -> DataFrame:
    """Latest ``n`` rollup rows of every user; ``recency`` 1 is the newest."""
    newest = Window.partitionBy("user_id").orderBy(F.col(period).desc())
    return rollup.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= n)


def weekly_usage(daily: DataFrame) -> DataFrame:
    """Buckets of seven active days over the last fourteen, oldest first."""
    recent = last_rows(daily, "date", fv.DAILY_ROWS)
    oldest = F.max("recency").over(Window.partitionBy("user_id"))
    position = oldest - F.col("recency")
    placed = recent.withColumn("week", F.floor(position / fv.WEEK_ROWS).cast("int") + 1)
    return placed.groupBy("user_id", "week").agg(
        *[F.sum(_count(c)).alias(c) for c in COUNTERS],
        F.concat(F.lit("Week "), F.col("week")).alias("label"),
    )


def today_usage(users: DataFrame, daily: DataFrame, as_of: Column) -> DataFrame:
    today = daily.filter(F.col("date") == as_of).select(
        "user_id", F.col("queries").alias("q"), F.col("tokens").alias("k")
    )
    return users.select("user_id").join(today, "user_id", "left").select(
        "user_id",
        F.coalesce("q", F.lit(0)).alias("queries_today"),
        F.coalesce("k", F.lit(0)).alias("tokens_today"),
    )


def lifetime_usage(stats: DataFrame, increments: DataFrame) -> DataFrame:
    """Counters per user after adding increments; both sides (user_id, total_queries, total_tokens)."""
    both = stats.unionByName(increments)
    return both.groupBy("user_id").agg(
        F.sum(_count("total_queries")).alias("total_queries"),
        F.sum(_count("total_tokens")).alias("total_tokens"),
    )


def healed_stats(stats: DataFrame, daily: DataFrame) -> DataFrame:
    """Lifetime counters are never below the sum of the daily rows."""
    summed = daily.groupBy("user_id").agg(
        F.sum(_count("queries")).alias("_q"), F.sum(_count("tokens")).alias("_k")
    )
    joined = stats.select("user_id", "total_queries", "total_tokens").join(summed, "user_id", "full")
    return joined.select(
        "user_id",
        F.greatest(_count("total_queries"), _count("_q")).alias("total_queries"),
        F.greatest(_count("total_tokens"), _count("_k")).alias("total_tokens"),
    )


def platform_rollup(rollup: DataFrame, period: str, n: int) -> DataFrame:
    """All users by period: the latest ``n`` periods, ascending; rows without a period are skipped."""
    grouped = rollup.filter(F.col(period).isNotNull()).groupBy(period)
    totals = grouped.agg(
        F.min_by("label", "user_id").alias("label"), *[F.sum(_count(c)).alias(c) for c in COUNTERS]
    )
    return totals.orderBy(F.col(period).desc()).limit(n).orderBy(period)


def period_totals(rollup: DataFrame) -> DataFrame:
    """Sums of a chosen rollup and the peaks that scale its chart."""
    return rollup.agg(
        *[F.coalesce(F.sum(_count(c)), F.lit(0)).alias(f"total_{c}") for c in COUNTERS],
        *[F.coalesce(F.max(_count(c)), F.lit(0)).alias(f"peak_{c}") for c in COUNTERS],
    )


def today_totals(daily: DataFrame, as_of: Column) -> DataFrame:
    return daily.filter(F.col("date") == as_of).agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_today"),
        F.coalesce(F.sum("queries"), F.lit(0)).alias("queries_today"),
    )


def alltime_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("total_queries"), F.lit(0)).alias("queries"),
    )


def is_admin(role_id: Column) -> Column:
    return F.lower(F.coalesce(role_id, F.lit(""))) == fv.ADMIN_ROLE


def user_counts(users: DataFrame, as_of: Column) -> DataFrame:
    """Users that are no admins, and those active with a login in the last thirty days."""
    recent = F.col("last_login_at") >= F.date_sub(as_of, fv.ACTIVE_DAYS)
    return users.filter(~is_admin(F.col("role_id"))).agg(
        F.count("*").alias("total_users"),
        F.count_if((F.col("status") == "active") & recent).alias("active_users"),
    )


def active_widgets(widgets: DataFrame, users: DataFrame) -> DataFrame:
    """Active widgets whose owner is an active user and no admin."""
    owners = users.filter(~is_admin(F.col("role_id")) & (F.col("status") == "active"))
    active = widgets.filter(F.col("status") == "active")
    return active.join(owners.select(F.col("id").alias("owner_id")), "owner_id", "left_semi")


def site_summary(sites: DataFrame) -> DataFrame:
    return sites.select(
        F.coalesce("id", "collection_name").alias("id"),
        F.coalesce("domain", "collection_name").alias("domain"),
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
        F.coalesce("status", F.lit("active")).alias("status"),
    ).orderBy(F.desc("page_count"), "id")


def overview_counts(users: DataFrame, sites: DataFrame, chats: DataFrame, jobs: DataFrame) -> DataFrame:
    """Four table counts in one row: each table is counted once, on the map side."""
    tagged = users.select(F.lit("users").alias("k"))
    tagged = tagged.unionAll(sites.select(F.lit("sites").alias("k")))
    tagged = tagged.unionAll(chats.select(F.lit("chats").alias("k")))
    tagged = tagged.unionAll(jobs.filter(F.col("status") == "active").select(F.lit("jobs").alias("k")))
    return tagged.agg(
        F.count_if(F.col("k") == "users").alias("total_users"),
        F.count_if(F.col("k") == "sites").alias("total_websites"),
        F.count_if(F.col("k") == "chats").alias("total_chats"),
        F.count_if(F.col("k") == "jobs").alias("active_jobs"),
    )


def dashboard(
    users: DataFrame,
    owners: DataFrame,
    widgets: DataFrame,
    stats: DataFrame,
    daily: DataFrame,
    as_of: Column,
    recent: int = 2,
) -> DataFrame:
    """One row per user: owned sites, totals, today's figures, active widgets, latest widgets.

    The sources are laid under each other and meet in one aggregate by user, combined on the map side.
    """
    touched = F.coalesce("updated_at", "created_at")
    latest = Window.partitionBy("owner_id").orderBy(touched.desc_nulls_last(), "widget_id")
    rank = F.row_number().over(latest)
    today = F.col("date") == as_of
    parts = [
        users.select(F.col("id").alias("user_id"), F.lit(1).alias("known")),
        owners.select(F.col("owner_id").alias("user_id"), F.lit(1).alias("site")),
        widgets.filter(F.col("status") == "active").select(F.col("owner_id").alias("user_id"), F.lit(1).alias("active")),
        widgets.withColumn("rank", rank).filter(F.col("rank") <= recent).select(
            F.col("owner_id").alias("user_id"), F.struct("rank", "display_name").alias("widget")
        ),
        stats.select("user_id", "total_queries", "total_tokens"),
        daily.select(
            "user_id",
            "queries",
            "tokens",
            F.when(today, F.col("queries")).alias("queries_now"),
            F.when(today, F.col("tokens")).alias("tokens_now"),
        ),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    healed = lambda kept, c: F.greatest(F.coalesce(F.max(kept), F.lit(0)), total(c))
    met = rows.groupBy("user_id").agg(
        F.max("known").alias("known"),
        F.count("site").alias("total_websites"),
        healed("total_queries", "queries").alias("total_queries"),
        healed("total_tokens", "tokens").alias("total_tokens"),
        total("queries_now").alias("queries_today"),
        total("tokens_now").alias("tokens_today"),
        F.count("active").alias("active_widgets"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list("widget")), lambda w: w["display_name"]), "|"
        ).alias("recent_activity"),
    )
    return met.filter("known = 1").drop("known")
