"""Users, sites, widgets, conversations: ownership, visibility and change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import fixed_values as fv
from pagemill.functions.text import humanize, strip, text_or_empty
from pagemill.operators.dedup import is_first, with_first


# --- users -----------------------------------------------------------------------

def public_users(users: DataFrame, roles: DataFrame) -> DataFrame:
    names = roles.select(F.col("id").alias("role_id"), F.col("name").alias("role"))
    return users.join(names, "role_id", "left").select(
        "id", "name", "email", F.coalesce("role", F.lit(fv.DEFAULT_ROLE_NAME)).alias("role"),
        "status", "last_login_at",
    )


def users_with_stats(users: DataFrame, stats: DataFrame, self_id: Column | None = None) -> DataFrame:
    others = users if self_id is None else users.filter(F.col("id") != self_id)
    joined = others.join(stats.withColumnRenamed("user_id", "id"), "id", "left")
    return joined.withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("total_queries", "total_tokens")}
    )


def users_by_email(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """Case-insensitive lookup of many addresses at once."""
    keyed = users.withColumn("_email", F.lower("email"))
    asked = wanted.select("email").select(F.lower("email").alias("_email")).distinct()
    return keyed.join(asked, "_email", "left_semi").drop("_email")


def search_users(users: DataFrame, text: str) -> DataFrame:
    haystack = F.lower(F.concat_ws(" ", "name", "email"))
    return users.filter(F.contains(haystack, F.lit(text.lower())))


# --- sites -----------------------------------------------------------------------

def records_of_user(records: DataFrame, user_id: Column | str | None) -> DataFrame:
    """All records for no user, else only the user's own; unowned records are nobody's."""
    if user_id is None:
        return records
    wanted = user_id if isinstance(user_id, Column) else F.lit(str(user_id))
    return records.filter(text_or_empty(F.col("owner_user_id")) == wanted.cast("string"))


def owned_sites(sites: DataFrame, owners: DataFrame, user_ids: DataFrame) -> DataFrame:
    """Sites owned by any of ``user_ids(owner_id)``."""
    mine = owners.join(user_ids.select("owner_id"), "owner_id", "left_semi")
    key = F.coalesce("id", "collection_name")
    return sites.withColumn("_key", key).join(
        mine.select(F.col("website_id").alias("_key")), "_key", "left_semi"
    ).drop("_key")


def claim_sites(claims: DataFrame, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Add ``outcome`` to claims: ``claimed``, ``repeat`` by the owner, or ``conflict``.

    The first claim of a site wins unless ``existing(website_id, owner_id)`` names an owner.
    """
    keyed = with_first(claims, ["website_id"], order, carry=["owner_id"])
    holder = F.col("_first.owner_id")
    fresh = is_first(order)
    if existing is not None:
        held = existing.select("website_id", F.col("owner_id").alias("_held"))
        keyed = keyed.join(held, "website_id", "left")
        holder = F.coalesce("_held", holder)
        fresh = fresh & F.col("_held").isNull()
    outcome = (
        F.when(fresh, "claimed")
        .when(F.col("owner_id") == holder, "repeat")
        .otherwise("conflict")
    )
    return keyed.withColumns({"outcome": outcome, "holder_id": holder}).drop("_first", "_n", "_held")


def site_access(requests: DataFrame, owners: DataFrame) -> DataFrame:
    """``requests(website_id, user_id, is_admin)`` with ``allowed``."""
    held = owners.select("website_id", F.col("owner_id").alias("_owner"))
    joined = requests.join(held, "website_id", "left")
    own = F.coalesce(F.col("_owner").cast("string") == F.col("user_id").cast("string"), F.lit(False))
    return joined.withColumn("allowed", F.col("is_admin") | own).drop("_owner")


def over_quota(owners: DataFrame, users: DataFrame, limit: int) -> DataFrame:
    """Owners, admins aside, that hold ``limit`` sites or more."""
    counted = owners.groupBy("owner_id").agg(F.count("*").alias("owned")).filter(F.col("owned") >= limit)
    regular = users.filter(F.lower("role_id") != fv.ADMIN_ROLE).select(F.col("id").alias("owner_id"))
    return counted.join(regular, "owner_id", "left_semi")


def sites_by_owner(sites: DataFrame, users: DataFrame) -> DataFrame:
    """Sites in owner order, then domain order; the group columns repeat on every row.

    Groups stay flat so that an owner of very many sites is never gathered in one row.
    """
    owner = F.coalesce(F.nullif(text_or_empty(F.col("owner_user_id")), F.lit("")), F.lit(fv.UNASSIGNED_OWNER))
    keyed = sites.withColumn("owner_id", owner)
    names = users.select(
        F.col("id").cast("string").alias("owner_id"), F.coalesce("name", "email").alias("_label")
    )
    joined = keyed.join(names, "owner_id", "left")
    return joined.select(
        "owner_id",
        F.coalesce("_label", "owner_id").alias("owner_label"),
        "id",
        F.coalesce("domain", "collection_name").alias("domain"),
    ).orderBy("owner_label", "owner_id", "domain", "id")


def site_status_counts(sites: DataFrame) -> DataFrame:
    s = F.col("status")
    return sites.agg(
        F.count_if(s == "pending").alias("pending"),
        F.count_if(s == "indexing").alias("indexing"),
        F.count_if((s == "indexed") | (text_or_empty(s) == "")).alias("indexed"),
        F.count_if(s == "failed").alias("failed"),
    )


def upsert_records(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def remove_records(existing: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return existing.join(keys.select(key), key, "left_anti")


def sync_sites(registry: DataFrame, collections: DataFrame) -> DataFrame:
    """Registry rows with ``synced``: whether their collection still exists."""
    present = collections.select("collection_name").distinct().withColumn("_present", F.lit(True))
    joined = registry.join(present, "collection_name", "left")
    return joined.withColumn("synced", F.coalesce("_present", F.lit(False))).drop("_present")


# --- widgets ---------------------------------------------------------------------

def stored_widgets(widgets: DataFrame) -> DataFrame:
    """Every field present: defaults for name, status, collection and mapping version."""
    collection = text_or_empty(F.col("collection"))
    filled = F.coalesce(F.nullif(text_or_empty(F.col("display_name")), F.lit("")), humanize(collection))
    version = F.coalesce(
        F.nullif(text_or_empty(F.col("updated_at")), F.lit("")), text_or_empty(F.col("created_at"))
    )
    return widgets.select(
        "widget_id",
        text_or_empty(F.col("owner_id")).alias("owner_id"),
        collection.alias("collection"),
        filled.alias("display_name"),
        F.coalesce(F.nullif("status", F.lit("")), F.lit("active")).alias("status"),
        text_or_empty(F.col("created_at")).alias("created_at"),
        text_or_empty(F.col("updated_at")).alias("updated_at"),
        version.alias("mapping_version"),
    )


def list_widgets(widgets: DataFrame) -> DataFrame:
    touched = F.coalesce(F.nullif("updated_at", F.lit("")), F.nullif("created_at", F.lit("")))
    return stored_widgets(widgets).orderBy(touched.desc_nulls_last(), "widget_id")


def prune_widgets(widgets: DataFrame, collections: DataFrame) -> DataFrame:
    valid = collections.select(F.col("collection_name").alias("collection"))
    return stored_widgets(widgets).join(valid, "collection", "left_semi")


def visible_widgets(widgets: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(widget_id, user_id)`` with ``found``: an unowned widget is open to everyone."""
    stored = stored_widgets(widgets).select("widget_id", "owner_id")
    joined = requests.join(stored, "widget_id", "left")
    found = (F.col("owner_id") == "") | (F.col("owner_id") == F.col("user_id").cast("string"))
    return joined.withColumn("found", F.coalesce(found, F.lit(False))).drop("owner_id")


def widgets_of_owner(widgets: DataFrame, owner_id: object) -> DataFrame:
    return list_widgets(widgets).filter(F.col("owner_id") == str(owner_id))


def answerable_messages(messages: DataFrame, widgets: DataFrame) -> DataFrame:
    """``messages(widget_id, ...)`` with ``reason`` (empty when answerable), collection and k."""
    stored = stored_widgets(widgets).select("widget_id", "collection", "status")
    joined = messages.join(stored, "widget_id", "left")
    reason = (
        F.when(F.col("status").isNull(), "widget not found")
        .when(F.col("status") != "active", "widget inactive")
        .otherwise("")
    )
    return joined.withColumns(
        {"reason": reason, "requested_k": F.lit(fv.WIDGET_TOP_K), "collection": strip(F.col("collection"))}
    ).drop("status")


# --- conversations ------------------------------------------------------------------

def conversations_with_messages(
    conversations: DataFrame, messages: DataFrame, page_size: int = 500
) -> DataFrame:
    """Conversations with their ordered messages nested, in pages of ``page_size`` turns.

    ``messages(conversation_id, turn, role, content)``; paging by turn keeps every nested array
    bounded, however long one conversation is.
    """
    paged = messages.withColumn("page", F.floor(F.col("turn") / page_size).cast("int"))
    nested = paged.groupBy("conversation_id", "page").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("messages")
    )
    joined = conversations.join(nested, F.col("id") == F.col("conversation_id"), "left")
    return joined.drop("conversation_id").withColumn("page", F.coalesce("page", F.lit(0)))


def touch_conversations(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """``updated_at`` moves to the latest message."""
    latest = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.max("created_at").alias("_last"))
    joined = conversations.join(latest, "id", "left")
    return joined.withColumn("updated_at", F.coalesce("_last", "updated_at")).drop("_last")


def delete_conversations(
    conversations: DataFrame, messages: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Conversations and messages that remain."""
    kept = conversations.join(ids.select("id"), "id", "left_anti")
    gone = ids.select(F.col("id").alias("conversation_id"))
    return kept, messages.join(gone, "conversation_id", "left_anti")


def date_bucket(day: Column, as_of: Column) -> Column:
    age = F.date_diff(as_of, day)
    return F.when(age == 0, "Today").when(age == 1, "Yesterday").otherwise("Older")


def validate_messages(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Trimmed messages with ``reason`` (empty when valid).

    ``messages(conversation_id, user_id, role, content)``, ``conversations(id, user_id)``.
    """
    held = conversations.select(F.col("id").alias("conversation_id"), F.col("user_id").alias("_owner"))
    joined = messages.join(held, "conversation_id", "left")
    content = strip(text_or_empty(F.col("content")))
    reason = (
        F.when(F.col("_owner").isNull(), "Conversation not found.")
        .when(F.col("_owner") != F.col("user_id"), "Forbidden.")
        .when(~text_or_empty(F.col("role")).isin("user", "assistant"), "Invalid role.")
        .when(content == "", "content is required.")
        .otherwise("")
    )
    return joined.withColumns({"reason": reason, "content": content}).drop("_owner")


# --- settings and change sets ----------------------------------------------------------

def resolve_settings(requests: DataFrame, settings: DataFrame, default_role: str = fv.DEFAULT_ROLE) -> DataFrame:
    """Settings of (user, collection), else of the collection, else the default.

    ``settings(user_id, collection, role, constraints)`` with a null user for a whole collection.
    """
    none = F.array().cast("array<string>")
    own = settings.filter(F.col("user_id").isNotNull()).select(
        "user_id", "collection", F.struct("role", "constraints").alias("_own")
    )
    shared = settings.filter(F.col("user_id").isNull()).select(
        "collection", F.struct("role", "constraints").alias("_shared")
    )
    joined = requests.join(own, ["user_id", "collection"], "left").join(shared, "collection", "left")
    fallback = F.struct(F.lit(default_role).alias("role"), none.alias("constraints"))
    chosen = F.coalesce("_own", "_shared", fallback)
    source = (
        F.when(F.col("_own").isNotNull(), "user").when(F.col("_shared").isNotNull(), "collection").otherwise("default")
    )
    return joined.withColumns(
        {"role": chosen["role"], "constraints": chosen["constraints"], "source": source}
    ).drop("_own", "_shared")


def merge_changes(
    base: DataFrame, changes: DataFrame, key: str, values: list[str], order: list[str]
) -> DataFrame:
    """Apply the latest change of every key.

    ``changes`` holds ``op`` (``upsert``, ``update`` or ``delete``), ``values`` (null leaves a value
    as it is) and ``changed_at``.  Every row gets an ``outcome``: kept, inserted, updated, deleted,
    or ``missing key`` for a change that had nothing to change; keep the first three to go on.
    """
    latest = changes.groupBy(key).agg(
        F.max_by(F.struct("op", "changed_at", *values), F.struct(*order)).alias("_c")
    )
    held = base.withColumn("_held", F.lit(True))
    joined = held.join(latest, key, "full")
    has, op = F.coalesce("_held", F.lit(False)), F.col("_c.op")
    outcome = (
        F.when(op.isNull(), "kept")
        .when(has & (op == "delete"), "deleted")
        .when(has, "updated")
        .when(op == "upsert", "inserted")
        .otherwise("missing key")
    )
    applied = {v: F.coalesce(F.col(f"_c.{v}"), F.col(v)) for v in values}
    stamped = F.coalesce(F.col("_c.changed_at"), F.col("updated_at"))
    return joined.withColumns({"outcome": outcome, **applied, "updated_at": stamped}).drop("_c", "_held")


def active_rows(merged: DataFrame) -> DataFrame:
    return merged.filter(F.col("outcome").isin("kept", "updated", "inserted")).drop("outcome")


