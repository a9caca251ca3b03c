"""Ownership, widgets, conversations and change sets over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import fixed_values as fv
from pagemill.operators import tenants
from pagemill.plans import base, query, sql

U, ST, OW, W = base.SQL_USERS, base.SQL_SITES, base.SQL_OWNERS, base.SQL_WIDGETS
CH, MS = base.SQL_CHATS, base.SQL_MESSAGES


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


@query(
    "user_public",
    f"""WITH {U} SELECT id, name, email, coalesce(r_name, 'User') AS role, status, strftime(last_login_at, '%Y-%m-%d') AS last_login_at
    FROM users LEFT JOIN region ON r_regionkey = c_nationkey % 7""",
)
def _(t):
    people = base.users(t).withColumn("role_id", F.col("c_nationkey") % 7)
    roles = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return tenants.public_users(people, roles).withColumn("last_login_at", _day("last_login_at"))


@query(
    "user_with_stats",
    f"""WITH {base.SQL_STATS}, {U} SELECT id, name, coalesce(total_queries, 0) AS total_queries, coalesce(total_tokens, 0) AS total_tokens
    FROM users LEFT JOIN stats ON user_id = id WHERE id <> 0""",
)
def _(t):
    joined = tenants.users_with_stats(base.users(t), base.stats(t), F.lit(0))
    return joined.select("id", "name", "total_queries", "total_tokens")


@query(
    "user_lookup_email",
    f"""WITH {U} SELECT id, email FROM users WHERE lower(email) IN (
      SELECT lower(replace(s_name, 'Supplier#', 'CUSTOMER.') || '@EXAMPLE.com') FROM supplier)""",
)
def _(t):
    asked = t.supplier.select(
        F.concat(F.replace("s_name", F.lit("Supplier#"), F.lit("CUSTOMER.")), F.lit("@EXAMPLE.com")).alias("email")
    )
    return tenants.users_by_email(base.users(t), asked).select("id", "email")


@query("user_search", f"WITH {U} SELECT id, name FROM users WHERE contains(lower(name || ' ' || email), 'mer.00000001')")
def _(t):
    return tenants.search_users(base.users(t), "Mer.00000001").select("id", "name")


@query(
    "own_filter",
    f"""WITH {OW}, {ST} SELECT id, owner_id AS owner_user_id FROM sites JOIN owners ON website_id = id
    WHERE owner_id = (SELECT min(owner_id) FROM owners)""",
)
def _(t):
    sites = base.sites(t, with_owner=True)
    first = base.owners(t).agg(F.min("owner_id")).scalar()
    return tenants.records_of_user(sites, first).select("id", "owner_user_id")


@query(
    "own_semi_join",
    f"""WITH {OW}, {ST}, {U} SELECT id, domain FROM sites WHERE id IN (
      SELECT website_id FROM owners WHERE owner_id IN (SELECT id FROM users WHERE role_id = 'role_admin'))""",
)
def _(t):
    admins = base.users(t).filter(F.col("role_id") == "role_admin").select(F.col("id").alias("owner_id"))
    return tenants.owned_sites(base.sites(t), base.owners(t), admins).select("id", "domain")


@query(
    "own_claim",
    f"""WITH {base.SQL_CLAIMS}, r AS (SELECT *, row_number() OVER w AS rn, first_value(owner_id) OVER w AS holder_id FROM claims
      WINDOW w AS (PARTITION BY website_id ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey))
    SELECT website_id, owner_id, l_orderkey, l_linenumber, l_partkey, holder_id,
      CASE WHEN rn = 1 THEN 'claimed' WHEN owner_id = holder_id THEN 'repeat' ELSE 'conflict' END AS outcome FROM r""",
)
def _(t):
    claimed = tenants.claim_sites(base.claims(t), base.CLAIM_ORDER)
    return claimed.drop("o_orderdate")


@query(
    "own_access_check",
    f"""WITH {OW} SELECT l_orderkey, l_linenumber, l_partkey, l_tax >= 0.08 OR coalesce(o.owner_id = o_custkey, false) AS allowed
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN owners o ON o.website_id = 'site_' || l_suppkey""",
)
def _(t):
    lines = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    requests = lines.select(
        F.concat(F.lit("site_"), F.col("l_suppkey")).alias("website_id"),
        F.col("o_custkey").alias("user_id"),
        (F.col("l_tax") >= 0.08).alias("is_admin"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )
    checked = tenants.site_access(requests, base.owners(t))
    return checked.select("l_orderkey", "l_linenumber", "l_partkey", "allowed")


@query(
    "own_quota",
    f"""WITH {U}, h AS (SELECT DISTINCT o_custkey AS owner_id, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT owner_id, count(*) AS owned FROM h WHERE owner_id IN (SELECT id FROM users WHERE role_id <> 'role_admin') GROUP BY 1 HAVING count(*) >= 30""",
)
def _(t):
    held = (
        t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(F.col("o_custkey").alias("owner_id"), "l_suppkey")
        .distinct()
    )
    return tenants.over_quota(held, base.users(t), 30)


@query(
    "site_group_by_owner",
    f"""WITH {OW}, {ST}, {U} SELECT coalesce(CAST(owner_id AS VARCHAR), '__unassigned__') AS owner_id,
      coalesce(u.name, CAST(owner_id AS VARCHAR), '__unassigned__') AS owner_label, s.id, s.domain
    FROM sites s LEFT JOIN owners ON website_id = s.id LEFT JOIN users u ON u.id = owner_id""",
)
def _(t):
    return tenants.sites_by_owner(base.sites(t, with_owner=True), base.users(t))


@query(
    "site_status_counts",
    f"""WITH {ST} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'indexing') AS indexing,
      count(*) FILTER (status = 'indexed' OR status IS NULL) AS indexed, count(*) FILTER (status = 'failed') AS failed FROM sites""",
)
def _(t):
    return tenants.site_status_counts(base.sites(t))


@query(
    "site_upsert",
    f"""WITH {ST} SELECT id, coalesce(CASE WHEN status = 'failed' THEN 'indexed' ELSE status END, 'indexed') AS status FROM sites
    UNION ALL SELECT 'site_n' || n_nationkey, 'indexed' FROM nation""",
)
def _(t):
    sites = base.sites(t).select("id", F.coalesce("status", F.lit("indexed")).alias("status"))
    redone = sites.filter(F.col("status") == "failed").select("id", F.lit("indexed").alias("status"))
    added = t.nation.select(F.concat(F.lit("site_n"), F.col("n_nationkey")).alias("id"), F.lit("indexed").alias("status"))
    return tenants.upsert_records(sites, redone.unionByName(added))


@query("site_remove", f"WITH {ST} SELECT id, domain FROM sites WHERE status IS NULL OR status <> 'failed'")
def _(t):
    sites = base.sites(t)
    gone = sites.filter(F.col("status") == "failed").select("id")
    return tenants.remove_records(sites, gone).select("id", "domain")


_COLLECTIONS = "(SELECT DISTINCT 'website_supplier_' || lpad(CAST(p_size AS VARCHAR), 9, '0') || '_example_com' FROM part)"


def _collections(t):
    return base.widgets(t).select(F.col("collection").alias("collection_name"))


@query(
    "site_sync",
    f"""WITH {ST} SELECT id, collection_name IN {_COLLECTIONS} AS synced FROM sites""",
)
def _(t):
    return tenants.sync_sites(base.sites(t), _collections(t)).select("id", "synced")


@query("widget_list", f"WITH {W} SELECT * FROM widgets")
def _(t):
    return tenants.list_widgets(base.widgets(t))


@query("widget_prune", f"WITH {ST}, {W} SELECT widget_id, collection FROM widgets WHERE collection IN (SELECT collection_name FROM sites)")
def _(t):
    return tenants.prune_widgets(base.widgets(t), base.sites(t)).select("widget_id", "collection")


@query(
    "widget_visible",
    f"""WITH {W} SELECT l_orderkey, l_linenumber, l_partkey, coalesce(owner_id = '' OR owner_id = CAST(o_custkey AS VARCHAR), false) AS found
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN widgets ON widget_id = 'widget_' || l_partkey""",
)
def _(t):
    lines = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    requests = lines.select(
        F.concat(F.lit("widget_"), F.col("l_partkey")).alias("widget_id"),
        F.col("o_custkey").alias("user_id"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )
    seen = tenants.visible_widgets(base.widgets(t), requests)
    return seen.select("l_orderkey", "l_linenumber", "l_partkey", "found")


@query(
    "widget_answerable",
    f"""WITH {W} SELECT o_orderkey, CASE WHEN status IS NULL THEN 'widget not found' WHEN status <> 'active' THEN 'widget inactive' ELSE '' END AS reason,
      collection, 5 AS requested_k FROM orders LEFT JOIN widgets ON widget_id = 'widget_' || (o_custkey * 2)""",
)
def _(t):
    asked = t.orders.select("o_orderkey", F.concat(F.lit("widget_"), F.col("o_custkey") * 2).alias("widget_id"))
    return tenants.answerable_messages(asked, base.widgets(t)).select("o_orderkey", "reason", "collection", "requested_k")


# --- conversations ------------------------------------------------------------------------

@query(
    "conv_with_messages",
    """SELECT conv_id AS id, CAST(floor(turn / 500) AS INT) AS page, count(*) AS n,
      string_agg(turn || ':' || role || ':' || text, chr(10) ORDER BY turn) AS messages FROM conversations GROUP BY 1, 2""",
)
def _(t):
    chats = t.conversations.select(F.col("conv_id").alias("id")).distinct()
    messages = t.conversations.select(
        F.col("conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("content")
    )
    nested = tenants.conversations_with_messages(chats, messages)
    flat = F.transform("messages", lambda m: F.concat_ws(":", m["turn"].cast("string"), m["role"], m["content"]))
    return nested.select("id", "page", F.size("messages").alias("n"), F.array_join(flat, "\n").alias("messages"))


@query("conv_recent", "SELECT o_orderkey AS id, o_custkey AS user_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders ORDER BY o_orderdate DESC, id")
def _(t):
    newest = base.chats(t).orderBy(F.desc("created_at"), "id")
    return newest.select("id", "user_id", _day("created_at").alias("created_at"))


@query(
    "conv_touch",
    f"""WITH {CH}, {MS}, l AS (SELECT conversation_id, max(created_at) AS last FROM messages GROUP BY 1)
    SELECT id, strftime(coalesce(last, created_at), '%Y-%m-%d') AS updated_at FROM chats LEFT JOIN l ON conversation_id = id""",
)
def _(t):
    touched = tenants.touch_conversations(base.chats(t), base.chat_messages(t))
    return touched.select("id", _day("updated_at").alias("updated_at"))


@query(
    "conv_delete_cascade",
    f"""WITH {CH}, {MS}, gone AS (SELECT id FROM chats WHERE title = '1-URGENT')
    SELECT 'chat' AS kind, id, 0 AS line FROM chats WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'message', conversation_id, l_linenumber FROM messages WHERE conversation_id NOT IN (SELECT id FROM gone)""",
)
def _(t):
    chats = base.chats(t)
    gone = chats.filter(F.col("title") == "1-URGENT").select("id")
    kept, messages = tenants.delete_conversations(chats, base.chat_messages(t), gone)
    left = kept.select(F.lit("chat").alias("kind"), "id", F.lit(0).alias("line"))
    right = messages.select(
        F.lit("message").alias("kind"), F.col("conversation_id").alias("id"), F.col("l_linenumber").alias("line")
    )
    return left.unionByName(right)


@query(
    "conv_date_bucket",
    f"""SELECT o_orderkey AS id, CASE date_diff('day', CAST(o_orderdate AS DATE), {base.SQL_LOGIN_AS_OF}) WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE 'Older' END AS bucket
    FROM orders""",
)
def _(t):
    return base.chats(t).select("id", tenants.date_bucket(F.col("created_at"), base.login_as_of(t)).alias("bucket"))


@query(
    "conv_validate_message",
    f"""WITH {CH}, {MS} SELECT conversation_id, l_linenumber, l_partkey, trim(content) AS content,
      CASE WHEN user_id IS NULL THEN 'Conversation not found.' WHEN user_id <> l_partkey THEN 'Forbidden.'
        WHEN role = 'system' THEN 'Invalid role.' WHEN trim(content) = '' THEN 'content is required.' ELSE '' END AS reason
    FROM messages LEFT JOIN (SELECT * FROM chats WHERE title <> '5-LOW') ON id = conversation_id""",
)
def _(t):
    messages = base.chat_messages(t).withColumn("user_id", F.col("l_partkey"))
    chats = base.chats(t).filter(F.col("title") != "5-LOW")
    checked = tenants.validate_messages(messages, chats)
    return checked.select("conversation_id", "l_linenumber", "l_partkey", "content", "reason")


# --- settings and change sets -----------------------------------------------------------------

@query(
    "cfg_resolve",
    f"""SELECT o_orderkey, CASE WHEN own THEN 'user' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'collection' ELSE 'default' END AS source,
      CASE WHEN own THEN 'Agent of ' || o_custkey WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Desk ' || o_orderpriority ELSE {sql.lit(fv.DEFAULT_ROLE)} END AS role
    FROM (SELECT *, bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey, o_orderpriority) AS own FROM orders)""",
)
def _(t):
    requests = t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("collection"))
    none = F.array().cast("array<string>").alias("constraints")
    own = (
        t.orders.filter(F.col("o_orderstatus") == "P")
        .select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("collection"))
        .distinct()
        .select("user_id", "collection", F.concat(F.lit("Agent of "), F.col("user_id")).alias("role"), none)
    )
    shared = (
        t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        .select(F.col("o_orderpriority").alias("collection"))
        .distinct()
        .select(
            F.lit(None).cast("long").alias("user_id"), "collection",
            F.concat(F.lit("Desk "), F.col("collection")).alias("role"), none,
        )
    )
    resolved = tenants.resolve_settings(requests, own.unionByName(shared))
    return resolved.select("o_orderkey", "source", "role")


@query(
    "tbl_merge_changes",
    """WITH c AS (SELECT o_custkey * 2 AS id, CASE o_orderstatus WHEN 'F' THEN 'delete' WHEN 'O' THEN 'update' ELSE 'upsert' END AS op,
      CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS segment, o_orderdate, o_orderkey FROM orders),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM c) WHERE rn = 1)
    SELECT coalesce(b.c_custkey, l.id) AS id, coalesce(l.segment, b.c_mktsegment) AS segment,
      strftime(coalesce(l.o_orderdate, TIMESTAMP '1990-01-01'), '%Y-%m-%d') AS updated_at,
      CASE WHEN l.op IS NULL THEN 'kept' WHEN c_custkey IS NOT NULL AND op = 'delete' THEN 'deleted' WHEN c_custkey IS NOT NULL THEN 'updated'
        WHEN op = 'upsert' THEN 'inserted' ELSE 'missing key' END AS outcome FROM customer b FULL JOIN l ON l.id = b.c_custkey""",
)
def _(t):
    people = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"),
        F.to_date(F.lit("1990-01-01")).alias("updated_at"),
    )
    status = F.col("o_orderstatus")
    changes = t.orders.select(
        (F.col("o_custkey") * 2).alias("id"),
        F.when(status == "F", "delete").when(status == "O", "update").otherwise("upsert").alias("op"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("segment"),
        F.to_date("o_orderdate").alias("changed_at"),
        "o_orderkey",
    )
    merged = tenants.merge_changes(people, changes, "id", ["segment"], ["changed_at", "o_orderkey"])
    return merged.select("id", "segment", _day("updated_at").alias("updated_at"), "outcome")
