"""URL rules as Column -> Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import fixed_values as fv
from pagemill.functions.text import keep_first, let, strip, text_or_empty

# generic syntax of RFC 3986, appendix B
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def scheme_of(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host_of(url: Column) -> Column:
    return F.lower(_part(url, 2))


def path_of(url: Column) -> Column:
    return _part(url, 3)


def query_of(url: Column) -> Column:
    return _part(url, 4)


def origin_of(url: Column) -> Column:
    return F.concat(scheme_of(url), F.lit("://"), host_of(url))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    return F.replace(
        F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def query_items(url: Column) -> Column:
    """Decoded (key, value) pairs in order; items without a value are left out."""
    pairs = F.transform(
        F.split(query_of(url), "&"),
        lambda item: F.struct(
            _decode(F.substring_index(item, "=", 1)).alias("key"),
            _decode(F.regexp_extract(item, r"^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )
    return F.filter(pairs, lambda p: p["value"] != "")


def _join_query(items: Column) -> Column:
    return F.array_join(
        F.transform(items, lambda p: F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"]))),
        "&",
    )


def _with_query(base: Column, query: Column) -> Column:
    return let(query, lambda q: F.when(q == "", base).otherwise(F.concat(base, F.lit("?"), q)))


def _trim_path(path: Column) -> Column:
    return let(
        F.rtrim(path, F.lit("/")), lambda p: F.when(p == "", F.lit("/")).otherwise(p)
    )


def normalize_url(url: Column) -> Column:
    """Lowercase, https by default, no fragment, no tracking keys, first value of a key wins."""
    u = strip(text_or_empty(url))
    scheme = F.coalesce(F.nullif(scheme_of(u), F.lit("")), F.lit("https"))
    path = _trim_path(path_of(u))
    items = F.filter(
        F.transform(
            query_items(u),
            lambda p: F.struct(F.lower(p["key"]).alias("key"), p["value"].alias("value")),
        ),
        lambda p: ~(p["key"].startswith(fv.TRACKING_PREFIX) | p["key"].isin(fv.TRACKING_PARAMS)),
    )
    query = F.when(query_of(u) == "", F.lit("")).otherwise(
        _join_query(keep_first(items, lambda p: p["key"]))
    )
    slash = F.when(path.startswith("/"), F.lit("")).otherwise(F.lit("/"))
    base = F.concat(scheme, F.lit("://"), host_of(u), slash, path)
    return F.lower(_with_query(base, query))


def canonicalize_url(url: Column) -> Column:
    """Lowercase scheme and host only, sorted query, no blanks, no fragment."""
    u = strip(text_or_empty(url))
    scheme = scheme_of(u)
    authority = F.when(host_of(u) == "", F.lit("")).otherwise(F.concat(F.lit("//"), host_of(u)))
    base = F.concat(
        F.when(scheme == "", F.lit("")).otherwise(F.concat(scheme, F.lit(":"))),
        authority,
        _trim_path(path_of(u)),
    )
    query = F.when(query_of(u) == "", F.lit("")).otherwise(
        _join_query(F.sort_array(query_items(u)))
    )
    return _with_query(base, query)


def normalize_site_url(url: Column) -> Column:
    """Scheme and host lowercased, path kept, query and trailing slashes dropped."""
    u = strip(text_or_empty(url))
    scheme = F.coalesce(F.nullif(scheme_of(u), F.lit("")), F.lit("https"))
    bare = host_of(u) == ""
    host = F.when(bare, F.lower(path_of(u))).otherwise(host_of(u))
    path = F.when(bare, F.lit("")).otherwise(path_of(u))
    return F.rtrim(F.concat(scheme, F.lit("://"), host, path), F.lit("/"))


def site_domain(url: Column) -> Column:
    return F.regexp_replace(host_of(normalize_site_url(url)), r"^www\.", "")


def site_slug(url: Column) -> Column:
    slug = F.btrim(F.regexp_replace(site_domain(url), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("website"))


def tenant_slug(user_id: Column) -> Column:
    slug = F.regexp_replace(F.lower(user_id.cast("string")), "[^a-z0-9]", "_")
    slug = F.regexp_replace(F.btrim(slug, F.lit("_")), "_+", "_")
    slug = F.btrim(F.substring(slug, 1, fv.TENANT_SLUG_CHARS), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("user"))


def collection_name(url: Column, user_id: Column | None = None) -> Column:
    base = F.concat(F.lit(fv.COLLECTION_PREFIX), site_slug(url))
    if user_id is None:
        return base
    has_user = F.coalesce(user_id.cast("string"), F.lit("")) != ""
    return F.when(
        has_user, F.concat(base, F.lit(fv.TENANT_SEPARATOR), tenant_slug(user_id))
    ).otherwise(base)


def url_category(url: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fv.CATEGORY_BY_SEGMENT.items() for x in kv])
    segments = F.filter(
        F.split(path_of(text_or_empty(url)), "/"),
        lambda s: (s != "") & ~s.isin(fv.LANGUAGE_SEGMENTS),
    )

    def pick(parts: Column) -> Column:
        known = F.filter(parts, lambda s: s.isin(list(fv.CATEGORY_BY_SEGMENT)))
        return (
            F.when(F.size(parts) == 0, F.lit("home"))
            .when(F.size(known) == 0, F.lit("general"))
            .otherwise(F.try_element_at(table, F.get(known, F.lit(0))))
        )

    return let(segments, pick)


def is_blocked_url(url: Column) -> Column:
    path = F.lower(path_of(text_or_empty(url)))
    media = path.rlike(r"[^/]\.(?:" + "|".join(fv.MEDIA_EXTENSIONS) + r")/*$")
    return media | path.rlike("|".join(fv.BLOCKED_PATH_TERMS))


def in_scope(url: Column, target: Column) -> Column:
    """Same host, and the path equals the target path or lies below it."""
    target_path = F.rtrim(path_of(target), F.lit("/"))
    path = path_of(url)
    return (host_of(url) == host_of(target)) & (
        (target_path == "")
        | (path == target_path)
        | F.startswith(path, F.concat(target_path, F.lit("/")))
    )


def should_index_sitemap(url: Column) -> Column:
    path = F.lower(path_of(url))
    skipped = path.rlike("^(?:" + "|".join(fv.SKIPPED_SITEMAP_PREFIXES) + ")")
    return ~(skipped | path.contains(fv.SKIPPED_SITEMAP_TERM))


def sitemap_priority(raw: Column) -> Column:
    number = F.btrim(text_or_empty(raw)).try_cast("double")
    usable = F.when(F.isnan(number), None).otherwise(number)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(usable, F.lit(0.5))))


def looks_like_sitemap(body: Column) -> Column:
    return text_or_empty(body).rlike(r"<(?:[\w.\-]+:)?(?:urlset|sitemapindex)[\s/>]")
