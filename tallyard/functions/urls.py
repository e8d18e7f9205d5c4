"""URL expressions. All are Column -> Column and stay inside code generation; bad input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that only track visits.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_reader utm_place utm_brand ref referer referrer source "
    "fbclid gclid msclkid _openstat ga_source ga_medium ga_campaign mc_eid mkt_tok si s fb_action_ids fb_action_types "
    "action_object_map action_type_map action_ref_map from via"
).split()
# Hosts that look parked or for sale.
PARKED = r"parked|for.?sale|buy.?domain|buy.?website|domain.?name.?search|whois"
# File endings that are not pages.
ASSETS = r"(?i)\.(jpg|jpeg|png|gif|pdf|zip|docx|xlsx|css|js)$"
# Page kinds by path, first match wins: pattern, kind, priority.
PAGE_KINDS = (
    ("/contact", "contact", 10), ("/get-in-touch", "contact", 10), ("/reach-us", "contact", 10),
    ("/about", "about", 9), ("/who-we-are", "about", 9), ("/company", "about", 8), ("/our-story", "about", 8),
    ("/profile", "about", 7), ("/team", "team", 7), ("/leadership", "team", 7), ("/management", "team", 7),
    ("/our-people", "team", 7), ("/product", "products", 6), ("/service", "services", 6), ("/solutions", "products", 5),
    ("/catalog", "products", 5), ("/career", "careers", 3), ("/join", "careers", 3), ("/news", "news", 2),
    ("/blog", "blog", 2), ("/press", "news", 2), ("/media", "news", 2), ("/article", "news", 1), ("/privacy", "legal", 1),
    ("/terms", "legal", 1), ("/legal", "legal", 1), ("/cookie", "legal", 1), ("/gdpr", "legal", 1), ("/faq", "faq", 3),
    ("/help", "faq", 3), ("/support", "faq", 3),
)
HOME_PATHS = ("/", "/index.html", "/home", "/en", "/ar")
#: Order in which pages are worth reading.
PAGE_RANK = ("contact", "about", "team", "products", "services", "homepage", "faq", "careers", "news", "blog", "legal", "other")

_PARTS = r"^(?i:(https?):)?(?://)?([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def trimmed(url: Column) -> Column:
    return F.regexp_replace(url, r"^[\s ﻿]+|[\s ﻿]+$", "")


def is_url(url: Column) -> Column:
    """A text with a host: letters, digits, dots and hyphens with an optional port, with or without a scheme."""
    return trimmed(url).rlike(r"(?i)^(?:https?://)?[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?(?::\d+)?(?:[/?#]\S*)?$")


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(trimmed(url), _PARTS, n)


def domain(url: Column) -> Column:
    """Host in lower case without ``www.``; null for what is no URL."""
    return F.when(is_url(url), F.regexp_replace(F.lower(_part(url, 2)), r"^www\.", ""))


def path(url: Column) -> Column:
    """Path of a URL, ``/`` for an empty one."""
    p = _part(url, 3)
    return F.when(is_url(url), F.when(p == "", F.lit("/")).otherwise(p))


def _query(url: Column, keep_order: bool) -> Column:
    params = F.split(F.regexp_replace(_part(url, 4), r"^\?", ""), "&")
    kept = F.filter(params, lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING))
    ordered = kept if keep_order else F.array_sort(kept)
    return F.when(F.size(ordered) > 0, F.concat(F.lit("?"), F.array_join(ordered, "&"))).otherwise(F.lit(""))


def _path(url: Column) -> Column:
    p = path(url)
    return F.when((F.length(p) > 1) & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)


def canonical(url: Column) -> Column:
    """https, host without ``www.``, no slash at the end, parameters sorted and without tracking; the fragment stays."""
    built = F.concat(F.lit("https://"), domain(url), _path(url), _query(url, False), _part(url, 5))
    return F.when(is_url(url), built)


def normalised(url: Column) -> Column:
    """As :func:`canonical`, but scheme and order of parameters stay."""
    scheme = F.when(F.lower(_part(url, 1)) == "http", F.lit("http://")).otherwise(F.lit("https://"))
    return F.when(is_url(url), F.concat(scheme, domain(url), _path(url), _query(url, True), _part(url, 5)))


def without_parameters(url: Column) -> Column:
    """Only the tracking parameters are taken away."""
    scheme = F.when(F.lower(_part(url, 1)) == "http", F.lit("http://")).otherwise(F.lit("https://"))
    host = F.lower(_part(url, 2))
    return F.when(is_url(url), F.concat(scheme, host, path(url), _query(url, True), _part(url, 5)))


def same_resource(a: Column, b: Column) -> Column:
    return canonical(a) == canonical(b)


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def looks_parked(host: Column) -> Column:
    return F.lower(host).rlike(PARKED)


def page_kind(lower_path: Column) -> Column:
    """``struct<kind, confidence>`` of a page by its path in lower case (see :func:`with_page_kind`)."""
    pair = lambda k, c: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"))
    out = F.when(lower_path.isNull(), pair("other", 0.1)).when(lower_path.isin(*HOME_PATHS), pair("homepage", 0.95))
    for pattern, kind, priority in PAGE_KINDS:
        out = out.when(lower_path.contains(pattern), pair(kind, min(0.95, 0.5 + priority / 20)))
    return out.otherwise(pair("other", 0.3))


def with_page_kind(rows: DataFrame, url: str) -> DataFrame:
    """Add ``kind`` and ``kind_confidence``; the path is a column of its own, so that it is computed once."""
    known = rows.withColumn("_path", F.lower(path(F.col(url)))).withColumn("_kind", page_kind(F.col("_path")))
    return known.withColumns({"kind": F.col("_kind.kind"), "kind_confidence": F.col("_kind.confidence")}).drop("_path", "_kind")


def page_rank(kind: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, PAGE_RANK)), kind), F.lit(99)).cast("int")


def page_urls(base: Column, total: Column, most: int = 60) -> Column:
    """URLs of the pages 2..min(total, most) of a listing."""
    last = F.least(total, F.lit(most))
    join = F.when(base.contains("?"), F.lit("&page=")).otherwise(F.lit("?page="))
    numbers = F.when((total >= 2) & (last >= 2), F.sequence(F.lit(2), F.greatest(last, F.lit(2)))).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda n: F.concat(base, join, n.cast("string")))
