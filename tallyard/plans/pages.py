"""Queries over pages, robots texts and streams. Pages are an input table; the fixture here is inline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import pages
from ..session import table
from ..streaming import live
from . import sqltext as S

QUERIES, SQL = {}, {}


def plan(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def page_table(spark: SparkSession, d: str) -> DataFrame:
    """A page for every company: the markup of a directory profile, made from its row (no fetching)."""
    c = table(spark, d, "company")
    e = lambda f: F.coalesce(F.regexp_replace(F.col(f), "[<>&]", " "), F.lit(""))
    html = F.concat(
        F.lit("<html><head><title>"), e("name_en"), F.lit(' - Directory</title><meta name="description" content="'),
        F.regexp_replace(e("description_en"), '"', "'"), F.lit('"></head><body><div class="logo"><img src="'), e("logo_url"),
        F.lit('"></div><h1>'), e("name_en"), F.lit("</h1><p>"), e("description_en"), F.lit("<p>Phone: "), e("phone"),
        F.lit('<br>Email: <a href="mailto:'), e("email"), F.lit('">mail</a><address>'), e("full_address"),
        F.lit('</address><div>Website: <a href="'), e("website_url"), F.lit('">site</a></div><a href="'), e("linkedin_url"), F.lit('">in</a></body></html>'),
    )
    return c.select("pos", F.coalesce("source_url", F.lit("https://directory.example/")).alias("url"), html.alias("html"), F.lit(200).alias("status"))


@plan()
def page_extract(spark: SparkSession, d: str) -> DataFrame:
    """Name, description, contacts, site and logo read from each page."""
    p = pages.extracted(page_table(spark, d))
    kept = [F.col(f"page.{f}.value").alias(f) for f in ("name", "description", "address", "website", "logo")]
    return p.select("pos", *kept, F.array_join("page.emails", ";").alias("emails"), F.array_join("page.phones", ";").alias("phones"))


@plan()
def page_listings(spark: SparkSession, d: str) -> DataFrame:
    """Rows parsed from one table page for each city by the parser its URL is routed to."""
    c = table(spark, d, "company").filter("city is not null and name_en is not null")
    row = F.concat(F.lit("<tr><td>"), F.regexp_replace("name_en", "[<>&]", " "), F.lit("<td>"), F.coalesce("phone", F.lit("")))
    at = F.pmod(F.xxhash64("pos"), F.lit(64))  # pages of bounded length, however large the city
    listed = c.groupBy("city", at.alias("page_no")).agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    html = F.concat(F.lit("<table><tr><th>Company name<th>Phone"), "rows", F.lit("</table>"))
    url = F.concat(F.lit("https://guide-directory.example/list?city="), F.regexp_replace("city", " ", "-"))
    found = pages.listings(listed.select("city", url.alias("url"), html.alias("html")))
    return found.select("city", "adapter", "strategy", "name_en", "phone")


@plan()
def site_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for each site from its pages."""
    p = pages.extracted(urls.with_page_kind(page_table(spark, d), "url"))
    p = p.withColumn("site", urls.domain(F.col("url")))
    out = pages.combined(p)
    return out.select("site", "name", "phone", "email", "n_pages")


@plan()
def site_checks(spark: SparkSession, d: str) -> DataFrame:
    return pages.site_check(pages.extracted(page_table(spark, d))).select("pos", "state", "confidence", "is_valid")


_ROUTES = " UNION ALL ".join(f"SELECT {-i} AS i, {score} AS s, {S.lit(kind)} AS kind, {S.lit(p)} AS p" for i, (kind, p, score, _) in enumerate(pages.ADAPTERS))


@plan(
    f"WITH a AS ({_ROUTES}) SELECT pos, arg_max(kind, (s, i)) AS adapter FROM parsed_company, a WHERE p = '' OR regexp_matches(source_url, p) GROUP BY pos"
)
def adapter_route(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_company").select("pos", pages.adapter_of(F.col("source_url")).alias("adapter"))


_ROBOTS = "User-agent: *\nDisallow: /products\nAllow: /products/list\nCrawl-delay: 2\n\nUser-agent: tallyard\nUser-agent: other # both\nDisallow: /en/*.html$\nDisallow: /contact"


@plan(
    f"WITH u AS (SELECT DISTINCT {S.domain('website_url')} AS domain, {S.path('website_url')} AS path FROM parsed_company)"
    " SELECT domain, path, NOT (regexp_matches(path, '^/en/.*\\.html$') OR starts_with(path, '/contact')) AS allowed, 0 AS crawl_delay FROM u WHERE domain IS NOT NULL"
)
def robots_filter(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("website_url")
    seen = table(spark, d, "parsed_company").select(urls.domain(u).alias("domain"), urls.path(u).alias("path")).filter("domain is not null").distinct()
    robots = seen.select("domain").distinct().withColumn("text", F.lit(_ROBOTS))
    return pages.robots_allowed(seen, pages.robots_rules(robots), "tallyard").select("domain", "path", "allowed", "crawl_delay")


@plan("SELECT event_type, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1")
def stream_counters(spark: SparkSession, d: str) -> DataFrame:
    like = table(spark, d, "events")
    return live.run_to_end(live.counters(live.source(spark, f"{d}/events.parque[t]", like), ["event_type"], "value"), "complete")


@plan(
    "SELECT * FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"
)
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    like = table(spark, d, "events")
    stream = live.source(spark, f"{d}/events.parque[t]", like).withColumn("ts", F.col("ts").cast("timestamp"))
    return live.run_to_end(live.windowed(stream, "ts", ["event_type"]), "append")


@plan(
    f"WITH r AS (SELECT id, {S.domain('url')} AS site, created_at, epoch_us(created_at) AS t FROM job WHERE url IS NOT NULL),"
    " n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY t, id) AS i FROM r),"
    " g AS (SELECT *, max(t - i * 2000000) OVER (PARTITION BY site ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + i * 2000000 AS g FROM n)"
    " SELECT id, site, CAST(floor((g - t) / 1000.0) AS BIGINT) AS waited_ms FROM g"
)
def request_slots(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "job").filter("url is not null").select("id", urls.domain(F.col("url")).alias("site"), "created_at")
    jobs = jobs.withColumn("site", F.coalesce("site", F.lit("")))
    out = live.granted_slots(jobs, "site", "created_at", "id", 2000, F.to_date("created_at"))
    return out.select("id", F.when(F.col("site") != "", F.col("site")).alias("site"), "waited_ms")
