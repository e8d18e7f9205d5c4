"""Lookups, routing, crawl planning, bundles and exports. Each query has its SQL beside it where SQL can state it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import dedupe, pages, query
from ..operators.records import CATEGORIES, category_ids
from ..session import lookup_join, table
from . import sqltext as S
from .pages import page_table
from .relational import _MEMBERS, _members
from .relational import SQL as _RELATIONAL

QUERIES, SQL = {}, {}
#: Time stamp and id of queries that take them as arguments.
POINT_ID = "c000000003"


def plan(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@plan(f"SELECT pos, id, status FROM company WHERE id = '{POINT_ID}' ORDER BY pos LIMIT 1")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """At most one row by id (the limit is the feature); the predicate reaches the scan."""
    found = query.select_rows(table(spark, d, "company"), [("id", "==", POINT_ID)], "pos", limit=1)
    return found.select("pos", "id", "status")


# Texts in URLs of pages that need a browser, and in pages of a firewall.
HEAVY = r"(?i)\.aspx|angular|react|vue\.js|__dopostback|/home/factories"
BLOCKED = r"(?i)mod_security|not acceptable|access denied"


@plan(
    f"SELECT id, CASE WHEN url IS NULL OR NOT {S.matches('url', '(?i)^https?://')} THEN 'none' WHEN {S.matches('url', HEAVY)} THEN 'browser' WHEN {S.matches('url', '(?i)guide')} THEN 'http-only' ELSE 'http' END AS fetch_method,"
    f" CASE WHEN {S.matches('url', '(?i)[.]gov[.]|chamber')} THEN 90000 ELSE 45000 END AS timeout_ms, coalesce({S.matches('error_message', BLOCKED)}, false) AS is_blocked FROM job"
)
def fetch_routes(spark: SparkSession, d: str) -> DataFrame:
    """How each job's page would be fetched, its timeout, and whether the last answer was a firewall's."""
    u = F.col("url")
    method = F.when(u.isNull() | ~u.rlike("(?i)^https?://"), "none").when(u.rlike(HEAVY), "browser").when(u.rlike("(?i)guide"), "http-only").otherwise("http")
    timeout = F.when(u.rlike("(?i)[.]gov[.]|chamber"), 90_000).otherwise(45_000)
    blocked = F.coalesce(F.col("error_message").rlike(BLOCKED), F.lit(False))
    return table(spark, d, "job").select("id", method.alias("fetch_method"), timeout.alias("timeout_ms"), blocked.alias("is_blocked"))


@plan()
def crawl_plan(spark: SparkSession, d: str) -> DataFrame:
    """Links of each page on its own site, no files, ranked by kind; the ten to follow first."""
    p = pages.extracted(page_table(spark, d)).select("pos", "url", F.explode("page.links").alias("link"))
    own = urls.domain(F.col("link")) == urls.domain(F.col("url"))
    p = urls.with_page_kind(p.filter(own & ~F.col("link").rlike(urls.ASSETS)), "link")
    return query.top_per_group(p, ["pos"], [urls.page_rank(F.col("kind")), F.asc("link")], 10).select("pos", "link", "kind")


@plan(
    f"WITH p AS (SELECT pos, {S.domain('website_url')} AS site, {S.filled('lower(name_en)')} AS name FROM parsed_company), c AS (SELECT pos AS candidate, {S.domain('website_url')} AS site, {S.filled('lower(name_en)')} AS name FROM company),"
    " k AS (SELECT p.pos, c.candidate FROM p JOIN c ON p.site = c.site UNION SELECT p.pos, c.candidate FROM p JOIN c ON p.site IS NULL AND p.name = c.name)"
    " SELECT pos, candidate FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY candidate) AS n FROM k) WHERE n <= 50"
)
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Stored companies a listing may be: same site, else same name; at most fifty each (the limit is the feature)."""
    new = table(spark, d, "parsed_company").select("pos", urls.domain(F.col("website_url")).alias("site"), text.filled(F.lower("name_en")).alias("name"))
    old = table(spark, d, "company").select(F.col("pos").alias("candidate"), urls.domain(F.col("website_url")).alias("site"), text.filled(F.lower("name_en")).alias("name"))
    # a listing is met by one key only, so no more than the first fifty companies of a key can count
    first = lambda key: query.top_per_group(old.filter(F.col(key).isNotNull()).select("candidate", key), [key], [F.asc("candidate")], 50)
    by_site = new.filter("site is not null").select("pos", "site").join(first("site"), "site").select("pos", "candidate")
    by_name = new.filter("site is null").select("pos", "name").join(first("name"), "name").select("pos", "candidate")
    both = by_site.union(by_name).distinct()
    return query.top_per_group(both, ["pos"], [F.asc("candidate")], 50)


@plan(
    "SELECT 'counter' AS kind, event_type AS name, round(sum(value), 4) AS value FROM events GROUP BY 2 UNION ALL SELECT 'gauge', event_type, arg_max(value, (ts, event_id)) FROM events GROUP BY 2"
    " UNION ALL SELECT 'errors', 'share', round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE, 6) FROM events"
)
def system_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    one = e.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("c"), F.max_by("value", F.struct("ts", "event_id")).alias("g"))
    rows = F.explode(F.array(F.struct(F.lit("counter").alias("kind"), F.col("c").alias("value")), F.struct(F.lit("gauge").alias("kind"), F.col("g").alias("value"))))
    both = one.select(F.col("event_type").alias("name"), rows.alias("r")).select("r.kind", "name", "r.value")
    share = F.round(F.count_if(F.col("event_type") == "error") / F.count(F.lit(1)), 6)
    return both.unionByName(e.agg(share.alias("value")).select(F.lit("errors").alias("kind"), F.lit("share").alias("name"), "value"))


@plan("SELECT CASE WHEN queue_name LIKE '%seed%' OR queue_name LIKE '%parse%' THEN 'discovery' ELSE 'enrichment' END AS family, count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending FROM job GROUP BY 1")
def queue_families(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("queue_name")
    family = F.when(q.contains("seed") | q.contains("parse"), "discovery").otherwise("enrichment")
    return table(spark, d, "job").groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "pending").alias("pending"))


def _pool_sql(*fields: str) -> str:
    values = " UNION ALL ".join(f"SELECT group_id, {f} AS v FROM m" for f in fields)
    return f"(SELECT group_id, string_agg(DISTINCT v, ';' ORDER BY v) AS pool FROM ({values}) WHERE NOT {S.blank('v')} GROUP BY 1)"


@plan(
    f"WITH {_MEMBERS} SELECT g.group_id, e.pool AS emails, p.pool AS phones, s.pool AS socials FROM (SELECT DISTINCT group_id FROM m) g LEFT JOIN {_pool_sql('email')} e USING (group_id)"
    f" LEFT JOIN {_pool_sql('phone', 'whatsapp')} p USING (group_id) LEFT JOIN {_pool_sql('linkedin_url', 'instagram_url', 'twitter_url', 'facebook_url')} s USING (group_id)"
)
def contact_pools(spark: SparkSession, d: str) -> DataFrame:
    """All contacts of a duplicate group: what a merge keeps beside the surviving values."""

    def pool(*fields: str) -> Column:
        held = F.array_union(*(F.collect_set(F.when(~text.blank(F.col(f)), F.col(f))) for f in fields)) if len(fields) == 2 else F.collect_set(F.when(~text.blank(F.col(fields[0])), F.col(fields[0])))
        if len(fields) > 2:
            held = F.array_distinct(F.flatten(F.array(*(F.collect_set(F.when(~text.blank(F.col(f)), F.col(f))) for f in fields))))
        joined = F.array_join(F.array_sort(held), ";")
        return F.when(joined != "", joined)

    m = _members(spark, d)
    return m.groupBy("group_id").agg(pool("email").alias("emails"), pool("phone", "whatsapp").alias("phones"), pool("linkedin_url", "instagram_url", "twitter_url", "facebook_url").alias("socials"))


@plan("SELECT pos, name_en FROM company WHERE status = 'approved' ORDER BY name_en DESC, pos LIMIT 100")
def sorted_export(spark: SparkSession, d: str) -> DataFrame:
    """Filter, order (descending unless told otherwise), then the first hundred (a top-k report)."""
    t = table(spark, d, "company").filter("status = 'approved'").select("pos", "name_en")
    return t.orderBy(F.desc_nulls_first("name_en"), "pos").limit(100)


@plan("SELECT doc_id, crawled_at FROM documents WHERE text ILIKE '%catalogue%' ORDER BY crawled_at DESC, doc_id LIMIT 20 OFFSET 10")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a search, newest first."""
    hits = query.search(table(spark, d, "documents"), "text", "catalogue", [F.desc("crawled_at"), F.asc("doc_id")], 20, 10)
    return hits.select("doc_id", "crawled_at")


@plan(
    f"WITH s AS (SELECT pos, coalesce({S.domain('url')}, '') AS site FROM seed) SELECT pos, array_to_string({S.messages(*((f'contains(site, {S.lit(p)})', t) for p, t in (('chamber', 'chamber'), ('.gov', 'government'), ('guide', 'industry-guide'), ('portal', 'trade-portal'), ('yellow', 'directory'))))}, ',') AS tags FROM s"
)
def seed_tags(spark: SparkSession, d: str) -> DataFrame:
    site = F.coalesce(urls.domain(F.col("url")), F.lit(""))
    tags = (("chamber", "chamber"), (".gov", "government"), ("guide", "industry-guide"), ("portal", "trade-portal"), ("yellow", "directory"))
    held = F.filter(F.array(*(F.when(site.contains(p), F.lit(t)) for p, t in tags)), lambda x: x.isNotNull())
    return table(spark, d, "seed").select("pos", F.array_join(held, ",").alias("tags"))


@plan("SELECT id, string_agg(coalesce(source_url, 'https://directory.example/'), ' ' ORDER BY pos) AS urls, count(*) AS n_pages FROM company GROUP BY 1")
def raw_bundles(spark: SparkSession, d: str) -> DataFrame:
    """The fetched pages of each company in order, as one row (a crawl bounds the pages of a site)."""
    p = page_table(spark, d).join(table(spark, d, "company").select("pos", "id"), "pos")
    held = F.sort_array(F.collect_list(F.struct("pos", "url")))
    return p.groupBy("id").agg(F.array_join(F.transform(held, lambda x: x["url"]), " ").alias("urls"), F.count(F.lit(1)).alias("n_pages"))


_API = "struct<data: struct<result: struct<data: array<struct<name: string, subdomain: string, details: string>>>>, result: struct<data: array<struct<name: string, subdomain: string, details: string>>>>"


@plan("SELECT id, name_en AS name, slug AS subdomain FROM company WHERE name_en IS NOT NULL AND length(trim(name_en)) > 1")
def json_api_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a JSON answer with its list at one of several paths (the answer is made from each stored company)."""
    item = F.array(F.struct(F.col("name_en").alias("name"), F.col("slug").alias("subdomain")))
    t = table(spark, d, "company").select("id", F.to_json(F.struct(F.struct(F.struct(item.alias("data")).alias("result")).alias("data"))).alias("answer"))
    read = F.from_json("answer", _API)
    rows = t.select("id", F.explode(F.coalesce(read["data"]["result"]["data"], read["result"]["data"])).alias("v"))
    return rows.filter(F.length(F.trim("v.name")) > 1).select("id", F.col("v.name").alias("name"), F.col("v.subdomain").alias("subdomain"))


@plan()
def markdown_records(spark: SparkSession, d: str) -> DataFrame:
    """Records in markdown sections (made from stored companies): heading, labelled lines, first lines as description."""
    c = table(spark, d, "company").filter("name_en is not null")
    e = lambda f: F.coalesce(F.regexp_replace(f, "\\s+", " "), F.lit(""))
    md = F.concat(F.lit("### "), e("name_en"), F.lit("\n"), e("scope_en"), F.lit("\nWebsite: "), e("website_url"), F.lit("\nPhone: "), e("phone"), F.lit("\n"))
    return markdown_sections(c.select("id", md.alias("md")), "id", "md")


def markdown_sections(rows: DataFrame, key: str, md: str) -> DataFrame:
    """``name, website, email, phone, location`` of every ``###`` section; the first of a repeated name in a text."""
    split = F.split(F.concat(F.lit("\n"), F.col(md)), r"\n\s*###\s+")
    s = rows.select(key, F.posexplode(split).alias("place", "section")).filter("place > 0")
    name = text.trim(F.substring_index("section", "\n", 1))
    label = lambda n: text.labelled(F.col("section"), n)
    s = s.select(key, "place", name.alias("name"), urls.canonical(label("Website")).alias("website"), label("Email").alias("email"), label("Phone").alias("phone"), label("Location").alias("location"))
    s = s.filter("name <> ''").withColumn("low", F.lower("name"))
    return query.first_per_key(s, [key, "low"], "place").select(key, "name", "website", "email", "phone", "location")


_SENT = ("logo_url", "linkedin_url", "phone", "email", "description_en", "description_ar", "instagram_url", "facebook_url")
_CASES = " ".join(f"WHEN {S.lit(x)} THEN {S.lit(i)}" for i, _, ar in CATEGORIES for x in (i, ar))
_LOWER = " ".join(f"WHEN {S.lit(en.lower())} THEN {S.lit(i)}" for i, en, _ in CATEGORIES)
_MAPPED = f"list_transform(list_filter(list_transform(categories, lambda x: {S.trim('x')}), lambda x: x <> ''), lambda x: CASE x {_CASES} ELSE CASE lower(x) {_LOWER} ELSE x END END)"


@plan(
    f"SELECT pos, {', '.join(f'nullif({f}, {S.lit(str())}) AS {f}' for f in _SENT)}, {S.trim('nullif(full_address, ' + S.lit('') + ')')} AS full_address,"
    f" array_to_string({_MAPPED}, '|') AS categories, array_to_string(products, '|') AS products, true AS is_vat_registered, confidence_score FROM parsed_company"
)
def enrichment_updates(spark: SparkSession, d: str) -> DataFrame:
    """Whitelisted, typed fields of JSON updates (made from listings): blanks dropped, lists of texts only."""
    t = table(spark, d, "parsed_company")
    sent = (*_SENT, "full_address", "categories", "products", "confidence_score", F.lit(" Yes").alias("is_vat_registered"), F.lit(1).alias("unknown"))
    out = enrichment(t.select("pos", F.to_json(F.struct(*sent)).alias("answer")), "pos", "answer")
    return out.select("pos", *_SENT, "full_address", F.array_join("categories", "|").alias("categories"), F.array_join("products", "|").alias("products"), "is_vat_registered", "confidence_score")


# Fields an enrichment may change, by their kind.
ENRICHED_TEXTS = (
    "logo_url", "linkedin_url", "sales_email", "procurement_email", "phone", "email", "seo_title_en", "seo_title_ar",
    "seo_description_en", "seo_description_ar", "description_en", "description_ar", "instagram_url", "twitter_url",
    "facebook_url", "cr_number", "vat_number", "chamber_commerce_id", "procurement_portal_url",
)
ENRICHED_LISTS = ("secondary_emails", "secondary_phones", "secondary_websites", "secondary_linkedin", "secondary_socials")


def enrichment(rows: DataFrame, key: str, answer: str) -> DataFrame:
    """The thirty fields of an update that may be changed; all others are left out, empty ones are null."""
    lists = (*ENRICHED_LISTS, "categories", "products", "fields")
    kinds = [f"{f}: string" for f in (*ENRICHED_TEXTS, "full_address", "is_vat_registered")] + [f"{f}: array<string>" for f in lists]
    v = F.from_json(answer, f"struct<{', '.join(kinds)}, confidence_score: double>")
    low = F.lower(text.trim(v["is_vat_registered"]))
    flag = F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)
    only = lambda f: F.filter(v[f], lambda x: x.isNotNull())
    return rows.select(
        key,
        *(F.nullif(v[f], F.lit("")).alias(f) for f in ENRICHED_TEXTS),
        text.trim(F.nullif(v["full_address"], F.lit(""))).alias("full_address"),
        category_ids(only("categories")).alias("categories"),
        only("products").alias("products"),
        F.filter(F.transform(only("fields"), text.trim), lambda x: x != "").alias("fields"),
        *(v[f].alias(f) for f in ENRICHED_LISTS),
        flag.alias("is_vat_registered"),
        v["confidence_score"].alias("confidence_score"),
    )


@plan(
    "SELECT e.company_id, e.field_name, arg_max(e.value, (e.confidence, e.value)) AS value FROM evidence e JOIN (SELECT DISTINCT id FROM company) c ON c.id = e.company_id WHERE e.value <> '' AND e.confidence > 0 GROUP BY 1, 2"
)
def best_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The most confident value of each field of each known company."""
    known = table(spark, d, "company").select(F.col("id").alias("company_id")).distinct()
    e = table(spark, d, "evidence").filter("value <> '' and confidence > 0").join(known, "company_id", "left_semi")
    return e.groupBy("company_id", "field_name").agg(F.max_by("value", F.struct("confidence", "value")).alias("value"))


@plan(
    f"WITH s AS (SELECT source_url, count(*) AS n, count(*) FILTER (WHERE {S.blank('website_url')}) AS no_site FROM parsed_company GROUP BY 1) SELECT p.pos, s.n AS page_rows FROM parsed_company p JOIN s USING (source_url) WHERE s.no_site * 2 > s.n"
)
def weak_pages(spark: SparkSession, d: str) -> DataFrame:
    """Rows of pages most of whose rows have no site: a join back to a per-page aggregate, hot pages broadcast."""
    t = table(spark, d, "parsed_company").select("pos", "source_url", text.blank(F.col("website_url")).alias("b"))
    s = t.groupBy("source_url").agg(F.count(F.lit(1)).alias("n"), F.count_if("b").alias("no_site")).filter("no_site * 2 > n").select("source_url", "n")
    return lookup_join(t, s, ["source_url"], "n").select("pos", F.col("n").alias("page_rows"))


@plan(
    f"WITH v AS ({_RELATIONAL['majority_vote']}), {_MEMBERS}, i AS (SELECT group_id, string_agg(id, ',' ORDER BY place) AS source_ids, count(*) AS n FROM m GROUP BY 1)"
    f" SELECT group_id, source_ids, {', '.join(f'(SELECT value FROM v WHERE v.group_id = i.group_id AND field = {S.lit(f)}) AS {f}' for f in ('name_en', 'city', 'phone'))} FROM i WHERE n >= 2"
)
def resolved_entities(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate groups resolved by majority, with the ids that went in: the merge log."""
    return resolved(_members(spark, d), "majority", ("name_en", "city", "phone"))


@plan(
    f"WITH v AS ({_RELATIONAL['prefer_latest']}), {_MEMBERS}, i AS (SELECT group_id, string_agg(id, ',' ORDER BY place) AS source_ids, count(*) AS n FROM m GROUP BY 1)"
    " SELECT i.group_id, source_ids, v.name_en, v.city, v.phone FROM i JOIN v USING (group_id) WHERE n >= 2"
)
def resolved_by_latest(spark: SparkSession, d: str) -> DataFrame:
    return resolved(_members(spark, d), "latest", ("name_en", "city", "phone"))


def resolved(members: DataFrame, strategy: str, fields: tuple[str, ...]) -> DataFrame:
    """Groups of two or more resolved by a strategy (``master``, ``latest`` or ``majority``), with the ids that went in."""
    if strategy == "majority":
        values = dedupe.majority(members, fields).groupBy("group_id").pivot("field", list(fields)).agg(F.first("value"))
    elif strategy in ("master", "latest"):
        values = dedupe.preferred(members, fields, latest=strategy == "latest")
    else:
        raise ValueError(f"unknown strategy {strategy}")
    ids = members.groupBy("group_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]), ",").alias("source_ids"), F.count(F.lit(1)).alias("_n"))
    return ids.filter("_n >= 2").drop("_n").join(values, "group_id", "left")
