"""Queue lifecycle, batch accounting, metric fan-out, candidate pickers and source conversions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import jobs, pages, records
from ..session import lookup_join, table
from ..sources import exports
from . import sqltext as S

QUERIES, SQL = {}, {}
#: The time at which the queries of queues are asked.
NOW = "2025-01-01 00:00:00"
_NOW = f"TIMESTAMPTZ '{NOW}+00'"


def plan(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


_DUE = f"status = 'pending' AND (scheduled_at IS NULL OR scheduled_at <= {_NOW})"
_CLAIM = f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY queue_name ORDER BY priority DESC, created_at, id) AS n FROM job WHERE {_DUE}) WHERE n = 1"


@plan(
    f"WITH c AS ({_CLAIM}) SELECT j.id, j.queue_name, CASE WHEN c.id IS NOT NULL THEN 'processing' ELSE j.status END AS status,"
    f" CASE WHEN c.id IS NOT NULL THEN 'w1' ELSE j.worker_id END AS worker_id FROM job j LEFT JOIN c ON c.id = j.id"
)
def claim_jobs(spark: SparkSession, d: str) -> DataFrame:
    """All jobs after one worker claimed the next due one of each queue."""
    return jobs.claimed(table(spark, d, "job"), "w1", now()).select("id", "queue_name", "status", "worker_id")


@plan(f"SELECT id, 'completed' AS status, {_NOW} AS completed_at FROM job WHERE status = 'processing'")
def complete_jobs(spark: SparkSession, d: str) -> DataFrame:
    return jobs.completed(table(spark, d, "job").filter("status = 'processing'"), now()).select("id", "status", "completed_at")


@plan(
    f"SELECT id, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= max_attempts THEN 'dead_letter' ELSE 'pending' END AS status, 'Timeout' AS error_message,"
    f" CASE WHEN attempts + 1 >= max_attempts THEN {_NOW} ELSE {_NOW} + to_microseconds(CAST(pow(2, attempts) AS BIGINT) * 1000000) END AS scheduled_at FROM job WHERE status = 'processing'"
)
def fail_jobs(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of the jobs in work when all of them fail."""
    out = jobs.failed(table(spark, d, "job").filter("status = 'processing'"), F.lit("Timeout"), now())
    return out.select("id", "attempts", "status", "error_message", "scheduled_at")


@plan(
    "SELECT id, queue_name, 'pending' AS status, 0 AS attempts FROM (SELECT *, row_number() OVER (PARTITION BY queue_name ORDER BY created_at DESC, id) AS n FROM job WHERE status = 'dead_letter') WHERE n <= 1000"
)
def retry_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Dead letters queued again, at most a thousand of each queue."""
    return jobs.retried(table(spark, d, "job"), now(), "dead_letter").select("id", "queue_name", "status", "attempts")


_HANDLER = "CASE queue_name " + " ".join(f"WHEN '{q}' THEN '{h}'" for q, h in jobs.HANDLERS.items()) + " END"


@plan(
    f"SELECT id, {_HANDLER} AS handler, CASE WHEN {_HANDLER} IS NULL THEN 'No processor configured for queue \"' || queue_name || '\"'"
    f" WHEN {_HANDLER} IN ('fetch', 'resolve') AND {S.blank('url')} THEN 'Job has no url' END AS error FROM job"
)
def route_jobs(spark: SparkSession, d: str) -> DataFrame:
    return jobs.routed(table(spark, d, "job")).select("id", "handler", "error")


@plan(
    "WITH f AS (SELECT event_type AS tag, 'event_total' AS metric, 1.0::DOUBLE AS value FROM events UNION ALL SELECT event_type, 'event_value', value FROM events"
    " UNION ALL SELECT event_type, 'event_success', CASE WHEN event_type = 'error' THEN 0 ELSE 1 END FROM events UNION ALL SELECT event_type, 'event_slow', 1 FROM events WHERE value > 50)"
    " SELECT metric, tag, count(*) AS n, round(sum(value), 4) AS total FROM f GROUP BY 1, 2"
)
def metric_fanout(spark: SparkSession, d: str) -> DataFrame:
    """One event as the points of several metrics, some of them only under a condition, then their counters."""
    e = table(spark, d, "events")
    point = lambda name, value: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
    ok = F.when(F.col("event_type") == "error", 0).otherwise(1)
    points = F.array(
        point("event_total", F.lit(1)), point("event_value", F.col("value")), point("event_success", ok),
        F.when(F.col("value") > 50, point("event_slow", F.lit(1))),
    )
    kept = F.explode(F.filter(points, lambda p: p.isNotNull()))
    rows = e.select(F.col("event_type").alias("tag"), kept.alias("p")).select("tag", "p.*")
    return rows.groupBy("metric", "tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@plan(
    "SELECT coalesce(source, 'unknown') AS provider, count(*) AS calls, CAST(sum(round(length(text) / 4.0)) AS BIGINT) AS tokens, CAST(max(round(length(text) / 4.0)) AS BIGINT) AS most FROM documents GROUP BY 1"
)
def token_sums(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of the texts of each source."""
    t = table(spark, d, "documents").select(F.coalesce("source", F.lit("unknown")).alias("provider"), text.token_estimate(F.col("text")).alias("t"))
    return t.groupBy("provider").agg(F.count(F.lit(1)).alias("calls"), F.sum("t").alias("tokens"), F.max("t").alias("most"))


_PASSED = f"(NOT {S.blank('name_en')} AND coalesce(confidence_score BETWEEN 0 AND 1, false))"


@plan(
    f"WITH n AS (SELECT *, (row_number() OVER (ORDER BY pos) - 1) // 100 AS batch FROM parsed_company) SELECT batch, count(*) AS n, count(*) FILTER (WHERE NOT {_PASSED}) AS errors,"
    f" count(*) FILTER (WHERE {_PASSED}) AS migrated FROM n GROUP BY 1"
)
def batch_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Rows written in batches of a hundred, with what each batch wrote and refused."""
    t = table(spark, d, "parsed_company").select("pos", "name_en", "confidence_score")
    passed = ~text.blank(F.col("name_en")) & F.coalesce(F.col("confidence_score").between(0, 1), F.lit(False))
    numbered = exports.with_ids(t.select("pos", passed.alias("ok")), "pos", 0)
    batch = F.floor((F.col("new_id") - 1) / 100).cast("long").alias("batch")
    return numbered.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("errors"), F.count_if("ok").alias("migrated"))


@plan(
    f"SELECT 'parsed_company' AS table_name, count(*) FILTER (WHERE {_PASSED}) AS migrated, CAST(sum(greatest(0, CASE WHEN {_PASSED} THEN -1 ELSE 1 END)) AS BIGINT) AS errors FROM parsed_company"
)
def migration_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals over the batches; an unknown number of errors (negative) counts as none."""
    t = table(spark, d, "parsed_company")
    passed = ~text.blank(F.col("name_en")) & F.coalesce(F.col("confidence_score").between(0, 1), F.lit(False))
    errors = F.sum(F.greatest(F.lit(0), F.when(passed, -1).otherwise(1)))
    return t.agg(F.count_if(passed).alias("migrated"), errors.alias("errors")).select(F.lit("parsed_company").alias("table_name"), "migrated", "errors")


@plan(f"SELECT count(DISTINCT {S.domain('url')}) AS size, min({S.domain('url')}) AS first_site, max({S.domain('url')}) AS last_site FROM job")
def robots_cache_stats(spark: SparkSession, d: str) -> DataFrame:
    """How many sites have cached rules, and the first and last of them."""
    site = urls.domain(F.col("url"))
    rows = table(spark, d, "job").select(site.alias("site"))
    return rows.agg(F.count_distinct("site").alias("size"), F.min("site").alias("first_site"), F.max("site").alias("last_site"))


@plan(
    "SELECT DISTINCT user_id, CASE user_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'moderator' WHEN 2 THEN 'admin' END AS role, coalesce(user_id % 4 IN (1, 2), false) AS may_moderate FROM events"
)
def role_order(spark: SparkSession, d: str) -> DataFrame:
    """Role of each user, and whether it is a moderator's or higher; an unknown role is below all."""
    kind = F.col("user_id") % 4
    role = F.when(kind == 0, "user").when(kind == 1, "moderator").when(kind == 2, "admin")
    return table(spark, d, "events").select("user_id").distinct().select("user_id", role.alias("role"), role_at_least(role, "moderator").alias("may_moderate"))


# Roles from the least to the most.
ROLES = ("user", "moderator", "admin")


def role_at_least(role: Column, wanted: str) -> Column:
    place = F.array_position(F.array(*map(F.lit, ROLES)), role)
    return F.coalesce(place >= ROLES.index(wanted) + 1, F.lit(False))


@plan(
    "SELECT pos, id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_at, strftime(coalesce(updated_at, created_at) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS updated_at FROM company"
)
def timestamps_iso(spark: SparkSession, d: str) -> DataFrame:
    """Times as ISO texts of milliseconds, the time of change being that of making where it is missing."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return table(spark, d, "company").select("pos", "id", iso(F.col("created_at")).alias("created_at"), iso(F.coalesce("updated_at", "created_at")).alias("updated_at"))


DDL = 'create table if not exists public.companies (id text);\nCREATE TABLE "cities" (id int);\ncreate table cities (x int);\n-- drop table old;\ncreate table if not exists seeds(id int);'
_TABLES = r'(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?(?:public\.)?"?(\w+)"?'


@plan(f"SELECT DISTINCT unnest(regexp_extract_all({S.lit(DDL)}, {S.lit(_TABLES)}, 1)) AS table_name")
def table_names(spark: SparkSession, d: str) -> DataFrame:
    """Tables that a definition file makes."""
    ddl = spark.createDataFrame([(DDL,)], "ddl string")
    return ddl.select(F.explode(F.array_distinct(F.regexp_extract_all("ddl", F.lit(_TABLES), F.lit(1)))).alias("table_name"))


# Signs of address lines and of places in them.
_OPPOSITE, _STREET = "(?i)opposite|opp", "(?i)street|road|rd\\.|st\\."
_PLACES = "(?i)al\\s+khobar|khobar|riyadh|jeddah|dammam|medina|mecca|tabuk|yanbu|najran|jazan"
_SCORE = (
    f"(CASE WHEN {S.matches('full_address', _OPPOSITE)} THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN {S.matches('full_address', _STREET)} THEN 2 ELSE 0 END + CASE WHEN {S.matches('full_address', _PLACES)} THEN 2 ELSE 0 END"
    " + CASE WHEN contains(full_address, ',') THEN 1 ELSE 0 END + greatest(0, 200 - length(full_address)) / 50.0::DOUBLE)"
)


@plan(f"SELECT source_url, arg_max(full_address, ({_SCORE}, -pos)) AS address FROM parsed_company WHERE full_address IS NOT NULL GROUP BY 1")
def best_address_line(spark: SparkSession, d: str) -> DataFrame:
    """The best of a page's address lines: signs of a street and a place, commas, and rather short (an aggregate, no sort)."""
    a = F.col("full_address")
    point = lambda test, n: F.when(test, float(n)).otherwise(0.0)
    score = point(a.rlike(_OPPOSITE), 3) + point(a.rlike(_STREET), 2) + point(a.rlike(_PLACES), 2) + point(a.contains(","), 1)
    score = score + F.greatest(F.lit(0), 200 - F.length(a)) / 50.0
    t = table(spark, d, "parsed_company").select("source_url", "full_address", "pos").filter(a.isNotNull())
    return t.groupBy("source_url").agg(F.max_by("full_address", F.struct(score, -F.col("pos"))).alias("address"))


_PHONES = r"\+?\d[\d\s\-()]{6,30}"
_FOUND = f"list_filter(list_transform(regexp_extract_all(phone, '{_PHONES}'), lambda m: regexp_replace(regexp_replace(m, '[^0-9+]', '', 'g'), '^00', '+')), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 7 AND 15)"


@plan(f"SELECT pos, CASE WHEN {_FOUND}[1] LIKE '+%' THEN {_FOUND}[1] ELSE '+' || {_FOUND}[1] END AS picked FROM parsed_company")
def phone_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The first run of digits in a text that can be a telephone number."""
    found = F.transform(F.regexp_extract_all("phone", F.lit(_PHONES), F.lit(0)), lambda m: F.regexp_replace(F.regexp_replace(m, "[^0-9+]", ""), "^00", "+"))
    first = F.get(F.filter(found, lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")).between(7, 15)), 0)
    picked = F.when(first.startswith("+"), first).otherwise(F.concat(F.lit("+"), first))
    return table(spark, d, "parsed_company").select("pos", picked.alias("picked"))


_HOSTNAME = r"(?i)^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$"


def _candidate_sql(x: str) -> str:
    v = S.trim(S.sub(S.trim(x), r"[)\].,;]+$"))
    v = S.trim(f"regexp_replace({v}, '(?i)(email|phone|location).*', '')")
    v = S.trim(f"regexp_replace({v}, '(?i)^website\\s*[:\\-]?\\s*', '')")
    bare = f"regexp_replace({v}, '(?i)^www\\.', '')"
    return f"CASE WHEN {S.matches(v, '(?i)^https?://')} THEN {v} WHEN {S.matches(f'regexp_extract({bare}, {S.lit(chr(94) + "[^/" + chr(92) + "s]*")})', _HOSTNAME)} THEN 'https://' || {bare} END"


@plan(f"SELECT pos, {_candidate_sql('website_url')} AS candidate FROM parsed_company")
def website_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Links picked from free text: closing signs and labels taken off, a bare host gets its scheme, anything else is none."""
    v = text.trim(F.regexp_replace(text.trim(F.col("website_url")), r"[)\].,;]+$", ""))
    v = text.trim(F.regexp_replace(v, "(?i)(email|phone|location).*", ""))
    v = text.trim(F.regexp_replace(v, r"(?i)^website\s*[:\-]?\s*", ""))
    t = table(spark, d, "parsed_company").select("pos", v.alias("v"))
    bare = F.regexp_replace("v", r"(?i)^www\.", "")
    host = F.regexp_extract(bare, r"^[^/\s]*", 0)
    return t.select("pos", F.when(F.col("v").rlike("(?i)^https?://"), F.col("v")).when(host.rlike(_HOSTNAME), F.concat(F.lit("https://"), bare)).alias("candidate"))


_DIRTY = "'<script>x()</script> onload=' || {0} || ' <IFRAME a=1></iframe>JavaScript:vbscript:' || ' onerror='"


def _clean_sql(x: str) -> str:
    t = S.sub(x, r"(?is)<script\b.*?</script>|<iframe\b.*?</iframe>")
    return S.trim(S.sub(t, r"(?i)javascript:|vbscript:|onload=|onerror="))


@plan(
    f"SELECT pos, {_clean_sql(_DIRTY.format('name_en'))} AS name_en, {_clean_sql(_DIRTY.format('email'))} AS email,"
    f" CASE WHEN website_url LIKE 'http://%' OR website_url LIKE 'https://%' THEN {_clean_sql('website_url')} WHEN website_url <> '' THEN {_clean_sql(chr(39) + 'https://' + chr(39) + ' || website_url')} ELSE website_url END AS website_url,"
    f" array_to_string(list_transform(categories, lambda c: {_clean_sql(_DIRTY.format('c'))}), '|') AS categories FROM parsed_company"
)
def sanitised_records(spark: SparkSession, d: str) -> DataFrame:
    """Records without scripts, frames, script protocols and handlers (put into each value here), links with a scheme."""
    t = table(spark, d, "parsed_company").select("pos", "name_en", "email", "website_url", "categories")
    dirty = lambda c: F.concat(F.lit("<script>x()</script> onload="), c, F.lit(" <IFRAME a=1></iframe>JavaScript:vbscript: onerror="))
    t = t.withColumns({"name_en": dirty(F.col("name_en")), "email": dirty(F.col("email")), "categories": F.transform("categories", dirty)})
    out = records.sanitised_record(t)
    return out.select("pos", "name_en", "email", "website_url", F.array_join("categories", "|").alias("categories"))


_CHANGED = "(SELECT id, pos + 1000000 AS pos, 'changed' AS status, updated_at + to_microseconds(CASE WHEN pos % 2 = 0 THEN 1 ELSE -1 END) AS updated_at FROM company WHERE status = 'approved' UNION ALL SELECT 'new-' || id, pos + 2000000, 'new', updated_at FROM company WHERE status = 'rejected')"


@plan(
    f"SELECT id, pos, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, pos DESC) AS n FROM (SELECT id, pos, status, updated_at FROM company UNION ALL SELECT * FROM {_CHANGED})) WHERE n = 1"
)
def upsert_changes(spark: SparkSession, d: str) -> DataFrame:
    """Stored records after newer and older versions of some and new records of others came in."""
    t = table(spark, d, "company").select("id", "pos", "status", "updated_at")
    step = F.when(F.col("pos") % 2 == 0, 1).otherwise(-1)
    moved = F.timestamp_micros(F.unix_micros("updated_at") + step)
    changed = t.filter("status = 'approved'").select("id", (F.col("pos") + 1_000_000).alias("pos"), F.lit("changed").alias("status"), moved.alias("updated_at"))
    new = t.filter("status = 'rejected'").select(F.concat(F.lit("new-"), "id").alias("id"), (F.col("pos") + 2_000_000).alias("pos"), F.lit("new").alias("status"), "updated_at")
    return exports.upserted(t, changed.union(new), ["id"], ["updated_at", "pos"]).select("id", "pos", "status")


@plan(
    f"WITH s AS (SELECT source_url, count(*) AS n FROM parsed_company GROUP BY 1), e AS (SELECT source_url, arg_max(value, (confidence, value)) AS found FROM evidence WHERE field_name = 'phone' AND value <> '' AND confidence > 0 GROUP BY 1)"
    f" SELECT p.pos, CASE WHEN s.n = 1 AND {S.blank('p.phone')} THEN e.found ELSE p.phone END AS phone FROM parsed_company p JOIN s USING (source_url) LEFT JOIN e USING (source_url)"
)
def fill_single_pages(spark: SparkSession, d: str) -> DataFrame:
    """Blank telephones filled from what was found on the page, only where the page has exactly one company."""
    t = table(spark, d, "parsed_company").select("pos", "source_url", "phone")
    e = table(spark, d, "evidence").filter("field_name = 'phone' and value <> '' and confidence > 0")
    found = e.groupBy("source_url").agg(F.max_by("value", F.struct("confidence", "value")).alias("found"))
    sizes = t.groupBy("source_url").agg(F.count(F.lit(1)).alias("n")).join(found, "source_url", "left")
    joined = lookup_join(t, sizes, ["source_url"], "n")
    return joined.select("pos", F.when((F.col("n") == 1) & text.blank(F.col("phone")), F.col("found")).otherwise(F.col("phone")).alias("phone"))


@plan(
    f"SELECT pos, CASE WHEN coalesce({S.matches('lower(' + S.domain('website_url') + ')', urls.PARKED)}, false) THEN 'parked' WHEN coalesce({S.matches('website_url', '(?i)^https?://[^/?#' + chr(92) + 's]+')}, false) THEN 'valid' ELSE 'invalid' END AS part FROM parsed_company WHERE website_url <> ''"
)
def website_partition(spark: SparkSession, d: str) -> DataFrame:
    """Links of records as valid, invalid and parked, before any page is fetched; records without one are in no part."""
    u = F.col("website_url")
    part = F.when(F.coalesce(urls.looks_parked(urls.domain(u)), F.lit(False)), "parked").when(urls.is_http(u), "valid").otherwise("invalid")
    return table(spark, d, "parsed_company").filter(u != "").select("pos", part.alias("part"))


@plan(
    "SELECT t.id, t.name, t.place FROM (SELECT id, name_en AS name, row_number() OVER (ORDER BY lower(name_en) NULLS LAST, name_en NULLS LAST, pos) AS place FROM company) t WHERE place <= 50"
)
def alphabetic_export(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty companies in the order of a reader: case only decides between equal letters, missing names last."""
    from pyspark.sql import window as W

    order = [F.lower("name_en").asc_nulls_last(), F.col("name_en").asc_nulls_last(), F.asc("pos")]
    top = table(spark, d, "company").select("id", F.col("name_en").alias("name"), "name_en", "pos").orderBy(*order).limit(50)
    return top.withColumn("place", F.row_number().over(W.Window.orderBy(*order)).cast("long")).select("id", "name", "place")


_CHECKS = [
    ("title", "شركة الاختبار (Test Company)", "شركة الاختبار|Test Company"), ("title", "Only English", "-|Only English"), ("title", "عربي فقط", "عربي فقط|-"),
    ("products", "We sell goods such as pumps, valves and pipes. More.", "pumps,valves,pipes"), ("email", "422b2c242d02236c21", "info@a.c"),
    ("normalised", "HTTP://www.A.example/x/?b=2&utm_source=q&a=1#t", "http://a.example/x?b=2&a=1#t"), ("parameters", "http://www.a.example/x/?utm_source=q&b=2", "http://www.a.example/x/?b=2"),
    ("same", "https://a.example/x/|http://www.a.example/x", "true"), ("labelled", "Name: A\nPhone: 123", "123"),
]


@plan("SELECT * FROM (VALUES " + ", ".join(f"({i}, {S.lit(k)}, {S.lit(out)})" for i, (k, _, out) in enumerate(_CHECKS)) + ") AS t(n, kind, result)")
def decoder_checks(spark: SparkSession, d: str) -> DataFrame:
    """Small decoders on fixed texts with known results."""
    t = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(_CHECKS)], "n int, kind string, v string")
    v, k = F.col("v"), F.col("kind")
    title = text.split_title(v)
    dash = lambda c: F.coalesce(c, F.lit("-"))
    result = (
        F.when(k == "title", F.concat_ws("|", dash(title["name_ar"]), dash(title["name_en"])))
        .when(k == "products", F.array_join(text.product_list(v), ","))
        .when(k == "email", text.decoded_email(v))
        .when(k == "normalised", urls.normalised(v))
        .when(k == "parameters", urls.without_parameters(v))
        .when(k == "same", urls.same_resource(F.substring_index(v, "|", 1), F.substring_index(v, "|", -1)).cast("string"))
        .when(k == "labelled", text.labelled(v, "Phone"))
    )
    return t.select("n", "kind", result.alias("result"))


_LISTED = [
    ("https://b2b.example/companies/all", '<html><body><script>window.__STATE__ = {"page":{"items":[{"companyName":"Alpha Co","phone":"0111"},{"name":"Beta","website":"https://b.example"}]}};</script></body></html>', [("embedded", "Alpha Co", "0111"), ("embedded", "Beta", None)]),
    ("https://b2b.example/suppliers/api", '{"data":{"result":[{"name":"Gamma","email":"g@g.example"}]}}', [("embedded", "Gamma", None)]),
    ("https://dir.example/c/17", '<h1>Delta Factory</h1><a href="tel:0122">call</a><a href="https://facebook.com/d">f</a>', [("profile", "Delta Factory", "0122")]),
    ("https://dir.example/profile/news", '<article><h1>Fair opens</h1><time>2024</time><a href="tel:0133">call</a></article>', []),
    ("https://guide-x.example/one", '<h1>Epsilon Est</h1><a href="mailto:e@e.example?x=1">mail</a>', [("profile", "Epsilon Est", None)]),
]


def _texts(*row: str | None) -> str:
    return "(" + ", ".join("NULL" if x is None else S.lit(x) for x in row) + ")"


@plan("SELECT * FROM (VALUES " + ", ".join(_texts(u, *r) for u, _, rows in _LISTED for r in rows) + ") AS t(url, strategy, name_en, phone)")
def portal_listings(spark: SparkSession, d: str) -> DataFrame:
    """Records that portals keep in the state of their scripts or in JSON answers, and those of profiles; articles are none."""
    t = spark.createDataFrame([(u, h) for u, h, _ in _LISTED], "url string, html string")
    return pages.listings(t).select("url", "strategy", "name_en", "phone")


_PAGED = [
    ("https://a.example/list", '<div class="pagination"><a href="?p=2">2</a><a href="/list?page=3&amp;s=1">3</a></div><a href="/about">x</a>', ["https://a.example/list?p=2", "https://a.example/list?page=3&s=1"]),
    ("https://b.example/x/", '<a rel="next" href="next.html">n</a><a href=\'y.aspx?PageFirstRow=31\'>m</a><a rel="next" href="next.html">n</a>', ["https://b.example/x/next.html", "https://b.example/x/y.aspx?PageFirstRow=31"]),
    ("https://c.example/", "<p>no pages</p>", []),
]


@plan("SELECT * FROM (VALUES " + ", ".join(f"({S.lit(u)}, {i}, {S.lit(x)})" for u, _, out in _PAGED for i, x in enumerate(out)) + ") AS t(url, place, link)")
def further_pages(spark: SparkSession, d: str) -> DataFrame:
    """Links to the further pages of listings, in order, each once."""
    t = spark.createDataFrame([(u, h) for u, h, _ in _PAGED], "url string, html string")
    return t.select("url", F.posexplode(pages.further_pages_column("html", "url")).alias("place", "link"))
