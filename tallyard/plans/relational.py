"""Queries that aggregate, join, rank or dedupe. Each has its SQL beside it where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import dedupe, metrics, query, records
from ..session import table
from ..sources import exports
from . import sqltext as S

QUERIES, SQL = {}, {}
#: Most rows of a reference table that become a literal map in the plan.
LITERAL_ROWS = 10_000


def plan(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_KIND, _SCORE = S.page_kind("website_url")
_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(urls.PAGE_RANK, 1)) + " ELSE 99 END"


@plan(
    f"WITH p AS (SELECT pos, {S.canonical('website_url')} AS canonical_url, {S.domain('website_url')} AS domain, {_KIND} AS kind FROM parsed_company),"
    " f AS (SELECT canonical_url, min(pos) AS pos, arg_min(domain, pos) AS domain, arg_min(kind, pos) AS kind FROM p WHERE canonical_url IS NOT NULL GROUP BY canonical_url),"
    f" r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {_RANK}, pos) AS page_rank FROM f)"
    " SELECT domain, canonical_url, kind, pos, page_rank::INT AS page_rank FROM r WHERE page_rank <= 5"
)
def page_triage(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pages, classified; the five most useful of each site."""
    pages = urls.with_page_kind(table(spark, d, "parsed_company"), "website_url")
    u = F.col("website_url")
    pages = pages.select("pos", urls.canonical(u).alias("canonical_url"), urls.domain(u).alias("domain"), "kind")
    pages = query.first_per_key(pages.filter("canonical_url is not null"), ["canonical_url"], "pos")
    from pyspark.sql import window as W

    w = W.Window.partitionBy("domain").orderBy(urls.page_rank(F.col("kind")), "pos")
    return pages.withColumn("page_rank", F.row_number().over(w)).filter("page_rank <= 5").select("domain", "canonical_url", "kind", "pos", "page_rank")


@plan(f"SELECT {S.domain('website_url')} AS domain, count(*) AS n, count(DISTINCT {S.canonical('website_url')}) AS n_urls FROM parsed_company GROUP BY 1")
def domain_counts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("website_url")
    t = table(spark, d, "parsed_company").select(urls.domain(u).alias("domain"), urls.canonical(u).alias("c"))
    return t.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c").alias("n_urls"))


_KEY = f"""CASE WHEN coalesce({S.name_key(f"coalesce({S.filled('name_en')}, name_ar)")}, '') <> '' THEN {S.name_key(f"coalesce({S.filled('name_en')}, name_ar)")}
    WHEN coalesce(lower({S.trim('website_url')}), '') <> '' THEN '|||' || lower({S.trim('website_url')}) END"""
_ORDER = f"(NOT {S.blank('website_url')})::INT DESC, (NOT {S.blank('email')})::INT DESC, (NOT {S.blank('phone')})::INT DESC, coalesce(confidence_score, 0) DESC, pos"


_BEST = ("pos", "name_en", "name_ar", "website_url", "email", "phone", "confidence_score")


def _best_sql(key: str) -> str:
    return (
        f"WITH k AS (SELECT *, {key} AS key FROM parsed_company), r AS (SELECT key, pos, row_number() OVER (PARTITION BY key ORDER BY {_ORDER}) AS n,"
        " min(pos) OVER (PARTITION BY key) AS first_pos, count(*) OVER (PARTITION BY key) AS n_rows FROM k WHERE key IS NOT NULL)"
        " SELECT key, first_pos, n_rows, pos FROM r WHERE n = 1"
    )


@plan(_best_sql(_KEY))
def best_records(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "parsed_company").select(*_BEST)
    return dedupe.best_records(t).select("key", "first_pos", "n_rows", "pos")


_STRICT = f"nullif(regexp_replace({S.name_key('name_en')}, '[\\s.-]+', '', 'g'), '')"


@plan(_best_sql(_STRICT))
def best_records_strict(spark: SparkSession, d: str) -> DataFrame:
    key = text.strict_key(F.col("name_en"))
    found = dedupe.best_records(table(spark, d, "parsed_company").select(*_BEST), F.nullif(key, F.lit("")))
    return found.select("key", "first_pos", "n_rows", "pos")


@plan(
    f"WITH k AS (SELECT pos, {S.domain('website_url')} AS key FROM parsed_company), m AS (SELECT pos, min(pos) OVER (PARTITION BY key) AS first, key FROM k WHERE key IS NOT NULL)"
    " SELECT first AS pos_a, pos AS pos_b FROM m WHERE pos <> first"
)
def same_site_links(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.star_links(table(spark, d, "parsed_company"), urls.domain(F.col("website_url")))


@plan(
    f"WITH k AS (SELECT pos, {S.canonical('linkedin_url')} AS key FROM parsed_company), m AS (SELECT pos, min(pos) OVER (PARTITION BY key) AS first, key FROM k WHERE key IS NOT NULL)"
    " SELECT first AS pos_a, pos AS pos_b FROM m WHERE pos <> first"
)
def same_profile_links(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.star_links(table(spark, d, "parsed_company"), urls.canonical(F.col("linkedin_url")))


@plan()
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "parsed_company")
    named = t.select(text.bare_company_name(F.col("name_en")).alias("name"), F.lower(text.filled(F.col("city"))).alias("city"))
    return dedupe.similar_name_pairs(named).withColumn("confidence", F.round("confidence", 6))


@plan()
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.duplicate_groups(table(spark, d, "parsed_company")).withColumn("confidence", F.round("confidence", 6))


_MEMBERS = """l AS (SELECT g.id AS group_id, c.id, min(c.place) AS place FROM duplicate_group g, LATERAL (SELECT unnest(company_ids) AS id, generate_subscripts(company_ids, 1) - 1 AS place) c GROUP BY 1, 2),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, pos DESC) AS n FROM company) WHERE n = 1),
    m AS (SELECT l.group_id, l.place, o.* FROM l JOIN o USING (id))"""
_FIELDS = ("name_en", "website_url", "phone", "email", "city", "linkedin_url")


def _members(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.group_members(table(spark, d, "duplicate_group"), table(spark, d, "company"))


@plan(f"WITH {_MEMBERS} SELECT group_id, {', '.join(f'arg_min({f}, place) FILTER (WHERE NOT {S.blank(f)}) AS {f}' for f in _FIELDS)} FROM m GROUP BY group_id")
def prefer_master(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.preferred(_members(spark, d), _FIELDS)


@plan(f"WITH {_MEMBERS} SELECT group_id, {', '.join(f'arg_max({f}, place) FILTER (WHERE NOT {S.blank(f)}) AS {f}' for f in _FIELDS)} FROM m GROUP BY group_id")
def prefer_latest(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.preferred(_members(spark, d), _FIELDS, latest=True)


@plan(
    f"WITH {_MEMBERS}, v AS ({' UNION ALL '.join(f'SELECT group_id, place, {S.lit(f)} AS field, {f} AS value FROM m' for f in _FIELDS)}),"
    f" c AS (SELECT group_id, field, value, count(*) AS n, min(place) AS first FROM v WHERE NOT {S.blank('value')} GROUP BY 1, 2, 3)"
    " SELECT group_id, field, value, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field ORDER BY n DESC, first) AS r FROM c) WHERE r = 1"
)
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.majority(_members(spark, d), _FIELDS)


@plan(
    f"WITH {_MEMBERS}, c AS (SELECT group_id, count(*) AS n_members, bool_and(NOT {S.blank('website_url')}) AS all_sites,"
    f" {', '.join(f'count(DISTINCT {f}) FILTER (WHERE NOT {S.blank(f)}) AS c_{f}' for f in _FIELDS)} FROM m GROUP BY group_id),"
    f" n AS (SELECT *, {S.messages(*((f'c_{f} > 1', f) for f in _FIELDS))} AS conflicts FROM c) SELECT group_id, n_members, array_to_string(conflicts, ',') AS conflicts,"
    " round(greatest(0, least(1, 0.7::DOUBLE - 0.05::DOUBLE * len(conflicts) + 0.1::DOUBLE * all_sites::INT + 0.1::DOUBLE)), 4) AS confidence FROM n"
)
def field_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.conflicts(_members(spark, d), _FIELDS)


@plan(
    f"WITH {_MEMBERS} SELECT group_id, {', '.join(f'array_to_string(list_sort(list_distinct(flatten(list(coalesce({a}, []))))), chr(44)) AS {a}' for a in ('categories', 'brands', 'products'))} FROM m GROUP BY group_id"
)
def array_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    arrays = ("categories", "brands", "products")
    united = dedupe.united_arrays(_members(spark, d), arrays)
    return united.select("group_id", *(F.array_join(a, ",").alias(a) for a in arrays))


@plan(
    f"WITH {_MEMBERS}, a AS (SELECT * FROM m WHERE place = 0), b AS (SELECT group_id, min(place) AS place FROM m WHERE place > 0 GROUP BY 1),"
    " s AS (SELECT m.* FROM m JOIN b USING (group_id, place)) SELECT a.group_id, a.id,"
    f" CASE WHEN {S.blank('a.phone')} THEN s.phone ELSE a.phone END AS phone, CASE WHEN {S.blank('a.email')} THEN s.email ELSE a.email END AS email,"
    " array_to_string(list_sort(list_distinct(list_concat(coalesce(a.categories, []), coalesce(s.categories, [])))), ',') AS categories,"
    " array_to_string(CASE WHEN s.id IS NULL THEN list_sort(list_distinct(a.merged_from)) ELSE list_sort(list_distinct(list_concat(coalesce(a.merged_from, [a.id]), [s.id]))) END, ',') AS merged_from"
    " FROM a LEFT JOIN s USING (group_id)"
)
def merged_records(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    masters = m.filter("place = 0")
    second = m.filter("place > 0")
    second = second.groupBy("group_id").agg(F.min_by(F.struct(*[c for c in m.columns if c != "group_id"]), "place").alias("r")).select("group_id", "r.*")
    out = dedupe.merged_into(masters, second, "group_id", ["categories"], ["phone", "email"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",").alias(c)
    return out.select("group_id", "id", "phone", "email", joined("categories"), joined("merged_from"))


@plan(
    "WITH i AS (SELECT pos, unnest(categories) AS label, generate_subscripts(categories, 1) AS place FROM parsed_company),"
    f" t AS (SELECT pos, place, {S.trim('label')} AS label FROM i WHERE NOT {S.blank('label')})"
    " SELECT pos, array_to_string(list(coalesce(a.id, b.id, c.id, label) ORDER BY place), '|') AS ids FROM t"
    " LEFT JOIN canonical_category a ON a.id = label LEFT JOIN canonical_category b ON lower(b.name_en) = lower(label)"
    " LEFT JOIN canonical_category c ON c.name_ar = label GROUP BY pos"
)
def category_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Category labels as ids, in place: by a literal map of a small reference table, by joins with a large one."""
    reference = table(spark, d, "canonical_category").select("id", "name_en", "name_ar")
    t = table(spark, d, "parsed_company").select("pos", "categories")
    if reference.count() <= LITERAL_ROWS:
        t = t.select("pos", records.category_ids(F.col("categories"), [tuple(r) for r in reference.collect()]).alias("ids")).filter(F.size("ids") > 0)
    else:
        t = records.category_ids_joined(t, reference, "pos", "categories")
    return t.select("pos", F.array_join("ids", "|").alias("ids"))


@plan("SELECT c.pos, c.id, t.name_en AS city_name, t.region_id FROM company c LEFT JOIN canonical_city t ON t.id = c.city_id")
def company_city(spark: SparkSession, d: str) -> DataFrame:
    """Companies with their city: a small dimension, joined by whichever strategy its size allows."""
    city = table(spark, d, "canonical_city").select(F.col("id").alias("city_id"), F.col("name_en").alias("city_name"), F.col("region_id").alias("r"))
    return table(spark, d, "company").join(city, "city_id", "left").select("pos", "id", "city_name", F.col("r").alias("region_id"))


@plan("SELECT event_type, date_trunc('day', ts) AS day, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY ALL")
def metric_counters(spark: SparkSession, d: str) -> DataFrame:
    return metrics.counters(table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts")), ["event_type", "day"], "value")


@plan("SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY ALL")
def metric_gauges(spark: SparkSession, d: str) -> DataFrame:
    return metrics.gauges(table(spark, d, "events"), ["event_type", "user_id"], "value", ["ts", "event_id"])


@plan(
    "WITH r AS (SELECT event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 1000),"
    " v AS (SELECT event_type, list_sort(list(value)) AS v FROM r GROUP BY 1) SELECT event_type, len(v)::INT AS n, round(list_avg(v), 4) AS mean, v[1] AS least, v[-1] AS most,"
    " v[floor(len(v) * 0.5)::INT + 1] AS p50, v[floor(len(v) * 0.9)::INT + 1] AS p90, v[floor(len(v) * 0.99)::INT + 1] AS p99 FROM v"
)
def metric_histograms(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histograms(table(spark, d, "events"), ["event_type"], "value", [F.desc("ts"), F.desc("event_id")])


@plan("SELECT event_id, ts, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 10000")
def recent_points(spark: SparkSession, d: str) -> DataFrame:
    """The newest ten thousand points (the feature is the ring buffer)."""
    return table(spark, d, "events").select("event_id", "ts", "event_type", "value").orderBy(F.desc("ts"), F.desc("event_id")).limit(10_000)


@plan(
    "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failures, round((count(*) - count(*) FILTER (WHERE event_type = 'error'))::DOUBLE / count(*), 4) AS success_rate,"
    " round(sum(value) / count(*), 4) AS mean_value FROM events GROUP BY user_id"
)
def source_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.success_stats(table(spark, d, "events"), ["user_id"], F.col("event_type") == "error", "value")


@plan(
    "SELECT event_id, user_id, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS running FROM events"
)
def queue_size_running(spark: SparkSession, d: str) -> DataFrame:
    change = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    out = metrics.running_sum(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], change, F.to_date("ts"))
    return out.select("event_id", "user_id", "running")


_STATUSES = ("pending", "processing", "completed", "failed", "dead_letter")


@plan(f"SELECT queue_name, {', '.join(f'count(*) FILTER (WHERE status = {S.lit(s)}) AS {s}' for s in _STATUSES)}, count(*) AS total FROM job GROUP BY 1")
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in _STATUSES]
    return table(spark, d, "job").groupBy("queue_name").agg(*counts, F.count(F.lit(1)).alias("total"))


@plan("SELECT queue_name, id, priority FROM (SELECT *, row_number() OVER (PARTITION BY queue_name ORDER BY priority DESC, created_at, id) AS n FROM job WHERE status = 'pending') WHERE n = 1")
def next_jobs(spark: SparkSession, d: str) -> DataFrame:
    pending = table(spark, d, "job").filter("status = 'pending'").select("queue_name", "id", "priority", "created_at")
    order = [F.desc("priority"), F.asc("created_at"), F.asc("id")]
    return query.top_per_group(pending, ["queue_name"], order, 1).drop("created_at")


@plan("SELECT status, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY created_at DESC, id) AS n FROM job) WHERE n <= 20")
def jobs_by_status(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "job").select("status", "id", "created_at")
    return query.top_per_group(jobs, ["status"], [F.desc("created_at"), F.asc("id")], 20)


@plan(
    "WITH k AS (SELECT idempotency_key, min(id) AS id FROM job WHERE status = 'completed' AND idempotency_key IS NOT NULL GROUP BY 1)"
    " SELECT idempotency_key, id FROM k WHERE NOT EXISTS (SELECT 1 FROM job j WHERE j.idempotency_key = k.idempotency_key AND j.status <> 'completed')"
)
def idempotent_enqueue(spark: SparkSession, d: str) -> DataFrame:
    """Completed work that may be queued again: no open job has its key; one row a key."""
    jobs = table(spark, d, "job").filter("idempotency_key is not null").select("idempotency_key", "id", "status")
    wanted = jobs.filter("status = 'completed'").groupBy("idempotency_key").agg(F.min("id").alias("id"))
    return wanted.join(jobs.filter("status <> 'completed'").select("idempotency_key"), "idempotency_key", "left_anti")


@plan(f"SELECT {S.domain('url')} AS domain, max(updated_at) AS last_at, count(*) FILTER (WHERE status = 'processing') AS active FROM job GROUP BY 1")
def site_load(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "job").select(urls.domain(F.col("url")).alias("domain"), "updated_at", "status")
    return jobs.groupBy("domain").agg(F.max("updated_at").alias("last_at"), F.count_if(F.col("status") == "processing").alias("active"))


@plan(
    f"SELECT count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,"
    f" CAST(sum(companies_found) FILTER (WHERE status = 'completed') AS BIGINT) AS companies, count(DISTINCT {S.domain('url')}) AS domains FROM seed"
)
def seed_stats(spark: SparkSession, d: str) -> DataFrame:
    done = F.col("status") == "completed"
    t = table(spark, d, "seed")
    return t.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(F.when(done, F.col("companies_found"))).alias("companies"), F.count_distinct(urls.domain(F.col("url"))).alias("domains"),
    )


@plan(f"SELECT {S.canonical('url')} AS canonical_url, min(pos) AS pos, count(*) AS n FROM seed WHERE {S.canonical('url')} IS NOT NULL GROUP BY 1")
def seed_registry(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "seed").select("pos", urls.canonical(F.col("url")).alias("canonical_url")).filter("canonical_url is not null")
    return t.groupBy("canonical_url").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))


@plan("SELECT company_id, field_name, value, max(confidence) AS confidence FROM evidence WHERE value IS NOT NULL AND value <> '' AND confidence > 0 GROUP BY 1, 2, 3")
def evidence_sink(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "evidence").filter("value is not null and value <> '' and confidence > 0")
    return kept.groupBy("company_id", "field_name", "value").agg(F.max("confidence").alias("confidence"))


@plan(
    "SELECT field_name, extraction_method, count(*) AS n, round(avg(confidence), 4) AS mean_confidence, count(*) FILTER (WHERE c.id IS NULL) AS n_unknown FROM evidence e"
    " LEFT JOIN (SELECT DISTINCT id FROM company) c ON c.id = e.company_id GROUP BY 1, 2"
)
def evidence_stats(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "company").select(F.col("id").alias("company_id")).distinct().withColumn("known", F.lit(True))
    e = table(spark, d, "evidence").join(known, "company_id", "left")
    return e.groupBy("field_name", "extraction_method").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.count_if(F.col("known").isNull()).alias("n_unknown")
    )


@plan("SELECT id, pos, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, pos DESC) AS n FROM company) WHERE n = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "company").select("id", "pos", "status", "updated_at")
    return exports.upserted(t, t.limit(0), ["id"], ["updated_at", "pos"]).select("id", "pos", "status")


@plan("SELECT c.pos, c.id, CASE WHEN p.id IS NOT NULL THEN p.city ELSE c.city END AS city FROM company c LEFT JOIN (SELECT id, arg_max(value, value) AS city FROM (SELECT company_id AS id, value FROM evidence WHERE field_name = 'city' AND value IS NOT NULL) GROUP BY id) p USING (id)")
def patch_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence").filter("field_name = 'city' and value is not null")
    patches = e.groupBy(F.col("company_id").alias("id")).agg(F.max("value").alias("city"))
    return exports.patched(table(spark, d, "company").select("pos", "id", "city"), patches, "id")


@plan("SELECT pos, id FROM company c WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(company_ids) AS id FROM duplicate_group WHERE status = 'resolved') g WHERE g.id = c.id)")
def delete_rows(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "duplicate_group").filter("status = 'resolved'").select(F.explode("company_ids").alias("id"))
    return exports.without(table(spark, d, "company").select("pos", "id"), gone, "id")


@plan("SELECT pos, 100000 + row_number() OVER (ORDER BY pos) AS new_id FROM parsed_company")
def next_ids(spark: SparkSession, d: str) -> DataFrame:
    return exports.with_ids(table(spark, d, "parsed_company").select("pos"), "pos", 100_000).select("pos", "new_id")


_COUNTED = ("company", "parsed_company", "evidence", "job", "seed", "documents", "events")


@plan(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _COUNTED))
def counts_report(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t in _COUNTED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@plan("SELECT pos, id, confidence_score FROM company WHERE status = 'approved' AND confidence_score >= 0.5 AND list_contains(categories, 'k01') ORDER BY confidence_score DESC LIMIT 1000000")
def filtered_scan(spark: SparkSession, d: str) -> DataFrame:
    filters = [("status", "==", "approved"), ("confidence_score", ">=", 0.5), ("categories", "array-contains", "k01")]
    return query.select_rows(table(spark, d, "company"), filters, "confidence_score", "desc").select("pos", "id", "confidence_score")


@plan("SELECT doc_id FROM documents WHERE text ILIKE '%water%' AND text ILIKE '%dealers%'")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    return query.search(table(spark, d, "documents"), "text", "water dealers").select("doc_id")


@plan(
    "WITH a AS (SELECT pos, list_filter(list_distinct(string_split_regex(lower(name_en), '[^\\p{L}\\p{N}]+')), lambda w: length(w) >= 3) AS x,"
    " list_filter(list_distinct(string_split_regex(lower(coalesce(description_en, '')), '[^\\p{L}\\p{N}]+')), lambda w: length(w) >= 3) AS y FROM company)"
    " SELECT pos, round(coalesce(len(list_intersect(x, y)) / nullif(least(len(x), len(y)), 0)::DOUBLE, 0), 6) AS overlap FROM a"
)
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    overlap = text.token_overlap(F.col("name_en"), F.coalesce("description_en", F.lit("")))
    return table(spark, d, "company").select("pos", F.round(overlap, 6).alias("overlap"))


@plan(
    "WITH s AS (SELECT id, url FROM job WHERE url IS NOT NULL), c AS (SELECT DISTINCT website_url AS url FROM company WHERE website_url IS NOT NULL)"
    " SELECT id, url FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.url = s.url)"
)
def unvisited_urls(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "company").select(F.col("website_url").alias("url")).filter("url is not null").distinct()
    return table(spark, d, "job").filter("url is not null").select("id", "url").join(seen, "url", "left_anti").select("id", "url")


_SLUG = S.slug("name_en")


@plan(f"WITH s AS (SELECT pos, {_SLUG} AS base FROM parsed_company), r AS (SELECT pos, base, row_number() OVER (PARTITION BY base ORDER BY pos) - 1 AS k FROM s) SELECT pos, CASE WHEN k > 0 THEN base || '-' || k ELSE base END AS slug FROM r")
def unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "parsed_company").select("pos", text.slug(F.col("name_en")).alias("base"))
    numbered = exports.numbered_in_groups(t, "base", "pos")
    k = F.col("k") - 1
    return numbered.select("pos", F.when(k > 0, F.concat_ws("-", "base", k.cast("string"))).otherwise(F.col("base")).alias("slug"))


@plan(f"WITH f AS (SELECT source_url, {S.filled('phone')} AS phone, confidence_score, pos FROM parsed_company WHERE NOT {S.blank('phone')}), b AS (SELECT source_url, arg_max(phone, (confidence_score, -pos)) AS found FROM f WHERE confidence_score IS NOT NULL GROUP BY 1) SELECT p.pos, CASE WHEN {S.blank('p.phone')} THEN b.found ELSE p.phone END AS phone FROM parsed_company p LEFT JOIN b USING (source_url)")
def fill_blanks(spark: SparkSession, d: str) -> DataFrame:
    """Blank telephone numbers filled from the best record of the same page; a page may hold any share of the rows."""
    from ..session import lookup_join

    t = table(spark, d, "parsed_company").select("pos", "source_url", "phone", "confidence_score")
    known = t.filter(~text.blank(F.col("phone")) & F.col("confidence_score").isNotNull())
    best = known.groupBy("source_url").agg(F.max_by(text.trim(F.col("phone")), F.struct("confidence_score", -F.col("pos"))).alias("found"))
    sizes = t.groupBy("source_url").agg(F.count(F.lit(1)).alias("n")).join(best, "source_url")
    joined = lookup_join(t, sizes, ["source_url"], "n", how="left")
    return joined.select("pos", F.when(text.blank(F.col("phone")), F.col("found")).otherwise(F.col("phone")).alias("phone"))
