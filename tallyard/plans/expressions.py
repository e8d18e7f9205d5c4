"""Row-level queries: one scan, column pruning, no shuffle. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contact, text, urls
from ..operators import records
from ..session import table
from . import sqltext as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT pos, {S.canonical('website_url')} AS canonical_url, {S.domain('website_url')} AS domain FROM parsed_company")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("website_url")
    return table(spark, d, "parsed_company").select("pos", urls.canonical(u).alias("canonical_url"), urls.domain(u).alias("domain"))


@query(
    f"SELECT pos, coalesce({S.matches('website_url', '(?i)^https?://[^/?#\\s]+')}, false) AS is_http,"
    f" coalesce({S.matches('lower(' + S.domain('website_url') + ')', urls.PARKED)}, false) AS looks_parked,"
    f" coalesce({S.matches('source_url', urls.ASSETS)}, false) AS is_asset FROM parsed_company"
)
def url_checks(spark: SparkSession, d: str) -> DataFrame:
    t, no = table(spark, d, "parsed_company"), F.lit(False)
    parked = F.coalesce(urls.looks_parked(urls.domain(F.col("website_url"))), no)
    asset = F.coalesce(F.col("source_url").rlike(urls.ASSETS), no)
    return t.select("pos", urls.is_http(F.col("website_url")).alias("is_http"), parked.alias("looks_parked"), asset.alias("is_asset"))


@query(f"SELECT pos, {S.page_kind('website_url')[0]} AS kind, {S.page_kind('website_url')[1]} AS confidence FROM parsed_company")
def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    t = urls.with_page_kind(table(spark, d, "parsed_company"), "website_url")
    return t.select("pos", "kind", F.col("kind_confidence").alias("confidence"))


@query(
    "SELECT pos, url || CASE WHEN contains(url, '?') THEN '&page=' ELSE '?page=' END || n AS page_url"
    " FROM (SELECT pos, url, unnest(generate_series(2, least(pages_scraped, 60))) AS n FROM seed WHERE pages_scraped >= 2)"
)
def page_urls(spark: SparkSession, d: str) -> DataFrame:
    pages = urls.page_urls(F.col("url"), F.col("pages_scraped"))
    return table(spark, d, "seed").select("pos", F.explode(pages).alias("page_url"))


@query(f"SELECT doc_id, {S.clean('text')} AS cleaned FROM documents")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT pos, {S.junk_to_null('city')} AS city, {S.junk_to_null('phone')} AS phone, {S.junk_to_null('description_en')} AS description_en FROM company")
def junk_to_null(spark: SparkSession, d: str) -> DataFrame:
    fields = ("city", "phone", "description_en")
    return table(spark, d, "company").select("pos", *(text.junk_to_null(F.col(f)).alias(f) for f in fields))


@query(f"SELECT pos, {S.legal('name_en')} AS name FROM parsed_company")
def name_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_company").select("pos", text.without_legal_ending(F.col("name_en")).alias("name"))


@query(f"SELECT pos, {S.phone('phone')} AS phone FROM parsed_company")
def phone_ladder(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_company").select("pos", contact.phone(F.col("phone")).alias("phone"))


@query(f"SELECT pos, CASE WHEN {S.matches('lower(' + S.trim('email') + ')', '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')} THEN lower({S.trim('email')}) END AS email FROM parsed_company")
def email_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_company").select("pos", contact.email(F.col("email")).alias("email"))


@query(f"SELECT pos, {S.city('city')} AS city, {S.country('full_address')} AS country FROM parsed_company")
def city_country(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "parsed_company")
    return t.select("pos", contact.city(F.col("city"))["city"].alias("city"), contact.country(F.col("full_address")).alias("country"))


_J = {f: f"({S.junk_to_null(f)})" for f in ("name_en", "phone", "email", "city")}
_MAIL = f"CASE WHEN {S.matches('lower(' + S.trim(_J['email']) + ')', '^[^' + chr(92) + 's@]+@[^' + chr(92) + 's@]+' + chr(92) + '.[^' + chr(92) + 's@]+$')} THEN lower({S.trim(_J['email'])}) END"


@query(
    f"SELECT pos, coalesce({S.legal(_J['name_en'])}, {_J['name_en']}) AS name_en, coalesce({S.phone(_J['phone'])}, {_J['phone']}) AS phone,"
    f" coalesce({_MAIL}, {_J['email']}) AS email, coalesce({S.city(_J['city'])}, {_J['city']}) AS city FROM parsed_company"
)
def record_normalise(spark: SparkSession, d: str) -> DataFrame:
    return records.normalised(table(spark, d, "parsed_company")).select("pos", "name_en", "phone", "email", "city")


_NAME = f"coalesce({S.filled('name_en')}, 'Unknown Company')"


@query(
    f"SELECT pos, {_NAME} AS name_en, coalesce({S.filled('name_ar')}, {_NAME}) AS name_ar, {S.slug(_NAME)} AS slug,"
    f" coalesce({S.filled('description_en')}, {_NAME}) AS description_en,"
    f" coalesce({S.filled('description_ar')}, {S.filled('description_en')}, {_NAME}) AS description_ar,"
    f" coalesce({S.filled('full_address')}, {S.filled('city')}, 'Saudi Arabia') AS full_address, '1' AS city_id, '1' AS region_id,"
    " 'pending' AS status, coalesce(confidence_score, 0) AS confidence_score FROM parsed_company"
)
def discovery_defaults(spark: SparkSession, d: str) -> DataFrame:
    return records.with_defaults(table(spark, d, "parsed_company"))


@query(
    "SELECT pos, "
    + S.trim(S.sub(S.sub("description_en", r"(?is)<script\b.*?</script>|<iframe\b.*?</iframe>"), "(?i)javascript:|vbscript:|onload=|onerror="))
    + " AS description_en FROM parsed_company"
)
def sanitise_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_company").select("pos", text.sanitised(F.col("description_en")).alias("description_en"))


_EN, _AR = r"^[\s\x21-\x7E\x{00C0}-\x{017F}]+$", r"^[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{2000}-\x{206F}\x{2E00}-\x{2E7F}\s\x21-\x7E]+$"


def _sql_name(x: str, pattern: str) -> str:
    return f"coalesce(length({S.trim(x)}) BETWEEN 2 AND 200 AND {S.matches(x, pattern)}, false)"


def _sql_items(x: str) -> str:
    return f"({x} IS NULL OR len(list_filter({x}, lambda i: i IS NULL OR {S.trim('i')} = '' OR length(i) > 100)) = 0)"


_ERRORS = S.messages(
    (f"NOT {_sql_name('name_en', _EN)} AND NOT {_sql_name('name_en', _AR)}", "name"),
    (f"website_url <> '' AND NOT coalesce({S.matches('website_url', '(?i)^https?://[^/?#\\s]+')}, false)", "website"),
    (f"phone <> '' AND NOT {S.matches(S.sub('phone', '[\\s\\-()+.]'), '^[0-9]{7,15}$')}", "phone"),
    (f"email <> '' AND NOT ({S.matches('email', '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')} AND length(email) <= 254)", "email"),
    (f"city <> '' AND NOT (length({S.trim('city')}) BETWEEN 2 AND 100 AND {S.matches(S.trim('city'), '^[a-zA-Z\\x{00C0}-\\x{017F}\\s\\-'+chr(39)+']+$')})", "city"),
    (f"NOT {_sql_items('categories')}", "categories"),
    (f"NOT {_sql_items('products')}", "products"),
)


@query(f"SELECT pos, array_to_string({_ERRORS}, ',') AS errors, len({_ERRORS}) = 0 AS is_valid FROM parsed_company")
def validate_records(spark: SparkSession, d: str) -> DataFrame:
    t = records.validated(table(spark, d, "parsed_company"))
    return t.select("pos", F.array_join("errors", ",").alias("errors"), "is_valid")


@query(f"SELECT count(*) FILTER (WHERE len({_ERRORS}) = 0) AS n_valid, count(*) FILTER (WHERE len({_ERRORS}) > 0) AS n_rejected FROM parsed_company")
def validate_partition(spark: SparkSession, d: str) -> DataFrame:
    t = records.validated(table(spark, d, "parsed_company"))
    return t.agg(F.count_if("is_valid").alias("n_valid"), F.count_if(~F.col("is_valid")).alias("n_rejected"))


_SAVE_ERRORS = S.messages(
    (S.blank("name_en"), "name_en is required"),
    (S.blank("slug"), "slug is required"),
    ("coalesce(business_type, '') = ''", "business_type is required"),
    (f"email <> '' AND NOT {S.matches('email', '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')}", "email has invalid format"),
    (f"website_url <> '' AND NOT {S.matches('website_url', '(?i)^https?://.+')}", "website_url has invalid format"),
    (f"logo_url <> '' AND NOT {S.matches('logo_url', '(?i)^https?://.+')}", "logo_url has invalid format"),
)
_SAVE_WARNINGS = S.messages(
    (f"phone <> '' AND NOT {S.matches(S.sub('phone', '[\\s\\-().]'), '^\\+?[0-9]{7,15}$')}", "phone format looks unusual"),
    ("confidence_score < 0 OR confidence_score > 1", "confidence_score out of range"),
    ("description_en <> '' AND length(description_en) < 10", "description_en is very short"),
    ("coalesce(city_id, '') = ''", "city_id is missing"),
    ("coalesce(region_id, '') = ''", "region_id is missing"),
)


@query(f"SELECT pos, array_to_string({_SAVE_ERRORS}, ';') AS errors, array_to_string({_SAVE_WARNINGS}, ';') AS warnings FROM company")
def presave_checks(spark: SparkSession, d: str) -> DataFrame:
    t = records.checked_before_saving(table(spark, d, "company"))
    return t.select("pos", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"))


@query(r"SELECT doc_id, round(length(regexp_replace(text, '[^\x{0600}-\x{06FF}]', '', 'g')) / nullif(length(text), 0), 6) AS arabic_share FROM documents")
def arabic_share(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(text.arabic_share(F.col("text")), 6).alias("arabic_share"))


def _sql_list(x: str) -> str:
    return f"nullif(array_to_string({x}, ' | '), '')"


_SEARCH = S.trim(
    S.sub(
        S.sub(
            f"lower(concat_ws(' | ', nullif(name_en, ''), nullif(name_ar, ''), nullif(business_type, ''), nullif(description_en, ''), nullif(description_ar, ''), nullif(city, ''), {_sql_list('categories')}, {_sql_list('products')}, {_sql_list('brands')}))",
            r"[^a-zA-Z0-9_\s\x{0600}-\x{06FF}\x{0750}-\x{077F}]", " ",
        ),
        r"\s+", " ",
    )
)


@query(f"SELECT pos, {_SEARCH} AS search_text FROM company")
def searchable_text(spark: SparkSession, d: str) -> DataFrame:
    return records.search_entries(table(spark, d, "company"))


def _one(f: str) -> str:
    if f in ("products", "categories", "brands"):
        return f"CASE WHEN len({f}) > 0 THEN 1 ELSE 0 END"
    return "CASE WHEN is_verified THEN 1 ELSE 0 END" if f == "is_verified" else f"CASE WHEN NOT {S.blank(f)} THEN 1 ELSE 0 END"


def _mean(*fields: str) -> str:
    return "(" + " + ".join(_one(f) for f in fields) + f") / {len(fields)}.0::DOUBLE"


_PARTS = {
    "contact": _mean("email", "phone", "website_url", "linkedin_url", "whatsapp"),
    "service": f"({_one('products')} * 2 + {_one('categories')} * 2 + {_one('description_en')} + {_one('scope_en')}) / 6.0::DOUBLE",
    "brand": f"({_one('brands')})::DOUBLE",
    "social": _mean("linkedin_url", "instagram_url", "twitter_url", "facebook_url"),
    "location": _mean("full_address", "city_id", "region_id"),
    "evidence": _mean("logo_url", "is_verified", "source_url"),
    "bilingual": _mean("name_ar", "description_ar", "seo_title_ar"),
}
_ADVICE = S.messages(("contact < 0.4", "contact"), ("service < 0.4", "service"), ("brand < 0.5", "brand"), ("social < 0.25", "social"), ("location < 0.5", "location"), ("bilingual < 0.5", "bilingual"), ("logo = ''", "logo"))


@query(
    f"WITH p AS (SELECT pos, coalesce(logo_url, '') AS logo, {', '.join(f'{v} AS {k}' for k, v in _PARTS.items())} FROM company),"
    f" o AS (SELECT *, ({' + '.join(_PARTS)}) / 7 AS overall FROM p) SELECT pos, {', '.join(f'round({k} * 100)::INT AS {k}' for k in (*_PARTS, 'overall'))},"
    f" CASE WHEN overall >= 0.8 THEN 'A' WHEN overall >= 0.6 THEN 'B' WHEN overall >= 0.4 THEN 'C' ELSE 'D' END AS grade,"
    f" array_to_string({_ADVICE}, ',') AS advice FROM o"
)
def completeness_score(spark: SparkSession, d: str) -> DataFrame:
    return records.completeness(table(spark, d, "company"))


def _gap(f: str) -> str:
    return f"coalesce(len({f}), 0) = 0" if f in ("categories", "products", "brands") else S.blank(f)


@query(f"SELECT pos, array_to_string({S.messages(*((_gap(f), f) for f in records.MISSABLE))}, ',') AS missing FROM company")
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    return records.missing_fields(table(spark, d, "company"))


@query(
    "SELECT doc_id, length(text) AS n_chars, CASE WHEN length(text) > 12000 THEN substr(text, 1, 12000) || '...[truncated]' ELSE text END AS logged,"
    " CAST(round(length(text) / 4) AS BIGINT) AS token_estimate FROM documents"
)
def log_fields(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    logged, tokens = text.truncated(c).alias("logged"), text.token_estimate(c).alias("token_estimate")
    return table(spark, d, "documents").select("doc_id", F.length(c).cast("long").alias("n_chars"), logged, tokens)


@query()
def text_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Addresses and numbers found in running text."""
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", contact.emails_in(c).alias("emails"), contact.phones_in(c).alias("phones"))


_INNER = "CASE WHEN json_valid(payload) THEN payload WHEN json_valid(regexp_extract(payload, '(?s)\\{.*\\}|\\[.*\\]')) THEN regexp_extract(payload, '(?s)\\{.*\\}|\\[.*\\]') END"


@query(f"SELECT id, nullif({_INNER}, '') IS NOT NULL AS is_json, TRY_CAST(json_extract_string({_INNER}, '$.depth') AS INT) AS depth FROM job")
def payload_json(spark: SparkSession, d: str) -> DataFrame:
    """Job payloads read leniently: whether they hold JSON at all, and the fields used."""
    v = text.lenient_json(F.col("payload"))
    depth = F.try_variant_get(v, "$.depth", "int")
    return table(spark, d, "job").select("id", v.isNotNull().alias("is_json"), depth.alias("depth"))


@query(
    "SELECT id, attempts, CAST(least(60000, 1000 * power(2, greatest(attempts, 1) - 1)) AS BIGINT) AS delay_ms FROM job"
)
def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    delay = text.retry_delay(F.greatest(F.col("attempts"), F.lit(1)))
    return table(spark, d, "job").select("id", "attempts", delay.alias("delay_ms"))


_CSV = ("pos", "name_en", "website_url", "phone", "city", "categories")


def _csv_sql(x: str) -> str:
    t = f"array_to_string({x}, '; ')" if x == "categories" else f"CAST({x} AS VARCHAR)"
    return f"coalesce(CASE WHEN regexp_matches({t}, '[,\"\\n]') THEN '\"' || replace({t}, '\"', '\"\"') || '\"' ELSE {t} END, '')"


@query(f"SELECT pos, {' || chr(44) || '.join(_csv_sql(x) for x in _CSV)} AS line FROM parsed_company")
def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import exports

    return exports.csv_lines(table(spark, d, "parsed_company"), _CSV, keep=("pos",))


@query(
    "SELECT pos, coalesce(name_en, '') AS name_en, coalesce(status, 'pending') AS status, coalesce(is_verified, false) AS is_verified,"
    " coalesce(confidence_score, 0) AS confidence_score, array_to_string(coalesce(categories, []), ';') AS categories FROM company"
)
def api_payload(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import exports

    p = exports.payload(table(spark, d, "company"))
    return p.select("pos", "p.name_en", "p.status", "p.is_verified", "p.confidence_score", F.array_join("p.categories", ";").alias("categories"))


@query()
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import exports

    return exports.json_lines(table(spark, d, "parsed_company"), ("pos", "name_en", "website_url", "linkedin_url", "email"))


_XML = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query(
    "SELECT '<url><loc>' || " + _XML.format(x="'https://directory.example/company/' || slug") + " || '</loc><lastmod>' ||"
    " strftime(coalesce(updated_at, created_at) AT TIME ZONE 'UTC', '%Y-%m-%d') || '</lastmod></url>' AS entry FROM company WHERE status = 'approved' AND slug IS NOT NULL"
    " UNION ALL SELECT '<url><loc>' || " + _XML.format(x="'https://directory.example/category/' || slug") + " || '</loc></url>' FROM canonical_category"
    " UNION ALL SELECT '<url><loc>' || " + _XML.format(x="'https://directory.example/city/' || slug") + " || '</loc></url>' FROM canonical_city"
)
def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import exports

    t = lambda n: table(spark, d, n)
    return exports.sitemap_entries(t("company"), t("canonical_category"), t("canonical_city"), "https://directory.example")
