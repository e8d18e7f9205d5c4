"""Record normalising, validation and scoring as column expressions over one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contact, text, urls

# Kinds of business and fallbacks of a newly found record.
BUSINESS_TYPES = ("vendor", "manufacturer", "trader")
FALLBACK = {"name": "Unknown Company", "address": "Saudi Arabia", "city_id": "1", "region_id": "1", "status": "pending"}
# Categories by id with English and Arabic name.
CATEGORIES = (
    ("1", "Industrial Equipment", "المعدات الصناعية"), ("2", "Electrical", "الكهرباء"), ("3", "Food Manufacturing", "تصنيع الأغذية"),
    ("4", "Building Materials", "مواد البناء"), ("5", "Medical Supplies", "المستلزمات الطبية"), ("6", "Chemicals", "المواد الكيميائية"),
    ("7", "Automotive", "السيارات"),
)
MISSABLE = ("categories", "products", "description_en", "description_ar", "brands", "scope_en")


def listed(*pairs: tuple[Column, Column]) -> Column:
    """Messages whose condition holds, in order; an unknown condition doesn't hold."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), m) for c, m in pairs)), lambda x: x.isNotNull())


def valid_name(c: Column, arabic: bool = False) -> Column:
    length = F.length(text.trim(c)).between(2, 200)
    letters = r"^[؀-ۿݐ-ݿࢠ-ࣿ -⁯⸀-⹿\s\x21-\x7E]+$" if arabic else r"^[\s\x21-\x7EÀ-ſ]+$"
    return F.coalesce(length & c.rlike(letters), F.lit(False))


def valid_items(c: Column) -> Column:
    return c.isNull() | F.forall(c, lambda x: F.coalesce((text.trim(x) != "") & (F.length(x) <= 100), F.lit(False)))


def validated(rows: DataFrame) -> DataFrame:
    """``errors``, ``warnings`` and ``is_valid`` of directory records."""
    c = F.col
    has = lambda f: F.coalesce(c(f) != "", F.lit(False))
    errors = listed(
        (~valid_name(c("name_en")) & ~valid_name(c("name_en"), True), F.lit("name")),
        (has("website_url") & ~urls.is_http(c("website_url")), F.lit("website")),
        (has("phone") & ~contact.valid_phone(c("phone")), F.lit("phone")),
        (has("email") & ~contact.valid_email(c("email")), F.lit("email")),
        (has("city") & ~(F.length(text.trim(c("city"))).between(2, 100) & text.trim(c("city")).rlike(r"^[a-zA-ZÀ-ſ\s\-']+$")), F.lit("city")),
        (~valid_items(c("categories")), F.lit("categories")),
        (~valid_items(c("products")), F.lit("products")),
    )
    warnings = listed(
        (~valid_name(c("name_en")) & valid_name(c("name_en"), True), F.lit("arabic name_en")),
        (has("name_ar") & ~valid_name(c("name_ar"), True), F.lit("name_ar")),
    )
    return rows.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("is_valid", F.size("errors") == 0)


def checked_before_saving(rows: DataFrame) -> DataFrame:
    """Errors that block a stored record and warnings that don't."""
    c = F.col
    has = lambda f: F.coalesce(c(f) != "", F.lit(False))
    errors = listed(
        (text.blank(c("name_en")), F.lit("name_en is required")),
        (text.blank(c("slug")), F.lit("slug is required")),
        (~has("business_type"), F.lit("business_type is required")),
        (has("email") & ~c("email").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit("email has invalid format")),
        (has("website_url") & ~c("website_url").rlike(r"(?i)^https?://.+"), F.lit("website_url has invalid format")),
        (has("logo_url") & ~c("logo_url").rlike(r"(?i)^https?://.+"), F.lit("logo_url has invalid format")),
    )
    warnings = listed(
        (has("phone") & ~F.regexp_replace(c("phone"), r"[\s\-().]", "").rlike(r"^\+?[0-9]{7,15}$"), F.lit("phone format looks unusual")),
        ((c("confidence_score") < 0) | (c("confidence_score") > 1), F.lit("confidence_score out of range")),
        (has("description_en") & (F.length("description_en") < 10), F.lit("description_en is very short")),
        (~has("city_id"), F.lit("city_id is missing")),
        (~has("region_id"), F.lit("region_id is missing")),
    )
    return rows.withColumn("errors", errors).withColumn("warnings", warnings)


def normalised(rows: DataFrame) -> DataFrame:
    """Junk to null, then legal endings, telephone, e-mail, city; the original where normalising gives nothing."""
    j = lambda f: text.junk_to_null(F.col(f))
    return rows.withColumns(
        {
            "name_en": F.coalesce(text.without_legal_ending(j("name_en")), j("name_en")),
            "phone": F.coalesce(contact.phone(j("phone")), j("phone")),
            "email": F.coalesce(contact.email(j("email")), j("email")),
            "city": F.coalesce(contact.city(j("city"))["city"], j("city")),
        }
    )


def sanitised_record(rows: DataFrame) -> DataFrame:
    """Texts and lists of texts sanitised, links with a scheme first; city and address, which are no stored columns, are dropped."""
    changed = {}
    for name, kind in rows.dtypes:
        c = F.col(name)
        if name == "website_url":
            prefixed = F.when(c.startswith("http://") | c.startswith("https://"), c).otherwise(F.concat(F.lit("https://"), c))
            changed[name] = F.when(c == "", c).otherwise(text.sanitised(prefixed))
        elif kind == "string":
            changed[name] = text.sanitised(c)
        elif kind == "array<string>":
            changed[name] = F.transform(c, text.sanitised)
    return rows.withColumns(changed).drop("city", "address")


def with_defaults(rows: DataFrame) -> DataFrame:
    """Defaults of a newly found record: names, slug, descriptions, address, ids, status."""
    t = lambda f: text.filled(F.col(f))
    name = F.coalesce(t("name_en"), F.lit(FALLBACK["name"]))
    return rows.select(
        "pos",
        name.alias("name_en"),
        F.coalesce(t("name_ar"), name).alias("name_ar"),
        text.slug(name).alias("slug"),
        F.coalesce(t("description_en"), name).alias("description_en"),
        F.coalesce(t("description_ar"), t("description_en"), name).alias("description_ar"),
        F.coalesce(t("full_address"), t("city"), F.lit(FALLBACK["address"])).alias("full_address"),
        F.lit(FALLBACK["city_id"]).alias("city_id"),
        F.lit(FALLBACK["region_id"]).alias("region_id"),
        F.lit(FALLBACK["status"]).alias("status"),
        F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"),
    )


def category_ids(labels: Column, categories=CATEGORIES) -> Column:
    """Labels as ids: by id, by English name in any case, by Arabic name; unknown ones stay; blanks are dropped."""
    by = {}
    for ident, en, ar in reversed(categories):
        by |= {ident: ident, en.lower(): ident, ar: ident}
    known = F.create_map(*(F.lit(x) for pair in by.items() for x in pair))
    kept = F.filter(F.transform(labels, text.trim), lambda x: x != "")
    return F.transform(kept, lambda x: F.coalesce(F.try_element_at(known, x), F.try_element_at(known, F.lower(x)), x))


def category_ids_joined(rows: DataFrame, reference: DataFrame, key: str, labels: str) -> DataFrame:
    """``key, ids``: the same for a reference table of any size, by joins on its three kinds of names."""
    items = rows.select(key, F.posexplode(F.filter(F.transform(labels, text.trim), lambda x: x != "")).alias("place", "label"))
    named = F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), c.alias("name")) for i, c in enumerate((F.col("id"), F.lower("name_en"), F.col("name_ar"))))))
    names = reference.select("id", named.alias("n")).filter("n.name is not null").select("id", "n.*")
    first = names.groupBy("name").agg(F.min_by("id", F.struct("rank", "id")).alias("found"))
    low = first.select(F.col("name").alias("low"), F.col("found").alias("found_low"))
    met = items.join(first, F.col("label") == F.col("name"), "left").withColumn("low", F.lower("label")).join(low, "low", "left")
    held = F.sort_array(F.collect_list(F.struct("place", F.coalesce("found", "found_low", "label").alias("id"))))
    return met.groupBy(key).agg(F.transform(held, lambda x: x["id"]).alias("ids"))


def completeness(rows: DataFrame, key: str = "pos") -> DataFrame:
    """Seven part scores (0..100), the overall score, a grade and what to add."""
    c = F.col

    def one(f: str) -> Column:
        kind = dict(rows.dtypes)[f]
        if kind.startswith("array"):
            return (F.coalesce(F.size(f), F.lit(0)) > 0).cast("int")
        if kind == "boolean":
            return F.coalesce(c(f), F.lit(False)).cast("int")
        return (~text.blank(c(f))).cast("int")

    def mean(*fields: str) -> Column:
        return sum((one(f) for f in fields[1:]), one(fields[0])) / len(fields)

    parts = {
        "contact": mean("email", "phone", "website_url", "linkedin_url", "whatsapp"),
        "service": (one("products") * 2 + one("categories") * 2 + one("description_en") + one("scope_en")) / 6,
        "brand": one("brands").cast("double"),
        "social": mean("linkedin_url", "instagram_url", "twitter_url", "facebook_url"),
        "location": mean("full_address", "city_id", "region_id"),
        "evidence": mean("logo_url", "is_verified", "source_url"),
        "bilingual": mean("name_ar", "description_ar", "seo_title_ar"),
    }
    out = rows.select(key, F.coalesce(c("logo_url"), F.lit("")).alias("_logo"), *(v.alias(k) for k, v in parts.items()))
    out = out.withColumn("overall", sum((c(p) for p in list(parts)[1:]), c("contact")) / 7)
    grade = F.when(c("overall") >= 0.8, "A").when(c("overall") >= 0.6, "B").when(c("overall") >= 0.4, "C").otherwise("D")
    advice = listed(
        *((c(p) < least, F.lit(p)) for p, least in (("contact", 0.4), ("service", 0.4), ("brand", 0.5), ("social", 0.25), ("location", 0.5), ("bilingual", 0.5))),
        (c("_logo") == "", F.lit("logo")),
    )
    scores = [F.round(c(p) * 100).cast("int").alias(p) for p in (*parts, "overall")]
    return out.select(key, *scores, grade.alias("grade"), F.array_join(advice, ",").alias("advice"))


def missing_fields(rows: DataFrame, key: str = "pos", fields: tuple[str, ...] = MISSABLE) -> DataFrame:
    kinds = dict(rows.dtypes)
    test = lambda f: F.coalesce(F.size(f), F.lit(0)) == 0 if kinds[f].startswith("array") else text.blank(F.col(f))
    return rows.select(key, F.array_join(listed(*((test(f), F.lit(f)) for f in fields)), ",").alias("missing"))


def search_entries(rows: DataFrame, key: str = "pos") -> DataFrame:
    """Search text of stored records."""
    c = F.col
    lists = [F.array_join(F.coalesce(f, F.array().cast("array<string>")), " | ") for f in ("categories", "products", "brands")]
    parts = [F.when(x != "", x) for x in (c("name_en"), c("name_ar"), c("business_type"), c("description_en"), c("description_ar"), c("city"), *lists)]
    return rows.select(key, text.search_text(*parts).alias("search_text"))
