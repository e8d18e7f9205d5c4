"""Contact expressions: telephone numbers, e-mail addresses, places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, trim

# Cities by what their name contains, first match wins.
CITIES = (
    ("riyadh", "Riyadh"), ("الرياض", "Riyadh"), ("jeddah", "Jeddah"), ("جدة", "Jeddah"), ("mecca", "Mecca"), ("مكة", "Mecca"),
    ("medina", "Medina"), ("المدينة", "Medina"), ("dammam", "Dammam"), ("الدمام", "Dammam"), ("khobar", "Al Khobar"),
    ("الخبر", "Al Khobar"), ("dhahran", "Dhahran"), ("الظهران", "Dhahran"), ("tabuk", "Tabuk"), ("تبوك", "Tabuk"),
    ("abha", "Abha"), ("أبها", "Abha"), ("hail", "Hail"), ("حائل", "Hail"), ("buraydah", "Buraydah"), ("بريدة", "Buraydah"),
    ("taif", "Taif"), ("الطائف", "Taif"), ("yanbu", "Yanbu"), ("ينبع", "Yanbu"), ("najran", "Najran"), ("نجران", "Najran"),
    ("jazan", "Jazan"), ("جازان", "Jazan"),
)
# What names of the country contain.
COUNTRY = ("saudi arabia", "ksa", "sa", "saudi", "المملكة العربية السعودية")


def phone(number: Column) -> Column:
    """International form of a telephone number, null for what can't be one."""
    c = F.regexp_replace(F.regexp_replace(number, r"[\s\-().]", ""), r"[^0-9+]", "")
    n = F.length(c)
    made = (
        F.when(c.startswith("05"), F.concat(F.lit("+966"), F.substring(c, F.lit(2), n)))
        .when(c.startswith("5") & (n == 9), F.concat(F.lit("+966"), c))
        .when(c.startswith("01") & (n >= 10), F.concat(F.lit("+966"), F.substring(c, F.lit(2), n)))
        .when(c.startswith("1") & (n == 9), F.concat(F.lit("+966"), c))
        .when(c.startswith("+966"), c)
        .when(c.startswith("966"), F.concat(F.lit("+"), c))
        .when(n.between(7, 15), F.when(c.startswith("+"), c).otherwise(F.concat(F.lit("+"), c)))
    )
    return F.when(made.rlike(r"^\+[0-9]{7,15}$"), made)


def email(address: Column) -> Column:
    """Trimmed lower-case address, null for a malformed one."""
    e = F.lower(trim(address))
    return F.when(e.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), e)


def valid_email(address: Column) -> Column:
    ok = address.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$") & (F.length(address) <= 254)
    return F.coalesce(ok, F.lit(False))


def valid_phone(number: Column) -> Column:
    return F.coalesce(F.regexp_replace(number, r"[\s\-()+.]", "").rlike("^[0-9]{7,15}$"), F.lit(False))


def city(name: Column) -> Column:
    """``struct<city, confidence>``: a known city contained in the text, else the text itself if of usual length."""
    low = F.lower(trim(name))
    pair = lambda c, s: F.struct(c.alias("city"), F.lit(s).alias("confidence"))
    out = F.when(blank(name), pair(F.lit(None).cast("string"), 0.0))
    for part, canonical in CITIES:
        out = out.when(low.contains(part), pair(F.lit(canonical), 0.9))
    return out.when(F.length(low).between(2, 49), pair(trim(name), 0.3)).otherwise(pair(F.lit(None).cast("string"), 0.0))


def country(name: Column) -> Column:
    low = F.lower(trim(name))
    known = low.contains(COUNTRY[0])
    for part in COUNTRY[1:]:
        known = known | low.contains(part)
    return F.when(blank(name), F.lit(None)).when(known, F.lit("Saudi Arabia")).otherwise(trim(name))


def emails_in(text: Column) -> Column:
    """Distinct addresses in a text in order of appearance, labels glued behind them cut off."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,24})(?![a-zA-Z])"), 1))
    cut = F.transform(found, lambda e: trim(F.regexp_replace(e, "(?i)(phone|tel|location).*", "")))
    return F.filter(cut, lambda e: ~e.contains("placeholder") & (F.length(e) > 5))


def phones_in(text: Column) -> Column:
    """Distinct numbers of 7 to 15 digits in a text, in order of appearance."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(\+?\d[\d\s\-()]{6,30}\d)"), 1), trim))
    return F.filter(found, lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")).between(7, 15))
