"""Text expressions: cleaning, slugs, search text, lenient JSON, small decoders. All are Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers understand it.
SPACE = r"[\s   -     　﻿]"
# Texts that stand for a missing value, compared exactly.
JUNK = ("", "null", "undefined", "N/A", "n/a", "-", "—", "TBD", "TBA")
# Legal endings of names, each tried once in this order.
LEGAL_ENDINGS = (
    "co.", "corp.", "ltd.", "llc", "inc.", "gmbh", "ag", "limited", "corporation", "company", "establishment",
    "للمساهمة", "المحدودة", "ذات المسؤولية المحدودة",
)
# Words after which products are listed.
PRODUCT_MARKERS = ("namely", "such as", "including", "like")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def blank(c: Column) -> Column:
    return c.isNull() | (trim(c) == "")


def filled(c: Column) -> Column:
    """The trimmed text, null for a blank one."""
    return F.nullif(trim(c), F.lit(""))


def clean(c: Column) -> Column:
    """White space squeezed, then zero-width characters and trade marks removed, then trimmed."""
    t = F.regexp_replace(c, f"{SPACE}+", " ")
    t = F.regexp_replace(t, r"[​-‍﻿]|[™®©]", "")
    return trim(t)


def junk_to_null(c: Column) -> Column:
    return F.when(~trim(c).isin(*JUNK), clean(c))


def without_legal_ending(name: Column) -> Column:
    """Each legal ending is taken off at most once, in the fixed order; then squeezed and without trade marks."""
    t = trim(name)
    for ending in LEGAL_ENDINGS:
        t = F.regexp_replace(t, f"(?iu){SPACE}+{ending.replace('.', chr(92) + '.')}$", "")
    return F.regexp_replace(trim(F.regexp_replace(t, f"{SPACE}+", " ")), "[™®©]", "")


def slug(name: Column) -> Column:
    t = F.regexp_replace(trim(F.lower(name)), f"{SPACE}+", "-")
    t = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9-]", ""), "-+", "-")
    return F.regexp_replace(t, "^-|-$", "")


def slug_any(name: Column) -> Column:
    """Slug that keeps Arabic letters."""
    t = F.regexp_replace(trim(F.lower(name)), f"{SPACE}+", "-")
    t = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9\\u0600-\\u06ff-]", ""), "-+", "-")
    return F.regexp_replace(t, "^-|-$", "")


def search_text(*parts: Column) -> Column:
    """Parts joined, lower case, only ASCII word characters and Arabic; squeezed."""
    t = F.lower(F.concat_ws(" | ", *parts))
    t = F.regexp_replace(t, "[^a-zA-Z0-9_\\s\\u0600-\\u06ff\\u0750-\\u077f]", " ")
    return trim(F.regexp_replace(t, "\\s+", " "))


def name_key(name: Column) -> Column:
    """Key of a name: lower case, letters, digits, points and hyphens, squeezed."""
    t = F.regexp_replace(F.lower(trim(name)), "\\s*\\|\\s*[^|]* guide\\s*$", "")
    t = F.regexp_replace(F.regexp_replace(t, "\\u00a0", " "), "[^\\p{L}\\p{N}\\s.-]+", " ")
    return trim(F.regexp_replace(t, "\\s+", " "))


def strict_key(name: Column) -> Column:
    return F.regexp_replace(name_key(name), "[\\s.-]+", "")


def sanitised(c: Column) -> Column:
    """Scripts, frames and script protocols removed."""
    t = F.regexp_replace(c, r"(?is)<script\b.*?</script>|<iframe\b.*?</iframe>", "")
    return trim(F.regexp_replace(t, r"(?i)javascript:|vbscript:|onload=|onerror=", ""))


def arabic_share(c: Column) -> Column:
    """Share of Arabic letters among all characters; null for null and empty."""
    return F.try_divide(F.length(F.regexp_replace(c, "[^\\u0600-\\u06ff]", "")), F.length(c))


def split_title(c: Column) -> Column:
    """``struct<name_ar, name_en>`` of a title like ``Arabic (English)``."""
    arabic, inner = F.regexp_extract(c, r"^\s*(.*?)\s*\(([^()]*)\)\s*$", 1), F.regexp_extract(c, r"^\s*(.*?)\s*\(([^()]*)\)\s*$", 2)
    mixed = arabic.rlike("[\\u0600-\\u06ff]") & inner.rlike("[A-Za-z]")
    only = c.rlike("[\\u0600-\\u06ff]") & ~c.rlike("[A-Za-z]")
    return F.struct(
        F.when(mixed, arabic).when(only, trim(c)).alias("name_ar"),
        F.when(mixed, trim(inner)).when(~only, trim(c)).alias("name_en"),
    )


def labelled(c: Column, *labels: str) -> Column:
    """Text after the first ``Label:`` to the end of the line; null if there is none."""
    found = F.regexp_extract(c, rf"(?im)^\s*(?:{'|'.join(labels)})\s*[:：]\s*(.+?)\s*$", 1)
    return F.when(found != "", found)


def product_list(c: Column, most: int = 15) -> Column:
    """Items listed after the first marker word, in the order of the markers."""
    rest = F.coalesce(
        *(F.when(F.lower(c).contains(f"{m} "), F.regexp_extract(c, rf"(?is)\b{m}\s+(.*)$", 1)) for m in PRODUCT_MARKERS)
    )
    items = F.split(F.regexp_extract(rest, r"(?s)^([^.;\n]*)", 1), r"\s*,\s*|\s+and\s+|\s*&\s*")
    return F.slice(F.array_distinct(F.filter(F.transform(items, trim), lambda x: F.length(x) >= 2)), 1, most)


def xml_escaped(c: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, c)


def decoded_email(code: Column) -> Column:
    """Address hidden as hexadecimal bytes, each combined by exclusive or with the first."""
    byte = lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int")
    places = F.sequence(F.lit(3), F.length(code) - 1, F.lit(2))
    letters = F.transform(places, lambda i: F.char(byte(i).bitwiseXOR(byte(F.lit(1)))))
    return F.when(code.rlike("^(?:[0-9a-fA-F]{2}){2,}$"), F.array_join(letters, ""))


def lenient_json(c: Column) -> Column:
    """A JSON text as variant: the whole text, else its outermost object or array, else null."""
    bare = F.regexp_replace(F.regexp_replace(trim(c), r"(?is)^```(?:json)?", ""), "```$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}|\[.*\]", 0)
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.when(inner != "", inner)))


def truncated(c: Column, most: int = 12_000) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("...[truncated]"))).otherwise(c)


def token_estimate(c: Column) -> Column:
    return F.round(F.length(c) / 4).cast("long")


def similarity(a: Column, b: Column) -> Column:
    """(longer - edit distance) / longer, in lower case; 0 where either is null or empty."""
    longer = F.greatest(F.length(a), F.length(b))
    s = F.try_divide(longer - F.levenshtein(F.lower(a), F.lower(b)), longer)
    return F.when((F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0), F.lit(0.0)).otherwise(s)


def bare_company_name(c: Column) -> Column:
    """Lower case, legal words removed anywhere, squeezed."""
    legal = r"(?<![A-Za-z0-9_])(?:inc|llc|ltd|corp|co|gmbh|ag|limited|corporation|company)(?![A-Za-z0-9_])\.?"
    return trim(F.regexp_replace(F.regexp_replace(F.lower(c), legal, ""), f"{SPACE}+", " "))


def same_company(a: Column, b: Column) -> Column:
    """``struct<matches, confidence>`` of two bare names (see :func:`bare_company_name`)."""
    la, lb = F.length(a), F.length(b)
    ratio = F.try_divide(F.least(la, lb), F.greatest(la, lb))
    s = similarity(a, b)
    pair = lambda m, c: F.struct(m.alias("matches"), c.cast("double").alias("confidence"))
    return (
        F.when(a == b, pair(F.lit(True), F.lit(0.95)))
        .when(a.contains(b) | b.contains(a), pair(ratio > 0.7, ratio * 0.8))
        .when(s > 0.85, pair(F.lit(True), s * 0.9))
        .otherwise(pair(F.lit(False), s))
    )


def token_overlap(a: Column, b: Column, least: int = 3) -> Column:
    """Shared tokens over the smaller token set; 0 if either is empty."""
    def tokens(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least))

    smaller = F.least(F.size(tokens(a)), F.size(tokens(b)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(tokens(a), tokens(b))), smaller), F.lit(0.0))


def retry_delay(attempt: Column, base: int = 1000, most: int = 60_000) -> Column:
    """Milliseconds before an attempt: base * 2^(attempt - 1), bounded."""
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt - 1)).cast("long")
