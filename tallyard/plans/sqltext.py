"""Pieces of DuckDB SQL that state the same rules as the expressions in :mod:`tallyard.functions`."""

from __future__ import annotations

from ..functions import contact, text, urls

SP = r"[\s\x{0B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {trim(x)} = '')"


def filled(x: str) -> str:
    return f"CASE WHEN NOT {blank(x)} THEN {trim(x)} END"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def clean(x: str) -> str:
    return trim(sub(sub(x, f"{SP}+", " "), r"[\x{200B}-\x{200D}\x{FEFF}]|[™®©]"))


def junk_to_null(x: str) -> str:
    return f"CASE WHEN {trim(x)} NOT IN ({', '.join(map(lit, text.JUNK))}) THEN {clean(x)} END"


def slug(x: str) -> str:
    t = sub(trim(f"lower({x})"), f"{SP}+", "-")
    return sub(sub(sub(t, "[^a-z0-9-]"), "-+", "-"), "^-|-$")


def legal(x: str) -> str:
    t = trim(x)
    for ending in text.LEGAL_ENDINGS:
        escaped = ending.replace(".", r"\.")
        t = sub(t, f"(?i){SP}+{escaped}$")
    return sub(trim(sub(t, f"{SP}+", " ")), "[™®©]")


def name_key(x: str) -> str:
    t = sub(f"lower({trim(x)})", r"\s*\|\s*[^|]* guide\s*$")
    t = sub(sub(t, r"\x{00A0}", " "), r"[^\p{L}\p{N}\s.-]+", " ")
    return trim(sub(t, r"\s+", " "))


_PARTS = r"^(?i:(https?):)?(?://)?([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def is_url(x: str) -> str:
    return matches(trim(x), r"^(?i:(?:https?://)?[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?(?::\d+)?(?:[/?#]\S*)?)$")


def part(x: str, n: int) -> str:
    return f"regexp_extract({trim(x)}, {lit(_PARTS)}, {n})"


def domain(x: str) -> str:
    host = sub(f"lower({part(x, 2)})", r"^www\.")
    return f"CASE WHEN {is_url(x)} THEN {host} END"


def path(x: str) -> str:
    return f"CASE WHEN {is_url(x)} THEN CASE WHEN {part(x, 3)} = '' THEN '/' ELSE {part(x, 3)} END END"


def canonical(x: str) -> str:
    p = f"({path(x)})"
    p = f"CASE WHEN length({p}) > 1 THEN regexp_replace({p}, '/$', '') ELSE {p} END"
    tracked = ", ".join(map(lit, urls.TRACKING))
    raw = sub(part(x, 4), r"^\?")
    params = f"list_sort(list_filter(string_split({raw}, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({tracked})))"
    query = f"CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END"
    return f"CASE WHEN {is_url(x)} THEN 'https://' || ({domain(x)}) || ({p}) || ({query}) || {part(x, 5)} END"


def page_kind(x: str) -> tuple[str, str]:
    p = f"lower({path(x)})"
    low = f"regexp_replace({p}, '/$', '')"
    kind, score = f"CASE WHEN ({p}) IS NULL THEN 'other'", f"CASE WHEN ({p}) IS NULL THEN 0.1"
    homes = ", ".join(map(lit, urls.HOME_PATHS))
    kind, score = f"{kind} WHEN ({p}) IN ({homes}) THEN 'homepage'", f"{score} WHEN ({p}) IN ({homes}) THEN 0.95"
    for pattern, name, priority in urls.PAGE_KINDS:
        kind += f" WHEN contains({low}, '{pattern}') THEN '{name}'"
        score += f" WHEN contains({low}, '{pattern}') THEN {min(0.95, 0.5 + priority / 20)}"
    return f"{kind} ELSE 'other' END", f"CAST({score} ELSE 0.3 END AS DOUBLE)"


def phone(x: str) -> str:
    c = sub(sub(x, r"[\s\-().]"), "[^0-9+]")
    made = f"""CASE WHEN {c} LIKE '05%' THEN '+966' || substr({c}, 2) WHEN {c} LIKE '5%' AND length({c}) = 9 THEN '+966' || {c}
        WHEN {c} LIKE '01%' AND length({c}) >= 10 THEN '+966' || substr({c}, 2)
        WHEN {c} LIKE '1%' AND length({c}) = 9 THEN '+966' || {c} WHEN {c} LIKE '+966%' THEN {c} WHEN {c} LIKE '966%' THEN '+' || {c}
        WHEN length({c}) BETWEEN 7 AND 15 THEN CASE WHEN {c} LIKE '+%' THEN {c} ELSE '+' || {c} END END"""
    return f"CASE WHEN regexp_matches({made}, '^\\+[0-9]{{7,15}}$') THEN {made} END"


def city(x: str) -> str:
    low = f"lower({trim(x)})"
    out = f"CASE WHEN {blank(x)} THEN NULL"
    for piece, name in contact.CITIES:
        out += f" WHEN contains({low}, {lit(piece)}) THEN {lit(name)}"
    return out + f" WHEN length({low}) BETWEEN 2 AND 49 THEN {trim(x)} END"


def country(x: str) -> str:
    low = f"lower({trim(x)})"
    known = " OR ".join(f"contains({low}, {lit(p)})" for p in contact.COUNTRY)
    return f"CASE WHEN {blank(x)} THEN NULL WHEN {known} THEN 'Saudi Arabia' ELSE {trim(x)} END"


def messages(*pairs: tuple[str, str]) -> str:
    items = ", ".join(f"CASE WHEN {c} THEN {lit(m)} END" for c, m in pairs)
    return f"list_filter([{items}], lambda m: m IS NOT NULL)"
