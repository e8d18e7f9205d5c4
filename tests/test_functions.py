"""Golden values of the column expressions."""

import pytest
from pyspark.sql import functions as F

from tallyard.functions import contact, text, urls
from tallyard.operators import records


def value(spark, build, *args):
    frame = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return frame.select(build(*(F.col(f"c{i}") for i in range(len(args)))).alias("v")).collect()[0].v


@pytest.mark.parametrize(
    "url, expected",
    [
        ("http://WWW.Foo.com/a/?b=2&utm_source=x&a=1", "https://foo.com/a?a=1&b=2"), ("foo.com", "https://foo.com/"), ("https://a.b/x#f", "https://a.b/x#f"),
        ("https://a.b/", "https://a.b/"), ("HTTPS://A.B/X?ref=1", "https://a.b/X"), ("not a url", None), ("", None), (None, None), (" https://a.b/c/ ", "https://a.b/c"),
    ],
)
def test_canonical_url(spark, url, expected):
    once = value(spark, urls.canonical, url)
    assert once == expected
    assert once is None or value(spark, urls.canonical, once) == once


@pytest.mark.parametrize(
    "url, kind, confidence",
    [("https://x.y/contact-us", "contact", 0.95), ("x.y/products/x", "products", 0.8), ("x.y/en", "homepage", 0.95), ("x.y/en/", "other", 0.3), ("x.y/zzz", "other", 0.3), (None, "other", 0.1)],
)
def test_page_kind(spark, url, kind, confidence):
    row = urls.with_page_kind(spark.createDataFrame([(url,)], "url string"), "url").collect()[0]
    assert (row.kind, row.kind_confidence) == (kind, confidence)


@pytest.mark.parametrize(
    "number, expected",
    [
        ("0501234567", "+966501234567"), ("501234567", "+966501234567"), ("0112345678", "+966112345678"), ("966501234567", "+966501234567"),
        ("00966501234567", "+00966501234567"), ("123", None), (None, None), ("(05) 0123-4567", "+966501234567"),
    ],
)
def test_phone_ladder(spark, number, expected):
    assert value(spark, contact.phone, number) == expected


@pytest.mark.parametrize("name, expected", [("Foo Co. Ltd.", "Foo Co."), ("Foo  Bar™ Company", "Foo Bar"), ("شركة كذا المحدودة", "شركة كذا"), ("", ""), (None, None)])
def test_legal_endings(spark, name, expected):
    assert value(spark, text.without_legal_ending, name) == expected


@pytest.mark.parametrize("name, expected", [("Controls & Electrics Arabia Ltd.", "controls-electrics-arabia-ltd"), ("  A  b ", "a-b"), ("شركة", "")])
def test_slug(spark, name, expected):
    assert value(spark, text.slug, name) == expected


def test_country_quirk_and_city(spark):
    assert value(spark, contact.country, "USA") == "Saudi Arabia"
    assert value(spark, lambda c: contact.city(c)["city"], "al riyadh city") == "Riyadh"
    assert value(spark, lambda c: contact.city(c)["city"], "x") is None


def test_emails_and_phones_in_text(spark):
    assert value(spark, contact.emails_in, "mail IR@ACME.COMPhone or hotel@x.example, placeholder@x.example") == ["IR@ACME.COM"]
    assert value(spark, contact.phones_in, "call +966 11 234 5678 or 12") == ["+966 11 234 5678"]


def test_small_decoders(spark):
    key = 0x2A
    code = f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in "a@b.co")
    assert value(spark, text.decoded_email, code) == "a@b.co"
    assert value(spark, text.xml_escaped, "a&b<c>'\"") == "a&amp;b&lt;c&gt;&apos;&quot;"
    assert value(spark, lambda c: text.labelled(c, "phone", "tel"), "Name: A\nTel: 12 \n") == "12"
    assert value(spark, text.product_list, "We sell parts such as pumps, valves and pipes. More.") == ["pumps", "valves", "pipes"]
    title = value(spark, text.split_title, "شركة الخزف (Ceramics Co)")
    assert (title.name_ar, title.name_en) == ("شركة الخزف", "Ceramics Co")


def test_lenient_json(spark):
    def first(c):
        return F.try_variant_get(text.lenient_json(c), "$[0].a", "int")

    assert value(spark, first, 'well: ```json\n[{"a":1}]```') == 1
    assert value(spark, lambda c: text.lenient_json(c).isNull(), "nothing") is True


def test_same_company_names(spark):
    def both(a, b):
        return text.same_company(text.bare_company_name(a), text.bare_company_name(b))

    assert tuple(value(spark, both, "Alpha Ltd", "alpha")) == (True, 0.95)
    assert tuple(value(spark, both, "Co", "Ltd")) == (True, 0.95)
    assert value(spark, both, "Alpha Pumps", "Omega Pipes").matches is False


def test_category_ids(spark):
    frame = spark.createDataFrame([(["Electrical", "4", "Unknown Category", " ", None, "السيارات"],)], "c array<string>")
    assert frame.select(records.category_ids(F.col("c")).alias("v")).collect()[0].v == ["2", "4", "Unknown Category", "7"]


def test_completeness_of_an_empty_record(spark):
    kinds = {f: "array<string>" for f in ("products", "categories", "brands")} | {"is_verified": "boolean", "pos": "long"}
    fields = "pos email phone website_url linkedin_url whatsapp products categories description_en scope_en brands instagram_url twitter_url facebook_url full_address city_id region_id logo_url is_verified source_url name_ar description_ar seo_title_ar".split()
    frame = spark.createDataFrame([(1, *[None] * (len(fields) - 1))], ", ".join(f"{f} {kinds.get(f, 'string')}" for f in fields))
    row = records.completeness(frame).collect()[0]
    assert row.overall == 0 and row.grade == "D" and len(row.advice.split(",")) == 7
