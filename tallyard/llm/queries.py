"""Queries of the training-data operators, by name. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import addresses, canonical, fingerprint, lookalike, matching, names, packing, pairs, residue, survivor, tokenize

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = matching.match_sources(table(spark, d, "chamber_listing"), table(spark, d, "portal_listing"))
    pairs = pairs.filter(F.col("confidence") >= matching.DECISION)
    return pairs.select(F.col("left_pos").alias("chamber_pos"), F.col("right_pos").alias("portal_pos"))


def p1_confidences(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate pair with its calibrated confidence."""
    return matching.match_sources(table(spark, d, "chamber_listing"), table(spark, d, "portal_listing"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_to_canonical(
        table(spark, d, "parsed_company"), table(spark, d, "canonical_city"), table(spark, d, "canonical_category")
    )


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """How many typed items of each field stand for an entry and how many for none."""
    return p2_found(spark, d).groupBy("field_name").agg(
        F.count_if(F.col("ref_id") != canonical.UNMATCHED).alias("n_matched"),
        F.count_if(F.col("ref_id") == canonical.UNMATCHED).alias("n_unmatched"),
    )


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every entry within the distance of each typed city and category."""
    items = canonical.typed_items(table(spark, d, "parsed_company")).select("field_name", "value").distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = None
    for field, name in (("city", "canonical_city"), ("categories", "canonical_category")):
        values = items.filter(F.col("field_name") == field).select("value").repartition(parts, "value")
        found = canonical.entries_within_distance(values, table(spark, d, name)).select(F.lit(field).alias("field_name"), "*")
        out = found if out is None else out.union(found)
    return out.filter("ref_id is not null")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = survivor.surviving_values(table(spark, d, "duplicate_group"), table(spark, d, "company"))
    return found.select("group_id", "field_name", "company_id")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return survivor.surviving_records(table(spark, d, "duplicate_group"), table(spark, d, "company"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_variants(table(spark, d, "portal_listing"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every row's class of one name and the number of other classes linked to it: the result without its pairs."""
    return pairs.class_sizes(*names.name_links(table(spark, d, "portal_listing")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_buildings(table(spark, d, "parsed_company"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every addressed row's class of one writing and the number of other classes linked to it: the result without its pairs."""
    return pairs.class_sizes(*addresses.building_links(table(spark, d, "parsed_company")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.formatting_copies(table(spark, d, "parsed_company"))


def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.collapsed_records(table(spark, d, "parsed_company"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "parsed_company"))


def p7_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How many values each path of the method finds first: a left-over slot, a repeated page, a wording."""
    found = residue.residue_reasons(table(spark, d, "parsed_company"))
    return found.groupBy("field_name", "reason").agg(F.count(F.lit(1)).alias("n"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents and those whose decoded ids give back the text byte for byte (null and empty texts as empty)."""
    documents = table(spark, d, "documents")
    shipped = tokenize.ship_model(spark)
    ids = documents.select("text", tokenize.encode_column(F.col("text"), shipped).alias("ids"))
    back = ids.select(F.coalesce("text", F.lit("")).alias("text"), tokenize.decode_column(F.col("ids"), shipped).alias("back"))
    return back.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("text") == F.col("back")).alias("n_same"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """The bin of every text, or piece of one, for each capacity."""
    return packing.fill_containers(table(spark, d, "documents"), table(spark, d, "container_spec")).drop("load")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Bins and share of the space used for each capacity."""
    containers = table(spark, d, "container_spec")
    return packing.fill_report(packing.fill_containers(table(spark, d, "documents"), containers), containers)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look_pairs(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a look-alike, its class and the number of other texts that look the same: the result without its pairs."""
    return lookalike.look_classes(table(spark, d, "documents"))


def p10_form(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_form(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit() and callable(f)}


#: SQL for DuckDB where SQL can state the result.
ORACLE = {
    "p8_round_trip": "SELECT count(*) AS n_docs, count(*) AS n_same FROM documents",
    "p6_found": r"""
        WITH f AS (
            SELECT pos, coalesce(name_en, '') AS a, coalesce(website_url, '') AS b FROM parsed_company
        ), u AS (
            SELECT pos, 1 AS side, a AS t FROM f UNION ALL SELECT pos, 2, b FROM f
        ), q AS (
            SELECT pos, side, t, strpos(t, '?') > 0 AND strpos(substr(t, greatest(strpos(t, '?'), 1)), '=') > 0 AS is_link FROM u
        ), s AS (
            SELECT pos, side,
                lower(regexp_replace(CASE WHEN is_link THEN substr(t, 1, strpos(t, '?') - 1) ELSE t END, '[^\p{L}\p{Nd}]', '', 'g')) AS base,
                CASE WHEN is_link THEN split_part(substr(t, strpos(t, '?') + 1), '#', 1) ELSE '' END AS params,
                CASE WHEN is_link AND strpos(substr(t, strpos(t, '?')), '#') > 0 THEN substr(substr(t, strpos(t, '?')), strpos(substr(t, strpos(t, '?')), '#')) ELSE '' END AS frag
            FROM q
        ), k AS (
            SELECT pos, side, base || '?' || array_to_string(list_sort(list_filter(list_transform(string_split(params, '&'),
                lambda x: lower(regexp_replace(x, '[^\p{L}\p{Nd}]', '', 'g'))), lambda y: y <> '')), '&')
                || '#' || lower(regexp_replace(frag, '[^\p{L}\p{Nd}]', '', 'g')) AS key FROM s
        ), r AS (
            SELECT pos, array_to_string(list_sort(list(key)), chr(10)) AS key FROM k GROUP BY pos
        ), m AS (SELECT pos, min(pos) OVER (PARTITION BY key) AS first_pos FROM r)
        SELECT first_pos, pos AS copy_pos FROM m WHERE pos <> first_pos""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
