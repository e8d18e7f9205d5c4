"""Sinks: row texts for CSV, JSON and sitemaps, nested API payloads, and writers that never overwrite what they read."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls

BOM = "﻿"


def csv_lines(rows: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One text per row: quoted only where needed, arrays joined by ``; ``, null empty."""
    kinds = dict(rows.dtypes)

    def cell(f: str) -> Column:
        c = F.array_join(f, "; ") if kinds[f].startswith("array") else F.col(f).cast("string")
        quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(c.rlike('[,"\n]'), quoted).otherwise(c), F.lit(""))

    return rows.select(*keep, F.concat_ws(",", *map(cell, fields)).alias("line"))


def write_csv(rows: DataFrame, fields: Sequence[str], path: str) -> None:
    """Text files with a byte order mark and header in each."""
    header = BOM + ",".join(fields)
    lines = csv_lines(rows, fields)
    lines.mapInPandas(_with_header(header), "line string").write.text(path)


def _with_header(header: str):
    def add(parts):
        import pandas as pd

        yield pd.DataFrame({"line": [header]})
        yield from parts

    return add


def json_lines(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One JSON object per row; links are canonical, null fields are left out."""
    cell = lambda f: (urls.canonical(F.col(f)) if f.endswith("_url") else F.col(f)).alias(f)
    return rows.select(F.to_json(F.struct(*map(cell, fields))).alias("json"))


def payload(rows: DataFrame) -> DataFrame:
    """``pos`` and nested record ``p`` with defaults in place of nulls."""
    none = F.array().cast("array<string>")
    p = F.struct(
        *(F.coalesce(f, F.lit("")).alias(f) for f in ("id", "slug", "name_en", "name_ar", "description_en", "description_ar")),
        F.struct(*(F.coalesce(f, F.lit("")).alias(f) for f in ("email", "phone", "website_url"))).alias("contact"),
        F.struct("city_id", "region_id", F.coalesce("full_address", F.lit("")).alias("full_address")).alias("location"),
        *(F.coalesce(f, none).alias(f) for f in ("categories", "brands", "products")),
        F.coalesce("is_verified", F.lit(False)).alias("is_verified"),
        F.coalesce("status", F.lit("pending")).alias("status"),
        F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"),
    )
    return rows.select("pos", p.alias("p"))


def sitemap_entries(companies: DataFrame, categories: DataFrame, cities: DataFrame, base: str) -> DataFrame:
    """One ``url`` element per approved company, category and city."""

    def entry(kind: str, modified: Column | None = None) -> Column:
        loc = text.xml_escaped(F.concat(F.lit(f"{base}/{kind}/"), "slug"))
        changed = [F.lit("<lastmod>"), modified, F.lit("</lastmod>")] if modified is not None else []
        return F.concat(F.lit("<url><loc>"), loc, F.lit("</loc>"), *changed, F.lit("</url>")).alias("entry")

    approved = companies.filter((F.col("status") == "approved") & F.col("slug").isNotNull())
    day = F.date_format(F.coalesce("updated_at", "created_at"), "yyyy-MM-dd")
    return approved.select(entry("company", day)).unionByName(categories.select(entry("category"))).unionByName(cities.select(entry("city")))


def upserted(table: DataFrame, changes: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Table after an upsert: for each key the row with the latest version; changes win ties."""
    rows = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    others = [c for c in table.columns if c not in key]
    best = F.max_by(F.struct(*others), F.struct(*version, "_new")).alias("_r")
    return rows.groupBy(*key).agg(best).select(*key, "_r.*").select(*table.columns)


def patched(table: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Table after a partial update: only the columns of ``patches`` change, null being a value like any other."""
    changed = [c for c in patches.columns if c != key]
    right = patches.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in changed), F.lit(True).alias("_hit"))
    joined = table.join(right, key, "left")
    return joined.select(*((F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)) for c in table.columns))


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def with_ids(rows: DataFrame, order: str, last: int, alias: str = "new_id") -> DataFrame:
    """Consecutive ids after ``last`` in the order of a column.

    Rows are range-partitioned and numbered within partitions; offsets come from the counts of the partitions, so no task
    sorts all rows.
    """
    ranged = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    ranged = ranged.withColumn("_m", F.monotonically_increasing_id())
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    ranged = ranged.withColumn("_p", part).withColumn("_k", place)
    from ..session import materialise

    kept = materialise(ranged.drop("_m"))
    counts = {r[0]: r[1] for r in kept.groupBy("_p").count().collect()}
    offsets, total = {}, last
    for p in sorted(counts):
        offsets[p] = total
        total += counts[p]
    offset = F.create_map(*(F.lit(x) for p in offsets.items() for x in p)) if offsets else F.create_map(F.lit(0), F.lit(0))
    return kept.withColumn(alias, (offset[F.col("_p")] + F.col("_k") + 1).cast("long")).drop("_p", "_k")


def numbered_in_groups(rows: DataFrame, group: str, order: str, alias: str = "k") -> DataFrame:
    """Number the rows of each group from 1 in the order of a column, however large a group is.

    Rows are range-partitioned by (group, order), so a large group spreads over neighbouring ranges; each range numbers its
    part, and the groups that cross a border, at most two a range, get the counts of the ranges before as an offset.
    """
    from pyspark.sql import window as W

    from ..session import materialise

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(rows.repartitionByRange(parts, group, order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    crossing = counts.groupBy(group).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(group)
    same = counts.alias("x").join(crossing.alias("y"), F.col(f"x.{group}").eqNullSafe(F.col(f"y.{group}")), "left_semi")
    before = W.Window.partitionBy(group).orderBy("_p").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = same.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.Window.partitionBy("_p", group).orderBy(order))
    met = ranged.withColumn("_own", own).join(F.broadcast(offsets), (F.col("_p") == F.col("_q")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    return met.select(*rows.columns, (F.coalesce("_before", F.lit(0)) + F.col("_own")).cast("long").alias(alias))


def swap_in(table: DataFrame, path: str) -> str:
    """Write a new version beside a table's path and return where it is; the caller switches over, readers keep theirs."""
    target = f"{path}.v-{uuid.uuid4().hex[:12]}"
    table.write.parquet(target)
    return target
