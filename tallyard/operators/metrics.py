"""Counters, gauges, histograms and running sums over metric points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def counters(points: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    return points.groupBy(*key).agg(F.round(F.sum(value), 4).alias("total"), F.count(F.lit(1)).alias("n"))


def gauges(points: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Last value of each key; an aggregate, so a hot key is combined on the map side."""
    return points.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias("last_value"))


def histograms(points: DataFrame, key: Sequence[str], value: str, order: Sequence[Column], kept: int = 1000) -> DataFrame:
    """Count, mean, least, most and quantiles of the last ``kept`` values of each key; quantile index ``floor(n * p)``.

    The window keeps ``kept`` rows a key before and after the shuffle (window group limit), so arrays stay small.
    """
    w = W.Window.partitionBy(*key).orderBy(*order)
    last = points.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= kept)
    held = last.groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias("v"))
    at = lambda p: F.element_at("v", (F.floor(F.size("v") * p) + 1).cast("int"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    return held.select(
        *key, F.size("v").alias("n"), F.round(mean, 4).alias("mean"), F.array_min("v").alias("least"), F.array_max("v").alias("most"),
        at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"),
    )


def success_stats(points: DataFrame, key: Sequence[str], failed: Column, value: str) -> DataFrame:
    """Totals, failures, success rate and mean of each key; rates without events are 0."""
    out = points.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failures"), F.sum(value).alias("_sum"))
    rate = F.coalesce(F.try_divide(F.col("total") - F.col("failures"), F.col("total")), F.lit(0.0))
    mean = F.coalesce(F.try_divide("_sum", "total"), F.lit(0.0))
    return out.select(*key, "total", "failures", F.round(rate, 4).alias("success_rate"), F.round(mean, 4).alias("mean_value"))


def running_sum(points: DataFrame, key: Sequence[str], order: Sequence[str], change: Column, span: Column) -> DataFrame:
    """Running sum of ``change`` in order within each key.

    Computed in spans of the order (for instance days): sums of spans are added up first, then each span by itself, so a
    key with very many points is spread over its spans.
    """
    marked = points.withColumn("_change", change).withColumn("_span", span)
    totals = marked.groupBy(*key, "_span").agg(F.sum("_change").alias("_total"))
    before = W.Window.partitionBy(*key).orderBy("_span").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = W.Window.partitionBy(*key, "_span").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    joined = marked.join(starts, [*key, "_span"])
    return joined.withColumn("running", F.col("_start") + F.sum("_change").over(inside)).drop("_change", "_span", "_start")
