"""Filters, ordering, search and paging over tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def condition(field: str, op: str, value) -> Column:
    """One predicate of the filter language; an unknown operator is equality. Null never satisfies a comparison."""
    c = F.col(field)
    known = {
        "==": lambda: c == value,
        "!=": lambda: c != value,
        ">": lambda: c > value,
        ">=": lambda: c >= value,
        "<": lambda: c < value,
        "<=": lambda: c <= value,
        "in": lambda: c.isin(list(value)),
        "not-in": lambda: ~c.isin(list(value)),
        "array-contains": lambda: F.array_contains(c, value),
        "array-contains-any": lambda: F.arrays_overlap(c, F.array(*map(F.lit, value))),
    }
    return known.get(op, known["=="])()


def select_rows(
    table: DataFrame, filters: Sequence[tuple] = (), order_by: str | None = None, direction: str = "asc", limit: int = 0
) -> DataFrame:
    """Conjunction of predicates, then an order (nulls last ascending, first descending), then a limit (0: none)."""
    for f in filters:
        table = table.filter(condition(*f))
    if order_by:
        c = F.col(order_by)
        table = table.orderBy(c.desc_nulls_first() if direction == "desc" else c.asc_nulls_last())
    return table.limit(limit) if limit else table


def search(table: DataFrame, text: str, query: str, newest: Sequence[Column] = (), limit: int = 0, offset: int = 0) -> DataFrame:
    """Rows whose ``text`` contains every word of the query, ignoring case; a blank query finds nothing."""
    terms = query.split()
    if not terms:
        return table.limit(0)
    hits = table.filter(reduce(lambda a, b: a & b, (F.col(text).ilike(f"%{t}%") for t in terms)))
    if newest:
        hits = hits.orderBy(*newest)
    hits = hits.offset(offset) if offset else hits
    return hits.limit(limit) if limit else hits


def top_per_group(table: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps n rows a group before the shuffle (window group limit)."""
    w = W.Window.partitionBy(*group).orderBy(*order)
    return table.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def first_per_key(table: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The row of each key with the least ``order``: an aggregate with map-side combine, not a sort of whole groups."""
    others = [c for c in table.columns if c not in key]
    best = F.min_by(F.struct(*others), F.col(order)).alias("_row")
    return table.groupBy(*key).agg(best).select(*key, "_row.*")


def page_cursor(pages: DataFrame, order: str, active: int) -> DataFrame:
    """Planned pages numbered in order, the active one (clamped) and what follows it."""
    from ..sources.exports import with_ids

    numbered = with_ids(pages, order, -1, "page_no")
    last = (numbered.agg(F.max("page_no")).collect()[0][0] or 0) if not numbered.isEmpty() else 0
    current = max(0, min(active, last))
    following = F.when(F.col("page_no") < last, F.col("page_no") + 1)
    return numbered.select(*pages.columns, "page_no", (F.col("page_no") == current).alias("is_active"), following.alias("next_page"))
