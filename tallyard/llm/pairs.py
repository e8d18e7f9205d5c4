"""Pairs between the representatives of classes, with the membership of the rows, and their expansion into pairs of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import block_join


def expand_pairs(
    members: DataFrame, links: DataFrame, a: str = "pos_a", b: str = "pos_b", block_rows: int = 2_000, within: bool = True
) -> DataFrame:
    """All pairs of rows of two linked classes and, if ``within``, of one class, the smaller key first, each once.

    ``members``: ``pos, rep``; ``links``: ``ra, rb``, two different representatives. Rows of a class are paired in chunks
    of even size (:func:`block_join`), so a large class is no task of its own; the list itself is as long as its definition
    makes it. A sort of the list against repetitions is only needed where a key is repeated.
    """
    members = members.distinct()
    most = [members.groupBy(c).count().agg(F.lit(c).alias("c"), F.max("count").alias("n")) for c in ("rep", "pos")]
    most = {r["c"]: r["n"] or 0 for r in most[0].union(most[1]).collect()}

    def join(one: DataFrame, two: DataFrame, key: str, one_id: str, two_id: str) -> DataFrame:
        return block_join(one, two, [key], one_id, two_id, block_rows) if most["rep"] > block_rows else one.join(two, key)

    x, y = members.select("rep", F.col("pos").alias("x")), members.select("rep", F.col("pos").alias("y"))
    left = join(links, x.withColumnRenamed("rep", "ra"), "ra", "rb", "x").select("rb", "x")
    across = join(left, y.withColumnRenamed("rep", "rb"), "rb", "x", "y").filter("x <> y").select("x", "y")
    if within:
        across = across.union(join(x, y, "rep", "x", "y").filter("x < y").select("x", "y"))
    pairs = across.select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b))
    return pairs.distinct() if most["pos"] > 1 else pairs


def class_sizes(members: DataFrame, links: DataFrame) -> DataFrame:
    """``pos, rep, n_links``: every row's class, and to how many others the class is linked."""
    ends = links.select(F.explode(F.array("ra", "rb")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(ends, "rep", "left").select("pos", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"))
