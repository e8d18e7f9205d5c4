"""Problem 6: records that differ only in white space, case, punctuation, field order or parameter order.

Field texts stream through a skip-and-fold lookup table (0 = skipped, otherwise the folded letter or digit) into rolling
polynomial hashes; no canonical string is ever built. A link's parameters and the two fields are combined by commutative
sums, so their order does not matter. Rows with equal 124-bit keys are then compared with their first record by a
two-pointer comparison that skips the same characters.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import lookup_join, materialise
from .lookalike import to_points

#: Prime moduli and bases of the four polynomial hashes; the first two make k1, the last two make k2.
MODULI = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1000003, 1299709, 15485863, 32452843)


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Folded letter or digit of each code point, 0 for all other characters."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.int64)
    for cp in range(len(table)):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind[0] == "L" or kind == "Nd":
            table[cp] = ord(c.lower()[0])
    return table


_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.int64) for _ in MODULI]


def _powers(k: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the k-th prime, kept and doubled as longer texts come."""
    table = _POWERS[k]
    while len(table) < n:
        step = pow(BASES[k], len(table), MODULI[k])
        table = np.concatenate((table, table * step % MODULI[k]))
    _POWERS[k] = table
    return table[:n]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Spread 64 bits (finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(salt)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _first_after(at: np.ndarray, row_of: np.ndarray, after: np.ndarray, none: int) -> np.ndarray:
    """For each row the first of the ascending positions ``at`` that is beyond ``after[row]``; ``none`` where missing."""
    found = np.full(len(after), none, dtype=np.int64)
    at = at[at > after[row_of[at]]]
    found[row_of[at][::-1]] = at[::-1]
    return found


def field_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 62-bit hashes of each text's letters and digits; parameters of a link in any order. Null equals empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    points, rows = to_points(texts)
    n = len(rows) - 1
    row_of = np.repeat(np.arange(n), np.diff(rows))
    size = len(points)
    query = _first_after(np.flatnonzero(points == 0x3F), row_of, np.full(n, -1), size)
    equals = np.flatnonzero(points == 0x3D)
    last_equals = np.full(n, -1, dtype=np.int64)
    last_equals[row_of[equals]] = equals
    query = np.where(last_equals > query, query, size)
    fragment = _first_after(np.flatnonzero(points == 0x23), row_of, query, size)
    amp = np.flatnonzero(points == 0x26)
    amp = amp[(amp > query[row_of[amp]]) & (amp < fragment[row_of[amp]])]
    opens = np.zeros(size + 1, dtype=np.int64)
    opens[query[query < size]] = 1
    opens[fragment[fragment < size]] = 1
    opens[amp] = 1
    kept = np.flatnonzero(fold_table()[points])
    values = fold_table()[points[kept]]
    totals = [np.zeros(n, dtype=np.uint64) for _ in range(2)]
    if not len(kept):
        return totals[0], totals[1]
    opens[rows[:-1][rows[:-1] < size]] = 1
    part = np.cumsum(opens[:size])[kept]
    begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    length = np.diff(np.append(begin, len(kept)))
    rank = np.arange(len(kept)) - np.repeat(begin, length)
    row = row_of[kept[begin]]
    kind = np.where(kept[begin] > fragment[row], 2, np.where(kept[begin] > query[row], 1, 0))
    for half in range(2):
        h = np.zeros(len(begin), dtype=np.uint64)
        for k in (2 * half, 2 * half + 1):
            sums = np.add.reduceat(values * _powers(k, int(rank.max()) + 1)[rank] % MODULI[k], begin) % MODULI[k]
            h = (h << np.uint64(31)) ^ sums.astype(np.uint64)
        with np.errstate(over="ignore"):
            h = _mix(h ^ (length.astype(np.uint64) << np.uint64(40)), half + 1)
            h = np.where(kind == 0, h, np.where(kind == 1, _mix(h, 101), _mix(h, 202)))
            np.add.at(totals[half], row, h)
    return totals[0], totals[1]


def record_key(name: Column, link: Column) -> Column:
    """``struct<k1 long, k2 long>``: equal for rows whose two fields hold the same letters and digits, in either order."""

    @F.arrow_udf("struct<k1: bigint, k2: bigint>")
    def key(names: pa.Array, links: pa.Array) -> pa.Array:
        pair = [field_hashes(names), field_hashes(links)]
        with np.errstate(over="ignore"):
            out = [_mix(pair[0][half], 7) + _mix(pair[1][half], 7) for half in range(2)]
        return pa.StructArray.from_arrays([pa.array(x.view(np.int64)) for x in out], ["k1", "k2"])

    return key(name, link)


_ASCII = [ord(c.lower()) if (c := chr(i)).isalnum() else 0 for i in range(128)]


def _same(a: str, i: int, m: int, b: str, j: int, n: int) -> bool:
    """Whether a[i:m] and b[j:n] hold the same letters and digits: two pointers that skip everything else."""
    folded, table = _ASCII, None
    while True:
        x = y = 0
        while i < m and not x:
            c = ord(a[i])
            if c < 128:
                x = folded[c]
            else:
                table = fold_table() if table is None else table
                x = int(table[c])
            i += 1
        while j < n and not y:
            c = ord(b[j])
            if c < 128:
                y = folded[c]
            else:
                table = fold_table() if table is None else table
                y = int(table[c])
            j += 1
        if x != y:
            return False
        if not x:
            return True


def _parts(t: str) -> tuple[int, list[tuple[int, int]], int]:
    """End of the base, spans of the parameters, begin of the fragment of a text."""
    q = t.find("?")
    if q < 0 or t.rfind("=") < q:
        return len(t), [], len(t)
    f = t.find("#", q)
    f = len(t) if f < 0 else f
    spans, lo = [], q + 1
    while lo <= f:
        hi = t.find("&", lo, f)
        hi = f if hi < 0 else hi
        if not _same(t, lo, hi, "", 0, 0):
            spans.append((lo, hi))
        lo = hi + 1
    return q, spans, f


def same_field(a: str, b: str) -> bool:
    if a == b:
        return True
    qa, pa_, fa = _parts(a)
    qb, pb, fb = _parts(b)
    if len(pa_) != len(pb) or not _same(a, 0, qa, b, 0, qb) or not _same(a, fa, len(a), b, fb, len(b)):
        return False
    left = list(pb)
    for lo, hi in pa_:
        match = next((s for s in left if _same(a, lo, hi, b, *s)), None)
        if match is None:
            return False
        left.remove(match)
    return True


def same_record(a1: str | None, a2: str | None, b1: str | None, b2: str | None) -> bool:
    """Exact comparison of two records of two fields each, in either field order."""
    a1, a2, b1, b2 = a1 or "", a2 or "", b1 or "", b2 or ""
    return (same_field(a1, b1) and same_field(a2, b2)) or (same_field(a1, b2) and same_field(a2, b1))


def _same_column(*columns: str) -> Column:
    @F.arrow_udf("boolean")
    def same(a1: pa.Array, a2: pa.Array, b1: pa.Array, b2: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (a1, a2, b1, b2)))
        return pa.array([same_record(*r) for r in rows], pa.bool_())

    return same(*columns)


def _verified(members: DataFrame, hot_rows: int) -> DataFrame:
    """Compare each member with the first of its key; ``pos, first_pos, same``."""
    first = members.filter("pos = first_pos").select("first_pos", "n", F.col("a").alias("fa"), F.col("b").alias("fb"))
    rest = members.filter("pos <> first_pos").drop("n")
    pairs = lookup_join(rest, first, ["first_pos"], "n", hot_rows)
    return pairs.select("pos", "first_pos", "k1", "k2", _same_column("fa", "fb", "a", "b").alias("same"))


def formatting_copies(
    records: DataFrame, key: str = "pos", name: str = "name_en", link: str = "website_url", hot_rows: int = 200_000
) -> DataFrame:
    """``first_pos, copy_pos``: for each set of copies its smallest key with each other key.

    The rows are keyed once and written to the shared folder. Grouping combines on the map side; copies find their first
    record through :func:`lookup_join`, so a set holding any share of all rows is spread over all tasks. Null equals
    empty; rows with both fields blank are copies of each other; rows repeated with the same key appear once.
    """
    keyed = materialise(
        records.select(F.col(key).alias("pos"), F.col(name).alias("a"), F.col(link).alias("b"))
        .withColumn("k", record_key(F.col("a"), F.col("b")))
        .select("pos", "k.k1", "k.k2", "a", "b")
    )
    found = None
    while True:
        groups = keyed.groupBy("k1", "k2").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))
        groups = materialise(groups.filter("n > 1"))
        members = materialise(lookup_join(keyed, groups, ["k1", "k2"], "n", hot_rows))
        checked = materialise(_verified(members, hot_rows))
        good = checked.filter("same").select("first_pos", F.col("pos").alias("copy_pos"))
        found = good if found is None else found.union(good)
        if checked.filter("not same").isEmpty():  # else texts with colliding keys remain: group them again
            return found.distinct()
        keyed = members.join(checked.filter("not same").select("pos"), "pos", "left_semi")
        keyed = keyed.select("pos", "k1", "k2", "a", "b")


def collapsed_records(
    records: DataFrame, key: str = "pos", name: str = "name_en", link: str = "website_url", hot_rows: int = 200_000
) -> DataFrame:
    """One row for each record, its first writing and how many copies it stands for (1 for a record without copies)."""
    copies = materialise(formatting_copies(records, key, name, link, hot_rows))
    counts = copies.groupBy("first_pos").agg((F.count(F.lit(1)) + 1).alias("n_copies"))
    rows = records.select(F.col(key).alias("first_pos"), F.col(name).alias("name"), F.col(link).alias("link"))
    kept = rows.join(copies.select(F.col("copy_pos").alias("first_pos")), "first_pos", "left_anti")
    return kept.join(counts, "first_pos", "left").fillna(1, ["n_copies"])
