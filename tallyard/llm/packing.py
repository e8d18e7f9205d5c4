"""Problem 9: fill containers of fixed capacity with documents, measured in tokens of a public tokenizer.

Documents are packed shard by shard: a best-fit decreasing start, then a swap-based local search over the underfull bins
that moves a document, exchanges one for one or two for one whenever that raises the sum of squared fills, until bins
empty and no exchange helps. Only a text larger than the capacity is split, into full pieces and a rest.

Shards are drawn by hash, so any number of equal documents spreads over all tasks. What lies in the underfull bins of the
shards is packed again in fewer, larger rounds until one shard remains or nothing changes hands, so the space lost to
sharding does not grow with the corpus.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .tokenize import DEFAULT_FOLDER, count_column, ship_model

#: About how many pieces a shard has, and the fill from which a bin of a shard is left as it is.
SHARD, FULL = 4_000, 0.995
#: Least share of the open pieces that a round must close for another to follow; otherwise all stay where they are packed.
LEAST_CLOSED = 0.05
#: About how many kinds of container are packed together.
TOGETHER = 1_000


def _best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing with a list of free spaces kept in order."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(free, (sizes[item], -1))
        if at < len(free):
            space, b = free.pop(at)
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        bisect.insort(free, (space - sizes[item], b))
    return bins


def _improve(a: list[int], b: list[int], sizes: list[int], space: int) -> tuple[list[int], list[int]] | None:
    """Best change between a fuller bin ``a`` with ``space`` left and an emptier one ``b``: a move from ``b`` to ``a``, an
    exchange of one for one, or of two for one. Returns what leaves ``b`` and what leaves ``a``; none if none helps.

    The fuller bin gains, so the sum of squared fills always rises.
    """
    best, change = 0, None
    order = sorted(b, key=lambda i: sizes[i])
    values = [sizes[i] for i in order]
    at = bisect.bisect_right(values, space) - 1
    if at >= 0 and values[at] > 0:
        best, change = values[at], ([order[at]], [])
    for y in a:
        if best == space:
            break
        at = bisect.bisect_right(values, sizes[y] + space) - 1
        if at >= 0 and values[at] - sizes[y] > best:
            best, change = values[at] - sizes[y], ([order[at]], [y])
        lo, hi = 0, len(values) - 1  # two of b for one of a
        while lo < hi:
            gain = values[lo] + values[hi] - sizes[y]
            if gain > space:
                hi -= 1
            else:
                if gain > best:
                    best, change = gain, ([order[lo], order[hi]], [y])
                lo += 1
    mine = sorted(a, key=lambda i: sizes[i])
    held = [sizes[i] for i in mine]
    for x in b:  # one of b for two of a
        if best == space:
            break
        lo, hi = 0, len(held) - 1
        while lo < hi:
            gain = sizes[x] - held[lo] - held[hi]
            if gain < 0:
                hi -= 1
            elif gain > space:
                lo += 1
            else:
                if gain > best:
                    best, change = gain, ([x], [mine[lo], mine[hi]])
                lo += 1
    return change if best > 0 else None


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers) for items of at most ``capacity``. Items of size 0 lie in the first bins with others."""
    bins = _best_fit(sizes, capacity)
    load = [sum(sizes[i] for i in b) for b in bins]
    active = [k for k in range(len(bins)) if load[k] < capacity]
    changed = True
    while changed and len(active) > 1:
        changed = False
        active = sorted((k for k in active if bins[k] and load[k] < capacity), key=lambda k: (-load[k], k))
        for donor in reversed(active):  # the emptiest first: it is the one to be emptied
            for taker in active:
                if taker == donor or load[taker] < load[donor] or not bins[donor] or load[taker] == capacity:
                    continue
                change = _improve(bins[taker], bins[donor], sizes, capacity - load[taker])
                if change:
                    out, back = change
                    gain = sum(sizes[i] for i in out) - sum(sizes[i] for i in back)
                    bins[taker] = [i for i in bins[taker] if i not in back] + out
                    bins[donor] = [i for i in bins[donor] if i not in out] + back
                    load[taker] += gain
                    load[donor] -= gain
                    changed = True
                    if not load[donor]:  # empty but for items of size 0
                        bins[taker] += bins[donor]
                        bins[donor] = []
    return [b for b in bins if b]


def _round(items: DataFrame, shards: int) -> DataFrame:
    """Pack each shard of each container by itself; ``bin`` is unique within container, round and shard."""

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece_no", "tokens"], ignore_index=True)
        capacity = int(frame["capacity"].iloc[0])
        sizes = [int(x) for x in frame["tokens"]]
        number, load = [0] * len(sizes), [0] * len(sizes)
        for n, members in enumerate(pack(sizes, capacity)):
            total = sum(sizes[i] for i in members)
            for i in members:
                number[i], load[i] = n, total
        return frame.assign(bin=number, load=load)

    placed = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no", "container_id"), F.lit(shards)).cast("int"))
    schema = "container_id int, capacity int, doc_id long, piece_no int, tokens int, shard int, bin int, load int"
    columns = ["container_id", "capacity", "doc_id", "piece_no", "tokens", "shard"]
    return placed.select(*columns).groupBy("container_id", "shard").applyInPandas(fill, schema)


def fill_containers(
    documents: DataFrame, containers: DataFrame, key: str = "doc_id", text: str = "text", folder: str = DEFAULT_FOLDER
) -> DataFrame:
    """``container_id, bin_id, doc_id, piece_no, tokens, load``: the bin of every text, or piece of one, for each capacity.

    Null and empty texts have no tokens and lie in some bin; a text above the capacity is cut into pieces of the capacity
    and a rest (``piece_no`` from 0); rows that repeat a key are packed one for one; without documents or containers the
    result is empty; a capacity that is null or not positive is left out. ``load`` is the tokens in the bin.
    """
    shipped = ship_model(documents.sparkSession, folder)
    sizes = documents.select(F.col(key).cast("long").alias("doc_id"), count_column(F.col(text), shipped).alias("size"))
    sizes = materialise(sizes)
    spec = containers.filter("capacity_tokens > 0").select("container_id", F.col("capacity_tokens").cast("int").alias("capacity"))
    spec = spec.distinct()
    groups = max(1, -(-spec.count() // TOGETHER))
    filled = None
    for g in range(groups):  # each about TOGETHER kinds, whatever their number
        held = spec.filter(F.pmod(F.xxhash64("container_id", "capacity"), F.lit(groups)) == g).orderBy("container_id", "capacity").collect()
        done = _fill(sizes, [(r[0], r[1]) for r in held])
        filled = done if filled is None else filled.unionByName(done)
    return filled


def _fill(sizes: DataFrame, kinds: list[tuple[int, int]]) -> DataFrame:
    """Pack ``doc_id, size`` into some kinds of containers, in rounds."""
    each = [F.struct(F.lit(i).alias("container_id"), F.lit(c).alias("capacity")) for i, c in kinds]
    none = F.array().cast("array<struct<container_id: int, capacity: int>>")
    pieces = sizes.withColumn("c", F.explode(F.array(*each) if each else none)).select("doc_id", "size", "c.*")
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / F.col("capacity")).cast("int") - 1)
    pieces = pieces.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last)))
    rest = F.col("size") - F.col("piece_no") * F.col("capacity")
    pieces = pieces.withColumn("tokens", F.least("capacity", rest).cast("int"))
    pieces = materialise(pieces.select("container_id", "capacity", "doc_id", "piece_no", "tokens"))
    done, number = None, 0
    open_items, count = pieces, pieces.groupBy("container_id").count().agg(F.max("count")).collect()[0][0] or 0
    while True:
        shards = max(1, round(count / SHARD))
        placed = materialise(_round(open_items, shards))
        name = F.concat_ws("-", F.lit(number), "shard", "bin")
        named = placed.select("container_id", "capacity", name.alias("bin_id"), "doc_id", "piece_no", "tokens", "load")
        left = named.filter(F.col("load") < F.col("capacity") * FULL)
        remaining = 0 if shards == 1 else left.groupBy("container_id").count().agg(F.max("count")).collect()[0][0] or 0
        last_round = shards == 1 or remaining > (1 - LEAST_CLOSED) * count
        closed = (named if last_round else named.filter(F.col("load") >= F.col("capacity") * FULL)).drop("capacity")
        done = closed if done is None else done.unionByName(closed)
        if last_round:
            return done
        open_items, count, number = left.select("container_id", "capacity", "doc_id", "piece_no", "tokens"), remaining, number + 1


def fill_report(filled: DataFrame, containers: DataFrame) -> DataFrame:
    """Bins, tokens and share of the space used for each container."""
    bins = filled.groupBy("container_id", "bin_id").agg(F.sum("tokens").alias("used"))
    totals = bins.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("used").alias("tokens"))
    spec = containers.select("container_id", "capacity_tokens")
    share = F.round(F.col("tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 4).alias("fill")
    return totals.join(spec, "container_id").select("container_id", "capacity_tokens", "n_bins", "tokens", share)
