"""Best records, duplicate links and groups, and merging of records."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..session import lookup_join, materialise


def completeness_order(pos: str = "pos") -> Column:
    """Greatest for the record to keep: has a site, has an e-mail, has a telephone, higher score, earlier."""
    has = lambda c: (~text.blank(F.col(c))).cast("int")
    score = F.coalesce("confidence_score", F.lit(0.0))
    return F.struct(has("website_url"), has("email"), has("phone"), score, -F.col(pos))


def record_key() -> Column:
    """Name key of a record; its site where there is no name; null where there is neither."""
    name = F.nullif(text.name_key(F.coalesce(text.filled(F.col("name_en")), F.col("name_ar"))), F.lit(""))
    return F.coalesce(name, F.concat(F.lit("|||"), F.lower(text.filled(F.col("website_url")))))


def best_records(rows: DataFrame, key: Column | None = None, pos: str = "pos") -> DataFrame:
    """The most complete record of each key, with the least position of its group.

    One aggregate: partial results combine before the shuffle, so a key with any share of the rows costs one record a task.
    """
    keyed = rows.withColumn("key", record_key() if key is None else key).filter(F.col("key").isNotNull())
    best = F.max_by(F.struct(*rows.columns), completeness_order(pos)).alias("r")
    return keyed.groupBy("key").agg(best, F.min(pos).alias("first_pos"), F.count(F.lit(1)).alias("n_rows")).select("key", "first_pos", "n_rows", "r.*")


#: Letters of a q-gram of a prefix filter.
GRAM = 3


def most_edits(length: int) -> int:
    """Most edits between a name of ``length`` letters and a longer or equal one whose similarity is above 0.85."""
    best = 0
    for longer in range(length, int(length / 0.85) + 2):
        d = math.ceil(0.15 * longer - 1e-9) - 1
        if longer - length <= d:
            best = max(best, d)
    return best


def grams(name: str) -> list[str]:
    """q-grams of a name, repeated ones numbered."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(name) - GRAM + 1):
        g = name[i : i + GRAM]
        k = seen[g] = seen.get(g, -1) + 1
        out.append(f"{g}{k}" if k else g)
    return out


def gram_prefix(name: str, rank: dict[str, int]) -> list[str]:
    """The rarest q-grams of a name, one more than all allowed edits can change: similar names have one in common."""
    d = most_edits(len(name))
    found = sorted(grams(name), key=lambda g: (rank.get(g[:GRAM], 0), g))
    return found[: GRAM * d + 1] if d else []


#: Most letters of a chunk of the similar-name join, places of the table of gram counts, bits of a letter group in a signature.
CHUNK, PLACES, GROUP_BITS = 5, 1 << 18, 4
#: Bits of the set of posted keys; last place of a chunk that is told apart.
POSTED_BITS, LAST_PLACE = 1 << 26, 0xFFFF
#: Most chunks of a name that are chosen by their counts, which takes time by the square of the length.
MOST_CHOSEN = 40
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def allowed_edits(length: int) -> int:
    """Most edits between a name of ``length`` letters and a shorter or equal one whose similarity is above 0.85."""
    return max(0, math.ceil(0.15 * length - 1e-9) - 1)


def chunk_size(length: int) -> int:
    """Letters of each of the disjoint chunks, one more than the allowed edits, that fit into a name; 0 for none."""
    d = allowed_edits(length)
    return min(CHUNK, length // (d + 1)) if d else 0


def _by_length(names: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``length, places, letters``: the names of each length as rows of a matrix of code points."""
    sizes = np.array([len(n) for n in names], dtype=np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        held = "".join(names[i] for i in at).encode("utf-32-le", "surrogatepass")
        yield int(size), at, np.frombuffer(held, dtype="<u4").reshape(len(at), size).astype(np.uint64)


def _gram_hashes(letters: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q letters from each place of each name."""
    n = letters.shape[1] - q + 1
    with np.errstate(over="ignore"):
        h = np.full((len(letters), n), q, dtype=np.uint64)
        for k in range(q):
            h = (h ^ letters[:, k : k + n]) * _MULTIPLIER
            h ^= h >> np.uint64(29)
    return h


def _rarest(cost: np.ndarray, q: int, wanted: int) -> np.ndarray:
    """Places of ``wanted`` disjoint grams of q letters of each row whose sum of costs is least; evenly spread in very long names."""
    rows, n = cost.shape
    if wanted > MOST_CHOSEN:
        return np.tile(np.arange(wanted) * ((n + q - 1) // wanted), (rows, 1))
    best = np.zeros((rows, n + q))  # of the grams that begin before a place
    takes = []
    for _ in range(wanted):
        after, take = np.full((rows, n + q), np.inf), np.zeros((rows, n), dtype=bool)
        for i in range(n):
            with_it = best[:, i] + cost[:, i]
            # best[:, i] holds the grams that end at i or before, after[:, i + q] those that end at i + q or before
            left_out = after[:, i + q - 1]
            take[:, i] = with_it < left_out
            after[:, i + q] = np.where(take[:, i], with_it, left_out)
        takes.append(take)
        best = after
    out = np.zeros((rows, wanted), dtype=np.int64)
    end = np.full(rows, n + q - 1)
    each = np.arange(rows)
    for k in range(wanted - 1, -1, -1):
        for i in range(n - 1, -1, -1):
            now = (end >= i + q) & takes[k][:, i] & (out[:, k] == 0)
            out[now, k] = i + 1
        end = out[:, k] - 1
    return out - 1


def _marked(hashes: np.ndarray, salt: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Key of each hash in the 48 upper bits, its place in the name in the 16 lower ones (the last of them: that or more)."""
    with np.errstate(over="ignore"):
        h = (hashes ^ salt[:, None]) * _MULTIPLIER
        h ^= h >> np.uint64(32)
    return (h << np.uint64(16)) | np.minimum(places, LAST_PLACE).astype(np.uint64)


def _lists(n: int, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """``n`` lists from ``list, value`` of all their values."""
    of = np.concatenate([np.zeros(0, dtype=np.int64), *(x for x, _ in found)])
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *(v.view(np.int64) for _, v in found)])
    ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[np.argsort(of, kind="stable")], pa.int64()))


def chunk_keys(names: list[str], salt: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Keys of disjoint chunks of each name, one more than the allowed edits, of those the ones rarest by ``counts``."""
    found = []
    for size, at, letters in _by_length(names):
        q, wanted = chunk_size(size), allowed_edits(size) + 1
        if q:
            hashes = _gram_hashes(letters, q)
            places = _rarest(counts[hashes % np.uint64(PLACES)].astype(np.float64), q, wanted)
            keys = _marked(np.take_along_axis(hashes, places, axis=1), salt[at], places)
            found.append((np.repeat(at, wanted), keys.ravel()))
    return _lists(len(names), found)


def gram_keys(names: list[str], salt: np.ndarray, posted: np.ndarray) -> pa.Array:
    """Keys of all grams of each name as long as the chunks of a longer or equal name that it may be similar to.

    ``posted`` has a bit for each remainder of the keys of the chunks; grams without theirs meet nothing and are left out.
    """
    found = []
    for size, at, letters in _by_length(names):
        longer = range(size, int(size / 0.85) + 2)
        for q in sorted({chunk_size(n) for n in longer if n - size <= allowed_edits(n)} - {0}):
            if q <= size:
                keys = _marked(_gram_hashes(letters, q), salt[at], np.arange(size - q + 1))
                bit = (keys >> np.uint64(16)) % np.uint64(POSTED_BITS)
                held = (posted[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                found.append((np.broadcast_to(at[:, None], keys.shape)[held], keys[held]))
    return _lists(len(names), found)


def signatures(names: list[str]) -> np.ndarray:
    """Sixteen groups of letters, each with as many bits as letters of it (up to four): an edit changes one bit each way."""
    out = np.zeros(len(names), dtype=np.uint64)
    for _, at, letters in _by_length(names):
        bits = np.zeros(len(at), dtype=np.uint64)
        groups = letters % np.uint64(16)
        for g in range(16):
            n = np.minimum((groups == g).sum(axis=1), GROUP_BITS).astype(np.uint64)
            bits |= ((np.uint64(1) << n) - np.uint64(1)) << np.uint64(g * GROUP_BITS)
        out[at] = bits
    return out.view(np.int64)


def gram_counts(named: DataFrame) -> np.ndarray:
    """How many grams of all names fall on each of ``PLACES`` places: a table of one size, whatever the letters."""

    @F.arrow_udf("array<int>")
    def places(names: pa.Array) -> pa.Array:
        held = names.to_pylist()
        found = []
        for size, at, letters in _by_length(held):
            if chunk_size(size):
                hashes = _gram_hashes(letters, chunk_size(size)) % np.uint64(PLACES)
                found.append((np.repeat(at, hashes.shape[1]), hashes.ravel()))
        return _lists(len(held), found).cast(pa.list_(pa.int32()))

    return _table(named.select(F.explode(places("name")).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("v")), PLACES)


def posted_bits(posted: DataFrame) -> np.ndarray:
    """The set of the posted keys' remainders, as bits of a table of one size."""
    bit = posted.select(F.pmod("key", F.lit(POSTED_BITS)).cast("int").alias("bit"))
    word = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, bit & 63))").alias("v"))
    return _table(word, POSTED_BITS >> 6).view(np.uint64)


def _table(rows: DataFrame, size: int) -> np.ndarray:
    """``size`` numbers, those of the rows ``at, v`` and 0 elsewhere."""
    table, held = np.zeros(size, dtype=np.int64), rows.toArrow()
    table[held["at"].to_numpy()] = held["v"].to_numpy()
    return table


def similar_name_pairs(rows: DataFrame) -> DataFrame:
    """``city, name_a, name_b, confidence``: different bare names of one city that the name test accepts above 0.7.

    ``rows`` has city and name; each distinct pair of them is compared once. Of the longer name of a pair, one chunk more is
    posted than edits are allowed, and an edit can change one of them only: the shorter name, all grams of which are looked
    up, has one of them. That is exact for the similarity above 0.85 and for containment, which then needs a length ratio
    above 0.875. The chunks are the rarest, counted over all names in a table of one size, so words of a trade hardly meet.
    Places and letter counts, other lower bounds of the edits, are compared before the names. A chunk of many names is cut into parts.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    @F.arrow_udf("bigint")
    def signature(names: pa.Array) -> pa.Array:
        return pa.array(signatures(names.to_pylist()), pa.int64())

    named = rows.filter("city is not null and length(name) > 0").select("city", "name").distinct().repartition(parts)
    named = materialise(named.select(F.monotonically_increasing_id().alias("id"), "city", "name", signature("name").alias("sig")))
    counts = spark.sparkContext.broadcast(gram_counts(named))

    def salts(of: pa.Array) -> np.ndarray:
        return of.to_numpy(zero_copy_only=False).view(np.uint64)

    @F.arrow_udf("array<bigint>")
    def chunks(names: pa.Array, city: pa.Array) -> pa.Array:
        return chunk_keys(names.to_pylist(), salts(city), counts.value)

    @F.arrow_udf("array<bigint>")
    def grams_(names: pa.Array, city: pa.Array) -> pa.Array:
        return gram_keys(names.to_pylist(), salts(city), bits.value)

    def side(keys: Column, s: str) -> DataFrame:
        rows = named.select(F.explode(keys).alias("k"), F.col("id").alias(s), F.length("name").alias(f"size_{s}"), F.col("sig").alias(f"sig_{s}"))
        at = F.col("k").bitwiseAND(F.lit(LAST_PLACE)).cast("int").alias(f"at_{s}")
        return rows.select(F.shiftrightunsigned("k", 16).alias("key"), at, s, f"size_{s}", f"sig_{s}")

    city = F.xxhash64("city")
    posted = materialise(side(chunks("name", city), "a"))
    bits = spark.sparkContext.broadcast(posted_bits(posted))
    met = _part_join(posted, side(grams_("name", city), "b"))
    most = (F.ceil(0.15 * F.col("size_a") - 1e-9) - 1).cast("int")
    before = F.col("at_a") - F.col("at_b")
    moved = F.abs(before) + F.abs(F.col("size_a") - F.col("size_b") - before)  # at least so many edits before the chunk and behind it
    placed = (F.greatest("at_a", "at_b") == LAST_PLACE) | (moved <= most)
    more = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(y))) <= most
    ordered = (F.col("size_a") > F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    met = met.filter(ordered & (F.col("size_a") - F.col("size_b") <= most) & placed & more("sig_a", "sig_b") & more("sig_b", "sig_a"))
    met = materialise(met.select("a", "b").distinct())
    one = named.select(F.col("id").alias("a"), "city", F.col("name").alias("x"))
    two = named.select(F.col("id").alias("b"), F.col("city").alias("city_b"), F.col("name").alias("y"))
    pairs = met.join(one, "a").join(two, "b").filter("city = city_b")
    pairs = pairs.filter(F.expr("levenshtein(x, y, cast(ceil(0.15D * greatest(length(x), length(y)) - 1e-9D) - 1 as int)) >= 0"))
    pairs = pairs.select("city", F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b"))
    tested = pairs.withColumn("m", text.same_company(F.col("name_a"), F.col("name_b"))).filter("m.matches and m.confidence > 0.7")
    return tested.select("city", "name_a", "name_b", F.col("m.confidence").alias("confidence"))


def _part_join(posted: DataFrame, asked: DataFrame, part_rows: int = 2_000) -> DataFrame:
    """Join on ``key``; a key with more than ``part_rows`` posted rows is cut into parts, each of which meets all that ask."""
    hot = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > part_rows)
    hot = materialise(hot.select("key", F.ceil(F.col("n") / part_rows).cast("int").alias("parts")))
    if hot.isEmpty():
        return posted.join(asked, "key")
    cut = posted.join(F.broadcast(hot), "key", "left")
    cut = cut.withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    asked = asked.join(F.broadcast(hot), "key", "left").withColumn("part", every).drop("parts")
    return cut.join(asked, ["key", "part"])


def link_keys(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """``pos, key, reason, confidence``: what records have in common, linear in the rows.

    Records with one key are linked: same site, same profile link, same bare name; and, for each pair of similar names of a
    city, a key of that pair.
    """
    base = materialise(rows.select(
        F.col(pos).alias("pos"),
        urls.domain(F.col("website_url")).alias("site"),
        urls.canonical(F.col("linkedin_url")).alias("profile"),
        text.bare_company_name(F.col("name_en")).alias("name"),
        F.lower(text.filled(F.col("city"))).alias("city"),
    ).filter("name is not null"))

    def of(kind: str, column: str, why: str, c: float) -> Column:
        return F.struct(F.concat(F.lit(f"{kind}|"), column).alias("key"), F.lit(why).alias("reason"), F.lit(c).alias("confidence"))

    pairs = similar_name_pairs(base)
    pair = F.concat_ws("|", F.lit("n"), "city", "name_a", "name_b").alias("key")
    sides = pairs.select("city", pair, "confidence", F.explode(F.array("name_a", "name_b")).alias("name"))
    near = base.join(sides, ["city", "name"]).select("pos", "key", F.lit("similar name").alias("reason"), "confidence")
    own = F.array(of("s", "site", "same domain", 0.95), of("p", "profile", "same profile", 0.9), of("e", "name", "same name", 0.95))
    same = base.select("pos", F.explode(own).alias("k")).select("pos", "k.*").filter("key is not null")
    return same.unionByName(near)


#: Most (record, key) rows that one task forms the last groups of.
LAST_ROWS = 400_000


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups of some ``pos, key, reason, confidence``, by one scan in order of position."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    linked = pa.Table.from_batches(held)
    keys = linked["key"].combine_chunks().dictionary_encode().indices.to_pylist()
    rows = list(zip(linked["pos"].to_pylist(), keys, linked["confidence"].to_pylist(), linked["reason"].to_pylist()))
    of_pos: dict[int, list[int]] = {}
    of_key: dict[int, list[int]] = {}
    for i, (p, k, _, _) in enumerate(rows):
        of_pos.setdefault(p, []).append(i)
        of_key.setdefault(k, []).append(i)
    taken: set[int] = set()
    out: list[tuple] = []
    for head in sorted(of_pos):
        if head in taken:
            continue
        best: dict[int, tuple] = {}
        for i in of_pos[head]:
            # a key's records are all in a group once its first open one has been the head
            for p, _, c, why in (rows[j] for j in of_key.pop(rows[i][1], ())):
                if p != head and p not in taken:
                    best[p] = max(best.get(p, (c, why)), (c, why))
        taken.update(best)
        out += [(head, p, why, c) for p, (c, why) in best.items()]
    kinds = [linked.schema.field(c).type for c in ("pos", "pos", "reason", "confidence")]
    columns = list(zip(*out)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["head_pos", "pos", "reason", "confidence"])


def duplicate_groups(rows: DataFrame, pos: str = "pos", last_rows: int = LAST_ROWS) -> DataFrame:
    """``head_pos, pos, reason, confidence``: groups as one scan in order of position makes them.

    A record not yet in a group heads one and takes all records linked to it that are not yet in one. This is done in
    rounds: whoever is the first of all its keys among the open records is a head, since nothing before it can take it; it
    takes a record when it is the first of all that record is linked to, else one before it may still become a head. A
    round is a few aggregates over (record, key) rows, so no task holds a group, and is written out before the next.
    The last ``last_rows`` of these rows are scanned by one task, so a long chain of records isn't a round for each head.
    """
    columns = ("pos", "key", "reason", "confidence")
    open_keys = materialise(link_keys(rows, pos).distinct())
    found = None
    while True:
        first = open_keys.groupBy("key").agg(F.min("pos").alias("first"), F.count_distinct("pos").alias("n"))
        linked = materialise(lookup_join(open_keys, materialise(first.filter("n > 1")), ["key"], "n"))
        if linked.count() <= last_rows:
            kind = {f.name: f.dataType.simpleString() for f in linked.schema}
            schema = f"head_pos {kind['pos']}, pos {kind['pos']}, reason string, confidence double"
            last = materialise(linked.select(*columns).coalesce(1).mapInArrow(_scan, schema))
            return last if found is None else found.unionByName(last)
        least = materialise(linked.groupBy("pos").agg(F.min("first").alias("first")))
        heads = least.filter("first = pos").select("first")
        best = F.max_by("reason", F.struct("confidence", "reason"))
        taken = linked.join(least.filter("first < pos"), ["pos", "first"], "left_semi").join(heads, "first", "left_semi")
        taken = taken.groupBy("pos", "first").agg(best.alias("reason"), F.max("confidence").alias("confidence"))
        taken = materialise(taken.select(F.col("first").alias("head_pos"), "pos", "reason", "confidence"))
        if taken.isEmpty():
            return taken if found is None else found
        found = taken if found is None else found.unionByName(taken)
        open_keys = linked.select(*columns).join(taken.select("pos"), "pos", "left_anti")


def star_links(rows: DataFrame, key: Column, pos: str = "pos") -> DataFrame:
    """Links from the first record of each key to its others: linear in the rows, whatever the size of a group."""
    keyed = rows.select(F.col(pos).alias("pos"), key.alias("key")).filter("key is not null")
    first = keyed.groupBy("key").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    linked = lookup_join(keyed, first, ["key"], "n").filter("pos <> first")
    return linked.select(F.col("first").alias("pos_a"), F.col("pos").alias("pos_b"))


def merged_into(masters: DataFrame, duplicates: DataFrame, on: str, arrays: Sequence[str], fields: Sequence[str], protected: Sequence[str] = ("name_en", "name_ar")) -> DataFrame:
    """Master records with blanks filled and arrays united from one duplicate each; protected fields only if blank."""
    other = duplicates.select(F.col(on), *(F.col(c).alias(f"_{c}") for c in (*arrays, *fields, "id")))
    joined = masters.join(other, on, "left")
    united = [F.array_distinct(F.concat(F.coalesce(c, F.array()), F.coalesce(f"_{c}", F.array()))).alias(c) for c in arrays]
    kept = [F.when(text.blank(F.col(c)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields]
    origin = F.when(F.col("_id").isNotNull(), F.array_distinct(F.concat(F.coalesce("merged_from", F.array("id")), F.array("_id"))))
    return joined.select(on, "id", *united, *kept, F.coalesce(origin, F.col("merged_from")).alias("merged_from"))


def group_members(groups: DataFrame, companies: DataFrame) -> DataFrame:
    """Known members of each group, one row each with its place in the list (the first of a repeated id)."""
    listed = groups.select(F.col("id").alias("group_id"), F.posexplode("company_ids").alias("place", "id"))
    listed = listed.groupBy("group_id", "id").agg(F.min("place").alias("place"))
    latest = F.max_by(F.struct(*[c for c in companies.columns if c != "id"]), F.struct("updated_at", "pos")).alias("r")
    once = companies.groupBy("id").agg(latest).select("id", "r.*")
    return listed.join(once, "id")


def preferred(members: DataFrame, fields: Sequence[str], latest: bool = False) -> DataFrame:
    """First (or last) value of each field by place that is not blank, in one aggregate."""
    pick = F.max_by if latest else F.min_by
    return members.groupBy("group_id").agg(
        *(pick(F.col(f), F.when(~text.blank(F.col(f)), F.col("place"))).alias(f) for f in fields)
    )


def majority(members: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Most frequent value of each field, ties to the one seen first."""
    long = members.select("group_id", "place", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("v"))
    votes = long.select("group_id", "place", "v.*").filter(~text.blank(F.col("value")))
    votes = votes.groupBy("group_id", "field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    return votes.groupBy("group_id", "field").agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("value"), F.max("n").alias("votes"))


def conflicts(members: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fields in which a group has more than one value, the number of them, and the confidence of resolving it."""
    counted = members.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.bool_and(~text.blank(F.col("website_url"))).alias("all_sites"),
        *(F.count_distinct(F.when(~text.blank(F.col(f)), F.col(f))).alias(f"_{f}") for f in fields),
    )
    names = F.filter(F.array(*(F.when(F.col(f"_{f}") > 1, F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    score = 0.7 - 0.05 * F.size("conflicts") + 0.1 * F.col("all_sites").cast("int") + 0.1
    out = counted.withColumn("conflicts", names).withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))
    return out.select("group_id", "n_members", F.array_join("conflicts", ",").alias("conflicts"), "confidence")


def united_arrays(members: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Distinct values of array fields over a group, sorted."""
    return members.groupBy("group_id").agg(
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in arrays)
    )
