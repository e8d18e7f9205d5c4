"""Problem 3: the best representative of each duplicate group, field by field.

The usable values of a field in a group are aligned token by token to the group's anchor, the value with most weight behind
it; each column, inserted ones and gaps included, is decided by a weighted vote, and the existing value closest to the voted
sequence survives. A record's weight is its confidence to the power of ``POWER``, halved for every ``HALF_LIFE`` days that
it is older; records with one value add up. So one clearly more trusted and more recent record decides, and several others
that are nearly as good overrule it.

Since every value is aligned to the anchor, the profile is a sum over values: it doesn't depend on their order or on how
they are divided. Groups of up to ``CHUNK`` values are decided in one call, larger ones by the same vote as an aggregation
over all of the cluster, with the same result. Equal values are merged first, on the map side.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..session import lookup_join, materialise
from .residue import PLACEHOLDER, WHOLE, _bare, mask_phone

#: Most values of a field that are decided in one call; more are decided by the same vote as an aggregation.
CHUNK = 64
#: Power of the confidence in a record's weight, and days of age that halve it.
POWER, HALF_LIFE = 8, 180
FIELDS = ("description_en", "phone", "email")

# What is written in place of a missing value.
STAND_INS = frozenset(
    """
    n/a|na|n.a.|n.a|none|null|nil|nan|undefined|unknown|tbd|tba|tbc|todo|test|-|--|---|.|..|...|…|?|x|xx|xxx|email|e-mail|mail|
    phone|tel|telephone|mobile|description|call us|contact us|not available|not provided|not specified|not set|no description|
    description not available|no phone|no email|coming soon|pending|missing|empty|[email protected]|غير متوفر|لا يوجد|غير محدد
    """.replace("\n    ", "").strip().split("|")
)
_EMAIL = re.compile(r"[^\s@,;<>()\[\]]+@[^\s@.,;<>()\[\]]+(?:\.[^\s@.,;<>()\[\]]+)*\.[A-Za-z؀-ۿ][^\s@.,;<>()\[\]]+")
_CUT_MARK = re.compile(r"[\s]*(?:\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|\.{2,}|…)?\s*$")


def usable(field: str, value: str | None) -> bool:
    """Neither blank nor a stand-in, and well formed."""
    t = re.sub(r"[\s ​﻿]+", " ", value or "").strip()
    low = t.lower()
    if not t or low in STAND_INS or low.rstrip(".! ") in STAND_INS or PLACEHOLDER.fullmatch(t):
        return False
    if field == "email":
        return _EMAIL.fullmatch(t) is not None
    if field == "phone":
        rest = re.sub(r"(?i)^(?:tel|phone|mobile|mob)\s*[:.]?\s*", "", re.split(r"(?i)\s*(?:ext|x)\.?\s*\d+\s*$", t)[0])
        digits = re.sub(r"\D", "", rest)
        if not re.fullmatch(r"\+?[\d\s().\-/]+", rest) or not 7 <= len(digits) <= 15 or mask_phone(rest):
            return False
        m = re.fullmatch(r"(?:00|)966(0?\d+)|0([1-9]\d*)", digits)
        return not m or len((m[1] or m[2]).lstrip("0")) == 9
    return WHOLE.fullmatch(_bare(t)) is None


def uncut(description: str) -> str:
    """A description without the marks that show where it was cut off."""
    return _CUT_MARK.sub("", re.sub(r"[\s ]+", " ", description).strip())


def tokens_of(field: str, value: str) -> list[str]:
    """What is aligned: a telephone's national digits, an address's words and signs, a text's words."""
    if field == "phone":
        digits = re.sub(r"\D", "", re.split(r"(?i)\s*(?:ext|x)\.?\s*\d+\s*$", value)[0])
        return list(re.sub(r"^(?:00)?966", "", digits).lstrip("0"))
    return re.findall(r"\w+|[^\w\s]", value.lower()) if field == "email" else value.split()


def align(anchor: list[str], tokens: list[str]) -> list[tuple[int, int, str]]:
    """``(column, insertion, token)`` of one sequence: a token or a gap in each column of the anchor, insertions after it."""
    out: list[tuple[int, int, str]] = []
    for _, i1, i2, j1, j2 in SequenceMatcher(None, anchor, tokens).get_opcodes():
        pairs = min(i2 - i1, j2 - j1)
        out += [(i1 + k, 0, tokens[j1 + k]) for k in range(pairs)]
        out += [(i, 0, "") for i in range(i1 + pairs, i2)]
        out += [(i1 + pairs - 1, k + 1, tokens[j]) for k, j in enumerate(range(j1 + pairs, j2))]
    return out


def elected(column: dict[str, float], total: float) -> str:
    """Winner of a column; values without a token there vote for the gap. Ties go to the first token, never to a gap."""
    votes = dict(column)
    votes[""] = votes.get("", 0.0) + max(0.0, total - sum(column.values())) * (1 - 1e-9)
    return min(votes, key=lambda t: (-votes[t], t == "", t))


def closeness(voted: list[str], tokens: list[str]) -> float:
    return round(SequenceMatcher(None, voted, tokens).ratio(), 9)


def consensus(values: list[list[str]], weights: list[float]) -> int:
    """Position of the value closest to the consensus; ties go to the heavier, then the earlier value."""
    best = max(range(len(values)), key=lambda i: (weights[i], -i))
    total, columns = sum(weights), {}
    for tokens, weight in zip(values, weights):
        for i, k, token in align(values[best], tokens):
            column = columns.setdefault((i, k), {})
            column[token] = column.get(token, 0.0) + weight
    voted = [t for t in (elected(columns[c], total) for c in sorted(columns)) if t]
    return max(range(len(values)), key=lambda i: (closeness(voted, values[i]), weights[i], -i))


def group_values(groups: DataFrame, companies: DataFrame) -> DataFrame:
    """``group_id, field_name, value, weight, trust, company_id``: the distinct usable values of each field of each group.

    ``weight`` is that of all records with the value, ``trust`` that of the most trusted, whose id is kept; cut-off
    beginnings of another description of the group are left out.
    """
    members = groups.select(F.col("id").alias("group_id"), F.explode(F.array_distinct("company_ids")).alias("company_id"))
    columns = [F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS]
    rows = companies.select(F.col("id").alias("company_id"), "confidence_score", "updated_at", F.explode(F.array(*columns)).alias("v"))

    @F.arrow_udf("boolean")
    def fit(fields: pa.Array, values: pa.Array) -> pa.Array:
        return pa.array([usable(f, v) for f, v in zip(fields.to_pylist(), values.to_pylist())], pa.bool_())

    @F.arrow_udf("string")
    def whole(values: pa.Array) -> pa.Array:
        return pa.array([uncut(v) if v is not None else None for v in values.to_pylist()], pa.string())

    rows = rows.join(members, "company_id").select("group_id", "company_id", "confidence_score", "updated_at", "v.*")
    rows = rows.filter(fit("field_name", "value"))
    trust = F.struct(
        F.coalesce("confidence_score", F.lit(-1.0)).alias("confidence"),
        F.coalesce(F.unix_micros("updated_at"), F.lit(0)).alias("recency"),
        F.col("company_id"),
    )
    sure = F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.coalesce("confidence_score", F.lit(0.0))))
    halvings = (F.coalesce(F.unix_micros("updated_at"), F.lit(0)) / 86_400e6 - 11_000) / HALF_LIFE
    weight = F.pow(sure, F.lit(POWER)) * F.pow(F.lit(2.0), F.greatest(F.lit(-900.0), F.least(F.lit(900.0), halvings)))
    keys = ["group_id", "field_name", "value"]
    delivered = rows.groupBy(*keys, "company_id").agg(F.max(trust).alias("trust"), F.max(weight).alias("weight"))
    merged = delivered.groupBy(*keys).agg(F.max("trust").alias("trust"), F.sum("weight").alias("weight"))
    texts = merged.filter(F.col("field_name") == "description_en").withColumn("w", whole("value")).filter("w <> ''")
    # a text and its copy with a cut mark behind it differ only in the mark: the shorter writing is the uncut one
    first = F.min_by(F.struct("value", "trust"), F.struct(F.length("value"), F.col("value")))
    texts = texts.groupBy("group_id", "field_name", "w").agg(first.alias("f"), F.sum("weight").alias("weight"))
    texts = uncut_texts(texts.select("group_id", "field_name", "w", "f.value", "f.trust", "weight"))
    others = merged.filter(F.col("field_name") != "description_en")
    found = texts.select(*merged.columns).unionByName(others)
    return found.select("group_id", "field_name", "value", "weight", "trust", F.col("trust.company_id").alias("company_id"))


def uncut_texts(texts: DataFrame) -> DataFrame:
    """The rows (distinct in ``group_id, w``) whose text ``w`` begins no other text of the group.

    Sorted, whatever begins with a text follows it at once. The rows are sorted over the cluster in ranges of even size, so
    a large group spreads over many; the first row of each range, one a partition, stands behind the last of the range before.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(texts.repartitionByRange(parts, "group_id", "w").withColumn("at", F.spark_partition_id()))
    following = W.Window.partitionBy("at").orderBy("group_id", "w")
    after = F.struct(F.lead("group_id").over(following).alias("g"), F.lead("w").over(following).alias("t"))
    heads = ranged.groupBy("at").agg(F.min(F.struct("group_id", "w")).alias("head"))
    nearest = heads.select("at", F.lead("head").over(W.Window.orderBy("at")).alias("next"))  # as many rows as ranges
    rows = ranged.withColumn("after", after).join(F.broadcast(nearest), "at", "left")
    group = F.coalesce("after.g", "next.group_id")
    text = F.when(F.col("after.g").isNotNull(), F.col("after.t")).otherwise(F.col("next.w"))
    cut = F.coalesce((group == F.col("group_id")) & text.startswith(F.col("w")) & (F.length(text) > F.length("w")), F.lit(False))
    return rows.filter(~cut).select(*texts.columns)


_KEYS = ["group_id", "field_name"]
_VALUE = "struct<value: string, weight: double, company_id: string>"


def decided_together(values: DataFrame) -> DataFrame:
    """``group_id, field_name, value, company_id``: the survivors of groups that one call can hold."""

    @F.arrow_udf(_VALUE)
    def winner(fields: pa.Array, held: pa.Array) -> pa.Array:
        out = []
        for field, row in zip(fields.to_pylist(), held.to_pylist()):
            out.append(row[consensus([tokens_of(field, x["value"]) for x in row], [x["weight"] for x in row]) if len(row) > 1 else 0])
        return pa.array(out, pa.struct([("value", pa.string()), ("weight", pa.float64()), ("company_id", pa.string())]))

    held = F.sort_array(F.collect_list(F.struct("trust", "value", "weight", "company_id")), asc=False)
    held = F.transform(held, lambda x: F.struct(x["value"].alias("value"), x["weight"].alias("weight"), x["company_id"].alias("company_id")))
    chosen = values.groupBy(*_KEYS).agg(held.alias("held"))
    return chosen.select(*_KEYS, winner("field_name", "held").alias("w")).select(*_KEYS, "w.value", "w.company_id")


def decided_apart(values: DataFrame, hot_rows: int) -> DataFrame:
    """The same for groups of any size: alignment by value, the vote as a sum over (group, column, token)."""

    @F.arrow_udf("array<struct<i: int, k: int, token: string>>")
    def aligned(fields: pa.Array, anchors: pa.Array, texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("i", pa.int32()), ("k", pa.int32()), ("token", pa.string())]))
        rows = zip(fields.to_pylist(), anchors.to_pylist(), texts.to_pylist())
        return pa.array([[dict(zip("ik", c), token=c[2]) for c in align(tokens_of(f, a), tokens_of(f, t))] for f, a, t in rows], kind)

    @F.arrow_udf("double")
    def score(fields: pa.Array, voted: pa.Array, texts: pa.Array) -> pa.Array:
        rows = zip(fields.to_pylist(), voted.to_pylist(), texts.to_pylist())
        return pa.array([closeness(v or [], tokens_of(f, t)) for f, v, t in rows], pa.float64())

    heaviest = F.max_by("value", F.struct("weight", "trust"))
    anchors = values.groupBy(*_KEYS).agg(heaviest.alias("anchor"), F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"))
    anchors = materialise(anchors)
    beside = lookup_join(values, anchors, _KEYS, "n", hot_rows)
    columns = beside.select(*_KEYS, "weight", F.explode(aligned("field_name", "anchor", "value")).alias("c"))
    votes = columns.groupBy(*_KEYS, "c.i", "c.k", "c.token").agg(F.sum("weight").alias("votes"))
    leader = F.min(F.struct(-F.col("votes"), F.col("token") == "", F.col("token")))
    tally = votes.groupBy(*_KEYS, "i", "k").agg(
        leader.alias("first"), F.sum("votes").alias("cast"), F.sum(F.when(F.col("token") == "", F.col("votes")).otherwise(0.0)).alias("gaps")
    )
    tally = tally.join(anchors.select(*_KEYS, "total"), _KEYS)
    against = F.col("gaps") + F.greatest(F.lit(0.0), F.col("total") - F.col("cast")) * (1 - 1e-9)
    won = tally.filter((F.col("first.token") != "") & (-F.col("first.col1") >= against))
    voted = won.groupBy(*_KEYS).agg(F.sort_array(F.collect_list(F.struct("i", "k", F.col("first.token").alias("token")))).alias("v"))
    voted = anchors.select(*_KEYS, "n").join(voted, _KEYS, "left").select(*_KEYS, "n", F.col("v.token").alias("voted"))
    scored = lookup_join(values, voted, _KEYS, "n", hot_rows).withColumn("score", score("field_name", "voted", "value"))
    best = F.max_by(F.struct("value", "company_id"), F.struct("score", "weight", "trust"))
    return scored.groupBy(*_KEYS).agg(best.alias("b")).select(*_KEYS, "b.value", "b.company_id")


def surviving_values(groups: DataFrame, companies: DataFrame, hot_rows: int = 200_000) -> DataFrame:
    """``group_id, field_name, value, company_id``: the surviving value of each field that has a usable one.

    Unknown and repeated ids, records delivered twice, null arrays and empty tables are harmless: members without a record
    and groups without usable values have no row. Ties are decided by weight, then confidence, recency and company id.
    """
    values = materialise(group_values(groups, companies))
    sizes = values.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"))
    large = materialise(sizes.filter(F.col("n") > CHUNK))
    if large.isEmpty():
        return decided_together(values)
    # groups this large are at most the values divided by CHUNK; hot ones among them are broadcast
    marked = materialise(lookup_join(values, large, _KEYS, "n", hot_rows, "left"))
    together = decided_together(marked.filter("n is null").drop("n"))
    return together.unionByName(decided_apart(marked.filter("n is not null").drop("n"), hot_rows))


def surviving_records(groups: DataFrame, companies: DataFrame) -> DataFrame:
    """One record for each group, each field from the record that gives its best value (null without a usable one)."""
    found = surviving_values(groups, companies)
    record = found.groupBy("group_id").pivot("field_name", list(FIELDS)).agg(F.first("value"))
    return groups.select(F.col("id").alias("group_id")).join(record, "group_id", "left")
