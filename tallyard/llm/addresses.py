"""Problem 5: writings of one building's address.

An address is a weighted vector of letter n-grams: its words are reduced to consonant skeletons, in which Latin and Arabic
writings agree, and cut into padded n-grams weighted by their rarity in all addresses. Candidates come from an inverted
index over (digits of the house number, n-gram) in which each address posts only its prefix: the rarest n-grams until the
norm of the rest is below the threshold, so no pair at or above the threshold is missed. Candidates are verified by cosine
similarity and compatible house numbers: a letter behind the number may be missing on one side, two letters must agree.

N-grams are numbered by a hash into ``BUCKETS`` places, so the table of their weights has one size for every script and
table. Equal addresses are reduced to one representative first and expanded at the end.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import block_join, lookup_join, materialise
from .names import beside, coarse, fold, is_arabic, skeleton, strip_article, token_distance
from .pairs import expand_pairs

#: Least cosine similarity; pairs without a common postal code need the second, and two common words below the third.
THRESHOLD, WITHOUT_POSTAL, CERTAIN = 0.25, 0.28, 0.6
#: Share (and least number) of addresses a word is in to be common, such as the name of a city, and the share (and least
#: number) of all different words it then stands beside; a busy building's or street's words stand beside few.
COMMON_SHARE, COMMON_LEAST = 0.005, 12
BESIDE_SHARE, BESIDE_LEAST = 0.05, 12
#: Letters of an n-gram.
SIZE = 4
#: Places of the table of n-gram weights; n-grams in one place share its count.
BUCKETS = 1 << 18

_DIGITS = {ord(c): str(i % 10) for i, c in enumerate("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹")}
# Words of address parts, which carry no location by themselves.
PART_WORDS = frozenset(
    map(
        fold,
        """
        street st str road rd avenue ave av boulevard blvd boul lane ln highway hwy way drive dr square sq crescent close
        district dist dt hay area quarter block building bldg no number nr num house villa tower center centre floor flr fl
        suite office unit room apartment apt flat level po box p.o ksa saudi arabia kingdom of the and near opposite opp
        behind beside next to postal code zip
        شارع طريق جادة ممر حي الحي مبنى مبني عمارة رقم الرقم البريدي صندوق بريد الدور الطابق مكتب شقة وحدة غرفة السعودية المملكة
        العربية بجوار مقابل خلف قرب
        """.split(),
    )
)
_WITHIN = re.compile(
    r"\b(?:office|suite|unit|room|apartment|apt|flat|floor|flr|level|shop|مكتب|شقة|شقه|وحدة|وحده|غرفة|غرفه|الدور|الطابق|دور|طابق)\b"
    r"\.?\s*(?:no\.?|number|رقم)?\s*[#:]?\s*\d+[a-z]?\b|\b\d+\s*(?:st|nd|rd|th)\b(?:\s*(?:floor|flr|fl)\b)?|#\s*\d+\s*(?=floor)"
)
_BOX = re.compile(r"\bp\.?\s*o\.?\s*b(?:ox)?\.?\s*(?:no\.?)?\s*\d+|\b(?:po)?box\s*\d+|(?:ص\.?\s*ب\.?|صندوق بريد)\s*\d+")
_LANDMARK = re.compile(r"\b(?:near|opp(?:osite)?|behind|beside|next to|in front of|across from|بجوار|مقابل|خلف|قرب|امام)\b\.?(?: the)?(?: [^\W\d]+){1,2}")
_DIGIT_LETTER = re.compile(r"(?<=[a-z]{3})7(?![\d])|7(?=[a-z]{3})")
_MARKED = re.compile(r"(?:\b(?:bldg|building|bld|house|villa|no|nr|number)\b\.?|#|\b(?:مبني|مبنى|عماره|رقم)\b)\s*(?:(?:no|number)\b\.?|رقم)?\s*[#:.]?\s*(\d{1,6})(?![\d-])\s*([a-z]\b)?")
_POSTAL = re.compile(r"(?<!\d)\d{5}(?:\s*-\s*\d{4})?(?!\d)")
_NUMBER = re.compile(r"(?<![\d-])\d{1,5}(?![\d-])")
_WORD = re.compile(r"[^\W\d_]+")


def house_number(text: str) -> str | None:
    """The building's number in a folded address; null if there is none."""
    rest = _BOX.sub(" ", _WITHIN.sub(" ", text))
    m = _MARKED.search(rest)
    if m:
        return m[1].lstrip("0") + (m[2] or "")
    m = _NUMBER.search(_POSTAL.sub(" ", rest))
    return m[0].lstrip("0") if m else None


def read_address(address: str | None) -> tuple[str | None, str | None, list[str]]:
    """House number, postal code and words (without words of address parts, floors, units and landmarks)."""
    if not address:
        return None, None, []
    text = _DIGIT_LETTER.sub("kh", fold(address.translate(_DIGITS)))
    number = house_number(text)
    postal = _POSTAL.search(text)
    rest = _LANDMARK.sub(" ", _BOX.sub(" ", _WITHIN.sub(" ", text)))
    words = [strip_article(w) for w in _WORD.findall(re.sub(r"\bk\.\s*s\.\s*a\b", " ", rest)) if w not in PART_WORDS]
    return number, postal[0][:5] if postal else None, [w for w in words if w not in PART_WORDS and len(w) > 1]


@lru_cache(maxsize=100_000)
def _grams_of(word: str) -> tuple[int, ...]:
    import xxhash

    s = skeleton(word)
    if not s:
        return ()
    s = f"^{s}$"
    return tuple(xxhash.xxh32_intdigest(s[i : i + SIZE].encode()) % BUCKETS for i in range(max(1, len(s) - SIZE + 1)))


def grams(words: list[str]) -> list[int]:
    """Distinct padded n-grams (their places) of the skeletons of some words, in order; short skeletons whole."""
    return list(dict.fromkeys(g for w in words for g in _grams_of(w)))


def vector(found: list[int], weight) -> tuple[list[int], list[float]]:
    """N-grams and weights of a unit vector, heaviest first (ties by place). ``weight``: of each place; 0 leaves it out."""
    raw = sorted(((g, float(weight[g])) for g in found if weight[g] > 0), key=lambda x: (-x[1], x[0]))
    norm = math.sqrt(sum(w * w for _, w in raw))
    return ([i for i, _ in raw], [w / norm for _, w in raw]) if norm else ([], [])


def prefix(ids: list[int], weights: list[float], least: float) -> list[int]:
    """Ids of a unit vector up to where the norm of the rest falls below ``least``."""
    out, left = [], 1.0
    for i, w in zip(ids, weights):
        if left < least * least - 1e-9:
            break
        out.append(i)
        left -= w * w
    return out


def cosine(a: tuple[list[int], list[float]], b: tuple[list[int], list[float]]) -> float:
    other = dict(zip(*b))
    return sum(w * other.get(i, 0.0) for i, w in zip(*a))


def compatible(a: str, b: str) -> bool:
    """House numbers with the same digits, whose letters agree or are missing on one side."""
    x, y = (re.fullmatch(r"(\d*)(.*)", v).groups() for v in (a, b))
    return x[0] == y[0] and (x[1] == y[1] or not x[1] or not y[1])


def same_building(cos: float, postal_a: str | None, postal_b: str | None, a: list[str], b: list[str]) -> bool:
    """Verification of two addresses with compatible house numbers; ``a`` and ``b`` are their uncommon words."""
    if postal_a and postal_b:
        return postal_a == postal_b and cos >= THRESHOLD
    return cos >= CERTAIN or (cos >= WITHOUT_POSTAL and same_places(a, b))


def same_places(a: list[str], b: list[str]) -> bool:
    """Whether two words of one address are spellings of two of the other, at two edits together; other parts may be missing."""
    sides = [([w for w in x if not is_arabic(w)], [w for w in x if is_arabic(w)]) for x in (a, b)]
    for ta in sides[0]:
        for tb in sides[1]:
            near = [(d, i, j) for i, x in enumerate(ta) for j, y in enumerate(tb) if (d := token_distance(x, y)) <= 2]
            if any(d + e <= 2 and i != k and j != m for (d, i, j), (e, k, m) in combinations(near, 2)):
                return True
    return False


def common_words(texts: DataFrame, total: int) -> set[str]:
    """Words (column ``words`` of ``total`` texts) in many addresses and beside many different words: at most the words
    of an address divided by ``COMMON_SHARE``."""

    @F.arrow_udf("array<struct<w: string, k: string>>")
    def keyed(found: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("w", pa.string()), ("k", pa.string())]))
        return pa.array([[{"w": w, "k": coarse(w)} for w in ws] for ws in found.to_pylist()], kind)

    usual = texts.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    usual = usual.filter(F.col("n") >= max(COMMON_LEAST, int(total * COMMON_SHARE))).select("w").collect()
    if not usual:
        return set()
    named = materialise(texts.select("words").distinct().select(keyed("words").alias("x")))
    partners, words = beside(named, [r[0] for r in usual])
    return {r[0] for r in partners.filter(F.col("n") >= max(BESIDE_LEAST, BESIDE_SHARE * words)).select("w").collect()}


def building_links(
    listings: DataFrame, key: str = "pos", address: str = "full_address", hot_rows: int = 200_000
) -> tuple[DataFrame, DataFrame]:
    """Membership (``pos, rep``) of the rows in classes of one writing, and links (``ra, rb``) between the representatives
    of writings that denote one building, the smaller first.

    Addresses without a house number or without words (null, blank, a city, a box) are in no class.
    """
    spark = listings.sparkSession
    rows = listings.select(F.col(key).alias("pos"), F.col(address).alias("text")).filter(F.col("text").isNotNull())

    @F.arrow_udf("struct<number: string, postal: string, grams: array<int>, words: array<string>>")
    def read(texts: pa.Array) -> pa.Array:
        found = [read_address(t) for t in texts.to_pylist()]
        kind = pa.struct([("number", pa.string()), ("postal", pa.string()), ("grams", pa.list_(pa.int32())), ("words", pa.list_(pa.string()))])
        out = [{"number": n, "postal": p, "grams": sorted(grams(w)) if n else [], "words": sorted(set(w))} for n, p, w in found]
        return pa.array(out, kind)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("least"))
    texts = texts.filter(F.col("text").rlike(r"\p{Nd}")).repartition(parts, "text").withColumn("r", read("text"))
    texts = materialise(texts.select("text", "n", "least", "r.*").filter("number is not null and size(grams) > 0"))

    total = texts.count()
    common = spark.sparkContext.broadcast(common_words(texts, total))
    counted = texts.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).toArrow()
    table = np.zeros(BUCKETS, dtype=np.float32)  # its size is fixed, whatever the script
    table[counted["g"].to_numpy()] = np.log1p(total / counted["n"].to_numpy())
    weight = spark.sparkContext.broadcast(table)

    @F.arrow_udf("struct<ids: array<int>, weights: array<float>, prefix: array<int>>")
    def vectors(found: pa.Array) -> pa.Array:
        made = [vector(g, weight.value) for g in found.to_pylist()]
        ids, weights = pa.list_(pa.int32()), pa.list_(pa.float32())
        out = [{"ids": i, "weights": w, "prefix": prefix(i, w, THRESHOLD)} for i, w in made]
        return pa.array(out, pa.struct([("ids", ids), ("weights", weights), ("prefix", ids)]))

    forms = texts.groupBy("number", "postal", "grams").agg(F.min("least").alias("rep"), F.min("words").alias("words"))
    forms = materialise(forms.withColumn("v", vectors("grams")).select("rep", "number", "postal", "grams", "words", "v.*"))
    digits = F.regexp_extract("number", r"^(\d*)", 1)
    posted = forms.select("rep", digits.alias("digits"), F.explode("prefix").alias("g"))
    a, b = posted.withColumnRenamed("rep", "ra"), posted.withColumnRenamed("rep", "rb")
    candidates = block_join(a, b, ["digits", "g"], "ra", "rb").filter("ra < rb").select("ra", "rb").distinct()

    fields = ("number", "ids", "weights", "postal", "words")

    @F.arrow_udf("boolean")
    def verified(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left.to_pylist(), right.to_pylist()):
            if not compatible(x["number"], y["number"]):
                out.append(False)
                continue
            cos = cosine((x["ids"], x["weights"]), (y["ids"], y["weights"]))
            a, b = ([w for w in v["words"] if w not in common.value] for v in (x, y))
            out.append(same_building(cos, x["postal"], y["postal"], a, b))
        return pa.array(out, pa.bool_())

    left = forms.select(F.col("rep").alias("ra"), F.struct(*fields).alias("x"))
    right = forms.select(F.col("rep").alias("rb"), F.struct(*fields).alias("y"))
    links = materialise(candidates.join(left, "ra").join(right, "rb").filter(verified("x", "y")).select("ra", "rb"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("number", "postal", "grams")]
    reps = materialise(texts.alias("t").join(forms.alias("f"), same).select("t.text", "t.n", "f.rep"))
    return materialise(lookup_join(rows, reps, ["text"], "n", hot_rows).select("pos", "rep")), links


def same_buildings(listings: DataFrame, key: str = "pos", address: str = "full_address", hot_rows: int = 200_000) -> DataFrame:
    """``pos_a, pos_b``: pairs of rows whose addresses denote one building, equal writings included, smaller key first.

    The classes and links are those of :func:`building_links`, expanded. Rows repeated with the same key are no pair. Very
    long addresses are read whole. Other columns are not read.
    """
    members, links = building_links(listings, key, address, hot_rows)
    return expand_pairs(members, links)
