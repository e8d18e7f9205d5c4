"""Problem 10: bring visually identical text to one form.

Arrow text is copied to one numpy code-point array per block of rows. A lookup table gathers each code point's
replacement (nothing for invisible characters, one or several code points otherwise), cumulative lengths give the
expansion offsets, and combining marks are ordered and composed on whole arrays. No string function runs per row.

What a reader can't see is folded: width, presentation forms, invisible characters, the kind of space, how an accent is
encoded, letters of another script with the same shape. What a reader sees stays: case, accents, line breaks, raised
digits, fractions, and letters or digits that merely resemble one another.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import block_join, lookup_join, materialise
from .pairs import expand_pairs

#: Code points handled at once by a worker; a longer text is handled whole.
BLOCK = 1 << 20

# Letters drawn like a Latin letter (or like another letter of their script) in common fonts.
SAME_SHAPE = {
    # Cyrillic capitals and small letters
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I", "Ԍ": "G",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    # Latin letters of phonetic alphabets, Armenian
    "ɑ": "a", "ɡ": "g", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "Օ": "O", "Տ": "S",
    # Cherokee, Coptic, Lisu
    "Ꭰ": "D", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R",
    "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # hyphens, apostrophe-free punctuation of the same drawing
    "‐": "-", "‑": "-", "⁃": "-", "˗": "-", "∶": ":", "∕": "/", "ǀ": "|", "∣": "|",
    # Arabic-script letters and the digits that are drawn alike in both digit sets (4, 5 and 6 are not)
    "ک": "ك", "ھ": "ه", "ہ": "ه",
    "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩",
    # signs
    "µ": "μ",
}

#: Decomposition tags that change only width or the form chosen for the place in a word.
FORM_TAGS = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>"}
#: Ranges of other compatibility characters that look like the sequence they stand for: digraphs, Roman numerals,
#: Latin, Armenian and Hebrew ligatures.
SEQUENCE_RANGES = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0xFB00, 0xFB4F))
#: Format characters that are drawn.
DRAWN_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
FARSI_YEH, YEH, ALEF_MAKSURA = 0x06CC, 0x064A, 0x0649


def _replacement(cp: int) -> str:
    """What a code point becomes: canonically decomposed, without invisible parts, in its plain shape."""
    c, out = chr(cp), []
    tag = unicodedata.decomposition(c).partition(" ")[0]
    if tag in FORM_TAGS or any(a <= cp <= b for a, b in SEQUENCE_RANGES):
        parts = unicodedata.normalize("NFKD", c)
    else:
        parts = c if 0xAC00 <= cp <= 0xD7A3 else unicodedata.normalize("NFD", c)
    for p in parts:
        kind, o = unicodedata.category(p), ord(p)
        if (kind == "Cf" and o not in DRAWN_FORMAT) or o == 0x034F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF:
            continue
        out.append(" " if kind == "Zs" else SAME_SHAPE.get(p, p))
    return "".join(out)


class Tables:
    """Lookup tables over all code points, built from the Unicode database of this Python."""

    def __init__(self) -> None:
        size = sys.maxunicode + 1
        self.first = np.arange(size, dtype=np.uint32)
        self.length = np.ones(size, dtype=np.uint8)
        self.start = np.zeros(size, dtype=np.uint32)
        self.ccc = np.zeros(size, dtype=np.uint8)
        self.mark = np.zeros(size, dtype=bool)
        more: list[int] = []
        pairs: dict[tuple[int, int], int] = {}
        for cp in range(size):
            c = chr(cp)
            if 0xD800 <= cp <= 0xDFFF or not (kind := unicodedata.category(c)) or kind in ("Cn", "Co"):
                continue
            self.ccc[cp] = unicodedata.combining(c)
            r = _replacement(cp)
            if r != c:
                self.length[cp] = len(r)
                if len(r) == 1:
                    self.first[cp] = ord(r)
                elif r:
                    self.start[cp] = len(more)
                    more += map(ord, r)
            d = unicodedata.decomposition(c)
            if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", unicodedata.normalize("NFD", c)) == c:
                a, b = (int(x, 16) for x in d.split())
                pairs[a, b] = cp
        self.more = np.array(more or [0], dtype=np.uint32)
        self.mark = self.ccc > 0
        self.mark[[b for _, b in pairs]] = True
        keys = np.array([a << 21 | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_values = keys[order], np.array([*pairs.values()], dtype=np.uint32)[order]

    def compose(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Composite of each pair, 0 where there is none."""
        key = a.astype(np.int64) << 21 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_values[at], 0).astype(np.uint32)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def fold(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fold a block. ``points``: code points of all rows; ``rows``: row offsets. Returns the same for the result."""
    t = tables()
    length = t.length[points]
    if (length == 1).all():
        out, bounds = t.first[points], rows
    else:
        ends = np.cumsum(length, dtype=np.int64)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
        begin, one, many = ends - length, length == 1, np.flatnonzero(length > 1)
        out[begin[one]] = t.first[points[one]]
        if len(many):
            n = length[many].astype(np.int64)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(begin[many], n) + inner] = t.more[np.repeat(t.start[points[many]].astype(np.int64), n) + inner]
        bounds = np.concatenate(([0], ends))[rows]
    out, bounds = _compose(out, bounds, t)
    return _farsi_yeh(out, bounds), bounds


def _farsi_yeh(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The dotless-at-the-end yeh is drawn like yeh before a letter and like alef maksura elsewhere."""
    at = np.flatnonzero(points == FARSI_YEH)
    if len(at):
        following = np.append(points, 0)[at + 1]
        following[np.isin(at + 1, rows)] = 0
        joined = ((following >= 0x0620) & (following <= 0x064A) & (following != 0x0621)) | (
            (following >= 0x066E) & (following <= 0x06D3)
        )
        points = points.copy()
        points[at] = np.where(joined, YEH, ALEF_MAKSURA)
    return points


def _compose(points: np.ndarray, rows: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition of combining marks, run by run, all runs at once."""
    points, rows = _hangul(points, rows)
    mark = t.mark[points]
    if not mark.any():
        return points, rows
    n = len(points)
    opens = np.zeros(n + 1, dtype=bool)
    opens[rows] = True
    # a run is a starter with the marks after it; a mark that opens a row has no starter and opens a run itself
    head = ~mark | opens[:n]
    run = np.cumsum(head) - 1
    ccc = t.ccc[points]
    place = np.arange(n)
    if ((ccc[1:] < ccc[:-1]) & (ccc[1:] > 0) & (ccc[:-1] > 0)).any():
        # a mark of class 0 keeps its place: it closes the stretch that may be reordered
        stretch = np.cumsum(head | (ccc == 0))
        order = np.lexsort((place, ccc, stretch))
        points, ccc = points[order], ccc[order]
    heads = np.flatnonzero(head)
    starter, last = points[heads].copy(), np.zeros(len(heads), dtype=np.int16)
    rank = place - heads[run]
    keep = np.ones(n, dtype=bool)
    following = np.append(rank[1:], 0)
    for k in range(1, int(rank.max()) + 1):  # k-th mark of every run that has one
        at = np.flatnonzero(rank == k) if k == 1 else at[following[at] == k] + 1
        r = run[at]
        made = t.compose(starter[r], points[at])
        # last: class of the mark kept before this one, 0 when none was kept, 255 after a kept mark of class 0
        free = (last[r] == 0) | ((last[r] < ccc[at]) & (last[r] != 255))
        done = (made > 0) & free
        starter[r[done]] = made[done]
        keep[at[done]] = False
        left = ~done
        last[r[left]] = np.where((ccc[at[left]] == 0) | (last[r[left]] == 255), 255, ccc[at[left]])
    points = points.copy()
    points[heads] = starter
    kept = np.concatenate(([0], np.cumsum(keep)))
    return points[keep], kept[rows]


def _hangul(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compose conjoining jamo: leading with vowel, then syllable with trailing consonant."""
    if not ((points >= 0x1100) & (points <= 0x11FF)).any():
        return points, rows
    for second_low, second_high in ((0x1161, 0x1175), (0x11A8, 0x11C2)):
        opens = np.zeros(len(points) + 1, dtype=bool)
        opens[rows] = True
        second = (points >= second_low) & (points <= second_high) & ~opens[:-1]
        second[0] = False
        before = np.concatenate(([0], points[:-1])).astype(np.int64)
        if second_low == 0x1161:
            second &= (before >= 0x1100) & (before <= 0x1112)
            made = 0xAC00 + ((before - 0x1100) * 21 + points - 0x1161) * 28
        else:
            second &= (before >= 0xAC00) & (before <= 0xD7A3) & ((before - 0xAC00) % 28 == 0)
            made = before + points - 0x11A7
        at = np.flatnonzero(second)
        points = points.copy()
        points[at - 1] = made[at].astype(np.uint32)
        kept = np.concatenate(([0], np.cumsum(~second)))
        points, rows = points[~second], kept[rows]
    return points, rows


def to_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows of an Arrow string array and the row offsets; null rows are empty."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    _, offsets, data = texts.buffers()
    if n == 0 or data is None:
        return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
    offset = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offset[0] : offset[-1]]
    counted = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, counted[offset - offset[0]]


def from_points(points: np.ndarray, rows: np.ndarray, null: np.ndarray) -> pa.Array:
    """Arrow string array of code points; rows marked in ``null`` are null."""
    wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    offsets = np.concatenate(([0], np.cumsum(wide)))[rows].astype(np.int64)
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    valid = pa.array(~null).buffers()[1]
    made = pa.Array.from_buffers(pa.large_string(), len(null), [valid, pa.py_buffer(offsets), pa.py_buffer(data)])
    return made.cast(pa.string())


def fold_array(texts: pa.Array) -> pa.Array:
    """One consistent form of each text; null stays null, empty stays empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    null = np.asarray(texts.is_null())
    points, rows = to_points(texts)
    parts, lo, n = [], 0, len(null)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + BLOCK, side="right")) - 1)
        done, bounds = fold(points[rows[lo] : rows[hi]], rows[lo : hi + 1] - rows[lo])
        parts.append(from_points(done, bounds, null[lo:hi]))
        lo = hi
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def form_column(text: Column) -> Column:
    """The consistent form of a text column (Arrow function, no shuffle)."""

    @F.arrow_udf("string")
    def form(texts: pa.Array) -> pa.Array:
        return fold_array(texts)

    return form(text)


def consistent_form(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``form`` of every row: null for null, empty for empty; repeated rows stay; other columns are unread."""
    return documents.select(F.col(key), form_column(F.col(text)).alias("form"))


def look_links(documents: DataFrame, key: str = "doc_id", text: str = "text", hot_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Membership (``pos, rep``) of the rows in classes of one text, and links (``ra, rb``) between the representatives of
    different texts that look the same, the smaller first. Only texts that have such a partner are in it.

    Only two 128-bit fingerprints a row are shuffled. Rows are first reduced to (form, text) variants, so any number of
    exact copies counts once; forms with a single variant go no further. Null and empty texts are left out.
    """
    c = F.col(text)
    kept = documents.filter(c.isNotNull() & (c != "")).select(
        F.col(key).alias("pos"), c.alias("raw"), form_column(c).alias("form")
    )
    prints = materialise(
        kept.select(
            "pos",
            F.xxhash64("form").alias("f1"),
            F.xxhash64(F.lit(1), "form").alias("f2"),
            F.xxhash64("raw").alias("r1"),
            F.xxhash64(F.lit(1), "raw").alias("r2"),
        )
    )
    variants = prints.groupBy("f1", "f2", "r1", "r2").agg(F.count(F.lit(1)).alias("copies"), F.min("pos").alias("least"))
    several = variants.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("f1", "f2")
    # a key repeated with another text is in two classes, which are told apart by the fingerprint
    rep = F.struct("least", "r1", "r2").alias("rep")
    variants = materialise(variants.join(several, ["f1", "f2"], "left_semi").withColumn("rep", rep))
    members = lookup_join(prints, variants.select("f1", "f2", "r1", "r2", "copies", "rep"), ["f1", "f2", "r1", "r2"], "copies", hot_rows)
    a, b = (variants.select("f1", "f2", F.col("rep").alias(c)) for c in ("ra", "rb"))
    links = block_join(a, b, ["f1", "f2"], "ra", "rb").filter("ra < rb").select("ra", "rb")
    return materialise(members.select("pos", "rep")), links


def same_look_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of rows whose texts look the same but differ (``doc_a`` < ``doc_b``).

    The classes and links are those of :func:`look_links`, expanded; no task ever compares the copies of one text with each
    other. Rows that repeat a key with another text are paired like any others but never with themselves.
    """
    members, links = look_links(documents, key, text)
    return expand_pairs(members, links, "doc_a", "doc_b", within=False)


def look_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``pos, look, variant, n_links``: of every row with a look-alike the smallest key of those that look the same, that of
    its own text's rows, and how many other texts look the same."""
    members, links = look_links(documents, key, text)
    ends = links.select(F.col("ra.least").alias("look"), F.col("rb").alias("rep")).union(links.select(F.col("ra.least"), F.col("ra")))
    ends = ends.union(links.select(F.col("rb.least"), F.col("ra"))).groupBy("rep").agg(F.min("look").alias("look"))
    both = links.select(F.explode(F.array("ra", "rb")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    found = members.join(ends, "rep").join(both, "rep")
    return found.select("pos", "look", F.col("rep.least").alias("variant"), "n_links")
