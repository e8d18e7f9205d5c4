"""Problem 2: map freely typed values to the entries of a reference list.

The entries and their alias paths (slug, non-numeric id, reordered words, common respellings, Arabic without the article)
are put into one trie without spaces, with word ends marked. A value is cut into windows of consecutive words; each
window runs through the trie as a Levenshtein automaton (insertions, deletions, substitutions, transpositions) whose
allowance grows with the window's length. A point after letters is an abbreviation: the automaton then skips to the end
of the word in the trie. The operator returns all entries within the distance; the best one is that which explains most
letters of the value with the fewest edits.

Values are searched once each: they are counted first (combined on the map side), and the results are joined back with
frequent values broadcast (see :func:`tallyard.session.lookup_join`).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import blank, lookup_join, materialise

UNMATCHED = "unmatched"
#: Windows remembered by a Python worker; beyond this many the memory is emptied, results do not change.
REMEMBERED = 100_000
#: About how many entries of a reference table are built into one trie; a larger table is searched in as many tries as it needs.
TRIE_ENTRIES = 200_000

# Usual respellings of romanised Arabic, each applied to a whole entry as an alias path.
RESPELLINGS = (
    ("oo", "u"), ("oo", "ou"), ("ee", "i"), ("aa", "a"), ("kh", "7"), ("w", "ou"), ("q", "k"), ("q", "g"), ("gh", "g"),
    ("th", "t"), ("dh", "d"), ("j", "g"), ("ay", "ai"), ("ee", "y"), ("kh", "k"), ("u", "o"), ("i", "e"),
)
# Words for the country, which say nothing about the entry and end a window.
COUNTRY_WORDS = {"ksa", "saudi", "arabia", "kingdom", "السعوديه", "المملكه", "العربيه"}
# Letters of Arabic that are written for one another, and marks that are left out.
ARABIC_FOLD = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ة": "ه", "ى": "ي", "ی": "ي", "ک": "ك", "ـ": ""})

_WORD = re.compile(r"[^\W_]+(?:'s)?\.?")


def allowance(letters: int) -> int:
    """Edits allowed for a window of so many letters: none below 4, one below 9, two above."""
    return 0 if letters < 4 else 1 if letters < 9 else 2


def words_of(value: str) -> list[str]:
    """Folded words of a value in order; a word that was followed by a point keeps it."""
    t = unicodedata.normalize("NFKD", value)
    t = "".join(c for c in t if not unicodedata.combining(c)).casefold().translate(ARABIC_FOLD)
    return [w for w in _WORD.findall(t.replace("&", " and ")) if w not in ("and", "and.")]


class Trie:
    """Trie of entries and alias paths with a Levenshtein automaton search."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.final: list[set[int]] = [set()]
        self.word_end = [False]
        self.size: list[int] = []
        self._jumps: dict[int, list[int]] = {}

    def add(self, words: list[str], entry: int) -> None:
        node = 0
        for w in words:
            for c in w.rstrip("."):
                at = self.next[node].get(c)
                if at is None:
                    at = self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.final.append(set())
                    self.word_end.append(False)
                node = at
            self.word_end[node] = True
        if node:
            self.final[node].add(entry)

    def jumps(self, node: int) -> list[int]:
        """Ends of the word that goes on at a node."""
        if node not in self._jumps:
            out, stack = [], [node]
            while stack:
                x = stack.pop()
                if self.word_end[x]:
                    out.append(x)
                if x == node or not self.word_end[x]:
                    stack += self.next[x].values()
            self._jumps[node] = out
        return self._jumps[node]

    def search(self, text: str, k: int) -> dict[int, int]:
        """Least distance of every entry within ``k`` edits of ``text``; a point stands for the rest of a word."""
        n, best = len(text), {}
        following, final = self.next, self.final
        # a state is (letters read, edits); (-1 - i, e) is a transposition waiting for letter i
        stack: list[tuple[int, tuple]] = [(0, ((0, 0),))]
        seen = set()
        while stack:
            node, states = stack.pop()
            closed: dict[int, int] = {}
            for i, e in states:  # letters of the text that the entry does not have
                if i < 0:
                    if closed.get(i, 9) > e:
                        closed[i] = e
                    continue
                while e <= k and i <= n:
                    if closed.get(i, 9) > e:
                        closed[i] = e
                    if i < n and text[i] == "." and k >= e:
                        for x in self.jumps(node) if node else ():
                            item = (x, ((i + 1, e),))
                            if item not in seen:
                                seen.add(item)
                                stack.append(item)
                    i, e = i + 1, e + 1
            if n in closed and final[node]:
                for entry in final[node]:
                    if best.get(entry, 9) > closed[n]:
                        best[entry] = closed[n]
            for c, child in following[node].items():
                moved: dict[int, int] = {}
                for i, e in closed.items():
                    if i < 0:
                        if text[-1 - i] == c and moved.get(1 - i, 9) > e:
                            moved[1 - i] = e
                        continue
                    if i < n and text[i] == c:
                        if moved.get(i + 1, 9) > e:
                            moved[i + 1] = e
                        continue
                    if e < k:
                        if moved.get(i, 9) > e + 1:
                            moved[i] = e + 1
                        if i < n:
                            if moved.get(i + 1, 9) > e + 1:
                                moved[i + 1] = e + 1
                            if i + 1 < n and text[i + 1] == c:
                                moved[-1 - i] = e + 1
                if moved:
                    stack.append((child, tuple(moved.items())))
        return best


class Matcher:
    """Finds the entries that a freely typed value stands for."""

    def __init__(self, entries: list[tuple[str, list[str]]]) -> None:
        """``entries``: id and its names. Alias paths are derived here."""
        self.ids = [i for i, _ in entries]
        self.trie = Trie()
        self.whole: dict[str, int] = {}
        self.most_words = 1
        for at, (ident, names) in enumerate(entries):
            if not ident.isdigit():
                self.whole.setdefault(ident.casefold(), at)
            for name in filter(None, names):
                for path in self._paths(name):
                    self.most_words = max(self.most_words, len(path))
                    self.trie.add(path, at)
        self._known: dict[str, dict[int, int]] = {}

    @staticmethod
    def _paths(name: str) -> list[list[str]]:
        words = words_of(name)
        paths = [words, words[::-1]]
        for part in re.findall("&", name)[:1]:
            left, _, right = name.partition(part)
            paths.append(words_of(right) + words_of(left))
        if re.search("[؀-ۿ]", name):
            paths.append([re.sub("^(و?)ال", r"\1", w) for w in words])
            paths.append(words_of(name.replace("ال", "")))
        else:
            for old, new in RESPELLINGS:
                if any(old in w for w in words):
                    paths.append([w.replace(old, new) for w in words])
                for i, w in enumerate(words):  # and in one place only
                    for m in re.finditer(old, w) if w.count(old) > 1 or len(words) > 1 else ():
                        paths.append([*words[:i], w[: m.start()] + new + w[m.end() :], *words[i + 1 :]])
            every = [w.replace("oo", "u").replace("ee", "i").replace("aa", "a") for w in words]
            paths.append(every)
        return [p for p in paths if p and all(p)]

    def _window(self, text: str, k: int) -> dict[int, int]:
        key = f"{k}{text}"
        if key not in self._known:
            if len(self._known) > REMEMBERED:
                self._known.clear()
            self._known[key] = self.trie.search(text, k)
        return self._known[key]

    def find(self, value: str, every: bool = False) -> list[tuple[int, int, int]]:
        """(entry, letters of the window, edits) within the distance, best first: of ``every`` entry, or as far as the best needs."""
        return [(entry, letters, edits) for entry, _, letters, edits in self.ranked(value, every)]

    def ranked(self, value: str, every: bool = False) -> list[tuple[int, int, int, int]]:
        """As :meth:`find`, with a rank before the letters that is comparable between tries."""
        whole = self.whole.get(value.strip().casefold())
        if whole is not None and not every:
            return [(whole, 1 << 40, len(value), 0)]
        words = [
            w if any(c.isalpha() for c in w) and w.rstrip(".") not in COUNTRY_WORDS else "" for w in words_of(value)
        ]
        found: dict[int, tuple[int, int, int]] = {}
        windows = set()
        for lo in range(len(words)):
            for hi in range(lo + 1, min(len(words), lo + self.most_words + 1) + 1):
                part = words[lo:hi]
                if not all(part):
                    break
                bare = [w.rstrip(".") for w in part]
                letters = sum(map(len, bare))
                if letters < 4 or max(map(len, bare)) < 3:
                    if lo == 0 and hi == len(words):  # so short a window counts only where it is the whole value
                        windows.add((letters, 1, "".join(bare)))
                else:
                    windows.add((letters, 1, "".join(bare)))
                    if bare != part:
                        windows.add((letters, 0, "".join(part)))
        enough = 0  # a shorter window with more edits can't be the best any more
        for k in range(3):
            for letters, plain, text in sorted(windows):
                if k > allowance(letters) or (not every and 2 * (letters - 2 * k) + plain <= enough):
                    continue
                for entry, edits in self._window(text, k).items():
                    scored = (2 * (letters - 2 * edits) + plain, -edits, letters)
                    if entry not in found or found[entry] < scored:
                        found[entry] = scored
            enough = max([enough, *(x[0] for x in found.values())])
        if whole is not None:
            found[whole] = (2 * len(value) + 1, 0, len(value))
        ranked = sorted(found.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))
        return [(entry, 4 * score + less, letters, -less) for entry, (score, less, letters) in ranked]

    def best(self, value: str) -> tuple[int, str] | None:
        """Rank (comparable between tries) and id of the best entry."""
        found = self.ranked(value)
        return (found[0][1], self.ids[found[0][0]]) if found else None


Entries = list[tuple[str, list[str]]]


def entry_groups(reference: DataFrame, ident: str = "id", names: tuple[str, ...] = ("name_en", "name_ar", "slug")) -> Iterator[Entries]:
    """The entries of a reference table in groups of about ``TRIE_ENTRIES``, drawn by a hash of the id; at least one group."""
    groups = max(1, -(-reference.count() // TRIE_ENTRIES))
    for g in range(groups):
        rows = reference.filter(F.pmod(F.xxhash64(F.col(ident).cast("string")), F.lit(groups)) == g).select(ident, *names).collect()
        yield sorted((str(r[0]), [x for x in r[1:] if x]) for r in rows if r[0] is not None)


def match_values(values: DataFrame, field: str, entries: Entries) -> DataFrame:
    """``value, n, field_name, m``: rank and id of the best of some entries for each value of a field (null without one)."""
    shipped = values.sparkSession.sparkContext.broadcast(entries)
    made: list[Matcher] = []

    @F.arrow_udf("struct<rank: bigint, ref_id: string>")
    def best(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Matcher(shipped.value))
        found = [made[0].best(t) for t in texts.to_pylist()]
        return pa.array([f and {"rank": f[0], "ref_id": f[1]} for f in found], pa.struct([("rank", pa.int64()), ("ref_id", pa.string())]))

    return values.filter(F.col("field_name") == field).withColumn("m", best("value"))


def typed_items(listings: DataFrame, key: str = "pos", city: str = "city", categories: str = "categories") -> DataFrame:
    """``pos, field_name, item_no, value`` of every city and category that is neither null nor blank."""
    cities = listings.select(F.col(key).alias("pos"), F.lit("city").alias("field_name"), F.lit(0).alias("item_no"), F.col(city).alias("value"))
    trades = listings.select(F.col(key).alias("pos"), F.posexplode(F.col(categories)).alias("item_no", "value"))
    trades = trades.withColumn("field_name", F.lit("categories")).select("pos", "field_name", "item_no", "value")
    return cities.union(trades).filter(~blank(F.col("value")))


def map_to_canonical(
    listings: DataFrame, cities: DataFrame, categories: DataFrame, hot_rows: int = 200_000
) -> DataFrame:
    """``pos, field_name, item_no, ref_id`` of every typed city and category that is not literally a reference name.

    ``ref_id`` is the id of the best entry or ``unmatched``. Null and blank values have no row; very long values are
    searched whole; of entries equally near, the first by id is taken; repeated rows are all answered; with an empty
    reference table everything is unmatched. Other columns of the tables, whatever their names, are not read.
    """
    items = typed_items(listings)
    values = items.groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))
    tables = {"city": cities, "categories": categories}
    literal = None
    for field, table in tables.items():
        names = table.select(F.lit(field).alias("field_name"), F.explode(F.array("name_en", "name_ar")).alias("value"))
        literal = names if literal is None else literal.union(names)
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = materialise(values.join(literal.filter("value is not null").distinct(), ["field_name", "value"], "left_anti").repartition(parts, "value"))
    found = None
    for field, table in tables.items():
        for entries in entry_groups(table):
            some = match_values(values, field, entries)
            found = some if found is None else found.union(some)
    # of several tries the best rank decides, then the first id, as within one
    first = F.min(F.when(F.col("m").isNotNull(), F.struct((-F.col("m.rank")).alias("rank"), F.col("m.ref_id"))))
    best = found.groupBy("field_name", "value").agg(F.max("n").alias("n"), F.coalesce(first["ref_id"], F.lit(UNMATCHED)).alias("ref_id"))
    joined = lookup_join(items, materialise(best), ["field_name", "value"], "n", hot_rows)
    return joined.select("pos", "field_name", "item_no", "ref_id")


def entries_within_distance(values: DataFrame, reference: DataFrame, column: str = "value") -> DataFrame:
    """Every entry within the length-dependent distance of each value, with letters explained and edits (all, not the best)."""
    found = None
    for entries in entry_groups(reference):
        some = values.select(column, F.explode_outer(_every(values, column, entries)).alias("m")).select(column, "m.ref_id", "m.letters", "m.edits")
        found = some if found is None else found.union(some.filter("ref_id is not null"))
    return found


def _every(values: DataFrame, column: str, entries: Entries) -> Column:
    shipped = values.sparkSession.sparkContext.broadcast(entries)
    made: list[Matcher] = []

    @F.arrow_udf("array<struct<ref_id: string, letters: int, edits: int>>")
    def every(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Matcher(shipped.value))
        kind = pa.list_(pa.struct([("ref_id", pa.string()), ("letters", pa.int32()), ("edits", pa.int32())]))
        rows = [[(made[0].ids[e], n, d) for e, n, d in made[0].find(t, every=True)] if t else [] for t in texts.to_pylist()]
        return pa.array([[dict(zip(("ref_id", "letters", "edits"), x)) for x in r] for r in rows], kind)

    return every(F.col(column))
