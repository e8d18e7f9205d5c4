"""Problem 4: link the spellings of one organisation's name.

Words that stand beside many different words (legal forms, trades, given names and their abbreviations) say little; the
rest of a name are its distinctive tokens. How often an organisation is listed doesn't matter for that. Each token is reduced to a consonant skeleton in which Latin and Arabic writings meet. The index
is a symmetric-delete neighbourhood on the skeletons of two tokens of a name: rows that share a neighbourhood key are
candidates, however their parts are ordered. Names with more than ``PAIRED`` tokens of a script are indexed by single tokens
instead, which every other name is looked up in. Candidates are verified by an optimal assignment of all their tokens, each
pair compared in its own script or across scripts: one name's tokens must all be found in the other, two of them at least,
and an initial or an abbreviation in the other name stands for a token. Words of both that contradict each other part them.

Rows with the same tokens are reduced to one representative first and expanded at the end.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import block_join, materialise
from .pairs import expand_pairs

#: Share of all partner words (and least number of them) beside which a word stands when it is shared rather than distinctive.
SHARED_SHARE, SHARED_LEAST = 0.025, 12
#: Most tokens of a script that are indexed in pairs; the tokens of longer names are indexed one by one.
PAIRED = 6

# Legal forms and joining words, with usual abbreviations.
LEGAL = frozenset(
    """
    company co comp coy corp corporation limited ltd llc inc plc establishment est estab estb group grp gp factory fact
    fac fcty works co.ltd and for of the al el ul bin ibn abu bros brothers sons partners trading
    شركة شركه الشركة الشركه مؤسسة مؤسسه المؤسسة المؤسسه مصنع المصنع مجموعة مجموعه المجموعة المجموعه المحدودة المحدوده محدودة
    وشركاه واولاده وأولاده بن ابن أبو ابو
    """.split()
)
# Words that follow the name of a shop or brand.
OUTLETS = frozenset("store shop mart brand online".split())
# Consonants of Arabic and of Latin digraphs, in classes that are confused in typing and romanising.
ARABIC_CLASS = dict(zip("بتثجحخدذرزسشصضطظعغفقكلمنهپچگڤ", "bt0jhxd0rzscsdtz'kfkklmnhbckf"))
LATIN_DIGRAPHS = (
    ("kh", "x"), ("7", "x"), ("sh", "c"), ("ch", "c"), ("th", "0"), ("dh", "0"), ("gh", "k"), ("dj", "j"), ("ck", "k"),
    ("ph", "f"), ("q", "k"), ("g", "k"), ("v", "f"), ("p", "b"),
)
# Vowels and glides as written in Latin, in order of replacement, in the three classes that Arabic writes.
LATIN_VOWELS = (("oo", "w"), ("ou", "w"), ("ee", "y"), ("ie", "y"), ("ea", "y"), ("aa", "a"))

_LATIN = re.compile(r"[a-z0-9]*[a-z][a-z0-9]*")
_ARABIC = re.compile(r"[ء-يپچگڤ]+")
_TATWEEL = re.compile("[ـً-ٰٟ​-‏]")
_ALEF = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ی": "ي", "ک": "ك", "ة": "ه"})
# Letters that are the same after the steps of fold except for the changes of _PLAIN.
_PLAIN_LETTERS = re.compile(r"[\x00-\x7fء-غف-ي]*")
_PLAIN = _ALEF | str.maketrans({"ؤ": "و", "ئ": "ي"})


def fold(text: str) -> str:
    """Lower case, without accents, tatweel and vowel signs; Arabic letters in one form."""
    if text.isascii():
        return text.lower()
    if _PLAIN_LETTERS.fullmatch(text):
        return text.translate(_PLAIN).lower()
    t = unicodedata.normalize("NFKC", text)
    t = _TATWEEL.sub("", t).translate(_ALEF).casefold()
    return "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))


LEGAL_FOLDED = frozenset(map(fold, LEGAL))
_WORD = re.compile(rf"{_ARABIC.pattern}|{_LATIN.pattern}")


def words(text: str | None) -> list[str]:
    """Folded Latin and Arabic words in order."""
    return _WORD.findall(fold(text)) if text else []


def is_arabic(word: str) -> bool:
    return "؀" <= word[0] <= "ۿ"


@lru_cache(maxsize=100_000)
def strip_article(word: str) -> str:
    if word[1:2] not in ("l", "ل", "ا"):  # the articles' second letters
        return word
    if is_arabic(word):
        m = re.fullmatch("و?ال(.{2,})", word)
        return m[1] if m else word
    m = re.fullmatch("(?:al|el|ul)((?:[bcdfghjklmnpqrstvwxyz7]|ou).{3,})", word)
    return m[1] if m else word


class _Only(dict):
    """A table for str.translate that drops all letters it does not hold."""

    def __missing__(self, letter: int) -> None:
        return None


# The replacements of letters in one table each, after those of two letters: single letters become none of those.
_DIGRAPHS_H = [(a, b) for a, b in LATIN_DIGRAPHS if len(a) == 2 and "h" in a]
_DIGRAPHS = [(a, b) for a, b in LATIN_DIGRAPHS if len(a) == 2 and "h" not in a]
_LETTERS = str.maketrans({a: b for a, b in LATIN_DIGRAPHS if len(a) == 1})
_CONSONANTS = str.maketrans("#", "0", "aeiouwy'123456789")
_ARABIC_CONSONANTS = _Only({ord(a): b for a, b in (ARABIC_CLASS | {"\n": "\n"}).items() if b != "'"})
_ARABIC_ACROSS = _Only({ord(a): b for a, b in (ARABIC_CLASS | {"و": "w", "ي": "y", "\n": "\n"}).items()})
# What leaves something in a skeleton.
_CONSONANT = re.compile(f"[bcdfghjklmnpqrstvxz07#{''.join(a for a, b in ARABIC_CLASS.items() if b != chr(39))}]")
_REPEATED = re.compile(r"([^\n])\1+")
_NO_VOWELS = str.maketrans("", "", "aeiou")
_ONE_VOWELS = str.maketrans({"w": "u", "o": "u", "e": "i", "y": "i"})


def _classes(word: str) -> str:
    if "h" in word:
        for old, new in _DIGRAPHS_H:
            word = word.replace(old, new)
    for old, new in _DIGRAPHS:
        word = word.replace(old, new)
    return word.translate(_LETTERS)


def _squeeze(text: str) -> str:
    out, last = [], ""
    for c in text:
        if c != last:
            out.append(c)
            last = c
    return "".join(out)


@lru_cache(maxsize=100_000)
def skeleton(word: str) -> str:
    """Consonant classes of a Latin or Arabic word, repeated ones once."""
    return _squeeze(word.translate(_ARABIC_CONSONANTS) if is_arabic(word) else _classes(word).translate(_CONSONANTS))


_COARSE = str.maketrans({"x": "k", "c": "s", "0": "t", "h": ""})


def coarse(word: str) -> str:
    """Skeleton in which a digraph and its letters in the other order (kh, hk) are the same: the index's token."""
    return _forms(word)[0]


def across(word: str) -> str:
    """A form in which a Latin and an Arabic writing can be compared: consonant classes and the long vowels."""
    return _forms(word)[2]


def spelling(word: str) -> str:
    """A Latin word without the differences of romanising."""
    return _forms(word)[1]


#: Coarse skeleton, spelling and form across scripts of words met lately.
_MET: dict[str, tuple[str, str, str]] = {}


def _forms(word: str) -> tuple[str, str, str]:
    found = _MET.get(word)
    if found is None:
        learn_forms([word])
        found = _MET[word]
    return found


def learn_forms(found: Iterable[str]) -> None:
    """The forms of many words, each made of all of them at once, a line for each."""
    new = {w for w in found if w not in _MET}
    if len(_MET) + len(new) > 150_000:
        _MET.clear()
        new = set(found)
    squeeze = (lambda t: _REPEATED.sub(r"\1", t)) if len(new) > 1 else _squeeze
    for arabic in (False, True):
        part = [w for w in new if is_arabic(w) == arabic]
        if not part:
            continue
        t = "\n".join(part)
        if arabic:
            bones, spelt, crossing = t.translate(_ARABIC_CONSONANTS), t, t.translate(_ARABIC_ACROSS)
        else:
            t = _classes(t)
            bones, spelt, crossing = t.translate(_CONSONANTS), t, t
            for old, new_ in (("oo", "u"), ("ou", "u"), ("ee", "i"), ("ie", "i"), ("ea", "i"), ("aa", "a")):
                spelt = spelt.replace(old, new_)
            for old, new_ in LATIN_VOWELS:
                crossing = crossing.replace(old, new_)
            spelt, crossing = squeeze(spelt.translate(_ONE_VOWELS)), crossing.translate(_NO_VOWELS)
        bones = squeeze(bones)
        rough = squeeze(bones.translate(_COARSE))
        lines = (x.split("\n") for x in (bones, rough, spelt, squeeze(crossing)))
        _MET.update((w, (r or b, x, y)) for w, b, r, x, y in zip(part, *lines))


def _agree(a: str, b: str) -> int:
    """With how many equal letters two words begin."""
    n, least = 0, min(len(a), len(b))
    while n < least and a[n] == b[n]:
        n += 1
    return n


def _one_edit(a: str, b: str) -> bool:
    """Whether two words are within one edit."""
    if not -2 < len(a) - len(b) < 2:
        return False
    i = _agree(a, b)
    x, y = a[i + 1 :], b[i + 1 :]
    return x == y or x == b[i:] or a[i:] == y or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours; ``most + 1`` when it is larger than ``most``."""
    if a == b:
        return 0
    if not most or abs(len(a) - len(b)) > most:
        return most + 1
    start = _agree(a, b)
    a, b = a[start:], b[start:]
    if _one_edit(a, b):
        return 1
    if most == 1:
        return 2
    if most == 2:  # what the first letters, which differ, can be
        swapped = len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]
        if _one_edit(a[1:], b[1:]) or _one_edit(a[1:], b) or _one_edit(a, b[1:]) or (swapped and _one_edit(a[2:], b[2:])):
            return 2
        return 3
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row2, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(row2[j] + 1, row[j - 1] + 1, row2[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before = row2
    return min(row[-1], most + 1)


@lru_cache(maxsize=100_000)
def letters(word: str) -> int:
    """The set of a word's letters as bits; an edit changes at most two of them."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def near(a: str, b: str, most: int) -> int:
    """:func:`edits` behind a cheap lower bound where it takes long."""
    if most > 1 and (letters(a) ^ letters(b)).bit_count() > 2 * most:
        return most + 1
    return edits(a, b, most)


def _subsequence(short: str, long: str) -> bool:
    at = iter(long)
    return all(c in at for c in short)


class Tokenizer:
    """Splits names into distinctive tokens, given the words that many rows share."""

    def __init__(self, shared: set[str]) -> None:
        self.shared = {strip_article(w) for w in shared} | shared
        self._by_first: dict[str, list[tuple[str, int]]] = {}
        self._near: dict[str, list[str]] = {}
        self._long = [w for w in sorted(self.shared) if len(w) >= 5]
        for w in self._long:
            self._by_first.setdefault(w[0], []).append((w, letters(w)))
            for d in self._shortened(w):
                self._near.setdefault(d, []).append(w)
        self._long_letters = np.array([letters(w) for w in self._long], np.uint64)
        self._long_sizes = np.array([len(w) for w in self._long], np.int16)
        self._known: dict[str, bool] = {}
        self._trades: dict[str, bool] = {}

    def learn(self, found: Iterable[str]) -> None:
        """Decide many words at once: only shared words of nearly a word's letters and length are compared with it."""
        new = sorted({w for w in found if w not in self._known})
        if len(self._known) + len(new) > 150_000:
            self._known.clear()
        for at in range(0, len(new), 4_096):
            part = new[at : at + 4_096]
            sizes = np.array([len(w) for w in part], np.int16)
            most = np.where(sizes < 8, 1, 2)[:, None]
            held = np.bitwise_count(np.array([letters(w) for w in part], np.uint64)[:, None] ^ self._long_letters[None, :]) <= 2 * most
            held &= (np.abs(sizes[:, None] - self._long_sizes[None, :]) <= most) & (sizes[:, None] >= 5)
            mistyped = set()
            for i, j in zip(*(x.tolist() for x in held.nonzero())):
                if i not in mistyped and edits(part[i], self._long[j], 1 if len(part[i]) < 8 else 2) <= (1 if len(part[i]) < 8 else 2):
                    mistyped.add(i)
            for i, w in enumerate(part):
                self._known[w] = i in mistyped or self._ordinary(w, False)

    def ordinary(self, word: str) -> bool:
        """Whether a word is shared, a legal form, or a short or mistyped form of a shared word."""
        if word not in self._known:
            if len(self._known) > 150_000:
                self._known.clear()
            self._known[word] = self._ordinary(word)
        return self._known[word]

    def _ordinary(self, w: str, whole: bool = True) -> bool:
        """``whole``: whether the whole word has to be compared with the shared ones, too."""
        if w in LEGAL_FOLDED or w in OUTLETS or w in self.shared or len(w) < 3:
            return True
        if not is_arabic(w):
            if len(w) < 5 or self._within(w):
                return True
        return (whole and self._mistyped(w)) or any(
            (w[:i] in self.shared and self._mistyped(w[i:])) or (w[i:] in self.shared and self._mistyped(w[:i]))
            for i in range(4, len(w) - 3)
        )

    def _within(self, w: str) -> bool:
        """Whether a word has letters of a longer shared one in order, the first among them."""
        own = letters(w)
        return any(not own & ~held and w != x and _subsequence(w, x) for x, held in self._by_first.get(w[0], ()))

    def _mistyped(self, w: str) -> bool:
        """Whether a word is a shared one with few edits."""
        if len(w) < 5:
            return False
        most = 1 if len(w) < 8 else 2
        return any(edits(w, x, most) <= most for d in self._shortened(w) for x in self._near.get(d, ()))

    @staticmethod
    def _shortened(w: str) -> set[str]:
        """A word without one letter, or without two if it is long (its symmetric-delete neighbourhood)."""
        one = {w[:i] + w[i + 1 :] for i in range(len(w))}
        two = {x[:i] + x[i + 1 :] for x in one for i in range(len(x))} if len(w) >= 7 else set()
        return {w} | one | two

    def distinctive(self, *texts: str | None) -> list[str]:
        """Distinctive tokens of some names, first occurrences, without articles."""
        return self.distinctive_of([w for t in texts for w in words(t)])

    def distinctive_of(self, found: list[str]) -> list[str]:
        """The same for the words of the names."""
        out: dict[str, None] = {}
        for w in found:
            if not self.ordinary(w):
                bare = strip_article(w)
                if not self.ordinary(bare) and _CONSONANT.search(bare):
                    out[bare] = None
        return list(out)

    def shorts(self, tokens: list[str], *texts: str | None) -> list[str]:
        """Words of some names that can be an initial or an abbreviation of a distinctive token."""
        return self.shorts_of(tokens, [w for t in texts for w in words(t)])

    def shorts_of(self, tokens: list[str], found: list[str]) -> list[str]:
        """The same for the words of the names."""
        short = {w for w in found if len(w) < 5 and not is_arabic(w) and w.isalpha() and not self._trade(w)}
        return sorted(w for w in short if w not in tokens and strip_article(w) not in tokens)

    def _trade(self, w: str) -> bool:
        known = self._trades.get(w)
        if known is None:
            if len(self._trades) > 150_000:
                self._trades.clear()
            known = w in LEGAL_FOLDED or w in OUTLETS or w in self.shared
            known = known or (len(w) > 1 and any(_subsequence(w, x) for x, _ in self._by_first.get(w[0], ())))
            self._trades[w] = known
        return known


@lru_cache(maxsize=100_000)
def deletes(s: str) -> frozenset[str]:
    """A skeleton and, if it is long enough, what is left after leaving out one letter."""
    return frozenset([s, *(s[:i] + s[i + 1 :] for i in range(len(s)))] if len(s) >= 3 else [s])


def _key(*parts: str) -> int:
    return xxhash.xxh64_intdigest("|".join(parts).encode()) - (1 << 63)


def pair_keys(tokens: list[str]) -> list[int]:
    """Neighbourhood keys of a name: for two of its tokens, one skeleton and the deletes of the other.

    None for a script of which it has more than ``PAIRED`` tokens.
    """
    out = set()
    for script in (True, False):
        same = [coarse(t) for t in tokens if is_arabic(t) == script]
        for a, b in combinations(same, 2) if len(same) <= PAIRED else ():
            out |= {(x, b) if x <= b else (b, x) for x in deletes(a)}
            out |= {(a, y) if a <= y else (y, a) for y in deletes(b)}
    return sorted({_key("p", *x) for x in out})


def initial_keys(tokens: list[str], shorts: list[str]) -> list[int]:
    """Keys under which a name of one Latin token and initials meets the names that have this token beside another."""
    latin = [t for t in tokens if not is_arabic(t)]
    if len(latin) == 1:
        return sorted({_key("i", coarse(latin[0]), s[0]) for s in shorts})
    return sorted({_key("i", coarse(a), b[0]) for a in latin for b in latin if a != b}) if len(latin) <= PAIRED else []


def single_keys(tokens: list[str]) -> list[int]:
    """Neighbourhood keys of all single tokens of a name that has more than ``PAIRED`` of a script."""
    if max(sum(map(is_arabic, tokens)), sum(not is_arabic(t) for t in tokens)) <= PAIRED:
        return []
    return sorted({_key("s", d) for t in tokens for d in deletes(coarse(t))})


def probe_keys(tokens: list[str]) -> list[int]:
    """Keys under which any name is looked up among the long ones: those of the longest skeleton of each script."""
    out: set[str] = set()
    for script in (True, False):
        same = [coarse(t) for t in tokens if is_arabic(t) == script]
        if len(same) > 1:
            out |= deletes(max(same, key=lambda x: (len(x), x)))
    return sorted(_key("s", d) for d in out)


@lru_cache(maxsize=1_000_000)
def token_distance(a: str, b: str) -> float:
    """Distance of two tokens, 9 where they are not spellings of one another."""
    if a == b:
        return 0.0
    if is_arabic(a) != is_arabic(b):
        arabic, latin = (a, b) if is_arabic(a) else (b, a)
        writings = [arabic, arabic[1:]] if arabic[0] == "و" and len(arabic) >= 4 else [arabic]  # with "and" before it
        best = 9.0
        for w in writings:
            x, y = across(w), across(latin)
            most = 1 if min(len(x), len(y)) >= 5 else 0
            d = near(x, y, most)
            best = min(best, 0.5 + d if d <= most else 9.0)
        return best
    x, y = spelling(a), spelling(b)
    size = max(len(x), len(y))
    most = (0 if size < 3 else 1 if size < 6 else 2) if is_arabic(a) else (1 if size < 7 else 2)
    d = near(x, y, most)
    if d > most and not is_arabic(a):
        most = 1 if min(len(a), len(b)) < 8 else 2
        d = near(a, b, most)
    return float(d) if d <= most else 9.0


def assignment(cost: list[list[float]]) -> list[int]:
    """Column of each row of a matrix with no more rows than columns, so that the sum is least (shortest augmenting paths)."""
    n, m = len(cost), len(cost[0])
    above, left = [0.0] * (m + 1), [0.0] * (n + 1)
    holder = [0] * (m + 1)  # row that holds a column; column 0 is the row looking for one
    for row in range(1, n + 1):
        holder[0], at = row, 0
        reach, came, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while holder[at]:
            done[at] = True
            r, step, following = holder[at], float("inf"), 0
            for c in range(1, m + 1):
                if not done[c]:
                    d = cost[r - 1][c - 1] - left[r] - above[c]
                    if d < reach[c]:
                        reach[c], came[c] = d, at
                    if reach[c] < step:
                        step, following = reach[c], c
            for c in range(m + 1):
                if done[c]:
                    left[holder[c]] += step
                    above[c] -= step
                else:
                    reach[c] -= step
            at = following
        while at:
            holder[at] = holder[came[at]]
            at = came[at]
    out = [0] * n
    for c in range(1, m + 1):
        if holder[c]:
            out[holder[c] - 1] = c - 1
    return out


def best_assignment(a: list[str], b: list[str]) -> list[tuple[int, int, float]]:
    """Pairs ``(place in a, place in b, distance)`` of the optimal assignment that are spellings of one another."""
    if len(a) > len(b):
        return [(j, i, d) for i, j, d in best_assignment(b, a)]
    cost = [[token_distance(x, y) for y in b] for x in a]
    if len(a) == 2 and len(b) == 2:
        straight = cost[0][0] + cost[1][1] <= cost[0][1] + cost[1][0]
        found = ((0, 0), (1, 1)) if straight else ((0, 1), (1, 0))
    else:
        found = enumerate(assignment(cost)) if a else ()
    return [(i, j, cost[i][j]) for i, j in found if cost[i][j] < 9]


def stands_for(short: str, token: str) -> bool:
    """Whether a word of up to four letters is an initial or an abbreviation of a token."""
    return short[0] == token[0] and len(short) < len(token) and _subsequence(short, token)


def covered(rest: list[str], shorts: list[str]) -> bool:
    """Whether each token left over is stood for by a short word of its own."""
    free = list(shorts)
    for token in rest:
        found = next((s for s in sorted(free, key=len, reverse=True) if stands_for(s, token)), None)
        if found is None:
            return False
        free.remove(found)
    return True


def same_names(a: list[str], b: list[str], short_a: list[str] = (), short_b: list[str] = ()) -> bool:
    """Whether two names, each the distinctive tokens of its two scripts, are spellings of one.

    In some script of each, the optimal assignment finds two tokens or more at one edit apiece on the average, and every
    token of one of the names is found or has an initial or abbreviation in the other. One token found must be within one
    edit, and then all others of that name need initials.
    """
    sides = [([t for t in x if not is_arabic(t)], [t for t in x if is_arabic(t)]) for x in (a, b)]
    for sa, sb in ((0, 0), (1, 1), (0, 1), (1, 0)):
        ta, tb = sides[0][sa], sides[1][sb]
        if not ta or not tb or max(len(ta), len(tb)) < 2:
            continue
        if len(ta) == len(tb) == 2:  # either both are found, or each name has a token left over
            for first, second in (tb, tb[::-1]):
                d = token_distance(ta[0], first)
                if d <= 2 and d + token_distance(ta[1], second) <= 2:
                    return True
            continue
        pairs = best_assignment(ta, tb)
        if not pairs or sum(d for _, _, d in pairs) > len(pairs):
            continue
        held_a, held_b = {i for i, _, _ in pairs}, {j for _, j, _ in pairs}
        rest_a = [t for i, t in enumerate(ta) if i not in held_a]
        rest_b = [t for j, t in enumerate(tb) if j not in held_b]
        if len(pairs) > 1 and (not rest_a or not rest_b):
            return True
        if rest_a and short_b and covered(rest_a, short_b) and (len(pairs) > 1 or not rest_b):
            return True
        if rest_b and short_a and covered(rest_b, short_a) and (len(pairs) > 1 or not rest_a):
            return True
    return False


def partner_key(word: str) -> str:
    """What a word counts as where it stands beside another: its coarse skeleton and digits; empty for legal forms."""
    if len(word) < 3 or word in LEGAL_FOLDED:
        return ""
    return coarse(word) + "".join(filter(str.isdigit, word))


def beside(named: DataFrame, only: list[str] | None = None, share: float = 0.0, least: float = 0.0) -> tuple[DataFrame, int]:
    """``w, n``: beside how many different partners each word stands, and how many partners there are.

    ``named`` has in ``x`` the words ``w`` of a text and what they count as, ``k``. Misspellings of a partner count as one
    with it: it stands for the most frequent key in its symmetric-delete neighbourhood. ``only``: the words to count for. Words
    that stand beside fewer than ``least`` partners or that share of all are left out; those whose rows hold fewer other words
    are not counted at all.
    """

    @F.arrow_udf("array<string>")
    def neighbours(keys: pa.Array) -> pa.Array:
        return pa.array([sorted(deletes(k)) for k in keys.to_pylist()], pa.list_(pa.string()))

    counted = named.select(F.explode(F.array_distinct("x.k")).alias("k")).filter("k <> ''").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    near_ = materialise(counted.select("k", "n", F.explode(neighbours("k")).alias("d")))
    weight = near_.groupBy("d").agg(F.sum("n").alias("m"))
    stands = near_.join(weight, "d").groupBy("k").agg(F.max(F.struct("m", "d")).alias("best")).select("k", F.col("best.d").alias("p"))
    stands = materialise(stands)
    total = stands.select("p").distinct().count()
    least = max(least, share * total)
    pairs = named.select(F.explode("x.w").alias("w"), "x")
    if only is not None:
        pairs = pairs.filter(F.col("w").isin(only))
    if least > 1:
        own = named.select(F.explode("x.w").alias("w"), (F.size("x") - 1).alias("n"))
        often = materialise(own.groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("w"))
        pairs = pairs.join(often, "w")
    pairs = pairs.select("w", F.explode("x").alias("y")).filter("w <> y.w and y.k <> ''").select("w", F.col("y.k").alias("k")).distinct()
    return pairs.join(stands, "k").groupBy("w").agg(F.count_distinct("p").alias("n")).filter(F.col("n") >= least), total


def lists(column: pa.Array) -> list[list[str]]:
    """The rows of a column of lists of texts without nulls; many times faster than ``to_pylist``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def places(rows: list[list]) -> pa.Array:
    """Where each row's items begin in the list of all."""
    return pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())


def shared_words(names: DataFrame, *columns: str) -> set[str]:
    """Words that stand beside at least ``SHARED_SHARE`` of all different partner words.

    Different names are counted, not rows, and a partner's misspellings as one with it. So an organisation's own words
    have few partners, however many rows and writings it has.
    """

    @F.arrow_udf("array<struct<w: string, k: string>>")
    def split(*texts: pa.Array) -> pa.Array:
        rows = zip(*(t.to_pylist() for t in texts))
        found = [sorted({w for t in row for w in words(t)}) for row in rows]
        flat = [w for row in found for w in row]
        learn_forms(set(flat))
        both = [pa.array(x, pa.string()) for x in (flat, [partner_key(w) for w in flat])]
        return pa.ListArray.from_arrays(places(found), pa.StructArray.from_arrays(both, ["w", "k"]))

    named = materialise(names.select(*columns).distinct().select(split(*columns).alias("x")))
    partners, _ = beside(named, share=SHARED_SHARE, least=SHARED_LEAST)
    return {r[0] for r in partners.select("w").collect()}


def name_column(shared, name: Column, other: Column) -> Column:
    """Tokens and short words of two name columns, each sorted; ``shared`` is a broadcast set of shared words."""
    made: list[Tokenizer] = []

    @F.arrow_udf("struct<tokens: array<string>, shorts: array<string>>")
    def split(a: pa.Array, b: pa.Array) -> pa.Array:
        if not made:
            made.append(Tokenizer(shared.value))
        found = [words(x) + words(y) for x, y in zip(a.to_pylist(), b.to_pylist())]
        every = {w for row in found for w in row}
        made[0].learn(every | set(map(strip_article, every)))
        tokens = [sorted(made[0].distinctive_of(row)) for row in found]
        shorts = [made[0].shorts_of(own, row) if own else [] for own, row in zip(tokens, found)]
        many = pa.list_(pa.string())
        return pa.StructArray.from_arrays([pa.array(tokens, many), pa.array(shorts, many)], ["tokens", "shorts"])

    return split(name, other)


#: Kinds of index keys: of pairs of tokens, met by their like; of the one side of the two other indexes.
BOTH, POSTED = 0, 1


def index_keys(tokens: list[str], shorts: list[str], several: bool) -> list[tuple[int, int]]:
    """``(kind, key)`` under which a name's class is indexed."""
    if not several:
        return [(POSTED, k) for k in initial_keys(tokens, shorts)] if shorts else []
    return [(BOTH, k) for k in pair_keys(tokens)] + [(POSTED, k) for k in single_keys(tokens)]


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType())])))
def key_column(tokens: pa.Array, shorts: pa.Array, several: pa.Array) -> pa.Array:
    found = lists(tokens)
    learn_forms({t for row in found for t in row})
    rows = [index_keys(*row) for row in zip(found, lists(shorts), several.to_pylist())]
    flat = np.array([x for row in rows for x in row], np.int64).reshape(-1, 2)
    items = pa.StructArray.from_arrays([pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1])], ["kind", "key"])
    return pa.ListArray.from_arrays(places(rows), items)


@F.arrow_udf(T.ArrayType(T.LongType()))
def probe_column(tokens: pa.Array, shorts: pa.Array) -> pa.Array:
    """Keys under which a name of several tokens is looked up among the posted ones."""
    rows = zip(lists(tokens), lists(shorts))
    return pa.array([[*initial_keys(a, b), *probe_keys(a)] for a, b in rows], pa.list_(pa.int64()))


def _mark(text: str, from_: int = 5) -> int:
    """A text's letters and length, as a bit more for each letter from ``from_`` on, in 32 bits of which an edit changes at most two."""
    bits = 0
    for c in text:
        bits |= 1 << (ord(c) & 31)
    return bits | _LENGTHS[min(max(len(text) - from_ + 1, 0), len(_LENGTHS) - 1)]


# Places of the bits for a length, which Latin letters and the usual Arabic ones leave free: those from 5, 6, 7, 8 letters on
_FREE = (27, 28, 29, 30, 31, 0)
_LENGTHS = [sum(1 << b for b in _FREE[:n]) for n in range(len(_FREE) + 1)]
#: What marks hold: the scripts of two tokens each (1 Latin, 2 Arabic), none where marks say nothing; two marks in each number.
MARKS = ("has", "l1", "l2", "lx", "a1", "a2")


@lru_cache(maxsize=100_000)
def token_marks(token: str) -> tuple[int, int, int]:
    """Marks of a token as written, of its spelling and of its form across scripts, without w: "and" may be left out there."""
    return _mark(token), _mark(spelling(token)), _mark(across(token).replace("w", ""), 3)


def name_marks(tokens: list[str], shorts: list[str]) -> tuple[int, ...]:
    """``MARKS`` of a name. They say nothing of a script of more than two tokens, and of one token if initials are there."""
    latin, arabic = [t for t in tokens if not is_arabic(t)], [t for t in tokens if is_arabic(t)]
    if max(len(latin), len(arabic)) != 2 or (shorts and 1 in (len(latin), len(arabic))):
        return (0,) * len(MARKS)
    l1 = l2 = lx = a1 = a2 = 0
    if len(latin) == 2:
        (w1, s1, x1), (w2, s2, x2) = map(token_marks, latin)
        l1, l2, lx = w1 << 32 | s1, w2 << 32 | s2, x1 << 32 | x2
    if len(arabic) == 2:
        (w1, _, x1), (w2, _, x2) = map(token_marks, arabic)
        a1, a2 = w1 << 32 | x1, w2 << 32 | x2
    return ((len(latin) == 2) + 2 * (len(arabic) == 2), l1, l2, lx, a1, a2)


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in MARKS]))
def mark_column(tokens: pa.Array, shorts: pa.Array) -> pa.Array:
    found = lists(tokens)
    learn_forms({t for row in found for t in row})
    rows = [name_marks(*row) for row in zip(found, lists(shorts))]
    flat = np.array(rows, np.uint64).reshape(-1, len(MARKS)).astype(np.int64)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in flat.T], list(MARKS))


def marks_allow(x: str, y: str) -> Column:
    """Whether two names can be spellings of one, from their marks in the columns with prefix ``x`` and ``y``: a lower bound.

    A pair of tokens is at least half as many edits apart as their marks differ in bits. Two tokens each of two names have to
    be found at two edits together in one script, at one across scripts, where each pair counts half an edit more. Two edits
    are allowed from the lengths of :func:`token_distance` on.
    """
    def apart(a: str, b: str, upper: bool, upper_b: bool | None = None) -> str:
        halves = [f"shiftrightunsigned({c}, 32)" if u else f"({c} & {0xFFFFFFFF}L)" for c, u in ((a, upper), (b, upper if upper_b is None else upper_b))]
        return f"shiftright(bit_count({halves[0]} ^ {halves[1]}) + 1, 1)"

    def latin(a: str, b: str) -> str:
        spelt, written = apart(a, b, False), apart(a, b, True)
        two = f"(({a} | {b}) & {1 << _FREE[2]}L) <> 0", f"({a} & {b} & {1 << (_FREE[3] + 32)}L) <> 0"
        return f"least(if({spelt} < 2 or {two[0]}, {spelt}, 9), if({written} < 2 or {two[1]}, {written}, 9))"

    def arabic(a: str, b: str) -> str:
        return f"if({apart(a, b, True)} < 2 or (({a} | {b}) & {1 << (_FREE[1] + 32)}L) <> 0, {apart(a, b, True)}, 9)"

    def across_(p: str, q: str, i: int, j: int) -> str:
        return apart(f"{p}lx", f"{q}a{j}", i == 1, False)

    def within(d, most: int) -> str:
        return f"({d(1, 1)} + {d(2, 2)} <= {most} or {d(1, 2)} + {d(2, 1)} <= {most})"

    return F.expr(
        f"{x}has = 0 or {y}has = 0"
        f" or (({x}has & {y}has & 1) <> 0 and {within(lambda i, j: latin(f'{x}l{i}', f'{y}l{j}'), 2)})"
        f" or (({x}has & {y}has & 2) <> 0 and {within(lambda i, j: arabic(f'{x}a{i}', f'{y}a{j}'), 2)})"
        f" or (({x}has & 1) <> 0 and ({y}has & 2) <> 0 and {within(lambda i, j: across_(x, y, i, j), 1)})"
        f" or (({y}has & 1) <> 0 and ({x}has & 2) <> 0 and {within(lambda i, j: across_(y, x, i, j), 1)})"
    )


@F.arrow_udf(T.BooleanType())
def same_column(a: pa.Array, b: pa.Array, short_a: pa.Array, short_b: pa.Array) -> pa.Array:
    ta, tb = lists(a), lists(b)
    learn_forms({t for x in (ta, tb) for row in x for t in row})
    return pa.array([same_names(*row) for row in zip(ta, tb, lists(short_a), lists(short_b))], pa.bool_())


def name_links(
    listings: DataFrame, key: str = "pos", name: str = "name_en", other: str = "name_ar"
) -> tuple[DataFrame, DataFrame]:
    """Membership (``pos, rep``) of the rows in classes of one name, and links (``ra, rb``) between the representatives of
    classes that name one organisation, the smaller first.

    Rows with the same tokens are a class; where a name has but one token in a script, rows with equal names. Names without
    distinctive tokens (null, blank, initials only, a trade only) name no organisation and are in no class.
    """
    spark = listings.sparkSession
    rows = listings.select(F.col(key).alias("pos"), F.col(name).alias("a"), F.col(other).alias("b"))
    shared = spark.sparkContext.broadcast(shared_words(rows, "a", "b"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rows.repartition(parts, "pos").withColumn("n", name_column(shared, F.col("a"), F.col("b")))
    latin = F.size(F.filter("n.tokens", lambda t: t.rlike("^[a-z0-9]")))
    several = (latin > 1) | (F.size("n.tokens") - latin > 1)
    raw = F.when(~several, F.xxhash64("a", "b"))
    # The filter comes after the write; before it, it would have the tokens made twice, in front of the exchange and behind.
    named = materialise(named.select("pos", "n.*", several.alias("several"), raw.alias("raw"))).filter(F.size("tokens") > 0)
    forms = named.groupBy("tokens", "shorts", "several", "raw").agg(F.min("pos").alias("rep"), F.count(F.lit(1)).alias("n"))
    forms = materialise(forms)
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("tokens", "shorts", "several", "raw")]
    members = materialise(named.alias("x").join(forms.alias("y"), same).select("x.pos", "y.rep"))
    keyed = forms.select("rep", mark_column("tokens", "shorts").alias("m"), F.explode(key_column("tokens", "shorts", "several")).alias("k"))
    keyed = materialise(keyed).select("rep", "m.*", "k.*")  # taken apart after the write; before it, the marks would be made for each
    # Marks are never null; saying so keeps the code that compares them small enough to be compiled.
    marks = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in MARKS]
    both = keyed.filter(F.col("kind") == BOTH).select("key", "rep", *marks)
    left, right = (both.select("key", *(F.col(c).alias(p + c) for c in ("rep", *MARKS))) for p in ("x_", "y_"))
    met = block_join(left, right, ["key"], "x_rep", "y_rep").filter(F.col("x_rep") < F.col("y_rep")).filter(marks_allow("x_", "y_"))
    candidates = met.select(F.col("x_rep").alias("ra"), F.col("y_rep").alias("rb"))
    posted = keyed.filter(F.col("kind") == POSTED).select("key", F.col("rep").alias("x"))
    if not posted.isEmpty():
        probed = materialise(forms.filter("several").select(F.col("rep").alias("y"), F.explode(probe_column("tokens", "shorts")).alias("key")))
        met = block_join(posted, probed, ["key"], "x", "y").filter(F.col("x") != F.col("y"))
        candidates = candidates.union(met.select(F.least("x", "y"), F.greatest("x", "y")))
    one = forms.select(F.col("rep").alias("ra"), F.col("tokens").alias("ta"), F.col("shorts").alias("sa"))
    two = forms.select(F.col("rep").alias("rb"), F.col("tokens").alias("tb"), F.col("shorts").alias("sb"))
    verified = candidates.distinct().join(one, "ra").join(two, "rb").filter(same_column("ta", "tb", "sa", "sb"))
    return members, materialise(verified.select("ra", "rb"))


def name_variants(
    listings: DataFrame, key: str = "pos", name: str = "name_en", other: str = "name_ar"
) -> DataFrame:
    """``pos_a, pos_b``: pairs of rows that name one organisation, equal spellings included, smaller key first.

    The classes and links are those of :func:`name_links`, expanded. Names with one distinctive token are paired with equal
    names and with those that their initials complete. Repeated keys give no pair with themselves. Very long names are
    tokenised whole.
    """
    members, links = name_links(listings, key, name, other)
    return expand_pairs(members, links)
