"""Reading names of organisations as people type them: lexicon words, proper words, acronyms.

A name is a proper word (a place or a surname) and a bag of lexicon words in any order.
Lexicon words are recognised in full, in their usual abbreviations, cut short before a
full stop, and with typing errors; what is left is proper.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

#: Words of organisation names with their usual abbreviations and other spellings.
LEXICON = {
    "academy": "acad", "agency": "agcy ag", "agriculture": "agric agri", "association": "assoc assn asn",
    "biology": "biol", "biotechnology": "biotech biotechnol", "cancer": "canc", "center": "centre ctr cent", "climate": "clim",
    "college": "coll", "conseil": "", "council": "cncl counc", "data": "", "disease": "diseases dis", "disorder": "disorders disord",
    "ecology": "ecol", "education": "educ", "energy": "energ", "food": "", "foundation": "found fdn fndn fnd",
    "fund": "", "fundacao": "", "genomics": "genom", "health": "hlth", "higher": "", "hospital": "hosp", "infectious": "infect",
    "infrastructure": "infrastr", "innovation": "innov", "institute": "inst instit", "international": "intl int'l internat",
    "laboratory": "lab labs laboratories", "marine": "mar", "medical": "med medicine", "memorial": "mem meml", "ministry": "min minist",
    "national": "natl nat'l nat", "natural": "", "neuroscience": "neurosci", "pesquisa": "", "plant": "", "programme": "program prog progr",
    "rare": "", "recherche": "", "research": "res rsrch resrch", "safety": "saf", "science": "sciences sci", "school": "",
    "secondary": "", "society": "soc", "soil": "", "technology": "tech technol technical", "trust": "tr",
    "universitat": "", "universite": "", "university": "univ u universidad", "veterinary": "vet", "water": "wat",
    "alexander": "alex sandy", "benedikt": "ben", "frederick": "fred", "isabella": "bella", "josephine": "josie jo",
    "katharina": "kathy kate", "leopold": "leo", "margareta": "greta maggie", "nathaniel": "", "theodora": "dora",
}
#: Words without weight, also as they are mistyped.
EMPTY = frozenset("a and at d da das de der des die do du el en et for fuer fur in la le los o of on our the to und y".split())
GIVEN = frozenset("alexander benedikt frederick isabella josephine katharina leopold margareta nathaniel theodora".split())

_EXACT = {form: word for word, forms in LEXICON.items() for form in (word, *forms.split())}
_FUZZY = sorted({w for w in _EXACT if len(w) >= 4})
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?|&|\+|\(|\)|,")


class Name(NamedTuple):
    """A name as read.

    proper: what the lexicon doesn't know; bag: lexicon words, sorted; initials: of all words; acronyms; letters: lone initials;
    place_first: a proper word stands before all lexicon words.
    """

    proper: tuple[str, ...]
    bag: tuple[str, ...]
    initials: str
    acronyms: tuple[str, ...]
    letters: tuple[str, ...]
    place_first: bool


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text).lower() if not unicodedata.combining(c))


#: A distance beyond any that is asked for.
FAR = 1 << 40


class Pattern:
    """A string to compare with many others: the Levenshtein distance in bit vectors, a column at a time."""

    def __init__(self, text: str) -> None:
        self.n, self.at = len(text), {}
        for i, c in enumerate(text):
            self.at[c] = self.at.get(c, 0) | (1 << i)

    def distance(self, other: str, most: int = FAR) -> int:
        """Insertions, deletions and substitutions between the two strings; ``FAR`` as soon as they are sure to exceed ``most``."""
        n, left = self.n, len(other) + most
        if not n:
            return len(other)
        every, top, at = (1 << n) - 1, 1 << (n - 1), self.at
        up, down, d = every, 0, n
        for c in other:
            eq = at.get(c, 0)
            x = eq | down
            flat = ((((eq & up) + up) ^ up) | eq) & every
            right_up = (down | ~(flat | up)) & every
            right_down = up & flat
            if right_up & top:
                d += 1
            elif right_down & top:
                d -= 1
            left -= 1
            if d > left:
                return FAR
            right_up = ((right_up << 1) | 1) & every
            up = ((right_down << 1) | ~(x | right_up)) & every
            down = right_up & x
        return d


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words, or ``most + 1`` if more."""
    if a == b:
        return 0
    far = most + 1
    if abs(len(a) - len(b)) > most:
        return far
    # What both begin or end with takes no edits.
    first, last_a, last_b = 0, len(a), len(b)
    least = min(last_a, last_b)
    while first < least and a[first] == b[first]:
        first += 1
    while last_a > first and last_b > first and a[last_a - 1] == b[last_b - 1]:
        last_a -= 1
        last_b -= 1
    a, b = a[first:last_a], b[first:last_b]
    if not a or not b:
        return min(len(a) + len(b), far)
    n = len(b)
    before, row = [far] * (n + 1), [min(j, far) for j in range(n + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(n, i + most)  # farther from the diagonal there are more edits than asked for
        last, before, row = before, row, [far] * (n + 1) if n < 64 else _Sparse(far)
        if i <= most:
            row[0] = i
        least = row[0]
        for j in range(lo, hi + 1):
            y = b[j - 1]
            d = before[j - 1] + (x != y)
            if before[j] < d:
                d = before[j] + 1
            if row[j - 1] < d:
                d = row[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and last[j - 2] < d:
                d = last[j - 2] + 1
            row[j] = d
            if d < least:
                least = d
        if least > most:
            return far
    return min(row[n], far)


class _Sparse(dict):
    """A row of a long comparison, with ``far`` wherever nothing was computed."""

    def __init__(self, far: int) -> None:
        super().__init__()
        self.far = far

    def __missing__(self, key: int) -> int:
        return self.far


#: No lexicon form is as long as this, even mistyped.
LONGEST = 20


def _letters(word: str) -> int:
    """The letters of a word as a set of bits; letters that share a bit only let more words pass."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


@lru_cache(maxsize=None)
def _of_length(n: int, most: int) -> list[tuple[str, int]]:
    """Lexicon forms within ``most`` letters of a length, with their letters."""
    return [(w, _letters(w)) for w in _FUZZY if abs(len(w) - n) <= most]


def _similar(token: str, most: int) -> list[str]:
    """Lexicon forms that can be within ``most`` edits of a token: each letter that only one of two words has takes one."""
    held, n = _letters(token), len(token)
    return [w for w, letters in _of_length(n, most) if (held & ~letters).bit_count() <= most and (letters & ~held).bit_count() <= most] if n <= LONGEST + most else []


@lru_cache(maxsize=200_000)
def lexicon_word(token: str, stopped: bool) -> str | None:
    """The lexicon word that a folded token stands for; ``stopped``: a full stop follows."""
    token = token.replace("’", "'")
    if token in _EXACT:
        return _EXACT[token]
    if stopped and len(token) >= 3:
        longer = {w for w in LEXICON if w.startswith(token)}
        if len(longer) == 1:
            return longer.pop()
    if not 4 <= len(token) <= LONGEST:
        return None
    most = 1 if len(token) < 7 else 2
    near = []
    for w in _similar(token, most):
        limit = 1 if len(w) < 6 else most
        if (d := edits(token, w, limit)) <= limit:
            near.append((d, w))
    if not near:
        return None
    near.sort()
    # Of forms at one distance, one must do: several forms of one word agree, different words do not.
    best = {_EXACT[w] for d, w in near if d == near[0][0]}
    return best.pop() if len(best) == 1 else None


@lru_cache(maxsize=200_000)
def _weightless(token: str) -> bool:
    return token in EMPTY or (len(token) <= 4 and any(len(e) >= 2 and edits(token, e, 1) <= 1 and len(token) >= 2 for e in ("of", "for", "the", "and", "on", "de", "la")))


#: Readings that a worker keeps, of texts up to this length.
KEPT, KEPT_LENGTH = 100_000, 200


def read(text: str, places: frozenset[str] = frozenset(), one_proper: bool = False) -> Name:
    """A typed name, read; ``places``: folded names of countries, dropped where they end the name after a comma;
    ``one_proper``: of several unknown words, all but the least lexicon-like are taken as badly mistyped lexicon words.
    """
    return _kept(text, places, one_proper) if len(text) <= KEPT_LENGTH else _read(text, places, one_proper)


@lru_cache(maxsize=KEPT)
def _kept(text: str, places: frozenset[str], one_proper: bool) -> Name:
    return _read(text, places, one_proper)


def _read(text: str, places: frozenset[str], one_proper: bool) -> Name:
    head, comma, tail = text.rpartition(",")
    if comma and " ".join(fold(tail).replace(".", "").split()) in places:
        text = head
    if "(" in text:
        text = re.sub(r"(\w.*\w\W+)\([A-Z]{2,7}\)\W*$", r"\1", text)  # a name's own acronym after it
    shouted = text.upper() == text and len(text) > 8
    proper, bag, initials, acronyms, letters, place_first = [], [], "", [], [], False
    for raw in _TOKEN.findall(text):
        if raw in "&+(),":
            continue
        stopped, raw = raw.endswith("."), raw.rstrip(".")
        token = fold(raw)
        if not shouted and len(raw) >= 2 and raw.isupper() and (token not in _EXACT or len(raw) < 3):
            if len(raw) <= 7:
                acronyms.append(token)
                continue
        word = lexicon_word(token, stopped)
        if word:
            if token == "nat" and not stopped and re.search(r"(?i)\bmem", text):
                word = "nathaniel"
            bag.append(word)
            initials += word[0]
        elif len(token) == 1 and stopped:
            letters.append(token)
        elif not _weightless(token):
            if len(token) >= 2:
                place_first = place_first or not bag
                proper.append(token)
                initials += token[0]
    if one_proper and len(proper) > 1:
        near = sorted((_nearest(token), token) for token in proper)
        for (share, word), token in near[:-1]:
            if share <= 0.42:
                proper.remove(token)
                bag += [word] if word else []
    if "memorial" in bag and "foundation" in bag:  # "Fnd" or a mistyped "Fund"
        bag[bag.index("foundation")] = "fund"
    return Name(tuple(sorted(proper)), tuple(sorted(bag)), "".join(sorted(initials)), tuple(acronyms), tuple(letters), place_first)


@lru_cache(maxsize=50_000)
def _nearest(token: str) -> tuple[float, str]:
    """The lexicon word nearest to a token ('' for a weightless one), with the share of its letters that differ."""
    if len(token) <= 4:
        near = [(edits(token, w, 1) / 4, word) for w, word in _EXACT.items() if len(w) >= 3 and edits(token, w, 1) <= 1]
        return min(near, default=(0.3, ""))
    pattern = Pattern(token)
    near = [(d / len(token), _EXACT[w]) for w in _similar(token, 4) if pattern.distance(w, 8) <= 8 and (d := edits(token, w, 4)) <= 4]
    return min(near, default=(1.0, ""))


def deletions(word: str, most: int) -> Iterable[str]:
    """The word and what is left of it without up to ``most`` letters; words within ``most`` edits share one."""
    seen = {word}
    layer = {word}
    for _ in range(most):
        layer = {w[:i] + w[i + 1:] for w in layer for i in range(len(w))}
        seen |= layer
    return seen
