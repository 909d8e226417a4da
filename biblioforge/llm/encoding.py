"""Text garbled by a wrong character encoding: detection and repair by minimum description length.

A candidate undoes a chain of wrong decodings: UTF-8 read as a one-byte code page, one
code page read as another, character references left in place, one on top of the other.
Only the stretches that a step can explain are changed, so text garbled in places is
repaired in place. Every candidate is compressed with the zstandard dictionary of each
language; the candidate with the shortest description, the chain's own cost and the cost
of characters that do not occur in good text included, is taken, and if that is the text
itself it stays as it is.

Defined results: NULL, empty and plain ASCII values are never affected; a value with
characters that are lost for good (the replacement character, control characters, a
broken rest of a sequence) is found, with what can be restored restored; correct accented,
Greek or foreign text stays; texts of any length are read whole; a value that occurs
often is treated alike each time; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code pages as which UTF-8 is mistaken, and those mistaken for the Western one; with their cost in bits.
CODE_PAGES = ("cp1252", "latin_1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859_15", "cp1254", "koi8_r")
SWAPPED = ("mac_roman", "cp437", "cp850")
STEP_BITS, SWAP_BITS = 6.0, 12.0
#: Bits of a note that something was lost for good.
LOST_BITS = 18.0
#: The size of a dictionary, and the share of all words of a language from which a word can stand in it (at most 1 / share words).
DICTIONARY_BYTES, WORD_SHARE = 16_384, 2e-5
#: The most languages that a dictionary each makes sense for.
LANGUAGES = 64
#: Share of the documents of a language (and least number) that a usual character stands in; counted over all documents.
USUAL_SHARE, USUAL_DOCS = 0.003, 3
#: Bits of a character by how usual it is in good text: seen, a letter of a Latin alphabet, Greek, anything else.
LATIN_BITS, GREEK_BITS, ODD_BITS, BROKEN_BITS = 3.0, 6.0, 24.0, 40.0


@lru_cache(maxsize=None)
def _page(codec: str) -> dict[str, int]:
    """The character of each high byte; bytes without one stand for the control character of their number."""
    page = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        page.setdefault(c, b)
    return page


@lru_cache(maxsize=None)
def _sequences(codec: str) -> re.Pattern[str]:
    """UTF-8 sequences as they look when read as ``codec``."""
    def of(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in _page(codec).items() if low <= b <= high) + "]"

    rest = of(0x80, 0xBF)
    return re.compile(f"(?:{of(0xC2, 0xDF)}{rest}|{of(0xE0, 0xEF)}{rest}{rest}|{of(0xF0, 0xF4)}{rest}{rest}{rest})+")


@lru_cache(maxsize=None)
def _marks(codec: str) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """Characters that a sequence of ``_sequences`` begins with, those that end it, and those that ``_swapped`` can change."""
    page = _page(codec)
    first, rest = (frozenset(c for c, b in page.items() if low <= b <= high) for low, high in ((0xC2, 0xF4), (0x80, 0xBF)))
    moved = frozenset(
        c for c, b in page.items()
        if c not in _WITHIN and (c.isupper() or unicodedata.category(c) not in ("Ll", "Lu", "Lo")) and bytes([b]).decode("cp1252", "ignore").isalpha()
    )
    return first, rest, moved


@lru_cache(maxsize=20_000)
def _steps(held: frozenset[str]) -> tuple[list[tuple[str, float]], list[str]]:
    """Code pages with their bits as which UTF-8 may have been mistaken, and those mistaken for the Western one, of a text that holds these characters beyond ASCII; others change nothing."""
    marks = {c: _marks(c) for c in (*CODE_PAGES, *SWAPPED)}
    mistaken = [(c, STEP_BITS + 0.5 * i) for i, c in enumerate(CODE_PAGES) if not held.isdisjoint(marks[c][0]) and not held.isdisjoint(marks[c][1])]
    return mistaken, [c for c in SWAPPED if not held.isdisjoint(marks[c][2])]


def _held(text: str) -> frozenset[str]:
    return frozenset(c for c in set(text) if c > "\x7f")


def _as_utf8(text: str, codec: str) -> str:
    page = _page(codec)

    def undo(m: re.Match[str]) -> str:
        try:
            return bytes(page[c] for c in m[0]).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            return m[0]

    return _sequences(codec).sub(undo, text)


def _swapped(text: str, codec: str) -> str:
    """Characters of ``codec`` inside or before a word's letters, read as the Western code page."""
    page = _page(codec)

    def undo(m: re.Match[str]) -> str:
        c = m[0]
        inside = m.start() > 0 and text[m.start() - 1].isalpha()
        if c not in page or c in _WITHIN or (not inside and c in _BEFORE) or (not text[m.end():m.end() + 1].isalpha() and c in _AFTER):
            return c
        if unicodedata.category(c) in ("Ll", "Lu", "Lo") and not (inside and c.isupper() and text[m.start() - 1].islower()):
            return c  # a letter in its place
        try:
            new = bytes([page[c]]).decode("cp1252")
        except UnicodeDecodeError:
            return c
        return new if new.isalpha() else c

    return re.sub(r"[^\x00-\x7f](?=[^\W\d_])|(?<=[^\W\d_])[^\x00-\x7f]", undo, text)


#: Symbols that good text has inside words, those it has right before a word, and those right after one.
_WITHIN, _BEFORE, _AFTER = "’‘–—‐‑­​", "“‘’«„…°±µ×–—€£§≥≤√™©®‰†‡•¶¿¡", "”’»“…°™©®‰†‡"


def _rests() -> tuple[re.Pattern[str], frozenset[str]]:
    """What a lost character leaves: the replacement character, control characters, a UTF-8 sequence without its end (or its middle);
    and characters of which every such rest holds one."""
    first = "".join(c for c, b in _page("cp1252").items() if 0xC2 <= b <= 0xF4 and c.isalpha())
    good = set(_WITHIN + _BEFORE + _AFTER)
    ending = [c for page in ("cp1252", "latin_1") for c, b in _page(page).items() if b <= 0xBF and c not in good and not c.isalpha()]
    later = "".join(map(re.escape, ending))
    rests = re.compile(
        f"[\ufffd\x80-\x84\x86-\x9f]+|[{first}][{later}]+|[ÃÂâ]€|(?<=[0-9])[ÃÂâ](?![^\\W\\d_])|(?<!\\w)â(?![\\w-])|(?<!\\w)â(?=[A-Z])"
        "|(?<=[a-z0-9])â(?=(?:t|s|re|ve|ll)\\b)|ÃÃ|Ã(?=[B-DF-HJ-NP-RTV-Z])")
    return rests, frozenset(ending) | set("\ufffdÃÂâ") | {chr(i) for i in range(0x80, 0xA0)}


_RESTS, _LEFT = _rests()


def _unescaped(text: str) -> str:
    return re.sub(r"&(?:[A-Za-z]{2,8}|#\d{2,6}|#x[0-9A-Fa-f]{2,5});", lambda m: u if (u := html.unescape(m[0])) not in "<>&\"" and ord(u[0]) > 127 else m[0], text)


def candidates(text: str, bits_of: Callable[[str], float]) -> dict[str, float]:
    """Every text that undoing a chain of wrong decodings gives, with the least bits of its chain; chains that alone take as many bits as the text are none."""
    found, layer, most = {text: 0.0}, [text], math.inf
    while layer:
        fresh = []
        for t in layer:
            mistaken, swapped = _steps(_held(t))
            steps = [(_as_utf8(t, c), bits) for c, bits in mistaken]
            if "&" in t:
                steps.append((_unescaped(t), STEP_BITS))
            if t == text:
                steps += [(_swapped(t, c), SWAP_BITS) for c in swapped]
            for new, bits in steps:
                if new != t and found[t] + bits < found.get(new, most):
                    fresh += [new] if new not in found else []
                    found[new] = found[t] + bits
        if fresh and most == math.inf:
            most = bits_of(text)
        layer = fresh
    return found


class Model:
    """Dictionaries and usual characters of good text by language."""

    def __init__(self, dictionaries: dict[str, bytes], usual: frozenset[str]) -> None:
        self.dictionaries, self.usual, self._made = dictionaries, usual, None

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "usual": self.usual, "_made": None}

    def _compressors(self) -> list:
        if self._made is None:
            import zstandard as z

            made = [z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_AUTO) for d in self.dictionaries.values()]
            self._made = [z.ZstdCompressor(level=6, dict_data=d, write_content_size=False) for d in made] or [z.ZstdCompressor(level=6)]
        return self._made

    def bits(self, text: str) -> float:
        """Bits of the shortest description of a text."""
        raw = text.encode("utf-8", "surrogatepass")
        shortest = min(len(c.compress(raw)) for c in self._compressors())
        rests = sum(m.end() - m.start() for m in _RESTS.finditer(text))  # where good text has no such characters
        return 8.0 * shortest + ODD_BITS * rests + sum(self._character(text, i) for i, c in enumerate(text) if c > "\x7f")

    def _character(self, text: str, i: int) -> float:
        c = text[i]
        if c == "�" or unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs"):
            return BROKEN_BITS
        before, after = text[i - 1:i], text[i + 1:i + 2]
        if c.isalpha():
            if c.isupper() and before.islower():
                return ODD_BITS  # a capital inside a word
            if c in self.usual:
                return 1.0
            return LATIN_BITS if "À" <= c <= "ž" else GREEK_BITS if "Α" <= c <= "ω" else ODD_BITS
        if before.isalpha() and after.isalpha() and c not in _WITHIN:
            return ODD_BITS  # a symbol inside a word
        if c in self.usual:
            return 2.0
        return ODD_BITS


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of good text: dictionaries and usual characters of each language, both counted over all of ``docs``."""
    every = docs.select(F.lower(F.substring(lang, 1, 2)).alias("lang"), F.col(text).alias("text")).where("lang is not null")
    # Words with the blanks after them.
    words = every.select("lang", F.explode(F.split("text", "(?<=\\s)(?=\\S)")).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    # The words of each language in all stand beside them, so that one shuffle does for both; a condition on the word alone would be pushed below it.
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    beside = F.broadcast(totals.agg(F.map_from_entries(F.collect_list(F.struct("lang", "total"))).alias("totals")))
    enough = F.when((F.size("totals") <= LANGUAGES) & (F.col("n") >= WORD_SHARE * F.col("totals")[F.col("lang")]), F.length("word"))
    frequent = words.where("n >= 2").crossJoin(beside).where(enough.between(3, DICTIONARY_BYTES))
    counted: dict[str, list[tuple[str, int]]] = {}
    languages = 0
    for name, word, n in frequent.select("lang", "word", "n").unionByName(totals.select("lang", F.lit(None).cast("string").alias("word"), F.col("total").alias("n"))).collect():
        if word is None:
            languages += 1
        else:
            counted.setdefault(name, []).append((word, n))
    if languages > LANGUAGES:
        raise ValueError("more languages than a dictionary each makes sense for")
    dictionaries = {name: _dictionary(found) for name, found in sorted(counted.items())}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[tuple[str, str]] = Counter()  # as many as there are characters, for each language
        for batch in batches:
            for name, value in zip(batch["lang"], batch["text"]):
                seen.update([(name, ""), *((name, c) for c in set(value or "") if c > "\x7f")])
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["lang", "c", "n"])

    seen = every.mapInPandas(count, "lang string, c string, n long").groupBy("lang", "c").agg(F.sum("n").alias("n"))
    rows = [tuple(r) for r in seen.where((F.col("n") >= USUAL_DOCS) | (F.col("c") == "")).collect()]
    sizes = {name: n for name, c, n in rows if not c}
    return Model(dictionaries, frozenset(c for name, c, n in rows if c and n >= max(USUAL_DOCS, USUAL_SHARE * sizes[name])))


def _dictionary(counted: list[tuple[str, int]]) -> bytes:
    """The words that save the most bytes, as many as a dictionary holds; the best stand last, where they are the cheapest to refer to."""
    size, taken = 0, []
    for word, _ in sorted(counted, key=lambda x: (-x[1] * (len(x[0]) - 2), x[0])):
        raw = word.encode("utf-8", "ignore")
        if size + len(raw) <= DICTIONARY_BYTES:
            taken.append(raw)
            size += len(raw)
    return b"".join(reversed(taken))


def repair(text: str | None, model: Model) -> tuple[bool, str | None]:
    """(affected, restored text)."""
    if not text or (text.isascii() and "&" not in text):
        return False, text
    bits = cache(model.bits)
    found, best = candidates(text, bits), text
    if len(found) > 1:
        best = min(found, key=lambda t: (found[t] + bits(t), found[t], t))
    if best != text:
        return True, best
    if _LEFT.isdisjoint(text):
        return False, text
    # Nothing can be restored; something was lost if the text is shorter to describe without its rest.
    without = _RESTS.sub("", text)
    return without != text and bits(without) + LOST_BITS < bits(text), text


def repair_fields(values: DataFrame, model: Model) -> DataFrame:
    """``values`` (key columns and value) that are affected, with ``restored``. Only suspicious values leave the JVM."""
    suspicious = values.where(F.col("value").rlike("[^\\x00-\\x7F]|&[A-Za-z#]"))
    schema = ", ".join(f"`{n}` {t}" for n, t in suspicious.dtypes) + ", restored string"

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fixed = [repair(v, model) for v in batch["value"]]
            batch = batch.assign(restored=[r for _, r in fixed])
            yield batch[[a for a, _ in fixed]]

    return suspicious.mapInPandas(fix, schema)
