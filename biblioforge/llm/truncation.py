"""Text cut off before its end: a backward character n-gram model of where texts end.

The contexts of the model are the last one to 32 characters before a position. Numbers,
addresses and words that are neither usual in the corpus nor begin a usual word stand in
them as one sign each. One more context is the line so far, with each word after the first
as one sign, which knows headings, lists and keyword lines. All positions of all different
texts are counted: how often a context ends a text and how often the text goes on. A
text's final contexts are scored from the shortest to the longest, each correcting the
share of ends that the shorter one expects (if it stands in fewer places), and the log-odds of ending against going on
are compared with a threshold for the text's language (and for the column the model was
trained on): a text has to be as likely to end as texts of that language are at a full
stop.

Only contexts with which some text ends are of use. A bitmap of their hashes is broadcast,
and as a context can only be among them if the shorter ones are, most positions are done
with after a few characters.

Defined results: NULL, empty and blank texts are no cases; trailing blanks do not count;
a mark left at the cut (dots in brackets, three dots, an ellipsis, a broken character) is
no part of the text before it; an unknown language is treated as one of its own; texts of
any length are read whole; equal texts are scored alike, and a document delivered with two
texts is a case if one of them is; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioforge.operators.skew import join_unique
from biblioforge.session import cut, keep

#: Lengths of the contexts, the share of texts a usual word stands in, and the occurrences that make a line's context count.
LENGTHS, USUAL_SHARE, SEEN = (*range(1, 13), 14, 16, 20, 24, 32), 0.0008, 3
#: Texts that a language needs for a threshold of its own; log-odds below its threshold at which a full stop ends no text ("et al.").
ENOUGH, NO_STOP = 30, -10.0
#: The share of ends expected of an unseen context, and the occurrences that an expectation weighs as much as.
FIRST_SHARE, WEIGHT = 0.005, 8.0
#: How much likelier (in nats) than a full stop an ending without one has to be.
MARGIN = 0.8
#: Characters looked at in one go, and counts of words kept in one go.
PIECE, FLUSH = 500_000, 400_000
#: Bits of the bitmap for each different text, and its largest size (32 MB).
BITS_A_TEXT, MOST_BITS, CHUNK = 512, 28, 15

_WORD = re.compile(r"https?://\S*[^\s.,;:)\]。]|[^\W\d_㐀-鿿]+(?:['’-][^\W\d_㐀-鿿]+)*|\d+(?:[.,]\d+)*")
_LATER_WORD = re.compile(r"(?<=[^\w\n])(?:[^\W\d_㐀-鿿]+(?:['’-][^\W\d_㐀-鿿]+)*|#)")
_MARK = re.compile(r"(?i)\s*(?:[\[(<]\s?(?:\.{3}|…|truncated|continued|cut|more)\s?[\])>]|\.{3,}|…|�+)\s*$")
_STOP = re.compile(r"[.。!?]['\"”’»)\]]*$")


def body(text: str) -> tuple[str, bool]:
    """The text without trailing blanks and a mark left at a cut, and whether there was one."""
    bare = _MARK.sub("", text)
    return bare.rstrip(), len(bare) < len(text.rstrip())


def usual_words(docs: DataFrame) -> frozenset[str]:
    """Words in more than a small share of the texts: at most (words in a text / share) of them, whatever the corpus."""

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()

        def flush() -> pd.DataFrame:
            found = pd.DataFrame(list(n.items()), columns=["word", "n"])
            n.clear()
            return found

        for batch in batches:
            for text in batch["text"]:
                n.update({w for w in _WORD.findall(text) if w[0].isalpha() and "://" not in w})
                if len(n) > FLUSH:
                    yield flush()
        yield flush()

    least = max(4, docs.count() * USUAL_SHARE)
    words = docs.select("text").mapInPandas(distinct, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(r["word"] for r in words.where(F.col("n") >= least).collect())


def masked(text: str, spelled: frozenset[str]) -> str:
    """A text as it stands in contexts: numbers, addresses and words that are not ``spelled`` as one sign each."""

    def sign(m: re.Match[str]) -> str:
        word = m[0]
        return word if word in spelled else "0" if word[0].isdigit() else "@" if "://" in word else "#"

    return _WORD.sub(sign, text)


# Contexts as hashes

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_START, _NEWLINE = 2, 10


def _mixed(hashes: np.ndarray, kind: int) -> np.ndarray:
    x = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(kind * 0x94D049BB133111EB % (1 << 64))
    return x ^ (x >> np.uint64(32))


class Stream:
    """The characters of several texts, each behind as many start signs as the longest context has, with hashes of any stretch of them."""

    def __init__(self, texts: list[str], pad: int) -> None:
        sign = chr(_START) * pad
        whole = sign + sign.join(t.replace(chr(_START), " ") for t in texts)
        self.chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.last = np.cumsum(np.array([len(t) + pad for t in texts], dtype=np.int64)) - 1
        powers = np.full(len(self.chars), _BASE, np.uint64)
        powers[:1] = 1
        self.powers = np.cumprod(powers)
        inverse = np.full(len(self.chars), _INVERSE, np.uint64)
        inverse[:1] = 1
        values = (self.chars.astype(np.uint64) + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.cumprod(inverse))])

    def hashes(self, begin: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
        """Of the characters from ``begin`` to ``end``, both included."""
        return _mixed((self.sums[end + 1] - self.sums[begin]) * self.powers[end], kind)

    def going_on(self) -> np.ndarray:
        """Positions that are no start sign and do not end a text."""
        here = self.chars != _START
        here[self.last] = False
        return np.flatnonzero(here)

    def line_starts(self) -> np.ndarray:
        """Where the line of each position begins, with the sign before it."""
        edge = (self.chars == _NEWLINE) | (self.chars == _START)
        return np.maximum.accumulate(np.where(edge, np.arange(len(self.chars)), 0))


def _groups(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of texts that are looked at together."""
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        size += len(t) + LENGTHS[-1]
        if size > PIECE:
            yield group
            group, size = [], 0
    if group:
        yield group


def _shape(text: str) -> str:
    return _LATER_WORD.sub("w", text)


def final_contexts(texts: list[str]) -> np.ndarray:
    """The hashes of each text's final contexts, shortest first, and of its last line (0 where a text has one line only)."""
    tails = [t[-LENGTHS[-1]:] for t in texts]
    lines = [t[t.rfind("\n"):] if "\n" in t else "" for t in texts]
    stream = Stream([chr(_START) * (LENGTHS[-1] - len(t)) + t for t in tails], LENGTHS[-1])
    stream.chars.setflags(write=False)
    found = [stream.hashes(stream.last - k + 1, stream.last, k) for k in LENGTHS]
    shaped = Stream([_shape(x) for x in lines], 1)
    line = shaped.hashes(shaped.line_starts()[shaped.last], shaped.last, 1000)
    found.append(np.where(np.array([bool(x.strip()) for x in lines], dtype=bool), line, np.uint64(0)))
    return np.stack(found, axis=1).view(np.int64)


def going_on(texts: list[str], bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of contexts in ``bitmap`` after which a text goes on, and how often; ``texts`` are looked at together."""
    bits = np.uint64(len(bitmap) * 8 - 1)

    def known(hashes: np.ndarray) -> np.ndarray:
        at = hashes & bits
        return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    stream = Stream(texts, LENGTHS[-1])
    at, found = stream.going_on(), []
    for k in LENGTHS:
        hashes = stream.hashes(at - k + 1, at, k)
        hit = known(hashes)
        at, hashes = at[hit], hashes[hit]
        found.append(hashes)
    shaped = Stream([_shape(t) for t in texts], 1)
    at = shaped.going_on()
    at = at[shaped.chars[at] != _NEWLINE]
    start = shaped.line_starts()[at]
    at, start = at[shaped.chars[start] == _NEWLINE], start[shaped.chars[start] == _NEWLINE]
    hashes = shaped.hashes(start, at, 1000)
    found.append(hashes[known(hashes)])
    values, counts = np.unique(np.concatenate(found), return_counts=True)
    return values.view(np.int64), counts


def pieces(text: str) -> list[str]:
    """A very long text in pieces that can be looked at by themselves: cut behind line ends, or else by force."""
    if len(text) <= PIECE:
        return [text]
    found, lo = [], 0
    while lo < len(text):
        hi = min(len(text), lo + PIECE)
        end = text.rfind("\n", lo + PIECE // 2, hi)
        hi = end if end > lo and hi < len(text) else hi
        found.append(text[lo:hi])
        lo = hi
    return found


# The model


def read_texts(docs: DataFrame, spelled: frozenset[str]) -> DataFrame:
    """(number, h1, h2, lang, marked, stopped, stream) of the different texts; ``docs``: h1, h2 (two hashes of the text), lang, text."""
    sent = docs.sparkSession.sparkContext.broadcast(spelled)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = [body(t) for t in batch["text"]]
            yield batch[["h1", "h2", "lang"]].assign(
                marked=[m for _, m in bodies], stopped=[not m and bool(_STOP.search(b)) for b, m in bodies], stream=[masked(b, sent.value) for b, _ in bodies])

    different = docs.groupBy("h1", "h2").agg(F.min("lang").alias("lang"), F.min("text").alias("text"))
    found = different.mapInPandas(read, "h1 long, h2 long, lang string, marked boolean, stopped boolean, stream string")
    return keep(found.select(F.monotonically_increasing_id().alias("number"), "*"))


def context_bitmap(finals: DataFrame, texts: int) -> np.ndarray:
    """The bitmap of the hashes of all final contexts; its size is bounded, with more of them it lets more others pass."""
    size = min(MOST_BITS, max(CHUNK + 1, int(texts * BITS_A_TEXT).bit_length()))
    bits = finals.select(F.explode("contexts").alias("c")).select(F.col("c").bitwiseAND(F.lit((1 << size) - 1)).alias("bit")).distinct()

    def chunk(rows: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(1 << CHUNK, np.uint8)
        part[rows["bit"].to_numpy() & ((1 << CHUNK) - 1)] = 1
        return pd.DataFrame({"chunk": [int(rows["bit"].iloc[0]) >> CHUNK], "part": [np.packbits(part, bitorder="little").tobytes()]})

    made = bits.groupBy(F.shiftright("bit", CHUNK)).applyInPandas(chunk, "chunk long, part binary").collect()
    bitmap = np.zeros(1 << (size - 3), np.uint8)
    for r in made:
        at = r["chunk"] << (CHUNK - 3)
        bitmap[at:at + (1 << (CHUNK - 3))] = np.frombuffer(bytes(r["part"]), np.uint8)
    return bitmap


def score_endings(texts: DataFrame) -> DataFrame:
    """(number, log_odds) of ``read_texts``."""

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch[["number"]].assign(contexts=list(final_contexts(list(batch["stream"]))))

    finals = cut(texts.select("number", "stream").mapInPandas(final, "number long, contexts array<long>"))
    bitmap = context_bitmap(finals, finals.count())
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [p for t in batch["stream"] for p in pieces(t)]
            found = [going_on([parts[i] for i in group], sent.value) for group in _groups(parts)]
            if found:
                values, at = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([c for _, c in found]), minlength=len(values)).astype(np.int64)
                yield pd.DataFrame({"context": values, "ends": np.zeros(len(values), np.int64), "goes_on": n})

    places = finals.select("number", F.posexplode("contexts").alias("rank", "context")).where("context <> 0")
    ends = places.groupBy("context").agg(F.count(F.lit(1)).alias("ends")).withColumn("goes_on", F.lit(0).cast("long"))
    counts = texts.select("stream").mapInPandas(count, "context long, ends long, goes_on long").unionByName(ends)
    # Contexts that passed the bitmap by chance end no text.
    counts = counts.groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on")).where("ends > 0")
    known = join_unique(places, cut(counts), ["context"])
    # Without the text itself.
    step = F.struct("rank", (F.col("ends") - 1).alias("ends"), "goes_on")
    lists = known.groupBy("number").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    in_text = F.filter("steps", lambda s: s["rank"] < len(LENGTHS))
    # A longer context that stands in just the places of the shorter one tells nothing more.
    state = lambda p, e, g: F.struct(p.alias("p"), e.cast("long").alias("e"), g.cast("long").alias("g"))
    again = lambda a, s: (a["e"] == s["ends"]) & (a["g"] == s["goes_on"])
    share = F.aggregate(in_text, state(F.lit(FIRST_SHARE), F.lit(-1), F.lit(-1)), lambda a, s: F.when(again(a, s), a).otherwise(
        state((s["ends"] + WEIGHT * a["p"]) / (s["ends"] + s["goes_on"] + WEIGHT), s["ends"], s["goes_on"])), lambda a: a["p"])
    line = F.filter("steps", lambda s: (s["rank"] == len(LENGTHS)) & (s["ends"] + s["goes_on"] >= SEEN))
    line_share = F.when(F.size(line) > 0, (line[0]["ends"] + 0.1) / (line[0]["ends"] + line[0]["goes_on"] + 0.6)).otherwise(F.lit(0.0))
    best = F.least(F.greatest(share, line_share), F.lit(1 - 1e-12))
    return lists.select("number", F.log(best / (1 - best)).alias("log_odds"))


def truncated(docs: DataFrame) -> DataFrame:
    """(doc_id, log_odds, threshold) of the texts that were cut. ``docs``: doc_id, lang, text."""
    docs = docs.select("doc_id", F.coalesce(F.lower("lang"), F.lit("")).alias("lang"), "text").where(F.col("text").rlike(r"\S"))
    docs = docs.select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    usual = usual_words(docs)
    texts = read_texts(docs, usual | frozenset(w[:i] for w in usual for i in range(1, len(w))))
    scored = cut(texts.drop("stream").join(score_endings(texts), "number").drop("number"))
    stops = scored.where("stopped").groupBy("lang").agg(F.percentile_approx("log_odds", 0.5, 1000).alias("middle"), F.count(F.lit(1)).alias("n"))
    overall = scored.where("stopped").agg(F.percentile_approx("log_odds", 0.5, 1000)).first()[0]
    default = F.lit(overall if overall is not None else -2.5)
    own = stops.where(F.col("n") >= ENOUGH).select("lang", F.least("middle", default).alias("own"))
    judged = join_unique(scored, own, ["lang"], "left").withColumn("threshold", F.coalesce("own", default))
    is_cut = F.col("log_odds") < F.col("threshold") + F.when(F.col("stopped"), F.lit(NO_STOP)).otherwise(F.lit(MARGIN))
    return join_unique(docs.select("doc_id", "h1", "h2"), judged.where(is_cut).select("h1", "h2", "log_odds", "threshold"), ["h1", "h2"]).drop("h1", "h2")
