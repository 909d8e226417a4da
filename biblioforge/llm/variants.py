"""Variant spellings of names typed by people, attributed through a noisy channel.

Spellings that read alike (the same proper word and the same lexicon words, whatever
their order, abbreviations and typing errors) form a class. Classes are ranked as
candidate canonical forms by how many spellings and occurrences they have; a class is
attached to the candidate with the largest posterior: its frequency as the prior, and as
the likelihood what the channel does to a name - errors in the proper word, words left
out, an acronym in place of the words, a given name cut to its initial. A class that is
itself seen in many spellings is evidence against its being an error.

Candidates are found through the letters that are left when up to two are deleted from
the proper word, never by comparing all classes. Names of lexicon words alone are linked by
all their words, their acronym, or all words and an initial; names in which nothing can be
read (digits, lone letters) by their whole folded text.

Defined results: a NULL or blank name is linked to nothing;
equal names under several ids are linked; ties go to the smaller id; very long names are
read whole; an empty table gives no pairs; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioforge.llm import names
from biblioforge.llm.components import connected_components
from biblioforge.operators.skew import join_unique
from biblioforge.session import cut

#: Log-likelihoods of the channel: an edit of the proper word, a word left out, an acronym, an initial; and the least to accept.
EDIT, DROPPED, ACRONYM, INITIAL, LEAST = -2.5, -1.0, -0.5, -0.5, -8.0
#: Longer proper words are compared as they are.
LONGEST = 40
#: Up to so many spellings of a candidate each spelling of the other class counts in full against its being an error.
FEW = 4
#: What the place of a name begins with in which nothing can be read.
UNREAD = "="
#: Pairs of one group are made in blocks of about so many members.
BLOCK = 500


def read_spellings(spellings: DataFrame, places: frozenset[str]) -> DataFrame:
    """(id, n, place, bag, acronym, letters, place_first) of (id, name, n)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, name, n in zip(batch["id"], batch["name"], batch["n"]):
                if not (name or "").strip():
                    continue
                r = names.read(name, places, one_proper=True)
                if not (r.proper or r.bag or r.acronyms):
                    rows.append((key, n, f"{UNREAD} {' '.join(names.fold(name).split())}", "", "", "", False))
                else:
                    acronym = "".join(sorted(r.acronyms[0])) if r.acronyms and len(r.bag) < 2 else ""
                    rows.append((key, n, " ".join(r.proper), " ".join(r.bag), acronym, "".join(sorted(r.letters)), r.place_first))
            yield pd.DataFrame(rows, columns=["id", "n", "place", "bag", "acronym", "letters", "place_first"])

    schema = "id long, n long, place string, bag string, acronym string, letters string, place_first boolean"
    return spellings.select("id", "name", "n").mapInPandas(read, schema)


def near_places(places: DataFrame) -> DataFrame:
    """(place, near, d) of distinct proper words at most two edits apart (one for short ones), each with itself at 0."""

    def letters_left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, k) for p in batch["place"] for k in names.deletions(p, _most(p))]
            yield pd.DataFrame(rows, columns=["place", "left"])

    def distance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = [names.edits(p, q, 2) for p, q in zip(batch["place"], batch["near"])]
            batch = batch.assign(d=pd.array(d, dtype="int32"))
            yield batch[[x <= min(_most(p), _most(q)) for x, p, q in zip(d, batch["place"], batch["near"])]]

    # Few bytes but much work: spread evenly.
    left = places.repartition(places.sparkSession.sparkContext.defaultParallelism).mapInPandas(letters_left, "place string, left string")
    pairs = left.join(left.withColumnRenamed("place", "near"), "left").select("place", "near").distinct()
    return pairs.mapInPandas(distance, "place string, near string, d int")


def _most(place: str) -> int:
    return 0 if not 4 <= len(place) <= LONGEST or place.startswith(UNREAD) else 1 if len(place) < 7 else 2


def likelihood(v: tuple, c: tuple, d: int) -> float | None:
    """Log-likelihood that class ``v`` is a typed form of class ``c``, or None. Each: bag, acronym, letters, place_first, spellings."""
    v_bag, v_acronym, v_letters, v_first, v_n = v
    c_bag, c_acronym, c_letters, _, c_n, c_place = c
    if c_acronym:
        return None
    weight = max(1.0, v_n * min(1.0, FEW / c_n))
    score = EDIT * d * weight
    have, want = v_bag.split(), c_bag.split()
    missing = list(want)
    for word in have:
        if word not in missing:
            return None
        missing.remove(word)
    if not missing and not v_acronym:
        return score if not v_letters or v_letters == c_letters else None
    if v_acronym:
        initials = "".join(sorted(w[0] for w in want))
        whole = "".join(sorted(initials + c_place[:1]))
        return score + ACRONYM if v_acronym in (initials, whole) and len(want) > 1 else None
    given = [w for w in missing if w in names.GIVEN]
    if given and len(missing) == 1:
        if not v_letters:
            return None
        return score + INITIAL if v_letters == given[0][0] else None
    if len(have) == 1 and v_first and weight <= 2:
        return score + DROPPED * len(missing)
    return None


def _asked() -> Column:
    """What a class is looked up by besides its proper word: its acronym, or the longest word of its bag (blank without any); without a proper word all of its bag."""
    words = F.array_sort(F.transform(F.split("bag", " "), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.when(F.col("acronym") != "", F.concat(F.lit("#"), "acronym")).when(F.col("place") == "", F.col("bag")).otherwise(words[0]["w"])


def _held() -> Column:
    """What a class is found by as a candidate: each word of its bag, its initials with and without the proper word's, blank for up to one word.

    Without a proper word: all words of its bag, all but each one, and its initials.
    """
    words = F.filter(F.split("bag", " "), lambda w: w != "")
    letters = F.transform(words, lambda w: F.substring(w, 1, 1))
    initials = [F.concat(F.lit("#"), F.array_join(F.array_sort(x), "")) for x in (letters, F.concat(letters, F.array(F.substring("place", 1, 1))))]
    without = F.transform(words, lambda _, i: F.array_join(F.filter(words, lambda _, j: i != j), " "))
    bags = F.filter(F.concat(F.array("bag"), without), lambda w: w != "")
    placed = F.array_distinct(F.concat(words, F.array(*initials), F.when(F.size(words) <= 1, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))))
    return F.when(F.col("place") == "", F.array_distinct(F.concat(bags, F.array(initials[0])))).otherwise(placed)


def attach(classes: DataFrame, near: DataFrame) -> DataFrame:
    """(id, canonical): the candidate of the largest posterior for each class that has an acceptable one."""
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("id", "place", "bag", "acronym", "letters", "place_first", "spellings", "n")]
    asked = classes.select(*side("v"), _asked().alias("key")).join(near, F.col("v_place") == F.col("place"))
    held = classes.where("acronym = ''").select(*side("c"), F.explode(_held()).alias("key"))
    pairs = asked.join(held, (F.col("near") == F.col("c_place")) & (asked["key"] == held["key"])).where("v_id <> c_id").drop("key")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                found = likelihood(
                    (r.v_bag, r.v_acronym, r.v_letters, r.v_place_first, r.v_spellings),
                    (r.c_bag, r.c_acronym, r.c_letters, r.c_place_first, r.c_spellings, r.c_place), r.d)
                if found is None or found < LEAST:
                    continue
                same = r.v_bag == r.c_bag and not r.v_acronym
                if same and (r.c_spellings, r.c_n, -r.c_id) <= (r.v_spellings, r.v_n, -r.v_id):
                    continue
                rows.append((r.v_id, r.c_id, found + math.log(r.c_n + 1.0)))
            yield pd.DataFrame(rows, columns=["id", "canonical", "posterior"])

    scored = pairs.mapInPandas(score, "id long, canonical long, posterior double")
    best = scored.groupBy("id").agg(F.max(F.struct("posterior", (-F.col("canonical")).alias("negative"))).alias("best"))
    return best.select("id", (-F.col("best.negative")).alias("canonical"))


def link_variants(spellings: DataFrame, places: frozenset[str] = frozenset()) -> DataFrame:
    """(id, canonical): each spelling with the smallest id of its entity. ``spellings``: id, name, n (occurrences)."""
    read = cut(read_spellings(spellings, places))
    key = ["place", "bag", "acronym", "letters"]
    classes = cut(read.groupBy(*key).agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n"), F.min("place_first").alias("place_first")))
    near = near_places(classes.select("place").distinct())
    links = cut(attach(classes, near))
    roots = connected_components(links, "id", "canonical")
    named = classes.join(roots, classes.id == roots.vertex, "left").select(*key, F.coalesce("root", "id").alias("canonical"))
    return join_unique(read, named, key).select("id", "canonical")


def pairs_of(members: DataFrame) -> DataFrame:
    """(a, b) with a < b of the members (id, canonical) of each group, made in blocks, so that no task has a large group alone."""
    blocks = members.groupBy("canonical").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sized = join_unique(members, blocks, ["canonical"])
    left = sized.select("canonical", F.col("id").alias("a"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    right = sized.select("canonical", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return left.join(right, ["canonical", "block"]).where("a < b").select("a", "b")
