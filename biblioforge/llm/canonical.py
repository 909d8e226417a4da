"""Mapping free-entered values to a canonical list with a BK-tree.

The entries' forms stand in a BK-tree under the Levenshtein distance, a true metric, so
that the triangle inequality prunes the search and every form within the threshold is
returned. The values of a batch go down the tree together, node by node, so that the
distances of a node are computed for all of them at once. The tree is broadcast; a list too long for one tree is cut into shards by the
hash of its forms, each searched with all values, and the winners of the shards are merged
as if all forms stood in one tree. Only distinct values are searched.

Defined results: a NULL or blank value has no row; a value without an entry within its
threshold comes out with the code ``none``; of entries spelled alike the one of the
smallest code wins, while a mistyped value as near to two entries is matched with neither; repeated entries
do no harm; an empty list maps everything to ``none``; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioforge.llm.names import Pattern, edits
from biblioforge.session import cut

#: Forms in one tree, the pieces a shard's values are searched in, and the code of unmatched values.
SHARD_FORMS, PIECES, NONE = 50_000, 16, "none"
#: Forms that begin with this are codes and acronyms, which match as they are or not at all.
EXACT = "="
#: Readings whose results a worker keeps, as departments and cities come again and again.
KNOWN = 200_000
#: Letters of a form whose distances are computed for many strings at once (longer forms have a tree of their own), strings that
#: go down a tree together, and strings so few that each goes on alone.
WORD, TOGETHER, FEW = 64, 16_384, 16


def levenshtein(a: str, b: str) -> int:
    """Insertions, deletions and substitutions between two strings."""
    return Pattern(a).distance(b)


class Tree:
    """A BK-tree over the forms of entries; forms beyond ``WORD`` letters stand in a second one."""

    def __init__(self, forms: Iterable[tuple[str, str]]) -> None:
        self.codes: dict[str, set[str]] = {}
        for form, code in forms:
            self.codes.setdefault(form, set()).add(code)
        self.root: tuple[str, dict] | None = None
        self.long: tuple[str, dict] | None = None
        self.known: dict[tuple[str, int], tuple[int, str, bool] | None] = {}
        inexact = sorted((f for f in self.codes if not f.startswith(EXACT)), key=lambda f: (hash_order(f), f))
        for form in inexact:
            if len(form) <= WORD:
                self.root = _added(self.root, form)
            else:
                self.long = _added(self.long, form)
        #: Numbers of the letters of forms; 0 is any other letter.
        self.letters = {c: i for i, c in enumerate(sorted(set("".join(f for f in inexact if len(f) <= WORD))), 1)}

    def within(self, query: str, most: int) -> list[tuple[int, str]]:
        """Every (distance, form) at most ``most`` away."""
        return self.within_all([(query, most)])[0]

    def within_all(self, asked: list[tuple[str, int]]) -> list[list[tuple[int, str]]]:
        """For each (query, most) every (distance, form) at most ``most`` away."""
        found: list[list[tuple[int, str]]] = [[(0, q)] if most == 0 and q in self.codes else [] for q, most in asked]
        # Strings whose lengths differ by more than ``most`` are no nearer than that.
        short = [i for i, (q, most) in enumerate(asked) if most > 0 and self.root and len(q) <= WORD + most]
        short.sort(key=lambda i: -len(asked[i][0]))
        for start in range(0, len(short), TOGETHER):
            self._descend(short[start:start + TOGETHER], asked, found)
        for i, (q, most) in enumerate(asked):
            if most > 0 and self.long and len(q) > WORD - most:
                found[i] += _below(self.long, Pattern(q), most)
        return found

    def _descend(self, places: list[int], asked: list[tuple[str, int]], found: list[list[tuple[int, str]]]) -> None:
        """Add to ``found`` what the queries at ``places``, by falling length, find in the tree."""
        lengths, most = np.array([len(asked[i][0]) for i in places]), np.array([asked[i][1] for i in places])
        coded = np.zeros((int(lengths[0]), len(places)), dtype=np.int32)
        for n, i in enumerate(places):
            coded[:lengths[n], n] = [self.letters.get(c, 0) for c in asked[i][0]]
        todo = [(self.root, np.arange(len(places)))]
        while todo:
            (form, children), active = todo.pop()
            if len(active) <= FEW:
                for n in active:
                    found[places[n]] += _below((form, children), Pattern(asked[places[n]][0]), asked[places[n]][1])
                continue
            d, limit = self._distances(form, coded[:lengths[active[0]], active], lengths[active]), most[active]
            for at in np.flatnonzero(d <= limit):
                found[places[active[at]]].append((int(d[at]), form))
            for k, child in children.items():  # as the triangle inequality has it
                near = active[np.abs(d - k) <= limit]
                if len(near):
                    todo.append((child, near))

    def _distances(self, form: str, coded: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The distances of a form to strings by falling length (a column each), as ``Pattern`` has them; bits beyond the form's letters never reach lower ones."""
        if not form:
            return lengths
        bits = np.zeros(len(self.letters) + 1, dtype=np.uint64)
        for c, at in Pattern(form).at.items():
            bits[self.letters[c]] = at
        one, top = np.uint64(1), np.uint64(len(form) - 1)
        up, down = np.full(len(lengths), ~np.uint64(0)), np.zeros(len(lengths), dtype=np.uint64)
        d = np.full(len(lengths), len(form), dtype=np.uint64)
        going = np.searchsorted(-lengths, -np.arange(len(coded)))  # how many strings have a letter there
        for row, n in zip(bits[coded], going):
            eq, u, w = row[:n], up[:n], down[:n]
            x = eq | w
            flat = (((eq & u) + u) ^ u) | eq
            right_up, right_down = w | ~(flat | u), u & flat
            d[:n] += (right_up >> top) & one
            d[:n] -= (right_down >> top) & one
            right_up = (right_up << one) | one
            up[:n] = (right_down << one) | ~(x | right_up)
            down[:n] = right_up & x
        return d.astype(np.int64)

    def learn(self, keys: Iterable[tuple[str, int]]) -> None:
        """Make the nearest entries of (query, most) known."""
        keys = list(dict.fromkeys(keys))
        fresh = [k for k in keys if k not in self.known]
        if fresh and len(self.known) > KNOWN:
            self.known.clear()
            fresh = keys
        for key, near in zip(fresh, self.within_all([_asked(*k) for k in fresh])):
            self.known[key] = _judged(self, *key, near)


def _added(root: tuple[str, dict] | None, form: str) -> tuple[str, dict]:
    """The tree with one form more."""
    if root is None:
        return form, {}
    node, pattern = root, Pattern(form)
    while True:
        d = pattern.distance(node[0])
        if d not in node[1]:
            node[1][d] = (form, {})
            return root
        node = node[1][d]


def _below(root: tuple[str, dict], pattern: Pattern, most: int) -> list[tuple[int, str]]:
    """Every (distance, form) of a tree at most ``most`` away from one string."""
    found, todo = [], [root]
    while todo:
        form, children = todo.pop()
        # Beyond this no child can be near enough, as the triangle inequality has it.
        d = pattern.distance(form, most + max(children, default=0))
        if d <= most:
            found.append((d, form))
        todo += [child for k, child in children.items() if d - most <= k <= d + most]
    return found


def hash_order(form: str) -> int:
    """An order without meaning, as sorted forms would make a deep tree."""
    return sum(ord(c) * (31 ** (i % 7)) for i, c in enumerate(form)) * 2654435761 % (1 << 32)


#: What a reader makes of a value: (form, largest edit distance), better readings first.
Reader = Callable[[str], list[tuple[str, int]]]


def fitting(query: str, form: str) -> int:
    """The most edits that make sense: in a word of under seven letters a second one only behind the same first letter."""
    return 2 if len(query) < 7 and query[:1] == form[:1] else 1 if len(query) < 7 else 9


def readings(tree: Tree, keys: list[tuple[str, int]]) -> Iterator[tuple[int, int, str, bool]]:
    """(reading, distance, code, whether no other entry is as near) of each reading with an entry within its edits; a swap counts one edit."""
    tree.learn(keys)
    for rank, key in enumerate(keys):
        if tree.known[key]:
            yield rank, *tree.known[key]


def search(tree: Tree, value: str, reader: Reader) -> tuple[int, int, str] | None:
    """The best (reading, distance, code): the first reading with one entry nearest, or with entries spelled alike."""
    return search_all(tree, [value], reader)[0]


def search_all(tree: Tree, values: Iterable[str], reader: Reader) -> list[tuple[int, int, str] | None]:
    """What ``search`` finds for each value. A reading is only looked up if no better one will do, together with those of the other values."""
    waiting = [(i, reader(v), 0) for i, v in enumerate(values)]
    found: list[tuple[int, int, str] | None] = [None] * len(waiting)
    while waiting:
        ahead = []
        for i, keys, rank in waiting:
            while rank < len(keys):
                key = keys[rank]
                if key[1] and key not in tree.known:
                    ahead.append((i, keys, rank))
                    break
                hit = tree.known[key] if key[1] else nearest(tree, *key)
                if hit and (hit[0] == 0 or hit[2]):
                    found[i] = rank, *hit[:2]
                    break
                rank += 1
        waiting = ahead
        tree.learn(keys[rank] for _, keys, rank in waiting)
    return found


def nearest(tree: Tree, query: str, most: int) -> tuple[int, str, bool] | None:
    """The (distance, smallest code, whether it is the only one) of the nearest entries within ``most`` edits, if there are any; at most
    one of the edits a swap, which the metric counts as two."""
    return _judged(tree, query, most, tree.within(*_asked(query, most)) if most else [(0, query)] if query in tree.codes else [])


def _asked(query: str, most: int) -> tuple[str, int]:
    return query, most + 1 if most else 0


def _judged(tree: Tree, query: str, most: int, within: list[tuple[int, str]]) -> tuple[int, str, bool] | None:
    if not within:
        return None
    near = [(edits(query, form, most), form) for _, form in within]
    least = min((d for d, form in near if d <= min(most, fitting(query, form))), default=None)
    if least is None:
        return None
    codes = set().union(*(tree.codes[form] for d, form in near if d == least))
    return least, min(codes), len(codes) == 1


def map_values(values: DataFrame, column: str, forms: DataFrame, reader: Reader, shard_forms: int = SHARD_FORMS) -> DataFrame:
    """(value, code, distance) of each distinct value; ``forms`` are (form, code)."""
    spark = values.sparkSession
    distinct = values.select(F.col(column).alias("value")).where(F.trim("value") != "").distinct()
    # Few bytes but much work: spread evenly.
    distinct = distinct.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    forms = cut(forms.select("form", "code").distinct())
    size = forms.count()
    if size <= shard_forms:
        listed = sorted(tuple(r) for r in forms.collect())

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree = Tree(listed)
            for batch in batches:
                found = [(v, *hit) for v, hit in zip(batch["value"], search_all(tree, batch["value"], reader)) if hit]
                yield pd.DataFrame(found, columns=["value", "rank", "distance", "code"])

        best = distinct.mapInPandas(whole, "value string, rank int, distance int, code string")
    else:
        shards = -(-size // shard_forms)
        piece = F.pmod(F.xxhash64("value"), F.lit(PIECES)).cast("int")
        asked = distinct.select("value", piece.alias("piece"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
        held = forms.withColumn("shard", F.pmod(F.xxhash64("form"), F.lit(shards)).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))

        def shard(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            tree = Tree(zip(right["form"], right["code"]))
            found = []
            for start in range(0, len(left), TOGETHER):
                read = [(v, reader(v)) for v in left["value"].iloc[start:start + TOGETHER]]
                tree.learn(key for _, keys in read for key in keys)
                found += [(v, *hit) for v, keys in read for hit in readings(tree, keys)]
            return pd.DataFrame(found, columns=["value", "rank", "distance", "code", "alone"])

        found = asked.groupBy("shard", "piece").cogroup(held.groupBy("shard", "piece")).applyInPandas(shard, "value string, rank int, distance int, code string, alone boolean")
        # Of each reading the nearest entries of all shards, judged together.
        level = found.groupBy("value", "rank", "distance").agg(F.min("code").alias("code"), ((F.min("code") == F.max("code")) & F.min("alone")).alias("alone"))
        level = level.groupBy("value", "rank").agg(F.min(F.struct("distance", "code", "alone")).alias("near")).where("near.distance = 0 or near.alone")
        best = level.groupBy("value").agg(F.min(F.struct("rank", "near.distance", "near.code")).alias("best")).select("value", "best.*")
    found = best.select("value", "code", "distance")
    return distinct.join(found, "value", "left").select("value", F.coalesce("code", F.lit(NONE)).alias("code"), "distance")
