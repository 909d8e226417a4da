"""Several values packed in one field: one row per value, with its position.

Ordinary characters of a cell are masked, which leaves its delimiter skeleton.
Far fewer skeletons than cells occur, so the splitting rule (which runs of the
cell make up which value) is resolved once per distinct skeleton and joined back
to the cells, where values are cut out by position on the JVM side.

Defined results: NULL and blank cells give no rows; a cell without a divider gives
one row at position 0; blank values between dividers are not counted; repeated
cells of a key give repeated rows (callers wanting a set use ``distinct``); an
unclosed quote is an ordinary character.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioforge.operators.skew import join_unique
from biblioforge.session import cut

#: Characters that stand for a masked apostrophe, a slash between blanks, a joining word and the start of a URL.
APOSTROPHE, SLASH, JOINER, URL = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
#: Rules are broadcast up to so many bytes, beyond that they are joined through a shuffle.
BROADCAST_BYTES = 8 << 20

_DELIMITERS = ",;|\"'\\[\\]\\n\\t\\r"
_STRONG = frozenset(";|\n\t\r" + SLASH)


def resolve(skeleton: str, kind: str) -> list[tuple[int, int]]:
    """The (first run, number of runs) of each value of a skeleton, runs counted from 1."""
    n = len(skeleton)
    lo, hi = 0, n
    while lo < hi and skeleton[lo] == " ":
        lo += 1
    while hi > lo and skeleton[hi - 1] in " ,;":
        hi -= 1
    bracketed = hi - lo >= 2 and skeleton[lo] == "[" and skeleton[hi - 1] == "]"
    if bracketed:
        lo, hi = lo + 1, hi - 1
    else:
        hi = n
    quoted = [False] * n
    i, fresh = lo, True  # fresh: a value may begin here
    while i < hi:
        c = skeleton[i]
        if c in "\"'" and fresh:
            end = _closing(skeleton, i, hi, bracketed, kind)
            if end:
                quoted[i:end + 1] = [True] * (end + 1 - i)
                i, fresh = end + 1, False
                continue
        fresh = c in ",;|\n\t\r" + SLASH + JOINER or (c == " " and (fresh or kind == "url"))
        i += 1
    free = [c for j, c in enumerate(skeleton[:hi]) if j >= lo and not quoted[j]]
    strong = any(c in _STRONG for c in free)
    values, start = [], lo

    def close(end: int) -> None:
        if any(skeleton[j] in "w" + URL for j in range(start, end)):
            values.append((start + 1, end - start))

    for j in range(lo, hi):
        c = skeleton[j]
        if quoted[j]:
            continue
        if c in _STRONG or (c == JOINER and kind == "person"):
            divides = True
        elif strong:
            divides = False
        elif c == ",":
            divides = kind != "url" or j + 1 >= hi or skeleton[j + 1] in " ,\"'" + URL
        else:
            divides = c == " " and kind == "url"
        if divides:
            close(j)
            start = j + 1
    close(hi)
    return values


def _closing(skeleton: str, i: int, hi: int, bracketed: bool, kind: str) -> int:
    """Where the quote opened at ``i`` ends, or 0: a like quote followed by a divider, a blank before one, or the end."""
    for j in range(i + 1, hi):
        if skeleton[j] != skeleton[i]:
            continue
        k = j + 1
        while k < hi and skeleton[k] == " ":
            k += 1
        if k >= hi or skeleton[k] in ",;|\n\t\r" + SLASH + JOINER or (k > j + 1 and kind == "url"):
            return j
    return 0


def _marked(cell: Column, kind: str) -> Column:
    """The cell with inner apostrophes, slashes between blanks, joining words and starts of URLs as single characters."""
    cell = F.regexp_replace(cell, "(?<=[\\p{L}\\p{N}])'(?=[\\p{L}\\p{N}])", APOSTROPHE)
    slash = "/" if kind == "id" else "(?<=\\s)/(?=\\s)"
    if kind == "url":
        return F.regexp_replace(F.regexp_replace(cell, slash, SLASH), "(?i)(?=https?://)", URL)
    cell = F.regexp_replace(cell, slash, SLASH)
    if kind == "person":
        cell = F.regexp_replace(cell, "(?<=[\\s,;])(?:and|&)(?=\\s)", JOINER)
    return cell


def _runs(cell: Column, kind: str) -> Column:
    extra = SLASH + JOINER + (URL + " " if kind == "url" else "")
    blank = "| +" if kind == "url" else ""
    single = _DELIMITERS + SLASH + JOINER + (URL if kind == "url" else "")
    return F.regexp_extract_all(cell, F.lit(f"[{single}]{blank}|[^{_DELIMITERS}{extra}]+"), F.lit(0))


def _mask(run: Column) -> Column:
    return (
        F.when(run.rlike(f"^[{_DELIMITERS}{SLASH}{JOINER}{URL}]$"), run)
        .when(run.rlike("(?U)^\\s*$"), F.lit(" "))
        .otherwise(F.lit("w"))
    )


def _clean(value: Column) -> Column:
    """Without white space, quotes and list brackets around it."""
    value = F.translate(value, APOSTROPHE + SLASH + JOINER + URL, "'/&")
    edge = "[\\s\\u0085\\p{Z}\"\\[\\]]"
    value = F.regexp_replace(value, f"^{edge}+|{edge}+$", "")
    value = F.when(value.rlike("(?s)^'.*'$") & (F.length(value) > 1), F.regexp_replace(value, "^'|'$", "")).otherwise(value)
    return F.regexp_replace(value, f"^{edge}+|{edge}+$", "")


def split_packed(df: DataFrame, keys: list[str], cell: str, kind: str = "name") -> DataFrame:
    """Rows (keys, value_pos, item_value, n_values) of the values in ``cell``.

    ``kind``: ``name`` (commas divide unless another divider occurs), ``person`` (joining
    words divide as well), ``url`` (blanks divide, commas inside a URL do not) or ``id``
    (any slash divides). Other columns, whatever their names, are ignored.
    """
    if kind not in ("name", "person", "url", "id"):
        raise ValueError(f"unknown kind {kind!r}")
    names = [f"__k{i}" for i in range(len(keys))]
    text = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(cell).cast("string").alias("__cell"))
    text = text.where(F.trim(F.col("__cell")) != "")
    cells = text.select(*names, _runs(_marked(F.col("__cell"), kind), kind).alias("__runs"))
    cells = cells.withColumn("__skeleton", F.array_join(F.transform("__runs", _mask), ""))

    def resolve_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rules = [[{"start": a, "n": b} for a, b in resolve(s, kind)] for s in batch["__skeleton"]]
            yield pd.DataFrame({"__skeleton": batch["__skeleton"], "__rule": rules})

    skeletons = cells.select("__skeleton").distinct()
    rules = cut(skeletons.mapInPandas(resolve_all, "__skeleton string, __rule array<struct<start:int,n:int>>"))
    size = rules.agg(F.sum(F.length("__skeleton") + 16 * F.size("__rule"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        ruled = cells.join(F.broadcast(rules), "__skeleton")
    else:
        ruled = join_unique(cells, rules, ["__skeleton"])
    values = F.filter(
        F.transform("__rule", lambda r: _clean(F.array_join(F.slice("__runs", r["start"], r["n"]), ""))),
        lambda v: v != "",
    )
    out = ruled.select(*names, values.alias("__values"))
    # Numbers come out of the explode with the values, so that a filter by them is no reason to cut all values out twice.
    numbered = F.transform("__values", lambda v, i: F.struct(F.size("__values").alias("n_values"), i.cast("int").alias("value_pos"), v.alias("item_value")))
    out = out.select(*names, F.inline_outer(numbered)).where("value_pos is not null")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "value_pos", "item_value", "n_values")
