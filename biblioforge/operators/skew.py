"""Joins and groupings that survive a key holding a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more rows than both of these.
HOT_ROWS, HOT_SHARE = 100_000, 1e-4


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, hot_share: float = HOT_SHARE) -> DataFrame | None:
    """Keys with more than ``max(hot_rows, hot_share * rows)`` rows, or None if there are none.

    At most ``1 / hot_share`` keys can qualify, whatever the size of the data, so the
    result can be broadcast. Counting combines map-side.
    """
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    if big.isEmpty():
        return None
    found = big.where(F.col("__n") > df.count() * hot_share).select(*keys).collect()
    if not found:
        return None
    return df.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in found], df.select(*keys).schema)


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = HOT_ROWS, most_rows: int | None = None) -> DataFrame:
    """``left`` joined to ``right``, whose ``keys`` are unique, without sending a hot key of ``left`` to one task.

    The rows of ``right`` for hot keys (at most ``1 / HOT_SHARE`` rows) are broadcast;
    all other rows join through a shuffle. Without hot keys this is the plain join.
    ``how`` is ``inner`` or ``left``. NULL keys match nothing. ``most_rows`` is a bound on
    the rows of ``left``, if the caller knows one; too few for a hot key save the counting.
    """
    if most_rows is not None and most_rows <= hot_rows:
        return left.join(right, keys, how)
    hot = hot_keys(left, keys, hot_rows)
    if hot is None:
        return left.join(right, keys, how)
    hot = F.broadcast(hot)
    warm = left.join(hot, keys, "left_semi").join(F.broadcast(right.join(hot, keys, "left_semi")), keys, how)
    return warm.unionByName(left.join(hot, keys, "left_anti").join(right, keys, how))
