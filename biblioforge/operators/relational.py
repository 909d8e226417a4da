"""Row-level operators: keeping first rows, checks, lookups, splits and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioforge.session import cut


def require_columns(df: DataFrame, columns: list[str]) -> None:
    """Raise if columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``, which should be total.

    The choice is an aggregate, which combines map-side, so a key of very many rows is
    reduced before it is shuffled. Clashing names are no problem: rows travel as one struct.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    ranks = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    chosen = df.groupBy(*keys).agg(F.min_by(row, ranks).alias("__row"))
    return chosen.select("__row.*")


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    """Without rows whose column is NULL or blank."""
    return df.where(F.coalesce(F.col(column), F.lit("")) != "")


def check_unique(df: DataFrame, key: str) -> None:
    """Raise if a key repeats."""
    n = df.agg(F.count(key).alias("n"), F.countDistinct(key).alias("d")).first()
    if n["n"] != n["d"]:
        raise ValueError(f"{key} is not unique: {n['n']} values, {n['d']} different")


def split_by_rank(df: DataFrame, key: str, fractions: tuple[float, float, float], seed: int) -> DataFrame:
    """With a column ``split`` of train, val or test: rows ranked by a hash of key and seed, cut at exact sizes.

    The held-out part is rounded up, as is the test part within it. Ranks come from counts of
    hash prefixes, so no single task orders all rows.
    """
    if abs(sum(fractions) - 1.0) > 1e-9:
        raise ValueError("the fractions do not add up to 1")
    hashed = df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("__p", F.substring("__h", 1, 3))
    before = hashed.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))  # at most 4096 rows
    before = before.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    ranked = hashed.join(F.broadcast(before), "__p").crossJoin(F.broadcast(total))
    ranked = ranked.withColumn("__r", F.col("__before") + F.row_number().over(Window.partitionBy("__p").orderBy("__h", key)))
    held = F.ceil(F.col("__total") * F.lit(round(fractions[1] + fractions[2], 9)))
    test = F.ceil(held * F.lit(round(fractions[2] / (fractions[1] + fractions[2]), 9)))
    train = F.col("__total") - held
    split = F.when(F.col("__r") <= train, "train").when(F.col("__r") <= F.col("__total") - test, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("__h", "__p", "__before", "__total", "__r")


def chunk_ids(df: DataFrame, key: str, n_chunks: int) -> DataFrame:
    """With a column ``chunk`` of 0 to n_chunks - 1: contiguous ranges of the key's order, the first ones a row longer."""
    ranged = cut(df.repartitionByRange(F.col(key)).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__before"), F.sum("n").over(Window.partitionBy()).alias("__total"))
    ranked = ranged.join(F.broadcast(sizes), "__part").withColumn("__r", F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1)
    size, extra = F.expr("__total div " + str(n_chunks)), F.col("__total") % n_chunks
    long = (size + 1) * extra
    chunk = F.when(F.col("__r") < long, F.floor(F.col("__r") / (size + 1))).otherwise(extra + F.floor((F.col("__r") - long) / F.greatest(size, F.lit(1))))
    return ranked.withColumn("chunk", chunk.cast("int")).drop("__part", "__before", "__total", "__r")


def unseen(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in what is done already."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    chosen = df.groupBy(*keys).agg(F.max_by(row, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("__row"))
    return chosen.select("__row.*")


def of_class(df: DataFrame, column: str, value: str) -> DataFrame:
    """The rows of one class, without the column that tells it."""
    return df.where(F.col(column) == value).drop(column)


def random_subset(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows drawn by a hash of key and seed, the same ones each time."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(k)
