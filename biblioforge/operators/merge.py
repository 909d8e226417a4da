"""Ordered merges of record groups into delimited cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioforge.functions.arrays import select_names
from biblioforge.operators.skew import join_unique


def ordered_join(value: Column, order: list[Column], separator: str = ", ", drop_blank: bool = False) -> Column:
    """Aggregate: the values of a group as one cell, in ``order``; NULLs count as blank."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.coalesce(value.cast("string"), F.lit("")).alias("v"))))
    values = F.transform(rows, lambda r: r["v"])
    return F.array_join(F.filter(values, lambda v: v != "") if drop_blank else values, separator)


def first_by(value: Column, order: list[Column]) -> Column:
    """Aggregate: the value of the first row by ``order``."""
    return F.min_by(value, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))


def descending(date: Column) -> Column:
    """A key that sorts YYYY-MM-DD dates newest first; blank and missing dates come last."""
    digits = F.regexp_replace(F.coalesce(date, F.lit("")), "[^0-9]", "")
    return -F.coalesce(digits.try_cast("long"), F.lit(-1))


def merge_exact(df: DataFrame, id_col: str, tie: str) -> DataFrame:
    """Records of one best_name and extracted_url as one: newest first, ids, names and scores listed, names chosen again.

    ``df`` has the columns of deduplication; ``tie`` makes the order total. A record
    without a twin stays as it is, with article_count 1.
    """
    order = [descending(F.col("publication_date")), F.col(tie)]
    listed = ["best_common", "best_common_prob", "best_full", "best_full_prob"]
    merged = df.groupBy("best_name", "extracted_url").agg(
        F.count(F.lit(1)).alias("article_count"), ordered_join(F.col(id_col), order).alias(id_col),
        *[ordered_join(F.col(c), order).alias(c) for c in listed], first_by(F.col("best_name_prob"), order).alias("best_name_prob"),
        first_by(F.col("publication_date"), order).alias("publication_date"), first_by(F.col("text"), order).alias("text"))
    chosen = select_names(*[F.col(c) for c in listed])
    names = ["best_common", "best_common_prob", "best_full", "best_full_prob", "best_name", "best_name_prob"]
    single = F.col("article_count") == 1
    pick = lambda n: F.when(single, F.col(n).cast("string")).otherwise(F.col(f"chosen.{n}").cast("string")).alias(n)
    return merged.withColumn("chosen", chosen).select(id_col, "text", *[pick(n) for n in names], "extracted_url", "publication_date", "article_count")


def merge_on(df: DataFrame, group: str, order: list[Column], listed: list[str], firsts: list[str]) -> DataFrame:
    """One row for each value of ``group``: listed columns in order, the others from the first row."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_merged"), *[ordered_join(F.col(c), order).alias(c) for c in listed], *[first_by(F.col(c), order).alias(c) for c in firsts])


def value_groups(df: DataFrame, id_col: str, cell: str, separator: str = ",") -> DataFrame:
    """(id, value, group_id, n_links) of each value of a list cell that other records have as well.

    ``group_id`` is the smallest id with the value, ``n_links`` the number of other records
    with it. Each record is one row for each of its values; pairs are not made.
    """
    values = df.select(F.col(id_col), F.explode(F.split(F.coalesce(F.col(cell), F.lit("")), f"\\Q{separator}\\E")).alias("value"))
    values = values.select(id_col, F.trim("value").alias("value")).where("value <> ''").distinct()
    groups = values.groupBy("value").agg(F.min(id_col).alias("group_id"), (F.count(F.lit(1)) - 1).alias("n_links")).where("n_links > 0")
    return join_unique(values, groups, ["value"]).select(id_col, "value", "group_id", "n_links")


def listed_duplicates(df: DataFrame, id_col: str, cell: str, separator: str = ",", trim: bool = True) -> DataFrame:
    """(id, duplicates): the ids of other records with a value of the cell, as reviewers see them.

    The list of a record is as long as its duplicates, so this is for frames under review;
    ``value_groups`` says the same of any number of records. Without ``trim`` blanks after a
    divider belong to the value.
    """
    value = F.explode(F.split(F.coalesce(F.col(cell), F.lit("")), f"\\Q{separator}\\E"))
    values = df.select(F.col(id_col).alias("id"), value.alias("value"))
    values = values.select("id", F.trim("value").alias("value") if trim else F.col("value")).where("value <> ''").distinct()
    other = values.select(F.col("id").alias("other"), "value")
    found = values.join(other, "value").where("id <> other").select("id", "other").distinct()
    lists = found.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("other")), ", ").alias("duplicates"))
    return df.select(F.col(id_col).alias("id")).join(lists, "id", "left").select(F.col("id").alias(id_col), F.coalesce("duplicates", F.lit("")).alias("duplicates"))
