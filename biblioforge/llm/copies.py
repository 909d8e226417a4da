"""Collapsing records that are copies but for their form, by commutative multiset hashing.

Each field is normalised to its letters and digits without case. The hashes of the
(field name, value) pairs of a record are added up, so that the order of interchangeable
values does not matter and nothing is sorted; records with one fingerprint form a group,
and every member is then compared value by value with the group's first record.

Defined results: a record whose fields have no letter or digit at all is no case; a row
delivered twice under one key is one record; ties cannot occur, as the smallest row key
names the group; a NULL field counts as a blank one unless the caller filters it; text of
any length is taken whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioforge.operators.skew import join_unique
from biblioforge.session import cut

#: The hashes are added modulo this prime (2**61 - 1), so that no sum overflows.
PRIME = (1 << 61) - 1


def bare(column: Column) -> Column:
    """Letters and digits alone, in upper case, which also unites the forms of sigma and sharp s."""
    return F.upper(F.regexp_replace(F.coalesce(column.cast("string"), F.lit("")), "[^\\p{L}\\p{N}]", ""))


def bare_values(*cells: Column) -> Column:
    """The normalised values of cells that hold a name or URLs: a new value begins with each URL scheme.

    Deciding on the bare text keeps the values apart even where blanks or punctuation
    were put into the scheme or between the URLs.
    """
    parts = [F.split(F.regexp_replace(bare(c), "(?<!^)(?=HTTPS?)", "\u0001"), "\u0001") for c in cells]
    return F.filter(F.concat(*parts), lambda v: v != "")


def multiset_hash(pairs: Column, seed: int) -> Column:
    """A sum of hashes that does not depend on the order of ``pairs``."""
    hashed = F.transform(pairs, lambda p: F.pmod(F.xxhash64(p, F.lit(seed)), F.lit(PRIME)))
    return F.aggregate(hashed, F.lit(0).cast("long"), lambda total, h: (total + h) % F.lit(PRIME))


def same_multiset(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values equally often."""
    times = lambda values, v: F.size(F.filter(values, lambda w: w == v))
    return (F.size(a) == F.size(b)) & F.forall(a, lambda v: times(a, v) == times(b, v))


def copy_groups(df: DataFrame, row_key: str, fields: dict[str, Column], loose: Column | None = None) -> DataFrame:
    """(row_key, group_key, n_copies) of the rows with at least one copy.

    ``fields`` are compared name by name, the values of the array ``loose`` in any order.
    """
    fixed = F.array(*[F.concat(F.lit(name + "\u0001"), bare(c)) for name, c in fields.items()])
    pairs = fixed if loose is None else F.concat(fixed, F.transform(loose, lambda v: F.concat(F.lit("\u0002"), v)))
    rows = df.select(F.col(row_key).alias("row_key"), pairs.alias("pairs"))
    rows = rows.select("row_key", "pairs", multiset_hash(F.col("pairs"), 1).alias("h1"), multiset_hash(F.col("pairs"), 2).alias("h2"))
    print_ = ["h1", "h2"]
    groups = rows.groupBy(*print_).agg(F.min("row_key").alias("group_key"), F.max("row_key").alias("last"))
    groups = groups.where("group_key < last").drop("last")
    members = cut(join_unique(rows, groups, print_))
    first = members.where("row_key = group_key").select("group_key", F.col("pairs").alias("first")).dropDuplicates(["group_key"])
    compared = join_unique(members, first, ["group_key"]).withColumn("same", same_multiset(F.col("pairs"), F.col("first")))
    # Different records under one fingerprint (a collision of 122 bits) are grouped by their values instead.
    other = compared.where("not same").withColumn("exact", F.array_join(F.array_sort("pairs"), "\u0003"))
    exact = other.groupBy(*print_, "exact").agg(F.min("row_key").alias("group_key"))
    other = other.drop("group_key").join(exact, [*print_, "exact"]).select("row_key", "group_key")
    grouped = compared.where("same").select("row_key", "group_key").unionByName(other).distinct()
    counts = grouped.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return join_unique(grouped, counts, ["group_key"]).select("row_key", "group_key", "n_copies")
