"""Query of problem 6: the values packed into cells of the literature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioforge.operators.packed import split_packed
from biblioforge.session import load

#: Table, field, key and kind of each packed field.
FIELDS = (
    ("review_records", "id", "resource_num", "id"),
    ("review_records", "extracted_url", "resource_num", "url"),
    ("article_metadata", "grant_agencies", "id", "name"),
    ("article_metadata", "authors", "id", "person"),
)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of each packed cell with at least two values, once per record.

    A record delivered again has the same cells, so cells are made distinct before they
    are split; rows without a key belong to no record.
    """
    parts = []
    for table, field, key, kind in FIELDS:
        cells = load(spark, sf_dir, table).select(F.col(key).cast("string").alias("record_key"), field)
        cells = cells.where((F.trim("record_key") != "") & (F.trim(field) != "")).distinct()
        values = split_packed(cells, ["record_key"], field, kind).where("n_values >= 2")
        parts.append(values.select(
            F.lit(table).alias("record_table"), "record_key", F.lit(field).alias("field_name"),
            F.col("value_pos").cast("int").alias("value_pos"), "item_value",
        ))
    return reduce(DataFrame.unionByName, parts)


QUERIES = {"p6_found": p6_found}
SQL: dict[str, str] = {}
