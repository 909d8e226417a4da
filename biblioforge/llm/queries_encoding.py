"""Queries of problem 5: fields garbled by a wrong character encoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioforge.llm.encoding import repair_fields, train
from biblioforge.session import load

FIELDS = {"articles": ("title", "abstract"), "article_metadata": ("affiliation",)}


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each affected field with its text as it is and as restored."""
    model = train(load(spark, sf_dir, "documents"))
    parts = []
    for table, fields in FIELDS.items():
        held = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])
        values = load(spark, sf_dir, table).where(F.trim("id") != "").select(F.lit(table).alias("record_table"), F.col("id").alias("record_key"), F.inline(held))
        parts.append(repair_fields(values, model))
    return reduce(DataFrame.unionByName, parts).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each title, abstract or affiliation of which a stretch was decoded wrongly."""
    return p5_restored(spark, sf_dir).select("record_table", "record_key", "field_name").distinct()


QUERIES = {"p5_found": p5_found, "p5_restored": p5_restored}
SQL: dict[str, str] = {}
