"""Queries of problem 10: documents whose text was cut before its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioforge.llm.truncation import truncated
from biblioforge.session import load


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document whose text was cut."""
    return truncated(load(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of its texts that are not blank each source cut."""
    docs = load(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S")).select("doc_id", "source")
    cut_ones = truncated(load(spark, sf_dir, "documents")).select("doc_id", F.lit(1).alias("is_cut")).distinct()
    rates = docs.join(cut_ones, "doc_id", "left").groupBy("source")
    return rates.agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.coalesce("is_cut", F.lit(0))).alias("n_cut")).withColumn(
        "cut_share", F.col("n_cut") / F.col("n_texts"))


QUERIES = {"p10_found": p10_found, "p10_rates": p10_rates}
SQL: dict[str, str] = {}
