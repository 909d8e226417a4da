"""Queries of problem 3: the spellings of funding agencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioforge.llm import names
from biblioforge.llm.variants import link_variants, pairs_of
from biblioforge.operators.packed import split_packed
from biblioforge.session import cut, load


def spelling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, n): how often each spelling occurs in the grants and the funder batches."""
    grants = load(spark, sf_dir, "article_metadata").select("id", "grant_agencies").distinct()
    typed = split_packed(grants, ["id"], "grant_agencies", "name").select("item_value")
    batches = split_packed(load(spark, sf_dir, "funders_geo_counts"), ["batch_no"], "agency_names", "name").select("item_value")
    return typed.unionByName(batches).groupBy(F.col("item_value").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def _agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    curated = load(spark, sf_dir, "curated_funders").select(F.col("agency_id").alias("id"), F.trim("agency").alias("name"))
    counted = curated.join(spelling_counts(spark, sf_dir), "name", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"))
    # A fixed list of countries: some dozens of rows.
    places = frozenset(names.fold(r[0]) for r in load(spark, sf_dir, "ref_countries").select("country_name").collect() if r[0])
    return cut(link_variants(counted, places | frozenset(p.split(",")[0] for p in places)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of spellings of one agency."""
    return pairs_of(_agencies(spark, sf_dir)).select(F.col("a").alias("agency_id_a"), F.col("b").alias("agency_id_b"))


def p3_agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling that can be read, with the smallest id among the spellings of its agency."""
    return _agencies(spark, sf_dir).select(F.col("id").alias("agency_id"), F.col("canonical").alias("group_id"))


QUERIES = {"p3_found": p3_found, "p3_agencies": p3_agencies}
SQL: dict[str, str] = {}
