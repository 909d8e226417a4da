"""Queries of problem 7: institutions and countries as typed, mapped to the reference lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioforge.llm import places
from biblioforge.llm.canonical import NONE, Reader, map_values
from biblioforge.llm.encoding import Model, repair, train
from biblioforge.operators.skew import join_unique
from biblioforge.session import cut, load


def _countries(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, str]]:
    """The reference countries, a fixed list of some dozens."""
    rows = load(spark, sf_dir, "ref_countries").select("country_3", "country_2", "country_name").collect()
    return [tuple(x or "" for x in r) for r in rows]


def _forms(entries: DataFrame, forms: Callable[[list[tuple]], list[tuple[str, str]]]) -> DataFrame:
    """(form, code) of the entries of a list, which may be of any length."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(forms([tuple(x or "" for x in r) for r in batch.itertuples(index=False)]), columns=["form", "code"])

    return entries.mapInPandas(make, "form string, code string")


def _repaired(reader: Reader, model: Model) -> Reader:
    """A reader of values as they were before a wrong decoding."""
    return lambda value: reader(repair(value, model)[1] or "")


def _mapped(records: DataFrame, forms: DataFrame, reader: Reader) -> DataFrame:
    """(record_key, value, code) of (record_key, value)."""
    found = cut(map_values(records, "value", forms, reader))
    code = F.when(F.col("code") == places.UNLISTED, NONE).otherwise(F.col("code"))
    return join_unique(records, found.select("value", code.alias("ref_code")), ["value"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference entry of each typed institution and country, or ``none``."""
    typed = load(spark, sf_dir, "article_metadata").select(F.col("id").alias("record_key"), F.col("affiliation").alias("value"))
    typed = typed.where((F.trim("value") != "") & (F.trim("record_key") != "")).distinct()
    countries = _countries(spark, sf_dir)
    model = train(load(spark, sf_dir, "documents"))
    forms = _forms(load(spark, sf_dir, "ref_institutions").select("inst_code", "institution_name", "short_name"), places.institution_forms)
    codes = frozenset(c for three, two, _ in countries for c in (three, two)) | {"UK"}
    found = _mapped(typed, forms, _repaired(places.institution_reader(codes), model)).withColumn("record_table", F.lit("article_metadata"))
    hosts = load(spark, sf_dir, "url_status").select(F.col("url_id").cast("string").alias("record_key"), F.col("country").alias("value"))
    hosts = hosts.where((F.trim("value") != "") & F.col("record_key").isNotNull()).distinct()
    named = _mapped(hosts, spark.createDataFrame(places.country_forms(countries), "form string, code string"), _repaired(places.read_country, model)).withColumn("record_table", F.lit("url_status"))
    return found.unionByName(named).select("record_table", "record_key", "ref_code")


def p7_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each table have a value that is in no list."""
    found = p7_found(spark, sf_dir).groupBy("record_table")
    return found.agg(F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("ref_code") == NONE).alias("n_unmatched"))


QUERIES = {"p7_found": p7_found, "p7_unmatched": p7_unmatched}
SQL: dict[str, str] = {}
