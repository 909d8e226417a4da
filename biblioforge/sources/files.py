"""Delimited files, registry documents and split outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblioforge.functions import text
from biblioforge.operators import relational

ARTICLE_COLUMNS = ["id", "title", "abstract"]


def read_text_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, encoding: str = "ISO-8859-1", separator: str = ",") -> DataFrame:
    """A delimited file with a header, every column text, quoted fields over several lines; blank fields are blank, not NULL.

    Without ``columns`` the header names them.
    """
    reader = spark.read.options(header=True, multiLine=True, escape='"', encoding=encoding, sep=separator)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path).na.fill("")


def read_typed_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A delimited file with a declared schema."""
    return spark.read.options(header=True, multiLine=True, escape='"').schema(schema).csv(path)


def read_articles(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(id, title, abstract, title_abstract, ...) of the first row of each id, without markup."""
    raw = read_text_csv(spark, path, encoding=encoding)
    relational.require_columns(raw, ARTICLE_COLUMNS)
    numbered = relational.drop_blank(raw, "id").withColumn("__row", F.monotonically_increasing_id())
    first = relational.keep_first(numbered, ["id"], [F.col("__row")]).drop("__row")
    clean = first.withColumns({c: text.strip_newlines(text.strip_markup(F.col(c))) for c in ("title", "abstract")})
    return clean.withColumn("title_abstract", text.title_abstract(F.col("title"), F.col("abstract")))


def read_together(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Several files as one table, columns matched by name."""
    if not paths:
        raise ValueError("no file to read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_typed_csv(spark, p, schema) for p in paths])


def write_text_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A delimited folder with headers; blank fields stay blank, quotes are doubled."""
    df.write.mode(mode).options(header=True, escape='"', emptyValue="").csv(path)


def append_chunk(df: DataFrame, path: str) -> None:
    """A further chunk of a result; each file of the folder has its own header."""
    write_text_csv(df, path, "append")


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder for each split."""
    df.write.mode("errorifexists").partitionBy(split).parquet(path)


def xml_values(document: Column, element: str) -> Column:
    """The different contents of an element of an XML document, whatever its namespace, joined by ``_AND_``."""
    found = F.xpath(document, F.lit(f'//*[local-name()="{element}"]/text()'))
    return F.array_join(F.array_distinct(found), "_AND_")


def read_registry(documents: DataFrame, id_col: str, xml: str) -> DataFrame:
    """(id, repositoryname, repositoryurl, subject, repository_type) of registry documents."""
    names = {"repositoryname": "repositoryName", "repositoryurl": "repositoryURL", "subject": "subject", "repository_type": "type"}
    return documents.select(F.col(id_col), *[xml_values(F.col(xml), e).alias(c) for c, e in names.items()])


def read_keyed_config(spark: SparkSession, path: str, key: str) -> dict[str, dict[str, str]]:
    """A small tab-separated configuration file as a mapping of its key column; a repeated key is an error."""
    rows = spark.read.options(header=True, sep="\t").csv(path).collect()
    found = {r[key]: r.asDict() for r in rows}
    if len(found) != len(rows):
        raise ValueError(f"{key} repeats in {path}")
    return found


def write_one_row(df: DataFrame, path: str) -> None:
    """A frame of exactly one row, such as the measures of a model, as one delimited file in a folder."""
    if df.limit(2).count() != 1:
        raise ValueError("not one row")
    write_text_csv(df.coalesce(1), path, "overwrite")
