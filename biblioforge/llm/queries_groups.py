"""Queries of problems 1 and 2: groups of linked records and copies that differ in form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioforge.llm.components import connected_components
from biblioforge.llm.copies import bare, bare_values, copy_groups
from biblioforge.operators.skew import join_unique
from biblioforge.session import cut, load


def _pmids(rows: DataFrame, cell: str) -> DataFrame:
    """(record, pmid): the PMIDs of a list cell in whatever style; spreadsheet decimals (``.0``) are no part of a PMID."""
    found = F.array_distinct(F.regexp_extract_all(F.col(cell), F.lit("(\\d+)(?:\\.0+(?!\\d))?"), F.lit(1)))
    return rows.select("record", F.explode_outer(found).alias("pmid")).where("pmid is not null").distinct()


def review_links(records: DataFrame) -> DataFrame:
    """(a, b): links that put the record whose duplicate column lists a PMID and those that hold it into one group.

    Each PMID stands for its first holder, to which the listing records and further holders
    are linked, so that no PMID, however often it is listed or held, makes many pairs.
    """
    held = _pmids(records.select(F.col("resource_num").alias("record"), "id"), "id")
    held = cut(held)
    listed = records.select(F.col("resource_num").alias("record"), F.concat_ws(" ", "duplicate_urls", "duplicate_names").alias("cell"))
    listed = cut(_pmids(listed.where("cell <> ''"), "cell"))
    holders = held.groupBy("pmid").agg(F.min("record").alias("b"), F.max("record").alias("last"))
    links = join_unique(listed, holders.drop("last"), ["pmid"], most_rows=listed.count())
    further = holders.where("last > b").drop("last").join(listed.select("pmid").distinct(), "pmid", "leftsemi")
    links = links.unionByName(join_unique(held, further, ["pmid"], most_rows=held.count()))
    return links.select(F.col("record").alias("a"), "b").where("a <> b")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each review record linked to another one, with the smallest number in its group."""
    links = review_links(load(spark, sf_dir, "review_records"))
    return connected_components(links, "a", "b").select(F.col("vertex").alias("resource_num"), F.col("root").alias("group_num"))


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_table, row_key, group_key, n_copies) of both tables with copies."""
    entities = load(spark, sf_dir, "entities").where(bare(F.col("mention")) != "")
    found = copy_groups(entities, "mention_id", {c: F.col(c) for c in ("id", "label", "mention")})
    predictions = load(spark, sf_dir, "predictions")
    values = bare_values(F.col("best_name"), F.col("extracted_url"))
    twins = copy_groups(predictions.where(F.size(values) > 0), "prediction_id", {"id": F.col("id")}, values)
    return found.withColumn("record_table", F.lit("entities")).unionByName(twins.withColumn("record_table", F.lit("predictions")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of entities or predictions that has a copy, with the smallest key among the copies."""
    return _copies(spark, sf_dir).select("record_table", "group_key", "row_key")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each group of copies, with their number."""
    return _copies(spark, sf_dir).where("row_key = group_key").select("record_table", "group_key", "n_copies")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_records": p2_records}

_BARE = "upper(regexp_replace(coalesce({0}, ''), '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_COPIES = f"""
WITH keyed AS (
  SELECT 'entities' AS record_table, mention_id AS row_key,
         concat_ws('|', {_BARE.format('id')}, {_BARE.format('label')}, {_BARE.format('mention')}) AS k
  FROM entities WHERE {_BARE.format('mention')} <> ''
  UNION ALL
  SELECT 'predictions', prediction_id, concat_ws('|', {_BARE.format('id')}, array_to_string(list_sort(list_filter(
         string_split(regexp_replace({_BARE.format('best_name')}, '(HTTPS?)', '|\\1', 'g') || '|' ||
                      regexp_replace({_BARE.format('extracted_url')}, '(HTTPS?)', '|\\1', 'g'), '|'), lambda v: v <> '')), '|'))
  FROM predictions WHERE {_BARE.format('best_name')} || {_BARE.format('extracted_url')} <> ''
), grouped AS (
  SELECT record_table, row_key, min(row_key) OVER w AS group_key, count(*) OVER w AS n_copies
  FROM keyed WINDOW w AS (PARTITION BY record_table, k)
)"""
SQL: dict[str, str] = {
    "p1_found": """
WITH RECURSIVE held AS (
  SELECT DISTINCT resource_num AS b, unnest(regexp_extract_all(id, '(\\d+)', 1)) AS pmid FROM review_records
), listed AS (
  SELECT DISTINCT resource_num AS a, unnest(regexp_extract_all(concat_ws(' ', duplicate_urls, duplicate_names), '(\\d+)(?:\\.0+)?', 1)) AS pmid
  FROM review_records
), link AS (
  SELECT DISTINCT a, b FROM listed JOIN held USING (pmid) WHERE a <> b
), both_ways AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
)
SELECT a AS resource_num, least(a, min(b)) AS group_num FROM reach GROUP BY a""",
    "p2_found": _COPIES + " SELECT record_table, group_key, row_key FROM grouped WHERE n_copies > 1",
    "p2_records": _COPIES + " SELECT record_table, group_key, n_copies FROM grouped WHERE n_copies > 1 AND row_key = group_key",
}
