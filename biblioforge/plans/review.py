"""Queries over review records and addresses: flags, answers, merges, status, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioforge.functions import text
from biblioforge.operators import merge, relational, review
from biblioforge.operators.skew import join_unique
from biblioforge.session import load

LEAST_PROB = 0.978
KEPT = ["best_name", "best_name_prob", "extracted_url", "publication_date"]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each review record once, whatever its deliveries."""
    rows = load(spark, sf_dir, "review_records")
    return relational.keep_first(rows, ["resource_num"], [F.col("received_at")]).drop("received_at")


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review records with answers made up by rule, as the tables hold none."""
    turn = F.pmod(F.col("resource_num"), F.lit(5))
    flagged = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = review.add_review_columns(_records(spark, sf_dir))
    return rows.withColumns({
        "review_low_prob": F.when(~flagged("low_prob"), "").when(turn == 0, "remove").when(turn == 1, "").otherwise("do not remove"),
        "review_dup_urls": F.when(~flagged("duplicate_urls"), "").when(turn < 3, "merge on record with best name prob").when(turn == 3, "do not merge").otherwise("maybe"),
        "review_dup_names": F.when(~flagged("duplicate_names"), "").when(turn < 2, "do not merge").otherwise('merge all "dup name" IDs'),
    })


def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review records whose name others have, with the group and the number of the others."""
    return merge.value_groups(_records(spark, sf_dir), "resource_num", "best_name", ";")


def shared_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review records with an address that others have."""
    return merge.value_groups(_records(spark, sf_dir), "resource_num", "extracted_url")


def low_prob_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with the mark of a low score."""
    rows = relational.drop_blank(load(spark, sf_dir, "predictions"), "best_name_prob")
    return rows.select("prediction_id", review.flag_low_prob(F.col("best_name_prob"), LEAST_PROB).alias("low_prob"))


def flag_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many review records have which flag."""
    return review.flag_counts(_records(spark, sf_dir))


def review_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are missing or not allowed."""
    return review.violations(_answered(spark, sf_dir), "resource_num")


def mixed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names under which not all records have one instruction."""
    return review.mixed_instructions(_answered(spark, sf_dir), "resource_num", "best_name", "review_dup_names")


def merged_on_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review records after removals, merged on their address where told so."""
    return review.merge_urls(review.drop_removed(_answered(spark, sf_dir)), "resource_num", KEPT)


def merged_on_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review records after removals, merged on their name unless told otherwise."""
    return review.merge_names(review.drop_removed(_answered(spark, sf_dir)), "resource_num", KEPT)


def cleaned_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of ids without decimals, and how many ids a record has."""
    return _records(spark, sf_dir).select(
        "resource_num", text.remove_decimals(F.coalesce("duplicate_urls", F.lit(""))).alias("duplicate_urls"),
        text.count_listed(F.coalesce("id", F.lit(""))).cast("string").alias("article_count"))


def regrouped_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of each record one by one and joined again."""
    rows = relational.drop_blank(_records(spark, sf_dir), "extracted_url")
    single = rows.select("resource_num", "best_name", F.posexplode(F.split("extracted_url", ", ")).alias("pos", "url"))
    return single.groupBy("resource_num").agg(
        F.min_by("best_name", "pos").alias("best_name"), merge.ordered_join(F.col("url"), [F.col("pos")]).alias("extracted_url"), F.count(F.lit(1)).alias("n_urls"))


def url_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of review records with their last known status and country; the blank status for unknown ones."""
    rows = relational.drop_blank(_records(spark, sf_dir), "extracted_url")
    single = rows.select("resource_num", F.posexplode(F.split("extracted_url", ", ")).alias("pos", "url"))
    known = relational.latest(load(spark, sf_dir, "url_status").select("url", "status", "country", "checked_at", "url_id"), ["url"], [F.col("checked_at"), F.col("url_id")])
    found = join_unique(single, known.select("url", "status", "country"), ["url"], "left")
    return found.select("resource_num", F.col("pos").cast("int").alias("pos"), "url", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("country", F.lit("")).alias("country"))


def unchecked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions whose address has no status yet: what a resumed run has to do."""
    rows = relational.drop_blank(load(spark, sf_dir, "predictions"), "extracted_url").select("prediction_id", F.col("extracted_url").alias("url"))
    return relational.unseen(rows, load(spark, sf_dir, "url_status").where("url is not null"), "url").select("prediction_id")


def remerged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of all articles of each record as one row."""
    ids = _records(spark, sf_dir).select("resource_num", F.posexplode(F.regexp_extract_all("id", F.lit("\\d+"), F.lit(0))).alias("pos", "id"))
    meta = relational.keep_first(load(spark, sf_dir, "article_metadata"), ["id"], [F.col("received_at")])
    found = join_unique(ids, meta.select("id", "affiliation", "authors", "grant_agencies", "num_citations"), ["id"], "left")
    order = [F.col("pos")]
    return found.groupBy("resource_num").agg(
        merge.ordered_join(F.col("id"), order).alias("ids"), merge.ordered_join(F.col("affiliation"), order, "; ", True).alias("affiliation"),
        merge.ordered_join(F.col("authors"), order, ", ", True).alias("authors"), merge.ordered_join(F.col("grant_agencies"), order, "; ", True).alias("grant_agencies"),
        F.coalesce(F.sum("num_citations"), F.lit(0)).alias("num_citations"))


def archive_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command line for each address to be archived: those that answered, once each."""
    rows = load(spark, sf_dir, "url_status").where(F.col("status").rlike("^[23]")).select("url").distinct()
    return rows.select("url", F.concat(F.lit("curl -X POST -d url="), "url", F.lit(" https://web.archive.org/save")).alias("command"))


QUERIES = {f.__name__: f for f in (
    shared_names, shared_urls, low_prob_flags, flag_totals, review_violations, mixed_answers, merged_on_url, merged_on_name, cleaned_review,
    regrouped_urls, url_statuses, unchecked_urls, remerged_metadata, archive_commands)}

_R = """rec AS (
  SELECT * EXCLUDE (received_at) FROM review_records QUALIFY row_number() OVER (PARTITION BY resource_num ORDER BY received_at) = 1
)"""
_ANSWERED = _R + """, answered AS (
  SELECT *, CASE WHEN coalesce(low_prob, '') = '' THEN '' WHEN resource_num % 5 = 0 THEN 'remove' WHEN resource_num % 5 = 1 THEN '' ELSE 'do not remove' END AS review_low_prob,
         CASE WHEN coalesce(duplicate_urls, '') = '' THEN '' WHEN resource_num % 5 < 3 THEN 'merge on record with best name prob'
              WHEN resource_num % 5 = 3 THEN 'do not merge' ELSE 'maybe' END AS review_dup_urls,
         CASE WHEN coalesce(duplicate_names, '') = '' THEN '' WHEN resource_num % 5 < 2 THEN 'do not merge' ELSE 'merge all "dup name" IDs' END AS review_dup_names
  FROM rec
), left_over AS (SELECT * FROM answered WHERE review_low_prob <> 'remove')"""


def _shared(column: str, separator: str) -> str:
    return f"""WITH {_R}, item AS (
  SELECT DISTINCT resource_num, trim(v) AS value FROM (SELECT resource_num, unnest(string_split(coalesce({column}, ''), '{separator}')) AS v FROM rec)
), grouped AS (SELECT *, min(resource_num) OVER (PARTITION BY value) AS group_id, count(*) OVER (PARTITION BY value) - 1 AS n_links FROM item WHERE value <> '')
SELECT * FROM grouped WHERE n_links > 0"""


def _merge_sql(told: str, group: str, order: str, names: str, rest: str) -> str:
    cols = ", ".join(KEPT)
    return f"""WITH {_ANSWERED}
SELECT resource_num::VARCHAR AS resource_num, {cols} FROM left_over WHERE NOT ({told})
UNION ALL
SELECT resource_num, {cols} FROM (
  SELECT {group}, string_agg(resource_num::VARCHAR, ', ' ORDER BY {order}) AS resource_num, {names}, {rest}
  FROM left_over WHERE {told} GROUP BY {group})"""


_PROB = "coalesce(try_cast(best_name_prob AS DOUBLE), 0) DESC, resource_num"
_DATE = "coalesce(try_cast(replace(publication_date, '-', '') AS BIGINT), -1) DESC, resource_num"
_list = lambda c, o: f"string_agg(coalesce({c}, ''), ', ' ORDER BY {o}) AS {c}"
_first = lambda c, o: f"list({c} ORDER BY {o})[1] AS {c}"

SQL: dict[str, str] = {
    "shared_names": _shared("best_name", ";"),
    "shared_urls": _shared("extracted_url", ","),
    "low_prob_flags": f"SELECT prediction_id, CASE WHEN best_name_prob::DOUBLE < {LEAST_PROB} THEN '{review.LOW_PROB}' ELSE '' END AS low_prob FROM predictions WHERE coalesce(best_name_prob, '') <> ''",
    "flag_totals": f"""WITH {_R}
SELECT count(*) FILTER (coalesce(duplicate_urls, '') || coalesce(duplicate_names, '') || coalesce(low_prob, '') <> '') AS any_flag, count(*) FILTER (coalesce(duplicate_urls, '') <> '') AS url_flag,
       count(*) FILTER (coalesce(duplicate_names, '') <> '') AS name_flag, count(*) FILTER (coalesce(low_prob, '') <> '') AS prob_flag FROM rec""",
    "review_violations": f"""WITH {_ANSWERED}
SELECT resource_num, 'review_low_prob' AS "column", 'unanswered' AS problem FROM answered WHERE coalesce(low_prob, '') <> '' AND review_low_prob = ''
UNION ALL SELECT resource_num, 'review_dup_urls', 'not allowed' FROM answered WHERE review_dup_urls = 'maybe'""",
    "mixed_answers": f"""WITH {_ANSWERED}
SELECT best_name, count(DISTINCT review_dup_names) AS n_instructions FROM answered WHERE coalesce(best_name, '') <> '' AND review_dup_names <> '' GROUP BY 1 HAVING count(DISTINCT review_dup_names) > 1""",
    "merged_on_url": _merge_sql("review_dup_urls = 'merge on record with best name prob'", "extracted_url", _PROB, ", ".join((_list("best_name", _PROB), _list("best_name_prob", _PROB))), _first("publication_date", _PROB)),
    "merged_on_name": _merge_sql("coalesce(duplicate_names, '') <> '' AND review_dup_names <> 'do not merge'", "best_name", _DATE, _list("best_name_prob", _DATE),
                                 ", ".join((_first("extracted_url", _DATE), _first("publication_date", _DATE)))),
    "cleaned_review": f"""WITH {_R} SELECT resource_num, replace(coalesce(duplicate_urls, ''), '.0', '') AS duplicate_urls, len(string_split(coalesce(id, ''), ','))::VARCHAR AS article_count FROM rec""",
    "regrouped_urls": f"""WITH {_R} SELECT resource_num, best_name, extracted_url, len(string_split(extracted_url, ', ')) AS n_urls FROM rec WHERE coalesce(extracted_url, '') <> ''""",
    "url_statuses": f"""WITH {_R}, single AS (
  SELECT resource_num, i - 1 AS pos, string_split(extracted_url, ', ')[i] AS url FROM rec, generate_series(1, len(string_split(extracted_url, ', '))) AS g(i) WHERE coalesce(extracted_url, '') <> ''
), known AS (SELECT url, status, country FROM url_status WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY checked_at DESC, url_id DESC) = 1)
SELECT resource_num, pos::INT AS pos, url, coalesce(status, '') AS status, coalesce(country, '') AS country FROM single LEFT JOIN known USING (url)""",
    "unchecked_urls": "SELECT prediction_id FROM predictions p WHERE coalesce(extracted_url, '') <> '' AND NOT EXISTS (SELECT 1 FROM url_status s WHERE s.url = p.extracted_url)",
    "remerged_metadata": f"""WITH {_R}, ids AS (
  SELECT resource_num, i AS pos, regexp_extract_all(id, '\\d+')[i] AS id FROM rec, generate_series(1, len(regexp_extract_all(id, '\\d+'))) AS g(i)
), meta AS (SELECT * FROM article_metadata QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at) = 1)
SELECT resource_num, string_agg(ids.id, ', ' ORDER BY pos) AS ids, coalesce(string_agg(affiliation, '; ' ORDER BY pos) FILTER (affiliation <> ''), '') AS affiliation,
       coalesce(string_agg(authors, ', ' ORDER BY pos) FILTER (authors <> ''), '') AS authors, coalesce(string_agg(grant_agencies, '; ' ORDER BY pos) FILTER (grant_agencies <> ''), '') AS grant_agencies,
       coalesce(sum(num_citations), 0) AS num_citations
FROM ids LEFT JOIN meta ON ids.id = meta.id GROUP BY resource_num""",
    "archive_commands": "SELECT DISTINCT url, 'curl -X POST -d url=' || url || ' https://web.archive.org/save' AS command FROM url_status WHERE regexp_matches(status, '^[23]')",
}
