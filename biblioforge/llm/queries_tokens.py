"""Queries of problems 8 and 9: token ids of the corpus and a mix of its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioforge.llm.mixing import mix
from biblioforge.llm.tokens import decode_corpus, encode_corpus, token_counts
from biblioforge.session import cut, load


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return encode_corpus(load(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids."""
    return decode_corpus(cut(encode_corpus(load(spark, sf_dir, "documents"))))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source").join(token_counts(docs), "doc_id")
    return mix(sized, load(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of the mix with the number of its copies, and the share its source is to have and has."""
    return _mixed(spark, sf_dir)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target and actual share of each source in the mix."""
    held = _mixed(spark, sf_dir).groupBy("source", "target_share", "actual_share")
    return held.agg(F.sum(F.col("n_copies") * F.col("n_tokens")).alias("mix_tokens"), F.max("n_copies").alias("most_copies"))


QUERIES = {"p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {"p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
