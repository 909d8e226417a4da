"""Queries of problem 4: inventory records and registry records of one resource."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioforge.llm import matching as m
from biblioforge.llm import resources
from biblioforge.operators.skew import join_unique
from biblioforge.session import cut, load, release

#: The least confidence of a match, and the share that is added to a word's shares in both sources before they are compared.
LEAST, KIND_SHARE = 0.5, 1e-3


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the inventory and the two registries, a record delivered again once."""
    inventory = load(spark, sf_dir, "inventory").select(
        F.lit("inventory").alias("source"), F.col("resource_num").cast("string").alias("key"),
        F.array("inv_name", "inv_comm_name", "inv_full_name").alias("names"), F.col("inv_url").alias("address"))
    re3data = load(spark, sf_dir, "re3data_repositories").select(
        F.lit("re3data").alias("source"), F.col("re3data_id").alias("key"), F.array("repositoryname").alias("names"), F.col("repositoryurl").alias("address"))
    fairsharing = load(spark, sf_dir, "fairsharing_records").select(
        F.lit("fairsharing").alias("source"), F.col("fs_id").alias("key"), F.array("fs_name").alias("names"), F.col("fs_url").alias("address"))
    every = inventory.unionByName(re3data).unionByName(fairsharing).where("key is not null").dropDuplicates(["source", "key"])
    return read_records(every)


def read_records(records: DataFrame) -> DataFrame:
    """(rid, source, key, first, record) of (source, key, names, address): the records with any name or address, read, numbered and packed."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [resources.read(tuple(names), address) for names, address in zip(batch["names"], batch["address"])]
            batch = batch[["source", "key"]].assign(first=batch["source"] == "inventory", record=[m.pack(r) for r in found])
            yield batch[[bool(r.tokens) for r in found]]

    # The numbers are kept with the records, so that they stay the same whatever is computed again later.
    return cut(records.mapInPandas(read, "source string, key string, first boolean, record string").select(F.monotonically_increasing_id().alias("rid"), "*"))


def token_stats(records: DataFrame) -> m.Stats:
    """The statistics of tokens over all (unpacked) records."""
    total = records.count()
    counts = records.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    usual = counts.where((F.col("n") > 1) & (F.col("n") > m.RARE * total)).collect()
    weight = {r["token"]: max(0.02, min(1.0, math.log(total / r["n"]) / math.log(1 / m.RARE))) for r in usual}
    common = frozenset(r["token"] for r in usual if r["n"] >= m.COMMON * total and r["n"] > 2)
    return m.Stats(total, weight, common, frozenset(r["token"] for r in usual if r["n"] > m.FREQUENT))


def with_holders(records: DataFrame) -> DataFrame:
    """(rid, record) of the first source, with the number of its records that hold each short name added to the packed record."""
    first = records.where("first").select("rid", F.posexplode("shorts").alias("pos", "token"))
    held = first.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")
    held = join_unique(first, held, ["token"]).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("pos", "n"))).alias("held"))
    counted = F.transform("shorts", lambda s, i: F.coalesce(F.try_element_at("held", i.cast("int")), F.lit(1)).cast("string"))
    told = records.where("first").select("rid", "record", "shorts").join(held, "rid", "left")
    return told.select("rid", F.concat_ws(m.ATTRIBUTE, "record", F.when(F.col("held").isNotNull(), F.array_join(counted, m.TOKEN))).alias("record"))


def with_kind(records: DataFrame) -> DataFrame:
    """(rid, source, record, kind) of the other sources.

    ``kind``: the log-ratio of the shares that the first and the other sources have of the word of the name (short names aside)
    that is least usual in the first one, which tells bodies of another kind.
    """
    sizes = {r["first"]: r["count"] for r in records.groupBy("first").count().collect()}
    words = records.select("first", F.explode("plain").alias("word")).groupBy("word").agg(F.count_if("first").alias("a"), F.count_if(~F.col("first")).alias("b"))
    # Words in this share of the other sources: at most (words of a name / share) of them.
    usual = words.where((F.col("b") > 0) & (F.col("b") >= m.COMMON * sizes.get(False, 0))).collect()
    ratio = {r["word"]: math.log((r["a"] / max(1, sizes.get(True, 0)) + KIND_SHARE) / (r["b"] / sizes[False] + KIND_SHARE)) for r in usual}
    sent = records.sparkSession.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def kind(plain: pd.Series) -> pd.Series:
        return pd.Series([min((sent.value[w] for w in words if w in sent.value), default=np.nan) for words in plain], dtype=float)

    return records.where("not first").select("rid", "source", "record", kind("plain").alias("kind"))


def scored_pairs(records: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """(l, r, source and the cosines) of all pairs that meet; ``table``: vectors to use instead of trained ones."""
    records = m.unpacked(records)
    stats = token_stats(records)
    # What a step has shuffled is freed before the next one, so that the disk holds one step at a time.
    release(records.sparkSession)
    if table is None:
        table = m.train(m.walk_sentences(records), m.WALKS * stats.total)
        release(records.sparkSession)
    pairs = m.candidate_pairs(records, table, stats)
    release(records.sparkSession)
    full = pairs.join(with_holders(records).withColumnsRenamed({"rid": "l", "record": "a"}), "l")
    full = full.join(with_kind(records).withColumnsRenamed({"rid": "r", "record": "b"}), "r")
    return m.compare(full, table, stats)


def matches(records: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """(l, r, confidence) of the pairs whose calibrated cosines tell that they are one resource."""
    return m.calibrated(scored_pairs(records, table)).where(F.col("confidence") >= LEAST)


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resource_num, registry, registry_id, confidence) of each pair of records of one resource."""
    records = _records(spark, sf_dir)
    found = matches(records).join(records.where("first").select(F.col("rid").alias("l"), F.col("key").try_cast("bigint").alias("resource_num")), "l")
    found = found.join(records.where("not first").select(F.col("rid").alias("r"), F.col("source").alias("registry"), F.col("key").alias("registry_id")), "r")
    return found.select("resource_num", "registry", "registry_id", "confidence")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of an inventory record and a registry record of one resource."""
    return p4_matches(spark, sf_dir).select("resource_num", "registry", "registry_id")


QUERIES = {"p4_found": p4_found, "p4_matches": p4_matches}
SQL: dict[str, str] = {}
