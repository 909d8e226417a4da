"""Encoding a corpus with a public tokenizer through a table of its distinct words.

A byte-level BPE merges only inside the words its pattern cuts a text into. So texts are
cut into words in Spark, each distinct word is encoded once, and the ids are joined back
to the words by position: those of frequent words in place, from a broadcast part of the
word table whose size is bounded, those of rare words through a shuffle of just these.

Defined results: NULL and empty texts give an empty list; a blank text gives the ids of
its blanks; texts of any length are taken whole; strings of special tokens are ordinary
text; a document id occurring with several texts gives one row for each of them, with the
same text twice two rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioforge.operators.skew import join_unique
from biblioforge.session import cut, keep

#: Folder of the public vocabularies and the default vocabulary (a rank file).
TOKENIZER_DIR = os.environ.get("BIBLIOFORGE_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern of the byte-level vocabularies. (?U) makes white space mean Unicode's.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word table of at most so many bytes is broadcast whole; of a larger one, only words with more than
#: this share of all occurrences (at most 1 / share words), while the others are joined through a shuffle.
BROADCAST_BYTES, FREQUENT_SHARE = 6 << 20, 2e-5


def words(text: Column) -> Column:
    """The words of a text in order."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


_sent: set[tuple[str, str]] = set()


def send(spark: SparkSession, path: str) -> str:
    """Send a vocabulary file to the workers, which need not have it, once for each application; gives the name they know it by."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent:
        _sent.add(key)
        spark.sparkContext.addFile(path)
    return os.path.basename(path)


@lru_cache(maxsize=4)
def _encoding(path: str):
    """The encoding of a vocabulary file, or of one that was sent under this name."""
    import tiktoken
    from pyspark import SparkFiles

    path = path if os.path.isabs(path) else SparkFiles.get(path)
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def word_table(occurrences: DataFrame, path: str) -> DataFrame:
    """(word, n, ids) of each distinct word, encoded once. ``n`` counts its occurrences."""

    name = send(occurrences.sparkSession, path)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(name)
        for batch in batches:
            yield batch.assign(ids=[encoding.encode_ordinary(w) for w in batch["word"]])

    distinct = occurrences.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return cut(distinct.mapInPandas(encode, "word string, n long, ids array<int>"))


def with_ids(occurrences: DataFrame, table: DataFrame, value: Column) -> DataFrame:
    """``occurrences`` with ``value`` of each word's row as ``found``; every word is in the table.

    A word that makes up a large part of all text is never sent to one task.
    """
    size, total = table.agg(F.sum(F.octet_length("word") + 4 * F.size("ids") + 24), F.sum("n")).first()
    table = table.select("word", "n", value.alias("found"))
    if (size or 0) <= BROADCAST_BYTES:
        return occurrences.join(F.broadcast(table.drop("n")), "word", "left").drop("word")
    frequent = F.broadcast(table.where(F.col("n") > total * FREQUENT_SHARE).drop("n").withColumn("is_frequent", F.lit(True)))
    joined = occurrences.join(frequent, "word", "left")
    # Empty texts have no word; they stay with the frequent words.
    known = joined.where("is_frequent or word is null").drop("is_frequent", "word")
    rare = joined.where("is_frequent is null and word is not null").drop("is_frequent", "found")
    return known.unionByName(rare.join(table.where(F.col("n") <= total * FREQUENT_SHARE).drop("n"), "word").drop("word"))


def occurrences_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, pos, word), with one row without word for a text without any."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode_outer(words(F.col(text))).alias("pos", "word"))


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document."""
    spark = docs.sparkSession
    split = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("words"))
    # An outer explode, as the inner one would split each text once more to filter it before.
    table = word_table(split.select(F.explode_outer("words").alias("word")).where("word is not null"), path or f"{TOKENIZER_DIR}/{BYTE_BPE}")
    size, total = table.agg(F.sum(F.octet_length("word") + 4 * F.size("ids") + 24), F.sum("n")).first()
    whole = (size or 0) <= BROADCAST_BYTES
    frequent = table if whole else table.where(F.col("n") > total * FREQUENT_SHARE)
    sent = spark.sparkContext.broadcast({r["word"]: np.array(r["ids"], np.int32) for r in frequent.select("word", "ids").toLocalIterator()})
    none = np.zeros(0, np.int32)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for batch in batches:
            ids, rare = [], []
            for found in batch["words"]:
                found = () if found is None else found
                parts = [known.get(w) for w in found]
                # The id -1 - i stands where the i-th rare word of the document stands.
                missing = [i for i, p in enumerate(parts) if p is None]
                for i, at in enumerate(missing):
                    parts[at] = np.array([-1 - i], np.int32)
                ids.append(np.concatenate(parts) if parts else none)
                rare.append([found[i] for i in missing])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "rare": rare})

    kind = split.schema["doc_id"].dataType.simpleString()
    placed = split.mapInPandas(place, f"doc_id {kind}, ids array<int>, rare array<string>")
    if whole:
        return placed.select("doc_id", "ids")
    placed = keep(placed.select(F.monotonically_increasing_id().alias("row"), "*"))
    open_ = placed.where(F.size("rare") > 0)
    words_ = open_.select("row", F.posexplode("rare").alias("pos", "word"))
    words_ = join_unique(words_, table.where(F.col("n") <= total * FREQUENT_SHARE).select("word", F.col("ids").alias("found")), ["word"])
    lists = words_.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "found"))).alias("lists"))
    filled = F.flatten(F.transform("ids", lambda i: F.when(i < 0, F.col("lists")[-1 - i]["found"]).otherwise(F.array(i))))
    return placed.where(F.size("rare") == 0).select("doc_id", "ids").unionByName(open_.join(lists, "row").select("doc_id", filled.alias("ids")))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every document, from the same word table without putting ids together."""
    occurrences = occurrences_of(docs, doc_id, text)
    table = word_table(occurrences.select("word").where("word is not null"), path or f"{TOKENIZER_DIR}/{BYTE_BPE}")
    found = with_ids(occurrences.drop("pos"), table, F.size("ids"))
    return found.groupBy("doc_id").agg(F.coalesce(F.sum("found"), F.lit(0)).cast("long").alias("n_tokens"))


def piece_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, piece): the bytes of each id in hexadecimal. A vocabulary is of fixed size."""
    ranks = _ranks(path or f"{TOKENIZER_DIR}/{BYTE_BPE}")
    return spark.createDataFrame(pd.DataFrame({"id": list(ranks.values()), "piece": [p.hex() for p in ranks]}), "id int, piece string")


def decode_corpus(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids) through a join of ids with their pieces."""
    placed = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    found = placed.join(F.broadcast(piece_table(encoded.sparkSession, path)), "id", "left")
    piece = F.when(F.col("pos").isNotNull(), F.struct("pos", "piece"))
    lists = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(piece)).alias("placed"))
    joined = F.array_join(F.transform("placed", lambda p: p["piece"]), "")
    return lists.select("doc_id", F.decode(F.unhex(joined), "UTF-8").alias("text"))
