"""The same operators on streams: row-wise stages as they are, merges batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioforge.functions import text
from biblioforge.operators import merge


def read_stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 16) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def clean_stream(articles: DataFrame) -> DataFrame:
    """Articles of a stream or a table with markup stripped and their addresses listed; no state is kept."""
    parts = [text.strip_newlines(text.strip_markup(F.coalesce(F.col(c), F.lit("")))) for c in ("title", "abstract")]
    clean = articles.where("coalesce(id, '') <> ''").withColumn("title_abstract", text.title_abstract(*parts))
    return clean.withColumn("extracted_url", text.join_list(text.url_list(F.col("title_abstract"))))


def first_deliveries(articles: DataFrame, received: str = "received_at", late: str = "30 days") -> DataFrame:
    """Each id of a stream once, repeats dropped as long as they are at most so late."""
    return articles.withWatermark(received, late).dropDuplicatesWithinWatermark(["id"])


def arrivals(articles: DataFrame, received: str = "received_at", late: str = "30 days", window: str = "30 days") -> DataFrame:
    """Articles that came in, by window of their arrival."""
    return articles.withWatermark(received, late).groupBy(F.window(received, window)).agg(F.count(F.lit(1)).alias("n_articles"))


def merge_batch(previous: DataFrame | None, batch: DataFrame) -> DataFrame:
    """A merged inventory (best_name, extracted_url, article_count, ids, publication_date) with a batch of records merged in."""
    order = [merge.descending(F.col("publication_date")), F.col("id")]
    fresh = batch.withColumn("extracted_url", text.clean_url(F.coalesce("extracted_url", F.lit("")))).withColumn("best_name", F.coalesce("best_name", F.lit("")))
    fresh = fresh.groupBy("best_name", "extracted_url").agg(
        F.count(F.lit(1)).alias("article_count"), merge.ordered_join(F.col("id"), order).alias("ids"), F.max("publication_date").alias("publication_date"))
    if previous is None:
        return fresh
    both = previous.withColumn("__old", F.lit(1)).unionByName(fresh.withColumn("__old", F.lit(0)))
    return both.groupBy("best_name", "extracted_url").agg(
        F.sum("article_count").alias("article_count"), merge.ordered_join(F.col("ids"), [F.col("__old")]).alias("ids"), F.max("publication_date").alias("publication_date"))


def merge_stream(stream: DataFrame, folder: str, checkpoint: str, done: Callable[[int], None] | None = None):
    """Keep an inventory up to date with a stream: version N is written from version N - 1 and batch N, so a repeated batch does no harm."""
    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        previous = spark.read.parquet(f"{folder}/version={n - 1}") if n else None
        merge_batch(previous, batch).write.mode("overwrite").parquet(f"{folder}/version={n}")
        if done:
            done(n)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
