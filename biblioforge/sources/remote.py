"""Remote services behind injected callables: searches, metadata, address checks, archives.

No client is built in. Each operator takes a picklable callable, calls it in the Python
workers, in batches of distinct keys, and may be retried, so calls have to be idempotent.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed value: the fields of a metadata answer that are used.
ANSWER = T.StructType([
    T.StructField("pmid", T.StringType()),
    T.StructField("citedByCount", T.IntegerType()),
    T.StructField("isOpenAccess", T.StringType()),
    T.StructField("hasTextMinedTerms", T.StringType()),
    T.StructField("hasTMAccessionNumbers", T.StringType()),
    T.StructField("license", T.StringType()),
    T.StructField("authorList", T.StructType([T.StructField("author", T.ArrayType(T.StructType([
        T.StructField("fullName", T.StringType()), T.StructField("affiliation", T.StringType())])))])),
    T.StructField("grantsList", T.StructType([T.StructField("grant", T.ArrayType(T.StructType([
        T.StructField("grantId", T.StringType()), T.StructField("agency", T.StringType())])))])),
])


def check_date(text: str | None) -> str:
    """A date as YYYY, YYYY-MM or YYYY-MM-DD; today if none is given; anything else is an error."""
    text = text or date.today().isoformat()
    if not re.fullmatch(r"\d{4}(-\d{2}(-\d{2})?)?", text):
        raise ValueError(f"not a date: {text}")
    return text


def fill_query(template: str, first: str | None, last: str | None) -> str:
    """A search with its dates in the places {0} and {1}."""
    return template.format(check_date(first), check_date(last))


class PagedSource(DataSource):
    """A paged search: ``spark.read.format("paged").option("query", ...)`` after ``register_paged``.

    Pages follow each other, so one task reads them all.
    """

    fetch: Callable[[str, str | None], tuple[list[dict], str | None]] | None = None

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, title string, abstract string, publication_date string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(type(self).fetch, self.options["query"])


class _PagedReader(DataSourceReader):
    def __init__(self, fetch, query: str) -> None:
        self.fetch, self.query = fetch, query

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page: str | None = None
        while True:
            rows, page = self.fetch(self.query, page)
            for r in rows:
                yield r.get("id", ""), r.get("title", ""), r.get("abstract", ""), r.get("publication_date", "")
            if not page:
                return


def register_paged(spark: SparkSession, fetch: Callable[[str, str | None], tuple[list[dict], str | None]]) -> None:
    """Make a paged search readable; ``fetch(query, page)`` gives rows and the next page or None, or raises."""
    spark.dataSource.register(type("Paged", (PagedSource,), {"fetch": staticmethod(fetch)}))


def with_retry(call: Callable, tries: int = 3, backoff: float = 0.5) -> Callable:
    """``call`` tried again after growing pauses."""
    def tried(*args):
        for n in range(tries):
            try:
                return call(*args)
            except OSError:
                if n + 1 == tries:
                    raise
                time.sleep(backoff * 2 ** n)
    return tried


def fetch_metadata(ids: DataFrame, id_col: str, fetch: Callable[[str], list[str]], chunk: int = 20) -> DataFrame:
    """(answer): JSON answers for distinct ids, asked for in chunks joined by OR."""
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["id"].tolist()
            for lo in range(0, len(keys), chunk):
                yield pd.DataFrame({"answer": fetch(" OR ".join(keys[lo:lo + chunk]))}, dtype="object")

    distinct = ids.select(F.col(id_col).cast("string").alias("id")).where("id <> ''").distinct()
    return distinct.mapInPandas(ask, "answer string")


def flatten_metadata(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """(id, affiliation, authors, grant_ids, grant_agencies, num_citations) of JSON answers; missing parts are blank.

    Blank grant values are dropped, blank authors are kept.
    """
    rows = answers.select(F.from_json(answer, ANSWER).alias("r"))
    author, grant = F.col("r.authorList.author"), F.col("r.grantsList.grant")
    author = F.coalesce(author, F.array().cast(ANSWER["authorList"].dataType["author"].dataType))
    grant = F.coalesce(grant, F.array().cast(ANSWER["grantsList"].dataType["grant"].dataType))
    held = lambda field: F.array_join(F.filter(F.transform(grant, lambda g: F.coalesce(g[field], F.lit(""))), lambda v: v != ""), ", ")
    listed = lambda field: F.array_join(F.transform(author, lambda a: F.coalesce(a[field], F.lit(""))), ", ")
    return rows.select(
        F.col("r.pmid").alias("id"), F.coalesce(F.get(F.transform(author, lambda a: a["affiliation"]), F.lit(0)), F.lit("")).alias("affiliation"),
        listed("fullName").alias("authors"), held("grantId").alias("grant_ids"), held("agency").alias("grant_agencies"), F.coalesce("r.citedByCount", F.lit(0)).alias("num_citations"))


def funder_rows(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """(id, agency), at least one row for each answer."""
    rows = answers.select(F.from_json(answer, ANSWER).alias("r"))
    return rows.select(F.col("r.pmid").alias("id"), F.explode_outer("r.grantsList.grant").alias("g")).select("id", F.col("g.agency").alias("agency"))


def article_flags(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """(id, open_access, text_mined_terms, accession_numbers, license) of JSON answers: flags true or false, NULL where nothing is said."""
    rows = answers.select(F.from_json(answer, ANSWER).alias("r"))
    flag = lambda field: F.when(F.col(f"r.{field}") == "Y", True).when(F.col(f"r.{field}") == "N", False)
    return rows.select(F.col("r.pmid").alias("id"), flag("isOpenAccess").alias("open_access"), flag("hasTextMinedTerms").alias("text_mined_terms"),
                       flag("hasTMAccessionNumbers").alias("accession_numbers"), F.col("r.license").alias("license"))


def flags_of_resources(articles: DataFrame, flags: DataFrame, resource: str) -> DataFrame:
    """For each resource whether all, none or some (NULL if it is not known) of its articles have each flag. ``articles``: resource, id."""
    names = [c for c in flags.columns if c not in ("id", "license")]
    kind = lambda c: F.when(F.min(c).isNull(), None).when(F.min(c) == F.max(c), F.when(F.min(c), "all").otherwise("none")).otherwise("some")
    return articles.join(flags, "id", "left").groupBy(resource).agg(*[kind(c).alias(c) for c in names])


def registry_pages(spark: SparkSession, login: Callable[[], str], fetch: Callable[[str, int], list[dict]], pages: int) -> DataFrame:
    """(page, record): JSON records of a registry that wants a login; the token is asked for once, pages are fetched side by side."""
    token = login()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page in batch["page"]:
                yield pd.DataFrame({"page": page, "record": [json.dumps(r) for r in with_retry(fetch)(token, int(page))]})

    return spark.range(1, pages + 1).withColumnRenamed("id", "page").mapInPandas(read, "page long, record string")


def located_by(*services: Callable[[str], tuple[str, str]]) -> Callable[[str], tuple[str, str]]:
    """A service that takes the country and the coordinates each from the first of the services that has it."""
    def locate(url: str) -> tuple[str, str]:
        country = coordinates = ""
        for service in services:
            if not (country and coordinates):
                c, p = service(url)
                country, coordinates = country or c or "", coordinates or p or ""
        return country, coordinates

    return locate


def check_urls(urls: DataFrame, url_col: str, probe: Callable[[str], int | str], locate: Callable[[str], tuple[str, str]], tries: int = 3, backoff: float = 0.5) -> DataFrame:
    """(url, status, country, coordinates) of distinct addresses, each probed up to ``tries`` times; only those that answer below 400 are located."""
    probe = with_retry(probe, tries, backoff)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    status = probe(url)
                except OSError as e:
                    status = str(e)
                place = locate(url) if isinstance(status, int) and status < 400 else ("", "")
                rows.append((url, str(status), *place))
            yield pd.DataFrame(rows, columns=["url", "status", "country", "coordinates"])

    distinct = urls.select(F.col(url_col).alias("url")).where("url <> ''").distinct()
    return distinct.mapInPandas(check, "url string, status string, country string, coordinates string")


def find_snapshots(urls: DataFrame, url_col: str, ask: Callable[[str], tuple[int, str | None]]) -> DataFrame:
    """(url, wayback_url): a snapshot, ``no_wayback``, or a note that the archive is down."""
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [ask(u) for u in batch["url"]]
            yield batch.assign(wayback_url=["wayback is down" if code in (503, 504) else found or "no_wayback" for code, found in answers])

    return urls.select(F.col(url_col).alias("url")).where("url <> ''").distinct().mapInPandas(look, "url string, wayback_url string")


def missing_snapshots(df: DataFrame, url_cell: str, wayback_cell: str) -> DataFrame:
    """(url) of the parallel lists of two cells whose snapshot is missing."""
    zipped = F.arrays_zip(F.split(url_cell, ", ").alias("url"), F.split(wayback_cell, ", ").alias("wayback"))
    return df.select(F.inline(zipped)).where("wayback = 'no_wayback'").select("url").distinct()


def submit(urls: DataFrame, url_col: str, send: Callable[[str], None]) -> None:
    """Send each distinct address to a service; a retried task sends again."""
    def each(rows: Iterator) -> None:
        for r in rows:
            send(r["url"])

    urls.select(F.col(url_col).alias("url")).where("url <> ''").distinct().foreachPartition(each)


def score_rows(df: DataFrame, load_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """``df`` through a model that each worker loads once: batches in, scored batches out."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(score, schema)
