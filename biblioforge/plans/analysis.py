"""Descriptive queries: countries, funders, registries, model quality, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblioforge.functions import arrays, text
from biblioforge.operators import measures, merge, relational, review
from biblioforge.operators.packed import split_packed
from biblioforge.session import cut, load

SEED, FRACTIONS = 241, (0.7, 0.15, 0.15)


def mentioned_countries(rows: DataFrame, key: str, cell: str, countries: DataFrame, code: str) -> DataFrame:
    """(key, countries): the countries that a text names or whose three-letter code it holds, as often as it does, in the order of the list.

    ``code`` is the column of the list to show (codes of two or three letters, numbers or
    names). Each run of words of a text is looked up in the broadcast list of some hundred
    spellings, so a text is read once, however many countries there are.
    """
    spelled = countries.select(F.col("country_3").alias("place"), F.col(code).alias("code"), F.explode(F.array("country_name", "country_3")).alias("name"))
    spelled = spelled.select("place", "code", text.plain_words(F.col("name")).alias("words")).where(F.size("words") > 0).distinct()
    longest = spelled.agg(F.max(F.size("words"))).first()[0] or 1
    spelled = spelled.select("place", "code", F.array_join("words", " ").alias("phrase"))
    runs = rows.select(key, text.plain_words(F.col(cell)).alias("words")).select(key, F.explode_outer(text.phrases(F.col("words"), longest)).alias("phrase"))
    found = runs.join(F.broadcast(spelled), "phrase").groupBy(key, "place", "code").agg(F.count(F.lit(1)).cast("int").alias("n"))
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "code", "n"))).alias("found"))
    return lists.select(key, F.array_join(F.flatten(F.transform("found", lambda f: F.array_repeat(f["code"], f["n"]))), ", ").alias("countries"))


def _countries_named(spark: SparkSession, sf_dir: str, code: str) -> DataFrame:
    rows = relational.keep_first(relational.drop_blank(load(spark, sf_dir, "article_metadata"), "id").select("id", "affiliation", "received_at"), ["id"], [F.col("received_at")])
    return mentioned_countries(rows, "id", "affiliation", load(spark, sf_dir, "ref_countries"), code)


def country_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-letter codes of the countries named in affiliations."""
    return _countries_named(spark, sf_dir, "country_3")


def country_names_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the countries named in affiliations."""
    return _countries_named(spark, sf_dir, "country_name")


def disciplinary_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry records of one class."""
    return relational.of_class(load(spark, sf_dir, "re3data_repositories").select("re3data_id", "repositoryname", "repository_type"), "repository_type", "disciplinary")


def article_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred articles drawn at random."""
    return relational.random_subset(relational.drop_blank(load(spark, sf_dir, "articles"), "id").select("id").distinct(), "id", 100, SEED)


def note_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review records whose duplicates are to be merged and are not given as a list of ids."""
    rows = load(spark, sf_dir, "review_records").where(F.trim("duplicate_names") != "").select(
        "resource_num", F.lit("merge only:").alias("review_dup_names"), F.col("duplicate_names").alias("review_notes_dup_names")).distinct()
    return review.note_violations(rows, "resource_num")


def validation_and_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best epoch of each model beside its measures over all epochs."""
    best = measures.best_rows(_stats(spark, sf_dir), ["model"], "val_f1", [F.col("epoch")]).select("model", F.col("val_f1").alias("f1"), F.col("val_loss").alias("loss"))
    test = _stats(spark, sf_dir).groupBy("model").agg(F.max("train_f1").alias("f1"), F.min("val_loss").alias("loss"))
    return measures.beside(best, test, "model", ["f1", "loss"])


def mentions_per_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and mentions of each country."""
    one = country_mentions(spark, sf_dir).select("id", F.explode(F.split("countries", ", ")).alias("country_3"))
    return one.groupBy("country_3").agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("id").alias("n_articles"))


def hosts_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of each country as typed, some names under one."""
    rows = load(spark, sf_dir, "url_status").select(F.trim("country").alias("country"), "url")
    rows = rows.where("country <> ''")
    name = F.when(F.col("country").isin("USA", "U.S.A.", "US", "United States of America"), "United States").when(F.col("country").isin("UK", "England"), "United Kingdom").otherwise(F.col("country"))
    return rows.groupBy(name.alias("country")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("url").alias("n_urls"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latitude and longitude of each address that has them."""
    rows = relational.drop_blank(load(spark, sf_dir, "url_status"), "coordinates").select("url_id", F.regexp_replace("coordinates", "[()]|,\\s*$", "").alias("c")).distinct()
    parts = F.split("c", ",")
    return rows.select("url_id", F.get(parts, F.lit(0)).try_cast("double").alias("lat"), F.get(parts, F.lit(1)).try_cast("double").alias("long")).where("lat is not null and long is not null")


def status_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the addresses of each host answered: yes, no or both."""
    rows = relational.drop_blank(load(spark, sf_dir, "url_status"), "url").where("status is not null")
    rows = rows.select(text.domain(F.col("url")).alias("host"), F.when(F.col("status").rlike("^[23]"), "yes").otherwise("no").alias("up"))
    sets = rows.groupBy("host").agg(F.min("up").alias("a"), F.max("up").alias("b"))
    return sets.select("host", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("both").alias("answers"))


def status_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of each kind and their percentage."""
    kinds = status_kinds(spark, sf_dir).groupBy("answers").agg(F.count(F.lit(1)).alias("n_hosts"))
    total = kinds.agg(F.sum("n_hosts").alias("total"))
    return kinds.crossJoin(F.broadcast(total)).select("answers", "n_hosts", F.round(F.col("n_hosts") * 100.0 / F.col("total"), 6).alias("percent"))


def _agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, agency): the agencies of each article, one by one."""
    cells = load(spark, sf_dir, "article_metadata").select("id", "grant_agencies").where("id <> ''").distinct()
    return split_packed(cells, ["id"], "grant_agencies", "name").select("id", F.col("item_value").alias("agency"))


def funder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, articles and resources of each agency."""
    found = _agencies(spark, sf_dir)
    held = load(spark, sf_dir, "review_records").select("resource_num", F.explode(F.regexp_extract_all("id", F.lit("\\d+"), F.lit(0))).alias("id")).distinct()
    per = found.join(held, "id", "left").groupBy("agency")
    return per.agg(F.countDistinct("id").alias("n_articles"), F.countDistinct("resource_num").alias("n_resources"))


def funded_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many articles have a funder; the most and the mean number of articles of a funder."""
    agencies = cut(_agencies(spark, sf_dir))
    per = agencies.groupBy("agency").agg(F.countDistinct("id").alias("n"))
    stats = per.agg(F.max("n").alias("most_articles"), F.round(F.avg("n"), 9).alias("mean_articles"), F.count(F.lit(1)).alias("n_agencies"))
    return stats.crossJoin(agencies.agg(F.countDistinct("id").alias("n_funded")))


def country_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of each country's funders over all batches, beside the number of agencies of each batch."""
    rows = load(spark, sf_dir, "funders_geo_counts").select("batch_no", "country", "country_3", "count_agencies", F.regexp_replace("biodata_resource_names", '[" ]', "").alias("r"))
    names = rows.select("country", F.explode(F.split("r", ",")).alias("name")).where("name <> ''").distinct()
    lists = names.groupBy("country").agg(F.count(F.lit(1)).cast("int").alias("n_resources"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("resources"))
    return rows.join(lists, "country", "left").select("batch_no", "country", "country_3", "count_agencies", F.coalesce("n_resources", F.lit(0)).alias("n_resources"), F.coalesce("resources", F.lit("")).alias("resources"))


def _key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, key): normalised names and addresses of the inventory and the two registries, each once."""
    inventory = load(spark, sf_dir, "inventory").select(F.lit("inventory").alias("source"), F.explode(F.array(
        F.lower(F.trim("inv_comm_name")), F.lower(F.trim("inv_full_name")), text.registry_url(F.coalesce("inv_url", F.lit(""))))).alias("key"))
    one = load(spark, sf_dir, "re3data_repositories").select(F.lit("re3data").alias("source"), F.explode(F.array(
        F.lower(F.trim("repositoryname")), text.registry_url(F.coalesce("repositoryurl", F.lit("")), False))).alias("key"))
    two = load(spark, sf_dir, "fairsharing_records").select(F.lit("fairsharing").alias("source"), F.explode(F.array(
        F.lower(F.trim("fs_name")), text.registry_url(F.coalesce("fs_url", F.lit("")), False))).alias("key"))
    return inventory.unionByName(one).unionByName(two).where("key <> ''").distinct()


def venn_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names and addresses each set of sources has in common, exclusively."""
    flags = _key_sets(spark, sf_dir).groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))
    return flags.groupBy("sources").agg(F.count(F.lit(1)).alias("n_keys"))


def registry_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory records with the exact name or address of a registry record."""
    inv = load(spark, sf_dir, "inventory").select("resource_num", F.explode(F.array(
        F.lower(F.trim("inv_comm_name")), F.lower(F.trim("inv_full_name")), text.registry_url(F.coalesce("inv_url", F.lit(""))))).alias("key")).where("key <> ''")
    keys = _key_sets(spark, sf_dir).where("source <> 'inventory'")
    return inv.join(keys, "key").groupBy("resource_num").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("registries"))


def life_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of the life sciences that are not institutional alone."""
    rows = load(spark, sf_dir, "re3data_repositories").where(F.col("subject").contains("Life") & (F.col("repository_type") != "institutional"))
    return rows.select("re3data_id", F.explode(F.split("subject", "_AND_")).alias("subject")).distinct()


def split_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles split for training, validation and test at exact sizes."""
    rows = relational.drop_blank(load(spark, sf_dir, "articles"), "id").select("id").distinct()
    return relational.split_by_rank(rows, "id", FRACTIONS, SEED)


def chunked_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles in ten chunks of nearly the same size."""
    rows = relational.drop_blank(load(spark, sf_dir, "articles"), "id").select("id").distinct()
    return relational.chunk_ids(rows, "id", 10)


def prediction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a country goes with an address that answers, as a prediction."""
    rows = load(spark, sf_dir, "url_status").select(F.col("status").rlike("^[23]").alias("truth"), (F.trim("country") != "").alias("predicted"))
    rows = rows.select(F.coalesce("truth", F.lit(False)).alias("truth"), F.coalesce("predicted", F.lit(False)).alias("predicted"))
    return measures.binary_measures(rows, F.col("truth"), F.col("predicted"))


def entity_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-entity quality of tags that miss every word of four letters, on documents' words."""
    rows = load(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S")).select(F.split(F.trim("text"), "\\s+").alias("w"))
    capital = lambda w: w.rlike("^[A-Z]")
    truth = F.transform("w", lambda w, i: F.when(capital(w) & (i > 0) & capital(F.get(F.col("w"), F.greatest(i - 1, F.lit(0)))), "I-N").when(capital(w), "B-N").otherwise("O"))
    guess = F.transform("truth", lambda t, i: F.when(F.length(F.get(F.col("w"), i)) == 4, "O").otherwise(t))
    tagged = rows.select("w", truth.alias("truth")).select("truth", guess.alias("guess"))
    return measures.entity_measures(tagged, "truth", "guess").select("tp", "fp", "fn", F.round("f1", 9).alias("f1"))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of models by epoch, made of shipped quantities: a model is a return flag and line status."""
    rows = load(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("model"), F.month("l_shipdate").alias("epoch"), "l_discount", "l_tax", "l_quantity")
    return rows.groupBy("model", "epoch").agg(
        F.round(F.avg("l_discount"), 6).alias("val_f1"), F.round(F.avg("l_tax"), 6).alias("train_f1"), F.round(F.avg("l_quantity"), 6).alias("val_loss"), F.round(F.max("l_tax"), 6).alias("train_loss"))


def best_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epoch of the best score of each model, the first of equals."""
    return measures.best_rows(_stats(spark, sf_dir), ["model"], "val_f1", [F.col("epoch")]).select("model", "epoch", "val_f1", text.significant(F.col("val_loss")).alias("val_loss"))


def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of the best epoch."""
    best = measures.best_rows(_stats(spark, sf_dir), ["model"], "val_f1", [F.col("epoch")])
    return measures.best_model(best, "val_f1", "val_loss").select("model", "epoch", "val_f1", "val_loss")


def metrics_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures by model, epoch and dataset."""
    return measures.metrics_long(_stats(spark, sf_dir), ["model", "epoch"], ["train_f1", "train_loss", "val_f1", "val_loss"])


def us_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication dates typed the American way, read back."""
    rows = relational.drop_blank(load(spark, sf_dir, "articles"), "publication_date").where(F.col("publication_date").rlike("^\\d{4}-\\d{2}-\\d{2}$")).select("id", "publication_date").distinct()
    part = lambda a, n: F.substring("publication_date", a, n).cast("int").cast("string")
    return rows.select("id", text.us_date(F.concat_ws("/", part(6, 2), part(9, 2), part(1, 4))).alias("publication_date"))


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON properties of events as columns, summed by type."""
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    rows = load(spark, sf_dir, "events").select("event_type", F.from_json("props", schema)["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest"))


def resources_per_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of review records that have metadata or not: a full outer join on the id."""
    held = load(spark, sf_dir, "review_records").select(F.explode(F.regexp_extract_all("id", F.lit("\\d+"), F.lit(0))).alias("id"), "resource_num").distinct()
    held = held.groupBy("id").agg(F.min("resource_num").alias("resource_num"))
    meta = load(spark, sf_dir, "article_metadata").where("id <> ''").groupBy("id").agg(F.max("num_citations").alias("num_citations"))
    both = held.join(meta, "id", "full")
    kind = F.when(F.col("resource_num").isNull(), "metadata only").when(F.col("num_citations").isNull(), "no citations known").otherwise("both")
    return both.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_articles"), F.coalesce(F.sum("num_citations"), F.lit(0)).alias("citations"))


def named_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first prediction of each article that has a name of either kind, with the kinds it has."""
    rows = load(spark, sf_dir, "predictions").select("id", "prediction_id", F.coalesce("common_name", F.lit("")).alias("c"), F.coalesce("full_name", F.lit("")).alias("f"))
    first = relational.keep_first(rows.where("not (c = '' and f = '')"), ["id"], [F.col("prediction_id")])
    return first.select("id", "prediction_id", F.when(F.col("c") == "", "full").when(F.col("f") == "", "common").otherwise("both").alias("kinds"))


def answering_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different addresses of each status class."""
    rows = relational.drop_blank(load(spark, sf_dir, "url_status"), "url").where(F.col("status").rlike("^[2-5]"))
    return rows.groupBy(F.concat(F.substring("status", 1, 1), F.lit("xx")).alias("status_class")).agg(F.countDistinct("url").alias("n_urls"))


def funders_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated agencies of every listed country, also of those without any."""
    agencies = load(spark, sf_dir, "curated_funders").select("agency_id", "country_3")
    countries = F.broadcast(load(spark, sf_dir, "ref_countries").select("country_3", "country_name"))
    counts = agencies.groupBy("country_3").agg(F.count(F.lit(1)).alias("n"))
    return countries.join(counts, "country_3", "left").select("country_3", F.initcap("country_name").alias("country_name"), F.coalesce("n", F.lit(0)).alias("n_agencies"))


def sentence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each sentence of each document with their places, one row for a sentence."""
    rows = load(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S"))
    split = rows.select("doc_id", F.posexplode(arrays.sentence_list(F.col("text"))).alias("sent_idx", "sentence"))
    words = arrays.word_list(F.col("sentence"))
    return split.select("doc_id", "sent_idx", F.array_join(F.transform(words, lambda w, i: i.cast("string")), ",").alias("word_idx"), F.array_join(words, " ").alias("words"))


QUERIES = {f.__name__: f for f in (
    country_mentions, country_names_mentioned, disciplinary_repositories, article_subset, note_violations, validation_and_test, mentions_per_country, hosts_by_country, coordinates, status_kinds, status_shares, funder_summary, funded_articles, country_rollup, venn_counts,
    registry_overlap, life_repositories, split_articles, chunked_articles, prediction_quality, entity_quality, best_epochs, best_model, metrics_by_dataset, us_dates,
    event_properties, resources_per_article, named_predictions, answering_hosts, funders_by_country, sentence_tokens)}

_PADDED = "' ' || replace(trim(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' ', '  ') || ' '"
_MENTIONS = f"""
WITH meta AS (
  SELECT id, {_PADDED.format("coalesce(affiliation, '')")} AS p FROM article_metadata WHERE coalesce(id, '') <> ''
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at) = 1
), names AS (
  SELECT country_3, country_name, {_PADDED.format("country_name")} AS w FROM ref_countries UNION SELECT country_3, country_name, {_PADDED.format("country_3")} FROM ref_countries
), counted AS (
  SELECT id, country_3, country_name, sum(((length(p) - length(replace(p, w, ''))) / length(w))::INT)::INT AS n FROM meta, names WHERE contains(p, w) GROUP BY ALL
)"""
_TRIM = "regexp_replace({0}, '^ +| +$', '', 'g')"
_WS = "[ \\t\\n\\x0B\\f\\r]+"
_HOST = "regexp_replace(regexp_replace(url, 'https?://', '', 'g'), '(?s)/.*', '')"
_KINDS = f"""
WITH kinds AS (
  SELECT {_HOST} AS host, min(CASE WHEN regexp_matches(status, '^[23]') THEN 'yes' ELSE 'no' END) AS a, max(CASE WHEN regexp_matches(status, '^[23]') THEN 'yes' ELSE 'no' END) AS b
  FROM url_status WHERE coalesce(url, '') <> '' AND status IS NOT NULL GROUP BY 1
), named AS (SELECT host, CASE WHEN a = b THEN a ELSE 'both' END AS answers FROM kinds)"""
_STATS = """
WITH stats AS (
  SELECT l_returnflag || l_linestatus AS model, month(l_shipdate)::INT AS epoch, round(avg(l_discount), 6) AS val_f1, round(avg(l_tax), 6) AS train_f1,
         round(avg(l_quantity), 6) AS val_loss, round(max(l_tax), 6) AS train_loss FROM lineitem GROUP BY 1, 2
), best AS (SELECT * FROM stats QUALIFY row_number() OVER (PARTITION BY model ORDER BY val_f1 DESC, epoch) = 1)"""


def _registry(c: str) -> str:
    return f"lower(regexp_replace(regexp_replace(trim(coalesce({c}, '')), '^https?://(?:www.)?', ''), '/$', ''))"


_KEYS = f"""
WITH inv AS (
  SELECT resource_num, unnest([lower(trim(inv_comm_name)), lower(trim(inv_full_name)), {_registry("split_part(inv_url, ',', 1)")}]) AS key FROM inventory
), keys AS (
  SELECT DISTINCT * FROM (
    SELECT 'inventory' AS source, key FROM inv
    UNION ALL SELECT 're3data', unnest([lower(trim(repositoryname)), {_registry('repositoryurl')}]) FROM re3data_repositories
    UNION ALL SELECT 'fairsharing', unnest([lower(trim(fs_name)), {_registry('fs_url')}]) FROM fairsharing_records) WHERE key <> ''
)"""

SQL: dict[str, str] = {
    "country_names_mentioned": _MENTIONS + " SELECT id, string_agg(array_to_string(list_resize([]::VARCHAR[], n, country_name), ', '), ', ' ORDER BY country_3) AS countries FROM counted GROUP BY id",
    "disciplinary_repositories": "SELECT re3data_id, repositoryname FROM re3data_repositories WHERE repository_type = 'disciplinary'",
    "article_subset": f"SELECT id FROM (SELECT DISTINCT id FROM articles WHERE coalesce(id, '') <> '') ORDER BY md5('{SEED}:' || id), id LIMIT 100",
    "note_violations": """
SELECT DISTINCT resource_num, trim(duplicate_names) AS note FROM review_records
WHERE trim(duplicate_names) <> '' AND NOT regexp_matches(trim(duplicate_names), '^[0-9]+([ \\t\\n\\x0B\\f\\r]*,[ \\t\\n\\x0B\\f\\r]*[0-9]+)*$')""",
    "validation_and_test": _STATS + """, test AS (SELECT model, max(train_f1) AS f1, min(val_loss) AS loss FROM stats GROUP BY 1)
SELECT best.model, val_f1, best.val_loss, test.f1 AS test_f1, test.loss AS test_loss FROM best JOIN test ON best.model = test.model""",
    "sentence_tokens": f"""
WITH split AS (
  SELECT doc_id, string_split(regexp_replace({_TRIM.format('text')}, '([.?!]){_WS}', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]')
), one AS (
  SELECT doc_id, sent_idx, string_split_regex({_TRIM.format('sentence')}, '{_WS}') AS w FROM (SELECT doc_id, unnest(range(0, len(s)))::INT AS sent_idx, unnest(s) AS sentence FROM split)
)
SELECT doc_id, sent_idx, array_to_string(range(0, len(w)), ',') AS word_idx, array_to_string(w, ' ') AS words FROM one""",
    "country_mentions": _MENTIONS + " SELECT id, string_agg(array_to_string(list_resize([]::VARCHAR[], n, country_3), ', '), ', ' ORDER BY country_3) AS countries FROM counted GROUP BY id",
    "mentions_per_country": _MENTIONS + " SELECT country_3, sum(n)::BIGINT AS n_mentions, count(*) AS n_articles FROM counted GROUP BY 1",
    "hosts_by_country": """
SELECT CASE WHEN c IN ('USA', 'U.S.A.', 'US', 'United States of America') THEN 'United States' WHEN c IN ('UK', 'England') THEN 'United Kingdom' ELSE c END AS country,
       count(*) AS n_rows, count(DISTINCT url) AS n_urls FROM (SELECT trim(country) AS c, url FROM url_status) WHERE c <> '' GROUP BY 1""",
    "coordinates": """
SELECT DISTINCT url_id, try_cast(split_part(c, ',', 1) AS DOUBLE) AS lat, try_cast(split_part(c, ',', 2) AS DOUBLE) AS long
FROM (SELECT url_id, regexp_replace(coordinates, '[()]|,\\s*$', '', 'g') AS c FROM url_status WHERE coalesce(coordinates, '') <> '')
WHERE try_cast(split_part(c, ',', 1) AS DOUBLE) IS NOT NULL AND try_cast(split_part(c, ',', 2) AS DOUBLE) IS NOT NULL""",
    "status_kinds": _KINDS + " SELECT host, answers FROM named",
    "status_shares": _KINDS + " SELECT answers, count(*) AS n_hosts, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM named GROUP BY 1",
    "country_rollup": """
WITH rows AS (SELECT *, regexp_replace(biodata_resource_names, '[" ]', '', 'g') AS r FROM funders_geo_counts), names AS (
  SELECT DISTINCT country, n FROM (SELECT country, unnest(string_split(r, ',')) AS n FROM rows) WHERE n <> ''
), lists AS (SELECT country, count(*)::INT AS n_resources, string_agg(n, ', ' ORDER BY n) AS resources FROM names GROUP BY 1)
SELECT batch_no, rows.country, country_3, count_agencies, coalesce(n_resources, 0) AS n_resources, coalesce(resources, '') AS resources FROM rows LEFT JOIN lists ON rows.country = lists.country""",
    "venn_counts": _KEYS + " SELECT sources, count(*) AS n_keys FROM (SELECT key, string_agg(source, '+' ORDER BY source) AS sources FROM keys GROUP BY key) GROUP BY 1",
    "registry_overlap": _KEYS + """ SELECT resource_num, string_agg(DISTINCT source, ', ' ORDER BY source) AS registries FROM inv JOIN keys ON inv.key = keys.key WHERE inv.key <> '' AND source <> 'inventory' GROUP BY 1""",
    "life_repositories": "SELECT DISTINCT re3data_id, unnest(string_split(subject, '_AND_')) AS subject FROM re3data_repositories WHERE contains(subject, 'Life') AND repository_type <> 'institutional'",
    "split_articles": f"""
WITH ranked AS (
  SELECT id, row_number() OVER (ORDER BY md5('{SEED}:' || id), id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM articles WHERE coalesce(id, '') <> '')
), sized AS (SELECT *, ceil(n * 0.3) AS held, ceil(ceil(n * 0.3) * 0.5) AS test FROM ranked)
SELECT id, CASE WHEN r <= n - held THEN 'train' WHEN r <= n - test THEN 'val' ELSE 'test' END AS split FROM sized""",
    "chunked_articles": "SELECT id, (ntile(10) OVER (ORDER BY id) - 1)::INT AS chunk FROM (SELECT DISTINCT id FROM articles WHERE coalesce(id, '') <> '')",
    "prediction_quality": """
WITH c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM (
  SELECT coalesce(regexp_matches(status, '^[23]'), false) AS t, coalesce(trim(country) <> '', false) AS p FROM url_status))
SELECT tp, fp, fn, 0.0::DOUBLE AS loss, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c""",
    "best_epochs": _STATS + " SELECT model, epoch, val_f1, round(val_loss * pow(10, 2 - floor(log10(abs(val_loss))))) / pow(10, 2 - floor(log10(abs(val_loss)))) AS val_loss FROM best",
    "best_model": _STATS + " SELECT model, epoch, val_f1, val_loss FROM best ORDER BY val_f1 DESC, val_loss LIMIT 1",
    "metrics_by_dataset": _STATS + " SELECT model, epoch, 'train' AS dataset, train_f1 AS f1, train_loss AS loss FROM stats UNION ALL SELECT model, epoch, 'val', val_f1, val_loss FROM stats",
    "us_dates": "SELECT DISTINCT id, publication_date FROM articles WHERE regexp_matches(publication_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')",
    "named_predictions": """
SELECT id, prediction_id, CASE WHEN coalesce(common_name, '') = '' THEN 'full' WHEN coalesce(full_name, '') = '' THEN 'common' ELSE 'both' END AS kinds
FROM predictions WHERE coalesce(common_name, '') <> '' OR coalesce(full_name, '') <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY prediction_id) = 1""",
    "answering_hosts": "SELECT left(status, 1) || 'xx' AS status_class, count(DISTINCT url) AS n_urls FROM url_status WHERE coalesce(url, '') <> '' AND regexp_matches(status, '^[2-5]') GROUP BY 1",
    "funders_by_country": """
SELECT r.country_3, array_to_string(list_transform(string_split(lower(country_name), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS country_name, coalesce(n, 0) AS n_agencies
FROM ref_countries r LEFT JOIN (SELECT country_3, count(*) AS n FROM curated_funders GROUP BY 1) c ON r.country_3 = c.country_3""",
    "event_properties": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS largest FROM (SELECT event_type, (props->>'k')::INT AS k FROM events) GROUP BY 1",
    "resources_per_article": """
WITH held AS (SELECT id, min(resource_num) AS resource_num FROM (SELECT unnest(regexp_extract_all(id, '\\d+')) AS id, resource_num FROM review_records) GROUP BY 1),
meta AS (SELECT id, max(num_citations) AS c FROM article_metadata WHERE id <> '' GROUP BY 1)
SELECT CASE WHEN resource_num IS NULL THEN 'metadata only' WHEN c IS NULL THEN 'no citations known' ELSE 'both' END AS kind, count(*) AS n_articles, coalesce(sum(c), 0)::BIGINT AS citations
FROM held FULL JOIN meta ON held.id = meta.id GROUP BY 1""",
}
