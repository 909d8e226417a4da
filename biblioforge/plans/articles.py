"""Queries over articles: cleaning, addresses, names, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioforge.functions import arrays, text
from biblioforge.operators import merge, relational
from biblioforge.session import load


def articles_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First delivery of each article with an id: markup stripped, title and abstract as one text."""
    raw = load(spark, sf_dir, "articles").select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"), "received_at")
    first = relational.keep_first(relational.drop_blank(raw, "id"), ["id"], [F.col("received_at"), F.col("title"), F.col("abstract")])
    parts = [text.strip_newlines(text.strip_markup(F.col(c))) for c in ("title", "abstract")]
    return first.select("id", text.title_abstract(*parts).alias("title_abstract"))


def url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses in each prediction's text, if there are at most two."""
    found = load(spark, sf_dir, "predictions").select("prediction_id", text.url_list(F.coalesce("text", F.lit(""))).alias("urls"))
    found = found.where((F.size("urls") > 0) & (F.size("urls") <= 2))
    return found.select("prediction_id", text.join_list(F.col("urls")).alias("extracted_url"), F.size("urls").alias("n_urls"))


def clean_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised address cells with the host of the first address."""
    rows = relational.drop_blank(load(spark, sf_dir, "predictions"), "extracted_url")
    return rows.select("prediction_id", text.clean_url(F.col("extracted_url")).alias("clean_url"), text.domain(F.col("extracted_url")).alias("domain"))


def inventory_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory addresses as registries are compared by them."""
    rows = relational.drop_blank(load(spark, sf_dir, "inventory"), "inv_url")
    return rows.select("resource_num", text.registry_url(F.col("inv_url")).alias("registry_url"))


def selected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best names of each prediction that has any, from its scored lists."""
    rows = load(spark, sf_dir, "predictions").where("coalesce(common_name, '') <> '' or coalesce(full_name, '') <> ''")
    chosen = arrays.select_names(F.col("common_name"), F.col("common_prob"), F.col("full_name"), F.col("full_prob"))
    return rows.select("prediction_id", chosen.alias("n")).select("prediction_id", "n.best_common", "n.best_full", "n.best_name", "n.best_name_prob")


def merged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of one name and normalised address merged, newest first."""
    rows = load(spark, sf_dir, "predictions").withColumn("extracted_url", text.clean_url(F.coalesce("extracted_url", F.lit(""))))
    rows = rows.withColumn("best_name", F.coalesce("best_name", F.lit("")))
    order = [merge.descending(F.col("publication_date")), F.col("prediction_id")]
    return rows.groupBy("best_name", "extracted_url").agg(
        F.count(F.lit(1)).alias("article_count"), merge.ordered_join(F.col("id"), order).alias("ids"),
        merge.first_by(F.col("publication_date"), order).alias("publication_date"), merge.first_by(F.col("text"), order).alias("text"))


def with_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A previous inventory and new predictions as one list, merged exactly by name and address."""
    new = load(spark, sf_dir, "predictions").select(
        F.col("id"), F.coalesce("best_name", F.lit("")).alias("best_name"), text.clean_url(F.coalesce("extracted_url", F.lit(""))).alias("extracted_url"))
    old = load(spark, sf_dir, "inventory").select(
        F.col("inv_id").alias("id"), F.coalesce("inv_name", F.lit("")).alias("best_name"), text.clean_url(F.coalesce("inv_url", F.lit(""))).alias("extracted_url"))
    both = old.unionByName(new)
    return both.groupBy("best_name", "extracted_url").agg(F.count(F.lit(1)).alias("article_count"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def mentions_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of each article without repeats: of spellings that differ in case the most frequent, then the best scored."""
    rows = relational.drop_blank(load(spark, sf_dir, "entities"), "mention")
    rows = rows.select("id", text.trim_punctuation(F.col("mention")).alias("mention"), "label", "prob")
    spelled = rows.groupBy("id", "mention").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("prob", "label")).alias("top"))
    best = spelled.groupBy("id", F.lower("mention").alias("key")).agg(
        F.max(F.struct("n", F.col("top.prob").alias("prob"), "mention", F.col("top.label").alias("label"))).alias("b"))
    return best.select("id", "b.mention", "b.label", "b.prob")


def mentions_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of each article side by side by label, listed with their scores."""
    rows = relational.drop_blank(load(spark, sf_dir, "entities"), "mention").groupBy("id", "label", "mention").agg(F.max("prob").alias("prob"))
    order = [F.lower("mention"), F.col("mention")]
    listed = lambda label, c: merge.ordered_join(F.when(F.col("label") == label, F.col(c)), order, drop_blank=True)
    return rows.groupBy("id").agg(
        listed("COM", "mention").alias("common_name"), listed("FUL", "mention").alias("full_name"),
        F.count_if(F.col("label") == "COM").alias("n_common"), F.count_if(F.col("label") == "FUL").alias("n_full"))


def name_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different mentions of each article, sorted."""
    rows = relational.drop_blank(load(spark, sf_dir, "entities"), "mention")
    return rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("mention")), "|").alias("names"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document with their number of words, both numbered from 0."""
    rows = load(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S"))
    split = rows.select("doc_id", F.posexplode(arrays.sentence_list(F.col("text"))).alias("sent_idx", "sentence"))
    return split.select("doc_id", "sent_idx", F.size(arrays.word_list(F.col("sentence"))).alias("n_words"))


def sentence_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each sentence of each document, one a row, with their places."""
    rows = load(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S"))
    split = rows.select("doc_id", F.posexplode_outer(arrays.sentence_list(F.col("text"))).alias("sent_idx", "sentence"))
    return split.select("doc_id", "sent_idx", F.posexplode_outer(arrays.word_list(F.col("sentence"))).alias("word_idx", "word"))


def tagged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document begin and go on a mention of its resource or one of two phrases, one of which holds the resource's name."""
    rows = load(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S") & (F.coalesce("resource_name", F.lit("")) != ""))
    words = F.transform(arrays.word_list(F.col("text")), lambda w: text.trim_punctuation(w))
    name = arrays.word_list(F.col("resource_name"))
    phrase = F.array(*map(F.lit, ("Data", "are", "available")))
    tags = arrays.bio_tags(F.col("words"), F.array(phrase, F.concat(name, F.array(F.lit("provides")))), F.array(name))
    tagged = rows.select("doc_id", "resource_name", words.alias("words")).select("doc_id", tags.alias("tags"))
    count = lambda tag: F.size(F.filter("tags", lambda t: t == tag))
    return tagged.select("doc_id", F.size("tags").alias("n_words"), count("B-COM").alias("begin_com"), count("I-COM").alias("inside_com"),
                         count("B-FUL").alias("begin_ful"), count("I-FUL").alias("inside_ful"))


def assembled_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions put together again from labels and scores of sub-tokens of up to four letters."""
    rows = load(spark, sf_dir, "entities").where(F.col("mention").rlike(r"\S") & F.col("label").isNotNull() & F.col("prob").isNotNull())
    rows = rows.select("mention_id", "mention", "label", "prob", arrays.word_spans(F.col("mention")).alias("spans"))
    ids = F.flatten(F.transform("spans", lambda s, i: F.array_repeat(i.cast("int"), F.ceil((s["end"] - s["start"]) / 4).cast("int"))))
    rows = rows.withColumn("ids", ids)
    labels = F.transform("ids", lambda w, i: F.concat(F.when(i == 0, "B-").otherwise("I-"), F.col("label")))
    probs = F.transform("ids", lambda w, i: F.col("prob") - 0.001 * i)
    found = rows.select("mention_id", arrays.assemble_entities(F.col("mention"), F.col("spans"), F.col("ids"), labels, probs).alias("e"))
    return found.select("mention_id", F.inline("e")).select("mention_id", "mention", "label", F.round("prob", 6).alias("prob"))


QUERIES = {f.__name__: f for f in (
    articles_clean, url_lists, clean_urls, inventory_urls, selected_names, merged_duplicates, with_previous, mentions_deduplicated,
    mentions_wide, name_sets, sentences, sentence_words, tagged_words, assembled_entities)}

_PUNCT = r"""!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~"""
_SIGNS = "".join("\\" + c for c in text.URL_SIGNS).replace("'", "''")
_TRIM = "regexp_replace({0}, '^ +| +$', '', 'g')"
_WS = "[ \\t\\n\\x0B\\f\\r]+"
_W = r"[\p{L}\p{M}\p{N}_]"
_CLEAN = (
    "replace(rtrim(lower(regexp_extract({0}, '^(?:[^/]|/{{2,}})*')) || substr({0}, length(regexp_extract({0}, '^(?:[^/]|/{{2,}})*')) + 1), '/'), 'https', 'http')"
)


def _markup(c: str) -> str:
    glued = f"regexp_replace({c}, '({_W[:-1]}.?!])</?h[0-9]>({_W})', '\\1 \\2', 'g')"
    glued = f"regexp_replace({glued}, '({_W[:-1]}.?!])</?h[0-9]>({_W})', '\\1 \\2', 'g')"
    return f"replace(regexp_replace({glued}, '<{_W[:-1]}/]+>', '', 'g'), chr(10), '')"


_SENTENCES = f"""
WITH split AS (
  SELECT doc_id, string_split(regexp_replace({_TRIM.format('text')}, '([.?!]){_WS}', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]')
), one AS (
  SELECT doc_id, sent_idx, string_split_regex({_TRIM.format('sentence')}, '{_WS}') AS words FROM (SELECT doc_id, unnest(range(0, len(s)))::INT AS sent_idx, unnest(s) AS sentence FROM split)
)"""

SQL: dict[str, str] = {
    "sentences": _SENTENCES + " SELECT doc_id, sent_idx, len(words)::INT AS n_words FROM one",
    "sentence_words": _SENTENCES + " SELECT doc_id, sent_idx, unnest(range(0, len(words)))::INT AS word_idx, unnest(words) AS word FROM one",
    "tagged_words": f"""
WITH d AS (
  SELECT doc_id, string_split_regex({_TRIM.format('resource_name')}, '{_WS}') AS n, ['Data', 'are', 'available'] AS p,
         list_transform(string_split_regex({_TRIM.format('text')}, '{_WS}'), lambda w: trim(w, '{_PUNCT}')) AS w
  FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]') AND coalesce(resource_name, '') <> ''
), found AS (
  SELECT doc_id, len(w) AS n_words, len(n) AS n_long, len(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(n) - 1] = n)) AS c,
         len(list_filter(range(1, len(w) + 1), lambda i: w[i:i + 2] = p)) AS f FROM d
)
SELECT doc_id, n_words::INT AS n_words, c::INT AS begin_com, (c * (n_long - 1))::INT AS inside_com, f::INT AS begin_ful, (2 * f)::INT AS inside_ful FROM found""",
    "assembled_entities": f"""
WITH rows AS (
  SELECT mention_id, label, prob, list_sum(list_transform(regexp_extract_all(mention, '[^ \\t\\n\\x0B\\f\\r]+'), lambda w: ceil(length(w) / 4.0))) AS n,
         regexp_replace(regexp_replace(mention, '([ \\t\\n\\x0B\\f\\r]){_WS}', '\\1', 'g'), '^{_WS}|{_WS}$', '', 'g') AS m
  FROM entities WHERE regexp_matches(mention, '[^ \\t\\n\\x0B\\f\\r]') AND label IS NOT NULL AND prob IS NOT NULL
)
SELECT mention_id, m AS mention, 'B-' || label AS label, round(prob - 0.001 * (n - 1) / 2, 6) AS prob FROM rows
WHERE length(m) <> 1 AND length(m) <= 100 AND NOT contains(m, 'http')""",
    "articles_clean": f"""
WITH first AS (
  SELECT id, coalesce(title, '') AS title, coalesce(abstract, '') AS abstract FROM articles WHERE coalesce(id, '') <> ''
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at, coalesce(title, ''), coalesce(abstract, '')) = 1
), clean AS (SELECT id, {_markup('title')} AS t, {_markup('abstract')} AS a FROM first)
SELECT id, CASE WHEN t = '' OR right(t, 1) IN ('.', '?', '!') THEN t ELSE t || '.' END || ' ' || a AS title_abstract FROM clean""",
    "url_lists": f"""
WITH found AS (
  SELECT prediction_id, list_transform(regexp_extract_all(coalesce(text, ''), 'https?://[\\p{{L}}\\p{{M}}\\p{{N}}_{_SIGNS}]+'),
         lambda u: trim(u, '{_PUNCT.replace('/', '')}')) AS l FROM predictions
), different AS (SELECT prediction_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS urls FROM found)
SELECT prediction_id, array_to_string(urls, ', ') AS extracted_url, len(urls)::INT AS n_urls FROM different WHERE len(urls) BETWEEN 1 AND 2""",
    "clean_urls": f"""
SELECT prediction_id, {_CLEAN.format('extracted_url')} AS clean_url,
       regexp_replace(regexp_replace(extracted_url, 'https?://', '', 'g'), '(?s)/.*', '') AS domain
FROM predictions WHERE coalesce(extracted_url, '') <> ''""",
    "inventory_urls": """
SELECT resource_num, lower(regexp_replace(regexp_replace(trim(split_part(inv_url, ',', 1)), '^https?://(?:www.)?', ''), '/$', '')) AS registry_url
FROM inventory WHERE coalesce(inv_url, '') <> ''""",
    "selected_names": """
WITH lists AS (
  SELECT prediction_id,
         list_zip(string_split(coalesce(common_name, ''), ', '), string_split(coalesce(common_prob, ''), ', '), true) AS c,
         list_zip(string_split(coalesce(full_name, ''), ', '), string_split(coalesce(full_prob, ''), ', '), true) AS f
  FROM predictions WHERE coalesce(common_name, '') <> '' OR coalesce(full_name, '') <> ''
), items AS (
  SELECT prediction_id, 'c' AS kind, 1000 + i AS pos, c[i][1] AS raw, c[i][2] AS p FROM lists, generate_series(1, len(c)) AS g(i)
  UNION ALL SELECT prediction_id, 'f', i, f[i][1], f[i][2] FROM lists, generate_series(1, len(f)) AS g(i)
), scored AS (
  SELECT prediction_id, kind, pos, CASE WHEN length(raw) = 1 THEN '' ELSE raw END AS name,
         CASE WHEN length(raw) <= 1 THEN 0.0 ELSE coalesce(try_cast(p AS DOUBLE), 0.0) END AS prob FROM items
), own AS (
  SELECT prediction_id, kind, name, min(pos) AS pos, arg_max(prob, pos) AS prob FROM scored GROUP BY ALL
), both_kinds AS (
  SELECT prediction_id, name, min(pos) AS pos, arg_max(prob, pos) AS prob FROM scored GROUP BY ALL
)
SELECT l.prediction_id,
       (SELECT arg_min(name, (-prob, pos)) FROM own o WHERE o.prediction_id = l.prediction_id AND kind = 'c') AS best_common,
       (SELECT arg_min(name, (-prob, pos)) FROM own o WHERE o.prediction_id = l.prediction_id AND kind = 'f') AS best_full,
       (SELECT arg_min(name, (-prob, pos)) FROM both_kinds o WHERE o.prediction_id = l.prediction_id) AS best_name,
       (SELECT max(prob) FROM both_kinds o WHERE o.prediction_id = l.prediction_id) AS best_name_prob
FROM lists l""",
    "merged_duplicates": f"""
WITH rows AS (SELECT *, {_CLEAN.format("coalesce(extracted_url, '')")} AS u, coalesce(best_name, '') AS n FROM predictions)
SELECT n AS best_name, u AS extracted_url, count(*) AS article_count,
       string_agg(id, ', ' ORDER BY coalesce(publication_date, '') DESC, prediction_id) AS ids,
       arg_min(publication_date, (-coalesce(try_cast(replace(publication_date, '-', '') AS BIGINT), -1), prediction_id)) AS publication_date,
       arg_min(text, (-coalesce(try_cast(replace(publication_date, '-', '') AS BIGINT), -1), prediction_id)) AS text
FROM rows GROUP BY 1, 2""",
    "with_previous": f"""
WITH both_lists AS (
  SELECT id, coalesce(best_name, '') AS best_name, {_CLEAN.format("coalesce(extracted_url, '')")} AS extracted_url FROM predictions
  UNION ALL SELECT inv_id, coalesce(inv_name, ''), {_CLEAN.format("coalesce(inv_url, '')")} FROM inventory
)
SELECT best_name, extracted_url, count(*) AS article_count, min(id) AS first_id, max(id) AS last_id FROM both_lists GROUP BY 1, 2""",
    "mentions_deduplicated": f"""
WITH bare AS (
  SELECT id, trim(mention, '{_PUNCT}') AS mention, label, prob FROM entities WHERE coalesce(mention, '') <> ''
), spelled AS (
  SELECT id, mention, count(*) AS n, max(prob) AS prob, arg_max(label, (prob, label)) AS label FROM bare GROUP BY id, mention
)
SELECT id, mention, label, prob FROM spelled
QUALIFY row_number() OVER (PARTITION BY id, lower(mention) ORDER BY n DESC, prob DESC, mention DESC, label DESC) = 1""",
    "mentions_wide": """
WITH best AS (SELECT DISTINCT id, label, mention FROM entities WHERE coalesce(mention, '') <> '')
SELECT id, coalesce(string_agg(mention, ', ' ORDER BY lower(mention), mention) FILTER (label = 'COM'), '') AS common_name,
       coalesce(string_agg(mention, ', ' ORDER BY lower(mention), mention) FILTER (label = 'FUL'), '') AS full_name,
       count(*) FILTER (label = 'COM') AS n_common, count(*) FILTER (label = 'FUL') AS n_full
FROM best GROUP BY id""",
    "name_sets": "SELECT id, string_agg(DISTINCT mention, '|' ORDER BY mention) AS names FROM entities WHERE coalesce(mention, '') <> '' GROUP BY id",
}
