"""Relational, merge, review and measure operators on small frames."""

import pytest
from pyspark.sql import functions as F

from biblioforge.operators import measures, merge, relational, review, skew
from biblioforge.operators.packed import resolve, split_packed


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_join_unique_splits_hot_keys(spark):
    left = spark.createDataFrame([("hot", i) for i in range(60)] + [("a", 1), ("b", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("hot", 1.0), ("a", 2.0)], "k string, w double")
    for how, n in (("inner", 61), ("left", 63)):
        plain, split = left.join(right, ["k"], how), skew.join_unique(left, right, ["k"], how, hot_rows=10)
        assert split.count() == n and sorted(map(str, rows(plain))) == sorted(map(str, rows(split)))


def test_keep_first_and_latest(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "id string, n int, v string")
    assert rows(relational.keep_first(df, ["id"], [F.col("n")])) == [("a", 1, "y"), ("b", 1, None)]
    assert rows(relational.latest(df, ["id"], [F.col("n")])) == [("a", 2, "x"), ("b", 1, None)]
    with pytest.raises(ValueError, match="not unique"):
        relational.check_unique(df, "id")
    with pytest.raises(ValueError, match="missing"):
        relational.require_columns(df, ["id", "zz"])


def test_splits_are_exact(spark):
    df = spark.range(103).withColumnRenamed("id", "key")
    sizes = dict(rows(relational.split_by_rank(df, "key", (0.7, 0.15, 0.15), 241).groupBy("split").count()))
    assert sizes == {"train": 72, "val": 15, "test": 16}
    chunks = rows(relational.chunk_ids(df, "key", 10).groupBy("chunk").agg(F.count("*"), F.min("key"), F.max("key")))
    assert [c[1] for c in chunks] == [11, 11, 11] + [10] * 7 and chunks[0][2:] == (0, 10)
    assert relational.split_by_rank(df.limit(0), "key", (0.5, 0.25, 0.25), 1).count() == 0


def test_merge_exact(spark):
    cols = "id string, tie int, text string, best_common string, best_common_prob string, best_full string, best_full_prob string, best_name string, best_name_prob string, extracted_url string, publication_date string"
    df = spark.createDataFrame([
        ("1", 1, "old", "AB", "0.9", "", "", "AB", "0.9", "u", "2010-01-01"), ("2", 2, "new", "AB", "0.5", "Full", "0.95", "AB", "0.5", "u", "2012-01-01"),
        ("3", 3, "t", "C1", "0.4", "", "", "C1", "0.4", "u", "2012-01-01")], cols)
    got = {r["id"]: r for r in merge.merge_exact(df, "id", "tie").collect()}
    assert set(got) == {"2, 1", "3"} and got["2, 1"]["text"] == "new" and got["2, 1"]["article_count"] == 2
    assert got["2, 1"]["best_name"] == "Full" and got["3"]["best_name_prob"] == "0.4"


def test_shared_values(spark):
    df = spark.createDataFrame([(1, "a, b"), (2, "b"), (3, ""), (4, None), (5, "b, c"), (6, "c, c")], "id int, v string")
    assert rows(merge.value_groups(df, "id", "v")) == [(1, "b", 1, 2), (2, "b", 1, 2), (5, "b", 1, 2), (5, "c", 5, 1), (6, "c", 5, 1)]
    assert rows(merge.listed_duplicates(df, "id", "v")) == [(1, "2, 5"), (2, "1, 5"), (3, ""), (4, ""), (5, "1, 2, 6"), (6, "5")]
    assert merge.value_groups(df.limit(0), "id", "v").count() == 0


def test_review(spark):
    df = review.add_review_columns(spark.createDataFrame([(1, "x", "", ""), (2, "", "7", "")], "id int, low_prob string, duplicate_urls string, duplicate_names string"))
    assert rows(review.violations(df, "id")) == [(1, "review_low_prob", "unanswered"), (2, "review_dup_urls", "unanswered")]
    with pytest.raises(ValueError, match="1: review_low_prob unanswered"):
        review.stop_on_violations(df, "id")
    assert rows(review.flag_counts(df)) == [(2, 1, 0, 1)]
    flags = spark.createDataFrame([("0.5",), ("0.98",)], "p string").select(review.flag_low_prob(F.col("p"), 0.978))
    assert [r[0] for r in flags.collect()] == ["low_prob_best_name", ""]


def test_measures(spark):
    df = spark.createDataFrame([(["B-A", "I-A", "O", "B-B"], ["B-A", "I-A", "O", "B-A"]), (["O"], ["B-A"])], "t array<string>, p array<string>")
    r = measures.entity_measures(df, "t", "p").first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 2, 1) and round(r["f1"], 6) == 0.4
    m = spark.createDataFrame([(True, True), (True, False), (False, True), (True, True)], "t boolean, p boolean")
    r = measures.binary_measures(m, F.col("t"), F.col("p")).first()
    assert (r["precision"], r["recall"]) == (2 / 3, 2 / 3)
    e = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.9), ("m", 3, 0.9)], "model string, epoch int, f1 double")
    assert measures.best_rows(e, ["model"], "f1", [F.col("epoch")]).first()["epoch"] == 2


def test_small_operators(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "b")], "k int, c string")
    assert rows(relational.of_class(df, "c", "b")) == [(2,), (4,)]
    assert relational.random_subset(df, "k", 2, 5).count() == 2 and rows(relational.random_subset(df, "k", 9, 5)) == rows(df)
    assert [r["position"] for r in measures.value_order(df, "c").orderBy("k").collect()] == [2, 3, 1, 3]
    notes = spark.createDataFrame([(1, "merge only:", "12, 34"), (2, "merge only:", "12; x"), (3, "merge only:", None), (4, "do not merge", "x")], "id int, review_dup_names string, review_notes_dup_names string")
    assert rows(review.note_violations(notes, "id")) == [(2, "12; x"), (3, "")]
    m = spark.createDataFrame([("a", 0.5), ("b", 0.6)], "model string, f1 double")
    assert rows(measures.beside(m, m.where("model = 'a'"), "model", ["f1"])) == [("a", 0.5, 0.5)]


@pytest.mark.parametrize(("cell", "kind", "values"), [
    ("a, b,, c;", "name", ["a, b,, c"]), ("a; b, c", "name", ["a", "b, c"]), ('"a, b"; c', "name", ["a, b", "c"]), ('"a, b", c', "name", ["a, b", "c"]),
    ("['a', \"Int'l b\"]", "name", ["a", "Int'l b"]), ("[1, 2]", "id", ["1", "2"]), ("1/2", "id", ["1", "2"]), ("a / b|c\nd", "name", ["a", "b", "c", "d"]),
    ("X Y, Z W and O'Q R", "person", ["X Y", "Z W", "O'Q R"]), ("X Y; Z W & et al.", "person", ["X Y", "Z W", "et al."]), ('"Y, X.", "W, Z."', "person", ["Y, X.", "W, Z."]),
    ("https://a.x/q?l=1,2, https://b.x/", "url", ["https://a.x/q?l=1,2", "https://b.x/"]), ("http://a.x http://b.x/c,d.html", "url", ["http://a.x", "http://b.x/c,d.html"]),
    ("http://a.x,http://b.x", "url", ["http://a.x", "http://b.x"]), ("   ", "name", []), (None, "name", []), ("water & soil", "name", ["water & soil"])])
def test_packed(spark, cell, kind, values):
    df = spark.createDataFrame([("k", cell, 1)], "key string, cell string, value_pos int")
    assert [r["item_value"] for r in split_packed(df, ["key"], "cell", kind).orderBy("value_pos").collect()] == values


def test_packed_edges(spark):
    long = ", ".join(f"v{i}" for i in range(5000))
    df = spark.createDataFrame([("a", long), ("b", "x" * 300_000), ("c", '"open, y'), ("d", "p;q"), ("d", "p;q")], "key string, cell string")
    got = {r["key"]: r["n"] for r in split_packed(df, ["key"], "cell").groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 5000, "b": 1, "c": 2, "d": 4}
    assert split_packed(df.limit(0), ["key"], "cell").count() == 0
    assert resolve("w,w", "name") == [(1, 1), (3, 1)]
    with pytest.raises(ValueError, match="unknown kind"):
        split_packed(df, ["key"], "cell", "other")
