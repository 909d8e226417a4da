"""Components and copies against brute force and defined cases."""

import random

import pytest
from pyspark.sql import functions as F

from biblioforge.llm.components import connected_components
from biblioforge.llm.copies import bare_values, copy_groups


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    pairs += [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7), (None, 3), (3, None), (2000, 2001), (2001, 2000), (2000, 2001)]
    df = spark.createDataFrame([(a, b, 0) for a, b in pairs], "a int, b int, step int")
    assert {tuple(r) for r in connected_components(df, "a", "b").collect()} == brute(pairs)


def test_components_empty_and_text(spark):
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0
    assert connected_components(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").count() == 0
    df = spark.createDataFrame([("y", "x"), ("z", "y")], "a string, b string")
    assert {tuple(r) for r in connected_components(df, "a", "b").collect()} == {("x", "x"), ("y", "x"), ("z", "x")}


def test_copies(spark):
    rows = [(1, "7", "Nuclea Bank"), (2, "7", "«nucleabank»!"), (3, "7", "NucleaBank 2"), (4, "8", "nucleabank"), (5, "7", None), (6, "7", ""), (7, "7", "—"), (8, "9", "Straße"), (9, "9", "STRASSE"), (9, "9", "STRASSE"), (10, "9", "x" * 100_000), (11, "9", "X" * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k int, id string, mention string, h1 int")
    df = df.where("mention rlike '[\\\\p{L}\\\\p{N}]'")
    got = {tuple(r) for r in copy_groups(df, "k", {"id": F.col("id"), "mention": F.col("mention")}).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (8, 8, 2), (9, 8, 2), (10, 10, 2), (11, 10, 2)}
    assert copy_groups(df.limit(0), "k", {"id": F.col("id")}).count() == 0


def test_exchanged_values(spark):
    rows = [(1, "A", "Name x", "http://a.b, https://c.d"), (2, "A", "https://c.d http ://a.b", "NAME-X"), (3, "A", "Name x", "http://a.b"), (4, "A", None, "http://a.b"), (5, "A", "http://a.b", "")]
    df = spark.createDataFrame(rows, "k int, id string, n string, u string")
    got = {(r[0], r[1]) for r in copy_groups(df, "k", {"id": F.col("id")}, bare_values(F.col("n"), F.col("u"))).collect()}
    assert got == {(1, 1), (2, 1), (4, 4), (5, 4)}


def test_review_links(spark):
    from biblioforge.llm.queries_groups import review_links

    rows = [(1, "10", "", None), (2, "10; 11.0", None, ""), (3, "['13']", "10", None), (4, "12", "12", ""), (5, "12", None, None), (6, "14", "14, 99", None), (7, None, None, "11"), (7, None, None, "11"), (8, "15", None, None), (9, "15", None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "resource_num long, id string, duplicate_urls string, duplicate_names string, pmid string")
    found = {tuple(r) for r in connected_components(review_links(df), "a", "b").collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (7, 1), (4, 4), (5, 4)}
    assert review_links(df.limit(0)).count() == 0
