"""Scalar functions against worked values."""

import pytest
from pyspark.sql import functions as F

from biblioforge.functions import text


def run(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_markup(spark):
    given = ["Aims<h4>Methods</h4>We", "end.<h4>Next</h4>", "H<sub>2</sub>O <i>x</i>", '<a href="x">y</a>', "", None, "é<h2>é"]
    assert run(spark, text.strip_markup, given) == ["Aims Methods We", "end. Next", "H2O x", '<a href="x">y', "", None, "é é"]


def test_period_and_join(spark):
    assert run(spark, text.add_period, ["", "a", "a.", "a?", "a!", "a\n"]) == ["", "a.", "a.", "a?", "a!", "a\n."]
    row = spark.range(1).select(text.title_abstract(F.lit(None).cast("string"), F.lit("x"))).first()
    assert row[0] == " x"


def test_urls(spark):
    given = ["see https://a.example/x, (http://b.example:80/y). https://a.example/x", "none", "http://c.example/~q#f"]
    assert run(spark, text.url_list, given) == [["https://a.example/x", "http://b.example:80/y"], [], ["http://c.example/"]]
    assert run(spark, text.clean_url, ["HTTPS://A.Example/Path/", "A.B", "http://X.y//", ""]) == ["http://a.example/Path", "a.b", "http://x.y", ""]
    assert run(spark, text.domain, ["https://a.example:81/x", "b.example", "http://c.example"]) == ["a.example:81", "b.example", "c.example"]
    assert run(spark, text.registry_url, [" https://www.A.b/c/ , https://d.e", "F.g"]) == ["a.b/c/ ".strip().rstrip("/"), "f.g"]


def test_very_long_url(spark):
    assert run(spark, lambda c: F.length(text.clean_url(c)), ["HTTP://a/" + "x" * 200_000 + "///"]) == [200_009]


def test_dates_and_numbers(spark):
    assert run(spark, text.us_date, ["1/2/2003", "11/12/2013", ""]) == ["2003-01-02", "2013-11-12", ""]
    with pytest.raises(Exception, match="not a date"):
        run(spark, text.us_date, ["2003"])
    assert run(spark, text.remove_decimals, ["1.0, 2.0", "10.05"]) == ["1, 2", "105"]
    assert spark.range(1).select(text.significant(F.lit(0.0123456)), text.significant(F.lit(0.0)), text.significant(F.lit(98765.0))).first()[:] == (0.0123, 0.0, 98800.0)


def test_phrases(spark):
    df = spark.createDataFrame([("Niger, Nigeria; Niger Niger",), (None,), ("",)], "v string")
    found = [r[0] for r in df.select(text.phrases(text.plain_words(F.col("v")), 2)).collect()]
    assert found[0].count("Niger") == 3 and found[0].count("Niger Niger") == 1 and "Niger Nigeria" in found[0] and found[1:] == [[], []]


def test_address_signs(spark):
    df = spark.createDataFrame([("at (https://a.b:80/x_y?q=1&z=[2]#top) and http://c.d/~me, HTTP://no",)], "v string")
    assert df.select(text.url_list(F.col("v"))).first()[0] == ["https://a.b:80/x_y?q=1&z=[2", "http://c.d/"]
