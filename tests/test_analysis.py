"""Queries of the descriptive analyses."""

from biblioforge.plans import analysis


def test_entity_quality_reads_whole_texts(spark, tmp_path):
    text = "a " * 1_000_000 + "Alpha b Beta"
    spark.createDataFrame([(text,)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = analysis.entity_quality(spark, str(tmp_path)).collect()[0]
    assert (row["tp"], row["fp"], row["fn"]) == (1, 0, 1)


def test_mentioned_countries(spark):
    listed = spark.createDataFrame([("JPN", "392", "Japan"), ("NER", "562", "Niger"), ("NGA", "566", "Nigeria"), ("TWN", "158", "Taiwan, Province of China"), ("CHN", "156", "China")], "country_3 string, number string, country_name string")
    rows = spark.createDataFrame([(1, "JPN."), (2, "Nigeria, Japan, and Japan"), (3, "560001, Niger."), (4, ""), (5, None), (6, "Taiwan, Province of China"), (7, "Japanese")], "id int, cell string")
    found = lambda code: dict(analysis.mentioned_countries(rows, "id", "cell", listed, code).collect())
    assert found("country_3") == {1: "JPN", 2: "JPN, JPN, NGA", 3: "NER", 6: "CHN, TWN"}
    assert found("number")[2] == "392, 392, 566" and found("country_name")[1] == "Japan"
    assert analysis.mentioned_countries(rows, "id", "cell", listed.limit(0), "country_3").count() == 0
