"""Files, injected services and streams."""

import json

from pyspark.sql import functions as F

from biblioforge.sources import files, remote
from biblioforge.streaming import incremental


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,title,abstract\n1,"A\nb",<i>x</i>\n1,other,y\n,no,z\n2,"He said ""q""",\n', encoding="ISO-8859-1")
    got = {r["id"]: r["title_abstract"] for r in files.read_articles(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {"1": "Ab. x", "2": 'He said "q". '}
    df = spark.createDataFrame([("a", ""), ('q"', "é")], "x string, y string")
    files.write_text_csv(df, str(tmp_path / "out"))
    files.append_chunk(df, str(tmp_path / "out"))
    assert files.read_text_csv(spark, str(tmp_path / "out"), ["x", "y"], "UTF-8").count() == 4


def test_registry_documents(spark):
    xml = '<r xmlns:a="u"><a:repositoryName>N</a:repositoryName><a:type>x</a:type><a:type>y</a:type><a:type>x</a:type></r>'
    df = spark.createDataFrame([("1", xml)], "id string, doc string")
    assert tuple(files.read_registry(df, "id", "doc").first()) == ("1", "N", "", "", "x_AND_y")


def test_paged(spark):
    def fetch(query, page):
        n = int(page or 0)
        return [{"id": f"{query}{n}", "title": "t"}], str(n + 1) if n < 2 else None

    remote.register_paged(spark, fetch)
    assert [r["id"] for r in spark.read.format("paged").option("query", "q").load().collect()] == ["q0", "q1", "q2"]
    assert remote.fill_query("x [{0} TO {1}]", "2011", "2021-12") == "x [2011 TO 2021-12]"


def test_metadata(spark):
    def fetch(query):
        return [json.dumps({"pmid": i, "citedByCount": 2, "grantsList": {"grant": [{"agency": "A"}, {"agency": "", "grantId": "g"}]}}) for i in query.split(" OR ")]

    ids = spark.createDataFrame([("1",), ("2",), ("1",), ("",)], "id string")
    answers = remote.fetch_metadata(ids, "id", fetch, chunk=1)
    assert sorted(tuple(r) for r in remote.flatten_metadata(answers).collect()) == [("1", "", "", "g", "A", 2), ("2", "", "", "g", "A", 2)]
    assert remote.funder_rows(spark.createDataFrame([('{"pmid": "9"}',)], "answer string")).collect()[0]["agency"] is None


def test_checks(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "u string")

    def probe(url):
        if url == "c":
            raise OSError("no route")
        return {"a": 200, "b": 404}[url]

    got = sorted(tuple(r) for r in remote.check_urls(urls, "u", probe, lambda u: ("X", "(1,2)")).collect())
    assert got == [("a", "200", "X", "(1,2)"), ("b", "404", "", ""), ("c", "no route", "", "")]
    calls = []
    assert remote.with_retry(lambda u: (calls.append(u), int("x" if len(calls) > 9 else 7))[1] if len(calls) > 1 else _down(calls, u), backoff=0.0)("u") == 7
    assert remote.located_by(lambda u: ("", "(1,2)"), lambda u: ("X", "(3,4)"))("u") == ("X", "(1,2)")
    found = dict(remote.find_snapshots(urls, "u", lambda u: {"a": (200, "s"), "b": (200, None), "c": (503, None)}[u]).collect())
    assert found == {"a": "s", "b": "no_wayback", "c": "wayback is down"}
    lists = spark.createDataFrame([("a, b", "s, no_wayback")], "u string, w string")
    assert [r[0] for r in remote.missing_snapshots(lists, "u", "w").collect()] == ["b"]


def _down(calls, url):
    calls.append(url)
    raise OSError("down")


def test_flags_and_registry(spark, tmp_path):
    answers = spark.createDataFrame([(json.dumps({"pmid": "1", "isOpenAccess": "Y", "hasTextMinedTerms": "N", "license": "cc by"}),), (json.dumps({"pmid": "2", "isOpenAccess": "N"}),)], "answer string")
    flags = remote.article_flags(answers)
    assert sorted(tuple(r) for r in flags.collect()) == [("1", True, False, None, "cc by"), ("2", False, None, None, None)]
    held = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "9")], "resource string, id string")
    got = {r["resource"]: tuple(r)[1:] for r in remote.flags_of_resources(held, flags, "resource").collect()}
    assert got == {"a": ("some", "none", None), "b": ("all", "none", None), "c": (None, None, None)}
    pages = remote.registry_pages(spark, lambda: "t0k", lambda token, page: [{"token": token, "page": page}], 3)
    assert sorted(json.loads(r["record"])["page"] for r in pages.collect()) == [1, 2, 3]
    (tmp_path / "m.tsv").write_text("model\tpath\na\tx\nb\ty\n")
    assert files.read_keyed_config(spark, str(tmp_path / "m.tsv"), "model")["b"]["path"] == "y"
    files.write_one_row(spark.createDataFrame([(0.5, 0.25)], "precision double, recall double"), str(tmp_path / "one"))
    assert spark.read.option("header", True).csv(str(tmp_path / "one")).count() == 1


def test_stream(spark, tmp_path):
    schema = "id string, best_name string, extracted_url string, publication_date string"
    for i, (k, d) in enumerate((("1", "2010-01-01"), ("2", "2012-01-01"))):
        spark.createDataFrame([(k, "N", "HTTPS://A/", d)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.read_stream(spark, str(tmp_path / "in"), schema, 1)
    query = incremental.merge_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "out/version=1")).first()
    assert last["article_count"] == 2 and last["extracted_url"] == "http://a" and set(last["ids"].split(", ")) == {"1", "2"}
    clean = incremental.clean_stream(spark.createDataFrame([("1", "t <i>a</i>", "see http://x.y")], "id string, title string, abstract string"))
    assert clean.first()["extracted_url"] == "http://x.y"
    assert F is not None
