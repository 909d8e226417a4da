"""Array functions against worked values."""

from pyspark.sql import functions as F

from biblioforge.functions import arrays


def names(spark, *cells):
    df = spark.createDataFrame([cells], "c string, cp string, f string, fp string")
    r = df.select(arrays.select_names(*[F.col(x) for x in ("c", "cp", "f", "fp")]).alias("n")).first()["n"]
    return r["best_common"], r["best_full"], r["best_name"], r["best_name_prob"]


def test_select_names(spark):
    assert names(spark, "AB", "0.9", "", "") == ("AB", "", "AB", 0.9)
    assert names(spark, "AB", "0.5", "Long name", "0.5") == ("AB", "Long name", "Long name", 0.5)
    assert names(spark, "AB, CD", "0.5, 0.7", "Long, Longer", "0.6, 0.2") == ("CD", "Long", "CD", 0.7)
    assert names(spark, "A", "0.9", "B", "0.9") == ("", "", "", 0.0)
    assert names(spark, "X1, X1", "0.2, 0.4", "", "") == ("X1", "", "X1", 0.4)
    assert names(spark, "X1, Y1, Z1", "0.2", None, None) == ("X1", "", "X1", 0.2)


def test_align_and_keep(spark):
    df = spark.createDataFrame([([3, 0, 1], [None, 0, 0, 1, 2, 2, None])], "l array<int>, w array<int>")
    assert df.select(arrays.align_labels(F.col("l"), F.col("w"))).first()[0] == [-100, 3, 4, 0, 1, 2, -100]
    df = spark.createDataFrame([([1, 2, 0], [1, -100, 0])], "p array<int>, t array<int>")
    assert df.select(arrays.kept_tags(F.col("p"), F.col("t"), {0: "O", 1: "B-COM", 2: "I-COM"})).first()[0] == ["B-COM", "O"]


def tags(spark, words, full, common):
    df = spark.createDataFrame([(words.split(), [f.split(" ") for f in full], [c.split(" ") for c in common])], "w array<string>, f array<array<string>>, c array<array<string>>")
    return df.select(arrays.bio_tags(F.col("w"), F.col("f"), F.col("c"))).first()[0]


def test_bio_tags(spark):
    assert tags(spark, "the Protein Data Bank PDB of Data Bank", ["Protein Data Bank", ""], ["PDB"]) == ["O", "B-FUL", "I-FUL", "I-FUL", "B-COM", "O", "O", "O"]
    assert tags(spark, "MothBase lists moths for mothBase users", [""], ["mothBase", "MothBase"]) == ["B-COM", "O", "O", "O", "B-COM", "O"]
    assert tags(spark, "An Oxalis catalogue exists", ["Oxalis catalogue"], ["Oxalis"]) == ["O", "B-COM", "O", "O"]
    assert tags(spark, "A B C D", ["A B C", "B C"], ["C D"]) == ["B-FUL", "B-FUL", "B-COM", "I-COM"]
    assert tags(spark, "A B C", ["A"], ["A B C"]) == ["B-FUL", "I-COM", "I-COM"] and tags(spark, "A B", [], []) == ["O", "O"]
    assert tags(spark, "A B C", ["A B"], ["C"]) == ["B-FUL", "I-FUL", "B-COM"]


def entities(spark, text, ids, spans, labels, probs):
    df = spark.createDataFrame([(text, spans, ids, labels, probs)], "t string, s array<struct<start:int,end:int>>, i array<int>, l array<string>, p array<double>")
    found = df.select(arrays.assemble_entities(*[F.col(c) for c in "tsilp"]).alias("e")).first()["e"]
    return [(e["mention"], e["label"], round(e["prob"], 6)) for e in found]


def test_entities(spark):
    text = "MOTHdb: Pollen Atlas for Alps."
    spans = [(0, 6), (6, 7), (8, 14), (15, 20), (21, 24), (25, 29), (29, 30)]
    labels = ["B-COM", "I-COM", "I-COM", "B-FUL", "I-FUL", "I-FUL", "I-FUL", "I-FUL"]
    assert entities(spark, text, [0, 0, 1, 2, 3, 4, 5, 6], spans, labels, [0.9, 0.8, 0.7, 0.5, 0.5, 0.5, 0.5, 1.0]) == [("MOTHdb:", "B-COM", 0.85), ("Pollen Atlas for Alps.", "B-FUL", 0.6)]
    text, spans = "In out more here (x2).", [(0, 2), (3, 6), (7, 11), (12, 16), (17, 18), (18, 20), (20, 22)]
    found = entities(spark, text, list(range(7)), spans, ["I-COM", "O", "I-FUL", "I-FUL", "B-COM", "I-COM", "I-COM"], [0.9, 0.9, 0.8, 0.6, 0.9, 0.8, 0.7])
    assert found == [("In", "I-COM", 0.9), ("more here", "I-FUL", 0.7), ("(x2).", "B-COM", 0.8)]
    assert entities(spark, "B (http://x.y)", [0, 1], [(0, 1), (2, 14)], ["B-COM", "B-FUL"], [0.9, 0.9]) == [] == entities(spark, "", [], [], [], [])
    df = spark.createDataFrame([(" ab  c\n",), ("",)], "t string").select(arrays.word_spans(F.col("t")))
    assert [[tuple(x) for x in r[0]] for r in df.collect()] == [[(1, 3), (5, 6)], []]


def test_softmax_label(spark):
    r = spark.createDataFrame([([1.0, 3.0, 3.0],)], "x array<double>").select(arrays.softmax_label(F.col("x"), ["O", "B", "I"]).alias("y")).first()["y"]
    assert r["label"] == "B" and abs(r["prob"] - 1 / (2 + 2.718281828 ** -2)) < 1e-9
