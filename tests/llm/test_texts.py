"""Encodings, tokens, mixes and cut texts."""

import math
import os
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from biblioforge.llm import encoding, mixing, tokens, truncation

GOOD = ["The archive’s entries – “soft” and naïve – cover β-barrel and α-helix motifs at 37 °C (≥ 0.5, mean ± SD).", "Université de Besançon, façade, tâche à côté; Ärzte für Köln und Österreich", "Fundação São João, España, Türkiye"]


@pytest.fixture(scope="module")
def model():
    usual = frozenset(c for t in GOOD for c in t if c > "\x7f")
    return encoding.Model({"en": GOOD[0].encode(), "fr": GOOD[1].encode()}, usual)


@pytest.mark.parametrize("codec", ["cp1252", "latin_1", "cp437", "mac_roman", "cp850", "cp1251"])
def test_repair_round_trip(model, codec):
    for good in ("It’s naïve – a β-barrel", "Université de Nükykedryl, Türkiye", "“soft” ≥ 0.5"):
        try:
            bad = good.encode("utf-8").decode(codec)
        except UnicodeDecodeError:
            continue
        assert encoding.repair(bad, model) == (True, good)
    assert encoding.repair("x Ã¢â‚¬Å“soft", model)[1] == "x “soft"


def test_good_text_stays(model):
    for good in [*GOOD, "SÃO PAULO ÃO-set", "Â-ring", "√n-scaled", "™-marked ©-free", "Россия", "", None, "plain & simple"]:
        assert encoding.repair(good, model) == (False, good)
    assert encoding.repair("fa�ade", model)[0] and encoding.repair("isnâ\x80t", model)[0]
    assert encoding.repair("é" * 50_000, model) == (False, "é" * 50_000)


def test_repair_fields(spark, model):
    df = spark.createDataFrame([("1", "Ã„rzte", "r"), ("2", "Ärzte", "r"), ("3", None, "r"), ("4", "", "r"), ("1", "Ã„rzte", "r")], "k string, value string, x string")
    assert sorted(r["restored"] for r in encoding.repair_fields(df, model).collect()) == ["Ärzte", "Ärzte"]
    assert encoding.repair_fields(df.limit(0), model).count() == 0
    assert encoding.train(spark.createDataFrame([], "text string, lang string")).dictionaries == {}


def test_dictionaries_come_from_all_documents(spark):
    """A long document and words spread over many documents count as much as others; order and repeats of rows do not matter."""
    rows = [(f"{'x' * 45} common word{i % 7} {'seldom' if i % 100 == 0 else 'often'} end", "en") for i in range(900)] + [("überall und immer " * 1000, "de"), (None, "de"), ("ohne Sprache", None)]
    model = encoding.train(spark.createDataFrame(rows, "text string, lang string"))
    assert set(model.dictionaries) == {"en", "de"} and "überall ".encode() in model.dictionaries["de"]
    assert all(w in model.dictionaries["en"] for w in (b"seldom ", b"often ", b"common ", b"word6 "))
    assert encoding.train(spark.createDataFrame(rows[::-1], "text string, lang string")).dictionaries == model.dictionaries


def test_documents_are_split_once(spark):
    """The words and their number in each language come from one pass, the characters from another."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    docs = spark.createDataFrame([(f"word{i % 9} and ünd more", "en" if i % 3 else "de") for i in range(60)], "text string, lang string")
    model = encoding.train(docs.select(seen("text").alias("text"), "lang"))
    assert set(model.dictionaries) == {"en", "de"} and model.usual == {"ü"} and read.value == 120
    langs = [chr(97 + i % 26) + chr(97 + i // 26) for i in range(encoding.LANGUAGES + 1)]
    with pytest.raises(ValueError):
        encoding.train(spark.createDataFrame([("some some some", x) for x in langs], "text string, lang string"))


def test_only_steps_that_can_change_a_text_are_tried(model, monkeypatch):
    """Steps left out change nothing, and usual accented letters need none."""
    texts = [*GOOD, "Ã„rzte &uuml;", "isnâ\x80t", "fa�ade", "UniversitŠt KÃ¶ln", "╝√├ñ", "Россия", "Â-ring ÂÃ â€™", "", "a\x85b", "Šx€y"]
    for t in texts + [t.encode("utf-8").decode(c, "ignore") for t in GOOD for c in encoding.CODE_PAGES]:
        mistaken, swapped = encoding._steps(encoding._held(t))
        assert all(encoding._as_utf8(t, c) == t for c in encoding.CODE_PAGES if c not in dict(mistaken))
        assert all(encoding._swapped(t, c) == t for c in encoding.SWAPPED if c not in swapped)
        assert not encoding._LEFT.isdisjoint(t) or not encoding._RESTS.search(t)
    tried = []
    monkeypatch.setattr(encoding, "_as_utf8", lambda t, c: tried.append(c) or t)
    assert encoding.repair("Universität Köln", model) == (False, "Universität Köln") and not tried


needs_tokenizers = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZER_DIR}/{tokens.BYTE_BPE}"), reason="no vocabulary files")


@needs_tokenizers
def test_tokens(spark, monkeypatch):
    texts = [None, "", " ", "Hello world's  end\n\n x", "<|endoftext|> it's", "á 漢字 12345 　\t!?", "a" * 30_000, "same", "same", "\x1c\x85 x ﬁ 👩‍🔬"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    whole = tokens._encoding(f"{tokens.TOKENIZER_DIR}/{tokens.BYTE_BPE}")
    expected = {i: whole.encode_ordinary(t or "") for i, t in enumerate(texts)}
    for limit in (tokens.BROADCAST_BYTES, 0):
        monkeypatch.setattr(tokens, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(tokens, "FREQUENT_SHARE", 0.05)
        assert {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df).collect()} == expected
        assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()} == {i: len(v) for i, v in expected.items()}
    assert {r["doc_id"]: r["text"] for r in tokens.decode_corpus(tokens.encode_corpus(df)).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "hello world"), (1, "foo bar baz"), (1, "foo bar baz"), (2, None)], "doc_id int, text string")
    rows = sorted((r["doc_id"], r["ids"]) for r in tokens.encode_corpus(again).collect())
    assert rows == sorted([(1, whole.encode_ordinary("hello world")), (1, whole.encode_ordinary("foo bar baz")), (1, whole.encode_ordinary("foo bar baz")), (2, [])])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.floats(0, 1), st.integers(0, 5)), min_size=1, max_size=6), st.floats(0, 5000))
def test_water_fill(sources, size):
    have = {str(i): s[0] for i, s in enumerate(sources)}
    share, most = {str(i): s[1] for i, s in enumerate(sources)}, {str(i): s[2] for i, s in enumerate(sources)}
    filled = mixing.water_fill(have, share, most, size)
    assert all(v <= have[s] * most[s] + 1e-6 for s, v in filled.items()) and sum(filled.values()) <= size + 1e-6
    free = [s for s, v in filled.items() if v < have[s] * most[s] - 1e-6]
    if free:
        assert abs(sum(filled.values()) - size) < 1e-6 * max(1, size)
        assert len({round(filled[s] / share[s], 3) for s in free}) == 1 or max(filled[s] / share[s] for s in free) < 1.001 * min(filled[s] / share[s] for s in free)


def test_mix(spark):
    docs = [(i, "a", 10) for i in range(300)] + [(1000 + i, "b", 10) for i in range(20)] + [(2000, "c", 5), (2001, None, 5), (2002, "b", 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.8, 2), ("b", 0.2, 2), ("d", 0.1, 3)], "source string, target_share double, max_repeats int")
    got = mixing.mix(df, targets).collect()
    assert all(r["n_copies"] == 2 for r in got if r["source"] == "b") and max(r["n_copies"] for r in got) <= 2
    total = sum(r["n_copies"] * r["n_tokens"] for r in got)
    assert abs(total - 3210) <= 20 and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df, targets).collect()))
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0


def _brute(texts):
    """Log-odds of each text's end, counted character by character."""
    usual = Counter(w for t in texts for w in {x for x in truncation._WORD.findall(t) if x[0].isalpha() and "://" not in x})
    usual = {w for w, n in usual.items() if n >= max(4, len(texts) * truncation.USUAL_SHARE)}
    spelled = frozenset(usual | {w[:i] for w in usual for i in range(1, len(w))})
    streams = [truncation.masked(truncation.body(t)[0], spelled) for t in texts]
    ends, on = Counter(), Counter()

    def contexts(s, i):
        padded = "\x02" * 32 + s[:i]
        yield from ((k, padded[-k:]) for k in truncation.LENGTHS)
        if "\n" in s[:i] and s[i - 1] != "\n":
            yield "line", truncation._shape(s[:i]).rpartition("\n")[2]

    for s in streams:
        ends.update(contexts(s, len(s)))
        for i in range(1, len(s)):
            on.update(c for c in contexts(s, i) if c[0] != "line")
        shape = truncation._shape(s)
        for i in range(1, len(shape)):
            if "\n" in shape[:i] and shape[i - 1] != "\n":
                on["line", shape[:i].rpartition("\n")[2]] += 1
    scores = []
    for s in streams:
        share, last = truncation.FIRST_SHARE, None
        for c in contexts(s, len(s)):
            e, g = ends[c] - 1, on[c]
            if c[0] != "line" and (e, g) != last:
                last = e, g
                share = (e + truncation.WEIGHT * share) / (e + g + truncation.WEIGHT)
            elif c[0] == "line" and e + g >= truncation.SEEN:
                share = max(share, (e + 0.1) / (e + g + 0.6))
        scores.append(math.log(share / (1 - share)))
    return scores


def _documents():
    whole = [f"The {a} group checked the {b} tables of release {i}. Data are available at https://x{i}.example without registration." for i, (a, b) in enumerate((a, b) for a in ("first", "second", "third", "curation") for b in ("binding", "folding", "sequence", "pathway", "structure"))]
    docs = [(i, "en", t) for i, t in enumerate(whole * 3)] + [(100 + i, "en", t + "\nKeywords: binding, folding") for i, t in enumerate(whole)] + [(200 + i, None, t + "\nStay tuned for more…") for i, t in enumerate(whole)]
    return docs + [(900, "en", whole[0][:40]), (901, "en", whole[1] + " The first group checked the bind"), (902, "en", whole[2] + " The second group checked the ..."), (903, "en", None), (904, "en", ""), (905, "en", " \n"), (906, "xx", whole[3] + " Data are available [...]"), (907, "en", whole[4] + " The third gro"), (907, "en", whole[5])]


def test_truncation(spark):
    df = spark.createDataFrame([(*d, 1) for d in _documents()], "doc_id long, lang string, text string, rank int")
    found = {r["doc_id"] for r in truncation.truncated(df).collect()}
    assert found >= {900, 901, 902, 906, 907} and not found & {*range(0, 300), 903, 904, 905}
    assert truncation.truncated(df.limit(0)).count() == 0


def test_endings_against_brute_force(spark):
    texts = sorted({t for _, _, t in _documents() if t and t.strip()} | {"x" * 40_000 + " the bind", "数据 可用。", "\ud83d\ude00 a"[2:]})
    df = spark.createDataFrame([(i, i, "en", t) for i, t in enumerate(texts)], "h1 long, h2 long, lang string, text string")
    usual = truncation.usual_words(df)
    read = truncation.read_texts(df, usual | frozenset(w[:i] for w in usual for i in range(1, len(w))))
    got = {r["h1"]: r["log_odds"] for r in read.join(truncation.score_endings(read), "number").collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(_brute(texts), abs=1e-6)


def test_pieces_of_long_texts():
    text = "one two\n" * 100_000
    assert "".join(truncation.pieces(text)) == text and max(map(len, truncation.pieces(text))) <= truncation.PIECE
    assert "".join(truncation.pieces("a" * 1_200_000)) == "a" * 1_200_000
