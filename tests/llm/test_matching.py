"""Records of two sources meet, are compared by cosines and judged by the calibration."""

import math
import random
import time

import numpy as np
import pytest

from biblioforge.llm import matching as m
from biblioforge.llm import queries_matching as q
from biblioforge.llm import resources
from biblioforge.session import release

COLUMNS = "source string, key string, names array<string>, address string"


def _made(n=240, seed=4):
    """Records of an inventory and a registry with slips, missing and moved addresses; gives the rows and the true pairs."""
    rng = random.Random(seed)
    part = lambda: rng.choice("b d f g k l m n p r s t v z br dr fl gl kr st tr".split()) + rng.choice("aeiouy")
    kinds, things, ends = "Plant Yeast Rice Human Viral Moss Coral Maize".split(), "gene toxin protein enzyme lipid exon".split(), "Database Atlas Archive Portal".split()
    rows, true = [], set()
    for i in range(n):
        coined = "".join(part() for _ in range(4)).title()
        full = f"{rng.choice(kinds)} {rng.choice(things)} {rng.choice(things)} {rng.choice(ends)}"
        url = f"https://{coined.lower()}.{rng.choice(['org', 'net', 'edu'])}.example/{coined.lower()}db"
        rows.append(("inventory", str(i), [coined + "DB", coined + "DB", full if rng.random() < 0.7 else None], url))
        if rng.random() < 0.6:
            k = rng.randrange(1, len(coined) - 1)
            name = coined[:k] + coined[k + 1:] if rng.random() < 0.2 else coined
            address = None if rng.random() < 0.1 else url.replace("https", "http").upper() if rng.random() < 0.9 else f"https://hosting.example/{coined.lower()}/"
            rows.append(("re3data", f"r{i}", [f"{name}DB: {full}"], address))
            true.add((str(i), f"r{i}"))
        else:
            other = "".join(part() for _ in range(4)).title()
            rows.append(("re3data", f"x{i}", [f"{other}DB ({full})"], f"https://{other.lower()}.org.example/"))
    return rows, true


@pytest.fixture(scope="module")
def made(spark):
    rows, true = _made()
    return q.read_records(spark.createDataFrame(rows, COLUMNS)), true


def _keys(records, pairs):
    """The keys of pairs of record numbers."""
    key = {r["rid"]: r["key"] for r in records.collect()}
    return {(key[r["l"]], key[r["r"]]) for r in pairs.collect()}


def test_true_pairs_come_out(made):
    records, true = made
    found = _keys(records, q.matches(records))
    assert len(found & true) >= 0.95 * len(true) and len(found & true) >= 0.95 * len(found)


def test_blocks_against_all_pairs(made):
    """Of the true pairs that the calibration accepts among all pairs, nearly all meet in a block."""
    records, true = made
    shown = m.unpacked(records)
    stats, table = q.token_stats(shown), m.start_table()
    every = q.with_holders(shown).withColumnsRenamed({"rid": "l", "record": "a"}).join(q.with_kind(shown).withColumnsRenamed({"rid": "r", "record": "b"}))
    brute = _keys(records, m.calibrated(m.compare(every, table, stats)).where(f"confidence >= {q.LEAST}")) & true
    met = _keys(records, m.candidate_pairs(shown, table, stats))
    assert len(brute & met) >= 0.98 * len(brute) and len(met) < 0.2 * every.count()


def test_slips_and_full_names_meet(spark):
    rows = [
        ("inventory", "1", ["NigloglalulKB"], None), ("inventory", "2", [None, "", "Coral protein splicing Browser"], ""), ("inventory", "3", ["Vonyrapus Atlas"], "https://a.example/x"),
        ("inventory", "4", [""], None), ("inventory", "5", ["Rabodatu"], "https://same.place.example/Home"),
        ("re3data", "1", ["NigloglalluKB"], None), ("re3data", "2", ["Dydastufes: Coral protein splicing Browser"], None), ("re3data", "3", ["Vonyrapsu Atlas"], None),
        ("re3data", "4", [None], ""), ("re3data", "5", ["Ribotrekom"], "http://www.same.place.example:80/"), ("re3data", "5", ["Ribotrekom"], "http://www.same.place.example:80/"),
    ]
    records = q.read_records(spark.createDataFrame(rows, COLUMNS).dropDuplicates(["source", "key"]))
    assert records.count() == 8
    shown = m.unpacked(records)
    met = _keys(records, m.candidate_pairs(shown, m.start_table(), q.token_stats(shown)))
    assert {("1", "1"), ("2", "2"), ("3", "3"), ("5", "5")} <= met and ("1", "5") not in met


def test_near_tokens_meet(spark):
    """Of the pairs with similar tokens (no slips) nearly all meet, whatever part of the work the hyperplanes have."""
    rng = random.Random(6)
    part = lambda: rng.choice("b d f g k l m n p r s t v z".split()) + rng.choice("aeiouy")
    rows = []
    for i in range(150):
        coined = "".join(part() for _ in range(8)).title()
        rows += [("inventory", str(i), [coined], None), ("re3data", str(i), [coined + rng.choice(["Db", "Kb", "Hub"])], None)]
    records = q.read_records(spark.createDataFrame(rows, COLUMNS))
    shown = m.unpacked(records)
    stats, table = q.token_stats(shown), m.start_table()
    near = {k for k, (a, b) in enumerate(zip(rows[::2], rows[1::2])) if m.vector(a[2][0].lower(), table) @ m.vector(b[2][0].lower(), table) >= m.NEAR}
    met = {int(a) for a, b in _keys(records, m.candidate_pairs(shown, table, stats)) if a == b}
    assert len(near) > 20 and len(near & met) >= 0.9 * len(near)


def test_large_blocks_stay_whole(spark):
    n = 3 * m.PIECE + 7
    side = lambda lo, count: spark.range(lo, lo + count).selectExpr("id as rid", "0 as kind", "cast(5 as long) as code")
    met = m.meetings(side(0, n), side(10_000, 90), ["kind", "code"])
    assert met.count() == met.distinct().count() == 90 * n
    assert m.meetings(side(0, n), side(0, 0), ["kind", "code"]).count() == 0


def test_empty_sides(spark):
    rows, _ = _made(12)
    for keep in ("inventory", "re3data", "none"):
        records = q.read_records(spark.createDataFrame([r for r in rows if r[0] == keep], COLUMNS))
        assert q.matches(records).count() == 0


def test_training_draws_companions_together():
    """Words that stand in the same names become alike, and no two words the same."""
    rng = random.Random(2)
    walks = [[rng.choice(["seed", "weather"]), "museum", "history"] if i % 2 else ["protein", rng.choice(["enzyme", "lipid"]), f"base{i % 7}"] for i in range(4000)]
    table = m.start_table()
    for i in range(8):
        table = m.train_step(walks[500 * i:500 * (i + 1)], table, i)
    cosine = lambda a, b, t: float(m.vector(a, t) @ m.vector(b, t))
    gain = lambda a, b: cosine(a, b, table) - cosine(a, b, m.start_table())
    assert gain("museum", "history") > 0.1 > gain("museum", "protein") and cosine("museum", "history", table) < 0.98
    assert np.array_equal(m.train_step([], table, 1), table)


def test_cosines_by_attribute():
    def side(names, url=""):
        return m._Side(m.pack(resources.read(names, url)), m.start_table(), m.Stats(1, {}, frozenset(), frozenset()), {})

    a = side(("AHPdb", "Amphibian haplotype polymorphism Database"), "https://ahpdb.zugybebrar.example/~tools/AHPdb")
    b = side(("Amphibian haplotype polymorphism Database_AND_ahpdb",), "ahpdb.zugybebrar.example/~tools/AHPdb/")
    c = side(("Amphibian enhancer dynamics Database",), "https://www.tudryzitum.org.example/")
    assert np.allclose(m.cosines(a, b), (1, 1, 1, 1, 1), atol=1e-5)
    name, worst, cover, url, holders = m.cosines(a, c)
    assert worst < 0.5 and url < 0.6 and holders == 0
    assert all(math.isnan(x) for x in m.cosines(side(("",)), a)[:4])


def test_each_step_leaves_no_shuffle_files(spark, made, monkeypatch):
    """When the pairs are scored the disk holds nothing of the walks, the training and the blocks."""
    manager = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    records, _ = made
    held = []
    compare = m.compare
    monkeypatch.setattr(m, "compare", lambda *a: held.append(manager.shuffleStatuses().size()) or compare(*a))
    release(spark)
    time.sleep(1)
    before = manager.shuffleStatuses().size()
    pause = q.release
    monkeypatch.setattr(q, "release", lambda s: (pause(s), time.sleep(1)))
    q.matches(records)
    assert held[0] <= before + 2
