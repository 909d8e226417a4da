"""Spellings, canonical lists and matching of records."""

import random

from hypothesis import given
from hypothesis import strategies as st

from biblioforge.llm import canonical, names, places, resources
from biblioforge.llm.canonical import Tree, levenshtein, map_values, search
from biblioforge.llm.variants import link_variants, pairs_of


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_tree_returns_all_within(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
    forms = sorted({word() for _ in range(200)})
    tree = Tree((f, f) for f in forms)
    for _ in range(60):
        q = word()
        assert all(levenshtein(q, f) == plain(q, f) for f in forms[:20])
        assert sorted(f for _, f in tree.within(q, 2)) == [f for f in forms if plain(q, f) <= 2]
    assert Tree([]).within("a", 3) == []


def test_map_values_sharded(spark):
    forms = [("alpha", "A"), ("beta", "B"), ("gamma", "G"), ("gamut", "H"), ("berlin", "BN"), ("berlen", "BE"), ("=us", "US"), ("us", "U2"), ("double", "D1"), ("double", "D2"), ("alpha", "A")]
    reader = lambda v: [("=" + v.lower(), 0), (v.lower(), 0), (v.lower(), 1)]
    values = ["Alpha", "bta", "zeta!", None, " ", "alpha", "gammat", "berlan", "us", "double", "doubel", "gamm" + "x" * 5000]
    df = spark.createDataFrame([(v, 1) for v in values], "v string, code int")
    listed = spark.createDataFrame(forms, "form string, code string")
    tree = Tree(forms)
    expected = {v: (hit[2] if (hit := search(tree, v, reader)) else "none") for v in values if v and v.strip()}
    assert expected | {"berlan": "none", "bta": "B", "double": "D1", "doubel": "none"} == expected
    for shard in (100, 3, 1):
        assert {r["value"]: r["code"] for r in map_values(df, "v", listed, reader, shard).collect()} == expected
    assert map_values(df.limit(0), "v", listed, reader).count() == 0
    assert map_values(df, "v", listed.limit(0), reader).where("code <> 'none'").count() == 0


def test_shards_against_brute_force(spark):
    """Ties, swaps and several readings come out as in one comparison with all forms, whatever the shards."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    forms = [(word(7), f"c{i % 9}") for i in range(40)]
    values = sorted({word(7) for _ in range(60)})
    reader = lambda v: [(v, 0), (v, 1), (v[::-1], 2)]

    def brute(v):
        for query, most in reader(v):
            near = [(names.edits(query, f, most), c) for f, c in forms]
            least = min((d for d, _ in near if d <= most), default=None)
            if least is not None and (least == 0 or len({c for d, c in near if d == least}) == 1):
                return min(c for d, c in near if d == least)
        return "none"

    df, listed = spark.createDataFrame([(v,) for v in values], "v string"), spark.createDataFrame(forms, "form string, code string")
    expected = {v: brute(v) for v in values}
    for shard in (1000, 7):
        assert {r["value"]: r["code"] for r in map_values(df, "v", listed, reader, shard).collect()} == expected


def test_many_values_go_down_a_tree_together(monkeypatch):
    """What each finds alone, swaps, ties, long forms and other alphabets included, with few of the distances computed one by one."""
    rng = random.Random(3)
    word = lambda most, letters="abcdé漢": "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
    forms = [word(12) for _ in range(200)] + [word(3) + "x" * rng.randrange(58, 70) + word(3) for _ in range(60)] + ["=ab", "=" + "x" * 80]
    tree = Tree((f, str(rng.randrange(90))) for f in forms)
    asked = [(word(14, "abcdé漢z"), rng.randrange(4)) for _ in range(400)] + [(word(3) + "x" * rng.randrange(57, 72) + word(3), rng.randrange(4)) for _ in range(60)] + [("", 2), ("", 0), ("=ab", 0), ("y" * 10_000, 3)]
    inexact = {f for f in forms if f[:1] != "="}
    expected = [[(0, q)] if not most and q in forms else sorted((d, f) for f in inexact if most and abs(len(f) - len(q)) <= most and (d := levenshtein(q, f)) <= most) for q, most in asked]
    assert [sorted(x) for x in tree.within_all(asked)] == expected
    reader = lambda v: [(v, 0), (v[1:], 1), (v, 2), ("=" + v, 0), (v[:-1], 3)]
    values = [q for q, _ in asked] * 10
    alone = {v: search(tree, v, reader) for v in set(values)}
    monkeypatch.setattr(canonical, "KNOWN", 20)
    assert canonical.search_all(tree, values, reader) == [alone[v] for v in values]
    calls = []
    single = names.Pattern.distance
    monkeypatch.setattr(names.Pattern, "distance", lambda *x: calls.append(1) or single(*x))
    short = Tree((f, f) for f in sorted(inexact) if len(f) < 12)
    calls.clear()
    canonical.search_all(short, [f"{i:05}"[::-1].translate(str.maketrans("0123456789", "abcdéabcdé")) for i in range(2000)], lambda v: [(v, 1)])
    assert len(calls) < 2000


@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 5))
def test_edits(a, b, most):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            swap = [rows[i - 2][j - 2] + 1] if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y else []
            rows[i].append(min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y), *swap))
    assert names.edits(a, b, most) == min(rows[-1][-1], most + 1)


def test_countries():
    tree = Tree(places.country_forms([("DEU", "DE", "Germany"), ("NER", "NE", "Niger"), ("NGA", "NG", "Nigeria"), ("IRL", "IE", "Ireland"), ("TWN", "TW", "Taiwan, Province of China"), ("CHN", "CN", "China")]))
    code = lambda v: (search(tree, v, places.read_country) or (0, 0, None))[2]
    assert [code(v) for v in ("de", " GEMRANY. ", "Republic of Germany", "Trier, Germany", "Deutschland", "Niger", "Nigeria", "Ireland", "Taiwan, Province of China", "P.R. China")] == ["DEU", "DEU", "DEU", "DEU", "DEU", "NER", "NGA", "IRL", "TWN", "CHN"]
    assert code("Iceland") == places.UNLISTED and code("XX") is None and code("") is None


def test_institutions():
    tree = Tree(places.institution_forms([("I1", "University of Malobraglum", "UM"), ("I2", "Center for Plant Science Tazegluny", "CPST")]))
    read = places.institution_reader(frozenset({"US"}))
    code = lambda v: (search(tree, v, read) or (0, 0, None))[2]
    assert code("Dept. of Health, Univ of Malobragulm, Town 123, US.") == "I1" and code("2 Group, CPST, Town, US") == "I2" and code("Center for Plant Science, Tazegluny, Town") == "I2"
    assert code("Malobraglum Brewery, Town") is None and code("Malobraglum Secondary School; US") is None


def test_variants(spark):
    rows = [(1, "National Medical Sciences Research Council of Numubelos", 9), (2, "Natl Medical Sci. Res Cncl of Nummubelos", 1), (3, "Numubelos NMSRC", 1), (4, "Numubelos Academy of Energy", 5), (5, "Acad of Energy, Numubelos", 1),
            (6, None, 0), (7, "", 0), (8, "M. Kysterozy Memorial Fund", 1), (9, "Margareta Kysterozy Mem. Fund", 3), (10, "the Numubelos Academy", 1), (11, "x" * 20_000, 0), (12, "MARGARETA KYSTEROZY MEMORIAL FUND", 1)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "id long, name string, n long, canonical string").drop("canonical")
    groups = {}
    for r in link_variants(df).collect():
        groups.setdefault(r["canonical"], set()).add(r["id"])
    assert {frozenset(v) for v in groups.values() if len(v) > 1} == {frozenset({1, 2, 3}), frozenset({4, 5, 10}), frozenset({8, 9, 12})}
    assert link_variants(df.limit(0)).count() == 0
    members = spark.createDataFrame([(i, 0) for i in range(1200)] + [(5000, 1)], "id long, canonical long")
    assert pairs_of(members).count() == 1200 * 1199 // 2


def test_variants_without_a_proper_word(spark):
    rows = [(1, "National Science Foundation", 9), (2, "Natl. Sci. Found", 1), (3, "NATIONAL SCIENCE FOUNDATION", 1), (4, "NSF", 2), (5, "Medical Research Council", 3), (6, "Med Res Cncl", 1), (7, "Margareta Memorial Fund", 2), (8, "M. Memorial Fund", 1),
            (9, "3 M", 1), (10, " 3  m", 1), (11, "4 M", 1), (12, None, 0), (13, " ", 0), (14, "National Science Agency", 1), (15, "M.", 1)]
    groups = {}
    for r in link_variants(spark.createDataFrame(rows, "id long, name string, n long")).collect():
        groups.setdefault(r["canonical"], set()).add(r["id"])
    assert set(map(frozenset, groups.values())) == {frozenset(x) for x in ({1, 2, 3, 4}, {5, 6}, {7, 8}, {9, 10}, {11}, {14}, {15})}


def test_name_reading():
    r = names.read("Glebykretil Assn for Food Safty Rsrch (GAFSR)")
    assert r.proper == ("glebykretil",) and r.bag == ("association", "food", "research", "safety")


def test_resources():
    r = resources.read(("AHPdb", None, "The Amphibian haplotype polymorphism Database (AHPdb)"), "HTTP://www.Ahpdb.zugybebrar.example:80/~tools/home_AND_https://b.example")
    assert r.shorts == ("ahpdb",) and r.full == ("amphibian", "haplotype", "polymorphism", "database") and r.urls == ("ahpdb.zugybebrar.example/~tools", "b.example/")
    assert r.plain == ("amphibian", "haplotype", "polymorphism", "database") and "zugybebrar" in r.tokens
    assert resources.read(("", None), None).tokens == [] == resources.read((" ; ",), " , ").tokens
