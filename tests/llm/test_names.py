import itertools
import random

import pytest

from engramix.llm import name_forms as N
from engramix.llm import names

FULL = ["Gustav Volarford", "Wanda Volarford", "Benjamin Tririvdal", "Katherine Dadulic", "Wadantech Freight Holdings AB", "Harumova Textile Systems GmbH"]
VARIANTS = {
    0: ["GUSTAV VOLARFORD", "Volarford, Gustav", "G. Volarford", "Gustav Volarfrd", "Dr. Gustav Volarford", "Gustav Volarford", "gustav.volarford", "Gustav Volarford's", "Gustav Volarford (she)"],
    1: ["Wanda Volarfford", "Volarford Wanda", "W. Volarford"],
    2: ["Benny Tririvdal", "Bejamin Tririvdal", "Ben Tririvdla"],
    3: ["Dadulic, K.G.", "Katherine G. Dadulic"],
    4: ["wadantech freight holdings", "The Wadantech Freight Holdings", "WADANTECH FREIGHT HOLDINGS A.B.", "Wadantech FH", "Wadantech-Freight Hldgs AB", "Wadantech Freiight Holdings AB", "Wadantech Freight & Co Holdings"],
    5: ["Textile Systems Harumova", "Harumova Textile Sys. GmbH"],
}


def test_lcs_ratio_equals_the_table():
    def table(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            rows[i + 1][j + 1] = rows[i][j] + 1 if a[i] == b[j] else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        assert N.lcs(a, b) == table(a, b)


def test_variants_are_linked_and_relatives_are_not(spark):
    rows = [(f, 1) for f in FULL] + [(v, 1) for vs in VARIANTS.values() for v in vs] * 2 + [(None, 1), ("", 1), ("...", 1), ("tea", 1), ("x" * 50_000, 1)]
    found = {tuple(r) for r in names.variant_pairs(spark.createDataFrame(rows, "name string, form int")).collect()}
    want = set()
    for i, vs in VARIANTS.items():
        group = [FULL[i], *vs]
        want |= {tuple(sorted(p)) for p in itertools.combinations(group, 2)}
    assert found == want


def test_large_blocks_lose_nothing(spark):
    rnd = random.Random(5)
    surnames = ["".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(3)) + "ford" for _ in range(150)]
    rows = []
    for s in set(surnames):
        rows += [(f"Anna {s.title()}",), (f"{s.title()}, Anna",), (f"Anna {s.title()[:-1]}",)]
    got = names.entities(spark.createDataFrame(rows, "name string")).collect()
    by = {r["name"]: r["entity"] for r in got}
    assert all(by[f"Anna {s.title()}"] == by[f"{s.title()}, Anna"] == by[f"Anna {s.title()[:-1]}"] for s in set(surnames))


def test_misspellings_are_told_by_share_not_by_count(spark):
    firms = [f"{x} Harbour Services" for x in ("Zurovane", "Plenkitar", "Mogalist", "Dwebbany", "Kixotral", "Fuhandro", "Oslimeck", "Jartevun")]
    wrong = [f.replace("Harbour", "Harbbour") for f in firms[:5]]
    family = ["Volarford", "Tririvdal", "Dadulic", "Muckenz", "Sepoglia", "Quandrow", "Ysbeteln", "Haxumni", "Bojwirk"]
    people = [f"Thomas {s}" for s in family[:5]] + [f"Tomas {s}" for s in family[4:]]
    found = {tuple(r) for r in names.variant_pairs(spark.createDataFrame([(n,) for n in firms + wrong + people], "name string")).collect()}
    assert found == {tuple(sorted((f, w))) for f, w in zip(firms, wrong)}


def test_blocks_of_any_size_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(names, "SLICE", 50, raising=False)
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(n))
    made = {("anna", "ber" + word(3)) for _ in range(110)} | {("freight", "holdings", word(4)) for _ in range(110)} | {("anna", "bergsted"), ("anna", "bergstad"), ("benny", "tririvdl"), ("benjamin", "tririvdal"), ("freight", "holdings", "zurovanelit"), ("freight", "hldgs", "zurvanelit")}
    made |= {(*f[:-1], f[-1][:2] + f[-1][3:]) for f in sorted(made)[::9]}
    forms = sorted({tuple(sorted(f)) for f in made})
    want = {(" ".join(f), " ".join(g)) for f, g in itertools.combinations(forms, 2) if N.spellings(f, g)}
    monkeypatch.setattr(names, "_confirmed", lambda _, found: found.select("src", "dst").distinct())
    frame = spark.createDataFrame([(" ".join(f), list(f)) for f in forms], "form string, words array<string>")
    assert {tuple(sorted(r)) for r in names.link_forms(frame, 0.8).collect()} == {tuple(sorted(p)) for p in want}
    assert ("anna bergstad", "anna bergsted") in want and any("hldgs" in f for f, _ in want)


def test_names_of_one_word_and_without_the_middle(spark, monkeypatch):
    monkeypatch.setattr(names, "SLICE", 3)
    rows = ["Zurovane Ltd", "ZUROVANE Limited", "Zurovane", "Ostenby", "OSTENBY", "Maria Elena Hivelberg", "Maria Hivelberg", "HIVELBERG, Maria", "Maria E. Hivelberg", "Otto Tarevmont", "Otto Emil Tarevmont", "Otto Karl Tarevmont"]
    found = {tuple(r) for r in names.variant_pairs(spark.createDataFrame([(n,) for n in rows], "name string")).collect()}
    groups = [rows[:3], rows[5:9]]
    assert found == {tuple(sorted(p)) for g in groups for p in itertools.combinations(g, 2)}


def test_empty(spark):
    assert names.variant_pairs(spark.createDataFrame([], "name string")).count() == 0


@pytest.mark.parametrize("a,b,want", [("mfg", "manufacturing", True), ("hldgs", "holdings", True), ("benny", "benjamin", True), ("max", "mirko", False), ("ann", "anna", False)])
def test_short_forms(a, b, want):
    assert N.short_of(a, b) is want
