import random

import pytest

from sparkloom.functions import headers
from sparkloom.operators import fuzzy


def names(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéß", k=rng.randrange(1, 10))) for _ in range(60)]
    out = []
    for _ in range(n):
        w = rng.choices(words, k=rng.randrange(1, 6))
        if rng.random() < 0.5:  # misspelt
            i = rng.randrange(len(w))
            w[i] = w[i][: len(w[i]) // 2] + rng.choice("abcz") + w[i][len(w[i]) // 2 + 1 :]
        out.append(" ".join(w))
    return out


ODD = [None, "", "  ", "a", "A  a", "a b c d e f g h", "x" * 300, "x" * 200 + " y", "req id", "Requirement ID", "requirement-id"]


@pytest.mark.parametrize("above", [70.0, 85.0, 40.0])
def test_no_pair_above_the_ratio_is_lost(spark, above, monkeypatch):
    monkeypatch.setattr(fuzzy, "TILE", 60)
    a, b = names(1, 150) + ODD, names(2, 170) + ODD
    want = {(x, y): headers.ratio(x, y) for x in a if x is not None for y in b if y is not None if headers.ratio(x, y) > above}
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "t string").repartition(3)
    got = {(r.x, r.y): r.score for r in fuzzy.ratio_pairs(frame(a), frame(b), above).collect()}
    assert len(want) > 20 and got == pytest.approx(want)
    assert fuzzy.ratio_pairs(frame(a).filter("false"), frame(b), above).collect() == []


@pytest.mark.parametrize("above", [0.65, 0.3])
def test_no_pair_above_the_cosine_is_lost(spark, above):
    a, b = names(3, 120) + ODD, names(4, 130) + ODD
    want = {(x, y): headers.trigram_cosine(x, y) for x in a if x is not None for y in b if y is not None if headers.trigram_cosine(x, y) > above}
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "t string").repartition(3)
    got = {(r.x, r.y): r.score for r in fuzzy.trigram_pairs(frame(a), frame(b), above).collect()}
    assert len(want) > 10 and got == pytest.approx(want)


def test_headers_against_a_hundred_thousand_terms(spark):
    words = spark.range(100_000).selectExpr("concat('t', id, ' field ', conv(id * 7919, 10, 36)) term", "concat('c', id) canonical", "CAST(id AS int) ord")
    heads = ["t77 field c7l3", "field t500 9999", "T99999 Field", "unlike anything"]
    got = {r.header: (r.canonical, r.tier) for r in headers.map_headers(spark.createDataFrame([(h,) for h in heads], "header string"), words).collect()}
    terms = [(r.term, r.canonical, r.ord) for r in words.collect()]
    for h in heads:
        best = max(((headers.ratio(h.lower(), t), -o, c) for t, c, o in terms))
        if best[0] > 70:
            assert got[h] == (best[2], "fuzzy")
    assert got["unlike anything"][1] in ("unmatched", "nlp") and sum(v[1] == "fuzzy" for v in got.values()) >= 2
