import random

import pytest

from sparkloom.operators import containment as ct


def tables(seed):
    rng = random.Random(seed)
    letters = "abcdé😀 "
    piece = lambda a, b: "".join(rng.choices(letters, k=rng.randrange(a, b)))
    texts = [(i, piece(1, 400)) for i in range(60)] + [(100, None), (101, ""), (102, "   "), (103, "ABC"), (104, "x" * 50_000), (103, "second of one id")]
    cut = lambda t, n: t[(at := rng.randrange(max(1, len(t) - n))) : at + n]
    patterns = [(i, cut(rng.choice(texts[:60])[1], rng.choice([1, 2, 5, 7, 8, 9, 15, 16, 17, 40, 100]))) for i in range(80)]
    patterns += [(200, None), (201, ""), (202, " "), (203, " aBc "), (204, "x" * 20_000), (205, piece(30, 60)), (206, "x"), (203, "ID")]
    return patterns, texts


def brute(patterns, texts):
    clean = lambda t: (t or "").strip(" ").lower()
    return {(p, t) for p, x in patterns for t, y in texts if clean(x) and clean(y) and clean(x) in clean(y)}


@pytest.mark.parametrize("most", [ct.AUTOMATON, 0])
def test_both_ways_equal_comparing_everything(spark, most):
    patterns, texts = tables(1)
    a, b = spark.createDataFrame(patterns, "p long, x string").repartition(3), spark.createDataFrame(texts, "t long, y string").repartition(3)
    want = brute(patterns, texts)
    assert len(want) > 200
    assert sorted(tuple(r) for r in ct.contained(a, b, "p", "x", "t", "y", most).collect()) == sorted(want)
    back = {(p, t) for t, p in brute(texts, patterns)}
    assert sorted(tuple(r) for r in ct.either_way(a, b, "p", "x", "t", "y", most).collect()) == sorted(want | back)
    assert ct.contained(a.filter("false"), b, "p", "x", "t", "y", most).collect() == []
    assert ct.contained(a, b.filter("false"), "p", "x", "t", "y", most).collect() == []


def test_an_anchor_of_a_pattern_is_one_of_every_text_that_holds_it():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices("ab", k=rng.randrange(1, 200)))
        at = rng.randrange(len(text))
        p = text[at : at + rng.randrange(1, 100)]
        w = ct.level(len(p))
        assert w <= len(p) and len(ct.anchors(p[:w], w)) >= 1
        assert ct.anchors(p[:w], w)[0] in ct.anchors(text, w)
    assert len(ct.anchors("".join(rng.choices("abcdefgh", k=5000)), 128)) < 200  # windows share anchors
