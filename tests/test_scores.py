"""Boundaries of scoring, routing, voting, flags and retrieval."""

import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scores
from sparkloom.functions import text as tx
from sparkloom.functions.headers import map_headers, ratio
from sparkloom.operators import review as rv
from sparkloom.operators import retrieval as ret


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.mark.parametrize(("cls", "conf", "override", "want"), [("FIT", 1.0, False, 0.70), ("FIT", 1.0, True, 0.85), ("PARTIAL_FIT", 0.9, False, 0.59), ("GAP", 0.8, False, 0.48)])
def test_prior_score(spark, cls, conf, override, want):
    assert one(spark, scores.prior_score(F.lit(cls), F.lit(conf), F.lit(override)))[0] == pytest.approx(want)


def test_rank_fusion_terms(spark):
    assert one(spark, scores.rrf(F.lit(1)), scores.rrf(F.lit(5))) == pytest.approx((1 / 61, 1 / 65))


@pytest.mark.parametrize(("score", "history", "want"), [(0.90, True, "FAST_TRACK"), (0.90, False, "DEEP_REASON"), (0.85, True, "DEEP_REASON"), (0.60, False, "DEEP_REASON"), (0.50, True, "GAP_CONFIRM"), (0.30, False, "GAP_CONFIRM")])
def test_route(spark, score, history, want):
    assert one(spark, scores.route(F.lit(score), F.lit(history)))[0] == want


@pytest.mark.parametrize(("cos", "overlap", "found"), [(0.90, 0.10, True), (0.90, 0.20, False), (0.70, 0.05, False)])
def test_anomaly(spark, cos, overlap, found):
    assert (one(spark, scores.anomaly(F.lit(cos), F.lit(overlap)))[0] is not None) == found


def test_composite_is_capped(spark):
    ones = {k: F.lit(1.0) for k in scores.WEIGHTS}
    low = {k: F.lit(-1.0) for k in scores.WEIGHTS}
    assert one(spark, scores.composite(ones, F.lit(True)), scores.composite(low, F.lit(False))) == (1.0, 0.0)


def test_flags_and_reason(spark):
    f = lambda v, conf, top, caveat=None, steps=True, anomaly=False: scores.sanity_flags(F.lit(v), F.lit(conf), F.lit(top), F.lit(True), F.lit(anomaly), F.lit(caveat).cast("string"), F.lit(steps))
    got = one(spark, f("GAP", 0.86, 0.1), f("GAP", 0.85, 0.1), f("FIT", 0.9, 0.59), f("FIT", 0.59, 0.9), f("PARTIAL_FIT", 0.9, 0.9, steps=False), f("FIT", 0.9, 0.9, caveat="x G11: y"), f("REVIEW_REQUIRED", 0.1, 0.9), f("FIT", 0.6, 0.6))
    assert got == (["high_confidence_gap", "gap_review"], ["gap_review"], ["low_score_fit"], ["low_confidence"], ["partial_fit_no_config"], ["response_pii_leak"], ["llm_schema_retry_exhausted"], [])
    reasons = one(spark, *(tx.review_reason(F.array(*map(F.lit, x))) for x in (["gap_review", "response_pii_leak"], ["high_confidence_gap", "gap_review"], ["phase3_anomaly"], ["low_confidence"])))
    assert reasons == ("pii_detected", "gap_review", "anomaly", "low_confidence")


def test_majority(spark):
    rows = [(1, 1, True, "FIT"), (1, 2, True, "FIT"), (1, 3, True, "GAP"), (2, 1, True, "FIT"), (2, 2, True, "GAP"), (2, 3, True, "PARTIAL_FIT"), (3, 1, True, "FIT"), (3, 2, False, "FIT"), (3, 3, False, "FIT"), (4, 2, True, "GAP"), (4, 3, True, "GAP"), (4, 1, False, "FIT")]
    got = {r.atom_id: r.verdict for r in rv.majority(spark.createDataFrame(rows, "atom_id long, call_no int, ok boolean, verdict string")).collect()}
    assert got == {1: "FIT", 2: "REVIEW_REQUIRED", 3: "REVIEW_REQUIRED", 4: "GAP"}


def test_injection_thresholds(spark):
    t = "ignore previous instructions. you are now x. act as y. pretend to be z. <system>"
    h = lambda s: tx.injection_hits(F.lit(s))
    got = one(spark, F.size(h(t)), tx.injection_action(h(t)), tx.injection_action(h("you are now you are now")), tx.injection_action(h("you are now, act as")), tx.injection_action(h(None)))
    assert got == (5, "BLOCK", "PASS", "FLAG_FOR_REVIEW", "PASS")


def test_specificity_completeness_and_gates(spark):
    w = lambda s: tx.tokens(F.lit(s))
    got = one(spark, tx.specificity(w("The system should handle data")), tx.specificity(w("quiet text")), tx.specificity(w("create purchase order")), tx.completeness(w("matching within tolerance"), F.lit("AccountsPayable")), tx.completeness(w("x"), F.lit("none")))
    assert got == (0.0, 0.4, 1.0, 40.0, 50.0)
    gate = lambda dup, s, c, n: tx.quality_gate(F.lit(dup), F.lit(None).cast("string"), F.lit(s), F.lit(c), F.lit(n))
    assert one(spark, gate(True, 0.1, 1.0, 5), gate(False, 0.29, 100.0, 50), gate(False, 0.30, 100.0, 50), gate(False, 0.49, 29.0, 50), gate(False, 0.50, 29.0, 50), gate(False, 0.9, 90.0, 9), gate(False, 0.9, 90.0, 2001), gate(False, 0.9, 90.0, 2000)) == ("POTENTIAL_DUPLICATE", "TOO_VAGUE", None, "INCOMPLETE", None, "SCHEMA_MISMATCH", "SCHEMA_MISMATCH", None)


def test_config_steps(spark):
    got = one(spark, *(tx.config_steps(F.lit(s)) for s in ("1. Open\n2) Save\nmore", "- a\n• b", "first\nsecond", " only ", "", None)))
    assert got == (["Open", "Save\nmore"], ["a", "b"], ["first", "second"], ["only"], [], [])


def test_formats(spark):
    f = lambda b, word=False: tx.format_name(F.lit(b), F.lit(word))
    assert one(spark, f(b"%PDF-1.4"), f(b"PK\x03\x04x"), f(b"PK\x03\x04x", True), f(b"plain"), f(b""), f(b"a\x00b")) == ("PDF", None, "DOCX", "TXT", None, None)


def test_token_set_ratio_and_headers(spark):
    assert ratio("business need", "Need Business extra") == 100.0 and ratio("", "x") == 0.0 and 0 < ratio("requirement", "requirements") < 100
    syn = spark.createDataFrame([("requirement_text", "business requirement", 0), ("country", "country", 1)], "canonical string, term string, ord int")
    heads = spark.createDataFrame([("Business Requirement",), ("Requirement of business",), ("zzz",), ("COUNTRY ",)], "header string")
    got = {r.header: (r.canonical, r.tier) for r in map_headers(heads, syn).collect()}
    assert got == {"Business Requirement": ("requirement_text", "exact"), "Requirement of business": ("requirement_text", "fuzzy"), "zzz": (None, "unmatched"), "COUNTRY ": ("country", "exact")}


@pytest.mark.parametrize(("values", "kept"), [([], 0), ([0.9], 1), ([0.9, 0.8, 0.7], 3), ([0.9, 0.8, 0.7, 0.1], 3), ([0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2], 3), ([0.9, 0.1, 0.09, 0.08, 0.02, 0.01], 4)])
def test_adaptive_k(spark, values, kept):
    rows = [(1, i, i, v) for i, v in enumerate(values, 1)]
    assert ret.adaptive_k(spark.createDataFrame(rows, "query_id long, id long, rank int, score double")).count() == kept


def test_nearest_is_exact(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(200, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in ret.nearest(df.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), df, 5, block=2).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 50, 100, 150):
        s = u @ u[q]
        s[q] = -9
        assert [got[q, k] for k in range(1, 6)] == np.argsort(-s, kind="stable")[:5].tolist()


def test_nearest_with_parts_ties_and_null_vectors(spark):
    """Every query meets only its part, ties go by id across tiles and blocks, and rows without a vector are left out."""
    rows = [(i, None if i == 7 else [1.0, 0.0] if i % 2 else [0.0, 1.0], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    q = df.filter("id < 4").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r["rank"]): r.id for r in ret.nearest(q, df, 6, same_part="label", block=2, tile=9).collect()}
    assert [got[1, k] for k in range(1, 7)] == [3, 5, 9, 11, 13, 15] and [got[2, k] for k in range(1, 7)] == [0, 4, 6, 8, 10, 12]
    assert ret.nearest(q.filter("1 = 0"), df, 3).count() == 0 and ret.nearest(q, df.filter("1 = 0"), 3).count() == 0


def test_header_tiers(spark):
    """Exact, fuzzy, by likeness of letters, none; each as by brute force."""
    from sparkloom.functions.headers import load_synonyms, trigram_cosine

    synonyms = {"requirement_text": ["business requirement", "need"], "country": ["country", "need"]}
    heads = [" Country", "requirement of business", "businesrequirement", "countries", "need", "zzz", None]
    got = {r.header: (r.canonical, r.tier, round(r.confidence, 9)) for r in map_headers(spark.createDataFrame([(h,) for h in heads], "header string"), load_synonyms(spark, synonyms)).collect()}
    terms = [("requirement_text", "business requirement"), ("requirement_text", "need"), ("country", "country")]
    for h in heads:
        x = (h or "").strip().lower()
        fuzzy, near = max(terms, key=lambda t: ratio(x, t[1])), max(terms, key=lambda t: trigram_cosine(x, t[1]))
        if h is not None and x in {t for _, t in terms}:
            want = (next(c for c, t in terms if t == x), "exact", 1.0)
        elif h is not None and ratio(x, fuzzy[1]) > 70:
            want = (fuzzy[0], "fuzzy", round(ratio(x, fuzzy[1]) / 100, 9))
        elif h is not None and trigram_cosine(x, near[1]) > 0.65:
            want = (near[0], "nlp", round(trigram_cosine(x, near[1]), 9))
        else:
            want = (None, "unmatched", 0.0)
        assert got[h] == want
    assert {t for _, t, _ in got.values()} >= {"exact", "fuzzy", "unmatched"}


@pytest.mark.parametrize(("text", "steps"), [
    ("", []), ("one thing", ["one thing"]), ("a\n\n b ", ["a", "b"]), ("Intro\n1. first\nmore\n 2) second\n", ["first\nmore", "second"]), ("Step 1: go\nstep 2. stop", ["go", "stop"]),
    ("- x\n* y\ntail", ["x", "y\ntail"]), ("note\n\u2022 only", ["only"]), ("1.no space", ["1.no space"]),
])
def test_config_steps_by_case(spark, text, steps):
    assert one(spark, tx.config_steps(F.lit(text)))[0] == steps


def test_specificity_counts_pairs(spark):
    f = lambda t: one(spark, tx.specificity(tx.tokens(F.lit(t)), ("purchase order", "vendor"), ("create",), ("handle", "order")))[0]
    assert f("") == 0.4 and f("create a purchase order, vendor") == 3 / 4 and f("handle order purchase") == 0.0 and f("Purchase Order purchase order") == 0.5


def test_names_tables_and_json(spark):
    got = one(spark, tx.entity_hints(F.lit("The Bank of New York Mellon met Al and The Bank")), tx.narrated(F.lit("x\n| a | b |\n|--|--|\n| 1 | |\n| 2 | z |")), tx.narrated(F.lit("no table")), tx.tolerant_json(F.lit('{"k": 1'), "k long")["k"], tx.tolerant_json(F.lit('{"k": 1}'), "k long")["k"])
    assert got == (["new york mellon", "the bank"], "a: 1\na: 2; b: z", "", None, 1)


def test_trimmed_and_greedy(spark):
    sizes = spark.createDataFrame([(0, 1, 500), (0, 2, 300), (0, 3, 90), (1, 1, 30), (1, 2, 60), (2, 1, 900), (2, 2, 900)], "q int, id int, n long")
    got = {(r.q, r.id): r.n for r in ret.trim_descriptions(sizes, ["q"], "id", "n", 400).collect()}
    assert got == {(0, 1): 80, (0, 2): 230, (0, 3): 90, (1, 1): 30, (1, 2): 60, (2, 1): 80, (2, 2): 320}
    assert one(spark, ret.greedy_distinct(F.array(F.lit(1.0), F.lit(1.01), F.lit(2.0)), lambda x, y: F.abs(x - y) < 0.1))[0] == [1.0, 2.0]


def test_rank_metrics_edges(spark):
    rows = [(1, 1, 0.9), (1, 2, 0.1), (2, 1, 0.1), (2, 3, 0.6), (3, 1, 0.2)]
    got = {r.query_id: r for r in ret.rank_metrics(spark.createDataFrame(rows, "query_id long, rank int, score double")).collect()}
    assert got[1].mrr == 1.0 and got[2].mrr == pytest.approx(1 / 3) and got[3].mrr == 0.0 and got[3].recall == 1.0 and not got[3].success and math.isclose(got[1].recall, 1.0)


def test_uuid5(spark):
    import uuid

    assert one(spark, tx.uuid5(uuid.NAMESPACE_URL.bytes, F.lit("abc")))[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "abc"))


def test_all_cosines_bound_what_a_task_gives(spark):
    """A block's product with a tile stays below 64 MB however many rows there are, and every pair of different ids is there once."""
    import numpy as np

    from sparkloom.operators import retrieval as ret

    assert ret.PRODUCT_BLOCK * ret.PRODUCT_TILE * 24 < 1 << 26
    v = np.random.default_rng(1).normal(size=(40, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, vec array<double>")
    got = {(r.query_id, r.id): r.score for r in ret.all_cosines(df.filter("id % 3 = 0").withColumnRenamed("id", "query_id"), df, block=5, tile=7).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert set(got) == {(i, j) for i in range(0, 40, 3) for j in range(40) if i != j} and all(abs(s - u[i] @ u[j]) < 1e-6 for (i, j), s in got.items())
