"""Phrases against a plain count, an encoder that fails, and the country rule of ingestion."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.operators import models, phrases, pipelines


def brute(docs, support, least):
    pairs = [(i, p, a, b) for i, w in docs for p, (a, b) in enumerate(zip(w, w[1:]))]
    n, first, second = Counter((a, b) for _, _, a, b in pairs), Counter(a for _, _, a, _ in pairs), Counter(b for *_, b in pairs)
    total = len(pairs)
    term = lambda k, r, c: k * math.log(k * total / (r * c)) if k > 0 else 0.0

    def llr(a, b):
        k, f, s = n[a, b], first[a], second[b]
        return 2 * (term(k, f, s) + term(f - k, f, total - s) + term(s - k, total - f, s) + term(total - f - s + k, total - f, total - s))

    known = {p for p in n if n[p] >= support and llr(*p) >= least and n[p] * total > first[p[0]] * second[p[1]]}
    out = []
    for i, w in docs:
        at = 0
        while at < len(w) - 1:
            if (w[at], w[at + 1]) not in known:
                at += 1
                continue
            end = at
            while end < len(w) - 1 and (w[end], w[end + 1]) in known:
                end += 1
            for cut in range(at, end, phrases.MOST_WORDS - 1):
                words = w[cut : min(end, cut + phrases.MOST_WORDS - 1) + 1]
                out.append((i, cut, len(words), " ".join(words)))
            at = end
    return known, sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    fixed = ["new york stock exchange", "fixed asset", "a b c d e f g h i j k l"]
    docs = []
    for i in range(80):
        words = []
        for _ in range(rng.randrange(0, 30)):
            words += rng.choice([*fixed, *(rng.choice("pqrstuvwxyz") for _ in range(6))]).split()
        docs.append((i, words))
    return [*docs, (100, []), (101, ["one"]), (102, ["fixed", "asset"] * 300)]


def test_phrases_equal_a_plain_count(spark, monkeypatch):
    docs = corpus(1)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)
    words = F.filter(F.split("text", " "), lambda x: x != "")
    for few in (phrases.FEW, 0):
        monkeypatch.setattr(phrases, "FEW", few)
        found = phrases.collocations(phrases.pairs(frame, "doc_id", words), 5, 10.83)
        known, want = brute(docs, 5, 10.83)
        assert {(r.a, r.b) for r in found.collect()} == known
        got = sorted(map(tuple, phrases.phrases(frame, "doc_id", words, found).select("doc_id", "pos", "words", "phrase").collect()))
        assert got == want and any(w[3] == "new york stock exchange" for w in want)
    assert phrases.collocations(phrases.pairs(frame.filter("false"), "doc_id", words)).collect() == []


def test_an_encoder_that_fails_costs_the_texts_it_fails_on(spark):
    def encode(texts: pd.Series) -> pd.Series:
        if texts.str.contains("bad").any():
            raise RuntimeError("no such language")
        return texts.map(lambda t: [float(len(t))])

    rows = spark.createDataFrame([(i, "bad one" if i % 17 == 3 else None if i == 5 else "  " if i == 6 else "x" * i, "REVIEW_REQUIRED" if i == 7 else "FIT") for i in range(1, 60)], "atom_id long, text string, classification string").repartition(2)
    got = {r.atom_id: (r.embedding, r.error) for r in models.write_back(rows, "text", encode).collect()}
    assert 7 not in got and len(got) == 58
    assert got[3] == (None, "RuntimeError: no such language") and got[20] == got[3] and got[5] == got[6] == (None, "no text to embed")
    assert got[8] == ([8.0], None) and sum(e is None for _, e in got.values()) == 58 - 4 - 2


def test_the_country_reaches_the_gate(spark):
    text = "The ledger shall be posted under US GAAP rules each month for every entity."
    rows = spark.createDataFrame([(1, text), (2, text + " It differs.")], "doc_id long, text string")
    gate = lambda land: {r.doc_id: r.gate for r in pipelines.ingested(rows, "doc_id", "text", F.lit("Budgeting"), F.lit(land)).filter("pos = 1").collect()}
    assert gate("DE")[1] != gate("")[1]


def test_pairs_are_counted_before_the_shuffle_and_phrases_found_where_a_text_is_read(spark):
    docs = [*corpus(2), (200, None)]
    frame = spark.createDataFrame([(i, None if w is None else " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)
    words = F.filter(F.split("text", " "), lambda x: x != "")
    counts = {(r.a, r.b): r.n for r in phrases.counted(frame, words).filter("a IS NOT NULL AND b IS NOT NULL").collect()}
    assert counts == Counter(p for _, w in docs for p in zip(w or [], (w or [])[1:]))
    found = phrases.collocations_of(frame, words, 5, 10.83)
    known, want = brute([(i, w or []) for i, w in docs], 5, 10.83)
    told = phrases.phrases(frame, "doc_id", words, found)
    assert {(r.a, r.b) for r in found.collect()} == known and sorted(map(tuple, told.collect())) == want
    assert "Window" not in told._jdf.queryExecution().executedPlan().toString()


def test_rare_pairs_are_not_counted_by_their_words(spark):
    """A pair or word below the support isn't among the counted rows, except one that shares its hash with a likely one."""
    docs = [(i, f"fixed asset rare{i} seldom{i} once{i}".split()) for i in range(300)]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)
    words = F.split("text", " ")
    often = spark.sparkContext.broadcast(np.sort(phrases.likely(frame, words, 10).toArrow()["h"].to_numpy()))
    rows = {(r.a, r.b): r.n for r in phrases.counted(frame, words, often).collect()}
    assert rows == {("fixed", "asset"): 300, ("fixed", None): 300, ("asset", None): 300, (None, "asset"): 300, (None, None): 1200}
    found = phrases.collocations_of(frame, words, 10, 10.83)
    assert [(r.a, r.b, r.n) for r in found.collect()] == [("fixed", "asset", 300)]
    assert len(phrases.phrases(frame, "doc_id", words, found).collect()) == 300


def test_hashes_that_are_shared_leave_counts_and_phrases_exact(monkeypatch):
    """In process, with hashes of 6 bits to be counted, and all first hashes of collocations equal to others' or not known."""
    monkeypatch.setattr(phrases, "DROPPED", np.uint64(58))
    monkeypatch.setattr(phrases, "SLICE_WORDS", 40)
    monkeypatch.setattr(phrases, "HELD", 50)
    docs = [w for _, w in corpus(3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.list_(pa.string()))], ["k", "w"])
    sent = pa.Table.from_batches(list(phrases._hashed(1)([batch])))
    often = phrases._often(5)(sent)["h"].to_numpy()
    known = type("Told", (), {"value": np.sort(often)})
    counts = Counter()
    for part in phrases._counted(known)([batch]):
        counts.update({(r["a"], r["b"]): r["n"] for r in part.to_pylist()})
    want = Counter(p for w in docs for p in zip(w, w[1:]))
    assert {p: n for p, n in counts.items() if None not in p and n >= 5} == {p: n for p, n in want.items() if n >= 5}
    assert counts[None, None] == sum(want.values()) and counts["fixed", None] == sum(n for (a, _), n in want.items() if a == "fixed")
    pairs = pa.RecordBatch.from_arrays([pa.array(["fixed", "new"]), pa.array(["asset", "york"])], ["a", "b"])
    h, g = (next(phrases._named([pairs])).column(c).to_numpy() for c in ("h", "g"))
    twice = type("Told", (), {"value": (np.sort(np.repeat(h, 2)), np.stack([g, g + 1], 1)[np.argsort(h)].ravel())})
    found = [r["phrase"] for part in phrases._found(twice)([batch]) for r in part.to_pylist()]
    assert set(found) >= {"fixed asset", "new york"} and sum(x == "new york" for x in found) == want["new", "york"]


def test_likely_hashes_beyond_what_is_sent_at_once_are_counted_in_passes(spark, monkeypatch):
    docs = corpus(6)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(2)
    words = F.filter(F.split("text", " "), lambda x: x != "")
    monkeypatch.setattr(phrases, "SENT", 30)
    assert phrases.likely(frame, words, 5).count() > 60  # three passes at least
    assert {(r.a, r.b) for r in phrases.collocations_of(frame, words, 5, 10.83).collect()} == brute(docs, 5, 10.83)[0]
