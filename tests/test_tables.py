"""Merges, dedup, PII, chunking, reports, streams."""

import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import chunking, dedup, pii
from sparkloom.operators import relational as rel
from sparkloom.operators import review as rv
from sparkloom.streaming import progress as pr


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, first string, c double")
    new = spark.createDataFrame([(2, "x", 9.0), (3, "y", 3.0), (3, "z", 3.5)], "k long, first string, c double")
    assert rows(rel.upsert(old, new.filter("first <> 'z'"), ["k"], ["c"]), "k", "first", "c") == [(1, "a", 1.0), (2, "b", 9.0), (3, "y", 3.0)]
    assert rows(rel.upsert(old, new, ["k"], ["c"]), "k", "first", "c") == [(1, "a", 1.0), (2, "b", 9.0), (3, "z", 3.5)]  # of equal new keys the largest row
    assert rows(rel.insert_absent(old, new, ["k"]), "k", "first") == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(rel.insert_absent(old, old, ["k"]), "k") == [(1,), (2,)]


def test_overlay_takes_nulls(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    over = spark.createDataFrame([(2, None)], "k long, v string")
    assert rel.overlay(base, over, ["k"], ["v"]).filter("v is null").count() == 1 and rel.fill_missing(base, over, ["k"], ["v"]).filter("v is null").count() == 0


def test_page_falls_back_and_ends(spark):
    v = spark.createDataFrame([(i, i / 10) for i in range(5)], "atom_id long, confidence double")
    assert [r.atom_id for r in rel.page(v, "nope", False, 0, 2, "atom_id").collect()] == [4, 3] and rel.page(v, "confidence", True, 9, 2, "atom_id").count() == 0


def test_dedup_chain(spark):
    import math

    at = lambda x: [math.cos(x), math.sin(x)]
    v = spark.createDataFrame([(1, at(0.0), "b"), (2, at(0.35), "b"), (3, at(0.70), "b"), (4, at(1.25), "b")], "id long, vec array<double>, b string")
    own = {r.id: (r.owner, r.soft) for r in dedup.owners(v).collect()}
    assert own == {1: (None, False), 2: (1, False), 3: (2, False), 4: (None, True)}
    seq = {r.id: r.owner for r in dedup.greedy(v).collect()}
    assert seq == {1: None, 2: 1, 3: None, 4: None}
    merged = dedup.merge(v.select("id", F.col("id").cast("string").alias("source_ref")), dedup.owners(v))
    assert rows(merged, "id", "source_ref") == [(1, "1,2"), (4, "4")]


@pytest.mark.parametrize("tile", [4096, 7])
def test_greedy_is_the_sequential_walk(spark, tile, monkeypatch):
    """DED3 against the walk over all pairs in order; the matrix way beside it, and the dispatcher between the two."""
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.normal(size=(90, 3))
    data = [(i, x.tolist(), "abc"[i % 3] if i < 80 else "d" if i < 89 else "e") for i, x in enumerate(v)]
    df = spark.createDataFrame(data, "id long, vec array<double>, b string")
    monkeypatch.setattr(dedup, "TILE_ROWS", tile)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    gone, near, least = {}, set(), {}
    for i in range(90):
        for j in range(i + 1, 90):
            s = float(u[i] @ u[j])
            if data[i][2] == data[j][2] and s > 0.8:
                if s > 0.92:
                    least.setdefault(j, i)
                if i not in gone and j not in gone:
                    if s > 0.92:
                        gone[j] = i
                    else:
                        near.add(j)
    assert {r.id: (r.owner, r.soft) for r in dedup.greedy(df).collect()} == {i: (gone.get(i), i in near) for i in range(90)}
    assert {r.id: r.owner for r in dedup.owners(df).collect()} == {i: least.get(i) for i in range(90)}
    both = {r.id: r.owner for r in dedup.deduplicate(df, most=9).collect()}
    assert both == {i: (gone if i < 80 else least).get(i) for i in range(90)}


def test_text_copies(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "id long, t string")
    assert rows(dedup.text_copies(d, "id", "t").filter("is_copy"), "id") == [(3,)]


@pytest.mark.parametrize("text", ["mail a.b@c.de or x@y.org", "call 555-123-4567", "id 123-45-6789", "10.0.0.1", "4111 1111 1111 1111", "none", "", None])
def test_pii_round_trip(text):
    red, entities, found = pii.redact_text(text)
    back = red
    for mark, value in found.items():
        back = back.replace(mark, value)
    assert back == text and len(entities) == len(found)


def test_pii_counters_and_restore(spark):
    red, entities, _ = pii.redact_text("a@b.de c@d.de", prefix="T1_")
    assert red == "<PII_T1_EMAIL_ADDRESS_1> <PII_T1_EMAIL_ADDRESS_2>" and [e["start"] for e in entities] == [0, 7]
    d = spark.createDataFrame([(1, "write a@b.de now"), (2, None)], "id long, t string")
    got = {r.id: r.x for r in pii.redact(d, "id", "t").select("id", tx.restore_pii(F.col("redacted"), F.col("found")).alias("x")).collect()}
    assert got == {1: "write a@b.de now", 2: None}


def test_prose_packing():
    long = "One. Two. Three. " + "x" * 1500
    got = chunking.pack_prose([(True, "Head", 1), (False, long, 1), (False, "tail", 2), (True, "Next", 3), (False, "end", 3)])
    assert [(c[1], c[4]) for c in got] == [("Head", False), ("Head", True), ("Next", False)]
    assert chunking.tail_sentences("a. b") == "" and chunking.tail_sentences("a. b. c") == "b. c"


def test_token_packing():
    word = "word " * 300
    got = chunking.pack_tokens([(word, "TEXT", 1, ["a"]), (word, "TABLE", 2, ["a"]), ("x", "TEXT", 3, ["b"])])
    assert [c["page_first"] for c in got] == [1, 2, 3] and all(c["n_tokens"] <= 600 for c in got) and abs(sum(got[0]["shares"].values()) - 1) < 1e-9
    assert len(chunking.split_oversized("word " * 1000)) > 1


def test_reports(spark, tmp_path):
    v = spark.createDataFrame([(1, "FIT", 0.5, True), (2, "GAP", 0.25, False), (3, "REVIEW_REQUIRED", 0.1, False)], "atom_id long, classification string, confidence double, reviewer_override boolean")
    rv.write_reports(v, str(tmp_path / "r"))
    got = spark.read.option("header", True).csv(str(tmp_path / "r"))
    assert set(got.columns) == {*rv.REPORT_COLUMNS, "report"} and sorted((r.req_id, r.confidence, r.override, r.report) for r in got.collect()) == [("1", "0.5000", "yes", "fits"), ("2", "0.2500", None, "gaps")]


EVENTS = [(1, "phase_start", 1, 1, None, 0, 0), (2, "step_progress", 1, 1, "s", 1, 3), (3, "phase_complete", 1, 1, None, 0, 0), (4, "phase_start", 1, 3, None, 0, 0), (5, "classification", 1, 3, None, 0, 0), (6, "complete", 1, 5, None, 0, 0), (7, "phase_start", 1, 5, None, 0, 0)]


def events(spark):
    return spark.createDataFrame(EVENTS, "seq long, event string, batch_id long, phase int, step string, completed int, total int").selectExpr("*", "7L atom_id", "'FIT' classification", "3 atoms_produced", "1.0D latency_ms")


def test_progress_fold(spark):
    e = pr.until_terminal(events(spark))
    assert e.count() == 6
    assert rows(pr.phase_states(e), "phase", "status", "pct") == [(1, "complete", 100), (3, "in_progress", 0)]
    view = rows(pr.progress_view(pr.repaired(pr.phase_states(e))), "phase", "status")
    assert view == [(1, "complete"), (2, "pending"), (3, "in_progress"), (4, "pending"), (5, "pending")]
    assert [r.what for r in pr.replay(e).orderBy("part", "pos").collect()] == ["phase:1:complete", "phase:3:in_progress", "atom:7:FIT", "complete"]


def test_stream_equals_batch(spark, tmp_path):
    e = events(spark)
    e.limit(4).write.json(str(tmp_path / "in"), mode="append")
    e.subtract(e.limit(4)).write.json(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(e.schema).json(str(tmp_path / "in"))
    pr.fold_stream(stream, str(tmp_path / "c"), "fold_test").awaitTermination(60)
    assert rows(spark.table("fold_test"), "phase", "status", "pct") == rows(pr.phase_states(e), "phase", "status", "pct")
    pr.publish(stream, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == e.count()


def test_illegal_steps(spark):
    s = spark.createDataFrame([(1, 1, "queued"), (1, 2, "processing"), (1, 3, "gate_2"), (1, 4, "gate_3")], "batch_id long, seq int, status string")
    assert rows(pr.illegal_steps(s), "seq") == [(3,)]


def test_bad_json_is_skipped(spark):
    raw = spark.createDataFrame([('{"seq": 1, "event": "x"}',), ("{oops",)], "value string")
    assert pr.decode(raw, "seq long, event string").count() == 1


def test_pii_sorts_out_only_texts_without_matches(spark):
    texts = ["x@y.org", "call (555) 123-4567 now", "+1 555.123.4567", "1.2.3.4", "1 2 3", "4111-1111 1111-1111", "123-45-6789", "plain words 12 and 34", "", None, "\u0661\u0662\u0663-\u0664\u0665-\u0666\u0667\u0668\u0669"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("more", F.lit("m"))
    got = {r.id: (r.redacted, len(r.entities), r.more) for r in pii.redact(d, "id", "t", keep=("more",)).collect()}
    assert got == {i: (pii.redact_text(t)[0], len(pii.redact_text(t)[1]), "m") for i, t in enumerate(texts)}


def test_scored_entities(spark):
    found = pii.detect_scored("Dr. Ada Byron, a@b.org, 123-45-6789, in Paris, DE89 3704 0044 0532 0130 00")
    assert [x[0] for x in found] == ["PERSON", "EMAIL_ADDRESS", "US_SSN", "LOCATION", "IBAN_CODE"] and pii.detect_scored(None) == [] and pii.detect_scored("in Paris", 0.5) == []


def test_a_match_takes_what_it_looks_behind_for():
    """As the SQL: the second "In" of "In In In" belongs to a match and doesn't begin another."""
    assert pii.detect_scored("In In In In Paris") == [("LOCATION", 3, 8, 0.4), ("LOCATION", 12, 17, 0.4)]
    assert [x[:3] for x in pii.detect_scored("\u00e9In Paris, in Oslo\u00e9")] == [("LOCATION", 4, 9), ("LOCATION", 14, 18)]


def test_large_blocks_are_those_that_the_caller_names(spark):
    """Both blocks have more rows than `most`. The chain 0 - 1 - 2: the owner of 2 is 1 by the matrix way, and nobody by the greedy way."""
    turn = lambda i: [math.cos(i * 0.5), math.sin(i * 0.5)]
    rows = [(100 * b + i, turn(i), b) for b in (1, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, b int")
    got = {r.id: r.owner for r in dedup.deduplicate(df, hard=0.8, soft=0.7, most=2, large=F.col("b") == 2).collect()}
    assert got == {100: None, 101: 100, 102: 101, 200: None, 201: 200, 202: None}
