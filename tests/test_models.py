"""Model calls: embeddings, retries, votes, gates; and that every registered query reads and names what it should."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import models


def test_embedding(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, "A  B a"), (3, ""), (4, None)], "id int, t string")
    v = {r.id: r.v for r in d.select("id", models.embedding(F.col("t")).alias("v")).collect()}
    assert len(v[1]) == 384 and v[1] == v[2] and sum(x * x for x in v[1]) == pytest.approx(1.0) and v[3] == v[4] == [0.0] * 384
    own = d.select(models.embedding(F.col("t"), lambda texts: pd.Series([[float(len(t or ""))] for t in texts])).alias("v")).collect()
    assert [r.v for r in own] == [[5.0], [6.0], [0.0], [0.0]]


def test_retries(spark):
    """Calls that may be retried are, up to the limit; others and prompts that are too long are not."""
    calls = spark.createDataFrame([(1, 1, "p", 1), (2, 1, "p", 3), (3, 1, "p", 9), (4, 1, "p", -1), (5, 1, "p" * 50, 1)], "atom_id long, call_no int, prompt string, works_at int")

    def model(rows):
        ok = (F.col("works_at") > 0) & (F.col("attempt") >= F.col("works_at"))
        return rows.withColumn("ok", ok).withColumn("retryable", F.col("works_at") > 0).withColumn("verdict", F.lit("FIT")).withColumn("confidence", F.lit(0.5)).withColumn("rationale", F.lit("r"))

    got = {r.atom_id: (r.ok, r.error, r.attempts, r.wait_s) for r in models.ask(calls, model, retries=3, limit=50).collect()}
    assert got == {1: (True, None, 1, 0), 2: (True, None, 3, 3), 3: (False, "retries exhausted", 3, 3), 4: (False, "refused", 1, 0), 5: (False, "prompt too large", 0, 0)}


@pytest.mark.parametrize(("route", "votes", "top", "want"), [
    ("DEEP_REASON", [("FIT", 0.9), ("FIT", 0.8), ("GAP", 0.7)], 0.9, ("FIT", 0.9, 3)), ("DEEP_REASON", [("FIT", 0.9), ("GAP", 0.8), ("GAP", 0.7)], 0.9, ("REVIEW_REQUIRED", 0.8, 3)),
    ("DEEP_REASON", [("FIT", 0.9), ("PARTIAL_FIT", 0.8), ("GAP", 0.7)], 0.5, ("REVIEW_REQUIRED", 0.0, 3)), ("DEEP_REASON", [("FIT", 0.9)], 0.9, ("REVIEW_REQUIRED", 0.0, 1)), ("DEEP_REASON", [], 0.9, ("REVIEW_REQUIRED", 0.0, 0)),
    ("FAST_TRACK", [("FIT", 0.9)], 0.49, ("PARTIAL_FIT", 0.9, 1)), ("FAST_TRACK", [("FIT", 0.9)], 0.50, ("FIT", 0.9, 1)), ("GAP_CONFIRM", [("GAP", 0.7)], 0.85, ("GAP", 0.7, 1)), ("GAP_CONFIRM", [("GAP", 0.7)], 0.86, ("REVIEW_REQUIRED", 0.7, 1)), ("GAP_CONFIRM", [], 0.1, ("REVIEW_REQUIRED", 0.0, 0)),
])
def test_verdicts_by_route(spark, route, votes, top, want):
    rows = spark.createDataFrame([(1, route, 2, top), (2, route, 0, top)], "atom_id long, route string, n_capabilities int, top_score double")
    answers = spark.createDataFrame([(1, i, True, v, c, "said") for i, (v, c) in enumerate(votes, 1)], "atom_id long, call_no int, ok boolean, verdict string, confidence double, rationale string")
    got = {r.atom_id: (r.classification, r.confidence, r.calls_used) for r in models.classified(rows, answers).collect()}
    assert got == {1: want, 2: ("GAP", 0.0, 0)}


def test_queries_have_no_stray_names():
    from sparkloom.plans import registry

    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) > 200


def test_atomise_falls_back(spark):
    from sparkloom.operators import pipelines as pipe

    def model(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [t.split("+") for t in texts] if len(texts) < 4 else [[]]

    d = spark.createDataFrame([(i, t) for i, t in enumerate(["a+b", "bad", "c", "d+e", "f", None])], "id int, t string").coalesce(1)
    got = sorted(tuple(r) for r in pipe.atomise(d, "id", "t", model, size=3).collect())
    assert got == [(0, 1, "a", "MODEL"), (0, 2, "b", "MODEL"), (1, 1, "bad", "FUNCTIONAL"), (2, 1, "c", "MODEL"), (3, 1, "d", "MODEL"), (3, 2, "e", "MODEL"), (4, 1, "f", "MODEL"), (5, 1, "", "MODEL")]
    assert pipe.atomise(d, "id", "t", model, size=6).filter("kind = 'FUNCTIONAL'").count() == 1


def test_matched_pairs(spark):
    from sparkloom.operators import pipelines as pipe

    rows = [("a", 1, [1.0, 0.0], [1.0, 0.0], "post invoices", "Invoice posting", ["invoice"], 0.5, 0.9, True, True), ("a", 2, [1.0, 0.0], [0.0, 1.0], "post invoices", "Other", ["invoice"], 0.0, 0.1, True, True), ("a", 3, [1.0, 0.0], [0.0, 1.0], "post invoices", "Other", ["invoice"], 0.0, 0.0, True, False), ("b", 1, [1.0, 0.0], [1.0, 0.1], "x", "y", ["z"], 0.0, 0.0, False, False)]
    d = spark.createDataFrame(rows, "atom_id string, cap_id int, atom_vec array<double>, cap_vec array<double>, atom_text string, cap_text string, hints array<string>, historical_alignment double, rerank_score double, has_history boolean, has_fit_prior boolean")
    got = {(r.atom_id, r["rank"]): r for r in pipe.matched_pairs(d).collect()}
    assert sorted(got) == [("a", 1), ("a", 2), ("b", 1)] and [got["a", k].cap_id for k in (1, 2)] == [1, 2]
    assert got["a", 1].entity_overlap == 1.0 and got["a", 1].anomaly is None and got["b", 1].anomaly.startswith("high cosine") and got["b", 1].route == "GAP_CONFIRM"


def test_kb_search_by_module(spark):
    from sparkloom.operators import pipelines as pipe

    base = spark.createDataFrame([(1, [1.0, 0.0], "m"), (2, [0.9, 0.1], "n"), (3, [0.0, 1.0], "m")], "id long, vec array<double>, module string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")
    assert [r.id for r in pipe.kb_search(q, base, 2).orderBy("rank").collect()] == [1, 2] and [r.id for r in pipe.kb_search(q, base, 2, "m").orderBy("rank").collect()] == [1, 3]


def test_section_paths(spark):
    from sparkloom.operators import chunking

    item = "array<struct<page:int,place:int,level:int,modality:string,text:string>>"
    items = [(1, 0, 1, "TEXT", "A"), (1, 2, 0, "TEXT", "p"), (1, 1, 2, "TEXT", "B"), (2, 0, 0, "TABLE", "t"), (2, 1, 2, "TEXT", "C"), (2, 2, 0, "IMAGE", "i"), (3, 0, 1, "TEXT", "D"), (3, 1, 0, "TEXT", "q")]
    d = spark.createDataFrame([(7, items), (8, [])], f"doc_id long, items {item}")
    got = [(r.text, r.modality, r.section_path) for r in chunking.element_stream(d, F.col("items")).orderBy("element_no").collect()]
    assert got == [("p", "TEXT", ["A", "B"]), ("t", "TABLE", ["A", "B"]), ("i", "IMAGE", ["A", "C"]), ("q", "TEXT", ["D"])]


def test_gate_state_and_seed(spark, tmp_path):
    from sparkloom.functions import values as va
    from sparkloom.sources import files as src

    now = F.to_timestamp(F.lit("2024-01-02 12:00:00"))
    rows = spark.createDataFrame([(1, 5, "FIT"), (1, 6, "GAP"), (2, 7, "GAP")], "batch_id long, atom_id long, classification string")
    src.put_gate_rows(rows, str(tmp_path / "s"), 3, F.to_timestamp(F.lit("2024-01-02 11:00:00")))
    assert [r.batch_id for r in src.batch_index(spark, str(tmp_path / "s"), now).collect()] == [1, 2] and src.get_state(spark, str(tmp_path / "s"), now).filter("field = 'gate_3:5'").first().value == '{"atom_id":5,"classification":"FIT"}'
    kb = src.knowledge_base(spark, [{"id": "1", "module": "m", "feature": "f", "description": "post invoices"}])
    assert src.seed(kb, str(tmp_path / "kb"), "description") == 1 and len(spark.read.parquet(str(tmp_path / "kb")).first().vec) == 384
    names = spark.createDataFrame([("a/b/c.txt",), ("c:\\x\\y.pdf",), ("plain",)], "p string").select(va.file_name(F.col("p")).alias("n"), va.cut(F.lit("x" * 900), "excerpt").alias("e")).collect()
    assert [r.n for r in names] == ["c.txt", "y.pdf", "plain"] and len(names[0].e) == 500
