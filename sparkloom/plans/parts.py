"""Operators that the larger queries use, each by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import headers, scores
from sparkloom.functions import text as tx
from sparkloom.operators import dedup
from sparkloom.operators import relational as rel
from sparkloom.operators import retrieval as ret
from sparkloom.operators import review as rv
from sparkloom.operators import views as vw
from sparkloom.plans.base import VERDICTS, query, table, verdicts
from sparkloom.plans.relational import BATCHES, batches
from sparkloom.plans.retrieval import _COS, _PAIRS, knn_sql, hits, vectors
from sparkloom.plans.review import _FLAGS, flagged
from sparkloom.plans.texts import SAMPLE_CONCRETE, SAMPLE_SPECIFIC, SAMPLE_VAGUE, TOKENS, _in, docs


@query("snk2_bulk_insert", f"WITH {BATCHES} SELECT batch_id, status FROM b WHERE batch_id % 2 = 0 UNION ALL SELECT batch_id, 'new' FROM b WHERE batch_id % 3 = 0 AND batch_id % 2 <> 0")
def snk2(spark, d):
    b = batches(spark, d).select("batch_id", "status")
    return rel.insert_absent(b.filter("batch_id % 2 = 0"), b.filter("batch_id % 3 = 0").withColumn("status", F.lit("new")), ["batch_id"])


@query("prj1_canonical_rows", "SELECT p_partkey AS id, p_name AS requirement_text, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS module FROM part WHERE p_partkey % 5 <> 0")
def prj1(spark, d):
    synonyms = headers.load_synonyms(spark, {"requirement_text": ["need"], "module": ["area"]})
    mapping = headers.map_headers(spark.createDataFrame([("Need ",), ("AREA",), ("zzz",)], "header string"), synonyms)
    name = F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).otherwise(" ")
    cells = F.create_map(F.lit("Need "), name, F.lit("AREA"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(""), F.lit("zzz"), F.lit("x"))
    rows = headers.canonical_rows(table(spark, d, "part").select(F.col("p_partkey").alias("id"), cells.alias("cells")), mapping)
    return rows.select("id", F.element_at("canonical", F.lit("requirement_text")).alias("requirement_text"), F.element_at("canonical", F.lit("module")).alias("module"))


@query("flt3_payload_filter", "SELECT vec_id AS id FROM embeddings WHERE label = 3")
def flt3(spark, d):
    return rel.matching(vectors(spark, d), label=3, vec=None).select("id")


_SPEC = f"""s AS (SELECT doc_id, source, length(text) AS n, len([x FOR x IN w IF x IN {_in(SAMPLE_CONCRETE)}]) + len([i FOR i IN range(1, len(w)) IF (w[i] || ' ' || w[i + 1]) IN {_in(SAMPLE_CONCRETE)}]) + len([x FOR x IN w IF x IN {_in(SAMPLE_SPECIFIC)}]) AS good,
 len([x FOR x IN w IF x IN {_in(SAMPLE_VAGUE)}]) AS bad FROM (SELECT *, {TOKENS} AS w FROM documents)), q AS (SELECT *, CASE WHEN good + bad = 0 THEN 0.4 ELSE good / (good + bad) END AS spec FROM s)"""


@query("flt6_flt7_flt8_single_gates", f"WITH {_SPEC} SELECT doc_id, CASE WHEN spec < 0.3 THEN 'TOO_VAGUE' END AS b, CASE WHEN spec < 0.3 THEN 'TOO_VAGUE' WHEN source = 'src1' AND spec < 0.5 THEN 'INCOMPLETE' END AS c, CASE WHEN n < 10 OR n > 2000 THEN 'SCHEMA_MISMATCH' END AS d FROM q")
def flt6(spark, d):
    s = docs(spark, d).select("doc_id", "source", F.char_length("text").alias("n"), tx.specificity(tx.tokens(F.col("text")), SAMPLE_CONCRETE, SAMPLE_SPECIFIC, SAMPLE_VAGUE).alias("spec"))
    none = F.lit(None).cast("string")
    gate = lambda spec, complete, n: tx.quality_gate(F.lit(False), none, spec, complete, n)
    fine, full, long = F.lit(1.0), F.lit(100.0), F.lit(100)
    return s.select("doc_id", gate(F.col("spec"), full, long).alias("b"), gate(F.col("spec"), F.when(F.col("source") == "src1", 0.0).otherwise(100.0), long).alias("c"), gate(fine, full, F.col("n")).alias("d"))


@query("flt14_clean_split", f"WITH {VERDICTS}, {_FLAGS} SELECT batch_id, len(flags) = 0 AS clean, count(*) AS n FROM r GROUP BY ALL")
def flt14(spark, d):
    return flagged(spark, d).groupBy("batch_id", (F.size("flags") == 0).alias("clean")).agg(F.count("*").alias("n"))


@query("flt16_unknown_sort_field", f"WITH {VERDICTS} SELECT atom_id, confidence FROM v ORDER BY confidence DESC, atom_id LIMIT 30")
def flt16(spark, d):
    return rel.page(verdicts(spark, d), "no such field", ascending=False, offset=0, size=30, tie="atom_id").select("atom_id", "confidence")


@query("jon3_verdicts_beside_matches", f"WITH {VERDICTS}, m AS (SELECT DISTINCT module, wave, max(top_score) OVER (PARTITION BY module, wave) AS best FROM v WHERE wave <= 4) SELECT atom_id, v.wave, best FROM v LEFT JOIN m ON m.module = v.module AND m.wave = v.wave")
def jon3(spark, d):
    v = verdicts(spark, d).withColumn("k", F.concat_ws("|", "module", F.col("wave").cast("string")))
    return vw.beside(v, v.filter("wave <= 4").groupBy("k").agg(F.max("top_score").alias("best")), "k", "best").select("atom_id", "wave", "best")


@query("jon9_all_cosines", f"SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0")
def jon9(spark, d):
    v = vectors(spark, d)
    return ret.all_cosines(v.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), v).select("query_id", "id", F.round("score", 6).alias("score"))


@query("jon12_similar_pairs", f"WITH {_PAIRS} SELECT i, j, round(s, 6) AS s FROM p WHERE s > 0.25")
def jon12(spark, d):
    return dedup.similar_pairs(vectors(spark, d), 0.25, "label").withColumn("s", F.round("s", 6))


@query("jon19_survivors", f"WITH {_PAIRS} SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT j FROM p WHERE s > 0.35)")
def jon19(spark, d):
    v = vectors(spark, d)
    return dedup.merge(v.select("id", F.col("id").cast("string").alias("source_ref")), dedup.owners(v, 0.35, 0.25, "label")).select("id")


@query("agg16_signal_sum", f"WITH {VERDICTS} SELECT atom_id, round(least(1.0, 0.25 * confidence + 0.20 * top_score + 0.15 * quantity / 50 + 0.25 * reviewed::INT + 0.15 * wave / 7), 6)::DOUBLE AS score FROM v")
def agg16(spark, d):
    v = verdicts(spark, d)
    signals = {"embedding_cosine": F.col("confidence"), "entity_overlap": F.col("top_score"), "token_ratio": F.col("quantity") / 50, "historical_alignment": F.col("reviewed").cast("int"), "rerank_score": F.col("wave") / 7}
    return v.select("atom_id", F.round(scores.composite(signals, F.lit(False)), 6).alias("score"))


@query("win10_bigrams", f"SELECT doc_id, count(b)::BIGINT AS n, count(DISTINCT b)::BIGINT AS n_distinct FROM (SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM (SELECT doc_id, {TOKENS} AS w FROM documents)) GROUP BY doc_id")
def win10(spark, d):
    b = docs(spark, d).select("doc_id", tx.bigrams(tx.tokens(F.col("text"))).alias("b")).filter(F.size("b") > 0)
    return b.select("doc_id", F.size("b").cast("long").alias("n"), F.size(F.array_distinct("b")).cast("long").alias("n_distinct"))


@query("win12_first_by_atom", f"WITH {VERDICTS} SELECT module, min(atom_id) AS atom_id FROM v GROUP BY 1")
def win12(spark, d):
    return rel.first_by(verdicts(spark, d), ["module"], [F.col("atom_id")]).select("module", "atom_id")


@query("set7_terms_in_tokens", f"SELECT doc_id, (list_contains(w, 'of') AND list_contains(w, 'the'))::INT + list_contains(w, 'und')::INT AS n_found FROM (SELECT doc_id, {TOKENS} AS w FROM documents)")
def set7(spark, d):
    return docs(spark, d).select("doc_id", tx.terms_found(tx.tokens(F.col("text")), ("of the", "und")).alias("n_found"))


@query("mth5_reciprocal_ranks", f"WITH {knn_sql(6)} SELECT query_id, id, round(1.0 / (60 + rank), 9)::DOUBLE AS score FROM hits")
def mth5(spark, d):
    return hits(spark, d, 6).select("query_id", "id", F.round(scores.rrf(F.col("rank")), 9).alias("score"))


@query("mth11_routes", f"WITH {VERDICTS} SELECT atom_id, CASE WHEN confidence > 0.85 AND reviewed THEN 'FAST_TRACK' WHEN confidence >= 0.60 THEN 'DEEP_REASON' ELSE 'GAP_CONFIRM' END AS route FROM v")
def mth11(spark, d):
    return verdicts(spark, d).select("atom_id", scores.route(F.col("confidence"), F.col("reviewed")).alias("route"))


@query("mth14_seconds", "SELECT event_id, floor(value * 100 / 1000 + 0.5)::BIGINT AS s FROM events")
def mth14(spark, d):
    return table(spark, d, "events").select("event_id", scores.seconds(F.col("value") * 100).alias("s"))


@query("dtj7_review_reasons", f"WITH {VERDICTS}, {_FLAGS} SELECT atom_id, reason FROM r WHERE len(flags) > 0")
def dtj7(spark, d):
    f = flagged(spark, d).filter(F.size("flags") > 0)
    return f.select("atom_id", tx.review_reason(F.col("flags")).alias("reason"))


@query("snk6_appendable", f"WITH {VERDICTS} SELECT atom_id, classification FROM v WHERE classification <> 'REVIEW_REQUIRED'")
def snk6(spark, d):
    return rv.writable(verdicts(spark, d)).select("atom_id", "classification")
