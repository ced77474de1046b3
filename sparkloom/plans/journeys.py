"""Nested views, attachments, listings and the composite pipelines."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import scores
from sparkloom.functions import text as tx
from sparkloom.functions import values as va
from sparkloom.operators import pipelines as pipe
from sparkloom.operators import relational as rel
from sparkloom.operators import retrieval as ret
from sparkloom.operators import review as rv
from sparkloom.operators import views as vw
from sparkloom.plans.base import VERDICTS, query, table, verdicts
from sparkloom.plans.relational import BATCHES, batches, uploads
from sparkloom.plans.retrieval import _HYBRID, _SPARSE, hits, knn_sql, sparse_hits
from sparkloom.plans.texts import _REDACTED, TOKENS, _in, _sql_rlike, ratio_sql
from sparkloom.sources import artifacts, elements
from sparkloom.storage import shared_folder


@query("jon2_atom_views", f"WITH {VERDICTS}, a AS (SELECT o_orderkey AS atom, o_orderpriority AS country FROM orders) SELECT atom_id, country, classification FROM v LEFT JOIN a ON a.atom = atom_id // 8")
def jon2(spark, d):
    a = table(spark, d, "orders").selectExpr("o_orderkey atom", "o_orderpriority country")
    return vw.beside(verdicts(spark, d).withColumn("atom", F.expr("atom_id div 8")), a, "atom", "country").select("atom_id", "country", "classification")


@query("jon7_results_with_journey", f"WITH {VERDICTS} SELECT v.atom_id, v.module, j.n AS journey_steps FROM v LEFT JOIN (SELECT atom_id, count(*) AS n FROM v WHERE wave <= 2 GROUP BY 1) j USING (atom_id)")
def jon7(spark, d):
    v = verdicts(spark, d)
    steps = v.filter("wave <= 2").groupBy("atom_id").agg(F.count("*").alias("journey_steps"))
    return vw.beside(v, steps, "atom_id", "journey_steps").select("atom_id", "module", "journey_steps")


@query("jon13_reranked_payload", f"WITH {knn_sql(8)} SELECT query_id, h.id, e.label, h.rank FROM hits h JOIN embeddings e ON e.vec_id = h.id WHERE h.rank <= 5")
def jon13(spark, d):
    payload = table(spark, d, "embeddings").selectExpr("vec_id id", "label")
    return hits(spark, d, 8).filter("rank <= 5").join(payload, "id").select("query_id", "id", "label", F.col("rank").cast("long").alias("rank"))


@query("jon14_citations", "SELECT c.conv_id, c.turn, coalesce(d.source, '') AS source_ref, CASE WHEN d.text IS NULL THEN '' ELSE left(d.text, 500) END AS excerpt FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id")
def jon14(spark, d):
    meta = table(spark, d, "documents").withColumnRenamed("doc_id", "conv_id")
    return vw.citations(table(spark, d, "conversations").select("conv_id", "turn"), meta, "conv_id")


@query("jon15_artifact_refs", "SELECT page_id, coalesce(n, 0) AS n_artifacts FROM pages LEFT JOIN (SELECT event_id % 100 AS page_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) USING (page_id)")
def jon15(spark, d):
    refs = table(spark, d, "events").filter("event_type = 'click'").selectExpr("event_id % 100 page_id")
    return vw.reference_counts(table(spark, d, "pages").select("page_id"), refs, "page_id")


@query("jon20_unshown_artifacts", "SELECT conv_id, array_to_string(list_sort([x FOR x IN list(DISTINCT turn) IF x % 2 = 1]), ',') AS left_over FROM conversations GROUP BY 1")
def jon20(spark, d):
    left = vw.not_shown(table(spark, d, "conversations"), "conv_id", "turn", F.col("turn") % 2 == 0)
    return left.select("conv_id", F.array_join(F.col("left_over").cast("array<string>"), ",").alias("left_over"))


@query("set3_set4_ordered_union", "SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), '|') AS roles FROM conversations GROUP BY 1")
def set3(spark, d):
    c = table(spark, d, "conversations")
    ends = c.groupBy("conv_id").agg(F.collect_list(F.when(F.col("turn") < 2, F.col("role"))).alias("a"), F.collect_list(F.when(F.col("turn") >= 2, F.col("role"))).alias("b"))
    return ends.select("conv_id", F.array_join(F.array_sort(va.merged(F.col("a"), F.col("b"))), "|").alias("roles"))


@query("set5_titles_or_features", "SELECT p_partkey AS id, len(list_distinct([p_brand, p_type, p_brand]))::INT AS n FROM part")
def set5(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.size(va.merged(F.array("p_brand", "p_type"), F.array("p_brand"))).alias("n"))


@query("win1_source_ranks", f"WITH {knn_sql(20)} SELECT query_id, h.id, e.label AS source, row_number() OVER (PARTITION BY query_id, e.label ORDER BY h.rank) AS rank FROM hits h JOIN embeddings e ON e.vec_id = h.id")
def win1(spark, d):
    source = table(spark, d, "embeddings").selectExpr("vec_id id", "label source")
    return ret.source_ranks(hits(spark, d, 20).join(source, "id")).select("query_id", "id", "source", F.col("source_rank").cast("long").alias("rank"))


@query("srt7_fused_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, role, turn) AS pos FROM conversations")
def srt7(spark, d):
    return vw.positions(table(spark, d, "conversations"), ["conv_id"], F.char_length("text").desc(), "role", "turn").select("conv_id", "turn", F.col("pos").cast("long").alias("pos"))


@query("srt9_chunk_order", "SELECT page_id, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id % 7, page_id) AS pos FROM pages")
def srt9(spark, d):
    p = table(spark, d, "pages").select("page_id", F.array((F.col("page_id") % 7)).alias("section_path"), F.expr("page_id div 20").alias("doc"))
    return vw.positions(p, ["doc"], "section_path", "page_id").select("page_id", F.col("pos").cast("long").alias("pos"))


@query("srt13_page_slice", "SELECT p_partkey AS id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 30")
def srt13(spark, d):
    return vw.slice_of(table(spark, d, "part"), [F.col("p_retailprice").desc(), "p_partkey"], 30, 10).select(F.col("p_partkey").alias("id"))


@query("srt14_slices", f"WITH {knn_sql(10)} SELECT query_id, string_agg(id::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 5) AS top5, string_agg(id::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 3) AS top3 FROM hits GROUP BY 1")
def srt14(spark, d):
    g = hits(spark, d, 10).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("x"))
    cut = lambda n: F.array_join(F.transform(F.slice("x", 1, n), lambda e: e["id"].cast("string")), ",")
    return g.select("query_id", cut(5).alias("top5"), cut(3).alias("top3"))


@query("srt16_fetch_all", "SELECT vec_id AS id, label FROM embeddings")
def srt16(spark, d):
    return table(spark, d, "embeddings").selectExpr("vec_id id", "label")


@query("mdl6_srt15_single_source_text", f"WITH {knn_sql(4)} SELECT query_id, h.id, md5(CASE WHEN trim(d.text) <> '' THEN d.text ELSE d.source END) AS chunk_md5 FROM hits h JOIN documents d ON d.doc_id = h.id")
def mdl6(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.coalesce(F.when(F.trim("text") != "", F.col("text")), F.col("source"))).alias("chunk_md5"))
    return hits(spark, d, 4).join(docs, "id").select("query_id", "id", "chunk_md5")


@query("flt4_usable_priors", "SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 9 <> 0 GROUP BY 1")
def flt4(spark, d):
    e = table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 9 != 0, F.col("embedding")))
    return vw.usable_priors(e).groupBy("label").agg(F.count("*").alias("n"))


@query("flt20_atoms_with_pii", "SELECT doc_id FROM documents WHERE " + " OR ".join(f"regexp_matches(coalesce(text, ''), '{p}')" for _, p in tx.PII_PATTERNS))
def flt20(spark, d):
    total = F.aggregate(F.map_values(tx.pii_counts(F.col("text"))), F.lit(0), lambda a, x: a + x)
    return table(spark, d, "documents").filter(total > 0).select("doc_id")


@query("flt23_journey_statuses", f"WITH {BATCHES} SELECT batch_id FROM b WHERE status IN ('F', 'P')")
def flt23(spark, d):
    return vw.in_status(batches(spark, d), "F", "P").select("batch_id")


@query("flt24_reasons_above_zero", "SELECT event_type AS reason, count(*) FILTER (value > 90) AS n FROM events GROUP BY 1 HAVING count(*) FILTER (value > 90) > 0")
def flt24(spark, d):
    return vw.happening(table(spark, d, "events").withColumnRenamed("event_type", "reason"), "reason", F.col("value") > 90)


@query("prj10_kb_items", "SELECT p_partkey AS id, p_brand AS module, p_name AS title FROM part")
def prj10(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey id", "p_brand module", "p_name title")


@query("prj11_result_view", f"WITH {VERDICTS} SELECT atom_id, module || '/' || classification AS label, round(confidence, 1) AS evidence FROM v")
def prj11(spark, d):
    return vw.result_view(verdicts(spark, d))


@query("prj17_gate_by_number", f"WITH {VERDICTS} SELECT atom_id, wave AS gate FROM v WHERE wave = 3")
def prj17(spark, d):
    return vw.lookup(verdicts(spark, d), wave=3).select("atom_id", F.col("wave").alias("gate"))


@query("dtj2_json_round_trip", "SELECT doc_id, source, n_chars FROM documents")
def dtj2(spark, d):
    packed = table(spark, d, "documents").select("doc_id", va.packed("source", "n_chars").alias("j"))
    return packed.select("doc_id", tx.tolerant_json(F.col("j"), "source string, n_chars bigint").alias("x")).select("doc_id", "x.source", "x.n_chars")


@query("dtj12_review_required", f"WITH {VERDICTS} SELECT atom_id, 'REVIEW_REQUIRED' AS classification, 0.0::DOUBLE AS confidence FROM v")
def dtj12(spark, d):
    return verdicts(spark, d).select("atom_id", *va.review_required())


@query("txt20_module_or_default", "SELECT p_partkey AS id, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN p_brand ELSE 'default' END AS module FROM part")
def txt20(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), va.known_module(F.col("p_brand"), ["Brand#1", "Brand#2"], "default").alias("module"))


@query("mth4_sigmoid", "SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS s FROM events")
def mth4(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scores.sigmoid(F.col("value") / 100), 6).alias("s"))


@query("src9_page_windows", "SELECT conv_id, (turn // 5)::BIGINT AS win, count(*) AS n FROM conversations GROUP BY 1, 2")
def src9(spark, d):
    return vw.page_windows(table(spark, d, "conversations"), "turn").groupBy("conv_id", "win").agg(F.count("*").alias("n"))


@query("src7_needs_ocr", "SELECT conv_id, sum(length(text)) / (count(*) * 2000.0::DOUBLE) < 0.3 AS needs_ocr FROM conversations GROUP BY 1")
def src7(spark, d):
    return vw.needs_ocr(table(spark, d, "conversations"), "conv_id", "text")


@query("mdl5_unified_modalities", "SELECT doc_id, CASE WHEN contains(text, ' | ') THEN 'TABLE' ELSE 'TEXT' END AS modality, CASE WHEN contains(text, ' | ') THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence FROM documents UNION ALL SELECT page_id, 'IMAGE', 0.3::DOUBLE FROM pages")
def mdl5(spark, d):
    return pipe.unify(table(spark, d, "documents").filter(~F.contains("text", F.lit(" | "))), table(spark, d, "documents").filter(F.contains("text", F.lit(" | "))), table(spark, d, "pages").withColumnRenamed("page_id", "doc_id")).select("doc_id", "modality", "confidence")


@query("mdl2_rule_atoms", r"SELECT doc_id, pos, length(x)::BIGINT AS n FROM (SELECT doc_id, generate_subscripts(string_split(text, '. '), 1) AS pos, trim(unnest(string_split(text, '. '))) AS x FROM documents) WHERE length(x) >= 10")
def mdl2(spark, d):
    return pipe.rule_atoms(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "pos", F.char_length("atom").cast("long").alias("n"))


#: Sentences that the query's model takes at most; longer texts it refuses.
_MOST = 60


def _splitter(texts: list[str]) -> list[list[str]]:
    out = [[x for x in t.split(". ") if x] for t in texts]
    if any(len(x) > _MOST for x in out):
        raise ValueError("too long")
    return out


@query("mdl2_atomise", f"""WITH s AS (SELECT doc_id, text, list_filter(string_split(text, '. '), lambda x: x <> '') AS x FROM documents)
SELECT doc_id, i AS pos, md5(x[i]) AS atom_md5, 'MODEL' AS kind FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM s WHERE len(x) <= {_MOST}) UNION ALL SELECT doc_id, 1, md5(text), 'FUNCTIONAL' FROM s WHERE len(x) > {_MOST}""")
def mdl2_atomise(spark, d):
    """Ten texts a call to a splitter that refuses long ones: a refused call is asked again text by text, and a refused text is one atom."""
    found = pipe.atomise(table(spark, d, "documents"), "doc_id", "text", _splitter)
    return found.select("doc_id", "pos", F.md5("atom").alias("atom_md5"), "kind")


_PAIRS3 = f"""{knn_sql(5)}, l AS (SELECT p_partkey AS k, p_name || ' ' || p_type AS t, lower(p_name) AS nm FROM part),
x AS MATERIALIZED (SELECT query_id AS atom_id, id AS cap_id, score, a.t AS a, c.t AS b, string_split(a.nm, ' ') AS hints FROM hits JOIN l a ON a.k = query_id % 100 JOIN l c ON c.k = id % 100), {ratio_sql('x')},
s AS (SELECT atom_id, cap_id, x.b, greatest(0.0, least(1.0, least(1.0, 0.25 * x.score + 0.20 * len(list_filter(hints, lambda h: contains(lower(x.b), h))) / len(hints) + 0.15 * r.score / 100 + 0.25 * (cap_id % 3 = 0)::INT + 0.15 * (cap_id % 10) / 10) + CASE WHEN cap_id % 5 = 0 THEN 0.10 ELSE 0 END))::DOUBLE AS c FROM x JOIN ratios r ON r.a = x.a AND r.b = x.b),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY atom_id, b ORDER BY round(c, 6) DESC, cap_id) AS n FROM s) WHERE n = 1)"""


@query("pip3_matched_pairs", f"""WITH {_PAIRS3}, z AS (SELECT *, max(round(c, 6)) OVER (PARTITION BY atom_id) AS best FROM o)
SELECT atom_id, cap_id, row_number() OVER (PARTITION BY atom_id ORDER BY round(c, 6) DESC, cap_id) AS rank, round(c, 6) AS composite, CASE WHEN best > 0.85 AND atom_id % 200 = 0 THEN 'FAST_TRACK' WHEN best >= 0.60 THEN 'DEEP_REASON' ELSE 'GAP_CONFIRM' END AS route FROM z""")
def pip3_pairs(spark, d):
    """Candidates by vectors, with texts, hints and priors: signals, one of equal texts, composite order and route."""
    label = table(spark, d, "part").selectExpr("p_partkey k", "p_name || ' ' || p_type t", "split(lower(p_name), ' ') hints")
    v = table(spark, d, "embeddings").selectExpr("vec_id", "embedding")
    found = hits(spark, d, 5).selectExpr("query_id atom_id", "id cap_id")
    side = lambda name: label.select(F.col("k").alias(f"{name}_k"), F.col("t").alias(f"{name}_text"), *([F.col("hints")] if name == "atom" else []))
    pairs = found.join(v.selectExpr("vec_id atom_id", "embedding atom_vec"), "atom_id").join(v.selectExpr("vec_id cap_id", "embedding cap_vec"), "cap_id")
    pairs = pairs.join(side("atom"), F.col("atom_id") % 100 == F.col("atom_k")).join(side("cap"), F.col("cap_id") % 100 == F.col("cap_k"))
    pairs = pairs.selectExpr("*", "CAST(cap_id % 3 = 0 AS double) historical_alignment", "(cap_id % 10) / 10 rerank_score", "atom_id % 200 = 0 has_history", "cap_id % 5 = 0 has_fit_prior")
    return pipe.matched_pairs(pairs).select("atom_id", "cap_id", F.col("rank").cast("long").alias("rank"), "composite", "route")


@query("pip8_batch_listing", f"WITH {BATCHES} SELECT batch_id, coalesce(u.c_name, '') AS filename, (SELECT count(*) FROM b WHERE status = 'O') AS total FROM b LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) u ON u.c_custkey = upload_id WHERE status = 'O' ORDER BY created_at DESC, batch_id LIMIT 20 OFFSET 20")
def pip8(spark, d):
    return pipe.listing(rel.matching(batches(spark, d), status="O"), uploads(spark, d), offset=20, size=20)


@query("pip9_resume_overrides", f"WITH {VERDICTS} SELECT atom_id, CASE WHEN atom_id % 2 = 0 THEN 'FIT' ELSE classification END AS classification FROM v")
def pip9(spark, d):
    v = verdicts(spark, d).withColumn("flags", F.array(F.lit("low_confidence")))
    dec = v.filter("atom_id % 2 = 0").select("atom_id", F.lit("OVERRIDE").alias("decision"), F.lit("FIT").alias("override_classification"), F.lit("r").alias("reviewer")).distinct()
    return rv.merge_overrides(v, dec).select("atom_id", "classification")


@query("pip10_search_dispatch", f"WITH {_HYBRID} SELECT query_id, id, 'hybrid' AS way FROM both_ UNION ALL SELECT query_id, id, 'dense' FROM hits WHERE rank <= 5")
def pip10(spark, d):
    dense = hits(spark, d, 10)
    both = pipe.search(dense, sparse_hits(spark, d, 10), 5).select("query_id", "id", F.lit("hybrid").alias("way"))
    return both.unionByName(pipe.search(dense, None, 5).select("query_id", "id", F.lit("dense").alias("way")))


@query("pip3_matching", f"""WITH {VERDICTS}, s AS (SELECT atom_id // 8 AS atom, atom_id, module, top_score, round(least(1.0, 0.25 * confidence + 0.20 * top_score + 0.15 * quantity / 50 + 0.25 * reviewed::INT + 0.15 * wave / 7), 6)::DOUBLE AS c, reviewed FROM v),
b AS (SELECT atom, max(c) AS best, bool_or(reviewed) AS h FROM s GROUP BY 1) SELECT atom AS atom_id, best AS composite, CASE WHEN best > 0.85 AND h THEN 'FAST_TRACK' WHEN best >= 0.60 THEN 'DEEP_REASON' ELSE 'GAP_CONFIRM' END AS route FROM b""")
def pip3(spark, d):
    pairs = verdicts(spark, d).select(F.expr("atom_id div 8").alias("atom_id"), F.col("confidence").alias("embedding_cosine"), F.col("top_score").alias("entity_overlap"), (F.col("quantity") / 50).alias("token_ratio"), F.col("reviewed").cast("double").alias("historical_alignment"), (F.col("wave") / 7).alias("rerank_score"), F.col("reviewed").alias("has_history"), F.lit(False).alias("has_fit_prior"))
    return pipe.matched(pairs).select("atom_id", "composite", "route")


@query("pip6_batch_completion", f"WITH {VERDICTS} SELECT batch_id, count(*) AS total, count(*) FILTER (classification = 'FIT') AS fit, count(DISTINCT module) AS modules FROM v WHERE classification <> 'REVIEW_REQUIRED' GROUP BY 1")
def pip6(spark, d):
    v = rv.writable(verdicts(spark, d))
    return v.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("classification") == "FIT").alias("fit"), F.count_distinct("module").alias("modules"))


_OF_ORDER = "sum(CASE WHEN {0} <= 5 THEN s / (1 + log2({0})) END) / (SELECT sum(1 / (1 + log2(i))) FROM range(1, 6) t(i))"


@query("pip11_ranking_evaluation", f"""WITH {knn_sql(10)}, {_SPARSE}, j AS (SELECT query_id, id, h.rank AS old, greatest(h.score, 0) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0::DOUBLE / (60 + h.rank) + coalesce(1.0::DOUBLE / (60 + x.rank), 0), 12) DESC, id) AS new FROM hits h LEFT JOIN sparse x USING (query_id, id)),
m AS (SELECT query_id, {_OF_ORDER.format("old")} AS old, {_OF_ORDER.format("new")} AS new FROM j GROUP BY 1)
SELECT round(avg(old), 6)::DOUBLE AS old_ndcg, round(avg(new), 6)::DOUBLE AS new_ndcg, round(avg(new) - avg(old), 6)::DOUBLE AS delta, count(*) AS queries FROM m""")
def pip11(spark, d):
    """The hits of the stated queries in the order of vectors, and in that of the ranks of vectors and texts together: nDCG@5 with the cosine as relevance, averaged."""
    dense = hits(spark, d, 10)
    both = dense.join(sparse_hits(spark, d, 10).select("query_id", "id", F.col("rank").alias("other")), ["query_id", "id"], "left")
    fused = F.round(scores.rrf(F.col("rank")) + F.coalesce(scores.rrf(F.col("other")), F.lit(0.0)), 12)
    both = both.withColumn("new", F.row_number().over(Window.partitionBy("query_id").orderBy(fused.desc(), "id"))).withColumn("score", F.greatest("score", F.lit(0.0)))
    of = lambda rank: ret.rank_metrics(both.select("query_id", F.col(rank).alias("rank"), "score")).select("query_id", F.col("ndcg").alias(rank))
    return of("rank").join(of("new"), "query_id").agg(F.round(F.avg("rank"), 6).alias("old_ndcg"), F.round(F.avg("new"), 6).alias("new_ndcg"), F.round(F.avg("new") - F.avg("rank"), 6).alias("delta"), F.count("*").alias("queries"))


@query("ded5_upload_hash", "SELECT sha256(html) AS content_hash, min(page_id) AS page_id FROM pages GROUP BY 1")
def ded5(spark, d):
    return table(spark, d, "pages").groupBy(F.sha2("html", 256).alias("content_hash")).agg(F.min("page_id").alias("page_id"))


_GATED = f"""{_REDACTED}, i_ AS MATERIALIZED (SELECT doc_id, len(list_filter([{", ".join(f"regexp_matches(coalesce(text, ''), '(?is){p}')".replace("'(?is)" + p, "'(?is)" + p.replace("'", "''")) for _, p in tx.INJECTION_PATTERNS)}], lambda x: x)) / {len(tx.INJECTION_PATTERNS)}.0 AS score FROM documents),
d_ AS (SELECT doc_id, coalesce(redacted, text) AS t, coalesce(n, 0) AS n_entities, CASE WHEN doc_id % 2 = 0 THEN 'AccountsPayable' ELSE 'Budgeting' END AS module, CASE WHEN doc_id % 3 = 0 THEN 'DE' ELSE '' END AS country, CASE WHEN score >= 0.15 THEN 'FLAG_FOR_REVIEW' ELSE 'PASS' END AS action FROM documents LEFT JOIN r USING (doc_id) JOIN i_ USING (doc_id) WHERE score < 0.5),
a_ AS MATERIALIZED (SELECT * EXCLUDE (x), trim(x) AS text FROM (SELECT doc_id, module, country, action, n_entities, generate_subscripts(string_split(t, '. '), 1) AS pos, unnest(string_split(t, '. ')) AS x FROM d_) WHERE length(trim(x)) >= 10),
w_ AS MATERIALIZED (SELECT *, {TOKENS} AS w, row_number() OVER (PARTITION BY text ORDER BY doc_id, pos) > 1 AS dup FROM a_),
c_ AS (SELECT *, len([x FOR x IN w IF x IN {_in(tx.CONCRETE_NOUNS + tx.SPECIFIC_VERBS)}]) + len([i FOR i IN range(1, len(w)) IF (w[i] || ' ' || w[i + 1]) IN {_in(tx.CONCRETE_NOUNS)}]) AS good, len([x FOR x IN w IF x IN {_in(tx.VAGUE_TERMS)}]) AS bad,
  CASE module {" ".join(f"WHEN '{m}' THEN round_even(100.0 * ({' + '.join('(' + ' AND '.join(f'list_contains(w, {_in([x])[1:-1]})' for x in t.split()) + ')::INT' for t in ts)}) / {len(ts)}, 1)" for m, ts in tx.MODULE_PARAMS.items() if m in ("AccountsPayable", "Budgeting"))} ELSE 50.0 END AS complete FROM w_),
s_ AS (SELECT *, CASE WHEN good + bad = 0 THEN 0.4 ELSE good / (good + bad) END AS s FROM c_)"""


@query("pip1_ingestion", f"""WITH RECURSIVE {_GATED} SELECT doc_id, pos, module, action, n_entities::INT AS n_entities, CASE WHEN dup THEN 'POTENTIAL_DUPLICATE'
 WHEN (module = 'AccountsPayable' AND {_sql_rlike(tx.CUSTOMER_PATTERN)}) OR (country = 'DE' AND {_sql_rlike(tx.GAAP_PATTERN)}) THEN 'SCHEMA_MISMATCH' WHEN s < 0.30 THEN 'TOO_VAGUE' WHEN complete < 30 AND s < 0.50 THEN 'INCOMPLETE' WHEN length(text) < 10 OR length(text) > 2000 THEN 'SCHEMA_MISMATCH' ELSE 'VALIDATED' END AS gate FROM s_""")
def pip1(spark, d):
    module = F.when(F.col("doc_id") % 2 == 0, "AccountsPayable").otherwise("Budgeting")
    country = F.when(F.col("doc_id") % 3 == 0, "DE").otherwise("")
    return pipe.ingested(table(spark, d, "documents"), "doc_id", "text", module, country).select("doc_id", "pos", "module", "action", "n_entities", "gate")


@query("src9_element_windows", """SELECT conv_id, (n // 3 + 1)::INT AS page, (n % 3)::INT AS position, (ceil((n // 3 + 1) / 5.0))::INT AS win, 'TEXT' AS kind, md5(text) AS text_md5
FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)""")
def src9_elements(spark, d):
    """A text file for each conversation, three turns on a page, read as elements in windows of five pages."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))  # one conversation
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / 3).cast("int")), lambda p: F.array_join(F.transform(F.slice("t", p * 3 + 1, F.lit(3)), lambda e: e["text"]), "\n\n"))
    files = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.array_join(pages, "\f").alias("text"))
    folder = f"{shared_folder(spark)}/sparkloom/files-{uuid.uuid4().hex}"
    files.write.partitionBy("conv_id").text(folder)
    elements.register(spark)
    read = spark.read.format("sparkloom_elements").load(folder)
    return read.select(F.regexp_extract("path", r"conv_id=(\d+)/", 1).cast("long").alias("conv_id"), "page", "position", F.col("window").alias("win"), "kind", F.md5("text").alias("text_md5"))


@query("snk12_artifact_store", "SELECT DISTINCT source AS batch_id, 'lang_' || lang AS artifact_type, substr(sha256(text), 1, 16) AS artifact_id, strlen(text)::BIGINT AS size FROM documents")
def snk12_store(spark, d):
    """Every document as an artifact, written twice; the second time nothing is new."""
    rows = table(spark, d, "documents").select(F.col("source").alias("batch_id"), F.concat(F.lit("lang_"), "lang").alias("artifact_type"), F.col("text").cast("binary").alias("content"))
    folder = f"{shared_folder(spark)}/sparkloom/artifacts-{uuid.uuid4().hex}"
    for _ in range(2):
        artifacts.store(rows, folder)
    return artifacts.listing(spark, folder)
