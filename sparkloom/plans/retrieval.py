"""Nearest neighbours, fusion, reranking, matching and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import scores
from sparkloom.functions import text as tx
from sparkloom.functions import values as va
from sparkloom.operators import containment, dedup
from sparkloom.operators import pipelines as pipe
from sparkloom.operators import retrieval as ret
from sparkloom.operators import views as vw
from sparkloom.operators.sparse_index import SparseIndex, exhaustive_sql
from sparkloom.operators.vector_index import VectorIndex
from sparkloom.plans.base import VERDICTS, query, table, verdicts
from sparkloom.plans.texts import TOKENS

_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_COS = f"{_DOT} / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def knn_sql(k: int, same_label: bool = False) -> str:
    part = " AND a.label = b.label" if same_label else ""
    return f"""hits AS (SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id{part} WHERE a.vec_id % 100 = 0) WHERE rank <= {k})"""


def vectors(spark, d):
    return table(spark, d, "embeddings").selectExpr("vec_id id", "embedding vec", "label")


def hits(spark, d, k, same_label=False):
    """The stated queries (ids divisible by 100) against all rows."""
    v = vectors(spark, d)
    return ret.nearest(v.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), v, k, same_part="label" if same_label else None)


@query("srt4_knn_rank_fusion", f"WITH {knn_sql(5, True)} SELECT query_id, id, rank, round(score, 6) AS score, round(1.0 / (60 + rank), 9)::DOUBLE AS rrf FROM hits")
def srt4(spark, d):
    return hits(spark, d, 5, True).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.round(scores.rrf(F.col("rank")), 9).alias("rrf"))


@query("srt4_knn_top20", f"WITH {knn_sql(20)} SELECT query_id, id, rank, round(score, 6) AS score FROM hits")
def srt4_20(spark, d):
    return hits(spark, d, 20).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("srt5_priors_overrides_first", f"WITH {knn_sql(10)} SELECT query_id, id, prior_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (id % 4 = 0) DESC, rank) AS prior_rank FROM hits) WHERE prior_rank <= 5")
def srt5(spark, d):
    return ret.priors_first(hits(spark, d, 10).withColumn("override", F.col("id") % 4 == 0), 5).select("query_id", "id", F.col("prior_rank").cast("long").alias("prior_rank"))


#: Documents that have a vector, and of these the stated queries: one id names both.
_TEXTS = "base_ AS MATERIALIZED (SELECT doc_id AS id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)), asked_ AS (SELECT id AS query_id, text FROM base_ WHERE id % 100 = 0)"
_SPARSE = f"{_TEXTS}, {exhaustive_sql('base_', 'asked_', 10, TOKENS)}"
_HYBRID = f"""{knn_sql(10)}, {_SPARSE}, fused_ AS (SELECT query_id, id, coalesce(1.0::DOUBLE / (60 + h.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS score FROM hits h FULL JOIN sparse s USING (query_id, id)),
both_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM fused_) WHERE rank <= 5)"""


def sparse_hits(spark, d, k: int):
    """The stated queries' texts through the sparse index of all documents that have a vector."""
    texts = table(spark, d, "documents").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text")
    words = tx.tokens(F.col("text"))
    return SparseIndex.build(texts, "id", words).search_blocks(texts.filter("id % 100 = 0"), k, "id", words)


@query("txt18_bm25_top10", f"WITH base_ AS (SELECT doc_id AS id, text FROM documents), asked_ AS (SELECT item_id AS query_id, text FROM benchmark), {exhaustive_sql('base_', 'asked_', 10, TOKENS)} SELECT query_id, id, rank, round(score, 6) AS score FROM sparse")
def txt18_top(spark, d):
    """All benchmark items against all documents."""
    words = tx.tokens(F.col("text"))
    found = SparseIndex.build(table(spark, d, "documents"), "doc_id", words).search_sent(table(spark, d, "benchmark"), 10, "item_id", words)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("srt10_hybrid", f"WITH {_HYBRID} SELECT query_id, id, round(score, 9) AS score, rank FROM both_")
def srt10(spark, d):
    return ret.hybrid(hits(spark, d, 10), sparse_hits(spark, d, 10), 5).select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("srt6_rerank", f"WITH {knn_sql(20)} SELECT query_id, id, round(1 / (1 + exp(-score * 10)), 6) AS rerank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS n FROM hits) WHERE n <= 7")
def srt6(spark, d):
    h = hits(spark, d, 20).withColumn("rerank", scores.sigmoid(F.col("score") * 10))
    return h.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rerank").desc(), "rank"))).filter("n <= 7").select("query_id", "id", F.round("rerank", 6).alias("rerank"))


@query("mth1_normalise", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm_before, 1.0::DOUBLE AS norm_after FROM embeddings")
def mth1(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(scores.norm(F.col("embedding")), 5).alias("norm_before"), F.round(scores.norm(scores.normalise(F.col("embedding"))), 6).alias("norm_after"))


@query("mth3_distances", f"SELECT a.vec_id, round({_COS}, 6) AS cosine, round({_DOT}, 6) AS dot, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclid FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def mth3(spark, d):
    a, b = vectors(spark, d), vectors(spark, d).selectExpr("id - 1 id", "vec w")
    x, y = F.col("vec"), F.col("w")
    return a.join(b, "id").select(F.col("id").alias("vec_id"), F.round(scores.cosine(x, y), 6).alias("cosine"), F.round(scores.dot(x, y), 6).alias("dot"), F.round(scores.euclid(x, y), 6).alias("euclid"))


_FUSION = f"""{knn_sql(12)}, caps AS (SELECT query_id AS atom_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM hits WHERE id % 3 = 0), docs AS (SELECT query_id AS atom_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM hits WHERE id % 3 = 1),
priors AS (SELECT query_id AS atom_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, least(1.0, 0.10 + 0.60 * (id % 10) / 10 + CASE WHEN id % 2 = 0 THEN 0.15 ELSE 0 END)::DOUBLE AS prior_score FROM hits WHERE id % 3 = 2),
fused AS (SELECT atom_id, 'capability' AS source, id, rank, 1.0::DOUBLE / (60 + rank) AS score FROM caps UNION ALL SELECT atom_id, 'doc', id, rank, 1.0::DOUBLE / (60 + rank) FROM docs UNION ALL SELECT atom_id, 'prior', id, rank, prior_score / (60 + rank) FROM priors)"""


def _fused(spark, d):
    h = hits(spark, d, 12).withColumnRenamed("query_id", "atom_id")
    ranked = lambda k: h.filter(f"id % 3 = {k}").withColumn("rank", F.row_number().over(Window.partitionBy("atom_id").orderBy("rank")))
    priors = ranked(2).withColumn("prior_score", scores.prior_score(F.lit("FIT"), (F.col("id") % 10) / 10, F.col("id") % 2 == 0))
    return ret.tagged_union(ranked(0), ranked(1), priors)


@query("set1_mth7_source_fusion", f"WITH {_FUSION} SELECT atom_id, source, id, rank, round(score, 9) AS score FROM fused")
def set1(spark, d):
    return _fused(spark, d).select("atom_id", "source", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


_BOOST = """boosted AS (SELECT f.atom_id, f.id, f.source, least(1.0, f.score + CASE WHEN f.source = 'capability' AND EXISTS (SELECT 1 FROM fused g WHERE g.atom_id = f.atom_id AND g.source = 'doc' AND g.id % 7 = f.id % 7) THEN 0.08 ELSE 0 END) AS score, f.rank FROM fused f)"""


@query("jon10_mth8_doc_boost", f"WITH {_FUSION}, {_BOOST} SELECT atom_id, source, id, round(score, 9) AS score, row_number() OVER (PARTITION BY atom_id ORDER BY round(score, 9) DESC, CASE source WHEN 'capability' THEN 0 WHEN 'doc' THEN 1 ELSE 2 END, rank) AS fused_rank FROM boosted")
def jon10(spark, d):
    f = _fused(spark, d).withColumn("feature", F.concat(F.lit("feature "), (F.col("id") % 7).cast("string")))
    caps = f.filter("source = 'capability'")
    docs = f.filter("source = 'doc'").select(F.col("atom_id").alias("a"), F.concat(F.lit("About "), F.col("feature")).alias("title"))
    told = caps.join(docs, (F.col("atom_id") == F.col("a")) & ret.mentions(F.col("feature"), F.col("title")), "left_semi").select("atom_id", "source", "id", F.lit(scores.DOC_BOOST).alias("boost"))
    s = F.least(F.lit(1.0), F.col("score") + F.coalesce("boost", F.lit(0.0)))
    out = f.join(told, ["atom_id", "source", "id"], "left").withColumn("score", F.round(s, 9))
    order = F.when(F.col("source") == "capability", 0).when(F.col("source") == "doc", 1).otherwise(2)
    return out.select("atom_id", "source", "id", "score", F.row_number().over(Window.partitionBy("atom_id").orderBy(F.col("score").desc(), order, "rank")).cast("long").alias("fused_rank"))


@query("jon11_prior_boost_first_match", f"""WITH {_FUSION}, m AS (SELECT p.atom_id, p.id AS prior, c.id, row_number() OVER (PARTITION BY p.atom_id, p.id ORDER BY c.rank) AS n FROM priors p JOIN caps c ON c.atom_id = p.atom_id AND c.id % 5 = p.id % 5)
SELECT c.atom_id, c.id, round(least(1.0, 1.0::DOUBLE / (60 + c.rank) + 0.12 * count(m.prior)), 9) AS score FROM caps c LEFT JOIN m ON m.atom_id = c.atom_id AND m.id = c.id AND m.n = 1 GROUP BY c.atom_id, c.id, c.rank""")
def jon11(spark, d):
    f = _fused(spark, d)
    caps = f.filter("source = 'capability'").withColumn("feature", F.concat(F.lit("feature "), (F.col("id") % 5).cast("string")))
    priors = f.filter("source = 'prior'").select(F.col("atom_id").alias("a"), F.col("id").alias("prior"), F.concat(F.lit("Chosen for FEATURE "), (F.col("id") % 5).cast("string")).alias("rationale"))
    m = caps.join(priors, (F.col("atom_id") == F.col("a")) & ret.mentions(F.col("feature"), F.col("rationale")))
    first = m.withColumn("n", F.row_number().over(Window.partitionBy("a", "prior").orderBy("rank"))).filter("n = 1").groupBy("atom_id", "id").agg(F.count("*").alias("boosts"))
    return caps.join(first, ["atom_id", "id"], "left").select("atom_id", "id", F.round(F.least(F.lit(1.0), F.col("score") + scores.PRIOR_BOOST * F.coalesce("boosts", F.lit(0))), 9).alias("score"))


_FEATURES = "a AS MATERIALIZED (SELECT DISTINCT lower(trim(x)) AS x FROM (SELECT unnest([p_name, p_type, p_brand] || string_split(p_name, ' ')) AS x FROM part UNION ALL SELECT unnest(string_split(text, '. ')) FROM benchmark))"


def features(spark, d):
    """Distinct names, types and brands of parts, their words, and the sentences of benchmark items."""
    parts = table(spark, d, "part").select(F.explode(F.concat(F.array("p_name", "p_type", "p_brand"), F.split("p_name", " "))).alias("x"))
    lines = table(spark, d, "benchmark").select(F.explode(F.split("text", r"\. ")).alias("x"))
    return parts.unionByName(lines).select(F.lower(F.trim("x")).alias("x")).distinct()


@query("jon10_features_in_texts", f"WITH {_FEATURES} SELECT x AS feature, doc_id FROM a JOIN documents ON x <> '' AND lower(trim(text)) <> '' AND (contains(lower(trim(text)), x) OR contains(x, lower(trim(text))))")
def jon10_texts(spark, d):
    """Features against whole documents, either way round."""
    f = features(spark, d).withColumn("feature", F.col("x"))
    return containment.either_way(f, table(spark, d, "documents"), "feature", "x", "doc_id", "text")


@query("txt6_overlap_of_features", f"WITH {_FEATURES} SELECT doc_id, count(*)::DOUBLE / (SELECT count(*) FROM a WHERE x <> '') AS overlap FROM a JOIN documents ON x <> '' AND contains(lower(trim(text)), x) GROUP BY 1")
def txt6_features(spark, d):
    """The share of all features that each document holds; documents without any are left out."""
    f = features(spark, d).filter("x <> ''").withColumn("feature", F.col("x"))
    total = f.count()
    return containment.contained(f, table(spark, d, "documents"), "feature", "x", "doc_id", "text").groupBy("doc_id").agg((F.count("*") / F.lit(total)).alias("overlap"))


@query("mth6_prior_score", f"WITH {VERDICTS} SELECT atom_id, round(least(1.0, CASE classification WHEN 'FIT' THEN 0.10 WHEN 'PARTIAL_FIT' THEN 0.05 ELSE 0 END + 0.60 * confidence + CASE WHEN reviewed THEN 0.15 ELSE 0 END), 6)::DOUBLE AS score FROM v")
def mth6(spark, d):
    return verdicts(spark, d).select("atom_id", F.round(scores.prior_score(F.col("classification"), F.col("confidence"), F.col("reviewed")), 6).alias("score"))


@query("win2_adaptive_k", f"""WITH {knn_sql(10)}, g AS (SELECT *, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS gap, count(*) OVER (PARTITION BY query_id) AS n FROM hits),
c AS (SELECT query_id, arg_max(rank, round(gap, 9) * 1000 - rank / 1e7) AS k FROM g WHERE rank BETWEEN 3 AND least(7, n - 1) GROUP BY 1) SELECT query_id, count(*) AS kept FROM hits JOIN c USING (query_id) WHERE rank <= k GROUP BY 1""")
def win2(spark, d):
    return ret.adaptive_k(hits(spark, d, 10)).groupBy("query_id").agg(F.count("*").alias("kept"))


@query("win3_retrieval_quality", f"""WITH {knn_sql(6)}, q AS (SELECT query_id, max(score) AS top1, max(CASE WHEN rank = 5 THEN score END) AS fifth FROM hits GROUP BY 1)
SELECT query_id, CASE (top1 > 0.5)::INT + (top1 - fifth > 0.01)::INT + (query_id % 200 = 0)::INT WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS quality FROM q""")
def win3(spark, d):
    return ret.quality(hits(spark, d, 6), F.col("query_id") % 200 == 0).select("query_id", "quality")


@query("mth9_calibrated", f"WITH {VERDICTS} SELECT atom_id, round(least(1.0, top_score * CASE wave % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 ELSE 0.70 END * CASE WHEN reviewed THEN 1.1 ELSE 1 END), 6)::DOUBLE AS calibrated FROM v")
def mth9(spark, d):
    q = F.when(F.col("wave") % 3 == 0, "HIGH").when(F.col("wave") % 3 == 1, "MEDIUM").otherwise("LOW")
    return verdicts(spark, d).select("atom_id", F.round(scores.calibrated(F.col("top_score"), q, F.col("reviewed")), 6).alias("calibrated"))


@query("win4_greedy_capabilities", f"""WITH RECURSIVE {VERDICTS}, i AS (SELECT DISTINCT batch_id, wave, round(confidence, 1) AS x FROM v), k AS (SELECT batch_id, wave, min(x) AS x, 1 AS n FROM i GROUP BY ALL
UNION ALL SELECT batch_id, wave, (SELECT min(i.x) FROM i WHERE i.batch_id = k.batch_id AND i.wave = k.wave AND i.x - k.x >= 0.15) AS x, n + 1 FROM k WHERE EXISTS (SELECT 1 FROM i WHERE i.batch_id = k.batch_id AND i.wave = k.wave AND i.x - k.x >= 0.15))
SELECT batch_id, wave, max(n)::BIGINT AS kept FROM k GROUP BY ALL""")
def win4(spark, d):
    v = verdicts(spark, d).groupBy("batch_id", "wave").agg(F.array_sort(F.collect_set(F.round("confidence", 1))).alias("items"))
    return v.select("batch_id", "wave", F.size(ret.greedy_distinct(F.col("items"), lambda x, y: F.abs(x - y) < 0.15)).cast("long").alias("kept"))


@query("win4_greedy_by_cosine", f"""WITH RECURSIVE {knn_sql(20)}, h AS MATERIALIZED (SELECT query_id, id, rank, embedding::DOUBLE[] AS v FROM hits JOIN embeddings ON vec_id = id),
s AS MATERIALIZED (SELECT a.query_id, a.id, a.rank, list(b.id) FILTER (b.id <> a.id AND list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) > 0.2) AS near FROM h a JOIN h b USING (query_id) GROUP BY ALL),
r AS (SELECT query_id, rank, [id] AS kept FROM s WHERE rank = 1 UNION ALL SELECT s.query_id, s.rank, CASE WHEN list_has_any(kept, coalesce(near, [])) THEN kept ELSE list_append(kept, s.id) END FROM r JOIN s ON s.query_id = r.query_id AND s.rank = r.rank + 1)
SELECT query_id, len(arg_max(kept, rank))::BIGINT AS kept, md5(array_to_string(arg_max(kept, rank), ',')) AS ids_md5 FROM r GROUP BY 1""")
def win4_cosine(spark, d):
    """The 20 best of each query in order of score, without those alike to a kept one. The library's bound is 0.95; vectors of the sample are never so close."""
    v = vectors(spark, d).select("id", "vec")
    lists = hits(spark, d, 20).join(v, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "vec"))).alias("x"))  # 20 a query
    kept = ret.greedy_distinct(F.col("x"), lambda a, b: scores.cosine(a["vec"], b["vec"]) > 0.2)
    return lists.select("query_id", F.transform(kept, lambda e: e["id"]).alias("k")).select("query_id", F.size("k").cast("long").alias("kept"), F.md5(F.array_join(F.col("k").cast("array<string>"), ",")).alias("ids_md5"))


@query("win6_trim_descriptions", f"""WITH {knn_sql(20)}, l AS (SELECT query_id, h.id, d.n_chars AS n, greatest(0, d.n_chars - 80) AS cap FROM hits h JOIN documents d ON d.doc_id = h.id),
o AS (SELECT *, sum(n) OVER (PARTITION BY query_id) - 12288 AS over, coalesce(sum(cap) OVER (PARTITION BY query_id ORDER BY n DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given FROM l)
SELECT query_id, id, (n - least(cap, greatest(0, over - given)))::BIGINT AS n_chars FROM o""")
def win6(spark, d):
    sizes = table(spark, d, "documents").selectExpr("doc_id id", "n_chars n")
    return ret.trim_descriptions(hits(spark, d, 20).select("query_id", "id").join(sizes, "id"), ["query_id"], "id", "n", 12288).select("query_id", "id", F.col("n").alias("n_chars"))


@query("mth10_composite_and_route", f"""WITH {VERDICTS}, c AS (SELECT atom_id, reviewed, greatest(0.0, least(1.0, least(1.0, 0.25 * confidence + 0.20 * top_score + 0.15 * quantity / 50 + 0.25 * reviewed::INT + 0.15 * wave / 7) + CASE WHEN classification = 'FIT' THEN 0.10 ELSE 0 END))::DOUBLE AS s FROM v)
SELECT atom_id, round(s, 6) AS composite, CASE WHEN round(s, 6) > 0.85 AND reviewed THEN 'FAST_TRACK' WHEN round(s, 6) >= 0.60 THEN 'DEEP_REASON' ELSE 'GAP_CONFIRM' END AS route FROM c""")
def mth10(spark, d):
    signals = {"embedding_cosine": F.col("confidence"), "entity_overlap": F.col("top_score"), "token_ratio": F.col("quantity") / 50, "historical_alignment": F.col("reviewed").cast("int"), "rerank_score": F.col("wave") / 7}
    s = verdicts(spark, d).withColumn("composite", F.round(scores.composite(signals, F.col("classification") == "FIT"), 6))
    return s.select("atom_id", "composite", scores.route(F.col("composite"), F.col("reviewed")).alias("route"))


@query("agg5_route_counts", f"WITH {VERDICTS} SELECT CASE WHEN confidence > 0.85 AND reviewed THEN 'FAST_TRACK' WHEN confidence >= 0.60 THEN 'DEEP_REASON' ELSE 'GAP_CONFIRM' END AS route, count(*) AS n FROM v GROUP BY 1")
def agg5(spark, d):
    return verdicts(spark, d).groupBy(scores.route(F.col("confidence"), F.col("reviewed")).alias("route")).agg(F.count("*").alias("n"))


@query("flt13_anomaly", f"WITH {VERDICTS} SELECT atom_id, format('high cosine ({{:.2f}}) but low entity overlap ({{:.2f}})', confidence, top_score) AS message FROM v WHERE confidence > 0.85 AND top_score < 0.20")
def flt13(spark, d):
    return verdicts(spark, d).select("atom_id", scores.anomaly(F.col("confidence"), F.col("top_score")).alias("message")).filter(F.col("message").isNotNull())


@query("srt8_composite_order", f"WITH {VERDICTS} SELECT batch_id, atom_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY top_score DESC, atom_id) AS rank FROM v) WHERE rank <= 10")
def srt8(spark, d):
    ranked = vw.positions(verdicts(spark, d), ["batch_id"], F.col("top_score").desc(), "atom_id", name="rank")
    return ranked.filter("rank <= 10").select("batch_id", "atom_id", F.col("rank").cast("long").alias("rank"))


_PAIRS = f"""p AS (SELECT a.vec_id AS i, b.vec_id AS j, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)"""


@query("ded2_duplicate_owners", f"WITH {_PAIRS}, h AS (SELECT j, min(i) AS owner FROM p WHERE s > 0.35 GROUP BY 1), f AS (SELECT DISTINCT j FROM p WHERE s > 0.25 AND s <= 0.35) SELECT vec_id AS id, owner, (owner IS NULL AND f.j IS NOT NULL) AS soft FROM embeddings LEFT JOIN h ON h.j = vec_id LEFT JOIN f ON f.j = vec_id")
def ded2(spark, d):
    return dedup.owners(vectors(spark, d), hard=0.35, soft=0.25, block="label").select("id", "owner", "soft")


@query("ded3_greedy_duplicates", f"""WITH RECURSIVE {_PAIRS}, o AS (SELECT i, j, row_number() OVER (ORDER BY i, j) AS n FROM p WHERE s > 0.35),
r AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS gone UNION ALL SELECT o.n, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone ELSE list_append(gone, j) END FROM r JOIN o ON o.n = r.n + 1),
g AS (SELECT unnest(gone) AS id FROM r WHERE n = (SELECT max(n) FROM r)), w AS (SELECT j, min(i) AS owner FROM o WHERE i NOT IN (SELECT id FROM g) GROUP BY 1),
f AS (SELECT j, min(i) AS first FROM p WHERE s > 0.25 AND s <= 0.35 AND i NOT IN (SELECT id FROM g) GROUP BY 1)
SELECT vec_id AS id, owner, (first IS NOT NULL AND (owner IS NULL OR first < owner)) AS soft FROM embeddings LEFT JOIN w ON w.j = vec_id LEFT JOIN f ON f.j = vec_id""")
def ded3(spark, d):
    return dedup.greedy(vectors(spark, d), hard=0.35, soft=0.25, block="label")


_WHOLE = f"p AS (SELECT a.vec_id AS i, b.vec_id AS j, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"


def _greedy_sql(pairs: str, base: str = "embeddings") -> str:
    return f"""WITH RECURSIVE {pairs}, o AS MATERIALIZED (SELECT i, j, row_number() OVER (ORDER BY i, j) AS n FROM p WHERE s > 0.35),
r AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS gone UNION ALL SELECT o.n, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone ELSE list_append(gone, j) END FROM r JOIN o ON o.n = r.n + 1),
g AS MATERIALIZED (SELECT unnest(gone) AS id FROM r WHERE n = (SELECT max(n) FROM r)), w AS (SELECT j, min(i) AS owner FROM o WHERE i NOT IN (SELECT id FROM g) GROUP BY 1),
f AS (SELECT j, min(i) AS first FROM p WHERE s > 0.25 AND s <= 0.35 AND i NOT IN (SELECT id FROM g) GROUP BY 1)
SELECT vec_id AS id, owner, (first IS NOT NULL AND (owner IS NULL OR first < owner)) AS soft FROM {base} LEFT JOIN w ON w.j = vec_id LEFT JOIN f ON f.j = vec_id"""


@query("ded3_index_duplicates", _greedy_sql(_WHOLE))
def ded3_index(spark, d):
    """The whole table as one block: pairs through the index."""
    return dedup.greedy_by_index(vectors(spark, d), hard=0.35, soft=0.25)


@query("srt4_index_top20")
def srt4_index(spark, d):
    """The stated queries through an index of all rows; tests print and hold its recall against `srt4_knn_top20`."""
    v = vectors(spark, d)
    found = VectorIndex.build(v).search(v.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), 20)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("ded4_merge", f"WITH {_PAIRS}, h AS (SELECT j, min(i) AS owner FROM p WHERE s > 0.35 GROUP BY 1), m AS (SELECT owner, string_agg(j::VARCHAR, ',' ORDER BY j) AS ids, count(*) AS n FROM h GROUP BY 1) SELECT vec_id AS id, vec_id || coalesce(',' || ids, '') AS source_ref, coalesce(n, 0) AS absorbed FROM embeddings LEFT JOIN m ON owner = vec_id WHERE vec_id NOT IN (SELECT j FROM h)")
def ded4(spark, d):
    v = vectors(spark, d)
    return dedup.merge(v.select("id", F.col("id").cast("string").alias("source_ref")), dedup.owners(v, hard=0.35, soft=0.25, block="label"))


@query("ded6_distinct_texts", "SELECT min(doc_id) AS first_doc, md5(text) AS h FROM documents GROUP BY 2")
def ded6(spark, d):
    return vw.first_uploads(table(spark, d, "documents").withColumnRenamed("doc_id", "first_doc"), "first_doc", F.md5("text")).select("first_doc", F.col("content_hash").alias("h"))


_NDCG = "sum(CASE WHEN rank <= 5 THEN score / (1 + log2(rank)) END) / (SELECT sum(1 / (1 + log2(i))) FROM range(1, 6) t(i))"


@query("agg17_rank_metrics", f"""WITH r AS (SELECT conv_id AS query_id, turn + 1 AS rank, ((length(text) % 100) / 100.0)::DOUBLE AS score FROM conversations)
SELECT query_id, round({_NDCG}, 6) AS ndcg, round(sum(CASE WHEN rank <= 5 THEN score / log2(rank + 1) END) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 6) t(i)), 6) AS ndcg_standard, round(coalesce(1.0 / min(CASE WHEN score > 0.5 THEN rank END), 0), 6)::DOUBLE AS mrr,
 round(CASE WHEN count(*) FILTER (score > 0.5) = 0 THEN 1.0 ELSE count(*) FILTER (score > 0.5 AND rank <= 5) / count(*) FILTER (score > 0.5) END, 6)::DOUBLE AS recall, coalesce(min(CASE WHEN score > 0.5 THEN rank END) <= 5, false) AS success FROM r GROUP BY 1""")
def agg17(spark, d):
    r = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), ((F.char_length("text") % 100) / 100.0).alias("score"))
    m = ret.rank_metrics(r)
    return m.select("query_id", *(F.round(c, 6).alias(c) for c in ("ndcg", "ndcg_standard", "mrr", "recall")), "success")


@query("agg18_metric_change", """WITH r AS (SELECT turn % 2 AS side, ((length(text) % 100) / 100.0)::DOUBLE AS s FROM conversations), a AS (SELECT avg(s) FILTER (side = 0) AS old, avg(s) FILTER (side = 1) AS new FROM r)
SELECT round(old, 6) AS old, round(new, 6) AS new, round(new - old, 6) AS delta, round(CASE WHEN old > 0 THEN 100 * (new - old) / old ELSE 0 END, 4) AS pct FROM a""")
def agg18(spark, d):
    r = table(spark, d, "conversations").select((F.col("turn") % 2).alias("side"), ((F.char_length("text") % 100) / 100.0).alias("s"))
    a = r.agg(F.avg(F.when(F.col("side") == 0, F.col("s"))).alias("old"), F.avg(F.when(F.col("side") == 1, F.col("s"))).alias("new"))
    out = a.select("old", "new", *va.change(F.col("old"), F.col("new")))
    return out.select(*(F.round(c, 6).alias(c) for c in ("old", "new", "delta")), F.round("pct", 4).alias("pct"))


@query("src20_synthetic_ranking", """WITH p AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey, pos::INT AS pos, round(0.95 / pow(pos + 1, 0.8), 9) AS capability, round(0.90 / pow(pos + 1, 0.7), 9) AS doc, CASE WHEN pos = n - 1 THEN 'PARTIAL_FIT' ELSE 'FIT' END AS prior FROM p""")
def src20(spark, d):
    """A made-up ranking of each brand's parts."""
    return vw.power_law_ranking(table(spark, d, "part"), "p_brand", "p_partkey").withColumns({c: F.round(c, 9) for c in ("capability", "doc")})


@query("mdl7_explain", f"WITH {_FUSION} SELECT atom_id, string_agg(source || ':' || id, ' > ' ORDER BY round(score, 9) DESC, source, id) AS explanation FROM fused GROUP BY 1")
def mdl7(spark, d):
    f = _fused(spark, d).groupBy("atom_id").agg(F.sort_array(F.collect_list(F.struct((-F.round("score", 9)).alias("s"), "source", "id"))).alias("x"))
    return f.select("atom_id", F.array_join(F.transform("x", lambda e: F.concat_ws(":", e["source"], e["id"])), " > ").alias("explanation"))


@query("agg32_sources_available", f"WITH {_FUSION} SELECT atom_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM fused GROUP BY 1")
def agg32(spark, d):
    has = lambda s: F.when(F.count_if(F.col("source") == s) > 0, F.lit(s))
    return _fused(spark, d).groupBy("atom_id").agg(F.concat_ws(",", has("capability"), has("doc"), has("prior")).alias("sources"))


@query("pip2_retrieval", f"""WITH {knn_sql(10)}, g AS (SELECT *, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS gap FROM hits), c AS (SELECT query_id, arg_max(rank, round(gap, 9) * 1000 - rank / 1e7) AS k FROM g WHERE rank BETWEEN 3 AND 7 GROUP BY 1),
t AS (SELECT * FROM hits JOIN c USING (query_id) WHERE rank <= k), z AS (SELECT query_id, (max(score) > 0.5)::INT + (max(score) - arg_max(score, least(rank, 5) * 1000 - rank) > 0.01)::INT AS p, query_id % 200 = 0 AS h FROM t GROUP BY query_id)
SELECT query_id, any_value(CASE p + h::INT WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END) AS quality, count(*) AS kept, round(max(least(1.0, score * CASE p + h::INT WHEN 3 THEN 1.0 WHEN 2 THEN 0.85 ELSE 0.70 END * CASE WHEN h THEN 1.1 ELSE 1.0 END)), 6)::DOUBLE AS best, md5(string_agg(id::VARCHAR, ',' ORDER BY rank)) AS provenance FROM t JOIN z USING (query_id) GROUP BY 1""")
def pip2(spark, d):
    kept = ret.adaptive_k(hits(spark, d, 10))
    history = F.col("query_id") % 200 == 0
    graded = kept.join(ret.quality(kept, history).select("query_id", "quality"), "query_id")
    got = graded.groupBy("query_id", "quality").agg(F.count("*").alias("kept"), F.max(scores.calibrated(F.col("score"), F.col("quality"), history)).alias("best"), F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("x"))
    return got.select("query_id", "quality", "kept", F.round("best", 6).alias("best"), F.md5(F.array_join(F.transform("x", lambda e: e["id"].cast("string")), ",")).alias("provenance"))


@query("mth2_cosine", f"SELECT a.vec_id AS id, round({_COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def mth2(spark, d):
    v = vectors(spark, d)
    both = v.select("id", "vec").join(v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other")), "id")
    return both.select("id", F.round(scores.cosine(F.col("vec"), F.col("other")), 6).alias("cosine"))


@query("srt17_kb_search", f"""SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.label = 3) WHERE rank <= 10""")
def srt17(spark, d):
    """The knowledge base of one module; a query that is in it finds itself."""
    v = vectors(spark, d)
    found = pipe.kb_search(v.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), v.withColumnRenamed("label", "module"), 10, 3)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))
